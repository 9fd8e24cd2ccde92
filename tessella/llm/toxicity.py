"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel. A string's features are its three-letter subsequences that span at most six letters,
each weighted DECAY ** (span - 1); gaps and inserted characters lower a match, they do not lose it.
The kernel is the cosine of these features. Letters are case folded, some digits count as the
letter they resemble, other marks are dropped, so "i.d.1.o.t" is "idiot"; three or more
single letters in a row ("i d i o t") also count as one string. A word of over 24 letters is read in
overlapping windows.

Training. Labels are of documents, insults are strings, so witnesses are found first: four-letter
pieces, and the strings that hold them, that stand in toxic documents far more often than chance
allows. The machine learns witnesses against strings of clean documents, with rounds of
hard negatives. Landmarks are a bounded set of training strings. A linear machine over landmark
kernels is a linear function of the subsequence features, so the model is one table of
64 ** 3 weights, whatever the corpus. A document's margin is that of its worst string; a logistic
curve fitted on the training documents makes it a score. Training uses at most `max_train` labelled rows,
chosen by a hash of doc_id; groups of near copies among them count once.

Defined results: null and empty texts have no strings and get the lowest score. Rows with a
null doc_id or label are not trained on. Without a label of either class the score is the share of
toxic labels (0 without labels). Repeated rows are scored alike. Extra columns are ignored by
`score_documents` and returned unchanged by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, split_words, text_bytes, text_slices, vocab_hashes

SPAN, DECAY, WINDOW = 6, 0.6, 24
LANDMARKS, ROUNDS, MAX_TRAIN = 192, 4, 12_000
#: Strings below this share of the decision threshold count as no match.
FLOOR = 0.3
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k in range(26):
        table[[65 + k, 97 + k]] = 1 + k
    for digit, letter in zip(b"013457@", b"oieasta", strict=True):
        table[digit] = table[letter]
    for b in range(0x80, 0xC0):  # continuation bytes; lead bytes are dropped
        table[b] = 32 + (b & 31)
    return table


LETTERS = _letters()


def letter_codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (1 to 63) of each string end to end, and offsets."""
    raw, offsets = text_bytes(strings)
    codes = LETTERS[raw]
    full = codes > 0
    return codes[full], np.concatenate([[0], np.cumsum(full)])[offsets]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, length) of the pieces that are read: whole strings, or overlapping windows of long ones."""
    length = np.diff(offsets)
    short = np.flatnonzero((length >= 3) & (length <= WINDOW))
    owner, start, size = [short], [offsets[short]], [length[short]]
    for s in np.flatnonzero(length > WINDOW):
        at = np.arange(0, length[s] - WINDOW // 2, WINDOW // 2)
        owner.append(np.full(len(at), s))
        start.append(offsets[s] + at)
        size.append(np.minimum(WINDOW, length[s] - at))
    return np.concatenate(owner), np.concatenate(start), np.concatenate(size)


def _keys(codes: np.ndarray, start: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, float]]:
    """Subsequence keys of strings of one length, by pattern of gaps, with the pattern's weight."""
    rows = codes[start[:, None] + np.arange(size)].astype(np.int32)
    for a, b in PATTERNS:
        if b < size:
            yield rows[:, : size - b] << 12 | rows[:, a : size - b + a] << 6 | rows[:, b:], DECAY**b


def norms(codes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Length of the feature vectors of strings of one length."""
    flat, weight = [], []
    base = np.arange(len(start), dtype=np.int64)[:, None] << 18
    for keys, w in _keys(codes, start, size):
        flat.append((base | keys).ravel())
        weight.append(np.full(keys.size, w))
    distinct, at = np.unique(np.concatenate(flat), return_inverse=True)
    value = np.bincount(at, np.concatenate(weight))
    return np.sqrt(np.bincount(distinct >> 18, value**2, minlength=len(start)))


def project(codes: np.ndarray, offsets: np.ndarray, table: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Largest value of table . features / |features| over each string's windows; 0 if none can reach the floor."""
    out = np.zeros(len(offsets) - 1)
    owner, start, size = windows(offsets)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for own in np.array_split(own, max(1, len(own) // 20_000)):
            value = np.zeros(len(own), np.float32)
            least = 0.0  # a feature vector is at least as long as if no subsequence came twice
            for keys, w in _keys(codes, start[own], n):
                value += np.float32(w) * table[keys].sum(axis=1)
                least += w * w * keys.shape[1]
            good = value > floor * np.sqrt(least)
            if good.any():
                np.maximum.at(out, owner[own[good]], value[good] / norms(codes, start[own[good]], n))
    return out


def features(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit feature vector (keys, values) of each string's first window."""
    out = []
    for s in range(len(offsets) - 1):
        size = min(WINDOW, int(offsets[s + 1] - offsets[s]))
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, w in _keys(codes, offsets[s : s + 1], size) if size >= 3 else ():
            keys.append(k.ravel().astype(np.int64))
            values.append(np.full(k.size, w))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(at, np.concatenate(values), minlength=len(key))
        out.append((key, value / max(np.linalg.norm(value), 1e-12)))
    return out


def stacked(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, and one column of values for each vector."""
    known = np.unique(np.concatenate([k for k, _ in vectors]))
    out = np.zeros((len(known), len(vectors)), np.float32)
    for j, (k, v) in enumerate(vectors):
        out[np.searchsorted(known, k), j] = v
    return known, out


@dataclass
class Machine:
    """Subsequence weights (None: the constant score), and the logistic curve over margins."""

    weights: np.ndarray | None
    floor: float
    bias: float
    slope: float
    constant: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.bias, -30, 30)))


def strings_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct strings of a slice, and (row, string) of each occurrence: words, and runs of single letters."""
    words = split_words(texts, lower=True)
    codes, offsets = letter_codes(words.vocab)
    rows = words.rows
    single = (np.diff(offsets) == 1)[words.ids] if len(words.vocab) else np.zeros(0, bool)
    if not single.any():
        return words.vocab, rows, words.ids
    at = np.flatnonzero(single)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(rows[at]) > 0)]))
    ends = np.append(new[1:], len(at))
    long = np.flatnonzero(ends - new >= 3)
    vocab = words.vocab.to_pylist()
    joined = ["".join(vocab[words.ids[i]] for i in at[new[k] : ends[k]]) for k in long]
    both = pa.concat_arrays([words.vocab, pa.array(joined, words.vocab.type)])
    return both, np.concatenate([rows, rows[at[new[long]]]]), np.concatenate([words.ids, len(vocab) + np.arange(len(joined))])


def margins(texts: pa.Array, weights: np.ndarray, floor: float) -> np.ndarray:
    vocab, rows, ids = strings_of(texts)
    value = project(*letter_codes(vocab), weights, floor)
    out = np.zeros(len(texts))
    hit = value[ids] > 0
    np.maximum.at(out, rows[hit], value[ids[hit]])
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most `max_train` labelled documents outside the held-out fold; near copies once."""
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    fold = label.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                own = [batch.column(c).slice(start, len(texts)) for c in ("doc_id", "toxic")]
                yield pa.RecordBatch.from_arrays([pa.array(signatures(texts)), own[0], own[1], texts], ["signature", "doc_id", "toxic", "text"])

    signed = rows.mapInArrow(sign, "signature long, doc_id long, toxic int, text string")
    one = F.min_by(F.struct("text", "toxic"), F.struct("doc_id", F.xxhash64("text")))
    return signed.groupBy("signature").agg(one.alias("r")).select("r.text", "r.toxic")


def signatures(texts: pa.Array) -> np.ndarray:
    """Smallest hash of a text's three-word windows: near copies mostly share it."""
    words = split_words(texts, lower=True)
    n = len(words.ids)
    h = vocab_hashes(words.vocab)[words.ids]
    rows = words.rows
    mixed = mix64(h)
    for k in (1, 2):
        same = np.zeros(n, bool)
        same[: n - k] = rows[: n - k] == rows[k:]
        after = np.zeros(n, np.uint64)
        after[: n - k] = h[k:]
        mixed = mix64(mixed + np.where(same, after, np.uint64(0)))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(np.diff(words.offsets))
    if len(full):
        out[full] = np.minimum.reduceat(mixed, words.offsets[full])
    return out.view(np.int64)


def pieces(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, code) of every four letters in a row."""
    n = np.maximum(np.diff(offsets) - 3, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + offsets[owner]
    code = np.zeros(len(owner), np.int64)
    for k in range(4):
        code = code << 6 | codes[at + k]
    return owner, code


def string_table(rows: DataFrame) -> pa.Table:
    """(s, t, c): in how many toxic and clean training documents each string stands; pieces as "\\n" and their code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for start, texts in text_slices(batch.column("text")):
                vocab, row, ids = strings_of(texts)
                row, ids = np.divmod(np.unique(row * max(1, len(vocab)) + ids), max(1, len(vocab)))
                owner, code = pieces(*letter_codes(vocab))
                distinct, code = np.unique(code, return_inverse=True)
                starts = np.searchsorted(owner, np.arange(len(vocab) + 1))
                n = np.diff(starts)[ids]
                each = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                prow, pid = np.divmod(np.unique(np.repeat(row, n) * max(1, len(distinct)) + code[each]), max(1, len(distinct)))
                names = pa.array([f"\n{k}" for k in distinct], vocab.type)
                for key, r, i in ((vocab, row, ids), (names, prow, pid)):
                    bad = label[start + r]
                    t, c = (np.bincount(i[m], minlength=len(key)) for m in (bad, ~bad))
                    yield pa.RecordBatch.from_arrays([key, pa.array(t), pa.array(c)], ["s", "t", "c"])

    return rows.mapInArrow(count, "s string, t long, c long").groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toArrow()


def _surprise(t: np.ndarray, c: np.ndarray, rate: float) -> np.ndarray:
    """Log likelihood ratio of seeing t of t + c in toxic documents, against the overall rate."""
    n = t + c
    q = np.clip(t / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    return np.where(q > rate, t * np.log(q / rate) + c * np.log((1 - q) / (1 - rate)), 0.0)


def witnesses(codes: np.ndarray, offsets: np.ndarray, t: np.ndarray, c: np.ndarray, strong: np.ndarray, rate: float) -> np.ndarray:
    """Strings that tell toxic documents: they, or a strong piece in them, stand there beyond chance."""
    held = np.zeros(len(t), bool)
    for k in range(0, len(t), 50_000):
        bounds = offsets[k : k + 50_001]
        owner, code = pieces(codes[bounds[0] : bounds[-1]], bounds - bounds[0])
        held[k + owner[np.isin(code, strong)]] = True
    return (t > c) & (held | (_surprise(t, c, rate) > np.log(100.0 * max(len(t), 1)))) & (np.diff(offsets) >= 3)


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        loss = np.maximum(0, 1 - y * (x @ w))
        on = loss > 0
        step = np.linalg.solve((x[on] * cost[on, None]).T @ x[on] + np.diag(reg), -(x[on] * (cost * y * loss)[on, None]).sum(0) + reg * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_weights(table: pa.Table, rate: float, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float] | None:
    """Subsequence weights and bias, from the string table; None if no string tells toxic documents."""
    table = table.sort_by("s")
    is_piece = pc.starts_with(table.column("s"), "\n")
    found, table = table.filter(is_piece), table.filter(pc.invert(is_piece))
    t, c = (found.column(k).to_numpy().astype(float) for k in "tc")
    strong = (_surprise(t, c, rate) > np.log(100.0 * max(len(t), 1))) & (t >= 0.8 * (t + c))
    strong = pc.utf8_slice_codeunits(found.column("s"), 1).cast(pa.int64()).to_numpy()[strong]
    strings = table.column("s").combine_chunks()
    t, c = (table.column(k).to_numpy().astype(float) for k in "tc")
    codes, offsets = letter_codes(strings)
    good = np.flatnonzero(witnesses(codes, offsets, t, c, strong, rate))
    if not len(good):
        return None
    order = np.lexsort((good, -(t - c)[good]))
    positive = good[order][:2000]
    clean = np.flatnonzero((c > t) & (np.diff(offsets) >= 3))
    spread = np.argsort((clean * 2654435761) % (1 << 32), kind="stable")
    negative = clean[spread[:2000]]

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(offsets)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return codes[np.repeat(offsets[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def vectors(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        new = np.array([r for r in rows if r not in held], np.int64)
        held.update(zip(new.tolist(), features(*part(new)), strict=True))
        return [held[int(r)] for r in rows]

    def kernel(rows: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        known, dense = stacked(marks)
        out = np.zeros((len(rows), len(marks)), np.float32)
        for i, (k, v) in enumerate(vectors(rows)):
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[at] == k
            out[i] = v[hit] @ dense[at[hit]]
        return out

    # Landmarks: witnesses far from one another, then the negatives that are taken for witnesses.
    near = kernel(positive, vectors(positive[:1]))
    chosen = [0]
    while len(chosen) < min(landmarks // 2, len(positive)) and near.max(axis=1).min() < 0.9:
        chosen.append(int(np.argmin(near.max(axis=1))))
        near = np.hstack([near, kernel(positive, vectors(positive[chosen[-1:]]))])
    marks, kp = vectors(positive[chosen]), near
    marks += vectors(negative[: landmarks // 8])
    kp = np.hstack([kp, kernel(positive, marks[kp.shape[1] :])])
    kn = kernel(negative, marks)
    for round_ in range(ROUNDS):
        known, dense = stacked(marks)
        kmm = dense.T @ dense
        value, vector = np.linalg.eigh(kmm.astype(np.float64))
        keep = value > 1e-4 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        k = np.concatenate([kp, kn])
        x = np.hstack([k @ root, np.ones((len(k), 1))])
        y = np.r_[np.ones(len(kp)), -np.ones(len(kn))]
        cost = np.r_[np.full(len(kp), 1 / len(kp)), np.full(len(kn), 1 / max(1, len(kn)))] * 1000
        w = solve(x, y, cost)
        weights = np.zeros(1 << 18, np.float32)
        weights[known] = dense @ (root @ w[:-1])
        if round_ < ROUNDS - 1 and len(clean):
            hard = clean[np.argsort(-project(*part(clean), weights, FLOOR * abs(w[-1])), kind="stable")[:1000]]
            extra = vectors(hard[: landmarks // 8])
            kp = np.hstack([kp, kernel(positive, extra)])
            kn = np.hstack([kn, kernel(negative, extra)])
            marks += extra
            hard = np.setdiff1d(hard, negative)
            negative = np.concatenate([negative, hard])
            kn = np.concatenate([kn, kernel(hard, marks)])
    return weights, float(w[-1])


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve, with smoothed targets and a little ridge."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * w)
        w = w - step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Machine:
    rows = training_rows(docs, labels, max_train).persist()
    try:
        table = string_table(rows)
        classes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        share = classes.get(1, 0) / max(1, sum(classes.values()))
        fitted = fit_weights(table, share, landmarks) if len(classes) == 2 else None
        if fitted is None:
            return Machine(None, 0.0, 0.0, 0.0, share)
        weights, floor = fitted[0], FLOOR * abs(fitted[1])

        def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in text_slices(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([pa.array(margins(texts, weights, floor)), batch.column("toxic").slice(start, len(texts))], ["m", "toxic"])

        got = rows.mapInArrow(margin, "m double, toxic int").toArrow()
        slope, bias = platt(got.column("m").to_numpy(), got.column("toxic").to_numpy().astype(float))
        return Machine(weights, floor, bias, slope, share)
    finally:
        rows.unpersist()


def score_rows(docs: DataFrame, machine: Machine, keep: tuple[str, ...]) -> DataFrame:
    """`row` (the kept columns, as a struct) and `score` of every document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                margin = margins(texts, model.weights, model.floor) if model.weights is not None else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, len(texts)), pa.array(model.score(margin))], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = score_rows(docs, train(docs, labels, max_train), ("doc_id",))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), (F.crc32(doc_id.cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not predicted toxic, all columns unchanged."""
    return score_rows(docs, train(docs, labels, max_train), tuple(docs.columns)).where("score < 0.5").select("row.*")
