"""LM scoring with a weighted backoff automaton.

The events of the model are the words of the training documents, one event for all other words, and the end of
the text. Smoothed n-grams are states and arcs: the root has an arc for each event (discounted counts of all training
tokens; what the discount takes is the unknown word's), each word is a state with arcs for the events that follow it,
and so is each pair of words. Where a state has no arc for an event, its failure arc leads to the state that
forgets the oldest word, at the weight that makes all probabilities sum to one. A text is read once from left to right,
carrying the state and adding log-probabilities. A state remembers two words, so a long text is read as pieces side by side, each of which
first reads the two words before it, unscored, and so comes to the state in which a reader of the whole text would be.

Scale. Words, pairs and triples of all training documents are counted, rare ones too; they grow with the corpus, so they are never
broadcast. Texts are cut into chunks whose words are dictionary-coded once. A chunk sends each of its distinct n-grams once, as a
sorted block of 64-bit keys (hashes) and counts for each range of keys; the task of a range sums its blocks and answers
each block in its order, so a chunk receives the counts of the n-grams it uses. One chunk of those that hold an n-gram is told to count it among the
successors of its context, and these numbers are summed in the same way. From them each chunk's task builds the states and arcs that its texts can pass, and reads the texts with them.
Chunks and their counts are written in buckets of chunks, so joins do not shuffle them. There are as many ranges as keep each near RANGE keys; n-grams whose hashes of 48 to 62 bits clash share a count.

Defined results: null and empty texts are one end token. A null doc_id is not held out. With nothing to learn from, the base score
is 0 a token and the end and the unknown word have half of all probability each. Rows are handled one by one, repeats alike.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, mix64, remove, split_words, sums_by_row, text_bytes, text_slices, written
from .kneser_ney import discounts

#: Keys (of words, pairs and triples, once for each chunk) that one task sums at a time.
RANGE = 2_000_000
CHUNK_BYTES = 6 << 20
#: Symbols of a text that are read in one go; the next piece starts from the MEMORY symbols before it.
PIECE = 256
MEMORY = 2
CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, hashes binary, tokens long"
BLOCK = "chunk long, part long, size long, keys binary, sums array<binary>"
ANSWER = "chunk long, part long, size long, sums array<binary>"


def chunk_table(docs: DataFrame) -> DataFrame:
    """Dictionary-coded chunks of the documents: one row a chunk, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in text_slices(batch.column("text"), CHUNK_BYTES):
                doc_ids, held = (batch.column(c).slice(start, len(texts)) for c in ("doc_id", "held"))
                words = split_words(texts, lower=True)
                used = np.bincount(words.ids, minlength=len(words.vocab)) > 0
                new = np.cumsum(used) - 1
                lengths = np.diff(words.offsets).astype(np.int32)
                hashes = word_hashes(words.vocab.filter(pa.array(used)))
                row = [number, doc_ids.to_pylist(), held.to_pylist(), lengths, zlib.compress(new[words.ids].astype("<i4").tobytes(), 1), hashes.tobytes(), len(words.ids) + len(texts)]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in CHUNK.split(", ")])
                number += 1

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held.alias("held"), "text").mapInArrow(run, CHUNK)


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word: mixed (place, byte) numbers summed and mixed again."""
    raw, offsets = text_bytes(vocab)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = mix64((place.astype(np.uint64) << np.uint64(8) | raw) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


@dataclass
class Automaton:
    """States are contexts; arcs: sorted state * symbols + symbol, with log10 probability and next state.

    Symbols: the words, then other words, the start and the end. State 0 is the root, whose arcs carry the events' own
    probabilities and lead to `root_target`. No state remembers more than MEMORY symbols.
    """

    symbols: int
    arcs: np.ndarray
    logp: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    weight: np.ndarray
    root_target: np.ndarray
    start: int

    def step(self, state: np.ndarray, event: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log10 probability of an event read in each state; failure arcs are followed until one has an arc for it."""
        into, logp = self.root_target[event], own.copy()
        left = np.flatnonzero(state)
        now, paid = state[left], np.zeros(len(left))
        while len(left):
            key = now * self.symbols + event[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key
            found = left[hit]
            into[found], logp[found] = self.target[arc[hit]], paid[hit] + self.logp[arc[hit]]
            left, now, paid = left[~hit], now[~hit], paid[~hit]
            paid, now = paid + self.weight[now], self.fail[now]
            root = now == 0
            logp[left[root]] += paid[root]
            left, now, paid = left[~root], now[~root], paid[~root]
        return into, logp

    def read(self, symbol: np.ndarray, own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text's events, given each event's own: pieces of texts are read in step, left to right."""
        length = np.diff(offsets)
        pieces = -(-length // PIECE)
        text = np.repeat(np.arange(len(length)), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(PIECE, length[text] - k * PIECE) + MEMORY * (k > 0)
        order = np.argsort(-size, kind="stable")
        text, k, size = text[order], k[order], size[order]
        begin = offsets[text] + k * PIECE - MEMORY * (k > 0)
        total, state = np.zeros(len(text)), np.where(k > 0, 0, self.start)
        active = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), "right")
        for place, n in enumerate(active.tolist()):
            at = begin[:n] + place
            state[:n], logp = self.step(state[:n], symbol[at], own[at])
            total[:n] += logp if place >= MEMORY else np.where(k[:n] > 0, 0.0, logp)
        return np.bincount(text, total, len(length))


def build_automaton(heads: list[str], own: np.ndarray, pairs: dict[tuple[int, int], int], triples: dict[tuple[int, int, int], int]) -> Automaton:
    """The whole automaton, from the events' own probabilities (by symbol) and the counts of all symbol pairs and triples.

    The plain definition of the model, for small corpora; `chunk_automaton` is the part of it that a chunk uses.
    """
    other, symbols = len(heads), len(heads) + 3
    state_of: dict[tuple[int, ...], int] = {(): 0}
    prob: dict[tuple[int, ...], float] = {}
    left: dict[tuple[int, ...], float] = {(): 1.0}
    for table in (pairs, triples):
        kept = [n for k, n in table.items() if k[-1] != other]
        d = discounts(*(kept.count(k) for k in (1, 2, 3, 4)))
        whole: dict[tuple[int, ...], int] = {}
        for key, n in table.items():
            whole[key[:-1]] = whole.get(key[:-1], 0) + n
        taken = dict.fromkeys(whole, 0.0)
        for key, n in table.items():
            if key[-1] != other:
                prob[key] = (n - d[min(n, 3)]) / whole[key[:-1]]
                taken[key[:-1]] += prob[key]
        for ctx in sorted(whole):
            left[ctx] = 1 - taken[ctx]
            state_of[ctx] = len(state_of)
        for key in table:
            if key[-1] != other:  # interpolate: what is left goes to the shorter context
                prob[key] += left[key[:-1]] * full(prob, left, own, key[1:])
    longest = lambda key: next(state_of[key[k:]] for k in range(len(key) + 1) if key[k:] in state_of)
    arcs = sorted((state_of[k[:-1]] * symbols + k[-1], np.log10(p), longest(k[-2:])) for k, p in prob.items())
    contexts = sorted(state_of, key=state_of.__getitem__)
    fail = np.array([longest(c[1:]) for c in contexts])
    weight = np.array([np.log10(max(left[c], 1e-12)) for c in contexts])
    root_target = np.array([longest((s,)) for s in range(symbols)])
    column = lambda k, kind: np.array([a[k] for a in arcs] or [-1], kind)
    return Automaton(symbols, column(0, np.int64), column(1, float), column(2, np.int64), fail, weight, root_target, longest((other + 1,)))


def full(prob: dict, left: dict, own: np.ndarray, key: tuple[int, ...]) -> float:
    """Probability of the last symbol of a key after the symbols before it."""
    if len(key) == 1:
        return float(own[key[0]])
    if key in prob:
        return prob[key]
    return left.get(key[:-1], 1.0) * full(prob, left, own, key[1:])


def unpack_ids(row: dict) -> np.ndarray:
    return np.frombuffer(zlib.decompress(row["ids"].as_py()), "<i4")


@dataclass
class Grams:
    """A chunk's symbols laid end to end (each text's words and its end), and its distinct pairs and triples."""

    hashes: np.ndarray
    symbol: np.ndarray
    offsets: np.ndarray
    train: np.ndarray  # of each symbol
    n_train: int  # texts
    pairs: np.ndarray  # symbol before * symbols + symbol, sorted
    pair_at: np.ndarray  # of each symbol
    triples: np.ndarray  # pair before * symbols + symbol, sorted
    triple_at: np.ndarray  # of each symbol but the first ones of texts
    later: np.ndarray  # places of those symbols

    @property
    def symbols(self) -> int:
        return len(self.hashes) + 3


def grams_of(row: dict) -> Grams:
    hashes, ids = np.frombuffer(row["hashes"].as_py(), np.uint64), unpack_ids(row)
    lengths = row["lengths"].values.to_numpy().astype(np.int64)
    learn = ~row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
    s = len(hashes) + 3
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbol = np.full(offsets[-1], s - 1, np.int64)
    symbol[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    before = np.concatenate([[0], symbol[:-1]])
    before[offsets[:-1]] = s - 2
    pairs, pair_at = np.unique(before * s + symbol, return_inverse=True)
    later = np.flatnonzero(before != s - 2)
    triples, triple_at = np.unique(pair_at[later - 1] * s + symbol[later], return_inverse=True)
    return Grams(hashes, symbol, offsets, np.repeat(learn, lengths + 1), int(learn.sum()), pairs, pair_at, triples, triple_at, later)


def key_bits(tokens: int) -> int:
    """Bits of an n-gram's hash: at any size of the corpus, about one key in a million or fewer clashes."""
    return min(62, max(48, tokens.bit_length() + 20))


def keys_of(g: Grams, bits: int) -> list[np.ndarray]:
    """Keys of all symbols, pairs and triples: a hash of so many bits, then two bits for the order, 0 for symbols that are no words."""
    step = np.uint64(0x9E3779B97F4A7C15)
    one = np.concatenate([g.hashes, np.array([1, 2, 3], np.uint64)])
    two = mix64(mix64(one[g.pairs // g.symbols] + step) + one[g.pairs % g.symbols])
    three = mix64(mix64(two[g.triples // g.symbols] + step) + one[g.triples % g.symbols])
    order = np.array([1] * len(g.hashes) + [0] * 3, np.uint64)
    return [(k >> np.uint64(64 - bits) << np.uint64(2)) | o for k, o in ((mix64(one + step), order), (two, np.uint64(2)), (three, np.uint64(3)))]


def counts_of(g: Grams) -> list[np.ndarray]:
    """Times in the chunk's training texts of all symbols, pairs and triples."""
    one = np.bincount(g.symbol[g.train], minlength=g.symbols)
    one[g.symbols - 2] = g.n_train
    return [one, np.bincount(g.pair_at[g.train], minlength=len(g.pairs)), np.bincount(g.triple_at[g.train[g.later]], minlength=len(g.triples))]


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, lowest first, without the planes that are zero throughout."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return planes[: max(1, (int(values.max()).bit_length() + 7) // 8)].tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((size, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def deal(number: int, keys: np.ndarray, values: list[np.ndarray], parts: int, bits: int) -> pa.RecordBatch:
    """A chunk's keys and the values to sum, in one block for each range of keys."""
    order = np.argsort(keys)
    keys, values = keys[order], [v[order] for v in values]
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(((4 << bits) - 1) // parts)
    bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * len(rows), pa.int64()), pa.array([p for p, _, _ in rows], pa.int64()), pa.array([b - a for _, a, b in rows], pa.int64()),
            pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
            pa.array([[pack(v[a:b]) for v in values] for _, a, b in rows], pa.list_(pa.binary())),
        ],
        ["chunk", "part", "size", "keys", "sums"],
    )


def answers(cell: pa.Scalar, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """The sums that came back for a chunk's keys, as `deal` sent them."""
    order = np.argsort(keys)
    blocks = sorted(cell.as_py() or [], key=lambda b: b["part"])
    out = []
    for j in range(columns):
        found = np.zeros(len(keys), np.int64)
        found[order] = np.concatenate([np.zeros(0, np.int64), *(unpack(b["sums"][j], b["size"]).astype(np.int64) for b in blocks)])
        out.append(found)
    return out


def sum_blocks(blocks: DataFrame, first_pass: bool) -> DataFrame:
    """Each block's values summed over all chunks, by key.

    The first pass doubles the sums and adds one where the block is its key's first; a row of chunk -1 has, for each order,
    how many sums are 1, 2, 3 and 4, how many are not 0, and their total.
    """

    def run(table: pa.Table) -> pa.Table:
        chunk, part, size = (table.column(c).to_pylist() for c in ("chunk", "part", "size"))
        keys = np.concatenate([np.cumsum(unpack(k.as_py(), n), dtype=np.uint64) for k, n in zip(table.column("keys"), size, strict=True)])
        sent = table.column("sums").to_pylist()
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        back: list[list[bytes]] = [[] for _ in size]
        extra = []
        for j in range(len(sent[0])):
            value = np.concatenate([unpack(s[j], n) for s, n in zip(sent, size, strict=True)])
            total = np.add.reduceat(value[order], first)
            value[order] = total[group]
            if first_pass:
                value *= np.uint64(2)
                value[order[first]] += np.uint64(1)
                kind = keys[first] & np.uint64(3)
                extra = [[np.array([*(np.sum(n == k) for k in (1, 2, 3, 4)), np.sum(n > 0), n.sum()], "<i8").tobytes() for n in (total[kind == o] for o in (1, 2, 3))]]
            for b, (lo, hi) in zip(back, zip(bounds, bounds[1:], strict=False), strict=True):
                b.append(pack(value[lo:hi]))
        more = len(extra)
        return pa.table(
            [pa.array(chunk + [-1] * more, pa.int64()), pa.array(part + part[:1] * more, pa.int64()), pa.array(size + [0] * more, pa.int64()), pa.array(back + extra, pa.list_(pa.binary()))],
            names=["chunk", "part", "size", "sums"],
        )

    return blocks.groupBy("part").applyInArrow(run, ANSWER)


def successors(g: Grams, counted: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which contexts (symbols, then pairs) need their successors counted, and how many once, twice and more often seen ones this chunk counts.

    A pair seen once has one successor, seen once, so only the others are asked for. A pair that ends a text has none.
    """
    one, two, three = (c >> 1 for c in counted)
    ask = np.concatenate([one > 0, (two > 1) & (g.pairs % g.symbols != g.symbols - 1)])
    out = []
    for k in (1, 2, 3):
        a, b = (np.flatnonzero((c & 1 == 1) & (np.minimum(c >> 1, 3) == k)) for c in counted[1:])
        out.append(np.concatenate([np.bincount(g.pairs[a] // g.symbols, minlength=len(one)), np.bincount(g.triples[b] // g.symbols, minlength=len(two))])[ask])
    return ask, out


def chunk_automaton(g: Grams, counts: list[np.ndarray], kinds: np.ndarray, own: np.ndarray, d2: np.ndarray, d3: np.ndarray) -> Automaton:
    """The states and arcs that a chunk's texts can pass; `kinds` has the numbers of successors of all its symbols and pairs.

    State 1 + a is the symbol a's, state 1 + symbols + p the pair p's. Those that were never counted have no arc to them: what
    would lead there leads to the longest shorter context that was.
    """
    s, (one, two, three) = g.symbols, counts
    a, b = g.pairs // s, g.pairs % s
    ctx, c = g.triples // s, g.triples % s
    shorter = np.zeros(len(g.triples), np.int64)  # the pair that ends a triple
    shorter[g.triple_at] = g.pair_at[g.later]
    left_one = kinds[:, :s].T @ d2[1:] / np.maximum(one, 1)
    left_two = kinds[:, s:].T @ d3[1:] / np.maximum(two, 1)
    near = (two - d2[np.minimum(two, 3)]) / np.maximum(one, 1)[a] + left_one[a] * own[b]
    p = np.flatnonzero((two > 0) & (one[a] > 0))
    t = np.flatnonzero((three > 0) & (two[ctx] > 0) & (two[shorter] > 0))
    deep = (three[t] - d3[np.minimum(three[t], 3)]) / two[ctx[t]] + left_two[ctx[t]] * near[shorter[t]]
    word = np.where(one > 0, 1 + np.arange(s), 0)
    pair = np.where(two > 0, 1 + s + np.arange(len(two)), word[b])
    arcs = np.concatenate([(1 + a[p]) * s + b[p], (1 + s + ctx[t]) * s + c[t]])  # sorted, as pairs and triples are
    logp, target = np.log10(np.concatenate([near[p], deep])), np.concatenate([pair[p], pair[shorter[t]]])
    if not len(arcs):
        arcs, logp, target = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)
    weight = np.log10(np.maximum(np.concatenate([[1.0], left_one, left_two]), 1e-12))
    return Automaton(s, arcs, logp, target, np.concatenate([np.zeros(1 + s, np.int64), word[b]]), weight, word, int(word[s - 2]))


def per_row(work: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield work({c: batch.column(c)[k] for c in batch.schema.names})

    return run


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written meanwhile, which nothing reads again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    chunks = bucketed(chunk_table(docs), "chunk", "lm_chunks")
    got = chunks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ends, parts, bits = got[0], max(1, -(-2 * got[1] // RANGE)), key_bits(got[1])

    def send_counts(row: dict) -> pa.RecordBatch:
        g = grams_of(row)
        return deal(row["chunk"].as_py(), np.concatenate(keys_of(g, bits)), [np.concatenate(counts_of(g))], parts, bits)

    def counted_of(row: dict, g: Grams, keys: list[np.ndarray]) -> list[np.ndarray]:
        return np.split(answers(row["counts"], np.concatenate(keys), 1)[0], np.cumsum([len(k) for k in keys])[:2])

    def send_successors(row: dict) -> pa.RecordBatch:
        g = grams_of(row)
        keys = keys_of(g, bits)
        ask, values = successors(g, counted_of(row, g, keys))
        return deal(row["chunk"].as_py(), np.concatenate(keys[:2])[ask], values, parts, bits)

    gathered = lambda rows, name: rows.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "size", "sums")).alias(name))
    with cleaned(spark), written() as paths:
        sums = materialize(sum_blocks(chunks.mapInArrow(per_row(send_counts), BLOCK), True), "lm-sums")
        stats = np.zeros((3, 6), np.int64)
        for r in sums.where("chunk < 0").select("sums").toLocalIterator():
            stats += np.array([np.frombuffer(b, "<i8") for b in r.sums])
        known = chunks.join(bucketed(gathered(sums, "counts"), "chunk", "lm_counts").hint("merge"), "chunk")
        remove(spark, paths[:1])  # the sums; the counts are read to the end
    with cleaned(spark):
        kinds_ = materialize(sum_blocks(known.mapInArrow(per_row(send_successors), BLOCK), False), "lm-kinds")
    n, v = int(stats[0, 5]) + ends, int(stats[0, 4]) + (ends > 0)
    d, d2, d3 = (np.array(discounts(*map(int, row[:4]))) for row in stats)
    seen = [stats[0, 0], stats[0, 1], stats[0, 4] - stats[0, 0] - stats[0, 1]]
    spare = sum(k * x for k, x in zip(seen, d[1:], strict=True)) / n if n else 0.5
    own_of = lambda c: np.where(c > 0, (c - d[np.minimum(c, 3)]) / max(n, 1), max(spare, 1e-9))
    end_own = ends / n if ends else 0.5
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(row: dict) -> pa.RecordBatch:
        g = grams_of(row)
        keys = keys_of(g, bits)
        counted = counted_of(row, g, keys)
        ask, _ = successors(g, counted)
        counts = [c >> 1 for c in counted]
        kinds = np.zeros((3, len(ask)), np.int64)
        kinds[0, g.symbols :] = counts[1] == 1  # a pair seen once
        kinds[:, ask] = answers(row["kinds"], np.concatenate(keys[:2])[ask], 3)
        count, own = counts[0], own_of(counts[0])
        count[-1], own[-1] = ends, end_own
        score = chunk_automaton(g, counts, kinds, own, d2, d3).read(g.symbol, np.log10(own)[g.symbol], g.offsets)
        base = sums_by_row(np.log10((count[g.symbol] + 1) / (n + v + 1)), g.offsets)
        length = np.diff(g.offsets)
        values = [row["doc_ids"].values, row["held"].values, length, sums_by_row((count[g.symbol] > 0).astype(np.int64), g.offsets), np.full(len(length), n), base, score]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(values, types, strict=True)], names)

    out = known.join(gathered(kinds_, "kinds").hint("merge"), "chunk", "left")
    return out.mapInArrow(per_row(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
