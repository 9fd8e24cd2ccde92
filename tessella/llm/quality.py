"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The model counts 4-grams of code points (case folded, white space as one blank), one model per language. Languages are those of the
table: each that holds at least `MIN_DOCS` documents and `MIN_SHARE` of all is a group, all others share the last
group. Every document is read; it counts as reference text if it passes the base rules and at most
1 % of its word characters are symbols, so that junk cannot teach the model that junk is likely. Texts fall in two folds by their CRC-32, and each fold is scored by the model of the other,
so that no text, nor a copy of it, teaches the model that judges it. Executors count, Spark sums and fits: a row for each 4-gram that stands in a text of the language
gets its probability under both folds' models, so nothing bounds the alphabet or the model. Probabilities of languages with up to `limit` 4-grams are sent to
the executors, as many languages at a time as hold `limit` together, with a pass over the documents of those languages; those of larger ones never pass the driver: Spark
joins them with the 4-grams of each text.
A code point that the other fold lacks has `FLOOR` in place of a share of an alphabet.
Each group gets a lower and an upper bound for the mean negative log10 probability of a character: the
quartiles of all its documents that pass the base rules, each moved away from the median by `spread`
times its gap to it and by at least its `reach`.

Defined results: a null or empty text has no words, no perplexity (null) and is not kept. Without
counts in the other fold all code points are alike. A null language belongs to the last group. Rows are judged one by one, so repeated doc_ids and
repeated texts each get their own row. Extra columns are ignored by `quality_report` and returned
unchanged by `filter_documents`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Collection, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import materialize, mix64, split_words, sums_by_row, text_bytes, text_slices
from .kneser_ney import discounts

#: A language has a group of its own from that many documents and that share of all documents on.
MIN_DOCS, MIN_SHARE = 50, 0.001
ORDER, FOLDS = 4, 2
#: Bits of a code point; two of them and a number of a group fill a long.
POINT = 21
#: Probability of a code point without counts, below all orders.
FLOOR = 1 / 64
#: 4-grams whose probabilities are sent at once; languages with more are joined.
MODEL_GRAMS = 1 << 22
#: n-grams that are sorted at once, and distinct ones that a task holds before it hands them on.
BLOCK, HELD = 1 << 20, 2 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bands: times the gap between a quartile and the median, and the least widening below and above (log10 of a factor in perplexity for each character).
SPREAD, REACH = 8.0, (0.1, 0.3)
MAX_SYMBOL_PERCENT = 1


def character_class(code: int) -> int:
    """What the model counts for a code point: 0 for white space, else its lower case where that is one code point."""
    low = chr(code).lower() if code < 0x10000 else chr(code)
    return 0 if low in " \t\n\v\f\r" else ord(low) if len(low) == 1 else code


CLASSES = np.fromiter(map(character_class, range(0x10000)), np.uint32, 0x10000)
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
BLANK = np.zeros(256, np.int64)
BLANK[list(b" \t\n\v\f\r")] = 1


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string array laid end to end, and the offsets."""
    raw, offsets = text_bytes(texts)
    if not len(raw) or raw.max() < 0x80:
        return raw, offsets
    first = (raw & 0xC0) != 0x80
    starts = np.flatnonzero(first)
    codes = raw[starts].astype(np.uint32)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((raw[starts] >= lead) & (raw[starts] < (lead >> 1 | 0x80 if size < 4 else 0xF8)))
        value = codes[at] & (0x7F >> size)
        for k in range(1, size):
            value = value << 6 | (padded[starts[at] + k] & 0x3F)
        codes[at] = value
    return codes, np.concatenate([[0], np.cumsum(first)])[offsets]


def grams(texts: pa.Array, owners: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first character, packed 4-gram that ends at each character, alphabet, row offsets, bits) for stretches of the texts laid end to end.

    A packed 4-gram is the text's owner, a number, and the places of four code points in the stretch's alphabet; blanks stand before a text. A
    stretch whose alphabet is too large for 63 bits is halved.
    """
    codes, offsets = code_points(texts)
    codes = CLASSES[codes] if codes.dtype == np.uint8 else np.where(codes < 0x10000, CLASSES[np.minimum(codes, 0xFFFF)], codes)
    codes = np.concatenate([np.zeros(ORDER - 1, codes.dtype), codes])  # character i stands at i + ORDER - 1
    length = np.diff(offsets)
    owner, depth = np.repeat(owners, length), np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
    todo = [(at, min(at + BLOCK, len(owner))) for at in range(0, len(owner), BLOCK)][::-1]
    while todo:
        begin, end = todo.pop()
        part = codes[begin : end + ORDER - 1]
        seen = np.zeros(int(part.max()) + 1, bool)
        seen[part] = seen[0] = True
        alphabet = np.flatnonzero(seen)
        bits = max(1, (len(alphabet) - 1).bit_length())
        if int(owner[begin:end].max()).bit_length() + ORDER * bits > 63:
            half = (begin + end) // 2
            todo += [(half, end), (begin, half)]
            continue
        place = (np.cumsum(seen) - 1)[part]
        out = owner[begin:end] << ORDER * bits | place[ORDER - 1 :]
        for k in range(1, ORDER):
            out |= np.where(depth[begin:end] >= k, place[ORDER - 1 - k : len(place) - k], 0) << bits * k
        yield begin, out, alphabet, offsets, bits


def unpacked(packed: np.ndarray, alphabet: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, and the first and last two code points as numbers of 2 * POINT bits."""
    a, b, c, d = (alphabet[packed >> bits * k & (1 << bits) - 1] for k in range(ORDER - 1, -1, -1))
    return packed >> ORDER * bits, a << POINT | b, c << POINT | d


def languages_of(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[str, ...]:
    """Languages with a group of their own, at most 1 / min_share."""
    least = max(min_docs, min_share * docs.count())
    return tuple(sorted(r.lang for r in docs.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()))


def language_groups(lang: pa.Array, languages: tuple[str, ...]) -> np.ndarray:
    found = pc.index_in(lang, value_set=pa.array(languages, lang.type)).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(found.astype(float)), len(languages), found).astype(np.int64)


def folds(texts: pa.Array) -> np.ndarray:
    """The fold of each text."""
    return np.fromiter((zlib.crc32(t.as_buffer()) % FOLDS for t in texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())), np.int64, len(texts))


COUNTED = ("n0", "n1", "t0", "t1")


def count_grams(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(g, first, last, n0, n1, t0, t1): a 4-gram of a language group, its count in reference texts of either fold, and in all texts; summed in each task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added() -> pa.Table:
            got = pa.concat_tables(waiting).group_by(["g", "first", "last"], use_threads=False).aggregate([(c, "sum") for c in COUNTED])
            return got.select(["g", "first", "last", *(f"{c}_sum" for c in COUNTED)]).rename_columns(["g", "first", "last", *COUNTED])

        waiting, n_waiting = [], 0
        for batch in batches:
            groups = language_groups(batch.column("lang"), languages)
            for start, texts in text_slices(batch.column("text")):
                found = base_counts(texts)
                good = ~base_failed(found) & (100 * found["n_symbols"] <= MAX_SYMBOL_PERCENT * found["word_chars"])
                owners = (groups[start : start + len(texts)] * FOLDS + folds(texts)) * 2 + good
                for _, packed, alphabet, _, bits in grams(texts, owners):
                    distinct, n = np.unique(packed, return_counts=True)
                    owner, first, last = unpacked(distinct, alphabet, bits)
                    kinds = [n * ((owner >> 1 & 1 == f) & (owner & 1 >= reference)) for reference in (1, 0) for f in range(FOLDS)]
                    waiting.append(pa.table([owner >> 2, first, last, *kinds], ["g", "first", "last", *COUNTED]))
                    n_waiting += len(n)
                if n_waiting > HELD:
                    waiting = [added()]
                    n_waiting = len(waiting[0])
                    if n_waiting > HELD // 2:
                        yield from waiting[0].to_batches(BLOCK)
                        waiting, n_waiting = [], 0
        if waiting:
            yield from added().to_batches(BLOCK)

    rows = docs.select("text", "lang").mapInArrow(count, "g long, first long, last long, " + ", ".join(f"{c} long" for c in COUNTED))
    return rows.groupBy("g", "first", "last").agg(*[F.sum(c).alias(c) for c in COUNTED])


def probabilities(counts: DataFrame) -> DataFrame:
    """(owner, first, last, logp): the log10 probability of the last code point of each 4-gram of a group and fold (owner: 2 * group + fold) under the other fold's model.

    The highest order uses counts, lower orders the number of distinct code points before the n-gram. An n-gram that one fold lacks has count 0
    there, and a context it lacks leaves the next lower order's probability as it is.
    """
    spark, marks, every, low = counts.sparkSession, ("a", "b", "c", "d"), range(FOLDS), (1 << POINT) - 1
    points = [F.shiftright("first", POINT), F.col("first").bitwiseAND(low), F.shiftright("last", POINT), F.col("last").bitwiseAND(low)]
    levels = {ORDER: counts.select("g", *[c.alias(m) for c, m in zip(points, marks, strict=True)], *COUNTED)}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("g", *marks[ORDER - k :]).agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in every])
    tally = [F.array(*[F.count_if(F.col(f"n{f}") == j) for j in range(1, 5)]).alias(f"d{f}") for f in every]
    tallies = reduce(DataFrame.unionByName, [level.groupBy("g").agg(*tally).withColumn("k", F.lit(k)) for k, level in levels.items()]).collect()
    cuts = spark.createDataFrame([(r.g, r.k, discounts(*r.d0), discounts(*r.d1)) for r in tallies], "g long, k int, d0 array<double>, d1 array<double>")
    below = None
    for k, level in sorted(levels.items()):
        own = marks[ORDER - k :]
        context = Window.partitionBy("g", *own[:-1])
        sums = [F.sum(f"n{f}").over(context).alias(f"whole{f}") for f in every]
        kinds = [F.count_if(F.col(f"n{f}") == j if j < 3 else F.col(f"n{f}") >= j).over(context).alias(f"kind{f}{j}") for f in every for j in (1, 2, 3)]
        rows = level.select("*", *sums, *kinds).join(F.broadcast(cuts.where(F.col("k") == k).drop("k")), "g")
        rows = rows.join(below, ["g", *own[1:]]) if below is not None else rows.select("*", *[F.lit(FLOOR).alias(f"p{f}") for f in every])
        p = []
        for f in every:
            n, d, whole, rest = (F.col(f"{c}{f}") for c in ("n", "d", "whole", "p"))
            freed = sum((F.col(f"kind{f}{j}") * d[j] for j in (2, 3)), F.col(f"kind{f}1") * d[1])
            p.append(F.when(whole > 0, (n - F.get(d, F.least(n, F.lit(3)).cast("int")) + freed * rest) / whole).otherwise(rest).alias(f"p{f}"))
        below = rows.select("g", *own, *p, *(COUNTED[FOLDS:] if k == ORDER else ()))
    two = lambda x, y: F.shiftleft(x, POINT).bitwiseOR(F.col(y))
    judged = F.explode(F.array(*[F.struct((F.col("g") * FOLDS + f).alias("owner"), F.col(f"t{f}").alias("t"), F.log10(f"p{1 - f}").alias("logp")) for f in every]))
    return below.select(two("a", "b").alias("first"), two("c", "d").alias("last"), judged.alias("j")).where("j.t > 0").select("j.owner", "first", "last", "j.logp")


class Sent:
    """Log10 probabilities of 4-grams by hashes; as it holds all that texts have, and no two share a hash, what is looked up is found."""

    def __init__(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray, logp: np.ndarray) -> None:
        self.seed = 0
        while len(np.unique(keys := self.key(owner, first, last))) < len(keys):
            self.seed += 1
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], logp[order]

    def key(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        head = mix64((owner << 2 * POINT | first).astype(np.uint64) + np.uint64(self.seed))
        return mix64(head + last.astype(np.uint64))

    def score(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.logp[np.searchsorted(self.keys, self.key(owner, first, last))]


def of_groups(docs: DataFrame, groups: Collection[int], languages: tuple[str, ...]) -> DataFrame:
    """The documents of some language groups."""
    if len(groups) > len(languages):
        return docs
    wanted = F.col("lang").isin([languages[g] for g in groups if g < len(languages)])
    if len(languages) in groups:
        wanted = wanted | ~F.col("lang").isin(list(languages))
    return docs.where(F.coalesce(wanted, F.lit(len(languages) in groups)))


#: Groups, and their probabilities: sent for one pass over their documents, or the rows of all, to be joined.
Part = tuple[list[int], Broadcast | DataFrame]


def train(docs: DataFrame, languages: tuple[str, ...], limit: int = MODEL_GRAMS) -> list[Part]:
    """Count over all reference texts on executors and fit there; send as many language groups at a time as hold `limit` 4-grams together."""
    rows = materialize(probabilities(materialize(count_grams(docs, languages), "grams")), "probabilities")
    group = F.floor(F.col("owner") / FOLDS)
    sizes = {r.g: r.n for r in rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts, held, far = [[]], 0, [g for g, n in sizes.items() if n > limit]
    for g in range(len(languages) + 1):
        if g not in far:
            if held + sizes.get(g, 0) > limit:
                parts, held = [*parts, []], 0
            parts[-1].append(g)
            held += sizes.get(g, 0)
    out: list[Part] = [(far, rows)] if far else []
    for groups in filter(None, parts):
        got = rows.where(group.isin(groups)).toArrow()
        out.append((groups, docs.sparkSession.sparkContext.broadcast(Sent(*(got.column(c).to_numpy() for c in ("owner", "first", "last", "logp"))))))
    return out


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of the base rules for each text of a slice."""
    words = split_words(texts)
    raw, offsets = text_bytes(texts)
    blanks = sums_by_row(BLANK[raw], offsets)
    n_words = np.diff(words.offsets)
    return {
        "n_words": n_words,
        "word_chars": pc.utf8_length(texts).to_numpy().astype(np.int64) - blanks,
        "n_symbols": sums_by_row(SYMBOL[raw], offsets),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_window_words(words.ids, words.offsets),
    }


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    lines = pc.split_pattern(texts, "\n")
    bounds = lines.offsets.to_numpy().astype(np.int64)
    values = lines.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = values.dictionary_encode()
    ids, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    raw, offs = text_bytes(vocab)
    full = sums_by_row(1 - BLANK[raw], offs)[ids] > 0 if len(vocab) else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))[full]
    distinct = np.unique(rows * max(1, len(vocab)) + ids[full]) // max(1, len(vocab))
    return np.bincount(rows, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def repeated_window_words(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words that stand in a 3-word window found twice or more in their text."""
    n, rows = len(ids), len(offsets) - 1
    if n < 3:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = np.flatnonzero(row[:-2] == row[2:])
    h = mix64(row[at].astype(np.uint64) + np.uint64(1))
    for k in range(3):
        h = mix64(h + ids[at + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    mark = np.zeros(n, np.int64)
    for k in range(3):
        mark[twice + k] = 1
    return sums_by_row(mark, offsets)


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang_group long, neg_log10_char double"


def metrics(texts: pa.Array, groups: np.ndarray, model: Sent | None) -> dict[str, np.ndarray]:
    """The columns of METRICS for each text of a slice; neg_log10_char is NaN where there is no text or no model."""
    found = {c: v.astype(np.int64) for c, v in base_counts(texts).items()}
    total, length = np.full(len(texts), np.nan), pc.utf8_length(texts).to_numpy().astype(np.int64)
    if model is not None:
        total[length > 0] = 0.0
        for at, packed, alphabet, offsets, bits in grams(texts, groups * FOLDS + folds(texts)):
            seen, back = np.unique(packed, return_inverse=True)
            total += sums_by_row(model.score(*unpacked(seen, alphabet, bits))[back], np.clip(offsets - at, 0, len(back)))
    return found | {"lang_group": groups, "neg_log10_char": -total / np.maximum(length, 1)}


def text_keys(texts: pa.Array, groups: np.ndarray) -> pa.Array:
    """A digest of each text and its group."""
    raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
    return pa.array([hashlib.blake2b(t.as_buffer(), digest_size=16, key=int(g).to_bytes(8, "little")).digest() for t, g in zip(raw, groups, strict=True)], pa.binary())


def joined_scores(docs: DataFrame, rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(key, value): neg_log10_char of each text of these documents, by a join of its 4-grams with their probabilities; copies count alike above and below the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = language_groups(batch.column("lang"), languages)
            for start, texts in text_slices(batch.column("text")):
                own = group[start : start + len(texts)]
                keys, fold = text_keys(texts, own), folds(texts)
                for _, packed, alphabet, _, bits in grams(texts, np.arange(len(texts))):
                    distinct, n = np.unique(packed, return_counts=True)
                    row, first, last = unpacked(distinct, alphabet, bits)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *map(pa.array, (own[row] * FOLDS + fold[row], first, last, n))], ["key", "owner", "first", "last", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "key binary, owner long, first long, last long, n long")
    return found.join(rows, ["owner", "first", "last"]).groupBy("key").agg((-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("value"))


def score(docs: DataFrame, models: list[Part], languages: tuple[str, ...]) -> DataFrame:
    """doc_id and `metrics` of every document."""

    def one(groups: list[int], model: Broadcast | DataFrame) -> DataFrame:
        far = isinstance(model, DataFrame)
        sent = None if far else model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group = language_groups(batch.column("lang"), languages)
                for start, texts in text_slices(batch.column("text")):
                    own = group[start : start + len(texts)]
                    found = metrics(texts, own, None if far else sent.value)
                    none = np.isnan(found["neg_log10_char"])
                    arrays = [pa.array(v, mask=none if c == "neg_log10_char" else None) for c, v in found.items()]
                    keys = [text_keys(texts, own)] if far else []
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.StructArray.from_arrays(arrays, list(found)), *keys], ["doc_id", "metrics", "key"][: 2 + far])

        own = of_groups(docs, groups, languages)
        rows = own.select("doc_id", "text", "lang")
        kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, metrics struct<{METRICS.replace(' ', ':').replace(',:', ',')}>"
        if not far:
            return rows.mapInArrow(run, kinds)
        got = rows.mapInArrow(run, f"{kinds}, key binary").join(joined_scores(own, model, languages), "key", "left")
        return got.select("doc_id", F.col("metrics").withField("neg_log10_char", F.col("value")).alias("metrics"))

    return reduce(DataFrame.unionByName, [one(*m) for m in models])


def bands(scored: DataFrame, n_groups: int, spread: float = SPREAD, reach: tuple[float, float] = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the language groups, from all documents that pass the base rules; nothing is inside where there is none.

    One row a group comes back.
    """
    m = F.col("metrics")
    part = scored.where(~base_failed(m)).groupBy(m["lang_group"].alias("g")).agg(F.percentile_approx(m["neg_log10_char"], [0.25, 0.5, 0.75], 10000).alias("q"))
    lower, upper = np.full(n_groups, np.inf), np.full(n_groups, -np.inf)
    for r in part.collect():
        if r.q:
            low, mid, high = r.q
            lower[r.g], upper[r.g] = low - max(spread * (mid - low), reach[0]), high + max(spread * (high - mid), reach[1])
    return lower, upper


def base_failed(m):
    """Of a struct column, or of a dict of arrays."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def verdict(m, lower: np.ndarray, upper: np.ndarray):
    """True for a document that passes the base rules and lies in its language group's band."""
    low, high = (F.array(*map(F.lit, v.tolist()))[m["lang_group"].cast("int")] for v in (lower, upper))
    return F.coalesce(~base_failed(m) & m["neg_log10_char"].between(low, high), F.lit(False))


def quality_report(docs: DataFrame, spread: float = SPREAD, reach: tuple[float, float] = REACH, limit: int = MODEL_GRAMS) -> DataFrame:
    """doc_id, base counts, base_failed, kept, lang_group (the language, null for the last group) and neg_log10_char for every document."""
    languages = languages_of(docs)
    scored = materialize(score(docs, train(docs, languages, limit), languages), "quality")
    m = F.col("metrics")
    names = F.array(*map(F.lit, languages), F.lit(None).cast("string"))
    return scored.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"),
        verdict(m, *bands(scored, len(languages) + 1, spread, reach)).alias("kept"), names[m["lang_group"].cast("int")].alias("lang_group"), m["neg_log10_char"].alias("neg_log10_char"),
    )


def filter_documents(docs: DataFrame, spread: float = SPREAD, reach: tuple[float, float] = REACH, limit: int = MODEL_GRAMS) -> DataFrame:
    """The documents that are kept, all columns unchanged.

    Texts are scored once for the bands and once more for the verdict, so no copy of them is written or shuffled.
    """
    languages = languages_of(docs)
    models = train(docs, languages, limit)
    low, high = bands(score(docs, models, languages), len(languages) + 1, spread, reach)

    def one(groups: list[int], model: Broadcast | DataFrame) -> DataFrame:
        far = isinstance(model, DataFrame)
        sent = None if far else model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group = language_groups(batch.column("lang"), languages)
                for start, texts in text_slices(batch.column("text")):
                    own = group[start : start + len(texts)]
                    m = metrics(texts, own, None if far else sent.value)
                    rows, value = batch.slice(start, len(texts)), m["neg_log10_char"]
                    good = ~base_failed(m)
                    if far:
                        rows = pa.RecordBatch.from_arrays([*rows.columns, text_keys(texts, own), pa.array(own)], [*rows.schema.names, *added])
                    else:
                        good &= (value >= low[own]) & (value <= high[own])
                    yield rows.filter(pa.array(good))

        own = of_groups(docs, groups, languages)
        if not far:
            return own.mapInArrow(run, docs.schema)
        added = [f"{c}_{uuid.uuid4().hex}" for c in ("key", "group")]
        rows = own.mapInArrow(run, StructType([*docs.schema.fields, StructField(added[0], BinaryType()), StructField(added[1], LongType())]))
        values = joined_scores(own, model, languages).withColumnRenamed("key", added[0]).withColumnRenamed("value", added[0] + "_value")
        lower, upper = (F.array(*map(F.lit, v.tolist()))[F.col(added[1]).cast("int")] for v in (low, high))
        return rows.join(values, added[0]).where(F.col(added[0] + "_value").between(lower, upper)).select(*[rows[f"`{c}`"] for c in docs.columns])

    return reduce(DataFrame.unionByName, [one(*m) for m in models])
