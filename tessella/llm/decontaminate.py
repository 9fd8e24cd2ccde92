"""Benchmark decontamination by spaced-seed hashing.

Words are folded to lower case (A-Z) and lose ASCII marks at either end; words of marks only are dropped.
A seed hashes the words at a mask's fixed places and ignores those between. Seeds of
benchmark items and of documents are joined, and around each hit document and item are laid side by side:
the hit counts if a window of WINDOW words around it differs in at most SUBSTITUTIONS of them.
The two masks hit every such window, wherever its substitutions stand, so nothing is missed.
An item shorter than the window, but of at least LEAST words, counts where it stands whole and unchanged.

A benchmark of up to `limit` words is sent to the executors as an index. Beyond that both sides' seeds
are shuffled and joined, with a bitmap of fixed size that keeps document seeds that no item has out of the shuffle. Rows of both sides
are told apart by a number written with their words; each pair of rows that share a seed is laid side by side once, whole, at all
their places, so that both ways give the same rows.

Defined results: null and empty texts, and items of fewer than LEAST words, match nothing.
Repeated documents and repeated items each get their rows. Items with a null item_id are searched under null.
Extra columns are ignored by `matches` and returned unchanged by `filter_documents`. An empty table on either side gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, split_words, text_slices, vocab_hashes

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW, SUBSTITUTIONS, LEAST = 13, 2, 5
#: Benchmark words up to which the index is sent to the executors (about 60 bytes a word).
LIMIT = 1_000_000
BITMAP_BITS = 24
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normal words of each text end to end, and offsets."""
    words = split_words(texts, lower=True)
    vocab = pc.utf8_trim(words.vocab, characters=MARKS)
    full = pc.binary_length(vocab).to_numpy(zero_copy_only=False) > 0
    keep = full[words.ids] if len(full) else np.zeros(0, bool)
    return vocab_hashes(vocab)[words.ids[keep]], np.concatenate([[0], np.cumsum(keep)])[words.offsets]


def seeds(hashes: np.ndarray, row: np.ndarray, places: tuple[int, ...], name: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) wherever the mask fits within a row; `row` is each word's row."""
    span = places[-1]
    at = np.arange(max(0, len(hashes) - span))
    at = at[row[at] == row[at + span]]
    out = np.full(len(at), name, np.uint64)
    for p in places:
        out = mix64(out + hashes[at + p])
    return at, out


def masks_for(lengths: np.ndarray) -> list[tuple[int, ...]]:
    """The two masks, and a whole-item mask for each length of short items."""
    short = sorted({int(n) for n in lengths if LEAST <= n < WINDOW})
    return [*MASKS, *(tuple(range(n)) for n in short)]


def item_seeds(hashes: np.ndarray, offsets: np.ndarray, masks: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of all items: windows of long items, whole short items."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    length = np.diff(offsets)[row] if len(row) else row
    out = []
    for k, places in enumerate(masks):
        at, seed = seeds(hashes, row, places, k)
        fits = length[at] >= WINDOW if k < len(MASKS) else (length[at] == len(places))
        out.append((seed[fits], at[fits]))
    return np.concatenate([s for s, _ in out]), np.concatenate([a for _, a in out])


@dataclass
class Index:
    """A benchmark's words, and its seeds in order, with a bitmap in front of them."""

    ids: list
    hashes: np.ndarray
    offsets: np.ndarray
    masks: list[tuple[int, ...]]
    seed: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


def build_index(ids: list, texts: pa.Array) -> Index:
    hashes, offsets = word_hashes(pc.fill_null(texts, ""))
    masks = masks_for(np.diff(offsets))
    seed, place = item_seeds(hashes, offsets, masks)
    order = np.argsort(seed, kind="stable")
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[seed >> np.uint64(64 - BITMAP_BITS)] = True
    return Index(ids, hashes, offsets, masks, seed[order], place[order], bitmap)


def best_window(same: np.ndarray) -> tuple[int, int]:
    """(start, matching words) of the best window, the first of equals."""
    total = np.concatenate([[0], np.cumsum(same)])
    score = total[WINDOW:] - total[:-WINDOW]
    k = int(np.argmax(score))
    return k, int(score[k])


def overlap(words: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int] | None:
    """(first matching word, matching words) if the item matches with its first word at `start` of the text."""
    lo, hi = max(start, 0), min(start + len(item), len(words))
    same = words[lo:hi] == item[lo - start : hi - start]
    if len(item) < WINDOW:
        at, score = 0, int(same.sum()) if len(same) == len(item) else 0
        good = score == len(item)
    elif len(same) < WINDOW:
        return None
    else:
        at, score = best_window(same)
        good = score >= WINDOW - SUBSTITUTIONS
    return (lo + at, int(same.sum())) if good else None


def find(index: Index, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, first matching word of the text, matching words): the best place of each pair that matches."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = [np.zeros((0, 3), np.int64)]
    for k, places in enumerate(index.masks):
        at, seed = seeds(hashes, row, places, k)
        hit = np.flatnonzero(index.bitmap[seed >> np.uint64(64 - BITMAP_BITS)])
        lo, hi = np.searchsorted(index.seed, seed[hit], "left"), np.searchsorted(index.seed, seed[hit], "right")
        n = hi - lo
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, at = index.place[where], np.repeat(at[hit], n)
        item = np.searchsorted(index.offsets, place, "right") - 1
        start = at - (place - index.offsets[item])  # where the item's first word would stand, in the slice
        pairs.append(np.stack([row[at], item, start], axis=1))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for r, i, start in np.unique(np.concatenate(pairs), axis=0).tolist():
        got = overlap(hashes[offsets[r] : offsets[r + 1]], index.hashes[index.offsets[i] : index.offsets[i + 1]], start - int(offsets[r]))
        if got:
            at, score = got
            if (r, i) not in best or (-score, at) < (-best[r, i][1], best[r, i][0]):
                best[r, i] = (at, score)
    return [(r, i, at, score) for (r, i), (at, score) in sorted(best.items())]


def small_index(benchmark: DataFrame, limit: int) -> Index | None:
    """The benchmark's index if it has at most `limit` words; its size is measured before anything is collected."""
    words = benchmark.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    if words > limit:
        return None
    got = benchmark.select("item_id", "text").toArrow()
    return build_index(got.column("item_id").to_pylist(), got.column("text").combine_chunks())


MATCH = "doc_id long, item_id long, first_word long, n_match long"


def matches(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each document and item that overlap: where (counted in words), and how many words agree there."""
    index = small_index(benchmark, limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if index is None:
        return _shuffled(rows.withColumn("number", F.monotonically_increasing_id()), benchmark).drop("number")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                got = find(shared.value, *word_hashes(texts))
                doc_id = batch.column("doc_id").slice(start, len(texts)).take(pa.array([g[0] for g in got], pa.int64()))
                item = pa.array([shared.value.ids[g[1]] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_id, item, *(pa.array([g[k] for g in got], pa.int64()) for k in (2, 3))], ["doc_id", "item_id", "first_word", "n_match"])

    return rows.mapInArrow(run, MATCH)


def _word_rows(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(number, key, words): each row's word hashes, written with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                hashes, offsets = word_hashes(texts)
                words = pa.array([hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("number").slice(start, len(texts)), batch.column(key).slice(start, len(texts)), words], ["number", key, "words"])

    return materialize(rows.mapInArrow(run, f"number long, {key} long, words binary"), label)


def _seed_rows(rows: DataFrame, masks: list[tuple[int, ...]], bitmap: np.ndarray | None, items: bool) -> DataFrame:
    """(seed, number, at): the seeds of each row and where they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            data = batch.column("words")
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(data).to_numpy().astype(np.int64) // 8)])
            hashes = np.frombuffer(b"".join(data.to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(number)), np.diff(offsets))
            length = np.diff(offsets)
            for k, places in enumerate(masks):
                at, seed = seeds(hashes, row, places, k)
                if items:
                    own = length[row[at]] >= WINDOW if k < len(MASKS) else length[row[at]] == len(places)
                else:
                    own = bitmap[seed >> np.uint64(64 - BITMAP_BITS)]
                at, seed = at[own], seed[own]
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(number[row[at]]), pa.array(at - offsets[row[at]])], ["seed", "number", "at"])

    return rows.mapInArrow(run, "seed long, number long, at long")


def _shuffled(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`matches` for a benchmark of any size, of rows (number, doc_id, text), with their numbers."""
    numbered = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = _word_rows(numbered, "item_id", "benchmark-words")
    texts = _word_rows(rows, "doc_id", "document-words")
    masks = masks_for(np.arange(LEAST, WINDOW))
    right = materialize(_seed_rows(items, masks, None, True), "benchmark-seeds")
    bits = right.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).alias("b")).distinct().toArrow()  # at most 2 ** BITMAP_BITS
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[bits.column("b").to_numpy()] = True
    left = _seed_rows(texts, masks, bitmap, False)
    both = left.join(right.select("seed", F.col("number").alias("item"), F.col("at").alias("place")), "seed")
    pairs = both.groupBy("number", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    pairs = pairs.join(items.select(F.col("number").alias("item"), "item_id", F.col("words").alias("item_words")), "item").join(texts, "number")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, first, n = [], [], []
            for j in range(len(batch)):
                words, item = (np.frombuffer(batch.column(c)[j].as_py(), np.uint64) for c in ("words", "item_words"))
                found = [got for start in batch.column("starts")[j].as_py() if (got := overlap(words, item, start))]
                if found:
                    at, score = min(found, key=lambda f: (-f[1], f[0]))
                    keep.append(j)
                    first.append(at)
                    n.append(score)
            got = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("number", "doc_id", "item_id")]
            yield pa.RecordBatch.from_arrays([*got, pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["number", "doc_id", "item_id", "first_word", "n_match"])

    return pairs.select("number", "doc_id", "item_id", "starts", "words", "item_words").mapInArrow(check, f"number long, {MATCH}")


def filter_documents(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents that overlap no benchmark item, all columns unchanged."""
    index = small_index(benchmark, limit)
    if index is None:
        name = "decontamination_row"
        rows = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "decontamination-rows")
        bad = _shuffled(rows.select(F.col(name).alias("number"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
        bad = materialize(bad.select(F.col("number").alias(name)).distinct(), "contaminated")
        return rows.join(bad, name, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                clean = np.ones(len(texts), bool)
                clean[[g[0] for g in find(shared.value, *word_hashes(texts))]] = False
                yield batch.slice(start, len(texts)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
