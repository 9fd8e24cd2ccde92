"""SimHash near-dedup with pivot distance tables.

A fingerprint holds a bit where over half of the XXH64 hashes of a text's word shingles hold it.
Two fingerprints link if at most `radius` bits differ. Of the fingerprints that meet, the Hamming distances to
PIVOTS reference fingerprints are computed first; they are sorted by one of these distances, and a pair whose distances
to any pivot differ by more than `radius` cannot link and is discarded; the pairs that are left are verified bit by bit.
Distances to a pivot lie within a few bits of 32, so they are too alike to say which fingerprints meet at all.

Which pairs meet at all: 64 bits are dealt into blocks so that a linking pair agrees in some set of
whole blocks (pigeonhole), and only fingerprints that agree there meet. A larger group is cut into
blocks by hash, and every two of its blocks meet in a group of their own, so no task holds an unbounded
group and no link is lost. A group that would need more than BLOCKS blocks is first dealt again over its remaining bits.
A group sends a star for each of its linked sets, not its pairs. Equal fingerprints are one node throughout.

Components come from alternating large-star and small-star rounds over those stars.

Defined results: null, empty and blank texts have fingerprint zero and link as any other. Texts of fewer
words than a shingle are one shingle. Rows that repeat a doc_id are one document. A row with a
null doc_id has a fingerprint and belongs to the component of equal and linked fingerprints, or to none (null)
if no document with an id is there. Extra columns are ignored by `components` and returned unchanged by
`one_of_each`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, materialize, text_slices

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Groups up to this size are compared at once; larger ones in blocks of half of it, up to so many blocks.
GROUP, BLOCKS = 1024, 128
#: Parts into which rows of one key are dealt where a large group's size is joined to them.
SALTS = 64
#: Two to this power consecutive row numbers share a bitmap; bitmaps hold no more.
BITMAP = 15
#: Mean group size up to which fewer, shorter blocks do.
MEAN_GROUP = 64

_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).view(np.uint64).ravel()


def _pivots() -> np.ndarray:
    """Reference fingerprints: Walsh functions over the 64 bit places, pairwise 32 bits apart."""
    place = np.arange(64)
    rows = [np.bitwise_count(place & k) & 1 for k in (1, 2, 4, 8, 16, 32, 63, 7, 56, 21, 42, 27, 13, 54, 35, 28)]
    return np.array([sum(int(b) << i for i, b in enumerate(r)) for r in rows], np.uint64)


PIVOTS = _pivots()


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of the texts of a slice."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts.to_pylist():
        words = text.encode().lower().split()  # bytes fold A-Z and split at ASCII white space only
        n = len(words)
        if n <= shingle:
            if n:
                hashes.append(digest(b" ".join(words), SEED))
            counts.append(min(n, 1))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1]
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)])
        counts.append(n - shingle + 1)
    return majority(np.array(hashes, np.uint64), np.array(counts, np.int64))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits that over half of each run's hashes hold; an empty run has none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    blocks = -(-n // 255)  # eight bit counts share a word, so at most 255 hashes are summed at once
    at = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(len(at), 64)
    bits = np.add.reduceat(sums, np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                fp = text_fingerprints(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def first_masks(nodes: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two fingerprints at most `radius` bits apart agree under one of them."""
    for equal in range(1, 5):
        blocks = np.array_split(np.arange(64), radius + equal)
        masks = [sum(1 << int(i) for b in pick for i in b) for pick in combinations(blocks, equal)]
        if equal == 4 or nodes <= MEAN_GROUP << min(m.bit_count() for m in masks):
            return masks
    raise AssertionError


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with one of radius + 1 parts of the other bits added: a linking pair agrees under one of these."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(free, min(radius + 1, len(free)))]


def linked(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs (positions) among rows of equal key.

    The rows of a key are sorted by their distance to the pivot that spreads them most, so pairs further apart than `radius` there are
    never formed; those that are formed must be as near in the distances to all other pivots, and then in their bits.
    """
    table = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS]).astype(np.int8)
    table = table[np.argsort(-table.var(axis=1), kind="stable")]
    order = np.lexsort((table[0], key))
    fp, key, table = fp[order], key[order], table[:, order]
    left, right, at = [], [], np.arange(len(fp) - 1)
    for step in range(1, len(fp)):
        at = at[at < len(fp) - step]
        # a row without a partner at this step has none further on: groups are runs, and distances ascend in them
        at = at[(key[at] == key[at + step]) & (table[0, at + step] - table[0, at] <= radius)]
        if not len(at):
            break
        a, b = at, at + step
        for coordinate in table[1:]:
            near = np.abs(coordinate[a] - coordinate[b]) <= radius
            a, b = a[near], b[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        left.append(order[a[close]])
        right.append(order[b[close]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position connected to each of n positions."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), a > b: stars that connect exactly the nodes (fp, rep) that links connect."""
    masks = first_masks(nodes.count(), radius)
    rows = nodes.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp", "rep")
    found = None
    while True:
        out = materialize(_compare(rows.withColumn("pair", F.lit(0).cast("long")), radius, group), "simhash-links")
        edges = out.where("kind = 0").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        large = out.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("fp"), "rep")
        if large.isEmpty():
            return found.distinct()
        sized = materialize(_sized(large, group), "simhash-sized")
        met = materialize(_compare(_block_pairs(sized.where(F.col("n_blocks") <= blocks)), radius, None), "simhash-links")
        found = found.unionByName(met.select("a", "b"))
        rows = sized.where(F.col("n_blocks") > blocks).select("mask", "fp", "rep")
        if rows.isEmpty():
            return found.distinct()
        rows = _finer(rows, radius)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _own() -> Column:
    return F.col("fp").bitwiseAND(F.col("mask")).alias("own")


def _sized(large: DataFrame, group: int) -> DataFrame:
    """The rows of large groups with the number of blocks that their group takes; a group's rows are salted for the join."""
    keyed = large.withColumn("own", _own()).withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SALTS)))
    sizes = keyed.groupBy("mask", "own").agg(F.ceil(2 * F.count("*") / group).alias("n_blocks"))
    salted = sizes.select("mask", "own", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return keyed.join(salted, ["mask", "own", "salt"]).select("mask", "fp", "rep", "n_blocks")


def _block_pairs(sized: DataFrame) -> DataFrame:
    """Every row once for each other block of its group; two rows of a group meet in some pair of blocks."""
    block = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
    rows = sized.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).where("other != block OR n_blocks = 1")
    return rows.select("mask", "fp", "rep", (F.least("block", "other") * (1 << 20) + F.greatest("block", "other")).alias("pair"))


def _finer(rows: DataFrame, radius: int) -> DataFrame:
    """The rows under each finer mask of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp, rep = (batch.column(c).to_numpy() for c in ("mask", "fp", "rep"))
            for m in np.unique(mask):
                own = mask == m
                for new in finer_masks(int(m) & ((1 << 64) - 1), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), _signed(new))), pa.array(fp[own]), pa.array(rep[own])], ["mask", "fp", "rep"])

    return rows.mapInArrow(run, "mask long, fp long, rep long")


def _compare(rows: DataFrame, radius: int, group: int | None) -> DataFrame:
    """Compare the rows of each (mask, masked fingerprint, pair) (kind 0: an edge); send on groups of over `group` rows (kind 1)."""
    schema = "kind int, a long, b long, rep long"

    def emit(kind: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(rep)], ["kind", "a", "b", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the last group, which the next batch may continue
        passing = None  # key of a group that has been found too large and is being sent on
        for batch in batches:
            mask, fp, rep, pair = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("mask", "fp", "rep", "pair"), strict=True))
            if not len(fp):
                continue
            key = np.stack([mask, fp & mask, pair])
            new = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
            first = np.concatenate([[0], new])
            size = np.diff(np.append(first, len(fp)))
            large = size > (group or len(fp))
            if passing is not None and tuple(key[:, 0]) == passing:
                large[0] = True
            last = first[-1]
            if large[-1]:
                passing, last = tuple(key[:, -1]), len(fp)
            else:
                passing = None
            run_of = np.repeat(np.arange(len(first)), size)
            send = large[run_of]
            if send.any():
                yield emit(1, mask[send], fp[send], rep[send])
            own = ~send
            own[last:] = False
            yield from settle(fp[own], rep[own], run_of[own])
            held = [mask[last:], fp[last:], rep[last:], pair[last:]]
        yield from settle(held[1], held[2], np.zeros(len(held[1]), np.int64))

    def settle(fp: np.ndarray, rep: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fp) < 2:
            return
        order = np.lexsort((rep, key))  # so that a star's centre is its smallest document
        fp, rep, key = fp[order], rep[order], key[order]
        label = stars(len(fp), *linked(fp.view(np.uint64), key, radius))
        leaf = np.flatnonzero(rep[label] < rep)
        if len(leaf):
            yield emit(0, rep[leaf], rep[label[leaf]], rep[leaf])

    keyed = rows.withColumn("own", _own())
    dealt = keyed.repartition("mask", "own", "pair").sortWithinPartitions("mask", "own", "pair").select("mask", "fp", "rep", "pair")
    return dealt.mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected to each node of the edges (a, b), a > b.

    Large-star and small-star rounds until the edges are stars: whoever has a smaller neighbour has no other. Edges that are stars, such as
    an earlier result, cost no round. Every round is written, so a lost executor costs that round only, and minima are written before they
    are joined, so a hub's rows can be split.
    """
    edges = materialize(edges, "components")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")), "components-min")
        if near.where("low < a AND high > low").isEmpty():
            return near.where("low < a").select(F.col("a").alias("node"), F.col("low").alias("component"))
        large = both.join(near.drop("high"), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large = materialize(large, "components-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "components-min")
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "components")


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    own = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    found = connected(links(nodes.where("rep IS NOT NULL"), radius, group))
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "simhash-named")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """The documents with one row for each component, all columns unchanged: of its smallest doc_id, the first such row; nulls come last.

    Rows are told apart by a number written with their fingerprints, and the fingerprints are the nodes, so rows without an id
    link and stay like any other, and rows that repeat a doc_id with other texts are not one document.

    Texts are written once, in buckets of blocks of consecutive numbers, and not shuffled: numbers of the rows that stay meet in
    a bitmap for each block, 4 KB, and each bucket's texts stream past the bitmaps of its blocks.
    """
    names = ("near_dedup_row", "near_dedup_fp", "near_dedup_block", "in_block", "bits")
    number, mark, block, in_block, bits = (_free(name, docs.columns) for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                fp = text_fingerprints(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(fp)], [*batch.schema.names, mark])

    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    marked = numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, T.StructField(mark, T.LongType())]))
    rows = bucketed(marked.withColumn(block, F.shiftright(number, BITMAP)), block, "simhash_texts")
    doc_id = F.col("doc_id").cast("long")
    first = F.min(F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.col(number).alias("number"))).alias("first")
    nodes = materialize(rows.groupBy(F.col(mark).alias("fp")).agg(first), "simhash-nodes")
    found = connected(links(nodes.select("fp", F.col("fp").alias("rep")), radius, group))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    stays = named.select(F.shiftright("first.number", BITMAP).alias(in_block), F.col("first.number").bitwiseAND((1 << BITMAP) - 1).alias("bit"))
    # numbers are shuffled before they become bitmaps: a task would else send a whole bitmap for each block it has a number of
    stays = stays.repartition(in_block).groupBy(in_block).agg(F.bitmap_construct_agg("bit").alias(bits))
    stays = materialize(stays, "simhash-kept")
    bit = F.col(number).bitwiseAND((1 << BITMAP) - 1)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("long")
    kept = rows.join(stays.hint("shuffle_hash"), F.col(block) == F.col(in_block))
    return kept.where(F.expr(f"1 << (`{number}` & 7)").bitwiseAND(byte) != 0).select(*(rows[f"`{c}`"] for c in docs.columns))


def _free(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name
