"""MinHash near-dedup with a signature-coordinate inverted join.

A document's set holds its distinct word shingles, as 64-bit hashes. Its signature has COORDINATES coordinates, each the smallest hash of the
set under its own order; BAND coordinates at a time make a band, and a document is posted under each of its bands, its tokens.

- Bands: two documents whose sets are as near as 85 % of their union share a band but for one pair in eight thousand million, while sets that
  merely have some passages in common hardly ever do. So lists hold candidates, and their number grows with the documents. Tokens of one document
  only are of no use and are not posted.
- Short signatures: such documents agree in MATCHES or more of the coordinates but for one pair in ten thousand million. Agreements of those that
  meet in a list are counted on a byte for each coordinate, which can only count too many. Sketches of the full sets go with them: a bit of a
  sketch is the parity of how many members fall there, so equal members cancel out and two sketches cannot differ in more bits than the sets in members.
- What is left is confirmed on the full sets.

Equal sets are one node throughout. A list does not form all its pairs: a round links its documents to the one that shares most with others, and
confirmed links make components; documents of one component need no comparing. Rounds go on, with documents outside a list's largest component,
as long as a fair share of their pairs turn out to be links, and these are more than a few, and more pairs are left than FEW for each posting. Then all pairs of different components are compared, those outside a list's largest
component with each other and with it, in blocks. So no link between components is lost, and the outcome is that of comparing everybody.

Sets are written only for documents that were posted. Which these are goes to the tasks as a Bloom filter of fixed size; more documents than it
holds well make it let others through, and a join drops those.

Defined results: null, empty and blank texts have an empty set and are alone. Texts of fewer words than a shingle are one shingle. Rows are
documents, also those that repeat a doc_id; component_id is the smallest doc_id reachable, null where no row there has one. kept is true where
doc_id = component_id, and for rows of a component without any id. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, split_words, text_slices, vocab_hashes
from .simhash import connected

SHINGLE = 3
#: Links hold at least so many percent of the union in the intersection.
PERCENT = 85
COORDINATES, MATCHES, BAND = 72, 39, 3
#: Rows that a block of a long list holds.
BLOCK = 512
#: Rounds of linking each list to one document at most, and what must be links for another one: a share of a round's pairs, and one of the posted documents.
ROUNDS, YIELD, CALM = 6, 0.1, 0.005
#: Pairs of different components for each posting, up to which all are compared at once: a pair takes about a microsecond, and no more of them than grow with the postings.
FEW = 256
#: Bits of the parity sketch of a set.
PARITY = 1024
#: Bits of the Bloom filter of posted documents, as a power of two.
BLOOM = 26

_FACTORS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TAGS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def text_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice laid end to end, and the offsets."""
    words = split_words(texts, lower=True)
    hashes = vocab_hashes(words.vocab)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    size = len(hashes)
    mixed = np.zeros(size, np.uint64)  # of the shingle that starts at each word, as far as there are words
    for k in range(shingle):
        mixed[: max(0, size - k)] = mix64(mixed[: max(0, size - k)] * _LANES[0] + hashes[k:] + _LANES[1])
    sets, counts = [], []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            own = np.unique(mixed[a : b - shingle + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from full shingles
            own = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                own = mix64(own * _LANES[2] + h)
        else:
            own = hashes[:0]
        sets.append(own)
        counts.append(len(own))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set; none for an empty one."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ lane))]) for lane in _LANES[:2]]
    both = np.stack([t[offsets[1:]] - t[offsets[:-1]] for t in total], axis=1)
    return [row.tobytes() if n else None for row, n in zip(both, np.diff(offsets).tolist(), strict=True)]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each full set, a row of COORDINATES for each: equal at a coordinate where its smallest values are, and else never."""
    out = np.empty((len(offsets) - 1, COORDINATES), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k, (factor, tag) in enumerate(zip(_FACTORS, _TAGS, strict=True)):
            out[full, k] = mix64(np.minimum.reduceat(values * factor, offsets[full]) ^ tag)
    return out


def bands(own: np.ndarray) -> np.ndarray:
    """A token for each BAND coordinates of the signatures."""
    parts = own.reshape(len(own), -1, BAND)
    out = parts[:, :, 0]
    for k in range(1, BAND):
        out = mix64(out * _LANES[0] + parts[:, :, k])
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, n_shingles, digest, short, tokens): the last three are null for empty sets; short holds a byte of each coordinate, tokens are bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                values, offsets = text_sets(texts, shingle)
                n = np.diff(offsets)
                own = signatures(values, offsets)
                short = pa.array([x.tobytes() if k else None for x, k in zip(own.astype(np.uint8), n.tolist(), strict=True)], pa.binary())
                flat = pa.array(np.ascontiguousarray(bands(own[n > 0])).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * (COORDINATES // BAND), pa.int32()), flat, mask=pa.array(n == 0))
                ids = [batch.column(c).slice(start, len(texts)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), pa.array(digests(values, offsets), pa.binary()), short, lists], ["row", "doc_id", "n_shingles", "digest", "short", "tokens"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, short binary, tokens array<long>")


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node, popularity): nodes under the tokens that others hold too, with how often all their tokens are held."""
    tokens = nodes.select("node", F.explode("tokens").alias("token"))
    held = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    return held.select("token", "node", F.sum("df").over(Window.partitionBy("node")).alias("popularity"))


def _bytes(column: pa.Array) -> np.ndarray:
    """Rows of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def parity_sketch(members: np.ndarray, size: int = PARITY) -> bytes:
    """Bit k is the parity of how many members fall on k."""
    return np.packbits(np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def may_link(n_a: np.ndarray, n_b: np.ndarray, short_a: np.ndarray, short_b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray) -> np.ndarray:
    """Whether sizes, differing bits of the sketches and agreeing coordinates leave a link possible; the first two never rule one out."""
    yes = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    yes[yes] = (100 + PERCENT) * _differing(odd_a[yes], odd_b[yes]) <= (100 - PERCENT) * (n_a[yes] + n_b[yes])
    yes[yes] = (short_a[yes] == short_b[yes]).sum(axis=1) >= MATCHES
    return yes


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def star_pairs(rows: DataFrame, lists: DataFrame | None) -> DataFrame:
    """(a, b), a > b: the rows of each list with its most popular node, at first (no lists yet) of all and later outside the largest component, where components differ."""
    here = rows if lists is None else rows.join(lists.select("token", "major"), "token")
    entry = F.struct("popularity", (-F.col("node")).alias("node"), "component")
    best = here.groupBy("token").agg(F.max(entry if lists is None else F.when(F.col("component") != F.col("major"), entry)).alias("c"))
    both = here.join(best.select("token", (-F.col("c.node")).alias("other"), F.col("c.component").alias("other_component")), "token").where("component <> other_component")
    return both.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def thinned(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that may link, by the marks (node, n, short, odd) of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(c).to_numpy() for c in ("a_n", "b_n")]
                yes = pa.array(may_link(*n, *(_bytes(batch.column(c)) for c in ("a_short", "b_short", "a_odd", "b_odd"))))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(yes) for c in ("a", "b")], ["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "short", "odd")]), side)
    return pairs.mapInArrow(run, "a long, b long")


def lists_left(rows: DataFrame) -> DataFrame:
    """(token, size, major, top): of each list with several components its rows and its largest component with its rows."""
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    lists = parts.groupBy("token").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("parts"))
    return lists.where("parts > 1").select("token", "size", F.col("most.component").alias("major"), F.col("most.k").alias("top"))


def block_pairs(rows: DataFrame, lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """(token, low, high, side, node, component): the rows of the lists, dealt so that any two of different components meet: a short list
    as one block, else blocks outside the largest component with all blocks."""
    short = F.col("size") <= block
    minor = short | (F.col("component") != F.col("major"))
    n_minor = F.when(short, 1).otherwise(F.ceil((F.col("size") - F.col("top")) / block)).cast("long")
    n_major = F.when(short, 0).otherwise(F.ceil(F.col("top") / block)).cast("long")
    own = F.when(minor, F.pmod(F.xxhash64("node", F.lit(7)), n_minor)).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), n_major) + n_minor)
    dealt = rows.join(lists, "token").select("token", "node", "component", own.alias("own"), F.when(minor, n_minor + n_major).otherwise(n_minor).alias("n_other"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_other") - 1)))
    return dealt.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("side"), "node", "component")


def all_pairs(dealt: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b), a > b: the pairs of different components in each dealt group that may link."""
    numbers, names = ("token", "low", "high", "side", "node", "component", "n"), ("short", "odd")

    def settle(side: np.ndarray, node: np.ndarray, component: np.ndarray, n: np.ndarray, short: np.ndarray, odd: np.ndarray, within: bool) -> Iterator[pa.RecordBatch]:
        one = np.arange(len(node)) if within else np.flatnonzero(side)
        two = one if within else np.flatnonzero(~side)
        for at in range(0, len(one), 32):
            x = one[at : at + 32]
            i, j = np.nonzero(component[x, None] != component[None, two])
            i, j = x[i], two[j]
            if within:
                i, j = i[i < j], j[i < j]
            yes = may_link(n[i], n[j], short[i], short[j], odd[i], odd[j])
            a, b = node[i[yes]], node[j[yes]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last group, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in numbers] + [_bytes(batch.column(c)) for c in names]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            token, low, high = rows[:3]
            ends = np.flatnonzero((token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                if b - a > 1:
                    yield from settle(*(x[a:b] for x in rows[3:]), within=low[a] == high[a])
            held = [x[ends[-1] if len(ends) else 0 :] for x in rows]
        if held is not None and len(held[0]) > 1:
            yield from settle(*held[3:], within=held[1][0] == held[2][0])

    sort = ["token", "low", "high"]
    return dealt.join(marks, "node").repartition(*sort).sortWithinPartitions(*sort).select(*numbers, *names).mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, posted: DataFrame, shingle: int = SHINGLE, bits_log: int = BLOOM) -> DataFrame:
    """(node, n, short, odd, members) of the posted (node, digest, n, short): read anew from the texts, each distinct set once a task."""
    marks = docs.sparkSession.sparkContext.broadcast(_digest_filter(posted, bits_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        words, log = marks.value
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                values, offsets = text_sets(texts, shingle)
                digest, members = [], []
                for k, own in enumerate(digests(values, offsets)):
                    if own is None or own in sent or not _in_filter(words, log, own):
                        continue
                    if len(sent) >= 1 << 18:
                        sent.clear()
                    sent.add(own)
                    digest.append(own)
                    members.append(values[offsets[k] : offsets[k + 1]])
                ends = np.concatenate([[0], np.cumsum([len(m) for m in members], dtype=np.int64)])
                flat = pa.array(np.concatenate([*members, np.zeros(0, np.uint64)]).view(np.int64))
                odd = pa.array([parity_sketch(m) for m in members], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), odd, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["digest", "odd", "members"])

    read = docs.select("text").mapInArrow(run, "digest binary, odd binary, members array<long>")
    return read.join(posted, "digest").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("node", "n", "short", "odd", "members")]).drop("digest")


def _digest_filter(posted: DataFrame, bits_log: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of digests in 64-bit words: three places from a digest's own bits. At most 2 ** (bits_log - 6) rows reach the driver, one for each word."""
    own = [F.conv(F.substring(F.hex("digest"), at, 8), 16, 10).cast("long") for at in (1, 9, 17)]
    places = posted.select(F.explode(F.array(*[F.pmod(x, F.lit(1 << bits_log)) for x in own])).alias("place"))
    masks = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("mask")).toArrow()
    out = np.zeros(1 << bits_log - 6, np.int64)
    out[masks.column("word").to_numpy()] = masks.column("mask").to_numpy()
    return out, bits_log


def _in_filter(words: np.ndarray, bits_log: int, digest: bytes) -> bool:
    for k in (0, 4, 8):
        place = int.from_bytes(digest[k : k + 4], "big") & (1 << bits_log) - 1
        if not int(words[place >> 6]) >> (place & 63) & 1:
            return False
    return True


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = np.zeros(batch.num_rows, bool)
            one, two = batch.column("one"), batch.column("two")
            for k in range(batch.num_rows):
                x, y = (np.asarray(column[k].values) for column in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes[k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes)) for c in ("a", "b")], ["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b")
    return full.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, block: int = BLOCK, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """(node, component) of every node that links to another; nodes are (node, digest, n, short, tokens)."""
    listed = materialize(postings(nodes), "minhash-postings")
    posted = nodes.select("node", "digest", "n", "short").join(listed.select("node").distinct(), "node")
    sets = materialize(full_sets(docs, materialize(posted, "minhash-posted"), shingle), "minhash-sets")
    marks, n_posted, n_listed = sets.select("node", "n", "short", "odd"), sets.count(), listed.count()
    rows, tried, named = listed.withColumn("component", F.col("node")), None, None
    last = not rounds
    for turn in count():
        lists = materialize(lists_left(rows), "minhash-left") if turn or last else None
        last = last or (turn and lists.agg(F.coalesce(F.sum((F.col("size") - F.col("top")) * F.col("size")), F.lit(0))).first()[0] <= few * n_listed)
        if not last:
            pairs = star_pairs(rows, lists)
            pairs = thinned(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), marks)
        else:
            pairs = all_pairs(block_pairs(rows, lists, block), marks)
            pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "minhash-pairs")
        edges = materialize(confirmed(pairs, sets), "minhash-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        n_pairs, n_edges = pairs.count(), edges.count()
        if n_edges:  # what is connected so far stands for the links behind it
            named = connected(edges if named is None else edges.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if last:
            break
        if n_edges:
            rows = materialize(listed.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "minhash-rows")
        last = turn + 1 >= rounds or n_edges <= max(YIELD * n_pairs, CALM * n_posted)
    return nodes.sparkSession.createDataFrame([], "node long, component long") if named is None else named


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = materialize(sketches(docs, shingle), "minhash-rows")
    first = [F.first(c).alias(c) for c in ("short", "tokens")]
    full = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), *first)
    nodes = materialize(full, "minhash-nodes")
    named = links(docs, nodes, shingle, block, rounds)
    of_node = materialize(nodes.select("digest", "node", "least").join(named, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component")), "minhash-components")
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    by_digest = of_node.join(smallest, "component").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
