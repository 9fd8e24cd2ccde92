"""Spelling variants by wildcard groups, without forming pairs.

Words that differ in one replaced code point share a wildcard group: a position with the prefix before and the suffix after it. Such a
group has as many near words for each of its words as others are in it, and the best of them is its first word, or its second for the first
one itself; so each group keeps its size and its top two. Words that differ by an inserted or deleted code point meet where the word with
one code point deleted is itself in the vocabulary. A group holds at most one word for each letter (and position), so none grows with
the corpus, and only a word's own counts are added up, first in each task.

Words are numbered in code-point order, and groups hold numbers, so a word of L letters sends 2 L short rows. Keys are spelled out up to
SPELLED letters; longer ones are lengths and polynomial hashes modulo 2^127 - 1 of what stands before and after the position, so that a run of
a million letters is still read once.

A word's form is its near word of most occurrences if it has `factor` times as many; forms lead to others until one has none. Counts grow
by `factor` at each step, so doubling the steps ends after five rounds at most for 64-bit counts.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string; repeated rows count again; ties go to the
smallest word in code-point order; extra columns are not read; an empty table gives an empty result. A long text is read in parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

#: Shortest word, least count, and how many times as many occurrences a form has.
LETTERS, OCCURRENCES, FACTOR = 7, 2, 10
#: Runs whose hash this divides lose a letter.
THINNING = 31
#: Longest key that is spelled out.
SPELLED = 64
#: Distinct words that a task counts before it hands them on, and characters of a text that are read at once.
HELD, PART = 200_000, 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
WILD, DELETED, OWN = 0, 1, 2
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D5DEECE66D


def runs(text: str, part: int = PART) -> Iterator[list[str]]:
    """The maximal letter runs of a text, part by part; a run is never cut."""
    start = 0
    while start < len(text):
        stop = min(start + part, len(text))
        if stop < len(text) and (rest := RUN.match(text, stop)):
            stop = rest.end()
        yield RUN.findall(text, start, stop)
        start = stop


def word_counts(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n): occurrences after thinning."""

    def emit(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(start, len(texts)).to_pylist()
                for doc_id, text in zip(ids, pc.ascii_lower(texts).to_pylist(), strict=True):
                    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for found in runs(text):
                        for word, n in Counter(found).items():
                            if len(word) < letters:
                                continue
                            h = crc32(word.encode(), seed)
                            if not h % THINNING:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < letters:
                                    continue
                            counts[word] += n
                        if len(counts) >= HELD:
                            yield emit(counts)
                            counts = Counter()
        if counts:
            yield emit(counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(id, word, n): words with enough occurrences; ids ascend as words do in code-point order."""
    counted = materialize(word_counts(docs, letters).where(F.col("n") >= occurrences), "variants-counts")
    ordered = counted.repartitionByRange("word").sortWithinPartitions("word")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variants-words")


def keys(word: str) -> Iterator[tuple[int, str]]:
    """The groups that a word takes part in: by wildcard, by each distinct deletion, and as itself."""
    size = len(word)
    if size <= SPELLED:
        for i in range(size):
            yield WILD, f"{word[:i]}*{word[i + 1 :]}"
        for i in range(size):
            if not i or word[i] != word[i - 1]:
                yield DELETED, word[:i] + word[i + 1 :]
        yield OWN, word
        return
    after = [0] * (size + 1)
    power = 1
    for i in range(size - 1, -1, -1):
        after[i] = (after[i + 1] + ord(word[i]) * power) % _PRIME
        power = power * _BASE % _PRIME
    yield OWN, f"#{size}:{after[0]:x}"
    # before[i] * BASE ** (size - 1 - i) is the prefix's share in the hash of the word without letter i
    shares, share, power = [0] * size, 0, pow(_BASE, size - 1, _PRIME)
    inverse = pow(_BASE, -1, _PRIME)
    for i in range(size):
        shares[i] = share * inverse % _PRIME
        share = (share + ord(word[i]) * power) % _PRIME
        power = power * inverse % _PRIME
    for i in range(size):
        yield WILD, f"*{i}:{size}:{shares[i]:x}:{after[i + 1]:x}"
        if not i or word[i] != word[i - 1]:
            yield DELETED, f"#{size - 1}:{(shares[i] + after[i + 1]) % _PRIME:x}" if size - 1 > SPELLED else word[:i] + word[i + 1 :]


def group_rows(words: DataFrame) -> DataFrame:
    """(key, kind, id, n): every word's rows in its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "id", "n"]
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
                for kind, key in keys(word):
                    for column, value in zip(columns, (key, kind, number, n), strict=True):
                        column.append(value)
                    if len(columns[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)
                        columns = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)

    return words.mapInArrow(run, "key string, kind int, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with near words how many there are, and its best as a struct of n and negated id."""
    own = F.col("kind") == OWN
    # a word itself comes after those that delete to it, so the first two rows are a group's top two
    group = Window.partitionBy("key").orderBy(own, F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("id"))
    seen = group_rows(words).select(
        "kind", "id", entry.alias("entry"), F.count("*").over(group).alias("size"), F.first(entry).over(group).alias("top"), F.nth_value(entry, 2).over(group).alias("next"),
        F.max(F.when(own, entry)).over(group).alias("word"),
    )
    others = F.col("size") - 1
    wild = F.when(F.col("kind") == WILD, F.when(F.col("top") == F.col("entry"), F.col("next")).otherwise(F.col("top")))
    near = F.when(F.col("kind") == DELETED, F.when(F.col("word").isNotNull(), 1).otherwise(0)).otherwise(others)
    best = wild.when(F.col("kind") == DELETED, F.col("word")).otherwise(F.col("top"))
    return seen.where("size > 1").select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(steps: DataFrame) -> DataFrame:
    """(id, root): where the steps (id, to) end, by doubling them until nothing changes."""
    now = materialize(steps.select("id", F.col("to").alias("root")), "variants-roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        moved = materialize(now.join(ahead, "root", "left").select("id", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "variants-roots")
        now = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = vocabulary(docs, letters, occurrences)
    found = words.join(neighbours(words), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.id")).alias("form_id"))
    found = materialize(found, "variants-near")
    ends = roots(found.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("to")))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    with_form = found.where("form_id IS NOT NULL").join(ends.select("id", F.col("root").alias("root_id")), "id").join(forms, "form_id").join(last, "root_id")
    alone = found.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return with_form.select("word", "form", "root", "n", "n_near", "form_n").unionByName(alone)
