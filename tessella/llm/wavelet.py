"""Token-ID output: a wavelet matrix for each shard.

Documents are ranged by doc_id, encoded with a public tokenizer, and written as shards of bounded size in that
order. A shard file holds its token ids as a wavelet matrix: one bit plane for each bit of an id, from the highest,
each plane ordered by the bits before it, with sampled rank counts. The samples and the planes' blocks are deflated one by one and
found by offset, so from one file, reading and inflating only the blocks it needs, it answers which token stands at a place (access) or at a
run of places, how often one occurs before a place (rank) and where its k-th occurrence is (select).

Encoding works on distinct words: the tokenizer never joins across white space, so a text's ids are those of its words.
Ranges are of about RANGE_BYTES of text; the tokens before a shard are sums within groups of ranges, on top of the groups' sums.

Files are written in the shared folder under names made from the task's partition, first under a name of the attempt and
then moved, so a task that runs again replaces its own files only.

Defined results: null and empty texts have only the end id. Rows with a null doc_id come first. Rows that repeat a doc_id
are in the order of a hash of their text. Extra columns are ignored. An empty table makes no shard and an empty result.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import resolve
from .common import materialize, shared_dir, split_words, text_slices
from .warc import put

MAGIC = b"WAVELET1"
END_ID = 1
#: Tokens of a shard; a single longer document has a shard of its own.
SHARD_TOKENS = 4 << 20
#: Bytes of text of one range, about; a range is one task.
RANGE_BYTES = 32 << 20
#: Ranges whose sums are added up together.
RANGE_GROUP = 1024
#: Bits for each sampled rank, bytes of a plane for each deflated block.
STEP, BLOCK = 512, 1 << 15
#: Entries of the memos of words and of pieces; a full memo is emptied.
MEMO = 600_000
# The pre-token pattern of the vocabulary, and what it comes to in words of plain Latin letters and printable ASCII, folded to lower case; OTHER is in no such word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
OTHER = r"[^!-~À-ÖØ-öø-ÿ]"


class Plane:
    """The bits of one plane, eight a byte, with `samples`: the ones before each STEP bits."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        padded = np.pad(data, (0, -len(data) % (STEP // 8)))
        self.samples = np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, STEP // 8).sum(1, dtype=np.int64))])

    def bytes(self, lo: int, hi: int) -> np.ndarray:
        return self.data[lo:hi]

    def bits(self, lo: int, hi: int) -> np.ndarray:
        """The bits at places lo to hi - 1."""
        return np.unpackbits(self.bytes(lo // 8, -(-hi // 8)), bitorder="little")[lo % 8 : lo % 8 + hi - lo].view(bool)

    def rank(self, at: int) -> int:
        """Ones before a place."""
        block = at // STEP
        return int(self.samples[block]) + int(np.count_nonzero(self.bits(block * STEP, at)))

    def select(self, k: int, one: int) -> int:
        """Place of the k-th one or zero."""
        count = self.samples if one else np.arange(len(self.samples)) * STEP - self.samples
        block = int(np.searchsorted(count, k, "right")) - 1
        bits = np.unpackbits(self.bytes(block * STEP // 8, (block + 1) * STEP // 8), bitorder="little") == one
        return block * STEP + int(np.flatnonzero(bits)[k - int(count[block])])


class StoredPlane(Plane):
    """A plane of a shard file: its samples are read on first use, and only the deflated blocks that hold wanted bits are read."""

    def __init__(self, read: Callable[[int, int], bytes], counts: tuple[int, int], blocks: list[tuple[int, int]]) -> None:
        self.read, self.counts, self.blocks = read, counts, blocks
        self.held: dict[int, np.ndarray] = {}

    @cached_property
    def samples(self) -> np.ndarray:
        ones = np.frombuffer(zlib.decompress(self.read(*self.counts)), "<u2")
        return np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])

    def block(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= 64:
                self.held.clear()
            self.held[k] = np.frombuffer(zlib.decompress(self.read(*self.blocks[k])), np.uint8)
        return self.held[k]

    def bytes(self, lo: int, hi: int) -> np.ndarray:
        parts = [self.block(k)[max(0, lo - k * BLOCK) : hi - k * BLOCK] for k in range(lo // BLOCK, min(len(self.blocks), -(-hi // BLOCK)))]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids, from the highest bit; each is ordered by the bits before it."""

    def __init__(self, n: int, planes: Sequence[Plane], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (rest & rest.dtype.type(1 << b)).astype(bool)
            planes.append(Plane(np.packbits(one, bitorder="little")))
            zeros.append(int(len(one) - np.count_nonzero(one)))
            rest = np.concatenate([rest[~one], rest[one]])
        return WaveletMatrix(len(ids), planes, zeros)

    def access(self, at: int) -> int:
        """The id at a place."""
        out = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = int(plane.bits(at, at + 1)[0]), plane.rank(at)
            at = zeros + ones if one else at - ones
            out = out << 1 | one
        return out

    def access_range(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi - 1.

        Down the planes the places stay a few runs, of which only the starts are ranked; their bits put the ids together on the way up.
        """
        runs, ways = [(lo, hi)] if lo < hi else [], []
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bits = [plane.bits(a, b) for a, b in runs]
            ones = [plane.rank(a) for a, _ in runs]
            more = [int(np.count_nonzero(x)) for x in bits]
            down = [(a - n, b - n - m) for (a, b), n, m in zip(runs, ones, more, strict=True)] + [(zeros + n, zeros + n + m) for n, m in zip(ones, more, strict=True)]
            runs = []
            for a, b in down:
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                elif a < b:
                    runs.append((a, b))
            ways.append(np.concatenate([np.zeros(0, bool), *bits]))
        out = np.zeros(hi - lo, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, one in enumerate(reversed(ways)):
            up, low = np.empty_like(out), len(one) - np.count_nonzero(one)
            up[~one] = out[:low]
            up[one] = out[low:] | out.dtype.type(1 << b)
            out = up
        return out

    def _narrow(self, token: int, end: int) -> list[tuple[int, int]]:
        """The range in which a token's first `end` places lie, after each plane."""
        lo, hi, out = 0, end, []
        for k, plane in enumerate(self.planes):
            a, b = plane.rank(lo), plane.rank(hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
            out.append((lo, hi))
        return out

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before a place."""
        if token >> len(self.planes) or not self.n:
            return 0
        lo, hi = self._narrow(token, end)[-1]
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a token; -1 if there are fewer."""
        if k >= self.rank(token, self.n):
            return -1
        at = self._narrow(token, self.n)[-1][0] + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            at = self.planes[plane].select(at - self.zeros[plane] if one else at, one)
        return at


def pack(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard file: header, document table, and of each plane the ones of every STEP bits and its blocks, all deflated one by one."""
    table = np.array([[d is not None, d or 0, n] for d, n in zip(doc_ids, lengths, strict=True)], "<i8").reshape(-1, 3)
    parts: list[bytes] = []
    at = 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        parts.append(zlib.compress(data, 1))
        at += len(parts[-1])
        return at - len(parts[-1]), len(parts[-1])

    head = {"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "table": put(table.tobytes()), "planes": []}
    for p in matrix.planes:
        head["planes"].append([put(np.diff(p.samples).astype("<u2").tobytes()), [put(p.data[k : k + BLOCK].tobytes()) for k in range(0, len(p.data), BLOCK)]])
    text = json.dumps(head).encode()
    return MAGIC + len(text).to_bytes(4, "little") + text + b"".join(parts)


class ShardFile:
    """A shard file that is read by offset: `matrix` looks tokens up in it, fetching only the blocks it needs."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        start = read(0, 12)
        if start[:8] != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(start[8:12], "little")
        head = json.loads(read(12, size))
        self.read = lambda at, n: read(12 + size + at, n)
        self.table_at = head["table"]
        self.matrix = WaveletMatrix(head["n"], [StoredPlane(self.read, counts, blocks) for counts, blocks in head["planes"]], head["zeros"])

    @staticmethod
    def of(f: pa.NativeFile) -> ShardFile:
        """Of a file that is open for random access."""

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return ShardFile(read)

    @cached_property
    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_id and number of tokens of each document."""
        table = np.frombuffer(zlib.decompress(self.read(*self.table_at)), "<i8").reshape(-1, 3)
        return [int(d) if full else None for full, d, _ in table.tolist()], table[:, 2]


def crcs(matrix: WaveletMatrix, lengths: np.ndarray, step: int) -> list[int]:
    """CRC32 of each document's ids, about `step` ids at a time."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = [0] * len(lengths)
    doc = 0
    for lo in range(0, matrix.n, step):
        ids = matrix.access_range(lo, min(lo + step, matrix.n)).astype("<u4")
        while doc < len(lengths) and bounds[doc] < lo + len(ids):
            a, b = max(lo, int(bounds[doc])), min(lo + len(ids), int(bounds[doc + 1]))
            out[doc] = zlib.crc32(ids[a - lo : b - lo], out[doc])
            if bounds[doc + 1] > lo + len(ids):
                break  # goes on in the next step
            doc += 1
    return out


class Pool:
    """Runs of ids by key: each key's place in the arrays, which grow as keys are added."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        """Empty but for the blank key, which has no ids."""
        self.slots = {"": 0}
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keys that are new, with their ids end to end and the count of each."""
        self.slots.update(zip(keys, range(len(self.slots), len(self.slots) + len(keys)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def runs(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at the given slots end to end, and the count of each."""
        n = self.size[slots]
        return self.flat[np.repeat(self.first[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class WordEncoder:
    """Ids of distinct words through the tokenizers library, many at a time, with bounded memos.

    Where the vocabulary has the pre-token pattern that PIECE stands for, words of plain Latin letters and ASCII are folded
    to lower case and cut into its pieces, and only pieces that are new go through the library; other words go through it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        folds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.cuts = splits == [PATTERN] and folds == ["NFC", "Replace", "Lowercase"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words, self.pieces = Pool(), Pool()

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: an array of ids, and where in it each word's begin and how many they are."""
        whole = np.full(len(words), not self.cuts)
        if self.cuts:
            whole |= pc.match_substring_regex(words, OTHER).to_numpy(zero_copy_only=False)
            for special in self.special:
                whole |= pc.match_substring(words, special).to_numpy(zero_copy_only=False)
        # a word of letters only is one piece; the others are cut
        folded = pc.utf8_lower(words)
        single = pc.utf8_is_alpha(folded).to_numpy(zero_copy_only=False) & ~whole
        several = ~(single | whole)
        cut = split_words(pc.replace_substring_regex(folded.filter(pa.array(several)), PIECE, r"\1 "))
        one = folded.filter(pa.array(single))
        pieces, start, n = self._known(self.pieces, [*_strings(one), *_strings(cut.vocab)], True)
        at = cut.ids + len(one)
        edges = np.concatenate([[0], np.cumsum(n[at])])
        flat = pieces[np.repeat(start[at] - edges[:-1], n[at]) + np.arange(edges[-1])]
        rest, rest_start, m = self._known(self.words, _strings(words.filter(pa.array(whole))), False)
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[single], size[single] = start[: len(one)], n[: len(one)]
        first[several], size[several] = len(pieces) + edges[cut.offsets[:-1]], np.diff(edges[cut.offsets])
        first[whole], size[whole] = len(pieces) + len(flat) + rest_start, m
        return np.concatenate([pieces, flat, rest]), first, size

    def _known(self, pool: Pool, keys: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the keys, in an array, and where in it each key's begin and how many they are."""
        if len(pool.slots) > MEMO:
            pool.clear()
        slots = np.fromiter(map(pool.slots.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(slots < 0)):
            new = new.tolist()
            fresh = list(dict.fromkeys(keys[k] for k in new))
            pool.add(fresh, *self._library(fresh, single))
            slots[new] = [pool.slots[keys[k]] for k in new]
        ids, n = pool.runs(slots)
        return ids, np.cumsum(n) - n, n

    def _library(self, texts: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without white space, and the count of each; `single`: each is one pre-token."""
        ids, sizes = [], []
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            if single:
                owner = np.array(got.word_ids, np.int64)
            else:
                starts = np.cumsum([0, *(len(w) + 1 for w in part)])
                owner = np.searchsorted(starts, [o[0] for o in got.offsets], "right") - 1
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(texts: pa.Array, words_of: WordEncoder, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with the end id, laid end to end, and the count of each."""
    words = split_words(texts)
    flat, first, size = words_of.encode(words.vocab)
    flat, first, size = np.append(flat, np.uint32(end_id)), np.append(first, len(flat)), np.append(size, 1)
    ends = words.offsets[1:] + np.arange(len(texts))
    coded = np.full(len(words.ids) + len(texts), len(words.vocab), np.int32)  # the end stands as one more word
    inside = np.ones(len(coded), bool)
    inside[ends] = False
    coded[inside] = words.ids
    n = size[coded]
    edges = np.concatenate([[0], np.cumsum(n)])
    index = np.int64 if edges[-1] >> 31 else np.int32
    out = flat[np.repeat((first[coded] - edges[:-1]).astype(index), n) + np.arange(edges[-1], dtype=index)]
    return out, np.diff(np.concatenate([[0], edges[ends + 1]]))


def write_shards(docs: DataFrame, folder: str, name: str, ranges: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards; (part, shard, name, tokens, docs) of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ranges = ranges or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = encoder(resolve(name))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, shard = task.partitionId(), 0
        ids, doc_ids, lengths = [], [], []

        def out() -> pa.RecordBatch:
            nonlocal shard
            title = f"shard-{part:06d}-{shard:04d}.wm"
            scratch = f"{base}/_attempt-{task.taskAttemptId()}-{title}"
            flat = np.concatenate(ids)
            with store.open_output_stream(scratch, compression=None) as f:
                f.write(pack(WaveletMatrix.build(flat), doc_ids, lengths))
            put(store, scratch, f"{base}/{title}")  # a task that runs again replaces what it has left
            row = [part, shard, title, len(flat), len(doc_ids)]
            shard += 1
            for x in (ids, doc_ids, lengths):
                x.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "shard", "name", "tokens", "docs"])

        for batch in batches:
            for start, texts in text_slices(batch.column("text"), 2 << 20):
                flat, n = encode_texts(texts, words_of)
                ids.append(flat)
                doc_ids.extend(batch.column("doc_id").slice(start, len(texts)).to_pylist())
                lengths.extend(n.tolist())
                if sum(map(len, ids)) >= shard_tokens:
                    yield out()
        if doc_ids:
            yield out()

    dealt = rows.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return dealt.mapInArrow(run, "part long, shard long, name string, tokens long, docs long")


def with_starts(shards: DataFrame, group: int = RANGE_GROUP) -> DataFrame:
    """Shards with `start`, the tokens of all shards before: running sums within a group of parts, on top of the groups' sums (one number for `group` tasks)."""
    grouped = shards.withColumn("group", F.floor(F.col("part") / group))
    sums = sorted(grouped.groupBy("group").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r.group)
    before = np.cumsum([0, *(r.n for r in sums)]).tolist()
    base = shards.sparkSession.createDataFrame([(r.group, b) for r, b in zip(sums, before, strict=False)], "group long, base long")
    own = Window.partitionBy("group").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(base, "group").select("name", (F.col("base") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).alias("start"))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, looked up in the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for title, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{title}") as f:
                    shard = ShardFile.of(f)
                    doc_ids, lengths = shard.documents
                    crc = crcs(shard.matrix, lengths, SHARD_TOKENS + SHARD_TOKENS // 2)
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_round_trip(docs: DataFrame, name: str = "word_bpe_49k.json", ranges: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, write shards in doc_id order, and read the documents back from them."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    shards = materialize(write_shards(docs, folder, name, ranges, shard_tokens), "shards")
    started = materialize(with_starts(shards), "shard-starts")
    return read_shards(started.repartition(max(1, started.count()), "name"), folder)
