"""BPE encoding and decoding as streaming transducers.

Encoding. The BPE tokens of a text's prefix are fixed by the last token of each prefix: the one token
that ends there and is compatible with the last token before it (their merges would not cross the
boundary). So one pass from left to right carries the last tokens of the latest positions.
A boundary is stable, and all tokens up to it are emitted, once every position from which a token can still grow
leads back to it. How far a decision can depend on what follows is bounded by the merge list alone:
`sufficient_lookahead` computes the bound, a loose one; held-back bytes are checked against it, and in practice are a few tokens.
Pre-tokens of up to PART bytes, nearly all, are read at once; only longer ones arrive in parts, each byte of which is read a bounded number of times.

Decoding. Ids become bytes, and an incremental state machine turns bytes into text, holding at most an
unfinished character; ill-formed bytes become U+FFFD as they do in the tokenizers library.

Merges happen within pre-tokens, so distinct pre-tokens are encoded once and kept in a bounded memo.

Defined results: null and empty texts have no ids and decode to the empty text. Special tokens that stand in a text
are matched first, as the library does. Rows are handled one by one, so repeats are alike; extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space. A space goes with the run of other characters after it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries of the memos of pre-tokens and of units (runs of them without white space between); a full memo is emptied.
MEMO, UNIT_MEMO = 200_000, 150_000
#: A pre-token longer than this is fed to the transducer in parts.
PART = 512
#: Pre-tokens up to SHORT bytes are read in step, TOGETHER at a time; longer ones one by one.
SHORT, TOGETHER = 48, 20_000
START = -1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class IntMap:
    """Numbers from non-negative integer keys to integers, looked up by whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys = np.full((1 << (64 - int(self.shift))) + 64, -1, np.int64)
        self.values = np.zeros(len(self.keys), np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            new = np.flatnonzero(free)[first]
            self.keys[slot[new]], self.values[slot[new]] = keys[left[new]], values[left[new]]
            rest = np.ones(len(left), bool)
            rest[new] = False
            left, slot = left[rest], slot[rest] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not there."""
        slot = self._slot(keys)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], slot[on] + 1
        return out


class Tokenizer:
    """A byte-level BPE vocabulary: its merge list as tables, and both transducers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            if made in self.born:
                raise ValueError(f"two merges make token {made}")
            self.rank[vocab[a], vocab[b]] = self.born[made] = k
            self.parts[made] = (vocab[a], vocab[b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.longest = max(len(self.bytes_of[i]) for i in vocab.values())
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [START]
        for t, i in vocab.items():
            node = 0
            for b in raw(t):
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(self.token_at)
                    self.token_at.append(START)
                node = self.trie[key]
            self.token_at[node] = i
        arrays = lambda d: (np.array(list(d), np.int64), np.array(list(d.values()), np.int64))
        self.trie_map = IntMap(*arrays(self.trie))
        self.token_of = np.array(self.token_at, np.int64)
        pair, rank = arrays(self.rank)
        self.rank_map = IntMap(pair[:, 0] << 20 | pair[:, 1], rank)
        self.born_of, self.left_of, self.right_of = (np.full(max(self.bytes_of) + 1, -1, np.int64) for _ in range(3))
        for token, (a, b) in self.parts.items():
            self.born_of[token], self.left_of[token], self.right_of[token] = self.born[token], a, b
        self.held = 0  # bytes that `stream` held back last
        self.memo: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        size = max(self.bytes_of) + 1
        flat = [self.bytes_of.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.size = np.array([len(b) for b in flat], np.int64)
        self.first = np.cumsum(self.size) - self.size

    @property
    def sufficient_lookahead(self) -> int:
        """Bytes after a boundary that can influence it: each merge can reach at most one longest token further. `stream` never holds back more."""
        return len(self.rank) * self.longest

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is how their bytes are merged.

        Merges are undone from the latest back; the parts that then touch the boundary must not
        have a merge that comes before the one that took either of them away.
        """
        rank, born, parts = self.rank, self.born, self.parts
        left = right = 1 << 60  # ranks of the merges that consume the part at the boundary
        while True:
            across = rank.get((a, b))
            if across is not None and across < left and across <= right:
                return False
            x, y = born.get(a, -1), born.get(b, -1)
            if x > y:
                left, a = x, parts[a][1]
            elif y >= 0:
                right, b = y, parts[b][0]
            else:
                return True

    def last_tokens(self, data: bytes, known: list[int]) -> list[int]:
        """The last token of each prefix of data. `known`: those of the first prefixes, at least the token before the data."""
        n = len(data)
        last = known + [START] * (n + 1 - len(known))
        trie, token_at, compatible = self.trie, self.token_at, self.compatible
        for j in range(max(0, len(known) - self.longest), n):  # tokens that start earlier end within what is known
            node, here = 0, last[j]
            for k in range(j, n):
                node = trie.get(node << 8 | data[k])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0 and last[k + 1] < 0 and (here < 0 or compatible(here, token)):
                    last[k + 1] = token
        return last

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks; each is emitted as soon as it is stable."""
        held, last = b"", [START]
        for chunk in chunks:
            if len(held) > self.sufficient_lookahead:
                raise AssertionError("more is held back than the merge list needs")
            held += chunk
            last = self.last_tokens(held, last)
            # A token that is still to end starts in the last `longest` bytes; where all their paths meet is stable.
            open_ = set(range(max(0, len(held) - self.longest + 1), len(held) + 1))
            while len(open_) > 1:
                far = max(open_)
                open_.discard(far)
                open_.add(far - len(self.bytes_of[last[far]]) if far else 0)
            stable = open_.pop()
            yield from self._back(last, stable)
            held, last = held[stable:], last[stable:]
            self.held = len(held)
        yield from self._back(last, len(held))

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) > PART:
            return list(self.stream(data[k : k + PART] for k in range(0, len(data), PART)))
        return self._back(self.last_tokens(data, [START]), len(data))

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs."""
        out = np.zeros(len(a), bool)
        at = np.arange(len(a))
        left = right = np.full(len(a), 1 << 60)
        while len(at):
            across = self.rank_map.get(a << 20 | b)
            x, y = self.born_of[a], self.born_of[b]
            on = ~((across >= 0) & (across < left) & (across <= right))
            done = on & (x < 0) & (y < 0)
            out[at[done]] = True
            on &= ~done
            at, a, b, x, y, left, right = (v[on] for v in (at, a, b, x, y, left, right))
            undo = x > y
            left, a = np.where(undo, x, left), np.where(undo, self.right_of[a], a)
            right, b = np.where(undo, right, y), np.where(undo, b, self.left_of[b])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, read in step: the same pass as `last_tokens`, a position of all at a time."""
        size = np.array([len(p) for p in pieces], np.int64)
        width = int(size.max())
        data = np.zeros((len(pieces), width), np.int64)
        inside = np.arange(width) < size[:, None]
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full((len(pieces), width + 1), START, np.int64)
        for j in range(width):
            row = np.flatnonzero(size > j)
            node = np.zeros(len(row), np.int64)
            found = []
            for k in range(j, min(width, j + self.longest)):
                node = self.trie_map.get(node << 8 | data[row, k])
                on = node >= 0
                row, node = row[on], node[on]
                token = self.token_of[node]
                new = (token >= 0) & (last[row, k + 1] < 0)
                found.append((row[new], np.full(new.sum(), k + 1), token[new]))
                on = size[row] > k + 1
                row, node = row[on], node[on]
                if not len(row):
                    break
            rows, end, token = (np.concatenate(v) for v in zip(*found, strict=True))
            if j:
                good = self.compatible_all(last[rows, j], token)
                rows, end, token = rows[good], end[good], token[good]
            last[rows, end] = token
        steps, row, end = [], np.arange(len(pieces)), size.copy()
        count = np.zeros(len(pieces), np.int64)
        while len(row):
            token = last[row, end]
            steps.append((row, token))
            count[row] += 1
            end = end - self.size[token]
            row, end = row[end > 0], end[end > 0]
        flat, bounds = np.zeros(count.sum(), "<u4"), np.cumsum(count)
        for k, (row, token) in enumerate(steps):
            flat[bounds[row] - 1 - k] = token
        packed, edge = flat.tobytes(), (4 * np.concatenate([[0], bounds])).tolist()
        return [packed[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. A pre-token never spans two units, so each distinct unit is encoded once."""
        split = [self.splitter.split(t) if self.splitter else [t] for t in texts]
        found = [[UNIT.findall(p) if not k % 2 else p for k, p in enumerate(parts)] for parts in split]
        if len(self.units) > UNIT_MEMO:
            self.units.clear()
        units = self.units
        self._learn({u for parts in found for p in parts[::2] for u in p if u not in units})
        pack = lambda k, p: b"".join([units[u] for u in p]) if not k % 2 else self.special[p].to_bytes(4, "little")
        return [b"".join([pack(k, p) for k, p in enumerate(parts)]) for parts in found]

    def _learn(self, new: set[str]) -> None:
        """Encode units that are not known yet."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        pieces = {u: self.pattern.findall(u) for u in new}
        fresh = [(p, p.encode()) for p in {p for ps in pieces.values() for p in ps if p not in memo}]
        fresh.sort(key=lambda x: len(x[1]))
        short = [x for x in fresh if len(x[1]) <= SHORT]
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            memo.update(zip((p for p, _ in part), self.encode_pieces([b for _, b in part]), strict=True))
        for piece, data in fresh[len(short) :]:
            memo[piece] = np.array(self.encode_piece(data), "<u4").tobytes()
        for u, ps in pieces.items():
            self.units[u] = memo[ps[0]] if len(ps) == 1 else b"".join([memo[p] for p in ps])

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text parts, each as soon as its bytes are complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.bytes_of[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part

    def decode_all(self, ids: bytes, block: int = 1 << 16) -> str:
        """Text of packed ids, a block of ids at a time through the same state machine."""
        machine, numbers = codecs.getincrementaldecoder("utf-8")("replace"), np.frombuffer(ids, "<u4")
        parts = []
        for k in range(0, len(numbers), block):
            part = numbers[k : k + block]
            n = self.size[part]
            at = np.repeat(self.first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts.append(machine.decode(self.flat[at].tobytes()))
        return "".join([*parts, machine.decode(b"", True)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each path and process."""
    return Tokenizer(path)


def resolve(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text for every document; `ids` too if wanted."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(resolve(name))
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                packed = bpe.encode_texts(texts.to_pylist())
                n = [len(ids) // 4 for ids in packed]
                digest = [hashlib.sha256(ids).hexdigest() for ids in packed]
                back = [hashlib.sha256(bpe.decode_all(ids).encode()).hexdigest() for ids in packed]
                kept = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in packed] if with_ids else []
                doc_id = batch.column("doc_id").slice(start, len(texts))
                arrays = [doc_id, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
