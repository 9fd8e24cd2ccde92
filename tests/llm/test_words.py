"""Spelling variants, fill-in-middle and MinHash near-dedup against plain restatements."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fim, minhash, queries, variants

from ..oracle import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_fill_in_middle", "op13_minhash_near_dedup"])
def test_query_equals_its_sql(spark, sf, con, name):
    assert difference(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name]) is None


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = vocabulary(rows)
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def variant_rows():
    say = lambda **k: " ".join(w for w, n in k.items() for _ in range(n))
    # a chain of three steps, ties of forms, repeated letters, letters outside ASCII
    text = say(committee=3000, comittee=300, comitte=30, commitee=3, vocabulary=50, vocabulery=5, vocabulory=5, vocbulary=2, aaaaaaa=20, aaaaaaaa=2, aaaaaab=2)
    text += " ÉCOLIERS éCOLIERS Écoliers" * 5 + " café×÷ñandúes" * 2 + " " + "x1".join(["abcdefgh"] * 3)
    many = [(k, "occurrence " * 4 + "ocurrence " * (k == 3)) for k in range(40)]
    return [(None, "nothing nothing"), (1, text), (1, text), (2, None), (3, ""), *many]


@pytest.mark.parametrize("odd", [False, True])
def test_variants_against_all_pairs(spark, raw, odd):
    rows = variant_rows() if odd else [(r[0], r[1]) for r in raw][:60]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    assert rows_of(variants.variants(docs)) == plain_variants(rows)


def test_variants_of_the_table(docs, raw, empty):
    got = variants.variants(docs)
    words = vocabulary((r[0], r[1]) for r in raw)
    assert {r.word: r.n for r in got.collect()} == words
    assert variants.variants(empty).count() == 0


def test_variants_of_very_long_runs(spark):
    """Runs longer than spelled keys, around that length too, with all kinds of edits."""
    rng = np.random.default_rng(1)
    rows = []
    for size in (63, 64, 65, 66, 300, 20_000):
        word = "".join(rng.choice(list("abcdé"), size))
        edits = [word[:-1], word[:9] + word[10:], word[:5] + "z" + word[5:], "q" + word[1:], word[:-1] + "y", word[:-1] + "w"]
        rows += [(k, f"{word} " * (12 if size < 20_000 else 2) + " ".join(edits * 2)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(variants.variants(docs)) == plain_variants(rows)


def test_variant_keys_take_linear_space():
    assert sum(len(k) for _, k in variants.keys("abcdefghij" * 5000)) < 50_000 * 2 * 90


def test_runs_are_never_cut():
    text = "ab cdé 12 x" * 500 + "y" * 3000 + "-" + "z" * 10
    for part in (1, 7, 100, 4096):
        assert [r for found in variants.runs(text, part) for r in found] == re.findall("[A-Za-zÀ-ÿ]+", text)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), digest(out), digest(text)


def test_fim_against_a_plain_restatement(spark, docs, raw, empty):
    assert rows_of(fim.report(docs)) == Counter(plain_fim(r[0], r[1]) for r in raw)
    odd = ["\n", "\n\n", "a", "a\nb", "no <P> here\nx", "<", "<S\n>", "a<P\n<M\n<S", " é\r\n\U0001f600\n" * 300, "x\n" * 500, "\x00\n" * 70, None, ""]
    rows = [(k, t) for k in range(6) for t in odd] + [(None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    some = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, output string, form long").repartition(3)
    assert rows_of(fim.report(some)) == Counter(plain_fim(*r) for r in rows)
    assert fim.report(empty).count() == 0


@pytest.mark.parametrize(("every", "block"), [(1, 1), (3, 5), (64, 7), (64, 1 << 16)])
def test_checkpoints_find_every_unit(every, block):
    text = "é\n\n\U0001f600 abc\nxyz\r\n" * 90 + "end"
    for t in (text, text + "\n", "", "\n", "a"):
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        index = fim.Checkpoints(t.encode(), every, block)
        assert (index.n, index.chars) == (len(units), len(t)) and len(index.units) <= len(units) // every + 1
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.at(u) == (len(before.encode()), len(before))


def shingles(text):
    w = WORD.findall(fold(text))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def plain_groups(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        if s:
            by[s].append(k)
    label = {s: k for k, s in enumerate(by)}
    kinds = list(by)
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if label[a] != label[b] and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                old, new = label[a], label[b]
                label = {s: new if v == old else v for s, v in label.items()}
    out = Counter()
    for k, (doc_id, _) in enumerate(rows):
        ids = [doc_id] if not sets[k] else [rows[j][0] for s in kinds if label[s] == label[sets[k]] for j in by[s]]
        least = min((i for i in ids if i is not None), default=None)
        out[doc_id, len(sets[k]), least, doc_id == least if doc_id is not None and least is not None else least is None] += 1
    return out


def near_copies(seed, copies, size, edits, vocab=400):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in rng.integers(0, vocab, size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            words[at] = f"e{rng.integers(0, 10**9)}"
        out.append(" ".join(words))
    return out


def test_minhash_on_the_table(docs, raw, empty):
    assert rows_of(minhash.near_duplicates(docs)) == plain_groups([(r[0], r[1]) for r in raw])
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("block", "rounds"), [(512, 6), (8, 0), (8, 2)])
def test_minhash_links_in_dense_groups(spark, block, rounds):
    """Groups whose pairs lie on both sides of the bound, by stars, by blocks and by both."""
    texts = [*near_copies(1, 60, 120, 5), *near_copies(2, 40, 40, 2), *near_copies(3, 50, 300, 16), *near_copies(4, 8, 7, 1), "a b", "a b", "A  B", "a", "", None, "   ", "one two three", "one two three four"]
    rows = [(None if k % 17 == 3 else 1000 - k, t) for k, t in enumerate(texts)] + [(None, "alone and without an id"), (999, texts[5])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row long, digest string").repartition(3)
    assert rows_of(minhash.near_duplicates(docs, block=block, rounds=rounds)) == plain_groups(rows)


@pytest.mark.parametrize("few", [0, minhash.FEW])
def test_minhash_compares_at_once_when_few_pairs_are_left(spark, monkeypatch, few):
    """Either way all links are found; where few pairs are left, one round and one comparison of all are enough."""
    turns, left = [], minhash.lists_left
    monkeypatch.setattr(minhash, "lists_left", lambda rows: (turns.append(1), left(rows))[1])
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(30):
        base = [f"w{k}" for k in rng.integers(5000, size=60)]
        for _ in range(6):  # each near to the one before, and less so to those before that
            base = list(base)
            base[int(rng.integers(60))] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(base))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = minhash.sketches(docs)
    nodes = minhash.materialize(own.select(F.col("doc_id").alias("node"), "digest", F.col("n_shingles").alias("n"), "short", "tokens"), "test-nodes")
    named = dict(minhash.links(docs, nodes, few=few).collect())
    expected = {i: c for (i, _, c, _) in plain_groups(rows)}
    assert {k: named.get(k, k) for k in expected} == expected
    assert len(turns) == 1 if few else len(turns) > 1


def test_minhash_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    values, offsets = [], [0]
    for _ in range(200):
        core = rng.integers(0, 1 << 63, 170).astype(np.uint64)
        for _ in range(2):  # 170 of 170 + 2 * 15 in common: 0.85
            values.append(np.sort(np.concatenate([core, rng.integers(0, 1 << 63, 15).astype(np.uint64)])))
            offsets.append(offsets[-1] + 185)
    tokens = minhash.signatures(np.concatenate(values), np.array(offsets))
    same = (tokens[::2] == tokens[1::2]).sum(axis=1)
    assert abs(same.mean() - 0.85 * minhash.COORDINATES) < 1 and same.min() > minhash.MATCHES
    assert not (tokens[:-2:2] == tokens[2::2]).any()


def test_minhash_lists_hold_near_documents_and_not_those_that_share_passages(spark):
    """Of sets with a third in common, hardly any are posted; all of those with 85 % are, and together."""
    rng = np.random.default_rng(4)
    passage, values, offsets = rng.integers(0, 1 << 63, 100).astype(np.uint64), [], [0]
    for core in [passage] * 60 + [c for _ in range(30) for c in [rng.integers(0, 1 << 63, 170).astype(np.uint64)] * 2]:
        values.append(np.sort(np.concatenate([core, rng.integers(0, 1 << 63, 200 - len(core) - 15 * (len(core) > 100)).astype(np.uint64)])))
        offsets.append(offsets[-1] + len(values[-1]))
    tokens = minhash.bands(minhash.signatures(np.concatenate(values), np.array(offsets)))
    nodes = spark.createDataFrame([(k, t) for k, t in enumerate(tokens.view(np.int64).tolist())], "node long, tokens array<long>")
    rows = minhash.postings(nodes).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.token, set()).add(r.node)
    assert all(any({k, k + 1} <= x for x in lists.values()) for k in range(60, 120, 2))
    assert sum(r.node < 60 for r in rows) < 60 * 12  # of 24 tokens; those under single coordinates are nearly all held by others


def test_parity_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for size in (5, 200, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 7 :], rng.integers(0, 1 << 63, size // 5).astype(np.uint64)]))
        odd = [np.frombuffer(minhash.parity_sketch(x), np.uint8)[None] for x in (a, b)]
        assert minhash._differing(*odd)[0] <= len(np.setxor1d(a, b))
