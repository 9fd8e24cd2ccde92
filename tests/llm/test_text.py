"""Operators on texts against plain restatements, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, dsir, kneser_ney, lm, quality, toxicity, wavelet
from tessella.llm.common import split_words, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_words_are_those_of_the_pattern(raw):
    texts = [r[1] for r in raw]
    for _, part in text_slices(pa.array(texts), 50_000):
        words = split_words(part, lower=True)
        vocab = words.vocab.to_pylist()
        for k, text in enumerate(part.to_pylist()):
            assert [vocab[i] for i in words.ids[words.offsets[k] : words.offsets[k + 1]]] == WORD.findall(fold(text))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    mark = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(mark)


def test_quality_base_columns_and_verdicts(docs, raw, empty):
    got = quality.quality_report(docs).collect()
    assert len(got) == len(raw)
    expected = Counter((r[0], *base(r[1])) for r in raw)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = rows_of(quality.filter_documents(docs).select("doc_id", "text", "row"))
    assert sum(kept.values()) == sum(r.kept for r in got)
    assert set(quality.filter_documents(docs).columns) == set(docs.columns)
    assert quality.quality_report(empty).count() == 0 and quality.filter_documents(empty).count() == 0


def test_quality_rejects_symbol_noise_and_keeps_prose(spark, docs):
    rng = np.random.default_rng(0)
    good = [(r.text, r.lang) for r in docs.where("doc_id < 200").select("text", "lang").collect() if r.text.count("&") + r.text.count("#") + r.text.count("|") == 0 and len(r.text) > 1500][:5]
    noise = [" ".join("".join(rng.choice(list("#*$%&|<>@"), 6)) + str(k) for k in range(90)) for _ in range(5)]
    extra = spark.createDataFrame([(20_000 + k, t, lang) for k, (t, lang) in enumerate([*good, *((t, "en") for t in noise)])], "doc_id long, text string, lang string")
    got = quality.quality_report(docs.select("doc_id", "text", "lang").unionByName(extra)).where("doc_id >= 20000").orderBy("doc_id").collect()
    base_ok = [r for r in got[:5] if not r.base_failed]
    assert base_ok and all(r.kept for r in base_ok)
    assert not any(r.kept for r in got[5:])


def test_quality_rejects_a_text_under_another_languages_label(spark, docs):
    """A German and a Spanish text among English ones are as unlikely there as noise, and so is an English one among German ones."""
    texts = {lang: docs.where(f"doc_id < 200 AND lang = '{lang}' AND length(text) > 1500").where("NOT text RLIKE '[#*$%&|<>]'").orderBy("doc_id").first().text for lang in ("en", "de", "es")}
    wrong = [("de", "en"), ("es", "en"), ("en", "de")]
    extra = spark.createDataFrame([(20_000 + k, texts[own], label) for k, (own, label) in enumerate(wrong)], "doc_id long, text string, lang string")
    got = quality.quality_report(docs.select("doc_id", "text", "lang").unionByName(extra)).where("doc_id >= 20000").collect()
    assert len(got) == 3 and not any(r.base_failed or r.kept for r in got)


def plain_perplexities(raw):
    """Language group and mean negative log10 probability of each text's characters, from dictionaries of class n-grams, by the definition of the model."""
    classes = lambda t: [0, 0, 0, *(quality.character_class(ord(c)) for c in t or "")]
    times = Counter(r[2] for r in raw)
    group = lambda r: r[2] if r[2] and times[r[2]] >= max(quality.MIN_DOCS, quality.MIN_SHARE * len(raw)) else None
    fold = lambda r: zlib.crc32((r[1] or "").encode()) % 2
    counts = {(group(r), f): Counter() for r in raw for f in (0, 1)}
    for r in raw:
        n, chars, symbols, _, repeated = base(r[1])
        if n >= 50 and 100 * repeated <= 50 * n and 100 * symbols <= chars:
            c = classes(r[1])
            counts[group(r), fold(r)].update(tuple(c[k : k + 4]) for k in range(len(c) - 3))

    def model(table):
        levels = {4: table}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        stats = {}
        for k, level in levels.items():
            d = kneser_ney.discounts(*(sum(1 for n in level.values() if n == j) for j in (1, 2, 3, 4)))
            whole, freed = Counter(), Counter()
            for g, n in level.items():
                whole[g[:-1]] += n
                freed[g[:-1]] += d[min(n, 3)]
            stats[k] = level, d, whole, freed

        def p(gram):
            if not gram:
                return 1 / 64
            level, d, whole, freed = stats[len(gram)]
            n, ctx = level.get(gram, 0), gram[:-1]
            return (n - d[min(n, 3)]) / whole[ctx] + freed[ctx] / whole[ctx] * p(gram[1:]) if whole[ctx] else p(gram[1:])

        return lru_cache(None)(p)

    models, out = {g: model(c) for g, c in counts.items()}, []
    for r in raw:
        c = classes(r[1])
        other = models[group(r), 1 - fold(r)]
        out.append(-sum(math.log10(other(tuple(c[k : k + 4]))) for k in range(len(c) - 3)) / (len(c) - 3) if r[1] else None)
    return [group(r) for r in raw], out


def test_quality_perplexity_and_bands_by_definition(docs, raw):
    got = Counter((r.doc_id, r.kept, None if r.neg_log10_char is None else round(r.neg_log10_char, 6)) for r in quality.quality_report(docs).collect())
    group, scores = plain_perplexities(raw)
    failed = [n < 50 or 100 * repeated > 50 * n for n, _, _, _, repeated in (base(r[1]) for r in raw)]
    limits = {}
    for g in set(group):
        if own := sorted(s for s, f, x in zip(scores, failed, group, strict=True) if x == g and not f):
            low, mid, high = (own[max(0, math.ceil(q * len(own)) - 1)] for q in (0.25, 0.5, 0.75))
            limits[g] = low - max(8 * (mid - low), 0.1), high + max(8 * (high - mid), 0.3)
    expected = Counter()
    for r, s, f, g in zip(raw, scores, failed, group, strict=True):
        expected[r[0], bool(not f and s is not None and limits[g][0] <= s <= limits[g][1]), None if s is None else round(s, 6)] += 1
    near = lambda c: sorted((str(i), k, -1 if s is None else round(s, 4)) for (i, k, s), n in c.items() for _ in range(n))
    assert near(got) == near(expected)


def test_quality_lower_band_rejects_word_salad(spark, docs):
    rng = np.random.default_rng(1)
    salad = [" ".join("the" * k for k in rng.integers(1, 13, 90)) for _ in range(4)]
    extra = spark.createDataFrame([(20_000 + k, t, "en") for k, t in enumerate(salad)], "doc_id long, text string, lang string")
    got = quality.quality_report(docs.select("doc_id", "text", "lang").unionByName(extra))
    found = got.where("doc_id >= 20000").collect()
    typical = got.where("doc_id < 9000 and lang_group = 'en' and kept").agg({"neg_log10_char": "min"}).first()[0]
    assert not any(r.base_failed for r in found)
    assert all(r.neg_log10_char < typical - 0.1 for r in found) and not any(r.kept for r in found)


def test_quality_judges_every_script_by_its_own_language(spark):
    """Prose of made-up Cyrillic and Han languages is kept, the same characters in random order are not; languages in passes give the same rows."""
    rng = np.random.default_rng(5)
    rows, salads = [], []
    for lang, first, size in (("ru", 0x430, 32), ("zh", 0x4E00, 300), ("ru-small", 0x430, 32)):
        vocab = ["".join(chr(first + k) for k in rng.integers(0, size, rng.integers(2, 7))) for _ in range(150)]
        for k in range(80 if lang != "ru-small" else 3):
            rows.append((len(rows), " ".join(vocab[i] for i in rng.integers(0, 150, 120)), lang))
        if lang != "ru-small":
            shuffled = ["".join(rng.permutation(list(rows[-1 - k][1].replace(" ", "")))) for k in range(3)]
            salads += [(10_000 + len(salads) + k, " ".join(t[i : i + 5] for i in range(0, len(t), 5)), lang) for k, t in enumerate(shuffled)]
    docs = spark.createDataFrame(rows + salads, "doc_id long, text string, lang string")
    report = quality.quality_report(docs)
    got = {r.doc_id: r for r in report.collect()}
    assert all(got[i].kept and got[i].lang_group == (lang if lang != "ru-small" else None) for i, _, lang in rows)
    assert not any(got[i].kept or got[i].base_failed for i, _, _ in salads)
    again = {r.doc_id: r for r in quality.quality_report(docs, limit=1).collect()}
    assert all(again[i].kept == r.kept and math.isclose(again[i].neg_log10_char, r.neg_log10_char, rel_tol=1e-9) for i, r in got.items())
    assert rows_of(quality.filter_documents(docs, limit=1)) == Counter(rows)


def test_quality_counts_whole_code_points(spark):
    """The same prose with each Han letter 34 code points further on is another text: it is as unlikely as noise, sent or joined."""
    rng = np.random.default_rng(6)
    vocab = ["".join(chr(0x4E00 + k) for k in rng.integers(0, 34, rng.integers(2, 6))) for _ in range(150)]
    rows = [(k, " ".join(vocab[i] for i in rng.integers(0, 150, 120)), "zh") for k in range(80)]
    moved = [(1000 + k, re.sub("[^ ]", lambda m: chr(ord(m[0]) + 34), rows[k][1]), "zh") for k in range(3)]
    docs = spark.createDataFrame(rows + moved, "doc_id long, text string, lang string")
    for limit in (quality.MODEL_GRAMS, 1):
        got = {r.doc_id: r for r in quality.quality_report(docs, limit=limit).collect()}
        assert all(got[i].kept for i, *_ in rows) and not any(got[i].kept or got[i].base_failed for i, *_ in moved)


def test_quality_grams_of_any_alphabet():
    """More code points than a packed number takes are dealt with in halves; 4-grams do not reach into another text."""
    rng = np.random.default_rng(7)
    texts = ["aB \tc", "", *("".join(map(chr, rng.integers(0x10000, 0x30000, 30_000))) for _ in range(2)), "x"]
    owners, got = np.array([5, 9, 1000, 3, 2]), []
    for at, packed, alphabet, offsets, bits in quality.grams(pa.array(texts), owners):
        assert at == len(got) and offsets.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
        got += zip(*(c.tolist() for c in quality.unpacked(packed, alphabet, bits)), strict=True)
    expected = []
    for owner, text in zip(owners.tolist(), texts, strict=True):
        c = [0, 0, 0, *(quality.character_class(ord(x)) for x in text)]
        expected += [(owner, c[k] << 21 | c[k + 1], c[k + 2] << 21 | c[k + 3]) for k in range(len(text))]
    assert got == expected


def test_quality_code_points_are_those_of_the_text():
    texts = ["", "plain", "née Ωmega Ж 漢字 \U0001f600", "é", ""]
    codes, offsets = quality.code_points(pa.array(texts))
    assert codes.tolist() == [ord(c) for t in texts for c in t] and offsets.tolist() == np.cumsum([0, *map(len, texts)]).tolist()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    codes, counts = np.unique(rng.integers(0, 1 << 8, 4000) & rng.integers(0, 1 << 8, 4000), return_counts=True)
    model = kneser_ney.fit_kneser_ney(codes, counts, 4, 2)
    for ctx in range(1 << 6):
        assert abs(sum(10 ** model.score(ctx << 2 | np.arange(4))) - 1) < 1e-9
    assert np.allclose(kneser_ney.fit_kneser_ney(codes[:0], counts[:0], 4, 2).score(np.arange(4)), math.log10(0.25))


def test_lm_base_and_model(docs, raw, empty):
    tokens = [(r[0], WORD.findall(fold(r[1])) + ["\n"]) for r in raw]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((i is None, i or 0, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens)
    got = lm.score_documents(docs).collect()
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(expected, mine, strict=True):
        assert a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_documents(empty).count() == 0


def test_lm_automaton_sums_to_one_in_every_state():
    own = np.array([0.3, 0.2, 0.1, 0.35, 1.0, 0.05])  # three common words, the others' sum, the start, the end
    pairs = {(0, 1): 5, (0, 3): 4, (0, 5): 1, (4, 0): 3, (4, 3): 2, (1, 1): 2}
    triples = {(0, 1, 0): 2, (0, 1, 3): 1, (4, 0, 1): 3}
    a = lm.build_automaton(["a", "b", "c"], own, pairs, triples)
    for state in range(len(a.fail)):
        total = 0.0
        for symbol in (0, 1, 2, 3, 5):
            at, logp = state, 0.0
            while at:
                k = np.searchsorted(a.arcs, at * a.symbols + symbol)
                if k < len(a.arcs) and a.arcs[k] == at * a.symbols + symbol:
                    logp += a.logp[k]
                    break
                logp, at = logp + a.weight[at], a.fail[at]
            total += 10 ** (logp + (0 if at else math.log10(own[symbol])))
        assert abs(total - 1) < 1e-9


def test_lm_learns_pairs_and_triples_of_rare_words(spark, monkeypatch):
    """All scores are those of the whole automaton, however rare the words and whatever the chunks and ranges."""
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(3000)]
    texts = [" ".join(vocab[i] for i in rng.zipf(1.3, 40) % 3000) for _ in range(60)] + ["rare1 rare2 rare3 rare4"] * 3 + ["", "w1", None]
    ids = list(range(len(texts)))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    tokens = [(t or "").split() for t in texts]
    heads = sorted({w for ws, h in zip(tokens, held, strict=True) if not h for w in ws})
    s, number = len(heads) + 3, {w: k for k, w in enumerate(heads)}
    coded = [[number.get(w, s - 3) for w in ws] + [s - 1] for ws in tokens]
    train = [c for c, h in zip(coded, held, strict=True) if not h]
    ones = Counter(x for c in train for x in c)
    pairs = Counter(p for c in train for p in zip([s - 2, *c], c, strict=False))
    triples = Counter(p for c in train for p in zip([s - 2, *c], c, c[1:], strict=False))
    n, words = sum(ones.values()), [ones[k] for k in range(s - 3)]
    d = kneser_ney.discounts(*(words.count(k) for k in (1, 2, 3, 4)))
    own = np.array([(c - d[min(c, 3)]) / n for c in words] + [sum(d[min(c, 3)] for c in words) / n, 1.0, len(train) / n])
    whole = lm.build_automaton(heads, own, pairs, triples)
    flat = np.concatenate(coded)
    expected = whole.read(flat, np.log10(own)[flat], np.concatenate([[0], np.cumsum([len(c) for c in coded])]))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    for size in (lm.RANGE, 500):
        monkeypatch.setattr(lm, "RANGE", size)
        got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
        assert np.allclose([got[i] for i in ids], expected, rtol=1e-9)


@pytest.mark.parametrize("piece", [1, 2, 3, 50, 4000])
def test_lm_pieces_of_a_text_come_to_the_states_of_the_whole(monkeypatch, piece):
    """Read in pieces or at once, a text's score is that of a walk through the automaton, symbol by symbol."""
    rng = np.random.default_rng(piece)
    own = np.array([0.3, 0.2, 0.1, 0.05, 0.3, 1.0, 0.05])  # four words, the others' sum, the start, the end
    learnt = [[5, *rng.integers(0, 5, 30).tolist(), 6] for _ in range(6)]
    pairs, triples = (Counter(p for c in learnt for p in zip(*(c[k:] for k in range(n)), strict=False)) for n in (2, 3))
    a = lm.build_automaton(list("abcd"), own, {p: n for p, n in pairs.items() if n > 1}, {t: n for t, n in triples.items() if n > 1})
    texts = [rng.integers(0, 5, n).tolist() + [6] for n in (0, 1, 2, 49, 50, 51, 700)]
    expected = []
    for text in texts:
        state, total = a.start, 0.0
        for symbol in text:
            while state and state * a.symbols + symbol not in a.arcs:
                total, state = total + a.weight[state], a.fail[state]
            if state:
                arc = np.searchsorted(a.arcs, state * a.symbols + symbol)
                total, state = total + a.logp[arc], a.target[arc]
            else:
                total, state = total + math.log10(own[symbol]), a.root_target[symbol]
        expected.append(total)
    monkeypatch.setattr(lm, "PIECE", piece)
    flat = np.concatenate([np.array(x) for x in texts])
    assert np.allclose(a.read(flat, np.log10(own)[flat], np.concatenate([[0], np.cumsum([len(x) for x in texts])])), expected, rtol=1e-12)
    assert not len(a.read(flat[:0], own[:0], np.zeros(1, np.int64)))


@pytest.fixture(scope="module")
def byte_level():
    path = bpe.resolve("byte_bpe_50k.json")
    return bpe.Tokenizer(path), Tokenizer.from_file(path)


def test_bpe_equals_the_library(docs, raw, byte_level, empty):
    library = byte_level[1]
    expected = Counter()
    for r in raw:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert rows_of(bpe.round_trip(docs)) == expected
    assert bpe.round_trip(empty).count() == 0


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000, "=-" * 5000, "etaoin" * 1500, "é" * 3000])
def test_bpe_streams_long_pre_tokens(byte_level, text):
    own, library = byte_level
    ids = library.encode(text, add_special_tokens=False).ids
    data = text.encode()
    for size in (1, 7, 300):
        if size == 1 and len(data) > 6000:
            data = data[:600]
            ids = library.encode(data.decode(errors="ignore"), add_special_tokens=False).ids
            data = data.decode(errors="ignore").encode()
        chunks = [data[k : k + size] for k in range(0, len(data), size)]
        assert list(own.stream(chunks)) == ids
        data, ids = text.encode(), library.encode(text, add_special_tokens=False).ids
    assert own.encode_pieces([b"hello", b"a", data[:40]]) == [np.array(own.encode_piece(p), "<u4").tobytes() for p in (b"hello", b"a", data[:40])]


def test_bpe_holds_back_little_and_reads_in_linear_time(byte_level):
    own, library = byte_level
    rng = np.random.default_rng(5)
    for text in ("".join(rng.choice(list("etaoinshrdlu"), 30_000)), "ab" * 15_000, "".join(rng.choice(list("thean"), 30_000))):
        most = 0

        def chunks(data=text.encode()):
            nonlocal most
            for k in range(0, len(data), 64):
                most = max(most, own.held)
                yield data[k : k + 64]

        assert list(own.stream(chunks())) == library.encode(text, add_special_tokens=False).ids
        assert most <= 4 * own.longest < own.sufficient_lookahead


def test_bpe_decoder_holds_unfinished_characters(byte_level):
    own = byte_level[0]
    ids = np.frombuffer(own.encode("\U0001f600é"), "<u4").tolist()
    assert "".join(own.decode(ids)) == "\U0001f600é"
    assert "".join(own.decode(ids[:-1])).startswith("\U0001f600") and "�" in "".join(own.decode(ids[:1]))


def test_wavelet_shards_equal_the_library(docs, raw, empty):
    library = Tokenizer.from_file(bpe.resolve("word_bpe_49k.json"))
    got = wavelet.shard_round_trip(docs, ranges=3, shard_tokens=20_000).collect()
    ids = {}
    for r in raw:
        ids.setdefault(r[0], []).append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4"))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, xs in ids.items() for x in xs)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert wavelet.shard_round_trip(empty).count() == 0


def test_wavelet_matrix_operations():
    ids = np.random.default_rng(2).integers(0, 700, 5000).astype(np.uint32)
    data = wavelet.pack(wavelet.WaveletMatrix.build(ids), [None, 3], [2000, 3000])
    shard = wavelet.ShardFile(lambda at, n: data[at : at + n])
    m = shard.matrix
    assert shard.documents[0] == [None, 3] and shard.documents[1].tolist() == [2000, 3000]
    assert [m.access(k) for k in range(0, 5000, 7)] == ids[::7].tolist() and (m.access_range(0, 5000) == ids).all()
    assert all((m.access_range(a, b) == ids[a:b]).all() for a, b in ((0, 0), (17, 18), (511, 513), (900, 4100), (4999, 5000)))
    assert wavelet.crcs(m, np.array([2000, 0, 3000]), 700) == [zlib.crc32(x.astype("<u4")) for x in (ids[:2000], ids[:0], ids[2000:])]
    for token in (0, 5, 699, 701, 5000):
        at = np.flatnonzero(ids == token)
        assert m.rank(token, 2500) == (at < 2500).sum()
        assert [m.select(token, k) for k in range(len(at))] == at.tolist() and m.select(token, len(at)) == -1
    none = wavelet.WaveletMatrix.build(ids[:0])
    assert none.rank(1, 0) == 0 and len(none.access_range(0, 0)) == 0


def test_wavelet_lookups_read_single_blocks():
    ids = np.random.default_rng(3).integers(0, 40000, 1_500_000).astype(np.uint32)
    data, asked = wavelet.pack(wavelet.WaveletMatrix.build(ids), [1], [len(ids)]), []
    m = wavelet.ShardFile(lambda at, n: asked.append(n) or data[at : at + n]).matrix
    assert m.access(1_234_567) == ids[1_234_567]
    assert sum(asked) < len(data) / 3  # one block and the samples of each plane


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(bpe.resolve("word_bpe_49k.json"))
    words = ["Don't", "STRAẞE", "ÀÉÎÕÜß×÷ªµ", "x2024y", "İstanbul", "<|endoftext|>", "a<|startoftext|>b", "e\u0301a", "''S'S", "\x1c\x7f", "\u00a0nb", "ΣΑΣ", "!!'re..", "l'été", "日本語", "a" * 3000]
    own = wavelet.WordEncoder(bpe.resolve("word_bpe_49k.json"))
    for batch in (words, words[:5], [*words, "new", "Words,"]):
        flat, first, n = own.encode(pa.array(batch))
        assert [flat[a : a + k].tolist() for a, k in zip(first, n, strict=True)] == [library.encode(w, add_special_tokens=False).ids for w in batch]


def test_resampling_takes_the_largest_keys(docs, labels, raw, empty):
    ratios = dsir.log_ratios(docs, labels)
    keyed = dsir.log_weights(docs, ratios).withColumn("key", dsir.F.col("log_weight") + dsir.gumbel()).collect()
    k = math.ceil(0.6 * len(raw))
    order = sorted(keyed, key=lambda r: (-r.key, r.doc_id is None, r.doc_id or 0))
    got = dsir.resample(docs, labels, fraction=0.6).collect()
    assert len(got) >= k and {(r.doc_id, r.key) for r in got} == {(r.doc_id, r.key) for r in order[:k]}
    assert all(r.kept for r in got)
    assert dsir.resample(empty, labels).count() == 0 and dsir.resample(docs, labels, fraction=0.0).count() == 0
    assert dsir.resample(docs, labels.limit(0), fraction=0.5).count() >= len(raw) // 2


def test_kth_largest_in_narrow_ranges(spark):
    rows = [(float(k % 7), k) for k in range(400)]
    keyed = spark.createDataFrame(rows, "key double, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 57, 200, 400):
        assert dsir.kth_largest(keyed, k, bins=3, last=5) == order[k - 1]


def test_dsir_ngrams_match_a_plain_count():
    import xxhash

    texts = ["Ab, ab! c", None, "", "one"]
    (_, part), = text_slices(pa.array(texts))
    bucket, offsets = dsir.ngram_buckets(part, 97)
    assert np.diff(offsets).tolist() == [5 + 4, 0, 0, 1]
    assert bucket[offsets[3]] == xxhash.xxh64_intdigest("one") % 97


def test_dsir_weights_by_definition(spark, docs, labels, raw):
    """Log weights from counts in dictionaries, a part and a pair of parts at a time."""
    import xxhash

    good = {r.doc_id for r in labels.groupBy("doc_id").agg(dsir.F.max("quality").alias("q")).where("q = 1").collect() if r.doc_id is not None}
    mixed = lambda h: int(dsir.mix64(np.array([h], np.uint64))[0])
    part = lru_cache(None)(lambda w: xxhash.xxh64_intdigest(w))

    def grams(text):
        p = [part(w) for word in WORD.findall(text or "") for w in re.findall(r"\w+|[^\w\s]+", word)]
        return [h % 1000 for h in p] + [mixed((mixed(a) + b) % 2**64) % 1000 for a, b in zip(p, p[1:], strict=False)]

    rows = [(r[0], grams(r[1])) for r in raw[:60] + raw[-10:]]
    some = spark.createDataFrame([(*r, "clash", 0.5, 7, 7) for r in raw[:60] + raw[-10:]], docs.schema).repartition(3)
    every, target = Counter(g for _, found in rows for g in found), Counter(g for i, found in rows for g in found if i in good)
    assert target
    n_every, n_target = sum(every.values()) + 1000, sum(target.values()) + 1000
    weight = lambda g: math.log((target[g] + 1) / n_target) - math.log((every[g] + 1) / n_every)
    expected = sorted(((i, len(found), sum(map(weight, found))) for i, found in rows), key=lambda r: (r[0] is None, r[0] or 0))
    ratios = dsir.log_ratios(some, labels, buckets=1000)
    got = sorted(((r.doc_id, r.n_ngrams, r.log_weight) for r in dsir.log_weights(some, ratios).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
    assert [c for _, _, c in got] == pytest.approx([c for _, _, c in expected], abs=1e-6)


def test_wavelet_shards_may_be_written_twice(docs, tmp_path):
    """A task that runs again finds its own files there."""
    folder = f"file://{tmp_path}/shards"
    first, second = (sorted(map(tuple, wavelet.write_shards(docs, folder, "word_bpe_49k.json", 2).collect())) for _ in range(2))
    assert first == second and len(list((tmp_path / "shards").glob("shard-*"))) == len(first) and not list((tmp_path / "shards").glob("_attempt*"))


INSULTS = ["blarghul", "zonkwit", "vexmudge"]


def toxic_corpus(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "re", "mi", "so", "la", "ne", "do", "ku", "pa", "vi"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)]
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                words[rng.integers(60)] = str(rng.choice(INSULTS))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out_and_obfuscated(spark):
    rows = toxic_corpus(400, 0)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain = " ".join(w for w in rows[1][1].split())
    odd = [(1000, plain + " z.o.n.k.w.i.t"), (1001, plain + " b l a r g h u l"), (1002, plain + " vexxmudge"), (1003, plain + " z0nkwit"), (1004, None), (1005, ""), (1006, plain), (None, plain)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.score_documents(both, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [1, 1, 1, 1]
    assert [got[i].predicted for i in (1004, 1005, 1006, None)] == [0, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_without_labels(docs, labels, empty, raw):
    got = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(got) == len(raw) and all(r.score == 0 for r in got)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert set(toxicity.filter_documents(docs, labels).columns) == set(docs.columns)


def test_subsequence_kernel_against_enumeration():
    from itertools import combinations

    def features(word):
        codes = [ord(c) - 96 for c in word]
        out = Counter()
        for i, j, k in combinations(range(len(codes)), 3):
            if k - i < toxicity.SPAN:
                out[codes[i] << 12 | codes[j] << 6 | codes[k]] += toxicity.DECAY ** (k - i)
        return out

    words = ["idiot", "idxiot", "banana", "ab", "abcabcabc"]
    codes, offsets = toxicity.letter_codes(pa.array(words))
    got = toxicity.features(codes, offsets)
    for word, (keys, values) in zip(words, got, strict=True):
        f = features(word)
        size = math.sqrt(sum(v * v for v in f.values()))
        assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == pytest.approx({k: v / size for k, v in f.items()})
    table = np.zeros(1 << 18, np.float32)
    table[got[0][0]] = got[0][1]
    f = [dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in got]
    assert toxicity.project(codes, offsets, table) == pytest.approx([sum(f[0].get(k, 0) * v for k, v in g.items()) for g in f], abs=1e-5)
