"""Near-duplicates, decontamination, pages, archives and the pipeline against plain restatements."""

import hashlib
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, decontaminate, html, queries, simhash, warc

from ..oracle import connect, difference


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) if len(h) else np.zeros(64)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


def components(rows):
    """Smallest id reachable from each row; null ids take part through their text only."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = {f for i, f in rows if i is not None}
    for a in named:
        for b in named:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    best = {}
    for i, f in rows:
        if i is not None:
            best[root(f)] = min(best.get(root(f), i), i)
    return Counter((i, f"{f:016x}", best.get(root(f))) for i, f in rows)


@pytest.mark.parametrize("group", [1024, 2])
def test_simhash_components(docs, raw, group):
    got = Counter(tuple(r) for r in simhash.components(docs, group=group).collect())
    assert got == components([(r[0], fingerprint(r[1])) for r in raw])


def test_simhash_links_in_dense_groups(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(1 << 62, size=100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    expected = {i: j for (i, _, j) in components(list(enumerate(fps)))}
    for group, blocks in ((1024, 128), (8, 128), (32, 8)):
        got = {r.node: r.component for r in simhash.connected(simhash.links(nodes, group=group, blocks=blocks)).collect()}
        assert {k: got.get(k, k) for k in expected} == expected


def test_connected_adds_links_to_stars_without_redoing_them(spark, monkeypatch):
    """Stars, such as an earlier result, are found to be stars; with links between them they become the components of all links."""
    rounds, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: (rounds.append(label), write(df, label))[1])
    path = simhash.connected(spark.createDataFrame([(k + 1, k) for k in range(40) if k % 10 != 9], "a long, b long"))
    rounds.clear()
    stars = path.select(F.col("node").alias("a"), F.col("component").alias("b"))
    again = simhash.connected(stars)
    assert rounds == ["components", "components-min"]
    assert sorted(again.collect()) == sorted(path.collect()) == [(k, k // 10 * 10) for k in range(40) if k % 10]
    more = simhash.connected(stars.unionByName(spark.createDataFrame([(25, 3), (3, 1)], "a long, b long")))
    assert sorted(more.collect()) == [(k, 0 if k < 10 or 20 <= k < 30 else k // 10 * 10) for k in range(40) if k not in (0, 10, 30)]


def test_simhash_keeps_one_of_each(docs, raw, empty):
    """Columns named as those used inside come back as they were."""
    rows = components([(r[0], fingerprint(r[1])) for r in raw])
    clash = docs.withColumns({"near_dedup_row": F.col("doc_id"), "Near_Dedup_FP": F.lit("x"), "bits": F.lit(1), "in_block": F.lit(2)})
    kept = simhash.one_of_each(clash)
    assert kept.columns == clash.columns
    got = kept.collect()
    assert all((r.near_dedup_row, r.Near_Dedup_FP, r.bits, r.in_block) == (r.doc_id, "x", 1, 2) for r in got)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({j for _, _, j in rows if j is not None})
    assert simhash.components(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_over_several_bitmaps(spark):
    """Row numbers of one partition run over many bitmaps, whose first and last bits count; texts are not shuffled for the last join."""
    n = 3 << simhash.BITMAP
    twice = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.when(F.col("id") % 1000 == 999, F.col("id") - 1).otherwise(F.col("id"))).alias("text"))
    kept = simhash.one_of_each(twice.coalesce(1), radius=0)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [k for k in range(n) if k % 1000 != 999]
    plan = kept._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_near_dedup_keeps_rows_without_ids(spark, docs, raw):
    """One row of each group of equal texts stays, whatever ids it has; ids that clash hide no text."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(1), "a"), (None, words(2), "b"), (None, words(2), "c"), (3, words(3), "d"), (None, words(3), "e"), (4, words(4), "f"), (4, words(5), "g"), (2, words(3), "h"), (6, words(6), "i"), (6, words(6), "j")]
    some = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, some, "")
    assert got.columns == some.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, words(1)), (None, words(2)), (2, words(3)), (4, words(4)), (4, words(5)), (6, words(6))])
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()]
    assert ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted({j for _, _, j in components([(r[0], fingerprint(r[1])) for r in raw]) if j is not None})


def test_masks_cover_all_near_pairs():
    rng = np.random.default_rng(4)
    for nodes in (10, 10**6, 10**9, 10**12):
        masks = simhash.first_masks(nodes)
        for _ in range(300):
            change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not change & m for m in masks)
            part = next(m for m in masks if not change & m)
            assert any(not change & m for m in simhash.finer_masks(part))


def words_of(text):
    return [w for w in (x.strip(string.punctuation) for x in re.findall(r"[^\x20\x09-\x0D]+", fold(text))) if w]


def leaks(rows, items):
    out = Counter()
    for i, text in rows:
        w = words_of(text)
        for j, item in items:
            q = words_of(item)
            n = min(13, len(q))
            if len(q) < 5:
                continue
            for s in range(n - len(q), len(w) - n + 1):
                lo, hi = max(0, s), min(len(w), s + len(q))
                same = [w[x] == q[x - s] for x in range(lo, hi)]
                if any(sum(same[x : x + n]) >= n - (2 if n == 13 else 0) for x in range(len(same) - n + 1)):
                    out[i, j] += 1
                    break
    return out


def test_decontamination(spark, sf, docs, raw, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    first = bench.orderBy("item_id").first().text.split()
    changed = list(first)
    changed[4], changed[9] = "QUITE", "other,"
    planted = [(7001, "before it " + " ".join(changed) + " after"), (7002, " ".join(first[:13])), (7003, " ".join(first[:12])), (7004, "a short item stands here whole"), (7005, "a short item stands changed here")]
    items = bench.unionByName(spark.createDataFrame([(500, "Short item stands here whole."), (501, "the"), (502, None), (503, "")], "item_id long, text string"))
    some = docs.select("doc_id", "text").where("doc_id < 60 OR doc_id >= 9000 OR doc_id IS NULL").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    expected = leaks([(r.doc_id, r.text) for r in some.collect()], [(r.item_id, r.text) for r in items.collect()])
    for limit in (decontaminate.LIMIT, 0):
        got = decontaminate.matches(some, items, limit)
        assert Counter((r.doc_id, r.item_id) for r in got.collect()) == expected
        left = decontaminate.filter_documents(some, items, limit)
        assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in some.collect()} - {i for i, _ in expected}
    assert (7001, 0) in expected and (7002, 0) in expected and (7003, 0) not in expected and (7004, 500) in expected and (7005, 500) not in expected
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(some, items.limit(0)).count() == 0


def test_decontamination_paths_agree(spark):
    """Rows without ids, repeated rows and items, and long overlaps: both paths give the same rows."""
    passage = [f"p{k}" for k in range(90)]
    far = passage[:]
    far[5] = far[60] = "changed"
    texts = [(None, "x y " + " ".join(passage)), (None, "x y " + " ".join(passage)), (1, " ".join(far)), (1, " ".join(far)), (2, "clean text"), (None, "clean too"), (3, " ".join(passage[40:55] + ["z"] * 30 + passage[:50])), (4, "five words stand here whole"), (1, " ".join(passage[70:]))]
    items = spark.createDataFrame([(8, " ".join(passage)), (8, " ".join(passage)), (None, " ".join(passage[20:60])), (9, "five words stand here whole")], "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    one, two = (Counter(tuple(r) for r in decontaminate.matches(docs, items, limit).collect()) for limit in (decontaminate.LIMIT, 0))
    assert one == two and one[None, 8, 2, 90] == 4 and one[1, 8, 6, 88] == 4
    for limit in (decontaminate.LIMIT, 0):
        left = decontaminate.filter_documents(docs, items, limit)
        assert Counter(tuple(r) for r in left.collect()) == Counter([(2, "clean text"), (None, "clean too")])


def test_masks_hit_every_window_with_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(all(s + p not in gone for p in m) for m in decontaminate.MASKS for s in range(13 - m[-1]))


SHELL = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies {n}</div><!-- <p>no</p> --><div id="main"><article><h1>Title {n} &amp; more</h1><p>First\n  <b>bold</b>{n}<br>line<p>Second &eacute;&#233; {n}<aside>Related {n}</aside><form><label>Name</label><input></form></article><section class="comments"><p>Nice post {n}</p></section></div><div class="sidebar"><p>Side {n}</p></div><footer>(c) {n}</footer></body></html>'


def test_html_extraction(spark):
    rows = [(k, f"https://h.example/{k}", SHELL.format(n=k)) for k in range(6)]
    rows += [(90, "https://single.example/", SHELL.format(n=90)), (91, None, SHELL.format(n=91)), (92, "https://h.example/none", None), (93, "https://h.example/empty", ""), (94, "not a url", "just text &lt;b&gt;"), (0, "https://h.example/0", SHELL.format(n=0))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    expected = lambda n: f"Title {n} & more\n\nFirst bold{n} line\n\nSecond éé {n}"
    want = Counter((i, u, expected(i)) for i, u, h in rows if h and i < 92) + Counter([(92, rows[8][1], ""), (93, rows[9][1], ""), (94, "not a url", "just text <b>")])
    for limit in (html.LIMIT, 0):
        got = html.extract_pages(pages, limit).collect()
        assert Counter((r.page_id, r.url, r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_template_learns_slots_without_known_names():
    page = "<body><div class=a>same top</div><div class=b><p>body {n} text</p><p>more {n}</p><div class=z>shared inside</div></div><div class=c>same end</div></body>"
    t = html.Template()
    for n in range(5):
        t.add_page(html.parse(page.format(n=n)))
    assert html.extract(html.parse(page.format(n=9)), t) == "body 9 text\n\nmore 9"
    again = html.Template()
    again.add_template(html.Template.load(t.dump()))
    assert html.extract(html.parse(page.format(n=9)), again) == "body 9 text\n\nmore 9"


def test_html_deep_and_broken_pages_take_linear_time():
    deep = "<div>" * 5000 + "<p>inside</p>" + "</div>" * 5000
    t = html.Template()
    for _ in range(3):
        t.add_page(html.parse(deep))
    assert html.extract(html.parse(deep), t) == "inside"

    def took(n):
        began = time.process_time()
        for broken in ("<p>text</p>" + "<a " * n, "<p>text</p>" + "<a '>" * n, "<p>text" + "<i>" * n + "</b>" * n, "<p>text</p><a title=\"" + "x<b>" * n):
            assert html.by_names(html.parse(broken)).startswith("text")
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 25 * max(took(4000), 0.02)


def test_html_article_keeps_headline_and_lead_beside_the_body():
    page = "<body><div class=top>Same</div><article><h1>Title {n}</h1><div class=lead>Lead {n}</div><div class=body><p>{n} long</p><p>{n} text " + "word " * 50 + "</p></div></article></body>"
    plain = page.replace("article", "section").replace("<div class=lead>Lead {n}</div>", "<h2>Lead {n}</h2>")
    for shape in (page, plain):
        t = html.Template()
        for n in range(4):
            t.add_page(html.parse(shape.format(n=n)))
        assert html.extract(html.parse(shape.format(n=7)), t).split("\n\n")[:3] == ["Title 7", "Lead 7", "7 long"]


def test_html_names_that_only_look_like_boilerplate_are_kept():
    """Compound class names, and addresses and titles that hold a telling word; what hides or is named outright still goes."""
    page = (
        '<body><nav>Top</nav><article><h1>Head {n}</h1><div class="side-by-side"><p>One {n}</p></div><section id="related-work"><p>Two {n}</p></section><p class="share-price">Three {n} '
        '<a href="/blog/hidden-gems">gems</a> <img alt="a hidden one"><a title="hidden comment">told</a></p><div class="comment-list"><p>Nice {n}</p></div><div class="related">More {n}</div>'
        '<p hidden>gone</p><p style="color:red; display:none">gone</p><p aria-hidden="true">gone</p><p aria-hidden=false>stays</p></article></body>'
    )
    want = "Head {n}\n\nOne {n}\n\nTwo {n}\n\nThree {n} gems told\n\nstays"
    t = html.Template()
    for n in range(5):
        t.add_page(html.parse(page.format(n=n)))
    assert html.extract(html.parse(page.format(n=8)), t) == html.extract(html.parse(page.format(n=8)), None) == want.format(n=8)


def test_html_many_siblings_are_matched_in_order():
    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y) * weights[x])
        return best[-1][-1] + 1

    rng = np.random.default_rng(9)
    for _ in range(200):
        weights = dict(zip("abcde", rng.integers(1, 5, 5).tolist(), strict=True))
        a, b = ("".join(rng.choice(list("abcde"), rng.integers(0, 9))) for _ in range(2))
        left, right = list(range(len(a))), list(range(len(b)))
        size = {(i, j): weights[a[i]] for i in left for j in right if a[i] == b[j]}
        most, own = html.heaviest(left, right, list(a), list(b), size)
        assert most == slow(a, b) == 1 + sum(weights[b[j]] for j in own)
        assert all(a[i] == b[j] for j, i in own.items()) and [own[j] for j in sorted(own)] == sorted(own.values())
    wide = lambda n: "<body>" + "".join(f'<div class="c{k}"><p>{n} {k}</p></div>' for k in range(20_000)) + "</body>"
    began = time.process_time()
    t = html.Template()
    for n in range(2):
        t.add_page(html.parse(wide(n)))
    assert time.process_time() - began < 15 and t.seen[1:].count(2) == 40_001  # the body, and a container and a paragraph each


def test_html_on_the_table(spark, sf):
    import html as entities

    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_warc_round_trip(spark):
    big, other = "é" + "<p>x</p>" * 200, "<i>y</i>" * 300
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, "http://a/3\r\nX: 1", big), (None, "http://a/n", big), (4, None, "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (10, "u", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    expected = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != last[h or ""]
        expected[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    got = warc.archive_round_trip(pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == expected
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_records_survive_any_split():
    records = [warc.make_record(k, f"u{k}", b"p" * (k * 37), hashlib.sha1(b"p" * (k * 37)).hexdigest(), False, None) for k in range(20)]
    import gzip

    whole = gzip.compress(b"".join(records))
    for size in (1, 13, 1000, 10**6):
        assert list(warc.split_records(warc.inflate(iter([whole[k : k + size] for k in range(0, len(whole), size)])))) == records
    many = b"".join(gzip.compress(r) for r in records)
    assert list(warc.split_records(warc.inflate(iter([many])))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[0][:-10]])))


def test_warc_inflates_in_bounded_parts_and_notices_damage():
    data = zlib.compress(b"a" * (60 << 20), 9, 31)
    sizes = [len(p) for p in warc.inflate(iter([data]))]
    assert sum(sizes) == 60 << 20 and max(sizes) <= warc.BLOCK
    record = warc.make_record(1, "u", b"p", hashlib.sha1(b"p").hexdigest(), False, None)
    whole = zlib.compress(record, 5, 31)
    assert list(warc.split_records(warc.inflate(iter([whole + b"\0" * 512, b"\0\0" + whole])))) == [record, record]
    for cut in (len(whole) - 8, len(whole) - 4, len(whole) // 2):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(iter([whole[:cut]]))))


def test_warc_keeps_odd_urls():
    for url in ("http://h/a b", "x\r\ny", "é\u2028", "http://h/%20?q=1#f", " lead: x ", ""):
        record = warc.make_record(1, url, b"p", hashlib.sha1(b"p").hexdigest(), False, None)
        assert warc.read_record(zlib.compress(record, 5, 31))[1] == url


def test_warc_equals_its_sql(spark, sf):
    assert difference(queries.QUERIES["op9_warc_normaliser"](spark, sf), connect(sf), queries.ORACLE_SQL["op9_warc_normaliser"]) is None


def test_pipeline_stages(spark, sf):
    """Each stage works on what its predecessor kept; kept ids follow from the operators' own plain versions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), f"test-{name}")
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert set(ids) <= {i for i, _ in before}
        if name == "near_dedup":
            assert ids == sorted({j for _, _, j in components([(i, fingerprint(t)) for i, t in before])})
        if name == "decontamination":
            assert ids == sorted({i for i, _ in before} - {i for i, _ in leaks(before, bench)})
        if name == "bpe":
            own = bpe.tokenizer(bpe.resolve("byte_bpe_50k.json"))
            assert {r.doc_id: tuple(r.ids) for r in docs.collect()} == {i: tuple(np.frombuffer(own.encode(t), "<u4").tolist()) for i, t in before}
        else:
            assert docs.columns == columns
    final = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_html_hosts_with_many_layouts_keep_all_nodes(spark):
    """A host beyond what a template holds is dealt into parts; none of its nodes goes. Read by one task, its pages give what one template gives."""
    layout = "<div class='page'><div class='top l{k}'>menu of {k}</div>" + "".join(f"<div class='s{{k}}x{j}'><p>words {{n}} of {j}</p></div>" for j in range(12)) + "<div class='end l{k}'>ends {k}</div></div>"
    rows = [(n, "http://many.example/x", layout.format(k=n % 15, n=n)) for n in range(90)] + [(100 + n, "http://few.example/x", layout.format(k=0, n=n)) for n in range(4)] + [(200, "http://one.example/", "<p>alone</p>"), (201, "http://many.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    whole = sorted(html.extract_pages(pages).collect())
    assert [r.text for r in whole[:90]] == ["\n\n".join(f"words {n} of {j}" for j in range(12)) for n in range(90)]
    for limit in (html.LIMIT, 0):
        assert sorted(html.extract_pages(pages, limit, nodes=40).collect()) == whole
    made = html.induce(pages, nodes=40).collect()
    assert {r.host: r.parts > 1 for r in made} == {"many.example": True, "few.example": False, "one.example": False}
    own = [html.Template.load(r.template) for r in made if r.host == "many.example"]
    assert sum(t.pages for t in own) == 90 and max(len(t.labels) for t in own) <= 80
    assert {x for t in own for x in t.labels} >= {x for _, url, h in rows if h and "many" in url for x in html.parse(h).labels}
