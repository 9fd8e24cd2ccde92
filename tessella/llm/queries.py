"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, dsir, fim, html, lm, minhash, quality, simhash, toxicity, variants, warc, wavelet
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsir.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shard_round_trip(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_simhash_near_dedup, op3_lm_scoring, op4_bpe_round_trip, op5_importance_resampling, op6_wavelet_shards,
        op7_decontamination, op8_html_extraction, op9_warc_normaliser, op10_toxicity, op11_spelling_variants, op12_fill_in_middle, op13_minhash_near_dedup,
    )
}
#: The others hold trained models, hashes or tokenizers, which SQL cannot express; tests check them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_warc_normaliser": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
 g AS (SELECT d, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY d), r AS (SELECT p.*, CASE WHEN page_id <> last THEN last END AS refers_to FROM p LEFT JOIN g USING (d))
 SELECT page_id, url, strlen(h) AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    # CRC-32 from its polynomial: a table of 256 entries, then a fold over the bytes of each distinct (doc_id, run)
    "op11_spelling_variants": r"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 found AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
 runs AS (SELECT d, w, hex(encode(d || ':' || w)) AS b, count(*) AS k FROM found WHERE length(w) >= 7 GROUP BY d, w),
 hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(b), 2), lambda i: ('0x' || substr(b, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM runs, crc),
 kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, k FROM hashed),
 v AS MATERIALIZED (SELECT w, sum(k)::BIGINT AS n FROM kept WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
 pos AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
 cut AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) AS l, substr(w, i + 1) AS r FROM pos),
 one AS (SELECT DISTINCT w, l || r AS x FROM cut),
 near AS (SELECT a.w, b.w AS x, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.w <> b.w
  UNION ALL SELECT one.w, v.w, v.n FROM one JOIN v ON v.w = one.x UNION ALL SELECT v.w, o.w, o.n FROM v JOIN (SELECT one.w, one.x, v.n FROM one JOIN v USING (w)) o ON o.x = v.w),
 best AS (SELECT w, count(*) AS n_near, arg_max(x, n) AS any_x, max(n) AS top FROM near GROUP BY w),
 named AS MATERIALIZED (SELECT v.w, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * v.n THEN (SELECT min(x) FROM near m WHERE m.w = v.w AND m.n = b.top) END AS form, CASE WHEN b.top >= 10 * v.n THEN b.top END AS form_n FROM v LEFT JOIN best b USING (w)),
 step AS (SELECT w, w AS root FROM named UNION ALL SELECT s.w, m.form FROM step s JOIN named m ON m.w = s.root WHERE m.form IS NOT NULL),
 last AS (SELECT s.w, s.root FROM step s JOIN named m ON m.w = s.root WHERE m.form IS NULL)
 SELECT m.w AS word, m.form, l.root, m.n, m.n_near, m.form_n FROM named m JOIN last l ON l.w = m.w""",
    "op12_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
 h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS z FROM h)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    # null ids do not occur in the table, and rows are documents
    "op13_minhash_near_dedup": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 e AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
 sets AS MATERIALIZED (SELECT min(doc_id) AS g, s, len(s) AS n FROM e WHERE len(s) > 0 GROUP BY s),
 x AS (SELECT g, n, unnest(s) AS t FROM sets),
 pairs AS (SELECT a.g AS a, b.g AS b FROM x a JOIN x b ON a.t = b.t AND a.g < b.g AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 edge AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
 reach AS (SELECT g, g AS c FROM sets UNION SELECT edge.a, reach.c FROM edge JOIN reach ON reach.g = edge.b),
 least AS (SELECT g, min(c) AS c FROM reach GROUP BY g)
 SELECT e.doc_id, len(e.s) AS n_shingles, coalesce(l.c, e.doc_id) AS component_id, e.doc_id = coalesce(l.c, e.doc_id) AS kept FROM e LEFT JOIN sets ON sets.s = e.s LEFT JOIN least l ON l.g = sets.g""",
}
