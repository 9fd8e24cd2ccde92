"""The registered queries over the star-schema tables, each with the SQL that checks it.

A query applies library operators to an adapter's rows; its SQL states the same result independently, over the raw tables.
Real numbers are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import evaluation, features, frames, levels, perturbation, segments, speakers, spectra
from ..sources import adapters
from . import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frame and hop in samples, for recordings of a few dozen samples; bins and rate of the spectra.
SIZE, HOP = 8, 4
BINS, RATE = 64, 16000.0
WINDOW, STEP, LEAST, CELL = 24, 8, 4, 64
#: Level over which a frame of these recordings is speech; about four frames in ten are.
SPEECH_DB = -20


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Round every double to six places; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SIGNAL = """signal AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (value - 50) / 450 AS x,
 value / 500 AS amp, value, event_type, epoch_us(ts) / 1000.0 AS ms FROM events)"""
FRAMES = f"""{SIGNAL}, fr AS (SELECT recording_id, f AS frame_idx, sqrt(avg(x * x) + 1e-12) AS rms, max(abs(x)) AS peak FROM
 (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - {SIZE - 1}) / {HOP}.0) AS BIGINT)), idx // {HOP} + 1)) AS f FROM signal) GROUP BY ALL HAVING count(*) = {SIZE}),
 lv AS (SELECT recording_id, frame_idx, frame_idx * {HOP} AS start_idx, rms, 20 * log10(rms) AS db, peak FROM fr)"""
SPECTRUM = """spectrum AS (SELECT label AS recording_id, vec_id AS frame_idx, b AS bin, abs(CAST(embedding[b + 1] AS DOUBLE)) AS mag FROM embeddings, range(64) t(b)),
 hz AS (SELECT *, bin * (8000.0 / 63) AS hz FROM spectrum)"""
CONTOUR = f"{SIGNAL}, contour AS (SELECT recording_id, idx, CASE WHEN event_type = 'error' THEN 0 ELSE 50 + value END AS f0 FROM signal)"


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.signal(spark, sf)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return frames.frame_levels(_signal(spark, sf), SIZE, HOP)


# Sources and forensics


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def forensic_hash(spark, sf):
    text = F.col("text").cast("binary")
    return adapters.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text, 256).alias("sha256"), F.md5(text).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT d.doc_id, CASE WHEN c.t IS NULL THEN false ELSE sha256(d.text) = sha256(c.t) AND md5(d.text) = md5(c.t) END AS verified FROM documents d
 LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0) c USING (doc_id)""")
def integrity_verify(spark, sf):
    """A copy is intact if both digests agree; a missing copy is not."""
    both = lambda c: F.struct(F.sha2(F.col(c).cast("binary"), 256), F.md5(F.col(c).cast("binary")))
    docs = adapters.table(spark, sf, "documents")
    kept = docs.select("doc_id", both("text").alias("own"))
    copy = docs.where(F.col("doc_id") % 7 != 0).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("t"))
    return kept.join(copy.select("doc_id", both("t").alias("other")), "doc_id", "left").select("doc_id", F.coalesce(F.col("own") == F.col("other"), F.lit(False)).alias("verified"))


@query("""WITH k(subtype) AS (VALUES ('PCM_16'), ('PCM_24'), ('PCM_32'), ('PCM_U8'), ('FLOAT'), ('DOUBLE'), ('VORBIS'))
 SELECT e.event_id, k.subtype, CAST(CASE WHEN subtype LIKE '%DOUBLE%' THEN 64 WHEN subtype LIKE '%FLOAT%' THEN 32 WHEN subtype LIKE '%16%' THEN 16 WHEN subtype LIKE '%24%' THEN 24
 WHEN subtype LIKE '%32%' THEN 32 WHEN subtype LIKE '%8%' THEN 8 END AS INTEGER) AS bits
 FROM events e JOIN (SELECT subtype, row_number() OVER () - 1 AS j FROM k) k ON e.event_id % 7 = k.j""")
def bit_depth_case(spark, sf):
    names = F.array(*map(F.lit, ("PCM_16", "PCM_24", "PCM_32", "PCM_U8", "FLOAT", "DOUBLE", "VORBIS")))
    rows = adapters.table(spark, sf, "events").select("event_id", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("subtype"))
    return rows.withColumn("bits", X.bit_depth(F.col("subtype")))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 0 ELSE round(value, 6) END AS x FROM events")
def sanitize_samples(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("inf"))).when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return r6(levels.sanitize(adapters.table(spark, sf, "events").select("event_id", raw.alias("x"))))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.scenario'), 'general_telephony') AS scenario FROM events")
def json_config(spark, sf):
    """A stream's settings from JSON, with defaults for what is missing."""
    got = F.from_json("props", "k long, scenario string")
    return adapters.table(spark, sf, "events").select("event_id", got["k"].alias("k"), F.coalesce(got["scenario"], F.lit("general_telephony")).alias("scenario"))


# Levels


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2, 6) + 0.0 AS x FROM embeddings")
def mono_downmix(spark, sf):
    rows = adapters.table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("channels"))
    return r6(levels.mono_downmix(rows).select("vec_id", "x"))


@query(f"WITH {SIGNAL} SELECT recording_id, idx, round(x - avg(x) OVER (PARTITION BY recording_id), 6) + 0.0 AS x FROM signal")
def dc_removal(spark, sf):
    return r6(levels.remove_dc(_signal(spark, sf)).select("recording_id", "idx", "x"))


@query(f"WITH {SIGNAL} SELECT recording_id, idx, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY recording_id ORDER BY idx), 0), 6) + 0.0 AS y FROM signal")
def pre_emphasis(spark, sf):
    return r6(levels.pre_emphasis(_signal(spark, sf)).select("recording_id", "idx", "y"))


@query(f"""WITH {SIGNAL}, a AS (SELECT recording_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM signal GROUP BY 1),
 b AS (SELECT *, CASE WHEN rms < 0.015 THEN 1.0 ELSE 10 ** (greatest(-30, least(12, -20 - 20 * log10(rms))) / 20) END AS raw FROM a),
 g AS (SELECT recording_id, CASE WHEN rms >= 0.015 AND peak * raw > 0.95 THEN 0.95 / peak ELSE raw END AS gain FROM b)
 SELECT recording_id, idx, round(greatest(-1, least(1, x * gain)), 6) + 0.0 AS x FROM signal JOIN g USING (recording_id)""")
def loudness_normalize(spark, sf):
    return r6(levels.normalize_loudness(_signal(spark, sf)).select("recording_id", "idx", "x"))


@query(f"""WITH {SIGNAL}, a AS (SELECT recording_id, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM signal GROUP BY 1)
 SELECT recording_id, n, round(peak, 6) AS peak, round(CASE WHEN peak <= 1e-7 THEN -100 ELSE 20 * log10(peak) END, 6) AS peak_dbfs,
 round(CASE WHEN rms <= 1e-7 THEN -100 ELSE 20 * log10(rms) END, 6) AS rms_dbfs, peak >= 0.999 AS is_clipped FROM a""")
def acoustic_stats(spark, sf):
    return r6(levels.acoustic_stats(_signal(spark, sf)))


@query(f"WITH {FRAMES} SELECT recording_id, round(quantile_cont(db, 0.95) - quantile_cont(db, 0.10), 6) AS dynamic_range_db FROM lv GROUP BY 1")
def dynamic_range(spark, sf):
    return r6(_levels(spark, sf).groupBy("recording_id").agg((F.percentile("db", 0.95) - F.percentile("db", 0.10)).alias("dynamic_range_db")))


@query(f"WITH {SIGNAL}, s AS (SELECT recording_id, abs(sign(x) - lag(sign(x)) OVER (PARTITION BY recording_id ORDER BY idx)) AS d FROM signal) SELECT recording_id, round(coalesce(avg(d) / 2, 0), 6) AS zcr FROM s GROUP BY 1")
def zcr(spark, sf):
    return r6(levels.zero_crossing_rate(_signal(spark, sf)))


# Frames and segments


@query(f"WITH {FRAMES} SELECT recording_id, frame_idx, start_idx, round(peak, 6) AS peak FROM lv")
def hop_frames(spark, sf):
    return r6(_levels(spark, sf).select("recording_id", "frame_idx", "start_idx", "peak"))


@query(f"WITH {FRAMES} SELECT recording_id, frame_idx, round(rms, 6) AS rms, round(db, 6) AS db FROM lv")
def frame_rms(spark, sf):
    return r6(_levels(spark, sf).select("recording_id", "frame_idx", "rms", "db"))


@query(f"""WITH {SIGNAL}, s AS (SELECT *, abs(sign(x) - lag(sign(x)) OVER (PARTITION BY recording_id ORDER BY idx)) AS d FROM signal)
 SELECT recording_id, f AS frame_idx, round(avg(CASE WHEN idx > f * {HOP} THEN d END) / 2, 6) AS zcr FROM
 (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - {SIZE - 1}) / {HOP}.0) AS BIGINT)), idx // {HOP} + 1)) AS f FROM s) GROUP BY 1, 2 HAVING count(*) = {SIZE}""")
def frame_zcr(spark, sf):
    return r6(frames.frame_zcr(_signal(spark, sf), SIZE, HOP))


THRESHOLD = """th AS (SELECT recording_id, quantile_cont(db, 0.15) AS floor_db, max(db) AS max_db FROM lv GROUP BY 1),
 tt AS (SELECT recording_id, floor_db, least(CASE WHEN floor_db < -35 THEN greatest(-48, floor_db + 5) ELSE -48 END, max_db - 2) AS threshold_db FROM th)"""


@query(f"WITH {FRAMES}, {THRESHOLD} SELECT recording_id, round(floor_db, 6) AS floor_db, round(threshold_db, 6) AS threshold_db FROM tt")
def adaptive_threshold(spark, sf):
    return r6(segments.adaptive_threshold(_levels(spark, sf)))


def _flags(spark, sf):
    return _levels(spark, sf).select("recording_id", "frame_idx", (F.col("db") > SPEECH_DB).alias("is_speech"))


# an independent statement of the smoothing: neighbours of each silent frame, then of each filled burst
HANGOVER = f"""fl AS (SELECT recording_id, frame_idx, db > {SPEECH_DB} AS s FROM lv),
 nb AS (SELECT *, max(CASE WHEN s THEN frame_idx END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS a,
  min(CASE WHEN s THEN frame_idx END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM fl),
 fi AS (SELECT recording_id, frame_idx, s OR (a IS NOT NULL AND b IS NOT NULL AND b - a - 1 <= 2) AS s FROM nb),
 nq AS (SELECT *, coalesce(max(CASE WHEN NOT s THEN frame_idx END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), -1) AS a,
  coalesce(min(CASE WHEN NOT s THEN frame_idx END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(frame_idx) OVER (PARTITION BY recording_id) + 1) AS b FROM fi),
 ho AS (SELECT recording_id, frame_idx, s AND b - a - 1 >= 2 AS is_speech FROM nq)"""


def _smooth(spark, sf):
    return segments.hangover(_flags(spark, sf), 2, 2)


@query(f"WITH {FRAMES}, {HANGOVER} SELECT * FROM ho")
def vad_hangover(spark, sf):
    return _smooth(spark, sf)


SEGMENTS = f"""nn AS (SELECT recording_id, count(*) AS n FROM signal GROUP BY 1),
 ru AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY recording_id, is_speech ORDER BY frame_idx) AS g FROM ho),
 ri AS (SELECT recording_id, is_speech, min(frame_idx) AS a, max(frame_idx) AS b FROM ru GROUP BY recording_id, is_speech, g),
 sg AS (SELECT recording_id, row_number() OVER w - 1 AS segment_id, is_speech, a * {HOP} AS start_idx,
  CASE WHEN lead(a) OVER w IS NULL THEN n ELSE b * {HOP} + {SIZE} END AS end_idx FROM ri JOIN nn USING (recording_id) WINDOW w AS (PARTITION BY recording_id ORDER BY a))"""


def _lengths(spark, sf):
    return _signal(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n"))


def _segments(spark, sf):
    return segments.segments(_smooth(spark, sf), _lengths(spark, sf), SIZE, HOP)


@query(f"WITH {FRAMES}, {HANGOVER}, {SEGMENTS} SELECT * FROM sg")
def vad_segments(spark, sf):
    return _segments(spark, sf)


CHUNKS = f"""ch AS (SELECT recording_id, i AS chunk_index, i * {STEP} AS start_idx, least(i * {STEP} + {WINDOW}, n) AS end_idx, i * {STEP} + {WINDOW} > n AS is_padded
 FROM (SELECT recording_id, count(*) AS n FROM signal GROUP BY 1), range(200) t(i) WHERE i * {STEP} + {WINDOW} <= n
 OR (n - i * {STEP} >= {LEAST} AND (i = 0 OR ((i - 1) * {STEP} + {WINDOW} <= n AND (i - 1) * {STEP} + {WINDOW} < n))))"""


def _chunks(spark, sf):
    return frames.sliding_chunks(_lengths(spark, sf), WINDOW, STEP, LEAST)


@query(f"WITH {SIGNAL}, {CHUNKS} SELECT * FROM ch")
def sliding_chunks(spark, sf):
    return _chunks(spark, sf)


@query(f"""WITH {FRAMES}, {HANGOVER}, {SEGMENTS}, {CHUNKS}, ov AS (SELECT c.recording_id, c.chunk_index, sum(least(s.end_idx, c.end_idx) - greatest(s.start_idx, c.start_idx)) AS o
 FROM ch c JOIN sg s ON c.recording_id = s.recording_id AND s.is_speech AND s.start_idx < c.end_idx AND c.start_idx < s.end_idx GROUP BY 1, 2)
 SELECT ch.*, round(least(1, coalesce(o, 0) / (end_idx - start_idx)), 3) AS speech_ratio, least(1, coalesce(o, 0) / (end_idx - start_idx)) > 0.05 AS contains_speech FROM ch LEFT JOIN ov USING (recording_id, chunk_index)""")
def chunk_speech_ratio(spark, sf):
    return frames.chunk_speech_ratio(_chunks(spark, sf), _segments(spark, sf), CELL)


@query(f"""WITH {FRAMES}, {HANGOVER}, {SEGMENTS} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id, idx) - 1 AS pos, idx, round(x, 6) AS x
 FROM sg JOIN signal USING (recording_id) WHERE is_speech AND idx >= start_idx AND idx < end_idx""")
def speech_only(spark, sf):
    return r6(frames.speech_only(_signal(spark, sf), _segments(spark, sf)).withColumn("pos", F.col("pos").cast("long")))


@query(f"""WITH {FRAMES}, q AS (SELECT *, db < -12 AS q, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY recording_id, db < -12 ORDER BY frame_idx) AS g FROM lv),
 p AS (SELECT recording_id, q, count(*) AS len FROM q GROUP BY recording_id, q, g)
 SELECT recording_id, count(CASE WHEN q AND len >= 2 THEN 1 END) AS pause_count, round(coalesce(avg(CASE WHEN q AND len >= 2 THEN len END), 0), 6) AS mean_pause FROM p GROUP BY 1""")
def pause_runs(spark, sf):
    return r6(segments.pause_runs(_levels(spark, sf), -12.0, 2))


@query(f"""WITH {FRAMES}, {HANGOVER}, m AS (SELECT recording_id, max(frame_idx) + 1 AS n FROM ho GROUP BY 1), c AS (SELECT recording_id, (frame_idx * 40) // n AS cell, max(is_speech) AS o FROM ho JOIN m USING (recording_id) GROUP BY 1, 2)
 SELECT m.recording_id, string_agg(CASE WHEN coalesce(o, false) THEN '#' ELSE '-' END, '' ORDER BY k) AS bar FROM (SELECT recording_id, k FROM m, range(40) t(k)) m LEFT JOIN c ON c.recording_id = m.recording_id AND c.cell = k GROUP BY 1""")
def timeline_bar(spark, sf):
    return segments.timeline_bar(_smooth(spark, sf))


# Perturbation and prosody


def _pert(name: str, value: str) -> str:
    w = "OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    near = lambda k: f"CASE WHEN count({value}) {w.format(k=k)} = {2 * k + 1} THEN abs({value} - avg({value}) {w.format(k=k)}) END"
    share = lambda c: f"round(CASE WHEN n >= 5 AND m > 0 THEN coalesce({c} / m * 100, 0) ELSE 0 END, 6)"
    return f"""d AS (SELECT recording_id, {value} AS v, lag({value}) OVER (PARTITION BY recording_id ORDER BY idx) AS p, {near(1)} AS d3, {near(2)} AS d5 FROM series),
 a AS (SELECT recording_id, count(v) AS n, avg(v) AS m, avg(abs(v - p)) AS d1, avg(d3) AS d3, avg(d5) AS d5, avg(CASE WHEN v > 0 AND p > 0 THEN abs(20 * log10(v / p)) END) AS db FROM d GROUP BY 1)
 SELECT recording_id, {share('d1')} AS {name}_local_pct, {share('d3')} AS {name}_three_pct, {share('d5')} AS {name}_five_pct, round(CASE WHEN n >= 5 AND m > 0 THEN coalesce(db, 0) ELSE 0 END, 6) AS {name}_db FROM a"""


PERIODS = f"{SIGNAL}, series AS (SELECT recording_id, idx, ms - lag(ms) OVER (PARTITION BY recording_id ORDER BY idx) AS period FROM signal QUALIFY idx > 0)"


def _periods(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("recording_id").orderBy("idx")
    return _signal(spark, sf).withColumn("period", (F.col("ms") - F.lag("ms").over(order)).cast("double")).where("period IS NOT NULL")


@query(f"WITH {PERIODS}, {_pert('jitter', 'period')}")
def jitter(spark, sf):
    return r6(perturbation.perturbation(_periods(spark, sf), "period", "jitter"))


@query(f"WITH {SIGNAL}, series AS (SELECT recording_id, idx, amp FROM signal), {_pert('shimmer', 'amp')}")
def shimmer(spark, sf):
    return r6(perturbation.perturbation(_signal(spark, sf), "amp", "shimmer"))


@query(f"""WITH {PERIODS}, d AS (SELECT recording_id, period AS v, lag(period) OVER (PARTITION BY recording_id ORDER BY idx) AS p FROM series)
 SELECT recording_id, round(coalesce(avg(abs(v - p)), 0), 2) AS rpvi, round(coalesce(100 * avg(CASE WHEN (v + p) / 2 > 0 THEN abs(v - p) / ((v + p) / 2) END), 0), 6) AS npvi FROM d GROUP BY 1""")
def npvi_rpvi(spark, sf):
    return perturbation.pairwise_variability(_periods(spark, sf), "period").select("recording_id", F.round("rpvi", 2).alias("rpvi"), F.round("npvi", 6).alias("npvi"))


@query(f"""WITH {CONTOUR}, a AS (SELECT recording_id, count(*) AS n, count(*) FILTER (f0 > 0) AS k, avg(f0) FILTER (f0 > 0) AS a, stddev_pop(f0) FILTER (f0 > 0) AS s, min(f0) FILTER (f0 > 0) AS lo, max(f0) FILTER (f0 > 0) AS hi FROM contour GROUP BY 1)
 SELECT recording_id, round(CASE WHEN k >= 2 THEN a ELSE 0 END, 6) AS mean_f0, round(CASE WHEN k >= 2 THEN s ELSE 0 END, 6) AS std_f0, round(CASE WHEN k >= 2 THEN lo ELSE 0 END, 6) AS min_f0,
 round(CASE WHEN k >= 2 THEN hi ELSE 0 END, 6) AS max_f0, round(k / n, 6) AS voiced_fraction FROM a""")
def pitch_stats(spark, sf):
    return r6(perturbation.pitch_stats(adapters.contour(spark, sf)))


@query(f"""WITH {CONTOUR}, v AS (SELECT recording_id, 12 * log2(f0 / 100) AS st, (f0 - lag(f0) OVER (PARTITION BY recording_id ORDER BY idx)) / 0.01 AS slope FROM contour WHERE f0 > 0),
 a AS (SELECT recording_id, count(*) AS n, quantile_cont(st, 0.95) - quantile_cont(st, 0.05) AS r, avg(slope) AS m, var_pop(slope) AS v FROM v GROUP BY 1)
 SELECT recording_id, round(CASE WHEN n >= 5 THEN r ELSE 0 END, 6) AS range_semitones, round(CASE WHEN n >= 5 THEN m ELSE 0 END, 4) AS mean_slope, round(CASE WHEN n >= 5 THEN v ELSE 0 END, 1) AS slope_variance, n >= 5 AND r < 1.5 AS is_monotone FROM a""")
def intonation(spark, sf):
    got = perturbation.intonation(adapters.contour(spark, sf))
    return got.select("recording_id", F.round("range_semitones", 6).alias("range_semitones"), F.round("mean_slope", 4).alias("mean_slope"), F.round("slope_variance", 1).alias("slope_variance"), "is_monotone")


@query(f"""WITH {CONTOUR}, v AS (SELECT recording_id, idx, f0 - lag(f0) OVER (PARTITION BY recording_id ORDER BY idx) AS s FROM contour WHERE f0 > 0),
 w AS (SELECT recording_id, sign(s) <> lag(sign(s)) OVER (PARTITION BY recording_id ORDER BY idx) AS t FROM v WHERE abs(s) > 10) SELECT recording_id, CAST(count(*) FILTER (t) AS BIGINT) AS turns FROM w GROUP BY 1""")
def pitch_turns(spark, sf):
    return perturbation.pitch_turns(adapters.contour(spark, sf))


@query(f"""WITH {FRAMES}, j AS (SELECT recording_id, abs(db - lag(db) OVER (PARTITION BY recording_id ORDER BY frame_idx)) AS j FROM lv)
 SELECT recording_id, round(coalesce(max(j), 0), 6) AS max_jump_db, count(*) FILTER (j > 4) AS splice_points FROM j GROUP BY 1""")
def splice_points(spark, sf):
    return r6(perturbation.splice_points(_levels(spark, sf), 4.0))


@query(f"""WITH {FRAMES}, p AS (SELECT recording_id, db, coalesce(db > lag(db) OVER w AND db > lead(db) OVER w AND db >= -8, false) AS p FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)),
 a AS (SELECT recording_id, count(*) FILTER (p) AS syllables, count(*) AS n, count(*) FILTER (db >= -8) AS k FROM p GROUP BY 1)
 SELECT recording_id, syllables, round(syllables / (n * 0.01), 6) AS speaking_rate, round(CASE WHEN k > 0 THEN syllables / (k * 0.01) ELSE 0 END, 6) AS articulation_rate FROM a""")
def speaking_rate(spark, sf):
    return r6(perturbation.speaking_rate(_levels(spark, sf), -8.0))


@query(f"""WITH {FRAMES}, e AS (SELECT recording_id, rms * rms / sum(rms * rms) OVER (PARTITION BY recording_id) AS p FROM lv WHERE frame_idx < 50) SELECT recording_id, round(sum(-p * log2(p + 1e-12)), 6) AS energy_entropy FROM e GROUP BY 1""")
def energy_entropy(spark, sf):
    return r6(spectra.energy_entropy(_levels(spark, sf)))


# Spectra


def _spectrum(spark, sf):
    return adapters.spectrum(spark, sf)


@query(f"""WITH {SPECTRUM}, c AS (SELECT recording_id, frame_idx, sum(mag * hz) / sum(mag) AS c FROM hz GROUP BY 1, 2 HAVING sum(mag) > 0),
 m AS (SELECT recording_id, frame_idx, any_value(c) AS c, sqrt(sum(mag * (hz - c) ** 2) / sum(mag)) AS s, sum(mag * (hz - c) ** 3) / sum(mag) AS t, sum(mag * (hz - c) ** 4) / sum(mag) AS q FROM hz JOIN c USING (recording_id, frame_idx) GROUP BY 1, 2)
 SELECT recording_id, round(avg(c), 3) AS centroid_mean, round(stddev_pop(c), 3) AS centroid_std, round(avg(s), 3) AS spread_mean, round(avg(t / s ** 3), 5) AS skewness_mean, round(avg(q / s ** 4), 5) AS kurtosis_mean FROM m GROUP BY 1""")
def spectral_moments(spark, sf):
    got = spectra.moment_stats(_spectrum(spark, sf), BINS, RATE)
    return got.select("recording_id", *[F.round(c, 3).alias(c) for c in ("centroid_mean", "centroid_std", "spread_mean")], *[F.round(c, 5).alias(c) for c in ("skewness_mean", "kurtosis_mean")])


@query(f"""WITH {SPECTRUM}, f AS (SELECT recording_id, exp(avg(ln(mag + 1e-10))) / (avg(mag) + 1e-10) AS f, max(mag) / (sqrt(avg(mag * mag)) + 1e-10) AS c FROM spectrum GROUP BY recording_id, frame_idx)
 SELECT recording_id, round(avg(f), 6) AS flatness_mean, round(avg(c), 6) AS crest_mean FROM f GROUP BY 1""")
def spectral_flatness_crest(spark, sf):
    return r6(spectra.flatness_crest(_spectrum(spark, sf)))


@query(f"WITH {SPECTRUM} SELECT recording_id, round(sum(mag * mag) FILTER (hz >= 4000) / sum(mag * mag), 6) AS hf_energy_ratio FROM hz GROUP BY 1")
def hf_energy_ratio(spark, sf):
    return r6(spectra.high_share(_spectrum(spark, sf), BINS, RATE, 4000.0))


@query(f"""WITH {SPECTRUM}, d AS (SELECT recording_id, frame_idx, mag - lag(mag) OVER (PARTITION BY recording_id, bin ORDER BY frame_idx) AS d FROM spectrum QUALIFY d IS NOT NULL),
 f AS (SELECT recording_id, sqrt(avg(greatest(d, 0) ** 2)) AS x FROM d GROUP BY recording_id, frame_idx) SELECT recording_id, round(avg(x), 6) AS flux_mean, round(stddev_pop(x), 6) AS flux_std FROM f GROUP BY 1""")
def spectral_flux(spark, sf):
    return r6(spectra.flux(_spectrum(spark, sf)))


@query(f"""WITH {SPECTRUM}, c AS (SELECT *, sum(mag * mag) OVER (PARTITION BY recording_id, frame_idx ORDER BY bin) AS c, sum(mag * mag) OVER (PARTITION BY recording_id, frame_idx) AS t FROM hz),
 f AS (SELECT recording_id, min(hz) AS x FROM c WHERE c >= 0.85 * t GROUP BY recording_id, frame_idx) SELECT recording_id, round(avg(x), 4) AS rolloff_mean FROM f GROUP BY 1""")
def spectral_rolloff(spark, sf):
    return spectra.rolloff(_spectrum(spark, sf), BINS, RATE).select("recording_id", F.round("rolloff_mean", 4).alias("rolloff_mean"))


MEAN_LEVELS = "ml AS (SELECT recording_id, bin, any_value(hz) AS hz, avg(mag) AS mag FROM hz GROUP BY 1, 2), md AS (SELECT *, 20 * log10(greatest(mag, 1e-10) / max(mag) OVER (PARTITION BY recording_id)) AS db FROM ml)"


@query(f"""WITH {SPECTRUM}, {MEAN_LEVELS}, w AS (SELECT recording_id, bin, hz, db, max(db) OVER r AS mx, avg(db) OVER r AS av, db - coalesce(lag(db, 12) OVER o, first_value(db) OVER o) AS fall FROM md
 WINDOW o AS (PARTITION BY recording_id ORDER BY bin), r AS (PARTITION BY recording_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 h AS (SELECT recording_id, min(hz) FILTER (hz >= 1400 AND bin < 57 AND db < -0.5 AND mx < -0.1 AND fall < -0.2 AND av < -0.5) AS hz FROM w GROUP BY 1)
 SELECT recording_id, hz IS NOT NULL AS has_cutoff, round(coalesce(hz, 0), 4) AS cutoff_hz FROM h""")
def hf_cutoff(spark, sf):
    """With thresholds that fit spectra without a real cutoff, so that both outcomes occur."""
    got = spectra.cutoff(_spectrum(spark, sf), BINS, RATE, 1400.0, -0.5, -0.1, -0.2, -0.5)
    return got.select("recording_id", "has_cutoff", F.round("cutoff_hz", 4).alias("cutoff_hz"))


@query(f"""WITH {SPECTRUM}, {MEAN_LEVELS}, n AS (SELECT recording_id, mag AS m, lag(mag) OVER o AS a, lead(mag) OVER o AS b FROM md WINDOW o AS (PARTITION BY recording_id ORDER BY bin)),
 g AS (SELECT recording_id, count(*) FILTER (m > a AND m > b) AS p, count(*) FILTER (m < a AND m < b) AS v, avg(m) FILTER (m > a AND m > b) AS pm, avg(m) FILTER (m < a AND m < b) AS vm FROM n GROUP BY 1)
 SELECT recording_id, round(CASE WHEN p >= 3 AND v >= 3 THEN greatest(0, least(1, 1 - (pm / (vm + 1e-10)) / 15)) ELSE 0 END, 6) AS smearing FROM g""")
def harmonic_smearing(spark, sf):
    return r6(spectra.harmonic_smearing(_spectrum(spark, sf)))


MEL = f"""ed AS (SELECT i, 700 * (10 ** ((2595 * log10(1 + 8000 / 700.0)) * i / 9 / 2595) - 1) AS f FROM range(10) t(i)),
 fb AS (SELECT a.i AS mel, k AS bin, greatest(0, least((k * (8000.0 / 63) - a.f) / (b.f - a.f), (c.f - k * (8000.0 / 63)) / (c.f - b.f))) AS w FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed c ON c.i = a.i + 2, range(64) t(k)),
 me AS (SELECT recording_id, frame_idx, mel, ln(greatest(sum(w * mag), 1e-6)) AS e FROM spectrum JOIN fb USING (bin) WHERE w > 0 GROUP BY 1, 2, 3)"""


def _mels(spark, sf):
    return spectra.mel_energies(_spectrum(spark, sf), BINS, RATE, 8)


@query(f"WITH {SPECTRUM}, {MEL} SELECT recording_id, frame_idx, CAST(mel AS INTEGER) AS mel, round(e, 6) AS log_energy FROM me")
def mel_filterbank(spark, sf):
    return r6(_mels(spark, sf))


@query(f"WITH {SPECTRUM}, {MEL} SELECT recording_id, CAST(mel AS INTEGER) AS mel, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(quantile_cont(e, 0.25), 6) AS p25, round(quantile_cont(e, 0.75), 6) AS p75 FROM me GROUP BY 1, 2")
def stat_pooling(spark, sf):
    return r6(spectra.stat_pooling(_mels(spark, sf)))


DFT = f"""dx AS (SELECT recording_id, f AS frame_idx, idx - f * {HOP} AS pos, x FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - {SIZE - 1}) / {HOP}.0) AS BIGINT)), idx // {HOP} + 1)) AS f FROM signal)
 QUALIFY count(*) OVER (PARTITION BY recording_id, f) = {SIZE}),
 dp AS (SELECT recording_id, frame_idx, k, sum(x * cos(2 * pi() * k * pos / {SIZE})) ** 2 + sum(x * sin(2 * pi() * k * pos / {SIZE})) ** 2 AS power FROM dx, range({SIZE // 2 + 1}) t(k) GROUP BY 1, 2, 3)"""


def _power(spark, sf):
    s = _signal(spark, sf)
    whole = frames.frame_levels(s, SIZE, HOP).select("recording_id", "frame_idx")
    rows = frames.hop_frames(s, SIZE, HOP).select("recording_id", "frame_idx", (F.col("idx") - F.col("frame_idx") * HOP).alias("pos"), "x").join(whole, ["recording_id", "frame_idx"])
    return spectra.dft_power(rows, SIZE)


@query(f"WITH {SIGNAL}, {DFT} SELECT recording_id, frame_idx, CAST(k AS INTEGER) AS k, round(power, 6) + 0.0 AS power FROM dp")
def dft_power(spark, sf):
    return r6(_power(spark, sf))


@query(f"WITH {SIGNAL}, {DFT} SELECT recording_id, round(sum(power) FILTER (k BETWEEN 1 AND 2) / sum(power), 6) AS band_ratio FROM dp GROUP BY 1")
def band_energy_ratio(spark, sf):
    return r6(spectra.band_ratio(_power(spark, sf), 1, 2))


@query(f"""WITH {SIGNAL}, c AS (SELECT recording_id, least(floor(amp / (1.0 / 30)), 29) AS c, count(*) AS n FROM signal WHERE amp BETWEEN 0 AND 1 GROUP BY 1, 2),
 p AS (SELECT recording_id, n / sum(n) OVER (PARTITION BY recording_id) AS p FROM c) SELECT recording_id, round(sum(-p * log2(p)) / log2(30), 6) AS entropy FROM p GROUP BY 1""")
def histogram_entropy(spark, sf):
    return r6(spectra.histogram_entropy(_signal(spark, sf), "amp", 0.0, 1.0))


# Scalars


@query("SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(value, 6) AS hz FROM events")
def hz_mel(spark, sf):
    mel = X.hz_to_mel(F.col("value"))
    return r6(adapters.table(spark, sf, "events").select("event_id", mel.alias("mel"), X.mel_to_hz(mel).alias("hz")))


@query("SELECT event_id, round(CASE WHEN r >= 0.999 THEN 30 WHEN r <= 0.01 THEN 0 ELSE 10 * log10(r / (1 - r)) END, 6) AS hnr_db FROM (SELECT event_id, (event_id % 1001) / 1000.0 AS r FROM events)")
def hnr_case(spark, sf):
    return r6(adapters.table(spark, sf, "events").select("event_id", X.hnr_db((F.col("event_id") % 1001) / 1000.0).alias("hnr_db")))


@query("""WITH f AS (SELECT event_id, 300.0 + event_id % 500 AS f1, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2000.0 + event_id % 900 END AS f3, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 3000.0 + event_id % 1200 END AS f4 FROM events),
 s AS (SELECT event_id, CASE WHEN f4 > 0 THEN (f4 - f1) / 3 WHEN f3 > 0 THEN (f3 - f1) / 2 ELSE 1000 END AS s FROM f) SELECT event_id, round(s, 6) AS dispersion, round(greatest(10, least(25, 35000 / (2 * s))), 6) AS tract_cm FROM s""")
def vocal_tract(spark, sf):
    k = F.col("event_id")
    f3, f4 = F.when(k % 4 == 0, 0.0).otherwise(2000.0 + k % 900), F.when(k % 3 == 0, 0.0).otherwise(3000.0 + k % 1200)
    spacing, cm = X.vocal_tract_cm(300.0 + k % 500, f3, f4)
    return r6(adapters.table(spark, sf, "events").select("event_id", spacing.alias("dispersion"), cm.alias("tract_cm")))


@query("""WITH b AS (SELECT label, b AS j, floor(abs(CAST(embedding[b + 1] AS DOUBLE)) * 20000) AS f FROM embeddings, range(64) t(b)), a AS (SELECT label, f FROM b WHERE f BETWEEN 200 AND 5000),
 r AS (SELECT label, f, row_number() OVER (PARTITION BY label ORDER BY f) AS k FROM a) SELECT label, max(CASE WHEN k = 1 THEN f END) AS f1, max(CASE WHEN k = 2 THEN f END) AS f2, max(CASE WHEN k = 3 THEN f END) AS f3, max(CASE WHEN k = 4 THEN f END) AS f4 FROM r GROUP BY 1""")
def formant_pick(spark, sf):
    """The four lowest candidate frequencies in range, from an array of them."""
    found = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.abs(x) * 20000).cast("double"))
    own = F.slice(F.sort_array(F.filter(found, lambda f: f.between(200, 5000))), 1, 4)
    rows = adapters.table(spark, sf, "embeddings").select("label", F.explode_outer(own).alias("f"))
    # the limit on the rank is applied in each task before the shuffle, so a label sends four rows a task
    low = rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.asc_nulls_last("f")))).where("k <= 4")
    found = low.groupBy("label").agg(F.count("f").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("f"))).alias(f"f{k}") for k in range(1, 5)])
    return found.where("n > 0").drop("n")


@query("SELECT doc_id, len(list_filter(l, lambda x: NOT starts_with(x, 'None') AND NOT starts_with(x, 'No audio'))) AS kept FROM (SELECT doc_id, ['None found', source, 'No audio', lang, CASE WHEN doc_id % 2 = 0 THEN 'None' ELSE 'low jitter' END] AS l FROM documents)")
def indicator_filter(spark, sf):
    made = F.array(F.lit("None found"), F.col("source"), F.lit("No audio"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "None").otherwise("low jitter"))
    kept = F.filter(made, lambda x: ~(x.startswith("None") | x.startswith("No audio")))
    return adapters.table(spark, sf, "documents").select("doc_id", F.size(kept).cast("long").alias("kept"))


# Features and speakers


def _features(spark, sf):
    """(recording_id, features map): some features from event values, some missing or not finite."""
    k, v = F.col("event_id"), F.col("value")
    pairs = [F.lit("pitch_mean_f0"), v, F.lit("jitter_local_pct"), v / 100, F.lit("zcr_mean"), F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(v / 1000), F.lit("hnr_mean_db"), F.when(k % 7 == 0, F.lit(float("inf"))).otherwise(v / 20)]
    return adapters.table(spark, sf, "events").select(k.alias("recording_id"), F.create_map(*pairs).alias("features"))


NAMES = ["pitch_mean_f0", "jitter_local_pct", "zcr_mean", "hnr_mean_db", "cpp_mean_db"]
RAW = "raw AS (SELECT event_id AS recording_id, value AS f0, value / 100 AS f1, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 1000 END AS f2, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value / 20 END AS f3, 0.0 AS f4 FROM events)"
ZSCORES = f"""{RAW}, z AS (SELECT recording_id, greatest(-5, least(5, (f0 - 150) / 45)) AS z0, greatest(-5, least(5, (f1 - 0.75) / 0.4)) AS z1, greatest(-5, least(5, (f2 - 0.1) / 0.05)) AS z2, greatest(-5, least(5, (f3 - 18) / 6)) AS z3, greatest(-5, least(5, (f4 - 12) / 4)) AS z4 FROM raw)"""


@query(f"WITH {RAW} SELECT recording_id, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, CAST(f4 AS DOUBLE) AS f4 FROM raw")
def feature_vector(spark, sf):
    v = _features(spark, sf).select("recording_id", features.vectorize(F.col("features"), NAMES).alias("v"))
    return r6(v.select("recording_id", *[F.get("v", F.lit(k)).alias(f"f{k}") for k in range(5)]))


def _zscores(spark, sf):
    v = features.vectorize(F.col("features"), NAMES)
    return _features(spark, sf).select("recording_id", features.normalize(v, *features.baseline(NAMES)).alias("z"))


@query(f"WITH {ZSCORES} SELECT recording_id, round(z0, 6) AS z0, round(z1, 6) AS z1, round(z2, 6) AS z2, round(z3, 6) AS z3, round(z4, 6) AS z4 FROM z")
def zscore_clip(spark, sf):
    return r6(_zscores(spark, sf).select("recording_id", *[F.get("z", F.lit(k)).alias(f"z{k}") for k in range(5)]))


@query(f"""WITH {ZSCORES}, l AS (SELECT recording_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest({NAMES}) AS feature, round(unnest([z0, z1, z2, z3, z4]), 9) AS z FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY abs(z) DESC, pos DESC) AS rank FROM l) SELECT recording_id, CAST(rank AS INTEGER) AS rank, feature, round(z, 6) AS z, CASE WHEN abs(z) > 1.5 THEN 'Synthetic indicator' ELSE 'Within normal baseline' END AS impact FROM r WHERE rank <= 3""")
def top_features(spark, sf):
    long = _zscores(spark, sf).select("recording_id", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 9))
    named = long.withColumn("feature", F.element_at(F.array(*map(F.lit, NAMES)), F.col("pos") + 1))
    return r6(features.top_features(named, 3))


@query("SELECT event_type AS feature, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-4), 6) AS deviation FROM events GROUP BY 1")
def normalizer_fit(spark, sf):
    return r6(features.fit_normalizer(adapters.table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value")))


ENROLL = """s AS (SELECT 'spk_' || label AS speaker_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 u AS (SELECT speaker_id, k, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM s),
 en AS (WITH RECURSIVE r AS (SELECT speaker_id, k, e AS v FROM u WHERE k = 1 UNION ALL
  SELECT speaker_id, k, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM (SELECT u.speaker_id, u.k, list_transform(list_zip(r.v, u.e), lambda p: (p[1] * r.k + p[2]) / (r.k + 1)) AS w FROM r JOIN u ON u.speaker_id = r.speaker_id AND u.k = r.k + 1))
  SELECT speaker_id, k AS sample_count, v AS voiceprint FROM r QUALIFY k = max(k) OVER (PARTITION BY speaker_id))"""


def _registry(spark, sf):
    return speakers.enroll(adapters.voiceprints(spark, sf))


@query(f"WITH {ENROLL} SELECT speaker_id, sample_count, round(voiceprint[1], 6) + 0.0 AS v0, round(voiceprint[64], 6) + 0.0 AS v63, round(list_sum(list_transform(voiceprint, lambda x: x * x)), 6) AS norm FROM en")
def speaker_enroll(spark, sf):
    got = _registry(spark, sf)
    return r6(got.select("speaker_id", "sample_count", F.get("voiceprint", F.lit(0)).alias("v0"), F.get("voiceprint", F.lit(63)).alias("v63"), speakers.dot(F.col("voiceprint"), F.col("voiceprint")).alias("norm")))


@query(f"WITH {ENROLL} SELECT speaker_id, sample_count FROM en WHERE speaker_id <> 'spk_3'")
def speaker_list(spark, sf):
    """The registry without voiceprints, after one speaker is deleted."""
    return _registry(spark, sf).where("speaker_id <> 'spk_3'").select("speaker_id", "sample_count")


CLAIMS = f"""{ENROLL}, cl AS (SELECT vec_id AS claim_id, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 10 = 1 THEN '' WHEN vec_id % 10 = 2 THEN 'ghost' ELSE 'spk_' || (CASE WHEN vec_id % 3 = 0 THEN label ELSE (label + 1) % 10 END) END AS speaker_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 vc AS (SELECT claim_id, speaker_id, coalesce(speaker_id, '') = '' AS none, voiceprint, (list_sum(list_transform(list_zip(e, voiceprint), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(voiceprint, lambda x: x * x))) + 1) / 2 AS c FROM cl LEFT JOIN en USING (speaker_id)),
 vd AS (SELECT claim_id, speaker_id, none, voiceprint IS NULL AS unknown, CASE WHEN none THEN 1.0 WHEN voiceprint IS NULL THEN 0.0 ELSE c END AS s FROM vc)"""


def _claims(spark, sf):
    k, label = F.col("vec_id"), F.col("label")
    who = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "").when(k % 10 == 2, "ghost").otherwise(F.concat(F.lit("spk_"), F.when(k % 3 == 0, label).otherwise((label + 1) % 10).cast("string")))
    return adapters.table(spark, sf, "embeddings").select(k.alias("claim_id"), who.alias("speaker_id"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"WITH {CLAIMS} SELECT claim_id, speaker_id, none OR s >= 0.75 AS is_match, round(s, 6) AS similarity, NOT none AND s < 0.75 AS impersonation, round(CASE WHEN none THEN 0.5 WHEN unknown THEN 0.6 ELSE greatest(0, least(1, 0.6 + 0.8 * abs(s - 0.75))) END, 6) AS confidence FROM vd")
def speaker_claim_join(spark, sf):
    return r6(speakers.verify_claims(_claims(spark, sf), _registry(spark, sf)))


@query(f"WITH {CLAIMS} SELECT none, unknown, count(*) AS claims, round(avg(s), 6) AS mean_similarity FROM vd GROUP BY 1, 2")
def speaker_verify(spark, sf):
    got = speakers.verify_claims(_claims(spark, sf), _registry(spark, sf))
    none = F.coalesce(F.col("speaker_id"), F.lit("")) == ""
    return r6(got.groupBy(none.alias("none"), (none | (F.col("speaker_id") == "ghost")).alias("unknown")).agg(F.count("*").alias("claims"), F.avg("similarity").alias("mean_similarity")))


# Evaluation

LABELLED = "la AS (SELECT doc_id, toxic AS label, (doc_id * 37 % 101) / 100.0 * 0.6 + toxic * 0.4 AS score FROM labels)"


def _labelled(spark, sf):
    return adapters.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), ((F.col("doc_id") * 37) % 101 / 100.0 * 0.6 + F.col("toxic") * 0.4).alias("score"))


@query(f"""WITH {LABELLED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM la)
 SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr FROM c""")
def eval_confusion(spark, sf):
    return r6(evaluation.confusion(_labelled(spark, sf)))


@query("""WITH la AS (SELECT toxic AS label, round((doc_id * 37 % 101) / 100.0 * 0.6 + toxic * 0.4, 4) AS score FROM labels), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM la)
 SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label <> 1) AS negatives, round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) AS auc FROM r""")
def eval_auc(spark, sf):
    return r6(evaluation.roc_auc(_labelled(spark, sf).withColumn("score", F.round("score", 4))))


@query(f"""WITH {LABELLED}, c AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'ai' WHEN 2 THEN 'silence' ELSE 'ambiguous' END AS category, CASE doc_id % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'SYNTHETIC' ELSE 'NO_SPEECH' END AS verdict, score AS s FROM la)
 SELECT category, count(*) AS total, count(*) FILTER (CASE category WHEN 'human' THEN verdict = 'REAL' OR s < 0.4 WHEN 'ai' THEN verdict = 'SYNTHETIC' OR s >= 0.6 WHEN 'silence' THEN verdict = 'NO_SPEECH' ELSE s BETWEEN 0.4 AND 0.6 END) AS passed, round(avg(s), 6) AS mean_score FROM c GROUP BY 1""")
def eval_acceptance(spark, sf):
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("human", "ai", "silence", "ambiguous"))), (k % 4 + 1).cast("int"))
    verdict_ = F.element_at(F.array(*map(F.lit, ("REAL", "SYNTHETIC", "NO_SPEECH"))), (k % 3 + 1).cast("int"))
    return evaluation.acceptance(_labelled(spark, sf).withColumn("category", kind).withColumn("verdict", verdict_))


@query(f"WITH {SIGNAL} SELECT recording_id, count(*) AS n, round(median(amp), 6) AS median, round(stddev_pop(amp), 6) AS deviation, round(greatest(0, least(1, 1 - 2 * stddev_pop(amp))), 6) AS consistency FROM signal GROUP BY 1")
def window_consistency(spark, sf):
    return r6(evaluation.window_consistency(_signal(spark, sf).select("recording_id", F.col("amp").alias("score"))))


# The scoring cascade

STEPS = ", ".join(f"((o_orderkey * {k}) % 101) / 100.0 AS {n}" for n, k in adapters.SCORE_STEPS.items())
SCORES = f"""sc AS (SELECT o_orderkey AS recording_id, {STEPS}, CASE o_orderkey % 5 WHEN 0 THEN 'high_value_transaction' WHEN 1 THEN 'confidential_disclosure' WHEN 2 THEN 'standard_support' ELSE 'general_telephony' END AS scenario,
 ((o_orderkey * 17) % 61) / 10.0 AS duration_sec, ((o_orderkey * 11) % 101) / 100.0 + 0.000037 AS modality_confidence, ((o_orderkey * 23) % 101) / 100.0 AS consistency, ((o_orderkey * 13) % 101) / 100.0 AS window_range,
 (o_orderkey * 7) % 9 AS splice_points, (o_orderkey * 3) % 4 AS n_factors, ((o_orderkey * 19) % 101) / 100.0 AS similarity, o_orderkey % 3 = 0 AS has_claim, o_orderkey % 6 = 0 AS impersonation FROM orders)"""
FUSED = f"""{SCORES}, li AS (SELECT *, CAST(ml_detector * 0.75 + synthesis_artifacts * 0.08 + acoustic * 0.07 + spectral * 0.04 + prosody * 0.04 + phase * 0.02 AS DOUBLE) AS lin FROM sc),
 fu AS (SELECT *, CASE WHEN ml_detector < 0.25 THEN least(lin, greatest(ml_detector, lin * 0.1)) WHEN ml_detector >= 0.7 THEN greatest(lin, ml_detector) ELSE lin END AS held FROM li),
 rw AS (SELECT *, round(CASE WHEN impersonation AND has_claim THEN least(1, held + (1 - similarity) * 0.4) ELSE held END, 4) AS raw FROM fu)"""
CALIBRATED = f"""{FUSED}, ca AS (SELECT *, round(1 / (1 + exp(-(8 * raw - 5.2))), 4) AS probability, (SELECT count(*) FILTER (v >= 0.5) FROM (SELECT unnest([acoustic, spectral, prosody, synthesis_artifacts, phase, ml_detector]) AS v)) AS yes FROM rw),
 cb AS (SELECT *, greatest(yes, CASE WHEN yes >= 3 THEN yes ELSE 6 - yes END) / 6 AS agreement FROM ca),
 cf AS (SELECT *, 0.25 * (greatest(0.1, least(1, duration_sec / 3)) + agreement + modality_confidence + consistency) AS b FROM cb),
 cc AS (SELECT *, round(greatest(0.05, least(0.99, CASE WHEN window_range > 0.4 THEN b * greatest(0.5, 1 - (window_range - 0.4)) ELSE b END)), 4) AS confidence, CASE scenario WHEN 'high_value_transaction' THEN 0.70 WHEN 'standard_support' THEN 0.80 ELSE 0.75 END AS t FROM cf)"""
VERDICTS = f"""{CALIBRATED}, st AS (SELECT *, CAST(acoustic >= 0.55 AS INT) + CAST(spectral >= 0.55 AS INT) + CAST(prosody >= 0.55 AS INT) + CAST(synthesis_artifacts >= 0.55 AS INT) + CAST(phase >= 0.55 AS INT) AS k FROM cc),
 ve AS (SELECT *, CASE WHEN (probability >= 0.45 AND probability < t) OR (abs(probability - t) < 0.10 AND confidence < 0.65) THEN 'UNCERTAIN' WHEN splice_points >= 2 AND probability > 0.25 AND probability < 0.80 THEN 'MANIPULATED'
  WHEN probability >= t AND (probability >= 0.90 OR ml_detector >= 0.90 OR k >= 2 OR n_factors >= 2 OR ml_detector >= 0.85) THEN 'SYNTHETIC' WHEN probability >= t THEN 'UNCERTAIN' ELSE 'REAL' END AS verdict FROM st),
 ri AS (SELECT *, round(probability * 100, 1) AS risk, CASE WHEN verdict = 'SYNTHETIC' AND round(probability * 100, 1) >= 75 THEN 'CRITICAL' WHEN verdict IN ('SYNTHETIC', 'MANIPULATED') OR round(probability * 100, 1) >= 70 THEN 'HIGH'
  WHEN round(probability * 100, 1) >= 30 OR verdict = 'UNCERTAIN' OR (scenario = 'high_value_transaction' AND (round(probability * 100, 1) >= 5 OR raw >= 0.25)) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM ve)"""


def _scores(spark, sf):
    return adapters.scores(spark, sf)


@query(f"WITH {SCORES}, p AS (SELECT recording_id, acoustic AS voiced, spectral * 0.4 AS jit, prosody * 1.6 AS shi, phase * 60 AS hnr, synthesis_artifacts * 40 AS cm, duration_sec AS d FROM sc) SELECT recording_id, round(CASE WHEN voiced < 0.15 THEN 0 ELSE (CASE WHEN jit < 0.15 THEN 0.3 * least(1, (0.15 - jit) / 0.15 * 1.5) ELSE 0 END) + (CASE WHEN shi < 0.8 THEN 0.3 * least(1, (0.8 - shi) / 0.8 * 1.5) ELSE 0 END) + (CASE WHEN hnr > 35 THEN 0.2 * least(1, (hnr - 35) / 10) ELSE 0 END) + (CASE WHEN cm < 8 OR cm > 26 THEN 0.16 ELSE 0 END) END, 6) AS score, round(CASE WHEN voiced < 0.15 THEN least(0.4, d / 3) ELSE greatest(0, least(1, 0.5 + voiced * 0.4 + least(0.1, d / 10))) END, 6) AS confidence FROM p")
def anomaly_acoustic(spark, sf):
    c = F.col
    score, conf = scoring.acoustic_anomaly(c("acoustic"), F.lit(120.0), c("spectral") * 0.4, c("prosody") * 1.6, c("phase") * 60, c("synthesis_artifacts") * 40, c("duration_sec"))
    return r6(_scores(spark, sf).select("recording_id", score.alias("score"), conf.alias("confidence")))


@query(f"WITH {SCORES} SELECT recording_id, round((CASE WHEN splice_points >= 5 THEN 0.4 ELSE 0 END) + (CASE WHEN spectral > 0.65 THEN 0.35 * least(1, (spectral - 0.65) / 0.25) ELSE 0 END) + (CASE WHEN phase * 0.02 < 0.003 AND duration_sec > 1.5 THEN 0.2 ELSE 0 END), 6) AS score, round(0.6 + least(0.3, duration_sec / 5), 6) AS confidence FROM sc")
def anomaly_spectral(spark, sf):
    score, conf = scoring.spectral_anomaly(F.col("splice_points") >= 5, F.col("spectral"), F.col("phase") * 0.02, F.col("duration_sec"))
    return r6(_scores(spark, sf).select("recording_id", score.alias("score"), conf.alias("confidence")))


@query(f"WITH {SCORES}, p AS (SELECT recording_id, splice_points * 3 AS syl, prosody * 3 AS st, has_claim AS mono, phase * 10 AS npvi, duration_sec AS d FROM sc) SELECT recording_id, CAST(CASE WHEN syl = 0 OR st = 0 THEN 0 ELSE (CASE WHEN mono AND d >= 2 AND st < 1 THEN 0.54 ELSE 0 END) + (CASE WHEN d >= 5 AND syl >= 10 AND npvi > 0 AND npvi < 2 THEN 0.32 ELSE 0 END) END AS DOUBLE) AS score, round(CASE WHEN syl = 0 OR st = 0 THEN 0 ELSE 0.5 + least(0.4, d / 4) END, 6) AS confidence FROM p")
def anomaly_prosody(spark, sf):
    score, conf = scoring.prosody_anomaly(F.col("splice_points") * 3, F.col("prosody") * 3, F.col("has_claim"), F.col("phase") * 10, F.col("duration_sec"))
    return r6(_scores(spark, sf).select("recording_id", score.alias("score"), conf.alias("confidence")))


@query(f"WITH {SCORES}, p AS (SELECT recording_id, impersonation AS per, acoustic * 0.3 AS cb, splice_points AS sp, spectral * 50 AS j, duration_sec AS d FROM sc) SELECT recording_id, round(least(1, (CASE WHEN per THEN 0.5 WHEN cb > 0.12 THEN 0.5 * least(1, (cb - 0.12) / 0.08) ELSE 0 END) + (CASE WHEN sp >= 6 AND j > 24 THEN 0.5 * least(1, (sp - 5) * 0.25) ELSE 0 END)), 6) AS score, round(0.6 + least(0.3, d / 3), 6) AS confidence FROM p")
def anomaly_artifact(spark, sf):
    score, conf = scoring.artifact_anomaly(F.col("impersonation"), F.col("acoustic") * 0.3, F.col("splice_points"), F.col("spectral") * 50, F.col("duration_sec"))
    return r6(_scores(spark, sf).select("recording_id", score.alias("score"), conf.alias("confidence")))


@query(f"WITH {SCORES}, p AS (SELECT recording_id, acoustic * 0.2 AS c, 0.9 + spectral * 0.1 AS e, prosody * 8 AS r, duration_sec AS d FROM sc) SELECT recording_id, round((CASE WHEN c < 0.08 AND d > 1.5 THEN 0.6 * (1 - c / 0.08) ELSE 0 END) + (CASE WHEN e > 0.98 AND r > 6 THEN 0.32 ELSE 0 END), 6) AS score, round(0.6 + least(0.3, d / 3), 6) AS confidence FROM p")
def anomaly_phase(spark, sf):
    score, conf = scoring.phase_anomaly(F.col("acoustic") * 0.2, 0.9 + F.col("spectral") * 0.1, F.col("prosody") * 8, F.col("duration_sec"))
    return r6(_scores(spark, sf).select("recording_id", score.alias("score"), conf.alias("confidence")))


@query(f"WITH {SCORES} SELECT recording_id, round(CASE WHEN impersonation OR (has_claim AND prosody * 2 < 0.8) OR splice_points >= 4 OR (spectral * 0.2 > 0 AND spectral * 0.2 < 0.10 AND phase > 0 AND phase < 0.5) THEN greatest(ml_detector, 0.94) ELSE least(ml_detector, 0.008) END, 6) AS probability FROM sc")
def classifier_rules(spark, sf):
    p = scoring.classify(F.col("ml_detector"), F.col("impersonation"), F.lit(False), F.col("has_claim"), F.col("prosody") * 2, F.col("splice_points"), F.col("spectral") * 0.2, F.col("phase"))
    return r6(_scores(spark, sf).select("recording_id", p.alias("probability")))


def _assessed(spark, sf):
    return scoring.assess(_scores(spark, sf))


@query(f"WITH {FUSED} SELECT recording_id, CAST(raw AS DOUBLE) AS raw FROM rw")
def fusion(spark, sf):
    return _assessed(spark, sf).select("recording_id", "raw")


@query(f"WITH {CALIBRATED} SELECT recording_id, CAST(probability AS DOUBLE) AS probability, CASE WHEN probability < 0.2 THEN 'Clearly Human' WHEN probability < 0.4 THEN 'Mostly Human' WHEN probability < 0.6 THEN 'Ambiguous / Inconclusive' WHEN probability < 0.8 THEN 'Likely AI' WHEN probability < 0.95 THEN 'Strong AI Evidence' ELSE 'Extremely Strong AI Evidence' END AS category FROM cc")
def platt_calibration(spark, sf):
    return _assessed(spark, sf).select("recording_id", "probability", "category")


@query(f"WITH {CALIBRATED} SELECT recording_id, round(agreement, 6) AS agreement FROM cc")
def modality_agreement(spark, sf):
    return r6(_assessed(spark, sf).select("recording_id", "agreement"))


@query(f"WITH {CALIBRATED} SELECT recording_id, CAST(confidence AS DOUBLE) AS confidence FROM cc")
def confidence(spark, sf):
    return _assessed(spark, sf).select("recording_id", "confidence")


@query(f"WITH {VERDICTS} SELECT recording_id, scenario, verdict FROM ri")
def verdict(spark, sf):
    return _assessed(spark, sf).select("recording_id", "scenario", "verdict")


ACTION = "CASE risk_level WHEN 'CRITICAL' THEN 'BLOCK_TRANSACTION_AND_ESCALATE_TO_FRAUD_CELL' WHEN 'HIGH' THEN 'TRIGGER_STEP_UP_MFA_AND_VOICE_CALLBACK' WHEN 'MEDIUM' THEN 'ADVISE_SECONDARY_VERIFICATION' ELSE 'AUTHORIZE_STANDARD_PROCESSING' END"


@query(f"WITH {VERDICTS} SELECT recording_id, risk_level, {ACTION} AS action FROM ri")
def risk_tier(spark, sf):
    return _assessed(spark, sf).select("recording_id", "risk_level", "action")


@query(f"WITH {VERDICTS} SELECT sha1(CAST(recording_id AS VARCHAR)) AS alert_id, recording_id, risk_level, verdict, {ACTION} AS action, 'console,in_app,webhook' AS channels FROM ri WHERE risk_level <> 'LOW'")
def alerts(spark, sf):
    from ..schema import CHANNELS

    # a generator in place of a filter: a filter would be pushed down with the whole cascade copied into it
    got = _assessed(spark, sf).withColumn("kept", F.explode(F.when(F.col("risk_level") != "LOW", F.array(F.lit(1)))))
    return got.select(F.sha1(F.col("recording_id").cast("string")).alias("alert_id"), "recording_id", "risk_level", "verdict", "action", F.lit(",".join(CHANNELS)).alias("channels"))


@query(f"WITH {VERDICTS} SELECT scenario, verdict, risk_level, count(*) AS n, round(avg(probability), 6) AS mean_probability FROM ri GROUP BY 1, 2, 3")
def risk_summary(spark, sf):
    return r6(_assessed(spark, sf).groupBy("scenario", "verdict", "risk_level").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability")))


@query(f"WITH {VERDICTS} SELECT recording_id, verdict || '|' || risk_level || '|' || printf('%.4f', probability) AS report FROM ri")
def report_json(spark, sf):
    """The flat report, written as JSON and read back."""
    doc = F.to_json(F.struct("verdict", "risk_level", "probability"))
    back = F.from_json("doc", "verdict string, risk_level string, probability double")
    rows = _assessed(spark, sf).select("recording_id", doc.alias("doc")).select("recording_id", back.alias("r"))
    return rows.select("recording_id", F.concat_ws("|", "r.verdict", "r.risk_level", F.format_string("%.4f", "r.probability")).alias("report"))


@query(f"WITH {SCORES}, i AS (SELECT recording_id, list_filter([CASE WHEN spectral > 0.8 THEN 'cutoff' ELSE 'None' END, CASE WHEN phase > 0.9 THEN 'flat' ELSE 'No audio' END], lambda x: NOT starts_with(x, 'None') AND NOT starts_with(x, 'No audio')) AS l FROM sc) SELECT recording_id, len(l) > 0 AS detected, CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') ELSE 'Nothing unusual found.' END AS detail FROM i")
def api_indicators(spark, sf):
    found = F.filter(F.array(F.when(F.col("spectral") > 0.8, "cutoff").otherwise("None"), F.when(F.col("phase") > 0.9, "flat").otherwise("No audio")), lambda x: ~(x.startswith("None") | x.startswith("No audio")))
    rows = _scores(spark, sf).select("recording_id", found.alias("l"))
    return rows.select("recording_id", (F.size("l") > 0).alias("detected"), F.when(F.size("l") > 0, F.array_join("l", " ")).otherwise("Nothing unusual found.").alias("detail"))


GATES = f"{SCORES}, gt AS (SELECT recording_id, duration_sec AS sec, acoustic AS ratio, -70 + spectral * 60 AS rms, prosody * 0.03 AS peak FROM sc), gs AS (SELECT *, sec >= 0.25 AND ratio >= 0.05 AND rms > -55 AS sp FROM gt)"


def _gates(spark, sf):
    rows = _scores(spark, sf).select("recording_id", F.col("duration_sec").alias("sec"), F.col("acoustic").alias("ratio"), (F.col("spectral") * 60 - 70).alias("rms"), (F.col("prosody") * 0.03).alias("peak"))
    return rows.withColumn("sp", scoring.speech_gate(F.col("sec"), F.col("ratio"), F.col("rms")))


@query(f"WITH {GATES} SELECT recording_id, sp AS contains_speech FROM gs")
def speech_gate(spark, sf):
    return _gates(spark, sf).select("recording_id", F.col("sp").alias("contains_speech"))


@query(f"WITH {GATES} SELECT recording_id, CASE WHEN peak < 0.005 OR rms < -52 THEN 'silence' ELSE 'non-speech' END AS reason FROM gs WHERE NOT sp")
def no_speech_reason(spark, sf):
    return _gates(spark, sf).select("recording_id", scoring.no_speech_reason(F.col("sp"), F.col("peak"), F.col("rms")).alias("reason")).where("reason IS NOT NULL")


@query(f"WITH {GATES} SELECT recording_id, 'NO_SPEECH' AS verdict, 'LOW' AS risk_level, 'AWAIT_CALLER_SPEECH' AS action, CAST(0 AS DOUBLE) AS probability FROM gs WHERE NOT sp")
def no_speech(spark, sf):
    rows = _gates(spark, sf).where("NOT sp")
    return rows.select("recording_id", F.lit("NO_SPEECH").alias("verdict"), F.lit("LOW").alias("risk_level"), F.lit("AWAIT_CALLER_SPEECH").alias("action"), F.lit(0.0).alias("probability"))


@query(f"WITH {GATES} SELECT recording_id, CASE WHEN NOT sp OR peak < 0.015 OR ratio < 0.10 OR rms < -50 THEN CASE WHEN peak < 0.01 OR rms < -50 THEN 'silence' ELSE 'non-speech' END ELSE 'pass' END AS gate FROM gs")
def stream_gate(spark, sf):
    return _gates(spark, sf).select("recording_id", scoring.stream_gate(F.col("sp"), F.col("peak"), F.col("ratio"), F.col("rms")).alias("gate"))


VERIFY = f"""{FRAMES}, {HANGOVER}, {SEGMENTS}, {CHUNKS}, ov AS (SELECT c.recording_id, c.chunk_index, sum(least(s.end_idx, c.end_idx) - greatest(s.start_idx, c.start_idx)) AS o FROM ch c JOIN sg s
 ON c.recording_id = s.recording_id AND s.is_speech AND s.start_idx < c.end_idx AND c.start_idx < s.end_idx GROUP BY 1, 2),
 cs AS (SELECT recording_id, avg(round(least(1, coalesce(o, 0) / (end_idx - start_idx)), 3)) AS speech, count(*) AS chunks FROM ch LEFT JOIN ov USING (recording_id, chunk_index) GROUP BY 1),
 vp AS (SELECT recording_id, chunks, speech, round(1 / (1 + exp(-(8 * speech - 5.2))), 4) AS p FROM cs)"""


@query(f"WITH {VERIFY} SELECT recording_id, chunks, round(speech, 6) AS speech, CAST(p AS DOUBLE) AS probability, CASE WHEN speech < 0.05 THEN 'NO_SPEECH' WHEN p >= 0.45 AND p < 0.75 THEN 'UNCERTAIN' WHEN p >= 0.75 THEN 'SYNTHETIC' ELSE 'REAL' END AS verdict FROM vp")
def verify_recordings(spark, sf):
    """End to end: samples to frames, smoothed segments, chunks, overlap ratios, calibration and a verdict."""
    got = chunk_speech_ratio(spark, sf).groupBy("recording_id").agg(F.avg("speech_ratio").alias("speech"), F.count("*").alias("chunks"))
    p = F.round(scoring.calibrate(F.col("speech")), 4)
    unsure = (F.col("probability") >= 0.45) & (F.col("probability") < 0.75)
    out = got.withColumn("probability", p).withColumn("verdict", F.when(F.col("speech") < 0.05, "NO_SPEECH").when(unsure, "UNCERTAIN").when(F.col("probability") >= 0.75, "SYNTHETIC").otherwise("REAL"))
    return r6(out.select("recording_id", "chunks", "speech", "probability", "verdict"))
