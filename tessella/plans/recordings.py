"""Registered queries over the samples of recordings: analysis, filters, embeddings, training, calibration, and verdicts from them.

The recordings are the bytes of documents' texts as unsigned 8-bit samples at 16 kHz.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import analysis, blocks, embedding, features, frames, ingestion, recurrence, reports, training, whole
from ..schema import FEATURES
from ..sources import adapters, store, wav
from ..streaming import packets as packet_codec
from ..streaming import sinks
from ..streaming import windows as hopping
from . import scoring
from .catalog import ACTION, FRAMES, HOP, SIGNAL, SIZE, VERDICTS, _assessed, r6
from .records import folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NAMES = list(FEATURES)
#: High-pass that removes what is left of an offset; designed for 16 kHz.
DC_HIGH_PASS = kernels.butterworth(1, 20.0, analysis.RATE, "high")
BYTES = """s0 AS (SELECT doc_id AS recording_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text <> ''),
 s AS (SELECT recording_id, len(h) AS n, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS idx FROM s0), pcm AS (SELECT recording_id, n, idx, (('0x' || h)::INTEGER - 128) / 128.0 AS x FROM s)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def analysed_blocks(cut: DataFrame, parity: bool = True, size: int = analysis.SIZE) -> DataFrame:
    """recording_id, duration_sec and the 60 features of recordings in blocks, written; the frames they come from are deleted again."""
    spark = cut.sparkSession
    at, out = folder(spark, "analysis-frames"), folder(spark, "analysis")
    rows = analysis.frame_rows(cut, size)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(at)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    analysis.features(spark.read.schema(schema).parquet(at), parity=parity).write.parquet(out)
    drop(spark, at)
    return spark.read.parquet(out)


def analysed(contents: DataFrame, parity: bool = True, size: int = analysis.SIZE, names: list[str] | None = None) -> DataFrame:
    """recording_id, duration_sec and the named features, all 60 by default, of recordings (recording_id, content) of unsigned 8-bit samples, written.

    Recordings of up to `size` samples are measured where they are; only longer ones are cut into blocks that meet in shuffles.
    """
    spark, names = contents.sparkSession, list(names or NAMES)
    rows, n, out = blocks.dealt(contents), F.octet_length("content"), folder(spark, "analysis")
    whole.whole_features(rows.where(n.between(1, size)), names, parity).write.parquet(out)
    far = contents.where(n > size)
    if not far.isEmpty():
        cut = blocks.pcm_blocks(blocks.dealt(far), size, analysis.BEFORE, analysis.AFTER)
        analysed_blocks(cut, parity, size).select("recording_id", "duration_sec", *names).write.mode("append").parquet(out)
    return spark.read.parquet(out)


@query()
def analyse_recordings(spark, sf):
    """The five analysers' 60 features of every recording."""
    return r6(analysed(adapters.recordings(spark, sf)))


@query(f"""WITH {BYTES}, c AS (SELECT recording_id, n, idx // 160 AS f, sum(x * x) AS e, arg_min(x, idx) AS a, arg_max(x, idx) AS z FROM pcm WHERE idx < n // 160 * 160 GROUP BY 1, 2, 3),
 j AS (SELECT recording_id, abs(20 * log10(sqrt(e / 160) + 1e-8) - lag(20 * log10(sqrt(e / 160) + 1e-8)) OVER w) AS d, abs(a - lag(z) OVER w) AS t FROM c WHERE n >= 640 WINDOW w AS (PARTITION BY recording_id ORDER BY f)),
 g AS (SELECT recording_id, n, f, e + lead(e) OVER w + lead(e, 2) OVER w AS e FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY f)),
 p AS (SELECT recording_id, e, e / (sum(e) OVER (PARTITION BY recording_id) + 1e-8) AS p FROM g WHERE f <= (n - 480) // 160 AND f < 50), h AS (SELECT recording_id, sum(CASE WHEN e > 0 THEN -p * log2(p + 1e-12) END) AS h FROM p GROUP BY 1),
 a AS (SELECT recording_id, count(*) FILTER (d > 18) AS k, max(d) AS d, max(t) * pi() AS t FROM j GROUP BY 1), r AS (SELECT recording_id, max(n) AS n, max(abs(x)) AS peak FROM pcm GROUP BY 1)
 SELECT r.recording_id, r.n AS num_samples, CASE WHEN peak >= 0.015 THEN round(coalesce(h, 0), 3) ELSE 0 END AS energy_entropy, CASE WHEN peak >= 0.015 THEN CAST(coalesce(k, 0) AS DOUBLE) ELSE 0 END AS artifact_splice_points,
 CASE WHEN peak >= 0.015 THEN round(coalesce(d, 0), 2) ELSE 0 END AS artifact_max_energy_jump_db, CASE WHEN peak >= 0.015 THEN round(coalesce(t, 0), 3) ELSE 0 END AS artifact_max_phase_jump_rad FROM r LEFT JOIN h USING (recording_id) LEFT JOIN a USING (recording_id)""")
def analysis_time_domain(spark, sf):
    """Those of the analysers' features that SQL can state over samples."""
    names = ["energy_entropy", "artifact_splice_points", "artifact_max_energy_jump_db", "artifact_max_phase_jump_rad"]
    got = analysed(adapters.recordings(spark, sf), parity=False, names=names)
    return r6(got.select("recording_id", F.round(F.col("duration_sec") * analysis.RATE).cast("long").alias("num_samples"), *names))


@query()
def analysis_vector(spark, sf):
    """The five analysers' maps of a recording united as a vector, normalised, with the five features that stand out."""
    maps = analysis.feature_maps(analysed(adapters.recordings(spark, sf)))
    rows = maps.select("recording_id", analysis.vector(maps).alias("v"))
    rows = rows.select("recording_id", "v", features.normalize(F.col("v"), *features.baseline(NAMES)).alias("z"))
    return rows.select("recording_id", "v", "z", features.top_names(F.col("z"), NAMES).alias("top"))


def _flag(name: str):
    return F.col(name) > 0.5


def analyser_scores() -> dict:
    """(anomaly score, confidence) of each analyser, from its features."""
    f, flag, sec = {c: F.col(c) for c in FEATURES}, _flag, F.col("duration_sec")
    return {
        "acoustic": scoring.acoustic_anomaly(f["pitch_voiced_fraction"], f["pitch_mean_f0"], f["jitter_local_pct"], f["shimmer_local_pct"], f["hnr_mean_db"], f["vocal_tract_length_cm"], sec),
        "spectral": scoring.spectral_anomaly(flag("has_artificial_cutoff"), f["spectral_flatness_mean"], f["spectral_flux_mean"], sec),
        "prosody": scoring.prosody_anomaly(f["prosody_syllable_count"], f["prosody_f0_range_semitones"], flag("prosody_is_monotone"), f["prosody_npvi"], sec),
        "synthesis_artifacts": scoring.artifact_anomaly(flag("artifact_periodic_detected"), f["artifact_checkerboard_ratio"], f["artifact_splice_points"], f["artifact_max_energy_jump_db"], sec),
        "phase": scoring.phase_anomaly(f["phase_if_clustering"], f["phase_dispersion_entropy"], f["phase_roughness"], sec),
    }


#: What scores, the classifier and the speech gate read of the features, and what the summaries print besides.
SCORED = ["pitch_voiced_fraction", "pitch_mean_f0", "jitter_local_pct", "shimmer_local_pct", "hnr_mean_db", "vocal_tract_length_cm", "has_artificial_cutoff", "spectral_flatness_mean", "spectral_flux_mean",
          "prosody_syllable_count", "prosody_f0_range_semitones", "prosody_is_monotone", "prosody_npvi", "artifact_periodic_detected", "artifact_checkerboard_ratio", "artifact_splice_points",
          "artifact_max_energy_jump_db", "phase_if_clustering", "phase_dispersion_entropy", "phase_roughness"]
PRINTED = [c for c in NAMES if any(c in value for _, _, lines in reports.SUMMARIES.values() for _, values in lines for value in values)]


def verdicts(table: DataFrame, probability: DataFrame | None = None, scenario: str = "general_telephony") -> DataFrame:
    """What `scoring.assess` makes of the analysers' features: five anomaly scores, the clamped classifier, fusion, calibration, verdict, risk and action.

    `probability` (recording_id, probability) is a network's; without one its score is 0.5 before the rules clamp it. Recordings without a voiced quarter
    second are NO_SPEECH and score 0, and so are those under the analysers' gate. There is one window, so windows agree.
    """
    f, flag, sec, pairs = {c: F.col(c) for c in FEATURES}, _flag, F.col("duration_sec"), analyser_scores()
    rows = table if probability is None else table.join(probability.select("recording_id", "probability"), "recording_id", "left")
    p = F.lit(0.5) if probability is None else F.coalesce("probability", F.lit(0.5))
    ml = scoring.classify(p, flag("artifact_periodic_detected"), flag("has_artificial_cutoff"), flag("prosody_is_monotone"), f["prosody_f0_range_semitones"], f["artifact_splice_points"], f["jitter_local_pct"], f["shimmer_local_pct"])
    factors = F.filter(F.array(*[F.when(score >= 0.3, name) for name, (score, _) in pairs.items()]), lambda x: x.isNotNull())
    voiced = f["pitch_voiced_fraction"] * sec
    scored = rows.select(
        "recording_id", sec, *[F.round(score, 4).alias(name) for name, (score, _) in pairs.items()], F.round(ml, 4).alias("ml_detector"), F.lit(scenario).alias("scenario"),
        (sum((c for _, c in pairs.values()), F.lit(0.0)) / len(pairs)).alias("modality_confidence"), F.lit(1.0).alias("consistency"), F.lit(0.0).alias("window_range"), f["artifact_splice_points"].alias("splice_points"),
        factors.alias("factors"), F.size(factors).alias("n_factors"), F.lit(1.0).alias("similarity"), F.lit(False).alias("has_claim"), F.lit(False).alias("impersonation"), (voiced >= 0.25).alias("speech"),
    )
    out = scoring.assess(scored)
    quiet = {"probability": F.lit(0.0), "confidence": F.lit(0.0), "verdict": F.lit("NO_SPEECH"), "risk_level": F.lit("LOW"), "action": F.lit("AWAIT_CALLER_SPEECH"), "category": F.lit("No speech")}
    return out.select(
        "recording_id", "duration_sec", *pairs, "ml_detector", *[F.when(F.col("speech"), F.col(c)).otherwise(v).alias(c) for c, v in quiet.items()], "factors",
    )


@query()
def verify_samples(spark, sf):
    """End to end from samples: analysis, anomaly scores, classifier, fusion, calibration, verdict, risk and action of every recording."""
    return r6(verdicts(analysed(adapters.recordings(spark, sf), names=SCORED)))


@query()
def chunk_voice(spark, sf):
    """Voice activity of the sliding chunks of every recording, 3 s long and 1 s apart; chunks without speech are left out."""
    size, hop, least = 3 * analysis.RATE, analysis.RATE, analysis.RATE // 2
    contents = adapters.recordings(spark, sf)
    lengths = contents.select("recording_id", F.octet_length("content").cast("long").alias("n")).where("n > 0")
    chunks = frames.sliding_chunks(lengths, size, hop, least)
    rows = chunks.join(contents, "recording_id").select("recording_id", "chunk_index", "start_idx", "end_idx", "is_padded", F.expr("substring(content, int(start_idx + 1), int(end_idx - start_idx))").alias("content"))
    return r6(blocks.voice(rows).where("speech_ratio > 0"))


@query(f"""WITH {VERDICTS} SELECT recording_id, risk_level, printf('%s (%.1f/100) %s', verdict, CAST(risk AS DOUBLE), {ACTION}) || ' | Factors: f' || (recording_id % 5) AS shown FROM ri WHERE risk_level <> 'LOW'""")
def alert_stream(spark, sf):
    """Alerts of a stream of verdicts in several batches; its last batch is run once more, as after a failure, and changes nothing."""
    at = folder(spark, "alert-stream")
    rows = _assessed(spark, sf).withColumn("factors", F.array(F.concat(F.lit("f"), (F.col("recording_id") % 5).cast("string"))))
    rows = rows.select("recording_id", "verdict", "probability", "risk_level", "action", "factors")
    rows.repartition(6, "recording_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    sinks.alert_sink(stream, f"{at}/alerts", f"{at}/progress").awaitTermination()
    last = stream_batches(spark, f"{at}/progress")
    drop(spark, f"{at}/progress/commits/{last}")
    sinks.alert_sink(stream, f"{at}/alerts", f"{at}/progress").awaitTermination()
    out = sinks.read_sink(spark, f"{at}/alerts", "recording_id long, verdict string, probability double, risk_level string, action string, factors array<string>, line string")
    shown = reports.console_line(F.col("verdict"), F.round(F.col("probability") * 100, 1), F.col("action"), F.col("factors"))
    return out.select("recording_id", "risk_level", shown.alias("shown"))


def stream_batches(spark, progress: str) -> int:
    """The number of a stream's last committed batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits")
    return max(int(f.getPath().getName()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().isdigit())


LE = "substr(printf('%08x', {0}), 7, 2) || substr(printf('%08x', {0}), 5, 2) || substr(printf('%08x', {0}), 3, 2) || substr(printf('%08x', {0}), 1, 2)"
HEADER = "52494646", "57415645666D7420100000000100010080BB000080BB00000100080064617461"


def wav_files(spark, sf) -> DataFrame:
    """(audio_id, path, content): documents' bytes in WAV files of 8 bits at 48 kHz; a document without text is an empty file."""
    n = F.octet_length("text")
    le = lambda v: F.unhex(F.regexp_replace(F.lpad(F.hex(v.cast("long")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    head = lambda h: F.unhex(F.lit(h))
    content = F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(head(HEADER[0]), le(n + 36), head(HEADER[1]), le(n), F.encode("text", "UTF-8"))).otherwise(F.lit(b""))
    return adapters.table(spark, sf, "documents").select(F.col("doc_id").alias("audio_id"), F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit("/a.WAV")).alias("path"), content.alias("content"))


@query(f"""WITH fs AS (SELECT doc_id AS audio_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN ''::BLOB ELSE unhex('{HEADER[0]}' || {LE.format("strlen(text) + 36")} || '{HEADER[1]}' || {LE.format("strlen(text)")}) || encode(text) END AS c FROM documents)
 SELECT audio_id, audio_id || '_forensic.wav' AS archived_as, sha256(c) AS sha256, md5(c) AS md5, CASE WHEN t = '' THEN 0 ELSE strlen(t) + 44 END AS n_bytes, true AS verified, CASE WHEN t <> '' THEN strlen(t) END AS source_samples, CASE WHEN t <> '' THEN 48000 END AS source_rate,
 CASE WHEN t <> '' THEN 1 END AS channels, CASE WHEN t <> '' THEN 8 END AS bit_depth, CASE WHEN t <> '' THEN (strlen(t) + 2) // 3 END AS num_samples, CASE WHEN t <> '' THEN CASE WHEN (strlen(t) + 2) // 3 < 8000 THEN 0 WHEN (strlen(t) + 2) // 3 < 48000 THEN 1 ELSE ((strlen(t) + 2) // 3 - 48000) // 16000 + 1
 + CASE WHEN ((strlen(t) + 2) // 3 - 48000) % 16000 > 0 AND (strlen(t) + 2) // 3 - (((strlen(t) + 2) // 3 - 48000) // 16000 + 1) * 16000 >= 8000 THEN 1 ELSE 0 END END END AS chunks, t = '' AS failed FROM fs""")
def ingest_files(spark, sf):
    """Files to records in one flow: hashes and archive, decoding, downmix, offset, resampling, loudness, voice activity and chunks; unreadable files are errors."""
    got = ingestion.ingest(wav_files(spark, sf), folder(spark, "archive"))
    count = lambda c, name: F.when(F.col(c).isNotNull(), F.size(c).cast("long")).alias(name)
    return got.select("audio_id", "archived_as", "sha256", "md5", "n_bytes", "verified", "source_samples", "source_rate", "channels", "bit_depth", count("samples", "num_samples"), count("chunks", "chunks"), F.col("error").isNotNull().alias("failed"))


@query()
def ingest_voice(spark, sf):
    """Of every file that can be read, level, speech and silence after clean-up, and its chunks with speech."""
    got = ingestion.records(blocks.dealt(wav_files(spark, sf), "audio_id")).where("error IS NULL")
    spoken = F.size(F.filter("chunks", lambda c: c["speech_ratio"] > 0.05)).cast("long")
    return r6(got.select("audio_id", "peak_dbfs", "rms_dbfs", "is_clipped", "speech_sec", "silence_sec", "speech_ratio", F.size("segments").alias("segments"), spoken.alias("speech_chunks")))


@query()
def analysis_summaries(spark, sf):
    """The five analysers' findings on every recording as text."""
    scores = analyser_scores()
    table = analysed(adapters.recordings(spark, sf), names=[c for c in NAMES if c in SCORED or c in PRINTED])
    return table.select("recording_id", *[reports.summary(name, score, sure, F.filter(F.array(F.when(score >= 0.3, f"{name} anomaly")), lambda x: x.isNotNull())).alias(name) for name, (score, sure) in scores.items()])


@query(f"""WITH {SIGNAL}, p AS (SELECT recording_id, idx // 10 AS seq, idx, round_even(greatest(-1, least(1, x)) * 32767, 0) / 32768 AS x FROM signal)
 SELECT CAST(recording_id AS VARCHAR) AS session_id, seq, count(*) AS n, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, CASE WHEN max(abs(x)) < 0.01 OR 20 * log10(greatest(sqrt(avg(x * x)), 1e-7)) < -50 THEN 'silence' WHEN max(abs(x)) < 0.015 THEN 'non-speech' ELSE 'pass' END AS gate FROM p GROUP BY 1, 2""")
def packet_gate(spark, sf):
    """Packets of bytes, each with its own encoding, decoded and gated without state."""
    s = adapters.signal(spark, sf)
    packets = s.groupBy(F.col("recording_id").cast("string").alias("session_id"), F.floor(F.col("idx") / 10).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    sent = packets.select("session_id", "seq", packet_codec.encoded(F.col("s.x"), F.lit("int16")).alias("payload"), F.lit("int16").alias("encoding"))
    got = sent.select("session_id", "seq", packet_codec.decoded(F.col("payload"), F.col("encoding")).alias("x"))
    n, square = F.size("x"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    levels = got.select("session_id", "seq", n.cast("long").alias("n"), F.array_max(F.transform("x", F.abs)).alias("peak"), F.sqrt(square / n).alias("rms"))
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-7)))
    return r6(levels.withColumn("gate", scoring.stream_gate(F.lit(True), F.col("peak"), F.lit(1.0), db)))


def live_verdicts(windows: DataFrame, probability: DataFrame | None = None, scenario: str = "general_telephony") -> DataFrame:
    """The fast lane over a batch of windows (session_id, window_no, samples, peak, rms, speech_ratio): the gate, then analysis, classifier, fusion, calibration and
    assessment of each window that passes, on its own. Windows that do not pass score 0 and are not analysed. Nothing is alerted here. Windows that were measured where
    they were cut come with (n, v), the SCORED features, in place of samples.
    """
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-7)))
    gate = scoring.stream_gate(F.col("speech_ratio") > 0, F.col("peak"), F.col("speech_ratio"), db)
    rows = windows.withColumn("gate", gate).withColumn("recording_id", F.xxhash64("session_id", "window_no"))
    open_ = rows.where("gate = 'pass'")
    if "v" in windows.columns:
        table = whole.table(open_, SCORED)
    else:
        table = analysed_blocks(blocks.array_blocks(open_.select("recording_id", "samples"), analysis.SIZE, analysis.BEFORE, analysis.AFTER))
    found = verdicts(table, probability, scenario).drop("duration_sec")
    got = rows.select("session_id", "window_no", "start_idx", "gate", "speech_ratio", "received_ms", "recording_id").join(found, "recording_id", "left").drop("recording_id")
    quiet = {"probability": F.lit(0.0), "confidence": F.lit(0.0), "verdict": F.lit("NO_SPEECH"), "risk_level": F.lit("LOW"), "action": F.lit("AWAIT_CALLER_SPEECH"), "category": F.lit("No speech"), "factors": F.array().cast("array<string>")}
    return got.withColumns({c: F.coalesce(c, v) for c, v in quiet.items()})


@query()
def stream_verify(spark, sf):
    """A stream of packets to verdicts from samples: windows of a second, each 0.5 s, gated by voice and verified on their own; a batch that runs again replaces itself.

    A session's last packet ends it, so no state is left of it. Packets stay the bytes they are until a window is cut, and windows are measured there, so neither files nor
    tasks hold samples as doubles beyond one session's; a batch's windows are cut once and written before they are judged.
    """
    at = folder(spark, "stream-verify")
    contents = adapters.recordings(spark, sf).where("content IS NOT NULL")
    last = F.greatest(F.floor((F.octet_length("content") - 1) / 4000), F.lit(0)).cast("int")
    rows = contents.select(F.col("recording_id").cast("string").alias("session_id"), "content", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    rows = rows.select("session_id", F.col("seq").cast("long").alias("seq"), F.lit(analysis.RATE).alias("sample_rate"), F.expr("substring(content, seq * 4000 + 1, 4000)").alias("payload"), F.lit("uint8").alias("encoding"), (F.col("seq") == F.col("last")).alias("end"))
    rows.write.parquet(f"{at}/packets")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/packets")
    cut = hopping.hopping_windows(stream, analysis.RATE, analysis.RATE // 2, voice=True, measure=SCORED)

    def verify(batch: DataFrame, n: int) -> None:
        sinks.write_batch(batch, n, f"{at}/windows")
        sinks.write_batch(live_verdicts(batch.sparkSession.read.schema(batch.schema).parquet(f"{at}/windows/batch={n}")), n, f"{at}/verdicts")
        drop(spark, f"{at}/windows/batch={n}")

    run = cut.writeStream.foreachBatch(verify).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    names = "session_id string, window_no long, start_idx long, gate string, speech_ratio double, probability double, verdict string, risk_level string, action string"
    return r6(sinks.read_sink(spark, f"{at}/verdicts", names).drop("batch"))


@query("""SELECT doc_id AS audio_id, CASE WHEN coalesce(text, '') = '' THEN 'unreadable' ELSE 'WAV' END AS container, CASE WHEN coalesce(text, '') <> '' THEN 48000 END AS rate, CASE WHEN coalesce(text, '') <> '' THEN 1 END AS channels,
 CASE WHEN coalesce(text, '') <> '' THEN 8 END AS bits, CASE WHEN coalesce(text, '') <> '' THEN strlen(text) END AS num_samples, CASE WHEN coalesce(text, '') <> '' THEN 384.0 END AS bitrate_kbps FROM documents""")
def container_probe(spark, sf):
    """What the headers of files say, without their samples; files without a header are unreadable."""
    got = wav.probe(wav_files(spark, sf).select("audio_id", F.substring("content", 1, 4096).alias("head"), F.octet_length("content").cast("long").alias("size")))
    return got.select("audio_id", "container", "rate", "channels", "bits", F.round(F.col("duration_sec") * F.col("rate")).cast("long").alias("num_samples"), "bitrate_kbps")


@query(f"""WITH {VERDICTS}, v AS (SELECT count(*) AS verdicts, count(*) FILTER (verdict = 'SYNTHETIC') AS synthetic, count(*) FILTER (risk_level <> 'LOW') AS alerts FROM ri) SELECT (SELECT count(DISTINCT label) FROM embeddings) AS speakers, (SELECT count(*) FROM embeddings) AS enrolments, verdicts, synthetic, alerts FROM v""")
def service_stats(spark, sf):
    """How much the service holds and has decided."""
    speakers = adapters.voiceprints(spark, sf).agg(F.count_distinct("speaker_id").alias("speakers"), F.count("*").alias("enrolments"))
    made = _assessed(spark, sf).agg(F.count("*").alias("verdicts"), F.count_if(F.col("verdict") == "SYNTHETIC").alias("synthetic"), F.count_if(F.col("risk_level") != "LOW").alias("alerts"))
    return speakers.withColumn("k", F.lit(1)).join(made.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


K = "tan(pi() * 20 / 16000)"


@query(f"""WITH RECURSIVE {SIGNAL}, m AS (SELECT recording_id, count(*) AS n, avg(x) AS mean FROM signal GROUP BY 1), c AS MATERIALIZED (SELECT recording_id, idx, n, x - mean AS x FROM signal JOIN m USING (recording_id)),
 r AS (SELECT recording_id, idx, n, x, x / (1 + {K}) AS y FROM c WHERE idx = 0 AND n > 64 UNION ALL SELECT c.recording_id, c.idx, c.n, c.x, (c.x - r.x) / (1 + {K}) - ({K} - 1) / ({K} + 1) * r.y FROM r JOIN c ON c.recording_id = r.recording_id AND c.idx = r.idx + 1)
 SELECT recording_id, idx, round(y, 6) AS x FROM r UNION ALL SELECT recording_id, idx, round(x, 6) FROM c WHERE n <= 64""")
def dc_high_pass(spark, sf):
    """Offset removal: the mean, then a recursive high-pass whose state runs on from block to block of 32 samples."""
    return r6(recurrence.remove_dc(adapters.signal(spark, sf), DC_HIGH_PASS, 32))


@query(f"""WITH {FRAMES}, p AS (SELECT recording_id, frame_idx, db, lag(db) OVER w AS a, lead(db) OVER w AS b FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)),
 k AS (SELECT * FROM p WHERE db > a AND db > b AND db >= -30), e AS (SELECT k.recording_id, k.frame_idx, k.db, max(q.frame_idx) FILTER (q.db > k.db AND q.frame_idx < k.frame_idx) AS l, min(q.frame_idx) FILTER (q.db > k.db AND q.frame_idx > k.frame_idx) AS r FROM k JOIN lv q USING (recording_id) GROUP BY 1, 2, 3),
 s AS (SELECT e.recording_id, e.frame_idx, e.db, e.db - greatest(min(q.db) FILTER (q.frame_idx <= e.frame_idx AND q.frame_idx > coalesce(l, -1)), min(q.db) FILTER (q.frame_idx >= e.frame_idx AND q.frame_idx < coalesce(r, 1000000))) AS prominence FROM e JOIN lv q USING (recording_id) GROUP BY 1, 2, 3)
 SELECT recording_id, frame_idx, round(db, 6) AS db, round(prominence, 6) AS prominence FROM s WHERE prominence >= 0.5""")
def level_peaks(spark, sf):
    """Peaks of recordings' levels with their prominence."""
    levels = frames.frame_levels(adapters.signal(spark, sf), SIZE, HOP)
    return r6(analysis.level_peaks(levels, -30.0, 1, 0.5))


@query()
def voice_embedding(spark, sf):
    """Embeddings of recordings: pooled mel bands, projected by the seeded matrix."""
    size = 1280 * 16
    return r6(embedding.voice_embeddings(blocks.pcm_blocks(adapters.recordings(spark, sf), size, 0, embedding.FFT), size))


RULE = "sin(12.9898 * (i * 16 + j + 1)) / sqrt(80)"


@query("""WITH spectrum AS (SELECT label AS recording_id, vec_id AS frame_idx, b AS bin, ln(greatest(abs(CAST(embedding[b + 1] AS DOUBLE)), 1e-5)) AS v FROM embeddings, range(20) t(b)),
 q AS (SELECT recording_id, bin, avg(v) AS a, stddev_pop(v) AS s, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM spectrum GROUP BY 1, 2),
 pooled AS (SELECT recording_id, bin AS i, a AS value FROM q UNION ALL SELECT recording_id, bin + 20, s FROM q UNION ALL SELECT recording_id, bin + 40, lo FROM q UNION ALL SELECT recording_id, bin + 60, hi FROM q),
 m AS (SELECT i, j, sin(12.9898 * (i * 16 + j + 1)) / sqrt(80) AS w FROM range(80) a(i), range(16) b(j)), p AS (SELECT recording_id, j, sum(value * w) AS value FROM pooled JOIN m USING (i) GROUP BY 1, 2)
 SELECT recording_id, j, round(value / sqrt(sum(value * value) OVER (PARTITION BY recording_id)), 6) AS value FROM p""")
def embedding_projection(spark, sf):
    """Pooled statistics times a matrix, at length one; the matrix here follows a rule that SQL can state."""
    spectrum = adapters.spectrum(spark, sf).where("bin < 20")
    mels = spectrum.select("recording_id", "frame_idx", F.col("bin").alias("mel"), F.log(F.greatest("mag", F.lit(1e-5))).alias("log_energy"))
    ids = spark.range(80).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return r6(embedding.project(embedding.pooled_rows(mels, 20), ids.withColumn("w", F.expr(RULE))))


def training_rows(spark, sf, at: str, size: int = analysis.SIZE) -> DataFrame:
    """(source, features, label) of labelled recordings, each also louder or softer and with noise, written at `at`; copies share their recording's source.

    What is added follows from the recording's number, so a run repeats. Copies are made and measured in the task that holds their recording; only recordings over
    `size` samples are copied as rows and cut into blocks.
    """
    parts = 4 * spark.sparkContext.defaultParallelism  # by number, as a small table is a lot of work
    labels = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("recording_id"), F.col("quality").alias("label")).repartition(parts, "recording_id").dropDuplicates(["recording_id"])
    contents = adapters.recordings(spark, sf).where(F.octet_length("content") > 0)
    n, v = F.octet_length("content"), features.normalize(F.array(*NAMES), *features.baseline(NAMES))
    near = contents.where(n <= size).repartition(parts, "recording_id").join(labels.hint("shuffle_hash"), "recording_id")
    table = whole.whole_features(near, copies=lambda source, raw: [blocks.changed(raw, kind, source) for kind in range(3)])
    table.select(F.col("recording_id").alias("source"), v.alias("features"), "label").write.parquet(at)
    far = contents.where(n > size)
    if not far.isEmpty():
        own = far.join(labels, "recording_id").select(F.col("recording_id").alias("source"), "content", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("kind"))
        own = own.select((F.col("source") * 3 + F.col("kind")).alias("recording_id"), blocks.augmented("content", "kind", "source").alias("content"))
        table = analysed(own, size=size).select(F.floor(F.col("recording_id") / 3).alias("recording_id"), v.alias("features"))
        table.join(labels, "recording_id").select(F.col("recording_id").alias("source"), "features", "label").write.mode("append").parquet(at)
    return spark.read.parquet(at)


@query()
def detector_training(spark, sf):
    """The network fitted to labelled recordings: losses and accuracy of each epoch, and whether the stored parameters score as the fitted ones."""
    at, root = folder(spark, "training"), folder(spark, "parameters")
    rows = training_rows(spark, sf, at)
    fit = training.train(rows, training.new_network(), epochs=6, rate=3e-3)
    store.save(spark, root, fit.parameters)
    version, back = store.load(spark, root)
    same = math.isclose(training.sums(rows, back, gradient=False)[0], training.sums(rows, fit.parameters, gradient=False)[0], rel_tol=1e-12)  # tasks' sums meet in any order
    drop(spark, at)
    return spark.createDataFrame([(int(h["epoch"]), h["train_loss"], h["val_loss"], h["val_accuracy"], int(h["n_train"]), int(h["n_val"]), version, same) for h in fit.history], "epoch long, train_loss double, val_loss double, val_accuracy double, n_train long, n_val long, version long, stored_equal boolean")


def _newton(steps: int) -> str:
    """Newton's steps as a chain of tables with slope and offset."""
    out = ["d AS MATERIALIZED (SELECT ((o_orderkey * 61) % 101) / 100.0 AS s, CAST(((o_orderkey * 61) % 101 + (o_custkey * 7) % 40) > 70 AS INT) AS y FROM orders), t0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"""g{k} AS (SELECT a, b, sum(p - y) AS gb, sum((p - y) * s) + a AS ga, sum(p * (1 - p)) AS hb, sum(p * (1 - p) * s) AS hx, sum(p * (1 - p) * s * s) + 1 AS ha FROM (SELECT a, b, s, y, 1 / (1 + exp(-(a * s + b))) AS p FROM d, t{k}) GROUP BY a, b),
 t{k + 1} AS MATERIALIZED (SELECT a - (hb * ga - hx * gb) / (ha * hb - hx * hx) AS a, b - (ha * gb - hx * ga) / (ha * hb - hx * hx) AS b FROM g{k})""")
    return "WITH " + ", ".join(out) + f" SELECT round(a, 4) AS a, round(b, 4) AS b, a BETWEEN 8 AND 18 AS usable FROM t{steps}"


@query(_newton(14))
def platt_fit(spark, sf):
    """Slope and offset of the calibration, fitted to scores and labels of orders."""
    score = (F.col("o_orderkey") * 61) % 101
    rows = adapters.table(spark, sf, "orders").select((score / 100.0).alias("score"), ((score + (F.col("o_custkey") * 7) % 40) > 70).cast("int").alias("label"))
    a, b = training.fit_platt(rows)
    return spark.createDataFrame([(round(a, 4), round(b, 4), training.usable_platt(a, b) == (a, b))], "a double, b double, usable boolean")
