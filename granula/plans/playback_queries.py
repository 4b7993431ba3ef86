"""Stream length, gapless trim and seeks over streams made of every document's number: a tag frame of four kinds, 12 to 14 silent frames, some with a trailer."""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.operators import codec, playback
from granula.plans.registry import query, table

FRAME = "FFFB9064" + "00" * 413

_S = (
    "s AS (SELECT doc_id AS d, doc_id % 4 AS kind, 12 + doc_id % 3 AS k, (doc_id // 4) % 2 AS trailer, doc_id % 20 * 1152 AS told, (doc_id * 7) % 4096 AS delay, (doc_id * 13) % 4096 AS pad FROM documents), "
    "t AS (SELECT *, CASE WHEN kind = 0 THEN delay ELSE 0 END AS kept_from, CASE WHEN kind = 0 AND told > 0 THEN told - least(pad, told) END AS kept_to, "
    "CASE WHEN kind = 0 THEN greatest(0, told - delay - pad) WHEN kind = 3 THEN 0 ELSE told END AS tagged, (k - trailer) * 1152 AS raw FROM s WHERE d IS NOT NULL), "
    "i AS (SELECT *, CASE WHEN tagged > 0 THEN tagged ELSE k * 1152 END AS samples FROM t)"
)


def streams(spark, d):
    """stream_id, content. The last frame before a trailer has no successor and does not count as one."""
    s = table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("n"))
    word = lambda v, width: F.lpad(F.hex(v), width, "0")
    head, told = F.lit("FFFB9064" + "00" * 32), word(F.col("n") % 20, 8)
    lame = F.concat(F.lit("4C414D45" + "00" * 17), word((F.col("n") * 7) % 4096 * 4096 + (F.col("n") * 13) % 4096, 6))
    xing = F.concat(head, F.lit("58696E67" + "00000001"), told, lame)
    info = F.concat(head, F.lit("496E666F" + "00000001"), told)
    vbri = F.concat(head, F.lit("56425249" + "0001" + "00" * 8), told, F.lit("0000" + "0001" + "0002" + "0001"))
    kind = F.col("n") % 4
    tag = F.when(kind == 3, "").otherwise(F.rpad(F.when(kind == 0, xing).when(kind == 1, info).otherwise(vbri), len(FRAME), "0"))
    body = F.expr(f"repeat('{FRAME}', cast(12 + n % 3 as int))")
    trailer = F.when(F.expr("(n div 4) % 2 = 1"), "544147" + "00" * 125).otherwise("")
    return s.select(F.col("n").alias("stream_id"), F.unhex(F.concat(tag, body, trailer)).alias("content"))


@query(
    f"WITH {_S} SELECT d AS stream_id, 44100::BIGINT AS hz, CASE WHEN kind < 3 THEN 417 ELSE 0 END::BIGINT AS start, CASE kind WHEN 0 THEN 'XING' WHEN 1 THEN 'INFO' WHEN 2 THEN 'VBRI' END AS tag, "
    "kept_from::BIGINT AS kept_from, kept_to::BIGINT AS kept_to, samples::BIGINT AS samples, (samples // 44100 * 1000000000 + samples % 44100 * 1000000000 // 44100)::BIGINT AS duration_ns FROM i"
)
def q_stream_info(spark, d):
    """Tag, start, trim window, length and duration of every stream."""
    return playback.stream_info(streams(spark, d)).select("stream_id", "hz", "start", "tag", "kept_from", "kept_to", "samples", "duration_ns")


@query(
    f"WITH {_S}, w AS (SELECT d, kept_from AS a, least(raw, coalesce(kept_to, raw)) AS b FROM i) "
    "SELECT d AS stream_id, (b - a)::BIGINT AS n_kept, (a // 1152)::BIGINT AS first_frame, ((b - 1) // 1152)::BIGINT AS last_frame FROM w WHERE b > a"
)
def q_gapless_pcm(spark, d):
    """What gapless playing keeps of every stream: samples, first and last frame."""
    s = streams(spark, d)
    k = playback.kept(codec.split_frames(s), playback.stream_info(s))
    return k.groupBy("stream_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_kept"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))


@query(
    f"WITH {_S}, p AS (SELECT *, (d * 37) % 25000 - 50 AS sample FROM i), r AS (SELECT *, sample + kept_from AS r FROM p), "
    "o AS (SELECT *, CASE WHEN sample < 0 THEN 'INVALID' WHEN sample >= samples OR r // 1152 >= k - trailer THEN 'END' ELSE 'OK' END AS state FROM r) "
    "SELECT d AS stream_id, sample::BIGINT AS sample, state, CASE WHEN state = 'OK' THEN sample WHEN state = 'END' THEN CASE WHEN sample >= samples THEN samples ELSE greatest(0, raw - kept_from) END END::BIGINT AS landed, "
    "CASE WHEN state = 'OK' THEN r // 1152 END::BIGINT AS frame, CASE WHEN state = 'OK' THEN r % 1152 END::BIGINT AS intra, CASE WHEN state = 'OK' THEN greatest(0, r // 1152 - 16) END::BIGINT AS prime FROM o"
)
def q_seek_pcm(spark, d):
    """Where a seek in every stream lands, and from which frame on it decodes."""
    s = streams(spark, d)
    targets = s.select("stream_id", ((F.col("stream_id") * 37) % 25000 - 50).cast("long").alias("sample"))
    return playback.seek_targets(targets, playback.stream_info(s), codec.split_frames(s))
