"""The coder over events.value as one-channel signals, a stream for each of eight groups of users. SQL cannot express them: see the round-trip tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.operators import codec
from granula.operators.signal import to_granules
from granula.plans.registry import query, r4, table


def signals(spark, d):
    """stream_id, granule, channel, pcm: values over 400, in order of event_id within each stream."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("stream_id"), "event_id", (F.col("value") / 400).alias("v"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy("event_id")) - 1)
    return to_granules(e, 576, ["stream_id"]).select("stream_id", "granule", F.lit(0).alias("channel"), F.col("x").alias("pcm"))


@query()
def q_stream_encode(spark, d):
    """Frames of every stream: size and MD5."""
    return codec.encode(signals(spark, d), 44100, 128, 1).select("stream_id", "frame_no", F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@query()
def q_stream_decode(spark, d):
    """Encoded, joined, split, decoded: status and energy of every granule."""
    pcm = codec.decode(codec.join_frames(codec.encode(signals(spark, d), 44100, 128, 1)))
    return pcm.select("stream_id", "segment_id", "granule", "status", r4(F.aggregate("pcm", F.lit(0.0), lambda a, v: a + v * v)).alias("energy"))
