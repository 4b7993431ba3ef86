"""Playing streams: what their tags say, gapless trim, exact seeks.

A stream's raw timeline counts the samples that its frames give; its playable one starts after the coder's delay and ends before
its padding. Length and trim come from a leading tag frame or, without a frame count there, from the first frame's size. Only the
look at a stream's first frames is Python; tags, trim and seeks are expressions over one row a stream or frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions.bits import uint
from granula.operators import codec
from granula.operators.frames import ID3V1, RESYNC_BUDGET, SEEK_LEAD, apply_lame, cbr_samples, duration_ns, header_fields, parse_lame, parse_vbri, parse_xing, samples_by_rate, side_info_bytes

HEADS = "stream_id long, length long, trailer long, off long, first_bytes long, layer int, hz long, channels int, kbps int, tag binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [f.split()[0] for f in HEADS.split(", ")]


def heads(streams: DataFrame) -> DataFrame:
    """HEADS of every stream(stream_id, content) with a frame of audio: its first one, and the tag frame before it (NULL: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content, tag = content or b"", None
                start = codec.skip_id3v2(content)
                for _, _, off, size, layer, hz, channels, kbps, _, status, _ in codec.Splitter(content[start:], start).frames(True):
                    raw = content[off : off + size]
                    if tag is None and layer == 3 and codec.is_tag(raw):
                        tag = raw
                        continue
                    if status != "TRUNCATED":
                        rows.append((stream, len(content), ID3V1 * (content[-ID3V1:][:3] == b"TAG" and len(content) >= ID3V1), off, size, layer, hz, channels, kbps, tag))
                    break
            cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return streams.select(F.col("stream_id").cast("long"), "content").mapInArrow(run, HEADS)


def stream_info(streams: DataFrame) -> DataFrame:
    """One row a stream with audio: layer, hz, channels, kbps, start, per_frame, tag, delay, padding, kept_from, kept_to (NULL: open), samples (0: unknown), duration_ns."""
    f = header_fields(uint(F.col("tag"), 0, 4))
    x = parse_xing(F.col("tag"), 4 + 2 * f["crc"] + side_info_bytes(f["mpeg1"], f["channels"]))
    v = parse_vbri(F.col("tag"))
    lame = parse_lame(F.col("tag"), x["lame_start"])
    rows = heads(streams).select(
        "stream_id", "layer", "hz", "channels", "kbps", F.col("off").alias("start"), "length", "trailer", "first_bytes",
        samples_by_rate(F.col("hz")).cast("long").alias("per_frame"),
        F.when(x["is_info"], "INFO").when(~x["is_info"], "XING").when(v["version"].isNotNull(), "VBRI").alias("tag"),
        F.nullif(F.coalesce(x["frames"], v["frames"]), F.lit(0)).alias("frames"), lame["delay"].alias("delay"), lame["lame_padding"].alias("padding"),
    )
    trim = apply_lame(F.col("frames") * F.col("per_frame"), F.col("delay"), F.col("padding"))
    rows = rows.select("*", trim["kept_from"].alias("kept_from"), trim["kept_to"].alias("kept_to"), trim["samples"].alias("tagged"))
    told = F.when(F.col("tagged") > 0, F.col("tagged")).otherwise(cbr_samples(F.col("length"), F.col("trailer"), F.col("start"), F.col("first_bytes"), F.col("per_frame")))
    rows = rows.withColumn("samples", told)
    return rows.select("stream_id", "layer", "hz", "channels", "kbps", "start", "per_frame", "tag", "delay", "padding", "kept_from", "kept_to", "samples", duration_ns(F.col("samples"), F.col("hz")).alias("duration_ns"))


def outcomes(frames: DataFrame) -> DataFrame:
    """stream_id, stop (frame_no at which playing ends, NULL: the last frame), state: END, UNSUPPORTED (Layer I or II) or CORRUPT (over 128 KiB without a frame)."""
    w = Window.partitionBy("stream_id").orderBy("frame_no")
    gap = F.col("off") - F.lag(F.col("off") + F.col("frame_bytes")).over(w)
    bad = F.when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED").when(F.col("gap") > RESYNC_BUDGET, "CORRUPT")
    first = frames.select("stream_id", "frame_no", "status", gap.alias("gap")).withColumn("bad", bad).groupBy("stream_id").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("frame_no", "bad"))).alias("f"))
    return first.select("stream_id", F.col("f.frame_no").alias("stop"), F.coalesce("f.bad", F.lit("END")).alias("state"))


def kept(frames: DataFrame, info: DataFrame) -> DataFrame:
    """stream_id, frame_no, lo, hi, at: the samples [lo, hi) of a frame that are played, and the playable index of the first.

    Frames without samples take no place in the timeline; what comes after a stop is not played.
    """
    w = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    given = frames.where(F.col("status").isin("OK", "CODEBOOK")).select("stream_id", "frame_no", F.col("samples").cast("long").alias("n"))
    given = given.join(outcomes(frames).select("stream_id", "stop"), "stream_id").where("stop is null or frame_no < stop")
    placed = given.withColumn("to", F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n")).join(info.select("stream_id", "kept_from", "kept_to"), "stream_id")
    lo, hi = F.greatest("from", "kept_from"), F.least("to", "kept_to")
    return placed.withColumn("l", lo).withColumn("h", hi).where("l < h").select("stream_id", "frame_no", (F.col("l") - F.col("from")).alias("lo"), (F.col("h") - F.col("from")).alias("hi"), (F.col("l") - F.col("kept_from")).alias("at"))


def _clipped(pcm: DataFrame, plan: DataFrame, info: DataFrame) -> DataFrame:
    """stream_id, channel, at, pcm: the granules' samples that `plan` keeps. plan: stream_id, frame_no, lo, hi, at."""
    granules = F.sequence(F.lit(0).cast("long"), F.floor(F.col("per_frame") / 576) - 1)
    parts = plan.join(info.select("stream_id", "per_frame"), "stream_id").select("*", F.explode(granules).alias("g"))
    parts = parts.select("stream_id", (F.col("frame_no") * F.floor(F.col("per_frame") / 576) + F.col("g")).alias("granule"), F.greatest(F.col("lo") - 576 * F.col("g"), F.lit(0)).alias("a"), F.least(F.col("hi") - 576 * F.col("g"), F.lit(576)).alias("b"), (F.col("at") - F.col("lo") + 576 * F.col("g")).alias("zero"))
    both = pcm.join(parts.where("a < b"), ["stream_id", "granule"])
    return both.select("stream_id", "channel", (F.col("zero") + F.col("a")).alias("at"), F.slice("pcm", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).alias("pcm"))


def play(streams: DataFrame, books: str | None = None, window: str | None = None) -> DataFrame:
    """stream_id, channel, at, pcm: what a player hears, a row for what is kept of each granule; `at` counts playable samples from 0."""
    frames, info = codec.split_frames(streams), stream_info(streams)
    return _clipped(codec.synthesise(codec.granules(frames, books), window), kept(frames, info), info)


def seek_targets(targets: DataFrame, info: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds to targets(stream_id, sample): state, landed, frame, intra (samples of it to skip) and prime (first frame to decode).

    state: OK; END (at or past the end: landed is the playable length, the rest NULL); INVALID (negative); UNSEEKABLE (free
    format, whose frames cannot be walked by their headers). Frames count whether or not they give samples.
    """
    counts = frames.where("status <> 'TRUNCATED'").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_frames"))
    rows = targets.join(info.select("stream_id", "kbps", "per_frame", "kept_from", "samples"), "stream_id").join(counts, "stream_id")
    limit = F.lit(2**62)  # past any stream, so that the sum cannot overflow
    rows = rows.withColumn("raw", F.least("sample", limit) + F.col("kept_from"))
    rows = rows.withColumn("to", F.expr("raw div per_frame"))
    told = (F.col("samples") > 0) & (F.col("sample") >= F.col("samples"))
    state = F.when(F.col("sample") < 0, "INVALID").when(told, "END").when(F.col("kbps") == 0, "UNSEEKABLE").when(F.col("to") >= F.col("n_frames"), "END").otherwise("OK")
    rows = rows.withColumn("state", state)
    ok = F.col("state") == "OK"
    landed = F.when(ok, F.col("sample")).when(F.col("state") == "END", F.when(told, F.col("samples")).otherwise(F.greatest(F.lit(0), F.col("n_frames") * F.col("per_frame") - F.col("kept_from"))))
    return rows.select(*targets.columns, "state", landed.cast("long").alias("landed"), F.when(ok, F.col("to")).alias("frame"), F.when(ok, F.col("raw") % F.col("per_frame")).alias("intra"), F.when(ok, F.greatest(F.lit(0), F.col("to") - SEEK_LEAD)).cast("long").alias("prime"))


def play_from(streams: DataFrame, targets: DataFrame, books: str | None = None, window: str | None = None) -> DataFrame:
    """As play(), from each stream's target sample on; targets: one (stream_id, sample) a stream. Frames before `prime` are not decoded."""
    frames, info = codec.split_frames(streams), stream_info(streams)
    plan = seek_targets(targets, info, frames).where("state = 'OK'")
    needed = frames.join(plan.select("stream_id", "prime"), "stream_id").where("frame_no >= prime").drop("prime")
    ends = needed.select("stream_id", "frame_no", F.col("samples").cast("long").alias("n")).join(outcomes(frames).select("stream_id", "stop"), "stream_id").where("stop is null or frame_no < stop")
    ends = ends.join(plan.select("stream_id", "frame", "intra"), "stream_id").where("frame_no >= frame").join(info.select("stream_id", "per_frame", "kept_from", "kept_to"), "stream_id")
    lo = F.when(F.col("frame_no") == F.col("frame"), F.col("intra")).otherwise(F.lit(0).cast("long"))
    hi = F.least("n", F.col("kept_to") - F.col("frame_no") * F.col("per_frame"))
    spans = ends.select("stream_id", "frame_no", lo.alias("lo"), hi.alias("hi"), (F.col("frame_no") * F.col("per_frame") + lo - F.col("kept_from")).alias("at")).where("lo < hi")
    return _clipped(codec.synthesise(codec.granules(needed, books), window), spans, info)
