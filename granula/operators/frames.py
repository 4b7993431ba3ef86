"""Frame headers, synchronisation, sizing, tags, trimming and seeking over tables of streams and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import tables as T
from granula.functions.bits import ascii_at, field, uint

ID3_HEADER, ID3V1, RESYNC_BUDGET, SEEK_LEAD = 10, 128, 128 * 1024, 16


def header_fields(h: Column) -> dict[str, Column]:
    """The fields of a 32-bit header word."""
    version, layer_bits, rate = field(h, 19, 2), field(h, 17, 2), field(h, 10, 2)
    bitrate, mpeg1 = field(h, 12, 4), field(h, 19, 1)
    layer = F.lit(4) - layer_bits
    sync, b1 = field(h, 24, 8), field(h, 16, 8)
    valid = (sync == 255) & ((b1.bitwiseAND(0xF0) == 0xF0) | (b1.bitwiseAND(0xFE) == 0xE2)) & (layer_bits != 0) & (bitrate != 15) & (rate != 3)
    mode = field(h, 6, 2)
    return {"valid": valid, "version": version, "layer": layer, "bitrate_index": bitrate, "rate_index": rate, "padding": field(h, 9, 1), "crc": F.lit(1) - field(h, 16, 1), "mpeg1": mpeg1, "mode": mode, "mode_extension": field(h, 4, 2), "channels": F.when(mode == 3, 1).otherwise(2)}


def bitrate_kbps(mpeg1: Column, layer: Column, index: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(v) for v in T.BITRATES[(m, k)]]) for m in (0, 1) for k in (1, 2, 3)])
    return F.get(F.get(table, (mpeg1 * 3 + layer - 1).cast("int")), index.cast("int"))


def sample_rate(version: Column, index: Column) -> Column:
    """version: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5."""
    base = F.get(F.array(*map(F.lit, T.RATES)), index.cast("int"))
    return F.floor(base / F.when(version == 3, 1).when(version == 2, 2).otherwise(4)).cast("long")


def frame_samples(mpeg1: Column, layer: Column) -> Column:
    return F.when(layer == 1, 384).when((layer == 3) & (mpeg1 == 0), 576).otherwise(1152)


def frame_bytes(samples: Column, kbps: Column, hz: Column, layer: Column, padding: Column) -> Column:
    """Without a bitrate (free format) 0; Layer I aligns to slots of four bytes."""
    plain = F.floor(samples * kbps * 125 / hz).cast("long")
    return F.when(kbps == 0, 0).otherwise(F.when(layer == 1, plain - plain % 4 + padding * 4).otherwise(plain + padding)).cast("long")


def decode_headers(df: DataFrame, word: str = "word") -> DataFrame:
    """Adds the header fields, kbps, hz, samples and frame_bytes of a header word column; rows that are no header keep valid = false."""
    f = header_fields(F.col(word))
    out = df.select("*", *[c.alias(n) for n, c in f.items()])
    out = out.withColumn("kbps", F.when(F.col("valid"), bitrate_kbps(F.col("mpeg1"), F.col("layer"), F.col("bitrate_index"))))
    out = out.withColumn("hz", F.when(F.col("valid"), sample_rate(F.col("version"), F.col("rate_index")))).withColumn("samples", F.when(F.col("valid"), frame_samples(F.col("mpeg1"), F.col("layer"))))
    return out.withColumn("frame_bytes", F.when(F.col("valid"), frame_bytes(F.col("samples"), F.col("kbps"), F.col("hz"), F.col("layer"), F.col("padding"))))


def sync_candidates(streams: DataFrame, content: str = "content") -> DataFrame:
    """Every offset whose four bytes are a valid header: stream_id, off, word.

    The first two bytes are tested on the array of sync positions, so only bytes 0xFF are exploded, not the stream.
    """
    hexed = F.hex(content)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(content) - 5)), lambda i: (F.substring(hexed, 2 * i + 1, F.lit(2)) == "FF") & F.substring(hexed, 2 * i + 3, F.lit(1)).isin("E", "F"))
    found = streams.where(F.length(content) > 4).select("stream_id", content, F.explode(starts).alias("off"))
    worded = found.select("stream_id", F.col("off").cast("long").alias("off"), uint(F.col(content), F.col("off"), 4).alias("word"))
    return worded.where(header_fields(F.col("word"))["valid"])


def same_stream(a: Column, b: Column) -> Column:
    """Version, layer and rate agree and both or neither are free format; bitrate, padding, CRC and mode may change."""
    mask = 0x00FE0C00
    free = lambda h: field(h, 12, 4) == 0
    return (a.bitwiseAND(mask) == b.bitwiseAND(mask)) & (free(a) == free(b))


def successors(frames: DataFrame) -> DataFrame:
    """Self-join at off + frame_bytes: next_off of the following frame of the same stream, NULL at a break. frames: stream_id, off, frame_bytes, word."""
    nxt = frames.select(F.col("stream_id").alias("next_stream"), F.col("off").alias("next_off"), F.col("word").alias("next_word"))
    follows = (F.col("stream_id") == F.col("next_stream")) & (F.col("off") + F.col("frame_bytes") == F.col("next_off")) & same_stream(F.col("word"), F.col("next_word"))
    return frames.join(nxt, follows, "left").select("stream_id", "off", "frame_bytes", "word", "next_off")


def segments(frames: DataFrame) -> DataFrame:
    """Adds frame_no, gap (bytes skipped before the frame), segment_id (a gap resets all state) and status: CORRUPT where a gap passes the resync budget."""
    w = Window.partitionBy("stream_id").orderBy("off")
    gap = F.col("off") - F.coalesce(F.lag(F.col("off") + F.col("frame_bytes")).over(w), F.col("off"))
    out = frames.withColumn("frame_no", F.row_number().over(w) - 1).withColumn("gap", gap)
    return out.withColumn("segment_id", F.sum((F.col("gap") > 0).cast("long")).over(w)).withColumn("status", F.when(F.col("gap") > RESYNC_BUDGET, "CORRUPT").otherwise("OK"))


def cbr_padding(n: Column, kbps: Column, hz: Column) -> Column:
    """The padding bit of frame n in closed form: the running remainder carries into the next byte."""
    r = (F.lit(144000) * kbps) % hz
    return (F.floor((n + 1) * r / hz) - F.floor(n * r / hz)).cast("long")


def id3v2_bytes(content: Column) -> Column:
    """Bytes of a leading tag: 10 + the synchsafe size, + 10 with a footer; 0 without one."""
    size = sum((uint(content, 6 + k, 1).bitwiseAND(127) * (1 << (21 - 7 * k)) for k in range(4)), F.lit(0))
    return F.when((F.length(content) >= ID3_HEADER) & ascii_at(content, 0, "ID3"), size + ID3_HEADER + F.when(uint(content, 5, 1).bitwiseAND(16) != 0, ID3_HEADER).otherwise(0)).otherwise(0).cast("long")


def id3v1_bytes(content: Column) -> Column:
    return F.when((F.length(content) >= ID3V1) & ascii_at(content, F.length(content) - ID3V1, "TAG"), ID3V1).otherwise(0).cast("long")


def side_info_bytes(mpeg1: Column, channels: Column) -> Column:
    return F.when((mpeg1 == 1) & (channels == 2), 32).when((mpeg1 == 0) & (channels == 1), 9).otherwise(17)


def parse_xing(frame: Column, off: Column) -> dict[str, Column]:
    """Fields of a Xing or Info tag at `off` (header, CRC and side info passed); all NULL unless every claimed field fits."""
    flags = uint(frame, off + 4, 4)
    has = lambda bit: flags.bitwiseAND(bit) != 0
    magic = ascii_at(frame, off, "Xing") | ascii_at(frame, off, "Info")
    p_bytes = off + 8 + F.when(has(1), 4).otherwise(0)
    p_toc = p_bytes + F.when(has(2), 4).otherwise(0)
    p_quality = p_toc + F.when(has(4), 100).otherwise(0)
    end = p_quality + F.when(has(8), 4).otherwise(0)
    ok = magic & flags.isNotNull() & (end <= F.length(frame))
    pick = lambda bit, at: F.when(ok & has(bit), uint(frame, at, 4))
    return {"is_info": F.when(ok, ascii_at(frame, off, "Info")), "frames": pick(1, off + 8), "bytes": pick(2, p_bytes), "has_toc": F.when(ok, has(4)), "quality": pick(8, p_quality), "lame_start": F.when(ok, end)}


def parse_vbri(frame: Column) -> dict[str, Column]:
    """Fields of a VBRI tag at byte 36; NULL unless the magic stands, entries have a width and the table fits."""
    p = 40
    entries, width = uint(frame, p + 14, 2), uint(frame, p + 18, 2)
    ok = F.coalesce(ascii_at(frame, 36, "VBRI") & (F.length(frame) >= 62) & (width != 0) & (62 + entries * width <= F.length(frame)), F.lit(False))
    names = {"version": (0, 2), "delay": (2, 2), "quality": (4, 2), "bytes": (6, 4), "frames": (10, 4), "toc_entries": (14, 2), "toc_scale": (16, 2), "entry_size": (18, 2), "entry_frames": (20, 2)}
    return {n: F.when(ok, uint(frame, p + o, w)) for n, (o, w) in names.items()} | {"toc": F.when(ok & width.isin(1, 2), F.transform(F.filter(F.sequence(F.lit(-1), entries - 1), lambda i: i >= 0), lambda i: F.conv(F.hex(F.substring(frame, (63 + i * width).cast("int"), width.cast("int"))), 16, 10).cast("int")))}


def parse_lame(frame: Column, at: Column) -> dict[str, Column]:
    """Encoder delay and padding, two 12-bit fields 21 bytes past the magic."""
    three = uint(frame, at + 21, 3)
    ok = ascii_at(frame, at, "LAME")
    return {"delay": F.when(ok, field(three, 12, 12)), "lame_padding": F.when(ok, field(three, 0, 12))}


def cbr_samples(length: Column, trailer: Column, start: Column, first_frame: Column, per_frame: Column) -> Column:
    """Samples of an untagged stream by its first frame's size; the trailer counts as audio if nothing else would be left."""
    trailer = F.when(length - trailer <= start, 0).otherwise(trailer)
    span = length - trailer - start
    return F.when((span > 0) & (first_frame > 0), F.floor(span / first_frame) * per_frame).otherwise(0).cast("long")


def samples_by_rate(hz: Column) -> Column:
    """Samples of a Layer III frame by its rate alone."""
    return F.when(hz >= 32000, 1152).otherwise(576)


def apply_lame(total: Column, delay: Column, padding: Column) -> dict[str, Column]:
    """Trim window and playable samples. total: raw samples by a tag's frame count; delay, padding: both NULL without the extension.

    Without a total only the head is trimmed and the samples are 0, unknown; a NULL kept_to is open.
    """
    known = delay.isNotNull() & total.isNotNull()
    trimmed = F.greatest(F.lit(0).cast("long"), total - delay - padding)
    return {
        "kept_from": F.coalesce(delay, F.lit(0)).cast("long"),
        "kept_to": F.when(known, total - F.least(padding, total)),
        "samples": F.when(known, trimmed).when(delay.isNotNull(), 0).otherwise(total).cast("long"),
    }


def duration_ns(samples: Column, hz: Column) -> Column:
    """Whole seconds and remainder apart; NULL when unknown."""
    return F.when((samples > 0) & (hz > 0), F.floor(samples / hz).cast("long") * 1_000_000_000 + F.floor((samples % hz) * 1_000_000_000 / hz).cast("long"))


def gapless(frames: DataFrame, delay: int, end: int | None) -> DataFrame:
    """Clips each frame's samples to [delay, end): kept_from and kept_to in the frame, rows without kept samples go. frames: stream_id, frame_no, n."""
    w = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = frames.where("n > 0").withColumn("to", F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
    lo, hi = F.greatest("from", F.lit(delay)), F.col("to") if end is None else F.least(F.col("to"), F.lit(end))
    return placed.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi").select("stream_id", "frame_no", (F.col("lo") - F.col("from")).cast("long").alias("kept_from"), (F.col("hi") - F.col("from")).cast("long").alias("kept_to"))


def seek_plan(targets: DataFrame, delay: int, per_frame: int) -> DataFrame:
    """Adds frame, intra and prime (first frame to decode, 16 before) for a playable sample index."""
    raw = F.col("sample") + delay
    return targets.withColumn("frame", F.floor(raw / per_frame).cast("long")).withColumn("intra", (raw % per_frame).cast("long")).withColumn("prime", F.greatest(F.lit(0), F.floor(raw / per_frame) - SEEK_LEAD).cast("long"))


def reservoir_spans(frames: DataFrame) -> DataFrame:
    """Where each frame's main data lies in its segment's joined area bytes: [cum - back, cum_end). frames: stream_id, segment_id, frame_no, area, main_data_begin."""
    w = Window.partitionBy("stream_id", "segment_id").orderBy("frame_no")
    before = F.coalesce(F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = frames.withColumn("before", before)
    return out.withColumn("from_byte", F.col("before") - F.col("main_data_begin")).withColumn("to_byte", F.col("before") + F.col("area")).withColumn("ok", (F.col("from_byte") >= 0) & (F.col("main_data_begin") <= T.RESERVOIR))


def place_in_slots(payloads: DataFrame, slots: DataFrame) -> DataFrame:
    """Interval-overlap join of payload bytes with slot bytes of one stream, both [from_byte, to_byte).

    Bytes are bucketed so that the join is on (stream_id, bucket) with the overlap as filter; a pair is kept in the bucket where
    its overlap begins, once.
    """
    size = 4096
    spread = lambda df: df.where("to_byte > from_byte").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_byte") / size), F.floor((F.col("to_byte") - 1) / size))))
    a = spread(payloads.select("stream_id", "payload", "from_byte", "to_byte")).alias("a")
    b = spread(slots.select("stream_id", "slot", "from_byte", "to_byte")).alias("b")
    lo, hi = F.greatest("a.from_byte", "b.from_byte"), F.least("a.to_byte", "b.to_byte")
    both = a.join(b, (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (lo < hi) & (F.floor(lo / size) == F.col("a.bucket")))
    return both.select(F.col("a.stream_id").alias("stream_id"), "payload", "slot", (hi - lo).cast("long").alias("overlap"))
