"""Decoding and encoding of Layer III streams as DataFrames.

Decode: streams -> frames (the pointer chase along one stream, one narrow Python pass) -> granules (entropy decoding and hybrid
filterbank, parallel over frames) -> overlap and polyphase (equi-joins with the granule before) -> PCM rows. Only the first step
follows a stream in order; its output carries each frame's main data already joined from the bit reservoir.

Status of a frame: OK, UNSUPPORTED (Layer I or II), SIDE_INFO (malformed), RESERVOIR (bytes before the segment's start), TRUNCATED,
CODEBOOK (a table that was not given). A stream without a frame gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions import layer3 as L
from granula.functions import psycho as P
from granula.functions import tables as T
from granula.functions.dsp import to_s16
from granula.operators.frames import cbr_padding
from granula.operators.signal import pre_echo

FRAMES = "stream_id long, frame_no long, segment_id long, off long, frame_bytes int, layer int, hz int, channels int, kbps int, samples int, status string, payload binary"
_FRAME_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
_FRAME_NAMES = [f.split()[0] for f in FRAMES.split(", ")]
CONFIRM, MAX_FREE = 10, 2304
#: Energy of MDCT lines over that of the windowed spectrum for the same noise.
CALIBRATION = 3.85e-6


def _same(a: bytes, b: bytes) -> bool:
    return L.header(b) is not None and not (a[1] ^ b[1]) & 0xFE and not (a[2] ^ b[2]) & 0x0C and (a[2] & 0xF0 == 0) == (b[2] & 0xF0 == 0)


class Splitter:
    """Walks one stream's bytes; feed() may be called with more bytes at any time, as a streaming query does."""

    def __init__(self, data: bytes = b"", base: int = 0, frame_no: int = 0, segment: int = 0, reserve: bytes = b"", free: int = 0, last: bytes = b""):
        self.data, self.base, self.frame_no, self.segment, self.reserve, self.free, self.last = data, base, frame_no, segment, reserve, free, last

    def _size(self, at: int) -> int:
        h = L.header(self.data[at : at + 4])
        return 0 if h is None else h.size or (self.free + h.padding if self.free else 0)

    def _confirmed(self, at: int, end: bool) -> bool:
        first, pos = self.data[at : at + 4], at
        for n in range(CONFIRM):
            size = self._size(pos)
            if not size:
                return False
            pos += size
            if pos + 4 > len(self.data):
                return n > 0 or (end and pos == len(self.data))
            if not _same(first, self.data[pos : pos + 4]):
                return False
        return True

    def _find_free(self, at: int) -> int:
        """Frame size without padding of a free-format header: the nearest distance at which two successors match."""
        d, h = self.data, L.header(self.data[at : at + 4])
        for k in range(4, MAX_FREE):
            if not _same(d[at : at + 4], d[at + k : at + k + 4]):
                continue
            size = k - h.padding
            after = at + k + size + L.header(d[at + k : at + k + 4]).padding
            if _same(d[at : at + 4], d[after : after + 4]):
                return size
        return 0

    def frames(self, end: bool) -> Iterator[tuple]:
        """Complete frames so far; end: no more bytes will come."""
        at = 0
        while at + 4 < len(self.data):
            size = self._size(at) if self.last and _same(self.last, self.data[at : at + 4]) else 0
            if size and at + size != len(self.data) and not (at + size + 4 <= len(self.data) and _same(self.data[at : at + 4], self.data[at + size : at + size + 4])):
                if not end and at + size + 4 > len(self.data):
                    break
                size = 0
            if not size:  # search: all state starts anew
                if not end and len(self.data) - at < 2 * 2884:
                    break
                fresh, self.free, self.reserve = at, 0, b""
                while at + 4 < len(self.data):
                    if self.data[at] == 0xFF and (h := L.header(self.data[at : at + 4])):
                        if not h.size:
                            self.free = self._find_free(at)
                        size = self._size(at)
                        if size and at + size <= len(self.data) and self._confirmed(at, end):
                            break
                        size, self.free = 0, 0
                    at += 1
                if not size:
                    at = fresh if end else max(fresh, len(self.data) - 2884)
                    break
                if self.last:
                    self.segment += 1
            raw, h = self.data[at : at + size], L.header(self.data[at : at + 4])
            self.last = raw[:4]
            status, payload = "OK", b""
            body = raw[4 + 2 * h.crc :]
            if h.layer != 3:
                status = "UNSUPPORTED"
            else:
                bits = L.Bits(body)
                found = L.side_info(bits, h) if size >= 4 else None
                side = (17 if h.channels == 1 else 32) if h.mpeg1 else (9 if h.channels == 1 else 17)
                if found is None or sum(f["part23"] for row in found[1] for f in row) > 8 * (len(body) - side + found[0]):
                    status, self.last, self.reserve = "SIDE_INFO", b"", b""
                else:
                    begin, area = found[0], body[side:]
                    ok = begin <= len(self.reserve)
                    main = self.reserve[len(self.reserve) - begin :] + area if ok else self.reserve + area
                    spent = -(-sum(f["part23"] for row in found[1] for f in row) // 8) if ok else 0
                    self.reserve = main[spent:][-T.RESERVOIR :]
                    status, payload = ("OK", raw[:4] + body[:side] + main) if ok else ("RESERVOIR", b"")
            yield self.frame_no, self.segment, self.base + at, size, h.layer, h.hz, h.channels, h.kbps, h.samples, status, payload
            self.frame_no += 1
            at += size
        if end and at + 4 <= len(self.data) and (h := L.header(self.data[at : at + 4])) and at + (h.size or 0) > len(self.data):
            yield self.frame_no, self.segment, self.base + at, len(self.data) - at, h.layer, h.hz, h.channels, h.kbps, h.samples, "TRUNCATED", b""
            at = len(self.data)
        self.data, self.base = self.data[at:], self.base + at


def skip_id3v2(content: bytes) -> int:
    if len(content) < 10 or content[:3] != b"ID3":
        return 0
    size = 0
    for b in content[6:10]:
        size = size << 7 | b & 127
    return 10 + size + (10 if content[5] & 16 else 0)


def is_tag(raw: bytes) -> bool:
    """Whether a frame holds a Xing, Info or VBRI tag instead of audio."""
    h = L.header(raw[:4])
    if h is None or h.layer != 3:
        return False
    side = (17 if h.channels == 1 else 32) if h.mpeg1 else (9 if h.channels == 1 else 17)
    at = 4 + 2 * h.crc + side
    return raw[at : at + 4] in (b"Xing", b"Info") or raw[36:40] == b"VBRI"


def split_frames(streams: DataFrame) -> DataFrame:
    """FRAMES of streams(stream_id long, content binary): leading ID3v2 skipped, a leading tag frame left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = content or b""
                start, rows, tagged = skip_id3v2(content), [], False
                for row in Splitter(content[start:], start).frames(True):
                    if not rows and not tagged and row[4] == 3 and is_tag(content[row[2] : row[2] + row[3]]):
                        tagged = True
                        continue
                    rows.append((stream, row[0] - tagged, *row[1:]))
                cols = list(zip(*rows, strict=True)) or [[]] * len(_FRAME_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _FRAME_TYPES, strict=True)], names=_FRAME_NAMES)

    return streams.select(F.col("stream_id").cast("long"), "content").mapInArrow(run, FRAMES)


def decode_payload(payload: bytes, books: str | None = None) -> list[list[tuple[np.ndarray, int, int, int]]]:
    """[granule][channel] of (576 lines ready for the inverse transform, block type, mixed flag, long subbands)."""
    h = L.header(payload[:4])
    side = (17 if h.channels == 1 else 32) if h.mpeg1 else (9 if h.channels == 1 else 17)
    _, fields = L.side_info(L.Bits(payload[4 : 4 + side]), h)
    bits, out, before = L.Bits(payload[4 + side :]), [], [None] * h.channels
    for row in fields:
        lines, scfs, marks = [], [], []
        for ch, f in enumerate(row):
            end = bits.pos + f["part23"]
            scf, mark = L.scalefactors(bits, h, f, ch, before[ch])
            before[ch] = scf
            ix = L.spectrum(bits, f, end, h.hz, books)
            bits.pos = end
            lines.append(L.dequantise(ix, scf, f, h))
            scfs.append(scf)
            marks.append(mark)
        if h.channels == 2:
            lines = list(L.stereo(lines[0], lines[1], h, row[0], scfs[1], marks[1]))
        made = []
        for f, x in zip(row, lines, strict=True):
            long = (4 if h.hz == 8000 else 2) if f["mixed"] else 0
            x = L.reorder(x, f, h.hz, h.mpeg1) if f["block"] == 2 else x
            made.append((L.antialias(x, max(0, long - 1) if f["block"] == 2 else 31), f["block"], f["mixed"], long or 2))
        out.append(made)
    return out


def granules(frames: DataFrame, books: str | None = None) -> DataFrame:
    """stream_id, segment_id, granule, channel, status, head and tail (576 samples each in subband order) of every frame; silence where it failed."""
    names, types = ["stream_id", "segment_id", "granule", "channel", "status", "head", "tail"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(i, 64).to_pylist():
                    per, status, made = r["samples"] // 576, r["status"], None
                    if status == "OK":
                        try:
                            made = decode_payload(r["payload"], books)
                        except L.CodebookMissing:
                            status = "CODEBOOK"
                    for g in range(per if status in ("OK", "CODEBOOK") else 0):
                        for ch in range(r["channels"]):
                            head, tail = L.imdct(*made[g][ch]) if made else (np.zeros((32, 18)), np.zeros((32, 18)))
                            rows.append((r["stream_id"], r["segment_id"], r["frame_no"] * per + g, ch, status, head.ravel(), tail.ravel()))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return frames.select("stream_id", "segment_id", "frame_no", "samples", "channels", "status", "payload").mapInArrow(run, "stream_id long, segment_id long, granule long, channel int, status string, head array<double>, tail array<double>")


KEY = ["stream_id", "segment_id", "channel"]


def _before(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds `column` of the granule before in the same segment and channel, silence at its start: an equi-join, no ordering of the stream."""
    past = df.select(*KEY, (F.col("granule") + 1).alias("granule"), F.col(column).alias(name))
    return df.join(past, [*KEY, "granule"], "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), 576)))


def _pairwise(df: DataFrame, a: str, b: str, name: str, function) -> DataFrame:
    """Applies function([32, 18] or [576], the same) -> 576 values row by row in Arrow batches; drops both inputs."""
    kept = [c for c in df.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), dtype=float).reshape(batch.num_rows, -1) for c in (a, b))
            out = [np.asarray(function(p, q)).ravel() for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(out, pa.list_(pa.float64()))], names=[*kept, name])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.mapInArrow(run, f"{schema}, {name} array<double>")


def decode(streams: DataFrame, books: str | None = None, window: str | None = None) -> DataFrame:
    """stream_id, segment_id, granule, channel, status, pcm array<double> of 576 samples. streams: stream_id, content."""
    return synthesise(granules(split_frames(streams), books), window)


def synthesise(rows: DataFrame, window: str | None = None) -> DataFrame:
    joined = _before(rows, "tail", "past").drop("tail")
    bands = _pairwise(joined, "head", "past", "bands", lambda h, t: L.flip((h + t).reshape(32, 18)))
    return _pairwise(_before(bands, "bands", "past"), "past", "bands", "pcm", lambda p, b: L.synthesise(p.reshape(32, 18), b.reshape(32, 18), window))


def samples(pcm: DataFrame) -> DataFrame:
    """stream_id, n, channel, v: one row a sample, n counted over the stream's granules."""
    return pcm.select("stream_id", "channel", "granule", F.posexplode("pcm").alias("i", "v")).select("stream_id", (F.col("granule") * 576 + F.col("i")).alias("n"), "channel", "v")


def pack(pcm: DataFrame, kind: str = "s16") -> DataFrame:
    """stream_id, granule, data: interleaved little-endian S16 or F32 of every granule."""
    both = pcm.groupBy("stream_id", "granule").agg(F.array_sort(F.collect_list(F.struct("channel", "pcm"))).alias("c"))
    inter = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(575)), lambda i: F.transform("c", lambda c: F.get(c["pcm"], i))))
    values = both.select("stream_id", "granule", (F.transform(inter, to_s16) if kind == "s16" else F.transform(inter, lambda v: v.cast("float"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v).astype("<i2" if kind == "s16" else "<f4").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["stream_id", "granule", "data"])

    return values.mapInArrow(run, "stream_id long, granule long, data binary")


def seek(frames: DataFrame, sample: int, per_frame: int = 1152, delay: int = 0, lead: int = 16) -> DataFrame:
    """The frames needed to play from a sample: its frame, those after, and the lead-in before. A filter on frame_no that reaches the scan of a stored frames table."""
    if sample < 0:
        raise ValueError("negative sample index")
    return frames.where(F.col("frame_no") >= max(0, (sample + delay) // per_frame - lead))


def validate(hz: int, channels: int, kbps: int) -> None:
    """In this order: rate, channels, bitrate."""
    if hz not in T.RATES:
        raise ValueError(f"sample rate {hz}: one of {T.RATES}")
    if channels not in (1, 2):
        raise ValueError(f"{channels} channels: 1 or 2")
    if kbps not in T.BITRATES[(1, 3)][1:]:
        raise ValueError(f"bitrate {kbps}: one of {T.BITRATES[(1, 3)][1:]}")


def encode(pcm: DataFrame, hz: int = 44100, kbps: int = 128, channels: int = 1, books: str | None = None, window: str | None = None, joint: bool = True, masked: bool = False, rounds: int = 150) -> DataFrame:
    """stream_id, frame_no, data: CBR MPEG-1 frames, each with its own main data. pcm: stream_id, granule, channel, pcm array<double> of 576.

    masked: noise is shaped under psychoacoustic thresholds by at most `rounds` passes of the distortion loop a granule; else one
    global gain a granule. Samples are clamped to [-1, 1]. A sample that is no number or not finite ends its stream: its frame and all later ones are
    not coded. An odd last granule is followed by silence.
    """
    validate(hz, channels, kbps)
    frame = F.floor(F.col("granule") / 2)
    ends = pcm.where(F.exists("pcm", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).groupBy("stream_id").agg(F.min(frame).alias("ended"))
    pcm = pcm.join(ends, "stream_id", "left").where(F.col("ended").isNull() | (frame < F.col("ended"))).drop("ended")
    clean = F.transform("pcm", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))
    rows = pcm.select("stream_id", F.lit(0).cast("long").alias("segment_id"), "channel", "granule", clean.alias("x"))
    bands = _pairwise(_before(rows, "x", "past"), "past", "x", "bands", lambda p, x: L.flip(L.analyse(p, x, window)))
    lines = _pairwise(_before(bands, "bands", "past"), "past", "bands", "lines", lambda p, b: L.antialias(L.mdct(p.reshape(32, 18), b.reshape(32, 18)), 31, True))
    if masked:
        lines = lines.join(allowed_noise(rows, hz), ["stream_id", "channel", "granule"])
    else:
        lines = lines.withColumn("xmin", F.lit(None).cast("array<double>"))
    frames = lines.groupBy("stream_id", F.floor(F.col("granule") / 2).cast("long").alias("frame_no")).agg(F.array_sort(F.collect_list(F.struct((F.col("granule") % 2).alias("g"), "channel", "lines", "xmin"))).alias("parts"))
    frames = frames.withColumn("padding", cbr_padding(F.col("frame_no"), F.lit(kbps), F.lit(hz)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for parts, padding in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spectra = [[np.zeros(576) for _ in range(channels)] for _ in range(2)]
                xmin = [[np.full(22, np.inf) for _ in range(channels)] for _ in range(2)] if masked else None
                for p in parts:
                    spectra[p["g"]][p["channel"]] = np.array(p["lines"])
                    if masked:
                        xmin[p["g"]][p["channel"]] = np.array(p["xmin"])
                ms = False
                if channels == 2 and joint:
                    pairs = [((a + b) / 2**0.5, (a - b) / 2**0.5) for a, b in spectra]
                    ms = sum(np.abs(m).sum() + np.abs(s).sum() for m, s in pairs) < 0.9 * sum(np.abs(a).sum() + np.abs(b).sum() for a, b in spectra)
                    spectra = [list(p) for p in pairs] if ms else spectra
                    xmin = [[np.minimum(*row)] * 2 for row in xmin] if ms and masked else xmin
                data.append(L.encode_frame(spectra, hz, kbps, padding, ms, books, xmin, rounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["stream_id", "frame_no", "data"])

    return frames.select("stream_id", "frame_no", "parts", "padding").mapInArrow(run, "stream_id long, frame_no long, data binary")


def allowed_noise(rows: DataFrame, hz: int) -> DataFrame:
    """stream_id, channel, granule, xmin: allowed noise of the 22 long bands. rows: stream_id, channel, granule, x of 576 samples.

    A granule's three windows span its own samples and those of the four before, gathered by one aggregation over granule + 0..4,
    so thresholds are made in parallel; the pre-echo cap, floor and all, then is a running minimum.
    """
    spread = rows.select("stream_id", "channel", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((F.col("granule") + k).alias("granule"), k.alias("back")))).alias("to"), "x")
    seen = spread.groupBy("stream_id", "channel", "to.granule").agg(F.max(F.when(F.col("to.back") == 0, 1)).alias("own"), F.map_from_entries(F.collect_list(F.struct("to.back", "x"))).alias("past")).where("own = 1")
    silence = F.array_repeat(F.lit(0.0), 576)
    history = F.concat(*[F.coalesce(F.try_element_at("past", F.lit(k)), silence) for k in (4, 3, 2, 1, 0)])
    flat = seen.select("stream_id", "channel", "granule", F.slice(history, -(P.WINDOW + 2 * P.HOP), P.WINDOW + 2 * P.HOP).alias("history"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [P.raw_thresholds(np.array(x), hz) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["stream_id", "channel", "granule", "raw", "energy"])

    raw = flat.mapInArrow(thresholds, "stream_id long, channel int, granule long, raw array<double>, energy array<double>")
    part = raw.select("stream_id", "channel", "granule", F.posexplode("raw").alias("b", "v"))
    quiet = F.get(F.array(*[F.lit(float(q) / 2**30) for q in P.tables(hz).quiet]), F.col("b"))
    capped = pre_echo(part, ["stream_id", "channel", "b"], "granule", "v", quiet, "nb")
    cap = capped.groupBy("stream_id", "channel", "granule").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "nb"))), lambda x: x["nb"]).alias("nb"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's threshold is a power of the unscaled window's spectrum; CALIBRATION brings it to the lines' scale
        for b in batches:
            made = [CALIBRATION * P.to_bands(np.array(nb), np.array(e), hz)[0] for nb, e in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.list_(pa.float64()))], names=["stream_id", "channel", "granule", "xmin"])

    return cap.join(raw.select("stream_id", "channel", "granule", "energy"), ["stream_id", "channel", "granule"]).mapInArrow(bands, "stream_id long, channel int, granule long, xmin array<double>")


def join_frames(frames: DataFrame) -> DataFrame:
    """stream_id, content: the frames of each stream in order."""
    return frames.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "data"))).alias("f")).select("stream_id", F.aggregate("f", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("content"))
