"""Headers, synchronisation, tags, sizing, trimming and seeking over byte streams made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.functions.bits import field, msb_bits, uint
from granula.operators import frames as R
from granula.plans.registry import query, table

_B = lambda p: f"('0x' || substr(h, {p}, 2))::BIGINT"
#: A 32-bit word of every event: md5 bytes, half of them given a sync.
_WORD = "wd AS (SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT & 2097151) | 4292870144 ELSE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT END AS word FROM events)"
_HDR = f"""{_WORD}, f AS (SELECT n, word, (word >> 24) & 255 AS b0, (word >> 16) & 255 AS b1, (word >> 19) & 3 AS version, (word >> 17) & 3 AS lb, (word >> 12) & 15 AS bi, (word >> 10) & 3 AS ri, (word >> 9) & 1 AS pad, (word >> 19) & 1 AS m1, (word >> 6) & 3 AS mode FROM wd),
v AS (SELECT *, 4 - lb AS layer, b0 = 255 AND ((b1 & 240) = 240 OR (b1 & 254) = 226) AND lb <> 0 AND bi <> 15 AND ri <> 3 AS valid FROM f),
s AS (SELECT *, CASE WHEN valid THEN [[[0,32,48,56,64,80,96,112,128,144,160,176,192,224,256],[0,8,16,24,32,40,48,56,64,80,96,112,128,144,160],[0,8,16,24,32,40,48,56,64,80,96,112,128,144,160]],[[0,32,64,96,128,160,192,224,256,288,320,352,384,416,448],[0,32,48,56,64,80,96,112,128,160,192,224,256,320,384],[0,32,40,48,56,64,80,96,112,128,160,192,224,256,320]]][m1 + 1][layer][bi + 1] END AS kbps,
CASE WHEN valid THEN [44100,48000,32000][ri + 1] // CASE version WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END END AS hz, CASE WHEN valid THEN CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND m1 = 0 THEN 576 ELSE 1152 END END AS samples FROM v),
z AS (SELECT *, CASE WHEN valid THEN CASE WHEN kbps = 0 THEN 0 WHEN layer = 1 THEN (samples * kbps * 125 // hz) // 4 * 4 + pad * 4 ELSE samples * kbps * 125 // hz + pad END END AS frame_bytes FROM s)"""


def words(spark, d):
    raw = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 2 == 0, raw.bitwiseAND(2097151).bitwiseOR(4292870144)).otherwise(raw).alias("word"))


@query(f"WITH {_HDR} SELECT n, valid::BIGINT AS valid, version::BIGINT AS version, layer::BIGINT AS layer, bi::BIGINT AS bitrate_index, pad::BIGINT AS padding, CASE WHEN mode = 3 THEN 1 ELSE 2 END::BIGINT AS channels, kbps::BIGINT AS kbps, hz::BIGINT AS hz, samples::BIGINT AS samples, frame_bytes::BIGINT AS frame_bytes FROM z")
def q_header_bits(spark, d):
    h = R.decode_headers(words(spark, d))
    return h.select("n", *[F.col(c).cast("long").alias(c) for c in ("valid", "version", "layer", "bitrate_index", "padding", "channels", "kbps", "hz", "samples", "frame_bytes")])


@query("""WITH e AS (SELECT event_id // 64 AS stream_id, event_id, md5(event_id::VARCHAR || 'a') AS a FROM events),
s AS (SELECT stream_id, string_agg(CASE WHEN event_id % 2 = 0 THEN 'FFFB' || upper(substr(a, 5)) ELSE upper(a) END, '' ORDER BY event_id) AS h FROM e GROUP BY 1),
o AS (SELECT stream_id, h, unnest(range(0, greatest(length(h) // 2 - 4, 0))) AS off FROM s), w AS (SELECT stream_id, off, ('0x' || substr(h, 2 * off + 1, 8))::BIGINT AS word FROM o)
SELECT stream_id, off, word FROM w WHERE (word >> 24) = 255 AND (((word >> 16) & 240) = 240 OR ((word >> 16) & 254) = 226) AND ((word >> 17) & 3) <> 0 AND ((word >> 12) & 15) <> 15 AND ((word >> 10) & 3) <> 3""")
def q_sync_candidates(spark, d):
    """Streams of 64 digests, every other one begun by a sync: all offsets with a valid header."""
    a = F.md5(F.concat(F.col("event_id").cast("string"), F.lit("a")).cast("binary"))
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 64).cast("long").alias("stream_id"), F.struct("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("fffb"), F.substring(a, 5, 28))).otherwise(a).alias("h")).alias("s"))
    streams = e.groupBy("stream_id").agg(F.unhex(F.concat_ws("", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]))).alias("content"))
    return R.sync_candidates(streams)


#: A stream of frames of every customer from its orders: each order a frame, a gap before every seventh.
_FR = """fr AS (SELECT o_custkey AS stream_id, o_orderkey, 417 + o_orderkey % 2 AS frame_bytes, CASE WHEN o_orderkey % 7 = 0 THEN 100 + CASE WHEN o_orderkey % 49 = 0 THEN 140000 ELSE 0 END ELSE 0 END AS skip FROM orders),
fo AS (SELECT stream_id, o_orderkey, frame_bytes, sum(frame_bytes + skip) OVER (PARTITION BY stream_id ORDER BY o_orderkey) - frame_bytes AS off, 4294672384 + (o_orderkey % 2) * 512 AS word FROM fr)"""


def frames(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", (417 + F.col("o_orderkey") % 2).alias("frame_bytes"), F.when(F.col("o_orderkey") % 7 == 0, 100 + F.when(F.col("o_orderkey") % 49 == 0, 140000).otherwise(0)).otherwise(0).alias("skip"))
    w = Window.partitionBy("stream_id").orderBy("o_orderkey")
    return o.select("stream_id", "frame_bytes", (F.sum(F.col("frame_bytes") + F.col("skip")).over(w) - F.col("frame_bytes")).alias("off"), (F.lit(4294672384) + (F.col("o_orderkey") % 2) * 512).alias("word"))


@query(f"WITH {_FR} SELECT a.stream_id, a.off::BIGINT AS off, b.off::BIGINT AS next_off FROM fo a LEFT JOIN fo b ON a.stream_id = b.stream_id AND a.off + a.frame_bytes = b.off AND (a.word & 16649216) = (b.word & 16649216)")
def q_frame_successor(spark, d):
    return R.successors(frames(spark, d)).select("stream_id", F.col("off").cast("long").alias("off"), F.col("next_off").cast("long").alias("next_off"))


@query(f"WITH {_FR}, g AS (SELECT stream_id, off, row_number() OVER w - 1 AS frame_no, off - coalesce(lag(off + frame_bytes) OVER w, off) AS gap FROM fo WINDOW w AS (PARTITION BY stream_id ORDER BY off)) SELECT stream_id, frame_no, gap::BIGINT AS gap, (sum((gap > 0)::BIGINT) OVER (PARTITION BY stream_id ORDER BY off))::BIGINT AS segment_id, CASE WHEN gap > 131072 THEN 'CORRUPT' ELSE 'OK' END AS status FROM g")
def q_segments(spark, d):
    s = R.segments(frames(spark, d))
    return s.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), F.col("gap").cast("long").alias("gap"), "segment_id", "status")


@query("WITH g AS (SELECT unnest(range(0, 2)) AS m1), l AS (SELECT m1, unnest(range(1, 4)) AS layer FROM g), b AS (SELECT *, unnest(range(1, 15)) AS bi FROM l), r AS (SELECT *, unnest(range(0, 3)) AS ri FROM b), p AS (SELECT *, unnest(range(0, 2)) AS pad FROM r), k AS (SELECT *, [[[32,48,56,64,80,96,112,128,144,160,176,192,224,256],[8,16,24,32,40,48,56,64,80,96,112,128,144,160],[8,16,24,32,40,48,56,64,80,96,112,128,144,160]],[[32,64,96,128,160,192,224,256,288,320,352,384,416,448],[32,48,56,64,80,96,112,128,160,192,224,256,320,384],[32,40,48,56,64,80,96,112,128,160,192,224,256,320]]][m1 + 1][layer][bi] AS kbps, [44100,48000,32000][ri + 1] // (2 - m1) AS hz, CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND m1 = 0 THEN 576 ELSE 1152 END AS samples FROM p) SELECT m1, layer, bi, ri, pad, kbps::BIGINT AS kbps, hz::BIGINT AS hz, (CASE WHEN layer = 1 THEN (samples * kbps * 125 // hz) // 4 * 4 + pad * 4 ELSE samples * kbps * 125 // hz + pad END)::BIGINT AS frame_bytes FROM k")
def q_sizing_grid(spark, d):
    """Every version, layer, bitrate, rate and padding."""
    g = spark.range(2).select(F.col("id").alias("m1"))
    for name, lo, hi in (("layer", 1, 3), ("bi", 1, 14), ("ri", 0, 2), ("pad", 0, 1)):
        g = g.withColumn(name, F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
    g = g.withColumn("kbps", R.bitrate_kbps(F.col("m1"), F.col("layer"), F.col("bi"))).withColumn("hz", R.sample_rate(2 + F.col("m1"), F.col("ri"))).withColumn("samples", R.frame_samples(F.col("m1"), F.col("layer")))
    return g.select("m1", "layer", "bi", "ri", "pad", F.col("kbps").cast("long").alias("kbps"), "hz", R.frame_bytes(F.col("samples"), F.col("kbps"), F.col("hz"), F.col("layer"), F.col("pad")).alias("frame_bytes"))


@query("SELECT event_id AS n, (((event_id + 1) * 42300) // 44100 - (event_id * 42300) // 44100)::BIGINT AS padding, (sum(((event_id + 1) * 42300) // 44100 - (event_id * 42300) // 44100) OVER (PARTITION BY event_id // 1000 ORDER BY event_id))::BIGINT AS padded_so_far FROM events")
def q_cbr_padding(spark, d):
    """128 kbit/s at 44.1 kHz: the padding bit of frame n, and the running number in blocks of 1000."""
    from pyspark.sql.window import Window

    p = table(spark, d, "events").select(F.col("event_id").alias("n"), R.cbr_padding(F.col("event_id"), F.lit(128), F.lit(44100)).alias("padding"))
    return p.withColumn("padded_so_far", F.sum("padding").over(Window.partitionBy(F.floor(F.col("n") / 1000)).orderBy("n")))


_DOCB = "db AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h0 FROM documents)"


@query(f"WITH {_DOCB}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '494433' || '0400' || CASE WHEN doc_id % 2 = 0 THEN '10' ELSE '00' END || h0 ELSE h0 END || CASE WHEN doc_id % 5 = 0 THEN '544147' || repeat('00', 125) ELSE '' END AS h FROM db) SELECT doc_id, (CASE WHEN length(h) >= 20 AND substr(h, 1, 6) = '494433' THEN 10 + (({_B(13)} & 127) << 21) + (({_B(15)} & 127) << 14) + (({_B(17)} & 127) << 7) + ({_B(19)} & 127) + CASE WHEN ({_B(11)} & 16) <> 0 THEN 10 ELSE 0 END ELSE 0 END)::BIGINT AS id3v2, (CASE WHEN length(h) >= 256 AND substr(h, length(h) - 255, 6) = '544147' THEN 128 ELSE 0 END)::BIGINT AS id3v1 FROM t")
def q_synchsafe(spark, d):
    """Tag sizes of documents as streams, every third given an ID3v2 head, every fifth an ID3v1 trailer."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("4944330400")), F.unhex(F.when(F.col("doc_id") % 2 == 0, F.lit("10")).otherwise(F.lit("00"))))).otherwise(F.unhex(F.lit("")))
    tail = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("544147" + "00" * 125))).otherwise(F.unhex(F.lit("")))
    s = table(spark, d, "documents").select("doc_id", F.concat(head, text, tail).alias("content"))
    return s.select("doc_id", R.id3v2_bytes(F.col("content")).alias("id3v2"), R.id3v1_bytes(F.col("content")).alias("id3v1"))


#: A frame of every document: header, 32 bytes of side info, a Xing tag whose flags are doc_id mod 16, then text bytes; LAME after it.
_XING = f"""{_DOCB}, x AS (SELECT doc_id, doc_id % 16 AS flags, CASE WHEN doc_id % 4 = 1 THEN '496E666F' ELSE '58696E67' END AS magic, substr(h0, 1, 400) AS body, 36 AS off FROM db),
y AS (SELECT *, 'FFFB9064' || repeat('00', 32) || magic || '000000' || lpad(upper(to_hex(flags)), 2, '0') || body AS h, 44 + CASE WHEN flags & 1 <> 0 THEN 4 ELSE 0 END AS pb, 44 + CASE WHEN flags & 1 <> 0 THEN 4 ELSE 0 END + CASE WHEN flags & 2 <> 0 THEN 4 ELSE 0 END AS pt FROM x),
w AS (SELECT *, pt + CASE WHEN flags & 4 <> 0 THEN 100 ELSE 0 END AS pq FROM y), q AS (SELECT *, pq + CASE WHEN flags & 8 <> 0 THEN 4 ELSE 0 END AS fin FROM w)"""


@query(f"WITH {_XING} SELECT doc_id, (CASE WHEN fin * 2 <= length(h) THEN (magic = '496E666F')::BIGINT END) AS is_info, (CASE WHEN fin * 2 <= length(h) AND flags & 1 <> 0 THEN ('0x' || substr(h, 89, 8))::BIGINT END) AS frames, (CASE WHEN fin * 2 <= length(h) AND flags & 2 <> 0 THEN ('0x' || substr(h, 2 * pb + 1, 8))::BIGINT END) AS n_bytes, (CASE WHEN fin * 2 <= length(h) AND flags & 8 <> 0 THEN ('0x' || substr(h, 2 * pq + 1, 8))::BIGINT END) AS quality, (CASE WHEN fin * 2 <= length(h) THEN fin END)::BIGINT AS lame_start, (CASE WHEN fin * 2 <= length(h) AND (fin + 24) * 2 <= length(h) THEN ('0x' || substr(h, 2 * (fin + 21) + 1, 6))::BIGINT >> 12 END) AS delay FROM q")
def q_tag_fields(spark, d):
    body = F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 200)
    magic = F.when(F.col("doc_id") % 4 == 1, F.lit("Info")).otherwise(F.lit("Xing")).cast("binary")
    flags = F.unhex(F.lpad(F.hex(F.col("doc_id") % 16), 8, "0"))
    s = table(spark, d, "documents").select("doc_id", F.concat(F.unhex(F.lit("FFFB9064" + "00" * 32)), magic, flags, body).alias("frame"))
    f = R.parse_xing(F.col("frame"), F.lit(36))
    s = s.select("doc_id", "frame", f["is_info"].cast("long").alias("is_info"), f["frames"].alias("frames"), f["bytes"].alias("n_bytes"), f["quality"].alias("quality"), f["lame_start"].cast("long").alias("lame_start"))
    return s.select("doc_id", "is_info", "frames", "n_bytes", "quality", "lame_start", field(uint(F.col("frame"), F.col("lame_start") + 21, 3), 12, 12).alias("delay"))


_VBRI = f"{_DOCB}, v AS (SELECT doc_id, 'FFFB9064' || repeat('00', 32) || '56425249' || substr(h0, 1, 28) || CASE WHEN doc_id % 4 = 0 THEN '0008' ELSE '0004' END || '0001' || lpad((doc_id % 4)::VARCHAR, 4, '0') || '0001' || substr(h0, 29, 64) AS h, doc_id % 4 AS w, CASE WHEN doc_id % 4 = 0 THEN 8 ELSE 4 END AS e, length(h0) AS l FROM db)"


@query(f"WITH {_VBRI} SELECT doc_id, (CASE WHEN ok THEN ('0x' || substr(h, 81, 4))::BIGINT END) AS version, (CASE WHEN ok THEN ('0x' || substr(h, 101, 8))::BIGINT END) AS frames, (CASE WHEN ok THEN e END)::BIGINT AS toc_entries, (CASE WHEN ok AND w IN (1, 2) THEN list_sum([('0x' || substr(h, 125 + 2 * w * i, 2 * w))::BIGINT FOR i IN range(0, 4)]) END)::BIGINT AS toc_sum FROM (SELECT *, w <> 0 AND length(h) >= 124 + 2 * w * e AND l >= 28 AS ok FROM v)")
def q_vbri_fields(spark, d):
    """A VBRI tag of every document: the head from text bytes, entry width doc_id mod 4, the table from the bytes after."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    entries = F.unhex(F.when(F.col("doc_id") % 4 == 0, F.lit("0008")).otherwise(F.lit("0004")))
    width = F.unhex(F.lpad((F.col("doc_id") % 4).cast("string"), 4, "0"))
    s = table(spark, d, "documents").select("doc_id", (F.length(text) >= 14).alias("long"), F.concat(F.unhex(F.lit("FFFB9064" + "00" * 32 + "56425249")), F.substring(text, 1, 14), entries, F.unhex(F.lit("0001")), width, F.unhex(F.lit("0001")), F.substring(text, 15, 32)).alias("frame"))
    f = R.parse_vbri(F.col("frame"))
    ok = F.col("long")
    return s.select("doc_id", F.when(ok, f["version"]).alias("version"), F.when(ok, f["frames"]).alias("frames"), F.when(ok, f["toc_entries"]).alias("toc_entries"), F.when(ok, F.aggregate(f["toc"], F.lit(0).cast("long"), lambda a, v: a + v)).alias("toc_sum"))


@query("WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, CASE WHEN doc_id % 5 = 0 THEN 128 ELSE 0 END AS t, (doc_id % 3) * 417 AS st FROM documents), a AS (SELECT doc_id, n - CASE WHEN n - t <= st THEN 0 ELSE t END - st AS span FROM s), f AS (SELECT doc_id, CASE WHEN span > 0 THEN span // 417 * 1152 ELSE 0 END AS samples FROM a) SELECT doc_id, samples::BIGINT AS samples, (CASE WHEN samples > 0 THEN samples // 44100 * 1000000000 + (samples % 44100) * 1000000000 // 44100 END)::BIGINT AS duration_ns FROM f")
def q_cbr_length(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    s = s.withColumn("samples", R.cbr_samples(F.col("n"), F.when(F.col("doc_id") % 5 == 0, 128).otherwise(0), (F.col("doc_id") % 3) * 417, F.lit(417), F.lit(1152)))
    return s.select("doc_id", "samples", R.duration_ns(F.col("samples"), F.lit(44100)).alias("duration_ns"))


_GAP = "fm AS (SELECT user_id AS stream_id, event_id AS frame_no, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1152 END AS n FROM events)"


@query(f"WITH {_GAP}, c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY frame_no) AS t FROM fm WHERE n > 0), k AS (SELECT stream_id, frame_no, t - n AS f, greatest(t - n, 1105) AS lo, least(t, 8000) AS hi FROM c) SELECT stream_id, frame_no, (lo - f)::BIGINT AS kept_from, (hi - f)::BIGINT AS kept_to FROM k WHERE lo < hi")
def q_gapless_trim(spark, d):
    """Frames of every user, some without samples, cut to playable samples 1105 to 8000."""
    f = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), F.when(F.col("event_id") % 9 == 0, 0).otherwise(1152).alias("n"))
    return R.gapless(f, 1105, 8000)


@query("SELECT event_id AS n, ((floor(abs(value) * 1000)::BIGINT + 1105) // 1152)::BIGINT AS frame, ((floor(abs(value) * 1000)::BIGINT + 1105) % 1152)::BIGINT AS intra, greatest(0, (floor(abs(value) * 1000)::BIGINT + 1105) // 1152 - 16)::BIGINT AS prime FROM events")
def q_seek_frame(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("n"), F.floor(F.abs("value") * 1000).cast("long").alias("sample"))
    return R.seek_plan(t, 1105, 1152).drop("sample")


@query("WITH f AS (SELECT user_id AS stream_id, event_id AS frame_no, event_id // 50 AS segment_id, 350 + event_id % 60 AS area, (event_id * 37) % 512 AS mdb FROM events), b AS (SELECT *, coalesce(sum(area) OVER (PARTITION BY stream_id, segment_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT stream_id, frame_no, (before - mdb)::BIGINT AS from_byte, (before + area)::BIGINT AS to_byte, (before - mdb >= 0)::BIGINT AS ok FROM b")
def q_reservoir_spans(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), F.floor(F.col("event_id") / 50).cast("long").alias("segment_id"), (350 + F.col("event_id") % 60).alias("area"), ((F.col("event_id") * 37) % 512).alias("main_data_begin"))
    return R.reservoir_spans(f).select("stream_id", "frame_no", F.col("from_byte").cast("long").alias("from_byte"), F.col("to_byte").cast("long").alias("to_byte"), F.col("ok").cast("long").alias("ok"))


_PLACE = "pl AS (SELECT user_id AS s, event_id AS p, 200 + event_id % 400 AS n, 417 + event_id % 2 AS m FROM events), a AS (SELECT s, p, sum(n) OVER w - n AS f, sum(n) OVER w AS t, sum(m) OVER w - m AS g, sum(m) OVER w AS u FROM pl WINDOW w AS (PARTITION BY s ORDER BY p))"


@query(f"WITH {_PLACE} SELECT a.s AS stream_id, a.p AS payload, b.p AS slot, (least(a.t, b.u) - greatest(a.f, b.g))::BIGINT AS overlap FROM a JOIN a b ON a.s = b.s AND greatest(a.f, b.g) < least(a.t, b.u)")
def q_interval_place(spark, d):
    """Payload bytes laid over frame slots: interval overlap by running sums."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("stream_id").orderBy("payload")
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("payload"), (200 + F.col("event_id") % 400).alias("n"), (417 + F.col("event_id") % 2).alias("m"))
    ends = e.withColumn("t", F.sum("n").over(w)).withColumn("u", F.sum("m").over(w))
    payloads = ends.select("stream_id", "payload", (F.col("t") - F.col("n")).alias("from_byte"), F.col("t").alias("to_byte"))
    slots = ends.select("stream_id", F.col("payload").alias("slot"), (F.col("u") - F.col("m")).alias("from_byte"), F.col("u").alias("to_byte"))
    return R.place_in_slots(payloads, slots)


@query("WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, len(b)::BIGINT AS n_bytes, coalesce(list_sum([('0x' || x)::BIGINT FOR x IN b]), 0)::BIGINT AS byte_sum, (CASE WHEN len(b) * 8 >= 26 THEN (('0x' || substr(h, 1, 8))::BIGINT >> 6) & 8191 ELSE 0 END)::BIGINT AS bits_13_26, (CASE WHEN len(b) * 8 >= 40 THEN ('0x' || substr(h, 5, 6))::BIGINT ELSE 0 END)::BIGINT AS bits_16_40 FROM b")
def q_document_bytes(spark, d):
    """Bytes as a bitstream: the sum of all bytes, and bit fields most significant first."""
    s = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("c"))
    pairs = F.regexp_extract_all(F.hex("c"), F.lit("(..)"))
    summed = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long"))
    return s.select("doc_id", F.length("c").cast("long").alias("n_bytes"), summed.alias("byte_sum"), msb_bits(F.col("c"), 13, 13).alias("bits_13_26"), msb_bits(F.col("c"), 16, 24).alias("bits_16_40"))
