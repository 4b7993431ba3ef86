"""Further header, tag, gating, scalefactor and bit-packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import tables as T
from granula.operators import frames as R
from granula.plans.coding_queries import _NOISE, _PAIRC, noise, pairs
from granula.plans.registry import EM, indexed, query, r4, table, vectors


@query(f"WITH {_NOISE}, m AS (SELECT vec_id, count(*) FILTER (noise > xmin) AS over, coalesce(max(noise / xmin) FILTER (noise > xmin), 0) AS ratio FROM nz GROUP BY 1) SELECT vec_id // 4 AS frame, arg_max(vec_id % 4, (over, ratio, -vec_id))::BIGINT AS neediest FROM m GROUP BY 1")
def q_neediest_granule(spark, d):
    """Of every four granules the one with the most bands over, then the greatest ratio, the first on ties."""
    from granula.operators.coding import masking_metrics

    m = masking_metrics(noise(spark, d), ["vec_id"])
    return m.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("frame")).agg(F.max_by(F.col("vec_id") % 4, F.struct("over", "ratio", (-F.col("vec_id")).alias("first"))).alias("neediest"))


@query(f"WITH {EM}, b AS (SELECT vec_id, unnest(range(0, 15)) AS band, unnest([list_max([abs(x[4 * b + k]) FOR k IN range(1, 5)]) FOR b IN range(0, 15)]) AS top FROM em), g AS (SELECT vec_id, unnest(range(0, 3)) AS lane FROM em) SELECT g.vec_id, lane, coalesce(max(band) FILTER (top > 0.25), -1)::BIGINT AS top_band FROM g LEFT JOIN b ON g.vec_id = b.vec_id AND band % 3 = lane GROUP BY 1, 2")
def q_top_band(spark, d):
    """Highest band of each window lane with a line over 0.25; -1 if none."""
    lane = lambda k: F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda b: (b % 3 == k) & (F.array_max(F.transform(F.slice("x", 4 * b + 1, 4), F.abs)) > 0.25)), lambda b: b))
    return indexed(vectors(spark, d), ["vec_id"], F.array(*[F.coalesce(lane(k), F.lit(-1)).cast("long") for k in range(3)]), "top_band", "lane")


@query(f"WITH {_PAIRC}, c AS (SELECT vec_id, pair, [['1', '001'], ['01', '000']][least(ax, 1) + 1][least(ay, 1) + 1] AS code FROM pc), bs AS (SELECT vec_id, string_agg(code, '' ORDER BY pair) AS s FROM c GROUP BY 1) SELECT vec_id, length(s)::BIGINT AS n_bits, lower(string_agg(printf('%02x', list_sum([substr(rpad(s, ((length(s) + 7) // 8 * 8)::INT, '0'), 8 * i + k + 1, 1)::INT << (7 - k) FOR k IN range(0, 8)])::INT), '' ORDER BY i)) AS packed FROM (SELECT vec_id, s, unnest(range(0, (length(s) + 7) // 8)) AS i FROM bs) GROUP BY vec_id, s")
def q_bit_writer(spark, d):
    """Codewords of table 1 written most significant bit first, the last byte padded with zeros."""
    code = lambda z: F.get(F.get(F.array(F.array(F.lit("1"), F.lit("001")), F.array(F.lit("01"), F.lit("000"))), F.least(z["ax"], F.lit(1)).cast("int")), F.least(z["ay"], F.lit(1)).cast("int"))
    s = pairs(spark, d).select("vec_id", F.concat_ws("", F.transform("pairs", code)).alias("s"))
    whole = F.expr("rpad(s, cast(ceil(length(s) / 8) * 8 as int), '0')")
    octets = F.transform(F.sequence(F.lit(0), F.ceil(F.length("s") / 8).cast("int") - 1), lambda i: F.lpad(F.lower(F.conv(F.substring(whole, i * 8 + 1, F.lit(8)), 2, 16)), 2, "0"))
    return s.select("vec_id", F.length("s").cast("long").alias("n_bits"), F.concat_ws("", octets).alias("packed"))


@query("WITH t AS (SELECT event_id AS n, event_id % 3 AS kind, event_id % 400 AS frames, (event_id * 7) % 4096 AS delay, (event_id * 13) % 4096 AS pad FROM events), a AS (SELECT *, CASE WHEN frames > 0 THEN frames * 1152 END AS total FROM t) SELECT n, delay AS kept_from, (CASE WHEN kind = 0 AND total IS NOT NULL THEN total - least(pad, total) END)::BIGINT AS kept_to, (CASE WHEN kind = 0 THEN greatest(0, total - delay - pad) ELSE total END)::BIGINT AS samples FROM a")
def q_apply_tags(spark, d):
    """Totals and trim windows from tags: kind 0 carries delay and padding, others only a frame count; 0 frames is unknown."""
    t = table(spark, d, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 3).alias("kind"), (F.col("event_id") % 400).alias("frames"), ((F.col("event_id") * 7) % 4096).alias("delay"), ((F.col("event_id") * 13) % 4096).alias("pad"))
    t = t.withColumn("total", F.when(F.col("frames") > 0, F.col("frames") * 1152))
    lame = F.col("kind") == 0
    trim = R.apply_lame(F.col("total"), F.when(lame, F.col("delay")), F.when(lame, F.col("pad")))
    return t.select("n", F.col("delay").alias("kept_from"), trim["kept_to"].alias("kept_to"), trim["samples"].alias("samples"))


@query("WITH g AS (SELECT unnest(range(1, 15)) AS bi), r AS (SELECT bi, unnest(range(0, 3)) AS ri FROM g), p AS (SELECT bi, ri, unnest(range(0, 2)) AS pad FROM r), m AS (SELECT *, unnest([0, 1, 3]) AS mode FROM p), e AS (SELECT *, unnest(CASE WHEN mode = 1 THEN [0, 2] ELSE [0] END) AS ext FROM m) SELECT bi, ri, pad, mode::BIGINT AS mode, ext::BIGINT AS ext, lower(printf('%08X', 4294639616 + bi * 4096 + ri * 1024 + pad * 512 + mode * 64 + ext * 16 + 4)) AS header FROM e")
def q_header_pack(spark, d):
    """The four header bytes of every bitrate, rate, padding and mode of an MPEG-1 encoder without CRC."""
    g = spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long"))).alias("bi"))
    g = g.withColumn("ri", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("pad", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    g = g.withColumn("mode", F.explode(F.array(*[F.lit(m).cast("long") for m in (0, 1, 3)]))).withColumn("ext", F.explode(F.when(F.col("mode") == 1, F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    word = F.lit(0xFFFB0000) + F.shiftleft("bi", 12) + F.shiftleft("ri", 10) + F.shiftleft("pad", 9) + F.shiftleft("mode", 6) + F.shiftleft("ext", 4) + 4
    return g.select("bi", "ri", "pad", "mode", "ext", F.lower(F.hex(word)).alias("header"))


@query("WITH c AS (SELECT event_id AS n, [44100, 48000, 32000, 22050][(event_id % 4) + 1] AS hz, event_id % 4 AS ch, (event_id * 31) % 400 * 1000 + CASE WHEN event_id % 11 = 0 THEN 500 ELSE 0 END AS bps, event_id % 5 = 0 AS quality FROM events) SELECT n, CASE WHEN hz NOT IN (44100, 48000, 32000) THEN 'RATE' WHEN ch NOT IN (1, 2) THEN 'CHANNELS' WHEN quality AND bps <> 0 THEN 'BOTH' WHEN quality THEN 'QUALITY' WHEN bps = 0 THEN 'OK' WHEN bps % 1000 <> 0 THEN 'NOT_KBPS' WHEN bps // 1000 NOT IN (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) THEN 'BITRATE' ELSE 'OK' END AS status, CASE WHEN bps = 0 THEN 128 ELSE bps // 1000 END::BIGINT AS kbps FROM c")
def q_config_checks(spark, d):
    """Encoder settings checked in order: rate, channels, bitrate against quality, default bitrate, whole kbit/s, legality."""
    e = F.col("event_id")
    c = table(spark, d, "events").select(e.alias("n"), F.get(F.array(*map(F.lit, [44100, 48000, 32000, 22050])), (e % 4).cast("int")).alias("hz"), (e % 4).alias("ch"), ((e * 31) % 400 * 1000 + F.when(e % 11 == 0, 500).otherwise(0)).alias("bps"), (e % 5 == 0).alias("quality"))
    kbps = F.floor(F.col("bps") / 1000)
    status = F.when(~F.col("hz").isin(T.RATES), "RATE").when(~F.col("ch").isin(1, 2), "CHANNELS").when(F.col("quality") & (F.col("bps") != 0), "BOTH").when(F.col("quality"), "QUALITY").when(F.col("bps") == 0, "OK").when(F.col("bps") % 1000 != 0, "NOT_KBPS").when(~kbps.isin(T.BITRATES[(1, 3)][1:]), "BITRATE").otherwise("OK")
    return c.select("n", status.alias("status"), F.when(F.col("bps") == 0, 128).otherwise(kbps).cast("long").alias("kbps"))


@query("WITH f AS (SELECT user_id AS stream_id, event_id AS frame_no, CASE WHEN event_id % 97 = 5 THEN 2 ELSE 3 END AS layer FROM events), s AS (SELECT *, min(CASE WHEN layer <> 3 THEN frame_no END) OVER (PARTITION BY stream_id) AS stop FROM f) SELECT stream_id, frame_no, layer::BIGINT AS layer, CASE WHEN stop IS NULL OR frame_no < stop THEN 'OK' WHEN frame_no = stop THEN 'UNSUPPORTED' ELSE 'AFTER_END' END AS status FROM s")
def q_layer_gate(spark, d):
    """The first frame of another layer ends a stream; frames after it are never read."""
    f = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), F.when(F.col("event_id") % 97 == 5, 2).otherwise(3).cast("long").alias("layer"))
    stop = F.min(F.when(F.col("layer") != 3, F.col("frame_no"))).over(Window.partitionBy("stream_id"))
    return f.withColumn("stop", stop).select("stream_id", "frame_no", "layer", F.when(F.col("stop").isNull() | (F.col("frame_no") < F.col("stop")), "OK").when(F.col("frame_no") == F.col("stop"), "UNSUPPORTED").otherwise("AFTER_END").alias("status"))


@query("WITH s AS (SELECT unnest(range(0, 512)) AS s) SELECT s AS scalefac_compress, CASE WHEN s < 400 THEN (s >> 4) // 5 WHEN s < 500 THEN ((s - 400) >> 2) // 5 ELSE (s - 500) // 3 END::BIGINT AS slen1, CASE WHEN s < 400 THEN (s >> 4) % 5 WHEN s < 500 THEN ((s - 400) >> 2) % 5 ELSE (s - 500) % 3 END::BIGINT AS slen2, CASE WHEN s < 400 THEN (s % 16) >> 2 WHEN s < 500 THEN (s - 400) % 4 ELSE 0 END::BIGINT AS slen3, CASE WHEN s < 400 THEN s % 4 ELSE 0 END::BIGINT AS slen4, (s >= 500)::BIGINT AS preflag FROM s")
def q_lsf_scalefac(spark, d):
    """MPEG-2 scalefactor lengths of every scalefac_compress without intensity stereo."""
    s = F.col("s")
    low, mid = s < 400, s < 500
    div = lambda x, n: F.floor(x / n)
    pick = lambda a, b, c: F.when(low, a).when(mid, b).otherwise(c).cast("long")
    g = spark.range(512).withColumnRenamed("id", "s")
    return g.select(s.alias("scalefac_compress"), pick(div(F.shiftright(s, 4), 5), div(F.shiftright(s - 400, 2), 5), div(s - 500, 3)).alias("slen1"), pick(F.shiftright(s, 4) % 5, F.shiftright(s - 400, 2) % 5, (s - 500) % 3).alias("slen2"), pick(F.shiftright(s % 16, 2), (s - 400) % 4, F.lit(0)).alias("slen3"), pick(s % 4, F.lit(0), F.lit(0)).alias("slen4"), (s >= 500).cast("long").alias("preflag"))


@query(f"WITH {EM}, p AS (SELECT vec_id, unnest(range(0, 21)) AS band, unnest([floor(abs(v) * 26)::BIGINT % 16 FOR v IN x[1:21]]) AS scf, 180 + vec_id % 40 AS gain, vec_id % 2 AS scale, (vec_id // 2) % 2 AS pre FROM em), t AS (SELECT *, [{', '.join(map(str, T.PRETAB))}][band + 1] AS pt FROM p) SELECT vec_id, band, round(log2(pow(2.0::DOUBLE, (gain - 210 - 2 * (scale + 1) * (scf + pre * pt)) / 4.0::DOUBLE)), 4) + 0.0 AS log_step FROM t")
def q_scalefactor_gain(spark, d):
    """The dequantiser step of every band: global gain, scale, scalefactor and pretab in quarter powers of two."""
    v = vectors(spark, d).select("vec_id", F.posexplode(F.transform(F.slice("x", 1, 21), lambda v: F.floor(F.abs(v) * 26) % 16)).alias("band", "scf"))
    pre = F.get(F.array(*map(F.lit, T.PRETAB)), F.col("band")) * (F.floor(F.col("vec_id") / 2) % 2)
    q = 180 + F.col("vec_id") % 40 - 210 - 2 * (F.col("vec_id") % 2 + 1) * (F.col("scf") + pre)
    return v.select("vec_id", F.col("band").cast("long").alias("band"), r4(F.log2(F.pow(F.lit(2.0), q / 4.0))).alias("log_step"))


@query("WITH g AS (SELECT unnest(range(0, 8207)) AS x) SELECT x, round(pow(x::DOUBLE, 4.0::DOUBLE / 3), 3) + 0.0 AS pow43 FROM g")
def q_pow43(spark, d):
    return spark.range(8207).select(F.col("id").alias("x"), (F.round(F.pow(F.col("id").cast("double"), F.lit(4.0 / 3.0)), 3) + 0.0).alias("pow43"))


@query("WITH s AS (SELECT event_id AS n, (event_id * 53) % 512 AS mdb, (event_id * 29) % 320 AS big, event_id % 2 AS switched, (event_id // 2) % 4 AS block, (event_id * 71) % 4096 AS part, 300 + event_id % 100 AS bytes FROM events) SELECT n, CASE WHEN big > 288 THEN 'BIG_VALUES' WHEN switched = 1 AND block = 0 THEN 'BLOCK_TYPE' WHEN part + 256 > 8 * bytes + 8 * mdb THEN 'OVERRUN' ELSE 'OK' END AS status FROM s")
def q_side_info_rejects(spark, d):
    """Malformed side info: too many pairs, a switched window without a block type, more bits than the frame and its reservoir have."""
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("n"), F.when((e * 29) % 320 > 288, "BIG_VALUES").when((e % 2 == 1) & (F.floor(e / 2) % 4 == 0), "BLOCK_TYPE").when((e * 71) % 4096 + 256 > 8 * (300 + e % 100) + 8 * ((e * 53) % 512), "OVERRUN").otherwise("OK").alias("status"))


@query("SELECT doc_id, (CASE WHEN octet_length(encode(coalesce(text, ''))) > 0 THEN 4 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN 32 WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 9 ELSE 17 END END)::BIGINT AS main_data_at FROM documents")
def q_side_info_size(spark, d):
    """Where main data starts: header, CRC, then 32, 17 or 9 bytes by version and channels."""
    size = R.side_info_bytes((F.col("doc_id") % 3 > 0).cast("int"), F.when(F.col("doc_id") % 5 > 0, 2).otherwise(1))
    at = 4 + F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0) + size
    return table(spark, d, "documents").select("doc_id", F.when(F.octet_length(F.coalesce("text", F.lit(""))) > 0, at).cast("long").alias("main_data_at"))
