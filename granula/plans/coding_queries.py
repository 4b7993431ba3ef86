"""Quantisation and coding over embeddings (64 lines in the first ten long bands) and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import dsp
from granula.functions import tables as T
from granula.operators import coding as C
from granula.plans.registry import EM, indexed, query, r4, table, vectors

BANDS = T.band_of_line(44100, 64)
_BAND = "bd AS (SELECT unnest(range(0, 64)) AS line, unnest([" + ", ".join(map(str, BANDS)) + "]) AS band)"
Q = 24  # 2^6: values of up to 0.6 become magnitudes of up to about 15
_IX = f"{EM}, {_BAND}, ln AS (SELECT vec_id, unnest(range(0, 64)) AS line, unnest(x) AS v FROM em), ix AS (SELECT ln.vec_id, ln.line, band, v, (sign(v) * least(floor(sqrt(abs(v) * 64.0 * sqrt(abs(v) * 64.0)) + 0.4054), 8206))::BIGINT AS ix FROM ln JOIN bd USING (line))"
_NOISE = f"{_IX}, nz AS (SELECT vec_id, band, sum(pow(abs(v) - pow(abs(ix)::DOUBLE, 4.0::DOUBLE / 3) / 64, 2)) AS noise, max(abs(v)) AS peak, sum(v * v) AS energy, sum(v * v) * 0.002 AS xmin FROM ix GROUP BY 1, 2)"


def quantised(spark, d):
    return vectors(spark, d).withColumn("ix", F.transform("x", lambda v: dsp.quantise(v, Q)))


def noise(spark, d):
    return C.band_noise(vectors(spark, d), ["vec_id"], F.col("x"), BANDS, Q).withColumn("xmin", F.col("energy") * 0.002)


@query(f"WITH {_IX} SELECT vec_id, line, ix FROM ix")
def q_quantize(spark, d):
    return indexed(quantised(spark, d), ["vec_id"], F.col("ix"), "ix", "line")


@query(f"WITH {_NOISE} SELECT vec_id, band, round(noise, 6) + 0.0 AS noise, round(peak, 4) + 0.0 AS peak FROM nz")
def q_noise_band(spark, d):
    return noise(spark, d).select("vec_id", "band", (F.round("noise", 6) + 0.0).alias("noise"), r4(F.col("peak")).alias("peak"))


@query(f"WITH {_NOISE} SELECT vec_id, count(*) FILTER (noise > xmin) AS over, round(coalesce(sum(noise - xmin) FILTER (noise > xmin), 0), 6) + 0.0 AS excess, round(coalesce(max(noise / xmin) FILTER (noise > xmin), 0), 3) + 0.0 AS ratio FROM nz GROUP BY 1")
def q_masking_metrics(spark, d):
    return C.masking_metrics(noise(spark, d), ["vec_id"]).select("vec_id", "over", (F.round("excess", 6) + 0.0).alias("excess"), (F.round("ratio", 3) + 0.0).alias("ratio"))


@query(f"WITH {_NOISE} SELECT vec_id, coalesce(arg_max(band, noise / xmin) FILTER (noise > xmin), -1)::BIGINT AS worst FROM nz GROUP BY 1")
def q_worst_band(spark, d):
    return C.worst_band(noise(spark, d), ["vec_id"])


@query(f"WITH {_NOISE}, m AS (SELECT vec_id, count(*) FILTER (noise > xmin) AS over, round(coalesce(sum(noise - xmin) FILTER (noise > xmin), 0), 9) AS excess, label FROM nz JOIN em USING (vec_id) GROUP BY vec_id, label) SELECT label::BIGINT AS label, (arg_min(vec_id, (excess, over, vec_id)))::BIGINT AS best FROM m GROUP BY 1")
def q_best_pass(spark, d):
    """Of each label's vectors the one with the least (excess, over), the earliest on ties."""
    m = C.masking_metrics(noise(spark, d), ["vec_id"]).withColumn("excess", F.round("excess", 9)).join(vectors(spark, d).select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    return C.better_pass(m, ["label"], ["excess", "over", "vec_id"], "vec_id").withColumnRenamed("vec_id", "best")


@query(f"WITH {_NOISE}, pk AS (SELECT vec_id, max(peak) * 20000 AS peak FROM nz GROUP BY 1), g AS (SELECT vec_id, peak, unnest(range(0, 256)) AS gg FROM pk), t AS (SELECT vec_id, gg, peak * [1.0::DOUBLE, pow(2.0::DOUBLE, 0.25), pow(2.0::DOUBLE, 0.5), pow(2.0::DOUBLE, 0.75)][((214 - gg) & 3) + 1] * pow(2.0::DOUBLE, (214 - gg) >> 2) AS t FROM g) SELECT vec_id, min(gg)::BIGINT AS min_gain FROM t WHERE sqrt(t * sqrt(t)) + 0.4054 <= 8206 GROUP BY 1")
def q_min_gain(spark, d):
    return C.least_gain(noise(spark, d).withColumn("peak", F.col("peak") * 20000), ["vec_id"]).select("vec_id", "min_gain")


_SMALL = f"{EM}, s AS (SELECT vec_id, [(sign(v) * least(floor(sqrt(abs(v) * 6.0 * sqrt(abs(v) * 6.0)) + 0.4054), 8206))::BIGINT * CASE WHEN vec_id % 3 = 0 AND i > 40 THEN 0 ELSE 1 END FOR v, i IN x] AS ix FROM em)"


def small(spark, d):
    """Magnitudes of 0 to 2; every third vector ends in zeros."""
    step = F.transform("x", lambda v, i: (F.signum(v) * F.least(F.floor(F.sqrt(F.abs(v) * 6.0 * F.sqrt(F.abs(v) * 6.0)) + 0.4054), F.lit(8206))).cast("long") * F.when((F.col("vec_id") % 3 == 0) & (i >= 40), 0).otherwise(1))
    return vectors(spark, d).select("vec_id", step.alias("ix"))


@query(f"""WITH {_SMALL}, u AS (SELECT vec_id, ix, coalesce(list_max([CASE WHEN v <> 0 THEN i ELSE 0 END FOR v, i IN ix]), 0) AS last, coalesce(list_max([CASE WHEN abs(v) > 1 THEN i ELSE 0 END FOR v, i IN ix]), 0) AS big FROM s),
w AS (SELECT vec_id, (last + 1) // 2 * 2 AS used, big FROM u) SELECT vec_id, ((used - 4 * ((used - big) // 4)) // 2)::BIGINT AS big_values, ((used - big) // 4)::BIGINT AS count1 FROM w""")
def q_spectrum_partition(spark, d):
    big, quads = dsp.spectrum_partition(F.col("ix"))
    return small(spark, d).select("vec_id", big.alias("big_values"), quads.alias("count1"))


def _len_sql(t: int) -> str:
    rows = T.PAIR_LENGTHS[t]
    return f"coalesce([[{'], ['.join(', '.join(map(str, r)) for r in rows)}]][ax + 1][ay + 1] + (ax > 0)::INT + (ay > 0)::INT, 1048576)::BIGINT AS c{t}"


_PAIRC = f"{_SMALL}, p AS (SELECT vec_id, unnest(range(0, 32)) AS pair, unnest([abs(ix[2 * p + 1]) FOR p IN range(0, 32)]) AS ax, unnest([abs(ix[2 * p + 2]) FOR p IN range(0, 32)]) AS ay FROM s), pc AS (SELECT vec_id, pair, ax, ay, {', '.join(_len_sql(t) for t in T.PAIR_LENGTHS)} FROM p)"


def pairs(spark, d):
    return small(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: F.struct(F.abs(F.get("ix", 2 * p)).alias("ax"), F.abs(F.get("ix", 2 * p + 1)).alias("ay"))).alias("pairs"))


@query(f"WITH {_PAIRC} SELECT vec_id, pair, c1, c2, c3 FROM pc")
def q_pair_cost(spark, d):
    flat = pairs(spark, d).select("vec_id", F.posexplode("pairs").alias("pair", "z")).select("vec_id", F.col("pair").cast("long").alias("pair"), "z.ax", "z.ay")
    return C.pair_costs(flat).select("vec_id", "pair", "c1", "c2", "c3")


@query(f"""WITH {_PAIRC}, b AS (SELECT vec_id, pair // 4 AS band, sum(c1) AS c1, sum(c2) AS c2, sum(c3) AS c3 FROM pc GROUP BY 1, 2),
px AS (SELECT vec_id, band + 1 AS k, sum(c1) OVER w AS p1, sum(c2) OVER w AS p2, sum(c3) OVER w AS p3 FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY band) UNION ALL SELECT DISTINCT vec_id, 0, 0, 0, 0 FROM b),
o AS (SELECT r0, r1, least(r0 + 1, 8) AS a, least(least(r0 + 1, 8) + r1 + 1, 8) AS c FROM (SELECT unnest(range(0, 16)) AS r0), (SELECT unnest(range(0, 8)) AS r1) WHERE r0 + r1 + 2 <= 8),
t AS (SELECT z.vec_id, r0, r1, least(a.p1 - z.p1, a.p2 - z.p2, a.p3 - z.p3) + least(c.p1 - a.p1, c.p2 - a.p2, c.p3 - a.p3) + least(e.p1 - c.p1, e.p2 - c.p2, e.p3 - c.p3) AS bits
FROM o JOIN px z ON z.k = 0 JOIN px a ON a.k = o.a AND a.vec_id = z.vec_id JOIN px c ON c.k = o.c AND c.vec_id = z.vec_id JOIN px e ON e.k = 8 AND e.vec_id = z.vec_id)
SELECT vec_id, min(bits)::BIGINT AS bits, arg_min(r0, (bits, r0, r1))::BIGINT AS r0, arg_min(r1, (bits, r0, r1))::BIGINT AS r1 FROM t GROUP BY 1""")
def q_region_search(spark, d):
    """Eight bands of four pairs: prefix costs, then the exact search over region bounds."""
    base = pairs(spark, d)
    prefix = []
    for t in T.PAIR_LENGTHS:
        at = lambda k, t=t: F.aggregate(F.slice("pairs", 1, k * 4), F.lit(0).cast("long"), lambda a, z: a + C.pair_cost(z["ax"], z["ay"], t))
        prefix.append(F.array(F.lit(0).cast("long"), *[at(k) for k in range(1, 9)]).alias(f"p{t}"))
    return C.region_costs(base.select("vec_id", *prefix), ["vec_id"])


@query(f"WITH {_SMALL}, q AS (SELECT vec_id, unnest(range(0, 16)) AS quad, unnest([[least(1, abs(ix[4 * k + 1])), least(1, abs(ix[4 * k + 2])), least(1, abs(ix[4 * k + 3])), least(1, abs(ix[4 * k + 4]))] FOR k IN range(0, 16)]) AS v FROM s), c AS (SELECT vec_id, sum([{', '.join(map(str, T.COUNT1_A))}][8 * v[1] + 4 * v[2] + 2 * v[3] + v[4] + 1] + list_sum(v)) AS a, sum(4 + list_sum(v)) AS b FROM q GROUP BY 1) SELECT vec_id, a::BIGINT AS bits_a, b::BIGINT AS bits_b, (a > b)::BIGINT AS count1_table FROM c")
def q_count1_cost(spark, d):
    quads = small(spark, d).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("ix", 4 * k + 1, 4))).alias("v"))
    a, b = C.count1_cost(F.col("v"))
    return quads.groupBy("vec_id").agg(F.sum(a).alias("bits_a"), F.sum(b).alias("bits_b")).withColumn("count1_table", (F.col("bits_a") > F.col("bits_b")).cast("long"))


_SCF = f"{EM}, sc AS (SELECT vec_id, label, [CASE WHEN i <= 11 THEN floor(abs(v) * 26)::BIGINT % 16 ELSE floor(abs(v) * 14)::BIGINT % 8 END FOR v, i IN x[1:21]] AS scf FROM em)"


def scalefactors(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(F.slice("x", 1, 21), lambda v, i: F.when(i < 11, F.floor(F.abs(v) * 26) % 16).otherwise(F.floor(F.abs(v) * 14) % 8)).alias("scf"))


@query(f"WITH {_SCF}, o AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(T.SLEN))}) AS o(i, s1, s2)), f AS (SELECT vec_id, i, 11 * s1 + 10 * s2 AS bits FROM sc, o WHERE list_max(scf[1:11]) <= (1 << s1) - 1 AND list_max(scf[12:21]) <= (1 << s2) - 1) SELECT sc.vec_id, min(bits)::BIGINT AS bits, arg_min(i, (bits, i))::BIGINT AS slot FROM sc LEFT JOIN f USING (vec_id) GROUP BY 1")
def q_scalefac_compress(spark, d):
    s = scalefactors(spark, d).withColumn("best", C.scalefac_compress(F.col("scf")))
    return s.select("vec_id", "best.bits", F.col("best.index").alias("slot"))


@query(f"WITH {_SCF}, z AS (SELECT vec_id, [v // 6 FOR v IN scf] AS scf FROM sc), j AS (SELECT a.vec_id // 2 AS pair, a.scf AS f, b.scf AS s FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0) SELECT pair, ((f[1:6] = s[1:6])::INT * 8 + (f[7:11] = s[7:11])::INT * 4 + (f[12:16] = s[12:16])::INT * 2 + (f[17:21] = s[17:21])::INT)::BIGINT AS mask FROM j")
def q_scfsi(spark, d):
    s = scalefactors(spark, d).withColumn("scf", F.transform("scf", lambda v: F.floor(v / 6)))
    both = s.groupBy(F.floor(F.col("vec_id") / 2).cast("long").alias("pair")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("scf"))).alias("f"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("scf"))).alias("s"))
    return both.where("f is not null and s is not null").select("pair", C.scfsi_mask(F.col("f"), F.col("s")).alias("mask"))


_DEMAND = "dm AS (SELECT event_id // 4 AS frame, event_id % 4 AS gc, greatest(836, least(3344, floor(greatest(0.0, value * 12))))::BIGINT AS demand FROM events)"


def demands(spark, d):
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("frame"), (F.col("event_id") % 4).alias("gc"), C.demand_bits(F.col("value") * 12, 1672).alias("demand"))


@query(f"WITH {_DEMAND} SELECT frame, gc, demand FROM dm")
def q_bit_demand(spark, d):
    return demands(spark, d)


@query(f"WITH {_DEMAND}, t AS (SELECT *, least((sum(demand) OVER (PARTITION BY frame) + 7) // 8, 700) * 8 AS target, sum(demand) OVER (PARTITION BY frame) AS total, row_number() OVER (PARTITION BY frame ORDER BY gc DESC) AS e FROM dm), s AS (SELECT *, (target * demand) // total AS share FROM t) SELECT frame, gc, target::BIGINT AS target, (CASE WHEN e = 1 THEN target - (sum(share) OVER (PARTITION BY frame) - share) ELSE share END)::BIGINT AS budget FROM s")
def q_budget_split(spark, d):
    s = C.split_budget(demands(spark, d), ["frame"], "gc", 700)
    return s.select("frame", "gc", F.col("target").cast("long").alias("target"), "budget")


@query("WITH f AS (SELECT event_id AS n, event_id % 512 AS occ, 383 - event_id % 2 AS area FROM events) SELECT n, greatest(0, occ + area - 511) AS lo, occ + area AS hi FROM f")
def q_spend_bounds(spark, d):
    """What a frame must and may spend, from the reservoir's occupancy and the frame's area."""
    f = table(spark, d, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 512).alias("occ"), (383 - F.col("event_id") % 2).alias("area"))
    return f.select("n", F.greatest(F.lit(0), F.col("occ") + F.col("area") - T.RESERVOIR).cast("long").alias("lo"), (F.col("occ") + F.col("area")).cast("long").alias("hi"))


@query("WITH f AS (SELECT event_id, 417 + event_id % 2 AS n_bytes, event_id % 2 AS padded, floor(abs(value))::BIGINT % 256 AS gain, user_id % 8 AS stream FROM events) SELECT stream, count(*) AS frames, sum(n_bytes)::BIGINT AS bytes, sum(padded)::BIGINT AS padded_frames, round(sum(gain)::DOUBLE / count(*), 4) + 0.0 AS mean_gain FROM f GROUP BY 1")
def q_encoder_stats(spark, d):
    f = table(spark, d, "events").select((F.col("user_id") % 8).alias("stream"), (417 + F.col("event_id") % 2).alias("n_bytes"), (F.col("event_id") % 2).alias("padded"), (F.floor(F.abs("value")) % 256).alias("gain"))
    return f.groupBy("stream").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_bytes").cast("long").alias("bytes"), F.sum("padded").cast("long").alias("padded_frames"), r4(F.sum("gain") / F.count(F.lit(1))).alias("mean_gain"))


@query("SELECT event_id AS n, (value <= 0 OR isnan(value))::BIGINT AS bad, max((value > 150)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS poisoned FROM events")
def q_poison_latch(spark, d):
    """Once a stream has met a bad sample it stays poisoned: a running maximum by user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("n"), ((F.col("value") <= 0) | F.isnan("value")).cast("long").alias("bad"), F.max((F.col("value") > 150).cast("long")).over(w).alias("poisoned"))


@query("""WITH RECURSIVE f AS (SELECT user_id % 8 AS s, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS n, 383 - event_id % 2 AS area, 200 + (event_id * 37) % 370 AS demand FROM events),
w AS (SELECT s, n, 0::BIGINT AS b, greatest(0, least(511, area - demand))::BIGINT AS a, area FROM f WHERE n = 0 UNION ALL
SELECT f.s, f.n, w.a, greatest(0, least(511, w.a + f.area - f.demand))::BIGINT, f.area FROM w JOIN f ON f.s = w.s AND f.n = w.n + 1)
SELECT s AS stream_id, n AS frame_no, b AS before, (b + area - a)::BIGINT AS spend, a AS after FROM w""")
def q_reservoir_occupancy(spark, d):
    """The bit reservoir of eight streams, frame by frame."""
    e = table(spark, d, "events")
    w = Window.partitionBy("stream_id").orderBy("event_id")
    f = e.select((F.col("user_id") % 8).alias("stream_id"), "event_id").withColumn("frame_no", (F.row_number().over(w) - 1).cast("long"))
    return C.reservoir_walk(f.select("stream_id", "frame_no", (383 - F.col("event_id") % 2).alias("area"), (200 + (F.col("event_id") * 37) % 370).alias("demand")))
