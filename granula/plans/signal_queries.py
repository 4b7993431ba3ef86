"""Signals, filterbank, transforms, stereo and psychoacoustics over events.value and embeddings.embedding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import dsp
from granula.functions import tables as T
from granula.operators import signal as S
from granula.plans.registry import EM, indexed, query, r4, table, vectors

GRANULE = "ev AS (SELECT event_id AS n, value AS v FROM events)"
TAPS = [math.sin(math.pi * (k + 0.5) / 16) / 16 for k in range(16)]
PARTS = 16


def events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("n"), F.col("value").alias("v"))


def g_sql(size: int) -> str:
    return f"{GRANULE}, gr AS (SELECT n // {size} AS granule, list_resize(list(v ORDER BY n), {size}, 0.0::DOUBLE) AS x FROM ev GROUP BY 1)"


@query(f"WITH {GRANULE} SELECT n // 576 AS granule, count(*) AS n_samples, round(sum(v), 2) + 0.0 AS total FROM ev GROUP BY 1")
def q_frame_granules(spark, d):
    return S.granule_counts(events(spark, d), 576).withColumn("total", F.round("total", 2) + 0.0)


@query(f"WITH {GRANULE}, w AS (SELECT v, unnest(range(greatest(0, (n - 1024 + 576) // 576 - CASE WHEN n - 1024 + 576 < 0 THEN 1 ELSE 0 END)::BIGINT, (n // 576 + 1)::BIGINT)) AS w FROM ev) SELECT w, count(*) AS n_samples, round(sum(v * v), 2) + 0.0 AS energy FROM w GROUP BY 1")
def q_sliding_1024_576(spark, d):
    return S.sliding_energy(events(spark, d)).withColumn("energy", F.round("energy", 2) + 0.0)


@query(f"WITH {EM}, e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(x) * 3 AS v FROM em) SELECT vec_id, i, round(greatest(-1.0, least(1.0, v)), 4) + 0.0 AS clamped, greatest(-32768, least(32767, round(greatest(-1.0, least(1.0, v)) * 32768.0)::BIGINT))::BIGINT AS s16 FROM e")
def q_clamp_s16(spark, d):
    e = indexed(vectors(spark, d), ["vec_id"], F.transform("x", lambda v: dsp.clamp(v * 3)), "v")
    return e.select("vec_id", "i", r4(F.col("v")).alias("clamped"), dsp.to_s16(F.col("v")).alias("s16"))


@query(f"WITH {EM} SELECT vec_id, unnest(range(0, 64)) AS slot, round(unnest([x[(s % 2) * 32 + s // 2 + 1] FOR s IN range(0, 64)]), 4) + 0.0 AS v FROM em")
def q_interleave(spark, d):
    """Planar to interleaved: channel 0 is the first half."""
    return indexed(vectors(spark, d), ["vec_id"], F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: r4(F.get("x", ((s % 2) * 32 + F.floor(s / 2)).cast("int")))), "v", "slot")


@query(f"WITH {EM} SELECT vec_id, unnest(range(0, 32)) AS b, unnest([round(list_sum([x[j + 1] * cos((2 * b + 1) * (j - 16) * pi() / 64) FOR j IN range(0, 64)]), 4) + 0.0 FOR b IN range(0, 32)]) AS s FROM em")
def q_matrixing(spark, d):
    return indexed(vectors(spark, d), ["vec_id"], F.transform(dsp.matvec(T.matrixing_kernel(), F.col("x")), r4), "s", "b")


@query(f"WITH {EM}, f AS (SELECT vec_id // 8 AS blk, unnest(range(0, 64)) AS j, unnest(x) AS v FROM em) SELECT blk, j, count(*) AS n_terms, round(sum(v), 4) + 0.0 AS y FROM f GROUP BY 1, 2")
def q_partial_sums(spark, d):
    """y[j] over eight vectors of 64: the windowed history folded."""
    flat = indexed(vectors(spark, d), [F.floor(F.col("vec_id") / 8).cast("long").alias("blk")], F.col("x"), "v", "j")
    return flat.groupBy("blk", "j").agg(F.count(F.lit(1)).alias("n_terms"), r4(F.sum("v")).alias("y"))


@query(f"WITH {GRANULE}, t AS (SELECT unnest(range(0, 16)) AS k), y AS (SELECT ev.n + k AS n, sum(v * sin(pi() * (k + 0.5) / 16) / 16) AS y FROM ev, t GROUP BY 1) SELECT y.n, round(y, 3) + 0.0 AS y FROM y JOIN ev USING (n)")
def q_fir_window(spark, d):
    e = events(spark, d)
    g = S.fir(S.to_granules(e, 576), TAPS)
    flat = g.select(F.col("granule"), F.posexplode("x").alias("line", "y")).select((F.col("granule") * 576 + F.col("line")).alias("n"), (F.round("y", 3) + 0.0).alias("y"))
    return flat.join(e.select("n"), "n", "left_semi")


_MDCT = f"""{g_sql(18)}, pr AS (SELECT a.granule, list_concat(coalesce(b.x, [0.0::DOUBLE FOR i IN range(0, 18)]), a.x) AS z FROM gr a LEFT JOIN gr b ON b.granule = a.granule - 1),
mdct AS (SELECT granule, [list_sum([z[i + 1] * sin(pi() / 36 * (i + 0.5)) * cos(pi() / 72 * (2 * i + 19) * (2 * k + 1)) / 9 FOR i IN range(0, 36)]) FOR k IN range(0, 18)] AS c FROM pr)"""


@query(f"WITH {_MDCT} SELECT granule, unnest(range(0, 18)) AS k, unnest([round(v, 3) + 0.0 FOR v IN c]) AS coefficient FROM mdct")
def q_mdct18(spark, d):
    m = S.mdct(S.to_granules(events(spark, d), 18))
    return indexed(m, ["granule"], F.transform("x", lambda v: F.round(v, 3) + 0.0), "coefficient", "k")


@query(f"WITH {_MDCT}, sy AS (SELECT granule, [list_sum([c[k + 1] * sin(pi() / 36 * (i + 0.5)) * cos(pi() / 72 * (2 * i + 19) * (2 * k + 1)) FOR k IN range(0, 18)]) FOR i IN range(0, 36)] AS y FROM mdct) SELECT a.granule, unnest(range(0, 18)) AS i, unnest([round(a.y[i + 1] + coalesce(b.y[i + 19], 0), 3) + 0.0 FOR i IN range(0, 18)]) AS sample FROM sy a LEFT JOIN sy b ON b.granule = a.granule - 1")
def q_imdct_ola(spark, d):
    """Time-domain alias cancellation: the samples come back one granule late."""
    m = S.imdct(S.mdct(S.to_granules(events(spark, d), 18)))
    return indexed(m, ["granule"], F.transform("x", lambda v: F.round(v, 3) + 0.0), "sample")


def _butterfly_sql(sign: int) -> str:
    c = "[" + ", ".join(str(v) for v in T.ALIAS_C) + "]"
    return f"""WITH {g_sql(576)}, l AS (SELECT granule, unnest(range(0, 576)) AS i, unnest(x) AS v FROM gr),
    k AS (SELECT unnest(range(0, 8)) AS k, unnest({c})::DOUBLE AS c), w AS (SELECT k, 1 / sqrt(1 + c * c) AS cs, {sign} * c / sqrt(1 + c * c) AS ca FROM k),
    b AS (SELECT granule, i, v, CASE WHEN i >= 18 AND i % 18 < 8 THEN i % 18 END AS up, CASE WHEN i < 558 AND i % 18 >= 10 THEN 17 - i % 18 END AS dn FROM l)
    SELECT b.granule, b.i, round(CASE WHEN up IS NOT NULL THEN b.v * cs - o.v * ca WHEN dn IS NOT NULL THEN b.v * cs + o.v * ca ELSE b.v END, 3) + 0.0 AS v
    FROM b LEFT JOIN w ON w.k = coalesce(up, dn) LEFT JOIN l o ON o.granule = b.granule AND o.i = CASE WHEN up IS NOT NULL THEN b.i - 2 * up - 1 ELSE b.i + 2 * dn + 1 END"""


@query(_butterfly_sql(1))
def q_antialias(spark, d):
    g = S.to_granules(events(spark, d), 576)
    return indexed(g, ["granule"], F.transform(dsp.butterflies(F.col("x"), T.ALIAS_CS, T.ALIAS_CA, 18, False), lambda v: F.round(v, 3) + 0.0), "v")


@query(_butterfly_sql(-1))
def q_alias_reduce(spark, d):
    g = S.to_granules(events(spark, d), 576)
    return indexed(g, ["granule"], F.transform(dsp.butterflies(F.col("x"), T.ALIAS_CS, T.ALIAS_CA, 18, True), lambda v: F.round(v, 3) + 0.0), "v")


@query(f"WITH {g_sql(576)} SELECT granule, unnest(range(0, 576)) AS i, unnest([round(CASE WHEN (i // 18) % 2 = 1 AND (i % 18) % 2 = 1 THEN -x[i + 1] ELSE x[i + 1] END, 3) + 0.0 FOR i IN range(0, 576)]) AS v FROM gr")
def q_odd_flip(spark, d):
    return indexed(S.to_granules(events(spark, d), 576), ["granule"], F.transform(dsp.flip_odd(F.col("x"), 18), lambda v: F.round(v, 3) + 0.0), "v")


_PAIRS = f"{EM}, p AS (SELECT a.vec_id // 2 AS pair, a.x AS l, b.x AS r FROM em a JOIN em b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0)"
_E = lambda e: f"list_sum([{e} FOR i IN range(1, 65)])"


@query(f"WITH {_PAIRS}, e AS (SELECT pair, {_E('(l[i] + r[i]) * (l[i] + r[i]) / 2')} AS em, {_E('(l[i] - r[i]) * (l[i] - r[i]) / 2')} AS es, {_E('l[i] * l[i]')} AS el, {_E('r[i] * r[i]')} AS er FROM p) SELECT pair, round(em, 4) + 0.0 AS e_mid, round(es, 4) + 0.0 AS e_side, (least(em, es) < 0.5 * least(el, er))::BIGINT AS prefer_ms FROM e")
def q_ms_stereo(spark, d):
    p = S.stereo_pairs(vectors(spark, d), "vec_id")
    m, s = S.mid_side(F.col("l"), F.col("r"), math.sqrt(0.5))
    e = p.select("pair", dsp.energy(m).alias("em"), dsp.energy(s).alias("es"), dsp.energy(F.col("l")).alias("el"), dsp.energy(F.col("r")).alias("er"))
    return e.select("pair", r4(F.col("em")).alias("e_mid"), r4(F.col("es")).alias("e_side"), (F.least("em", "es") < 0.5 * F.least("el", "er")).cast("long").alias("prefer_ms"))


@query(f"WITH {EM}, p AS (SELECT vec_id, x, vec_id % 7 AS pos, tan((vec_id % 7) * pi() / 12) AS t FROM em) SELECT vec_id, unnest(range(0, 64)) AS i, unnest([round(v * CASE WHEN pos = 6 THEN 1 ELSE t / (1 + t) END, 4) + 0.0 FOR v IN x]) AS l, unnest([round(v * CASE WHEN pos = 6 THEN 0 ELSE 1 / (1 + t) END, 4) + 0.0 FOR v IN x]) AS r FROM p")
def q_intensity(spark, d):
    kl, kr = S.intensity(F.col("vec_id") % 7)
    p = vectors(spark, d).withColumn("kl", kl).withColumn("kr", kr)
    both = F.transform("x", lambda v: F.struct(r4(v * F.col("kl")).alias("l"), r4(v * F.col("kr")).alias("r")))
    return indexed(p, ["vec_id"], both, "s").select("vec_id", "i", "s.l", "s.r")


@query(f"WITH {EM} SELECT vec_id, unnest(range(0, 60)) AS i, unnest([round(x[(i // 12) * 12 + (i % 3) * 4 + (i % 12) // 3 + 1], 4) + 0.0 FOR i IN range(0, 60)]) AS v FROM em")
def q_reorder_short(spark, d):
    return indexed(vectors(spark, d), ["vec_id"], F.transform(dsp.reorder_short(F.col("x"), [4] * 5), r4), "v")


@query(f"WITH {EM} SELECT vec_id, unnest(range(0, 32)) AS k, unnest([round(list_sum([x[i + 1] * cos(pi() / 32 * (i + 0.5) * k) FOR i IN range(0, 32)]), 4) + 0.0 FOR k IN range(0, 32)]) AS y FROM em")
def q_dct2_32(spark, d):
    return indexed(vectors(spark, d), ["vec_id"], F.transform(dsp.matvec(T.dct2_kernel(), F.slice("x", 1, 32)), r4), "y", "k")


@query(f"WITH {EM} SELECT vec_id, unnest(range(0, 64)) AS i, unnest([round(list_sum([x[k + 1] * cos((16 + i) * (2 * k + 1) * pi() / 64) FOR k IN range(0, 32)]), 4) + 0.0 FOR i IN range(0, 64)]) AS u FROM em")
def q_synthesis_matrix(spark, d):
    return indexed(vectors(spark, d), ["vec_id"], F.transform(dsp.matvec(T.synthesis_kernel(), F.slice("x", 1, 32)), r4), "u")


_DFT = f"""{EM}, sp AS (SELECT vec_id, label, [list_sum([x[i + 1] * sqrt(8.0 / 3) * 0.5 * (1 - cos(2 * pi() * i / 64)) * cos(2 * pi() * i * k / 64) FOR i IN range(0, 64)]) FOR k IN range(0, 33)] AS re,
[list_sum([x[i + 1] * sqrt(8.0 / 3) * 0.5 * (1 - cos(2 * pi() * i / 64)) * -sin(2 * pi() * i * k / 64) FOR i IN range(0, 64)]) FOR k IN range(0, 33)] AS im FROM em)"""


def spectra(spark, d):
    re, im = T.dft_kernel()
    return vectors(spark, d).select("vec_id", "label", dsp.matvec(re, F.col("x")).alias("re"), dsp.matvec(im, F.col("x")).alias("im"))


def powers(df):
    return df.withColumn("p", F.zip_with("re", "im", lambda a, b: a * a + b * b))


@query(f"WITH {_DFT} SELECT vec_id, unnest(range(0, 33)) AS k, unnest([round(re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1], 4) + 0.0 FOR k IN range(0, 33)]) AS power FROM sp")
def q_dft_power(spark, d):
    return indexed(powers(spectra(spark, d)), ["vec_id"], F.transform("p", r4), "power", "k")


@query(f"""WITH {_DFT}, b AS (SELECT vec_id, label, unnest(range(0, 33)) AS k, unnest(re) AS re, unnest(im) AS im FROM sp),
h AS (SELECT *, lag(re, 1) OVER w AS re1, lag(im, 1) OVER w AS im1, lag(re, 2) OVER w AS re2, lag(im, 2) OVER w AS im2 FROM b WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)),
m AS (SELECT *, sqrt(re * re + im * im) AS r, sqrt(re1 * re1 + im1 * im1) AS r1, sqrt(re2 * re2 + im2 * im2) AS r2 FROM h WHERE re2 IS NOT NULL),
c AS (SELECT *, (re1 * re1 - im1 * im1) / (r1 * r1) AS c2, 2 * re1 * im1 / (r1 * r1) AS s2, re2 / r2 AS cf, im2 / r2 AS sf, 2 * r1 - r2 AS rp FROM m)
SELECT vec_id, k, round(least(1.0, sqrt(pow(re - rp * (c2 * cf + s2 * sf), 2) + pow(im - rp * (s2 * cf - c2 * sf), 2)) / (r + abs(rp))), 3) + 0.0 AS cw FROM c""")
def q_unpredictability(spark, d):
    """How far a bin is from the extrapolation of its last two spectra, 0 to 1, by label."""
    bins = spectra(spark, d).select("vec_id", "label", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("vec_id", "label", F.col("k").cast("long").alias("k"), "z.re", "z.im")
    w = Window.partitionBy("label", "k").orderBy("vec_id")
    h = bins.select("*", *[F.lag(c, i).over(w).alias(f"{c}{i}") for c in ("re", "im") for i in (1, 2)]).where("re2 is not null")
    m = h.withColumn("r", F.sqrt(F.expr("re * re + im * im"))).withColumn("r1", F.sqrt(F.expr("re1 * re1 + im1 * im1"))).withColumn("r2", F.sqrt(F.expr("re2 * re2 + im2 * im2")))
    c = m.selectExpr("vec_id", "k", "re", "im", "r", "(re1 * re1 - im1 * im1) / (r1 * r1) as c2", "2 * re1 * im1 / (r1 * r1) as s2", "re2 / r2 as cf", "im2 / r2 as sf", "2 * r1 - r2 as rp")
    dist = F.sqrt(F.expr("pow(re - rp * (c2 * cf + s2 * sf), 2) + pow(im - rp * (s2 * cf - c2 * sf), 2)"))
    return c.select("vec_id", "k", (F.round(F.least(F.lit(1.0), dist / (F.col("r") + F.abs("rp"))), 3) + 0.0).alias("cw"))


def partitions(spark, d):
    """Energy of 16 partitions of two bins (the last takes bin 32 too)."""
    p = powers(spectra(spark, d))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda b: F.get("p", 2 * b) + F.get("p", 2 * b + 1) + F.when(b == PARTS - 1, F.get("p", F.lit(32))).otherwise(0.0))
    return p.select("vec_id", "label", parts.alias("e"))


_PART = f"{_DFT}, pw AS (SELECT vec_id, [re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1] FOR k IN range(0, 33)] AS p FROM sp), pt AS (SELECT vec_id, [p[2 * b + 1] + p[2 * b + 2] + CASE WHEN b = 15 THEN p[33] ELSE 0 END FOR b IN range(0, 16)] AS e FROM pw)"
_SPREAD = """sd AS (SELECT b, bb, (b - bb) / 3.0::DOUBLE AS dz FROM (SELECT unnest(range(0, 16)) AS b), (SELECT unnest(range(0, 16)) AS bb)),
db AS (SELECT b, bb, 15.811389 + 7.5 * (dz + 0.474) - 17.5 * sqrt(1 + (dz + 0.474) * (dz + 0.474)) + CASE WHEN dz >= 0.5 AND dz <= 2.5 THEN 8 * least((dz - 0.5) * (dz - 0.5) - 2 * (dz - 0.5), 0) ELSE 0 END AS db FROM sd),
sk AS (SELECT b, list(CASE WHEN db <= -100 THEN 0 ELSE pow(10.0::DOUBLE, db / 10) END ORDER BY bb) AS s FROM db GROUP BY b),
ec AS (SELECT vec_id, b, e[b + 1] AS e, list_sum([e[i] * s[i] FOR i IN range(1, 17)]) AS ecb, list_sum([e[i] * s[i] * (0.05 + 0.9 * ((i - 1) % 5) / 5.0) FOR i IN range(1, 17)]) AS cbs, list_sum(s) AS ns FROM pt, sk)"""


@query(f"WITH {_PART} SELECT vec_id, unnest(range(0, 16)) AS b, unnest([round(v, 4) + 0.0 FOR v IN e]) AS energy FROM pt")
def q_partition_energy(spark, d):
    return indexed(partitions(spark, d), ["vec_id"], F.transform("e", r4), "energy", "b")


def spread(spark, d):
    """vec_id, b, e, ecb, cbs, ns: energies and weighted unpredictabilities convolved with the spreading function."""
    s = T.spreading(PARTS)
    cw = dsp.vector([0.05 + 0.9 * (i % 5) / 5.0 for i in range(PARTS)])
    p = partitions(spark, d).withColumn("ecb", dsp.matvec(s, F.col("e"))).withColumn("cbs", dsp.matvec(s, F.zip_with("e", cw, lambda a, b: a * b)))
    flat = p.withColumn("ns", dsp.vector([float(sum(r)) for r in s])).select("vec_id", F.posexplode(F.arrays_zip("e", "ecb", "cbs", "ns")).alias("b", "z"))
    return flat.select("vec_id", F.col("b").cast("long").alias("b"), "z.e", "z.ecb", "z.cbs", "z.ns")


@query(f"WITH {_PART}, {_SPREAD} SELECT vec_id, b, round(ecb, 3) + 0.0 AS ecb FROM ec")
def q_spreading(spark, d):
    return spread(spark, d).select("vec_id", "b", (F.round("ecb", 3) + 0.0).alias("ecb"))


def thresholds(df):
    """Tonality by the clamped logarithm, then the masking threshold."""
    tb = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -0.299 - 0.43 * F.log(F.least(F.lit(1.0), F.col("cbs") / F.col("ecb")))))
    t = df.withColumn("tb", F.when((F.col("ecb") > 0) & (F.col("cbs") > 0), tb).when(F.col("ecb") > 0, 1.0).otherwise(0.0))
    return t.withColumn("nb", F.col("ecb") / F.col("ns") * F.pow(F.lit(10.0), -(F.col("tb") * 15.5 + (1 - F.col("tb")) * 5.5) / 10))


_NB = "tn AS (SELECT *, CASE WHEN ecb > 0 AND cbs > 0 THEN greatest(0.0, least(1.0, -0.299 - 0.43 * ln(least(1.0, cbs / ecb)))) WHEN ecb > 0 THEN 1.0 ELSE 0.0 END AS tb FROM ec), nb AS (SELECT *, ecb / ns * pow(10.0::DOUBLE, -(tb * 15.5 + (1 - tb) * 5.5) / 10) AS nb FROM tn)"


@query(f"WITH {_PART}, {_SPREAD}, {_NB} SELECT vec_id, b, round(tb, 4) + 0.0 AS tonality, round(nb, 4) + 0.0 AS threshold FROM nb")
def q_tonality(spark, d):
    return thresholds(spread(spark, d)).select("vec_id", "b", r4(F.col("tb")).alias("tonality"), r4(F.col("nb")).alias("threshold"))


@query(f"WITH {_PART}, {_SPREAD}, {_NB} SELECT vec_id, round(sum(CASE WHEN nb > 0 AND e / nb > 1 THEN 2 * log2(e / nb) ELSE 0 END), 3) + 0.0 AS pe_bits FROM nb GROUP BY 1")
def q_perceptual_entropy(spark, d):
    t = thresholds(spread(spark, d))
    return t.groupBy("vec_id").agg((F.round(F.sum(F.when((F.col("nb") > 0) & (F.col("e") / F.col("nb") > 1), 2 * F.log2(F.col("e") / F.col("nb"))).otherwise(0.0)), 3) + 0.0).alias("pe_bits"))


#: A floor for q_pre_echo_floor that binds for some of the partitions.
QUIET = 0.05


def _capped(spark, d, floor: float):
    t = thresholds(spread(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("vec_id")))
    capped = S.pre_echo(t, ["b"], "k", "nb", F.lit(floor), "capped")
    return capped.select("vec_id", "b", (F.round("capped", 3) + 0.0).alias("capped"))


@query(f"""WITH RECURSIVE {_PART}, {_SPREAD}, {_NB}, seq AS (SELECT vec_id, b, nb AS raw, row_number() OVER (PARTITION BY b ORDER BY vec_id) AS k FROM nb),
rec AS (SELECT b, k, vec_id, raw AS c, raw AS p1, NULL::DOUBLE AS p2 FROM seq WHERE k = 1 UNION ALL
SELECT s.b, s.k, s.vec_id, least(s.raw, 2 * r.c, coalesce(16 * r.p2, 2 * r.c)) AS c, s.raw, r.c FROM rec r JOIN seq s ON s.b = r.b AND s.k = r.k + 1)
SELECT vec_id, b, round(c, 3) + 0.0 AS capped FROM rec""")
def q_pre_echo(spark, d):
    """Thresholds may not rise above twice the last or 16 times the one before, a recurrence on its own output."""
    return _capped(spark, d, 0.0)


@query(f"""WITH RECURSIVE {_PART}, {_SPREAD}, {_NB}, seq AS (SELECT vec_id, b, nb AS raw, row_number() OVER (PARTITION BY b ORDER BY vec_id) AS k FROM nb),
rec AS (SELECT b, k, vec_id, greatest(raw, {QUIET}) AS c, raw AS p1, NULL::DOUBLE AS p2 FROM seq WHERE k = 1 UNION ALL
SELECT s.b, s.k, s.vec_id, greatest({QUIET}, least(s.raw, 2 * r.c, coalesce(16 * r.p2, 2 * r.c))) AS c, s.raw, r.c FROM rec r JOIN seq s ON s.b = r.b AND s.k = r.k + 1)
SELECT vec_id, b, round(c, 3) + 0.0 AS capped FROM rec""")
def q_pre_echo_floor(spark, d):
    """The same with the threshold in quiet inside the recurrence, as the encoder has it."""
    return _capped(spark, d, QUIET)
