"""Quantisation, noise, Huffman cost, scalefactor coding and bit budgets over rows of bands, lines and granules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import dsp
from granula.functions import tables as T

IMPOSSIBLE = 1 << 20


def band_rows(df: DataFrame, key: list[str], values: Column, bands: list[int]) -> DataFrame:
    """key, line, band, v: each line with its band, from a literal map in the row, no join."""
    band = dsp.vector(bands)
    return df.select(*key, F.posexplode(values).alias("line", "v")).withColumn("band", F.get(band, F.col("line")).cast("long")).withColumn("line", F.col("line").cast("long"))


def band_noise(df: DataFrame, key: list[str], values: Column, bands: list[int], q: int) -> DataFrame:
    """key, band, noise, peak: squared quantisation error and greatest magnitude of every band."""
    v = band_rows(df, key, values, bands)
    e = F.abs(F.col("v")) - dsp.dequantise(dsp.quantise(F.col("v"), q), -q)
    return v.groupBy(*key, "band").agg(F.sum(e * e).alias("noise"), F.max(F.abs("v")).alias("peak"), F.sum(F.col("v") * F.col("v")).alias("energy"))


def masking_metrics(bands: DataFrame, key: list[str]) -> DataFrame:
    """over, excess and greatest ratio of the bands whose noise passes xmin."""
    bad = F.col("noise") > F.col("xmin")
    return bands.groupBy(*key).agg(F.count_if(bad).alias("over"), F.coalesce(F.sum(F.when(bad, F.col("noise") - F.col("xmin"))), F.lit(0.0)).alias("excess"), F.coalesce(F.max(F.when(bad, F.col("noise") / F.col("xmin"))), F.lit(0.0)).alias("ratio"))


def worst_band(bands: DataFrame, key: list[str]) -> DataFrame:
    """The violating band with the greatest ratio, the lowest on ties; -1 if none."""
    bad = F.col("noise") > F.col("xmin")
    best = F.max(F.when(bad, F.struct((F.col("noise") / F.col("xmin")).alias("r"), (-F.col("band")).alias("b"))))
    return bands.groupBy(*key).agg(F.coalesce(-best["b"], F.lit(-1)).cast("long").alias("worst"))


def better_pass(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Lexicographic minimum, the earliest on ties."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def least_gain(peaks: DataFrame, key: list[str]) -> DataFrame:
    """The least global gain at which every band's peak fits the largest codable value; 255 if none does."""
    fits = lambda gg: F.sqrt(F.col("peak") * dsp.quarter_power(F.lit(T.QUANT_GAIN_BASE) - gg) * F.sqrt(F.col("peak") * dsp.quarter_power(F.lit(T.QUANT_GAIN_BASE) - gg))) + T.ROUNDING <= T.MAX_QUANT
    top = peaks.groupBy(*key).agg(F.max("peak").alias("peak"))
    return top.withColumn("min_gain", F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(255)), fits)), F.lit(255)).cast("long"))


def pair_cost(x: Column, y: Column, table: int) -> Column:
    """Codeword length plus sign bits; IMPOSSIBLE where the table has no such pair."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in T.PAIR_LENGTHS[table]])
    code = F.get(F.get(rows, x.cast("int")), y.cast("int"))
    return F.coalesce(code + (x > 0).cast("int") + (y > 0).cast("int"), F.lit(IMPOSSIBLE)).cast("long")


def pair_costs(pairs: DataFrame) -> DataFrame:
    """Adds c1, c2, c3. pairs: ax, ay magnitudes."""
    return pairs.select("*", *[pair_cost(F.col("ax"), F.col("ay"), t).alias(f"c{t}") for t in T.PAIR_LENGTHS])


def region_costs(prefix: DataFrame, key: list[str]) -> DataFrame:
    """For arrays p1..p3 of costs up to each band (one entry more than bands), the cheapest split into three regions.

    Row-local: all (r0, r1) with r0 + r1 + 2 within the bands, each region by its cheapest table; least total, then r0, then r1.
    """
    bands = F.size("p1") - 1
    cost = lambda a, b: F.least(*[F.get(f"p{t}", b) - F.get(f"p{t}", a) for t in T.PAIR_LENGTHS])

    def option(r0: Column, r1: Column) -> Column:
        a = F.least(r0 + 1, bands)
        c = F.least(a + r1 + 1, bands)
        return F.struct((cost(F.lit(0), a) + cost(a, c) + cost(c, bands)).alias("bits"), r0.cast("long").alias("r0"), r1.cast("long").alias("r1"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r0: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda r1: r0 + r1 + 2 <= bands), lambda r1: option(r0, r1))))
    return prefix.withColumn("best", F.array_min(every)).select(*key, F.col("best.bits").alias("bits"), F.col("best.r0").alias("r0"), F.col("best.r1").alias("r1"))


def count1_cost(v: Column) -> tuple[Column, Column]:
    """(table A bits, table B bits) of one quad array of four."""
    signs = F.aggregate(v, F.lit(0), lambda a, x: a + (x != 0).cast("int"))
    index = sum(((F.get(v, F.lit(i)) != 0).cast("int") * (8 >> i) for i in range(4)), F.lit(0))
    return (F.get(dsp.vector(T.COUNT1_A), index) + signs).cast("long"), (F.lit(4) + signs).cast("long")


def scalefac_compress(scf: Column) -> Column:
    """struct(bits, index): the cheapest of the 16 length pairs that hold the greatest scalefactor of either half, lowest on ties; NULL if none."""
    top = lambda a, b: F.array_max(F.slice(scf, a + 1, b - a))
    lo, hi = top(0, 11), top(11, 21)
    options = [F.when((lo <= (1 << s1) - 1) & (hi <= (1 << s2) - 1), F.struct(F.lit(11 * s1 + 10 * s2).cast("long").alias("bits"), F.lit(i).cast("long").alias("index"))) for i, (s1, s2) in enumerate(T.SLEN)]
    return F.array_min(F.array_compact(F.array(*options)))


def scfsi_mask(first: Column, second: Column) -> Column:
    """Bit 3 - g is set where group g of the second granule's scalefactors equals the first's."""
    part = lambda x, g: F.slice(x, g[0] + 1, g[1] - g[0])
    return sum(((part(first, g) == part(second, g)).cast("int") * (8 >> i) for i, g in enumerate(T.SCFSI_GROUPS)), F.lit(0)).cast("long")


def demand_bits(pe: Column, mean: int) -> Column:
    return F.greatest(F.lit(mean // 2), F.least(F.lit(min(T.MAX_PART23, 2 * mean)), F.floor(F.greatest(F.lit(0.0), pe)))).cast("long")


def split_budget(demands: DataFrame, frame: list[str], order: str, cap: int) -> DataFrame:
    """Adds budget: the frame's target, its demands rounded up to bytes within `cap` bytes, shared in proportion; the last takes the rest."""
    w = Window.partitionBy(*frame)
    total, n = F.sum("demand").over(w), F.row_number().over(w.orderBy(F.col(order).desc()))
    target = F.least(F.floor((total + 7) / 8), F.lit(cap)) * 8
    share = F.floor(target * F.col("demand") / total)
    out = demands.withColumn("target", target).withColumn("share", share).withColumn("from_end", n)
    return out.withColumn("budget", F.when(F.col("from_end") == 1, F.col("target") - (F.sum("share").over(w) - F.col("share"))).otherwise(F.col("share")).cast("long")).drop("share", "from_end")


def encoder_stats(frames: DataFrame) -> DataFrame:
    """frames, bytes, padded frames and mean gain. frames: n_bytes, padded, gain."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.sum("n_bytes").cast("long").alias("bytes"), F.sum("padded").cast("long").alias("padded_frames"), (F.sum("gain") / F.count(F.lit(1))).alias("mean_gain"))


def reservoir_walk(frames: DataFrame, cap: int = T.RESERVOIR, block: int = 1024) -> DataFrame:
    """stream_id, frame_no, before, spend, after: bit reservoir bytes ahead of each frame, what it spends, what is left.

    A frame may spend what it has (before + area), must leave no more than `cap`, and wants `demand`:
    after = clamp(before + area - demand, 0, cap). Such clamps compose to one clamp (shift, low, high), so a block of frames is
    folded to three numbers in parallel, a stream's blocks are folded in order, and each block is walked from its known start.
    frames: stream_id, frame_no from 0 without gaps, area, demand, bytes.
    """
    item = F.struct("frame_no", F.col("area").cast("long").alias("area"), F.col("demand").cast("long").alias("demand"))
    blocks = frames.groupBy("stream_id", F.floor(F.col("frame_no") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("f"))
    clip = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), x))
    big = F.lit(1 << 60)
    start = F.struct(F.lit(0).cast("long").alias("shift"), (-big).cast("long").alias("low"), big.cast("long").alias("high"))

    def fold(m: Column, x: Column) -> Column:
        d = x["area"] - x["demand"]
        return F.struct((m["shift"] + d).alias("shift"), clip(m["low"] + d).alias("low"), clip(m["high"] + d).alias("high"))

    folded = blocks.select("stream_id", F.struct("block", F.aggregate("f", start, fold).alias("m")).alias("b")).groupBy("stream_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    zero = F.struct(F.lit(0).cast("long").alias("occ"), F.array().cast("array<bigint>").alias("starts"))

    def next_start(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(b["m"]["low"], F.least(b["m"]["high"], a["occ"] + b["m"]["shift"])).alias("occ"), F.concat(a["starts"], F.array(a["occ"])).alias("starts"))

    starts = folded.withColumn("starts", F.aggregate("bs", zero, next_start, lambda a: a["starts"])).select("stream_id", F.explode(F.arrays_zip("bs", "starts")).alias("z")).select("stream_id", F.col("z.bs.block").alias("block"), F.col("z.starts").alias("occ"))
    none = F.array().cast("array<struct<frame_no: bigint, before: bigint, spend: bigint, after: bigint>>")

    def walk(a: Column, x: Column) -> Column:
        after = clip(a["occ"] + x["area"] - x["demand"])
        row = F.struct(x["frame_no"].cast("long").alias("frame_no"), a["occ"].alias("before"), (a["occ"] + x["area"] - after).alias("spend"), after.alias("after"))
        return F.struct(after.alias("occ"), F.concat(a["rows"], F.array(row)).alias("rows"))

    done = blocks.join(starts, ["stream_id", "block"]).withColumn("rows", F.aggregate("f", F.struct(F.col("occ"), none.alias("rows")), walk, lambda a: a["rows"]))
    return done.select("stream_id", F.explode("rows").alias("r")).select("stream_id", "r.frame_no", "r.before", "r.spend", "r.after")
