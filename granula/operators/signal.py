"""Framing, filterbank, transforms and stereo over signals: rows (key, n, v) or array columns.

A signal is framed by one shuffle on (key, granule); every transform after it is row-local on arrays of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.functions import dsp
from granula.functions import tables as T


def to_granules(samples: DataFrame, size: int, key: list[str] | None = None) -> DataFrame:
    """key, granule, x array<double> of exactly `size` samples (the last padded with zeros). samples: key, n, v."""
    keys = key or []
    framed = samples.select(*keys, F.floor(F.col("n") / size).cast("long").alias("granule"), F.struct((F.col("n") % size).cast("int").alias("line"), F.col("v").cast("double").alias("v")).alias("s"))
    grouped = framed.groupBy(*keys, "granule").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("x"))
    return grouped.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("x"))))


def granule_counts(samples: DataFrame, size: int) -> DataFrame:
    return samples.groupBy(F.floor(F.col("n") / size).cast("long").alias("granule")).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("v").alias("total"))


def sliding_energy(samples: DataFrame, window: int = 1024, hop: int = 576) -> DataFrame:
    """Energy of overlapping windows: every sample goes to the one or two windows it lies in."""
    first = F.greatest(F.lit(0), F.floor((F.col("n") - window) / hop) + 1)
    spread = samples.withColumn("w", F.explode(F.sequence(first.cast("long"), F.floor(F.col("n") / hop).cast("long"))))
    return spread.groupBy("w").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("v") * F.col("v")).alias("energy"))


def pre_echo(thresholds: DataFrame, key: list[str], order: str, value: str, floor: Column, name: str) -> DataFrame:
    """Adds the capped threshold: no more than twice the last or 16 times the one before, never under the floor.

    The floor is part of the recurrence. Floored values are never under it, so twice the last is not either, 16 times the one
    before never binds, and unrolled the cap is the min over j >= 0 of 2^j floored[k - j]: a running minimum of log2 - k.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(F.log2(F.greatest(F.col(value), floor)) - F.col(order)).over(w)
    return thresholds.withColumn(name, F.pow(F.lit(2.0), F.col(order) + low))


def with_previous(granules: DataFrame, key: list[str] | None = None, name: str = "prev") -> DataFrame:
    """Adds the granule before: every granule goes to its own place and to the next one, and one aggregation brings them together.

    No global sort, whatever the length of the signal, and what comes before is worked out once.
    """
    keys = key or []
    rest = [c for c in granules.columns if c not in (*keys, "granule")]
    own, past = F.struct(*rest), F.col("x")
    nothing = [F.lit(None).cast(granules.select(c).schema[0].dataType) for c in (own, past)]
    to = F.array(F.struct("granule", own.alias("own"), nothing[1].alias("past")), F.struct((F.col("granule") + 1).alias("granule"), nothing[0].alias("own"), past.alias("past")))
    met = granules.select(*keys, F.explode(to).alias("to")).groupBy(*keys, F.col("to.granule").alias("granule")).agg(F.first("to.own", ignorenulls=True).alias("own"), F.first("to.past", ignorenulls=True).alias("past"))
    silence = F.array_repeat(F.lit(0.0), F.size("own.x"))
    return met.where("own is not null").select(*keys, "granule", *[F.col(f"own.{c}") for c in rest], F.coalesce("past", silence).alias(name))


def mdct(granules: DataFrame, n: int = 18, key: list[str] | None = None) -> DataFrame:
    """Replaces x, n samples, by n coefficients of the window of this and the previous granule."""
    return with_previous(granules, key).withColumn("x", dsp.matvec(T.mdct_kernel(n), F.concat("prev", "x"))).drop("prev")


def imdct(coefficients: DataFrame, n: int = 18, key: list[str] | None = None) -> DataFrame:
    """Windowed inverse and overlap-add: sample granule g is the first half of g plus the second half of g - 1."""
    both = coefficients.withColumn("y", dsp.matvec(T.imdct_kernel(n), F.col("x"))).withColumn("x", F.slice("y", n + 1, n))
    out = with_previous(both, key)
    return out.withColumn("x", F.zip_with(F.slice("y", 1, n), F.col("prev"), lambda a, b: a + b)).drop("y", "prev")


def fir(granules: DataFrame, taps: list[float], key: list[str] | None = None) -> DataFrame:
    """y[n] = sum of taps[k] x[n - k], silence before the start; the history comes from the granule before."""
    m = len(taps)
    joined = with_previous(granules, key).withColumn("z", F.concat(F.slice("prev", -(m - 1), m - 1), F.col("x")))
    rev = list(reversed([float(t) for t in taps]))
    return joined.withColumn("x", F.transform("x", lambda _, i: dsp.dot(F.slice("z", i + 1, m), dsp.vector(rev)))).drop("prev", "z")


def mid_side(left: Column, right: Column, scale: float = 1.0) -> tuple[Column, Column]:
    s = F.lit(scale)
    return F.zip_with(left, right, lambda a, b: (a + b) * s), F.zip_with(left, right, lambda a, b: (a - b) * s)


def intensity(position: Column, ms: Column | bool = False) -> tuple[Column, Column]:
    """(left, right) gains of an MPEG-1 intensity position 0-6: tan(pos pi / 12) shared out."""
    ratio = F.tan(position * F.lit(3.141592653589793 / 12))
    s = F.when(F.lit(ms) if isinstance(ms, bool) else ms, F.lit(1.41421356)).otherwise(F.lit(1.0))
    return F.when(position == 6, s).otherwise(s * ratio / (1 + ratio)), F.when(position == 6, F.lit(0.0)).otherwise(s / (1 + ratio))


def stereo_pairs(df: DataFrame, id_col: str) -> DataFrame:
    """Rows of even and odd ids as left and right of pair id / 2. One shuffle, no self-join."""
    return df.groupBy(F.floor(F.col(id_col) / 2).cast("long").alias("pair")).agg(F.max(F.when(F.col(id_col) % 2 == 0, F.col("x"))).alias("l"), F.max(F.when(F.col(id_col) % 2 == 1, F.col("x"))).alias("r")).where("l is not null and r is not null")
