"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas. Native operations only.

A block is a run of at most BLOCK words of one document. A source's target fixes how often all its blocks are taken whole and
how many blocks, least in a permutation by hash, are taken once more: the quota. The drawn blocks of all sources are split over
the output shards by a binary tree; each node parts every source's quota between its halves by one multivariate
hypergeometric draw, so quotas stay exact at every node. A source's permutation is then cut at its shards' quotas, which makes
the shards' blocks disjoint, and each shard is shuffled by a hash of its own.

Only sums by source reach the driver, a row per source; tables by source go back as text literals, which the JVM parses, and
are broadcast up to FEW_SOURCES rows, joined by an exchange beyond. Ranks come from hash buckets: a running sum over bucket
totals and a window inside one bucket, so no source is sorted in one task.

Defined results: a null text has size 0, no block and taken 0; sources are ordered by code point with null last; an empty or
all-empty table has no blocks; repeated rows of one doc_id, source and size are drawn alike; a very long text is many blocks,
which the draw treats one by one; ties of a hash go by doc_id, size and block; the query carries no extra columns,
mixed_documents all of them.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.llm.common import columns, durable, fresh, stored

BLOCK, WHOLE = 64, 1 << 30
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Sources up to which a table by source is broadcast (some 100 bytes a row).
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    whole: int  # every block is taken so many times
    rest: float  # words of one more, partial, pass


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Water-filling: `share` of all sizes by weight, a target stops at `most` times its size, the excess is shared anew until none is above."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: (most * sizes[i] / weights[i], i))
    capped, weight = 0.0, sum(weights[i] for i in order)
    for n, i in enumerate(order):
        level = (total - capped) / weight
        if most * sizes[i] <= level * weights[i]:
            out[i] = most * sizes[i]
            capped += out[i]
            weight -= weights[i]
        else:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
    return out


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[SourcePlan]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    out = []
    for r, t in zip(rows, wanted, strict=True):
        whole = min(int(t // r.size), int(most)) if r.size else 0
        out.append(SourcePlan(r.source, r.size, t, whole, t - whole * r.size if r.size else 0.0))
    return out


def blocks(sized: DataFrame, seed: int, size: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, copies, block, words, h): one row per block of each distinct (doc_id, source, size); copies counts equal rows."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).where("size > 0")
    cut = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / size).cast("int"))))
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("block"))
    return cut.select("doc_id", "source", "size", "copies", "block", F.least(F.lit(size), F.col("size") - F.col("block") * size).cast("int").alias("words"), F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long").alias("h"))


def hypergeometric(u: float, good: int, bad: int, take: int) -> int:
    """The u-quantile of the number of good ones among `take` drawn without replacement, by inversion of the law itself.

    Weights follow from the mode by the ratio of neighbours, at every size alike. The ends left out, beyond nine deviations and
    60, hold less than a uniform number of 53 bits can tell.
    """
    total, lowest, highest = good + bad, max(0, take - bad), min(good, take)
    if lowest == highest:
        return lowest
    mode = min(highest, max(lowest, (good + 1) * (take + 1) // (total + 2)))
    p = good / total
    reach = int(9 * math.sqrt(take * p * (1 - p) * (total - take) / max(1, total - 1))) + 60
    lo, hi = max(lowest, mode - reach), min(highest, mode + reach)
    x = np.arange(lo, hi, dtype=np.float64)
    step = np.log(good - x) + np.log(take - x) - np.log(x + 1) - np.log(bad - take + x + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(min(np.searchsorted(upto, u * upto[-1], side="right"), hi - lo))


def _parted(rng: np.random.Generator, counts: list[int], take: int) -> list[int]:
    """One multivariate hypergeometric draw."""
    left, need, out = sum(counts), take, []
    for n in counts:
        x = hypergeometric(rng.random(), n, left - n, need)
        out.append(x)
        left, need = left - n, need - x
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """[shard][source]: every shard gets an equal share of the draws (one apart at most), every source's quota is used up exactly."""

    def part(counts: list[int], lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [counts]
        mid, total = (lo + hi) // 2, sum(counts)
        rng = np.random.default_rng([seed, lo, hi])
        left = _parted(rng, counts, total * (mid - lo) // (hi - lo))
        return part(left, lo, mid) + part([a - b for a, b in zip(counts, left, strict=True)], mid, hi)

    return part(quotas, 0, shards)


def _by_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver as one text literal that the JVM parses, so that no Python row reaches an executor."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    made = spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")))
    return F.broadcast(made) if len(rows) <= FEW_SOURCES else made


def ranked_blocks(sized: DataFrame, seed: int = 7, bucket_rows: int = 50_000, block: int = BLOCK) -> tuple[DataFrame, list[SourcePlan]]:
    """Every block with its rank in its source's permutation, `whole` passes and whether it is in the partial one; and the plan.

    The hash buckets follow the table: about bucket_rows blocks in one. The partial pass takes the blocks least by hash while their running words stay within
    half a block of the wanted words.
    """
    spark = sized.sparkSession
    wanted = plan(sized)
    bits = min(40, max(6, math.ceil(math.log2(max([1.0, *(p.size / min(block, 64) / bucket_rows for p in wanted)])))))
    cut = blocks(sized, seed, block).withColumn("bucket", F.shiftright("h", 48 - bits).cast("int"))
    known = _by_source(spark, [(p.source, p.whole, p.rest) for p in wanted], "s string, whole int, rest double")
    tot = cut.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("words") * F.col("copies")).alias("w"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = durable(tot.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0")))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "block")
    ranked = (
        cut.withColumn("r", F.row_number().over(inside) - 1)
        .withColumn("c", F.sum(F.col("words") * F.col("copies")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .alias("x")
        .join(tot.select(F.col("source").alias("ts"), F.col("bucket").alias("tb"), "n0", "w0"), F.col("source").eqNullSafe(F.col("ts")) & (F.col("bucket") == F.col("tb")))
        .join(known, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank0", F.col("n0") + F.col("r"))
        .withColumn("more", F.col("w0") + F.col("c") - F.col("words") * F.col("copies") / 2.0 <= F.col("rest"))
        .select("doc_id", "source", "size", "copies", "block", "words", "whole", "rank0", "more")
    )
    return ranked, wanted


def taken(ranked: DataFrame, drawn: DataFrame) -> DataFrame:
    """(doc_id, source, size, taken) of every row of the input that has words: the drawn words of all shards."""
    key = ["doc_id", "source", "size", "copies"]
    rows = drawn.select(*key, F.col("words").cast("long").alias("words")).union(ranked.where("block = 0").select(*key, F.lit(0).cast("long")))
    sums = rows.groupBy(*key).agg(F.sum("words").alias("taken"))
    return sums.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "source", "size", "taken")


def to_shards(ranked: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """Every draw with its pass, shard and place in the shard's local order."""
    spark = ranked.sparkSession
    drawn = ranked.withColumn("pass", F.explode(F.expr("if(whole + cast(more as int) = 0, array(), sequence(0, whole + cast(more as int) - 1))")))
    first: dict[str | None, dict[int, int]] = {}
    for r in drawn.groupBy("source", "pass").agg(F.count(F.lit(1)).alias("n")).collect():
        first.setdefault(r.source, {})[r["pass"]] = r.n
    names = sorted(first, key=lambda s: (s is None, s or ""))
    parts = split_tree([sum(first[s].values()) for s in names], shards, seed)
    rows = []
    for i, s in enumerate(names):
        ends, at = [], 0
        for part in parts:
            at += part[i]
            ends.append(at)
        rows.append((s, [sum(n for q, n in first[s].items() if q < p) for p in range(int(MOST) + 1)], ends))
    cuts = _by_source(spark, rows, "s string, starts array<bigint>, ends array<bigint>")
    placed = drawn.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("rank", F.col("starts")[F.col("pass")] + F.col("rank0"))
    return placed.withColumn("shard", F.expr("size(filter(ends, e -> e <= rank))")).withColumn("place", F.xxhash64(F.lit(seed), "shard", "source", "rank")).select("doc_id", "source", "size", "copies", "block", "words", "pass", "rank", "shard", "place")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with every row as often as the mix draws it, shard after shard, each in its shuffled order; the block is a whole document.

    Rows without words have nothing to take and go.
    """
    d, s, z, shard, place = fresh(docs, "__doc", "__source", "__size", "__shard", "__place")
    ranked, _ = ranked_blocks(durable(sizes(docs)), seed, block=WHOLE)
    drawn = to_shards(durable(ranked), seed=seed)
    drawn = drawn.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("shard").alias(shard), F.col("place").alias(place))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (size == F.col(z))
    return docs.join(drawn, same).orderBy(shard, place).select(*columns(docs))


def op4_splitting_tree_mix(docs: DataFrame) -> DataFrame:
    """The contract's query: taken words of every document, summed over the shards, which are written in their order."""
    sized = durable(sizes(docs))
    ranked, wanted = ranked_blocks(sized)
    ranked = durable(ranked)
    drawn = stored(to_shards(ranked).orderBy("shard", "place"))
    known = _by_source(docs.sparkSession, [(p.source, p.size, p.target) for p in wanted], "s string, source_size bigint, target double")
    rows = taken(ranked, drawn).union(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def oracle_sql(seed: int = 7) -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM s0),
    s2 AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, o) AS n FROM s1 WHERE source_size > 0),
    s3 AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM s2) - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
    stop AS (SELECT n, level FROM s3 WHERE 2.0::DOUBLE * source_size > level * w ORDER BY n LIMIT 1),
    s4 AS (SELECT s1.source, s1.source_size, CASE WHEN s3.n IS NULL THEN 0.0::DOUBLE WHEN s3.n >= (SELECT n FROM stop) THEN (SELECT level FROM stop) * s3.w ELSE 2.0::DOUBLE * s3.source_size END AS target FROM s1 LEFT JOIN s3 USING (o)),
    s AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::INT AS whole, target - whole * source_size AS rest FROM s4),
    u AS (SELECT doc_id, source, size, count(*) AS copies FROM d WHERE size > 0 GROUP BY ALL),
    b AS (SELECT *, least({BLOCK}, size - block * {BLOCK}) AS words, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size || '|' || block), 1, 12))::BIGINT AS h FROM (SELECT *, unnest(range(0, (size - 1) // {BLOCK} + 1)) AS block FROM u)),
    c AS (SELECT *, sum(words * copies) OVER (PARTITION BY source ORDER BY h, doc_id, size, block ROWS UNBOUNDED PRECEDING) AS c FROM b),
    t AS (SELECT c.doc_id, c.source, c.size, sum(c.words * (s.whole + (c.c - c.words * c.copies / 2.0 <= s.rest)::INT))::BIGINT AS taken FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
    SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
    LEFT JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.source IS NOT DISTINCT FROM t.source AND d.size = t.size"""
