"""Hierarchical weighted hash tree: region, rack, shard.

At each level a row draws -ln(u) / weight for every child of its node, u from a hash of (doc_id, child), and descends into the
least. A child's draw depends on the child and its weight alone, so when a weight changes only rows that enter or leave that
subtree move at that level, and the rest of the tree keeps its rows. Capacity added as a subtree of its own (a new region here)
takes rows only into itself.

Law of the query: `key` (doc_id and the shard count decide).

Defined results: a null doc_id is hashed as the word "null", so all such rows share a shard; a null text has size 1 and the
CRC of the empty text; repeated rows share a shard and get slots of their own; ties of a draw go to the lower child; a
very long text only has a large size. Extra columns are not carried by the query, all by with_shard but one named shard, which
it replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.llm.common import fresh

#: Shards a rack holds and racks a region holds; shard s sits in rack s // RACK of region s // (RACK * REGION).
RACK, REGION = 4, 2
#: Rows a slot bucket is meant to hold; their number follows the table.
BUCKET_ROWS = 50_000


def topology(shards: int, rack: int = RACK, region: int = REGION) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards; every shard weighs 1, so a node weighs as many shards as it has."""
    tree: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        tree.setdefault(s // (rack * region), {}).setdefault(s // rack, []).append(s)
    return tree


def _descend(key: Column, parent: Column, nodes: list[tuple[int, str, int, float]]) -> Column:
    """The id of the child of `parent` with the least draw; nodes: (parent, name, id, weight).

    A draw is -ln(u) / weight, u in (0, 1) from the first 12 hex digits of md5(key|name).
    """
    table = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(name).alias("name"), F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for p, name, i, w in nodes])

    def draw(n: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), n["name"]).cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
        return F.struct((-F.log(u) / n["weight"]).alias("d"), n["id"].alias("id"))

    # the lambda binds the parent once; named in place it would be worked out anew for every node
    return F.get(F.transform(F.array(parent), lambda p: F.array_min(F.transform(F.filter(table, lambda n: n["parent"] == p), draw))["id"]), F.lit(0))


def place(docs: DataFrame, key: Column, tree: dict[int, dict[int, list[int]]], name: str) -> DataFrame:
    """Adds the shard of a key as column `name`: three levels of weighted draws, native expressions only."""
    regions = [(0, f"r{g}", g, sum(map(len, racks.values()))) for g, racks in tree.items()]
    racks = [(g, f"k{r}", r, len(leaves)) for g, inner in tree.items() for r, leaves in inner.items()]
    shards = [(r, f"s{s}", s, 1) for inner in tree.values() for r, leaves in inner.items() for s in leaves]
    region, rack = fresh(docs, "__region", "__rack")
    step = docs.withColumn(region, _descend(key, F.lit(0), regions)).withColumn(rack, _descend(key, F.col(region), racks))
    return step.withColumn(name, _descend(key, F.col(rack), shards)).drop(region, rack)


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard) of every row: a projection, no shuffle."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return place(place(measured, key, topology(shards), "shard"), key, topology(shards + 1), "grown_shard")


def with_shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All columns of docs and `shard` (a column of that name is replaced): a projection, no shuffle."""
    (name,) = fresh(docs, "__shard")
    placed = place(docs, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), topology(shards), name)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"], F.col(name).alias("shard"))


def slots(placed: DataFrame, buckets: int) -> DataFrame:
    """Adds `slot`, gapless from 0 within a shard, without sorting a whole shard in one task.

    Rows fall into hash buckets of their doc_id; a bucket's first slot is the running count of the buckets before it (a table of
    shards x buckets rows), and a row's place inside its bucket is a small window.
    """
    order = ["doc_id", "text_crc32", "size"]
    marked = placed.withColumn("bucket", (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|slot")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    within = marked.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1)
    counts = marked.groupBy("shard", "bucket").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return within.join(before, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("at")).cast("long")).drop("before", "at", "bucket")


def bucket_count(rows: int) -> int:
    """A power of two, 64 at least, so that a bucket of one shard holds about BUCKET_ROWS rows at most."""
    return 1 << max(6, math.ceil(math.log2(max(1, rows / 16 / BUCKET_ROWS))))


def op8_hash_tree_sharding(docs: DataFrame) -> DataFrame:
    """The contract's query: shards 0 to 15, law `key`, one more shard for grown_shard."""
    buckets = bucket_count(docs.count())
    return slots(assign(docs, 16), buckets).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle_sql(shards: int = 16) -> str:
    """The same rows in DuckDB; the CRC goes byte by byte over a table made from its polynomial."""

    def draw(node: str, weight: float) -> str:
        return f"-ln((('0x' || substr(md5(k || '|{node}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / {float(weight)}"

    def least(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = [draw(n, w) for n, w, _ in children]
        cases = [f"WHEN {draws[i]} <= least({', '.join(draws[i + 1 :])}) THEN {v}" for i, (_, _, v) in enumerate(children[:-1])]
        return f"CASE {' '.join(cases)} ELSE {children[-1][2]} END"

    def tree(n: int) -> str:
        return least([(f"r{g}", sum(map(len, racks.values())), least([(f"k{r}", len(leaves), least([(f"s{x}", 1, str(x)) for x in leaves])) for r, leaves in racks.items()])) for g, racks in topology(n).items()])

    step = "list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)"
    return f"""
    WITH crc AS (SELECT list({step} ORDER BY n) AS entry FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS raw FROM documents),
    e AS (SELECT doc_id, k, (octet_length(raw) + 1)::BIGINT AS size,
      xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, entry[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM d, crc),
    p AS (SELECT doc_id, size, text_crc32, k, ('0x' || substr(md5(k || '|slot'), 1, 8))::BIGINT AS b, {tree(shards)} AS shard, {tree(shards + 1)} AS grown_shard FROM e),
    n AS (SELECT greatest(64, pow(2, ceil(log2(greatest(1, count(*) / 16 / {BUCKET_ROWS})))))::BIGINT AS buckets FROM documents)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
      (row_number() OVER (PARTITION BY shard ORDER BY b % buckets, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM p, n"""
