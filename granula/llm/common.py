"""What the training-data operators share: tables, durable intermediates, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as the contracts ask (full case mapping would touch other scripts).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of df has it (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, shared by driver and executors; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir")
        if root is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="granula-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends: results that are read lazily may need it until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: for wide or compressible rows, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    kept_until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so a lost executor recomputes nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def noted(df: DataFrame) -> DataFrame:
    """`df` stored as it is, for narrow rows that may be few: a checkpoint is read by as many tasks as wrote it, small files are read by one
    task together. Joins with it are dealt out at any size, so that what is exchanged grows in proportion to the input."""
    return stored(df, "none").hint("merge")


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def _stars(pairs: DataFrame) -> bool:
    """Whether no node of the distinct pairs (u, v) has two parents v or is both child and parent."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    edges(a, b): undirected links. Returns (node, root) for every node with a link, root the smallest node reachable.
    A round is two aggregations and two joins on the edge list; no adjacency list is gathered. The minima are written before they
    are joined, so that both sides of the join are plain exchanges and adaptive execution can split the rows of a hub. Every
    round brings some node to a smaller parent; the rounds end when the links are stars: no node has two parents or is a
    parent and a child, so that the parent is the smallest node of its component.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = noted(pairs)
    while not _stars(pairs):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = noted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = noted(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = noted(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = noted(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).hint("merge")
