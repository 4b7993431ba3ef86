"""Where queries over the driver's tables register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(x: Column) -> Column:
    """Four decimals; no negative zero."""
    return F.round(x, 4) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x array<double> of the embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


EM = "em AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def indexed(df: DataFrame, keys: list[str], values: Column, name: str, i: str = "i") -> DataFrame:
    """One row an element: keys, index, value."""
    return df.select(*keys, F.posexplode(values).alias(i, name)).withColumn(i, F.col(i).cast("long"))
