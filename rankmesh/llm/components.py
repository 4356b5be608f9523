"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import discard, new_folder

#: Rounds in which any graph that fits a cluster has settled; each halves the paths at least.
ROUNDS = 64


def lowest(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Rows (key, out): the smallest value of each key, pre-aggregated.

    Grouped by the key's complement, so that a join with ``rows`` by the key deals
    both sides out anew, and a key with very many rows can be split there.
    """
    least = rows.groupBy(F.bitwise_not(F.col(key)).alias("_turned")).agg(F.min(value).alias(out))
    return least.select(F.bitwise_not(F.col("_turned")).alias(key), out)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (a, b: long), component being the smallest node reachable.

    Edges may repeat, run either way or be loops; edges with a null are left out.
    Only counts reach the driver. A node with very many edges is no problem: what
    is computed for it is a minimum, pre-aggregated, and the join on it can be split.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("a is not null and b is not null and u > v").distinct()
    spark = now.sparkSession
    path = new_folder(spark, "graph")
    now.write.parquet(path)
    now, mark = spark.read.schema(now.schema).parquet(path), None
    for _ in range(ROUNDS):
        # large star: each node's greater neighbours move to its smallest neighbour
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(ways, "u", "v", "m").select("u", F.least("u", "m").alias("m"))
        large = ways.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours move to the smallest of them
        low = lowest(large, "u", "v", "m")
        both = large.join(low, "u")
        next_ = both.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        last, path = path, new_folder(spark, "graph")
        next_.write.parquet(path)
        now = spark.read.schema(next_.schema).parquet(path)
        discard(spark, last)  # one round's edges are all that the next needs
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("the components haven't settled")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
