"""Connected components of edge tables, without collecting edges or nodes anywhere."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where one machine is the cluster (tests), a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tilewright-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows from a table written to the shared folder: lineage ends here, and each row is made once."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The table as a side of a join that is never broadcast.

    A table's size in files, or before its rows are unfolded, is far below that in memory; by it a table of any size that grows
    with the input may pass whole through the driver.
    """
    return df.hint("merge")


#: Moved roots that are broadcast at most; beyond, only those that name so many rows (HOT) that a task would read too much.
MAX_BROADCAST, HOT = 100_000, 100_000


def _relabelled(rows: DataFrame, moved: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` name moved roots (of, r) get the new ones.

    While the moved roots are few they are broadcast.  Else they are shuffled, each once, and the rows with them, but for
    rows of a hot root, which stay where they are: at most one root in HOT rows is hot, and these are broadcast.
    """
    few, out = moved.count() <= MAX_BROADCAST, rows
    for column in columns:
        new = moved.select(F.col("of").alias("_of"), F.col("r").alias("_r"))
        led = lambda df, to: df.join(to, F.col(column) == F.col("_of"), "left").withColumn(column, F.coalesce("_r", column)).drop("_of", "_r")  # noqa: B023, E731
        if few:
            out = led(out, F.broadcast(new))
            continue
        # no column's names depend on another's
        hot = cut(rows.groupBy(F.col(column).alias("_hot")).count().where(F.col("count") >= HOT).select("_hot"))
        if hot.isEmpty():
            out = led(out, shuffled(new))
            continue
        hot_new = new.join(F.broadcast(hot), F.col("_of") == F.col("_hot"), "left_semi")
        split = lambda how: out.join(F.broadcast(hot), F.col(column) == F.col("_hot"), how)  # noqa: B023, E731
        out = led(split("left_semi"), F.broadcast(hot_new)).unionByName(led(split("left_anti"), shuffled(new)))
    return out


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """The least node that each node is connected with: node, root.

    In every round each root hooks on to the least root next to it, chains of hooks are halved by
    pointer jumping until they are one step long, and edges become edges between roots, those within one root
    being dropped.  So rounds grow with the logarithm of the longest path.  A node that very many
    others hook on to (the hub of a star) is a common key of no shuffle: only hooks that lead on are looked
    up, and they are broadcast if they are few or hot.  ``nodes`` (column node) adds nodes without edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    named = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    if nodes is not None:
        named = named.unionByName(nodes.select("node"))
    roots = named.distinct().select("node", F.col("node").alias("root"))
    # from the greater root to the less
    down = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not down.isEmpty():
        hooks = cut(down.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("of"), F.col("v").alias("r")))
        while True:  # hooks on to roots that are hooked themselves
            on = hooks.select(F.col("r").alias("next")).distinct()
            further = cut(on.join(shuffled(hooks), F.col("next") == F.col("of")).select("of", "r"))
            if further.isEmpty():
                break
            hooks = cut(_relabelled(hooks, further, "r"))
        roots = cut(_relabelled(roots, hooks, "root"))
        both = _relabelled(down, hooks, "u", "v").where("u <> v")
        down = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return roots


def components_sql(nodes: str, edges: str) -> str:
    """DuckDB: CTE ``cc(node, root)`` over CTEs ``nodes(node)`` and symmetric ``edges(a, b)``."""
    return f"""reach(node, root) AS (
  SELECT node, node FROM {nodes} UNION SELECT e.b, r.root FROM reach r JOIN {edges} e ON e.a = r.node WHERE r.root < e.b
), cc AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
