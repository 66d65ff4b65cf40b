"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def vocabulary_file(name: str) -> str:
    """A vocabulary's place on this machine, so that workers find their own: a path, or the name of a public file."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files are deleted when the query that wrote them ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._kiln_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote, when nothing will read it again."""
    path = getattr(df, "_kiln_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot with more than one in HOT of all rows, so that there are fewer hot keys than HOT.
HOT = 256


def hot_keys(sizes: DataFrame, key: str) -> DataFrame:
    """Of sizes (key, n) the fewer than HOT hot keys with their number of salts: (key, salts)."""
    limit = max(HOT, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT)
    return cut(sizes.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("salts")), "hot")


def salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Adds salt, by which the rows of a hot key are dealt evenly; 0 for others."""
    salt = F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("salts")


def for_salts(facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """One row for each salt of a key, to be joined with salted rows by key and salt."""
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return facts.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(salts)).drop("salts")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per linked node.

    component is the smallest node that can be reached. Each round every node hooks to its smallest
    neighbour, two pointer jumps shorten the chains, and the links are contracted to the hooked
    labels, so the rounds grow with the logarithm of the longest chain. A hot node is only the
    many-rows side of equi-joins (which adaptive execution splits) or of a partial aggregate. Self
    links and repeated links are harmless; links with a null end are dropped.
    """
    links = _links(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    links = cut(links, "links")
    labels = cut(
        links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        .distinct().withColumn("component", F.col("node")),
        "labels",
    )
    while not links.isEmpty():
        hook = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        hook = cut(hook, "hook")
        jumped = _follow(_follow(hook, "p", hook), "p", hook)
        jump = cut(jumped, "hook")
        newer_labels = cut(_follow(labels, "component", jump), "labels")
        newer_links = cut(_links(_follow(_follow(links, "a", jump), "b", jump)), "links")
        for old in (hook, jump, labels, links):
            drop(old)
        labels, links = newer_labels, newer_links
    return labels


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _follow(rows: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """Replaces column by what it hooks to; a root stays as it is."""
    to = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
    joined = rows.join(to, F.col(column) == F.col("_v"), "left")
    return joined.select(*[F.coalesce("_p", column).alias(c) if c == column else F.col(c) for c in rows.columns])


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches through a symmetric matrix of links."""
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (low == root).all():
            return root
        root = low
