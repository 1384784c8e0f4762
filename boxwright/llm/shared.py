"""What the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]"
#: A key with more rows is dealt to several tasks; so many such keys are sent to all executors, more are joined by shuffle.
FANOUT, BROADCAST_KEYS = 1 << 16, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs on one machine, a temporary
    folder is made and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("boxwright.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="boxwright-")
        spark.conf.set("boxwright.shared.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared folder once and read it back.

    Cuts the lineage like a checkpoint, but computes the plan only once, and
    survives lost executors because the files belong to no executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside higher-order functions.

    A plain expression that a lambda mentions is evaluated for every element;
    as the only element of an array it is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no name of theirs can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def small(df: DataFrame, most: int, items: Column | None = None) -> DataFrame:
    """``df`` (already materialised) marked for broadcast if it has at most
    ``most`` rows, and so many ``items`` (a number for each row) in all; beyond
    that it is returned as it is and joins by shuffle."""
    if df.limit(most + 1).count() > most or items is not None and (df.agg(F.sum(items)).first()[0] or 0) > most:
        return df
    return F.broadcast(df)


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` at
    most.  Keys with more than ``FANOUT`` rows are dealt to several tasks by
    the hash of ``by``, with a copy of the table's row in each."""
    hot = materialise(rows.groupBy(key).agg(F.ceil(F.count("*") / FANOUT).alias("_parts")).where("_parts > 1"), "hot")
    if not hot.limit(1).count():
        return rows.join(table, key)
    hot = small(hot, BROADCAST_KEYS)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0).cast("bigint"))
    many = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1)
    few = table.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return many.join(few, [key, "_part"]).drop("_part")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``.

    Alternates the large-star and small-star steps until nothing changes.
    Each step is a grouped minimum (combined before the shuffle) and an equi-
    join that deals the edges of a hub to several tasks.
    Returns ``node, component`` for every node that has an edge to another
    one; ``component`` is the smallest node reachable.  Nulls and loops are no
    edges.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = materialise(e, label), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = mark
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = spread_join(both, low, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = spread_join(large, low, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        e = materialise(e, label)
