"""What several operators share: a shared scratch folder, cut lineage, distributed ranks and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary one if driver and executors are one process, as in tests, and an error on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("-")[0].startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="lodemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-made table, as a file that any executor can read again after a loss."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts be small, for all that the session runs: 10,000 whole texts at once fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class _Cleaned:
    """Shuffle files of the queries run inside are dropped when each ends: what it made is in a written table by then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")

    def __exit__(self, *_):
        self.spark.conf.set(CLEANUP, self.was)


def cut(df: DataFrame, what: str = "cut", codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing above it."""
    spark = session(df)
    path = scratch(spark, what)
    with _Cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodemark_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a cut table that nothing lazy reads any more."""
    if path := getattr(df, "_lodemark_path", None):
        remove(session(df), path)


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with as many underscores before them as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys that may count as hot at most (those are a table that is broadcast), and rows that a hot key has at least.
HOT_KEYS, LEAST_HOT = 10_000, 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has each key once and in `count` how many of the rows have it.

    Keys that more than 1 / HOT_KEYS of the rows have (there are HOT_KEYS of them at most) are broadcast, so their rows
    stay where they are; all others meet by a shuffle, in groups that small. table has to be a written one.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total // HOT_KEYS, LEAST_HOT)
    some = table.where(hot).drop(count)
    if some.isEmpty():
        return rows.join(table.drop(count), key, how)
    near = rows.join(F.broadcast(some), key)
    rest = rows.join(F.broadcast(some.select(key)), key, "left_anti")
    return near.unionByName(rest.join(table.where(~hot).drop(count), key, how))


def hashed_sample(rows: DataFrame, h: str, n: int, most: int) -> DataFrame:
    """About `most` of the n rows (all, if fewer): those whose hash column h is below a bound that n fixes."""
    if n <= most:
        return rows
    return rows.where(F.col(h) < F.lit(int(-(1 << 63) + (1 << 64) * (most / n)))).limit(2 * most)


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def with_prefix(df: DataFrame, group: list[str], order: list[Column], bucket: Column, weight: Column, name: str) -> DataFrame:
    """df with `name`: the sum of weight over the rows of its group that come before it.

    Rows come by bucket, then by order. Only (group, bucket) meets in a task, so a hot group is dealt over its buckets;
    the sums of whole buckets are a small table, one row for each group and bucket.
    """
    df = df.withColumn("_b", bucket).withColumn("_w", weight)
    key = [F.col(c) for c in group] + [F.col("_b")]
    totals = df.groupBy(*key).agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b") if group else Window.orderBy("_b")
    totals = totals.withColumn("_base", F.sum("_t").over(before) - F.col("_t")).drop("_t")
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_in", F.sum("_w").over(inside) - F.col("_w"))
    return df.join(totals, [*group, "_b"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_w", "_base", "_in")


#: Tasks that one node's edges are dealt over.
SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge table of two long columns.

    Alternates large-star and small-star, each a grouped minimum and a join, until no edge moves; every round is a
    written table, and only its row count and checksum come to the driver. Joins are salted, so a hub's edges are dealt
    over SALTS tasks.
    """

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        many = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(many, ["u", "_s"]).drop("_s")

    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = cut(small, "edges")
        drop_cut(now)
        now = after
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
