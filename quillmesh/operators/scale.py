"""Scale helpers: the cluster's shared folder, cut lineage, and joins that hot keys do not break."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many hot keys are broadcast by `skew_join`; a key is hot only
#: beyond one part in HOT_KEYS of the rows, so more cannot exist.
HOT_KEYS = 1000


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, with as many underscores more as set it apart from the columns of `frames`."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A folder of our own only where none is set and driver and tasks share a machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillmesh-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quillmesh/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut lineage that outlives executors.

    Shuffle files of the plan go when it has been written, as nothing reads them again.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hot_keys(left: DataFrame, key: str, rows: int, hot: int = HOT_KEYS) -> DataFrame:
    """(key, salts) of the keys with more than rows/hot rows: `hot` rows at most, one salt per share."""
    share = max(32, math.ceil(rows / hot))
    return (
        left.groupBy(F.col(key).alias("hot_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > share) & F.col("hot_key").isNotNull())
        .select("hot_key", F.ceil(F.col("n") / share).cast("int").alias("salts"))
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: Column, rows: int, how: str = "inner", counts: str | None = None) -> DataFrame:
    """`left` joined with `right` on `key`, hot keys of `left` dealt over several tasks.

    `right` has few rows a key (mostly one). Rows of a hot key get one of its salts by
    `spread`; the right side repeats its rows of that key once a salt, so the repeats
    number HOT_KEYS at most over all keys. Only (key, salts) of hot keys is broadcast.
    `how`: inner or left. `counts`: the column of `right`, one row a key, that has the
    number of left rows of its key; without it they are counted. Columns other than the
    key must have different names on the two sides; any names will do.
    """
    hot_key, salts, salt_l, salt_r, key_r = (free_name(x, left, right) for x in ("hot_key", "salts", "salt_", "salt_r", "key_"))
    if counts:
        share = max(32, math.ceil(rows / HOT_KEYS))
        hot = right.filter((F.col(counts) > share) & F.col(key).isNotNull()).select(F.col(key).alias(hot_key), F.ceil(F.col(counts) / share).cast("int").alias(salts))
    else:
        hot = materialize(hot_keys(left, key, rows), scratch(left.sparkSession, "hot")).toDF(hot_key, salts)
    some = F.broadcast(hot)
    salted = left.join(some, F.col(key) == F.col(hot_key), "left").withColumn(salt_l, F.coalesce(F.pmod(F.xxhash64(spread), F.col(salts)), F.lit(0)).cast("int")).drop(hot_key, salts)
    dealt = right.withColumnRenamed(key, key_r).join(some, F.col(key_r) == F.col(hot_key), "left").withColumn(salt_r, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts) - 1, F.lit(0))))).drop(hot_key, salts)
    return salted.join(dealt, (F.col(key) == F.col(key_r)) & (F.col(salt_l) == F.col(salt_r)), how).drop(salt_l, salt_r, key_r)
