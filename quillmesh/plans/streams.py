"""K: streaming operators, run over a table as a stream to its end.

A table is one file and so one batch; watermarks of a day or an hour hold back nothing in
it, and let state go where a stream has many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmesh.operators.scale import shared_dir
from quillmesh.session import ship
from quillmesh.sources.fixtures import with_tables
from quillmesh.streaming import state as K

from .base import query


def finished(stream, spark, mode: str, keys: tuple[str, ...] = ()):
    """The result of a stream that reads what is there, written to the shared folder.

    In update mode a batch is written under its number, so that a repeated batch replaces
    itself, and the last batch that has a row of `keys` tells its values.
    """
    name = f"k_{uuid.uuid4().hex[:10]}"
    at = f"{shared_dir(spark)}/streams/{name}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")  # a stream without rows has no batch
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/out")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def events_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def runs_stream(spark, d):
    state = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 20, "empty").otherwise("ok")
    return events_stream(spark, d).select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.col("event_id").alias("run"), state.alias("state"))


@query("k01_health_stream", with_tables("runs", also="""i AS (SELECT *, sum(CASE WHEN state <> 'error' THEN 1 ELSE 0 END) OVER w AS ie, sum(CASE WHEN state <> 'empty' THEN 1 ELSE 0 END) OVER w AS im FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY run)),
  c AS (SELECT *, CAST(sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, ie ORDER BY run) AS BIGINT) AS consecutive_error, CAST(sum(CASE WHEN state = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, im ORDER BY run) AS BIGINT) AS consecutive_empty FROM i)""") + "SELECT source_id, run, consecutive_error, consecutive_empty, consecutive_error >= 3 OR consecutive_empty >= 5 AS unhealthy FROM c")
def k01(spark, d):
    ship(spark)
    return finished(K.health(runs_stream(spark, d)), spark, "append")


@query("k03_first_seen_stream", with_tables("history") + "SELECT article_id, min(ts) AS first_seen FROM history GROUP BY article_id")
def k03(spark, d):
    return finished(K.first_seen(events_stream(spark, d).select((F.col("event_id") * 13 % 1000).alias("article_id"), "ts")), spark, "update", ("article_id",))


@query("k08_recorded_once_stream", with_tables("history") + "SELECT DISTINCT user_id, article_id, kind FROM history")
def k08(spark, d):
    h = events_stream(spark, d).select("user_id", (F.col("event_id") * 13 % 1000).alias("article_id"), F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "opened").when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("save").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return finished(K.recorded_once(h).select("user_id", "article_id", "kind"), spark, "append")


LIVE_RUNS, LIVE_EVERY_S = 10, 4 * 3600


def live_run(batch):
    """id, hype, eligible, now_s: a run's events: how many different readers each of twelve had, and whether any of them bought."""
    run = F.floor((F.dayofmonth("ts") - 1) / 3)
    e = batch.groupBy(F.concat(F.lit("e"), (F.col("event_id") % 12).cast("string")).alias("id")).agg(F.countDistinct("user_id").alias("hype"), (F.count_if(F.col("event_type") == "purchase") * 5 > F.count(F.lit(1))).alias("eligible"), F.max(run).alias("run"))
    return e.select("id", "hype", "eligible", (F.col("run") * LIVE_EVERY_S).cast("long").alias("now_s"))


@query("k02_live_slot")
def k02(spark, d):
    """K2: the live slot over ten runs of three days of events each, a run a batch of a stream, four hours apart."""
    at = f"{shared_dir(spark)}/streams/live_{uuid.uuid4().hex[:10]}"
    events = spark.read.parquet(f"{d}/events.parquet")
    for run in range(LIVE_RUNS):  # one file a run, in order of time
        events.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 3), F.lit(LIVE_RUNS - 1)) == run).coalesce(1).write.mode("append").parquet(f"{at}/runs")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/runs")
    step = K.live_batches(f"{at}/slots", lambda batch, _: live_run(batch))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, since_s long, epoch int").parquet(f"{at}/slots").select("epoch", "id", "since_s")
