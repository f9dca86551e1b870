"""Feeds as a data source: a few feeds a partition, bounded retries, a state in place of a failure.

    spark.dataSource.register(FeedFiles)
    spark.read.format("feed_files").option("root", folder).option("feeds", json_list_of_names).load()

gives one row a feed, (feed, body, state, attempts), in the order of the list. A feed is
a folder of part files, or a file, under `root`, a folder that all machines share. `state`
is null where the body was read, "http_error" where there is none or it is larger than
`max_bytes`, and "timeout" where reading it took more than `timeout` seconds.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, RETRIES, TIMEOUT_S = 5_000_000, 2, 15.0
#: Feeds have a partition each up to so many; beyond that neighbours share one, MOST_A_TASK at most, since a task takes longer to start than a feed to read.
TASKS, MOST_A_TASK = 200, 64


class Feeds(InputPartition):
    def __init__(self, first: int, names: list[str]):
        super().__init__((first, names))
        self.first, self.names = first, names


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options["root"]
        if "://" in root and not root.startswith("file://"):
            raise ValueError("feed_files reads a folder that is mounted on all machines")
        self.root = root.removeprefix("file://").removeprefix("file:")
        self.feeds = json.loads(options["feeds"])
        self.most, self.retries, self.timeout = int(options.get("max_bytes", MAX_BYTES)), int(options.get("retries", RETRIES)), float(options.get("timeout", TIMEOUT_S))

    def partitions(self) -> list[Feeds]:
        some = max(1, min(MOST_A_TASK, -(-len(self.feeds) // TASKS)))
        return [Feeds(i, self.feeds[i : i + some]) for i in range(0, len(self.feeds), some)]

    def fetch(self, name: str) -> str:
        """The body of a feed; raises OSError, TimeoutError or ValueError."""
        until = time.monotonic() + self.timeout
        path = os.path.join(self.root, name)
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", "."))) if os.path.isdir(path) else [path]
        if not files:
            raise OSError(f"{name} is empty")
        out, left = [], self.most
        for file in files:
            with open(file, "rb") as f:
                out.append(f.read(left + 1))
            left -= len(out[-1])
            if left < 0:
                raise ValueError(f"{name} is larger than {self.most} bytes")
            if time.monotonic() > until:
                raise TimeoutError(name)
        return b"".join(out).decode("utf-8", "replace")

    def read(self, partition: Feeds | None) -> Iterator[tuple]:
        if partition is None:  # no feeds
            return
        for place, name in enumerate(partition.names, partition.first):
            yield self.outcome(place, name)

    def outcome(self, place: int, name: str) -> tuple:
        state = "http_error"
        for attempt in range(1, self.retries + 2):
            try:
                return place, name, self.fetch(name), None, attempt
            except TimeoutError:
                state = "timeout"
            except (OSError, ValueError):
                state = "http_error"
        return place, name, None, state, self.retries + 1


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return "place int, feed string, body string, state string, attempts int"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def fetch_all(spark: SparkSession, root: str, names: list[str], **options: object) -> DataFrame:
    """(place, feed, body, state, attempts) of every feed named, in their order; a feed that fails gives its state."""
    spark.dataSource.register(FeedFiles)
    reader = spark.read.format("feed_files").option("root", root).option("feeds", json.dumps(names))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()  # partitions follow the list, so rows do


def feed_states(fetched: DataFrame, items: DataFrame) -> DataFrame:
    """A2: (feed, state, n_items): the transport's state, else parse_error, empty or ok. items: feed, one row an item; fetched: with `kind`."""
    n = items.groupBy("feed").agg(F.count(F.lit(1)).alias("n_items"))
    met = fetched.join(n, "feed", "left")
    state = F.coalesce("state", F.when(F.col("kind").isNull(), "parse_error").when(F.coalesce("n_items", F.lit(0)) == 0, "empty").otherwise("ok"))
    return met.select("feed", state.alias("state"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
