"""The change feed: the events of commits as a stream, and what lives on it.

Events are rows ``(commit_ts, author, kind, g, s, p, o)`` in files that come once their commit stands and
are only ever added, so a structured stream reads each once and none of a failed commit; resuming is its
checkpoint, or a filter on ``commit_ts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions.terms import RDF_TYPE
from quadspark.operators.store import CHANGE_DDL, Store


class OutOfRange(Exception):
    """The feed no longer reaches back to where a reader wants to resume."""


def filtered(changes: DataFrame, after: int | None = None, graphs: list[str] | None = None, predicates: list[str] | None = None, types: DataFrame | None = None, values: bool = True) -> DataFrame:
    """``types (s)`` limits subjects; without ``values`` literal objects are left out."""
    rows = changes if after is None else changes.where(F.col("commit_ts") > after)
    rows = rows if graphs is None else rows.where(F.col("g").isin(*graphs))
    rows = rows if predicates is None else rows.where(F.col("p").isNull() | F.col("p").isin(*predicates))
    rows = rows if types is None else rows.join(types.select("s").distinct(), "s", "left_semi")
    return rows if values else rows.withColumn("o", F.when(F.col("o.kind") == "U", F.col("o")))


def stream(spark: SparkSession, store: Store, **options) -> DataFrame:
    """The feed as a streaming DataFrame."""
    store.publish()
    fs, path = store._fs(f"{store.path}/changes")
    fs.mkdirs(path)  # a store without a commit has an empty feed
    rows = spark.readStream.schema(CHANGE_DDL).option("recursiveFileLookup", "true").parquet(f"{store.path}/changes")
    return filtered(rows, **options)


def batch(store: Store, after: int | None = None, **options) -> DataFrame:
    """Events after a commit, in commit order; :class:`OutOfRange` if events after it were pruned."""
    floor = store.floor()
    if after is not None and after < floor:
        raise OutOfRange(f"the feed begins after {floor}")
    return filtered(store.changes(), floor if after is None else after, **options).orderBy("commit_ts", "g", "s", "p")


def subscribe(spark: SparkSession, store: Store, each: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Hands batches of events to ``each`` until what is there is read; returns the query."""
    rows = stream(spark, store, **options)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_index(changes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(g, s, type)`` after the events, a consumer of the feed; ``before`` is the index that they change.

    Within a commit an assertion wins over the closing of the same quad, which it replaces.
    """
    rows = changes.where((F.col("p") == RDF_TYPE) & F.col("o").isNotNull() & F.col("kind").isin("assert", "close"))
    order = F.struct("commit_ts", (F.col("kind") == "assert").alias("set"))
    last = rows.groupBy("g", "s", F.col("o.str").alias("type")).agg(F.max(order).alias("last"))
    out = last.where("last.set").select("g", "s", "type")
    return out if before is None else out.unionByName(before.join(last, ["g", "s", "type"], "left_anti").select("g", "s", "type"))


class TypeIndex:
    """The type index of a store, kept in a folder and brought up to date from the feed."""

    def __init__(self, store: Store, path: str):
        self.store, self.path = store, path.rstrip("/")

    def _state(self) -> tuple[int, str] | None:
        """The newest version that was written in whole: its commit and folder."""
        fs, p = self.store._fs(self.path)
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        done = [n for n in names if fs.exists(self.store._fs_path(f"{self.path}/{n}/_SUCCESS"))]
        return (int(done[-1]), f"{self.path}/{done[-1]}") if done else None

    def refresh(self) -> int:
        """Follows the feed from where the index stands; the commit that it now stands at."""
        state, last = self._state(), self.store.last()
        if state and state[0] >= last:
            return last
        spark = self.store.spark
        events = batch(self.store, state[0]) if state else batch(self.store)
        events = events.where(F.col("commit_ts") <= last)
        before = spark.read.parquet(state[1]) if state else None
        type_index(events, before).write.mode("overwrite").parquet(f"{self.path}/{last:020d}")
        return last

    def read(self) -> DataFrame:
        state = self._state()
        return self.store.spark.read.parquet(state[1]) if state else self.store.spark.createDataFrame([], "g string, s string, type string")


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of an events stream by time window, with a watermark."""
    ts = events.withWatermark("ts", late)
    return ts.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
