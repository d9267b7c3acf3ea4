"""Running winner counts and their drift, kept by key in the state of a stream.

Rows are scored where they lie and added up in their task by key, window and winner, so that a micro-batch sends one short row for each of these, however
many rows a key has. The state of a key holds the counts of its open windows and those of all windows that are closed. A timer closes a window when
the watermark has passed its end.

What the stream tells, by kind:

running  the counts of a window and winner so far, again whenever they have changed
closed   the last counts of a window and winner, once; drift is the distance (half the sum of absolute differences) of the window's shares of winners from those
         of all windows of the key that were closed before, null for the first
late     counts of rows whose window was closed when they came; they change nothing in the state

So for every window the last running counts plus the late ones are those of a batch over the same rows, in whatever order they came. doubtful counts the
rows whose strength is below `doubt`. Rows without a time are left out; a null key is a key.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumifuzz.operators.rules import RuleBase
from lumifuzz.sources import shared

OUTPUT = "key string, window_start timestamp, winner int, n long, doubtful long, drift double, kind string"
# times go through Python as milliseconds: those of pandas end in 1677 and 2262
_TOLD = OUTPUT.replace("window_start timestamp", "window_start long")
_PARTS = "key string, window long, winner int, n long, doubtful long, last long"
_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Before the first micro-batch Spark sets the processor up in a Python process on the driver, which gets neither files of addPyFile nor the driver's sys.path: the processor takes its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each key, window and winner of a task's share of a micro-batch."""
    parts = [b.groupby(["key", "window", "winner"], dropna=False, as_index=False).agg(n=("doubtful", "size"), doubtful=("doubtful", "sum"), last=("time", "max")) for b in batches if len(b)]
    if parts:
        whole = pd.concat(parts).groupby(["key", "window", "winner"], dropna=False, as_index=False).agg({"n": "sum", "doubtful": "sum", "last": "max"})
        yield whole.assign(key=whole["key"].astype(object).where(whole["key"].notna(), None))


class Winners(StatefulProcessor):
    """The state of one key. size: of a window, in milliseconds."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a window is one entry, so that closing it does not go through all open ones
        self.open = handle.getMapState("open", "window long", "winner array<int>, n array<long>, doubtful array<long>")
        self.closed = handle.getMapState("closed", "winner int", "n long")

    def _row(self, key, window, winner, n, doubtful, drift, kind) -> tuple:
        return key[0], window, winner, n, doubtful, drift, kind

    def _held(self, window: int) -> dict[int, tuple[int, int]]:
        """n and doubtful by winner of an open window."""
        return {w: (n, d) for w, n, d in zip(*self.open.getValue((window,)), strict=True)}

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        changed: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for batch in rows:
            for window, winner, n, doubtful in zip(*(batch[c].tolist() for c in ("window", "winner", "n", "doubtful")), strict=True):
                changed[window][winner][0] += n
                changed[window][winner][1] += doubtful
        out = []
        for window, by in sorted(changed.items()):
            if window + self.size <= passed:
                out += [self._row(key, window, winner, *counts, None, "late") for winner, counts in sorted(by.items())]
                continue
            if self.open.containsKey((window,)):
                held = self._held(window)
            else:
                held = {}
                self.handle.registerTimer(window + self.size)
            for winner, (n, doubtful) in sorted(by.items()):
                before = held.get(winner, (0, 0))
                held[winner] = (n + before[0], doubtful + before[1])
                out.append(self._row(key, window, winner, *held[winner], None, "running"))
            self.open.updateValue((window,), (list(held), *map(list, zip(*held.values(), strict=True))))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        window = expiredTimerInfo.getExpiryTimeInMs() - self.size
        held = self._held(window)
        self.open.removeKey((window,))
        before = {k[0]: v[0] for k, v in self.closed.iterator()}
        rows, ever = sum(n for n, _ in held.values()), sum(before.values())
        drift = sum(abs(held.get(w, (0, 0))[0] / rows - before.get(w, 0) / ever) for w in held.keys() | before.keys()) / 2 if rows and ever else None
        for winner, (n, _) in held.items():
            self.closed.updateValue((winner,), (before.get(winner, 0) + n,))
        yield _frame([self._row(key, window, winner, n, doubtful, drift, "closed") for winner, (n, doubtful) in sorted(held.items())])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return made.astype({"window_start": "int64", "winner": "int32", "n": "int64", "doubtful": "int64", "drift": "float64"})


def winners(stream: DataFrame, base: RuleBase, time: str, key: str, window_seconds: int = 86_400, late: str = "1 hour", doubt: float = 0.5) -> DataFrame:
    """The stream of OUTPUT for rows scored by a base. Needs a state store that can hold several values for a key (run() sets it)."""
    size = 1000 * window_seconds
    at = F.col(time).cast("timestamp")
    scored = base.explain(stream.where(F.col(time).isNotNull()))
    rows = scored.select(F.col(key).cast("string").alias("key"), (F.floor(F.unix_millis(at) / size) * size).alias("window"), F.col("winner").cast("int").alias("winner"), (F.col("strength") < doubt).cast("long").alias("doubtful"), F.unix_millis(at).alias("time"))
    # the watermark is taken here; its column does not go on to the state, where rows before the watermark would be dropped unseen
    parts = rows.mapInPandas(_added_up, _PARTS).withColumn("last", F.timestamp_millis("last")).withWatermark("last", late).drop("last")
    told = parts.groupBy("key").transformWithStateInPandas(statefulProcessor=Winners(size), outputStructType=_TOLD, outputMode="Update", timeMode="EventTime")
    return told.withColumn("window_start", F.timestamp_millis("window_start"))


def run(stream: DataFrame, base: RuleBase, time: str, key: str, folder: str | None = None, **options) -> DataFrame:
    """Runs the stream over all that its source holds now and gives what it has told so far, as a table. folder: results and state, in the shared folder; a later run with the same one goes on from there."""
    spark = stream.sparkSession
    folder = folder or shared.shared_folder(spark, "winners")
    # None: left at Spark's default
    held = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    try:
        spark.conf.set(_PROVIDER, _ROCKS)
        # as many state stores as there are cores, not more: they outlive this run
        spark.conf.set(_PARTITIONS, str(min(int(spark.conf.get(_PARTITIONS)), spark.sparkContext.defaultParallelism)))
        told = winners(stream, base, time, key, **options)
        to = told.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        to.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/told/batch={i}")).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{OUTPUT}, batch long").parquet(f"{folder}/told")


def totals(told: DataFrame) -> DataFrame:
    """key, window_start, winner, n, doubtful: for each window its last running counts plus what came late."""
    names = ["key", "window_start", "winner"]
    last = told.where("kind = 'running'").groupBy(*names).agg(F.max("n").alias("n"), F.max("doubtful").alias("doubtful"))
    late = told.where("kind = 'late'").groupBy(*names).agg(F.sum("n").alias("n"), F.sum("doubtful").alias("doubtful"))
    return last.unionByName(late).groupBy(*names).agg(F.sum("n").alias("n"), F.sum("doubtful").alias("doubtful"))


def read_table(spark: SparkSession, path: str, bytes_per_trigger: int = 1 << 28) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files; small ones share a micro-batch, each of which costs about a second."""
    # a pattern for the same name: a plain path would have to be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
