"""State by key for the streaming operators, in a RocksDB state store, with a limit in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

#: What a step takes (keys, the number of each row's key, the batch's rows of these keys, their states or None) and gives
#: (new states or None, rows to emit).
Step = Callable[[list[tuple], np.ndarray, pd.DataFrame, list[tuple | None]], tuple[list[tuple | None], pd.DataFrame]]

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1 << 10  # of keys, by their hash; fixed for a stream's life


def prepare_store(spark: SparkSession) -> None:
    """State in RocksDB, its changes alone written at each batch: state may be larger than memory, and recovers from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Keyed(StatefulProcessor):
    """Steps the keys of a bucket together; a map keeps a value for each, of which a batch reads and writes its own keys' alone."""

    def __init__(self, step: Step, keys: StructType, kept: str, span: int | None):
        self.step, self.keys, self.span = step, keys, span
        self.kept = kept if span is None else f"{kept}, until_ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("kept", self.keys, self.kept)

    def ids(self, rows: pd.DataFrame) -> list[tuple]:
        """Keys as the state takes them; pandas may have made whole numbers beside unknown ones floats."""
        plain = lambda v, f: None if pd.isna(v) else int(v) if isinstance(f.dataType, IntegralType) else v
        return [tuple(map(plain, r, self.keys)) for r in rows[self.keys.names].itertuples(index=False, name=None)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        part = pd.concat(frames, ignore_index=True)
        number = part.groupby(self.keys.names, sort=False, dropna=False).ngroup().to_numpy()
        ids = self.ids(part.iloc[np.unique(number, return_index=True)[1]])
        states = [self.values.getValue(k) for k in ids]
        before = [s if s is None else tuple(s)[: None if self.span is None else -1] for s in states]
        held, made = self.step(ids, number, part, before)
        if self.span is not None:
            now, newest = timerValues.getCurrentWatermarkInMs(), part["newest_ms"].groupby(number).max()
            until = [max(now, now if pd.isna(t) else int(t)) + self.span for t in newest]
            held = [h if h is None else (*h, t) for h, t in zip(held, until, strict=True)]
            self.wake([t for h, t in zip(held, until, strict=True) if h is not None])
        for k, h in zip(ids, held, strict=True):
            if h is not None:
                self.values.updateValue(k, tuple(h))
        yield made

    def wake(self, times: list[int]) -> None:
        """The bucket's one timer rings when the first of its keys may have to go."""
        timers = list(self.handle.listTimers())
        for timer in timers:
            self.handle.deleteTimer(timer)
        if timers or times:
            self.handle.registerTimer(min([*timers, *times]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        until = [(tuple(k), v[-1]) for k, v in self.values.iterator()]
        for k, t in until:
            if t <= now:
                self.values.removeKey(k)
        left = [t for _, t in until if t > now]
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, keys: list[str], step: Step, out: str, kept: str, mode: str = "append", idle: str | None = None, time: str = "ts") -> DataFrame:
    """``step`` over the rows of a batch, a bucket of keys at a time: a bucket's rows must fit in a task (bound them by the source's options).

    A call into Python and its tables cost far more than a key's few rows, so keys share them.
    With ``idle`` (such as "1 hour") rows carry a timestamp ``time``, the stream's watermark is ``idle`` behind the newest of
    them, and a key is forgotten, by a timer, once the watermark is ``idle`` past its newest row. Rows older than the
    watermark are dropped by Spark, which counts them in its own progress. Without ``idle`` state stays for ever. The limit
    is in event time: for a limit in processing time Spark always runs one batch more, so a query that takes what is there
    never ends.
    """
    prepare_store(rows.sparkSession)
    kind, span = StructType([rows.schema[k] for k in keys]), None
    if idle is not None:
        span = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))
        rows = rows.withWatermark(time, idle).withColumn("newest_ms", F.unix_millis(time))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(Keyed(step, kind, kept, span), out, mode, "None" if idle is None else "EventTime")
