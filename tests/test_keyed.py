"""The streams' keyed state without a stream: keys of a bucket share a call, each has its own value."""

import pandas as pd
from pyspark.sql.types import LongType, StructField, StructType

from strideframe.streaming.keyed import Keyed


class Handle:
    """Stands for the state store of one bucket."""

    def __init__(self):
        self.values, self.timers = {}, []
        self.getValue, self.updateValue, self.removeKey = self.values.get, self.values.__setitem__, self.values.pop

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter(list(self.values.items()))

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_keys_of_a_bucket_share_a_call_and_are_forgotten_apart():
    calls = []

    def step(keys, number, rows, states):
        calls.append(len(keys))
        sums = rows["x"].groupby(number).sum().tolist()
        new = [((s or (0,))[0] + x,) for s, x in zip(states, sums, strict=True)]
        return new, pd.DataFrame([(*k, *n) for k, n in zip(keys, new, strict=True)], columns=["video_id", "sum"])

    handle, state = Handle(), Keyed(step, StructType([StructField("video_id", LongType())]), "sum long", 100)
    state.init(handle)
    feed = lambda rows, now: [tuple(map(int, r)) for out in state.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["video_id", "x", "newest_ms"])]), Now(now)) for r in out.itertuples(index=False)]
    assert feed([(v, 1, 10 * v) for v in range(50)] + [(7, 2, 500)], 0) == [(v, 3 if v == 7 else 1) for v in range(50)]
    assert calls == [50] and handle.timers == [100]
    handle.timers.clear()
    assert list(state.handleExpiredTimer((0,), Now(300), Now(100))) == []
    assert sorted(k for k, in handle.values) == [7, *range(21, 50)] and handle.timers == [310]
    assert feed([(7, 5, 510), (1, 1, 510)], 300) == [(7, 8), (1, 1)] and handle.timers == [310]
