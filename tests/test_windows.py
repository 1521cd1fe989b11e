import datetime as dt

import pandas as pd

from stepwell.streaming import windows


class State:
    def __init__(self):
        self.rows, self.calls = [], 0

    def _set(self, rows):
        self.rows, self.calls = rows, self.calls + 1

    update = lambda self, value: self._set([value])
    put = lambda self, values: self._set(list(values))
    appendValue = lambda self, value: self._set([*self.rows, value])  # noqa: E731, N815
    clear = lambda self: self._set([])
    exists = lambda self: bool(self.rows)


class Value(State):
    get = lambda self: self.rows[0]


class Listed(State):
    get = lambda self: iter(self.rows)


class Handle:
    def __init__(self):
        self.made = []

    def getValueState(self, name, schema):  # noqa: N802
        return self.made.append(Value()) or self.made[-1]

    def getListState(self, name, schema):  # noqa: N802
        return self.made.append(Listed()) or self.made[-1]

    def registerTimer(self, end):  # noqa: N802
        pass


class Before:
    getCurrentWatermarkInMs = lambda self: 0  # noqa: E731, N815


def test_users_of_a_batch_are_one_call_and_stay_exact():
    processor, handle = windows.WindowUsers(60), Handle()
    processor.init(handle)
    key, n = ("ws_1", "vpv", dt.datetime(2024, 1, 10), 0), windows.CHUNKS * 2 + 3
    for k in range(n):  # each batch has half of the users of the one before
        ids = [f"anonymous-{k * 50 + i}" for i in range(100)] + [None]
        list(processor.handleInputRows(key, iter([pd.DataFrame({"anonymous_id": ids})]), Before()))
    assert sum(s.calls for s in handle.made) == 2 * n and all(len(s.rows) <= windows.CHUNKS for s in handle.made)
    (row,) = list(processor.handleExpiredTimer(key, None, None))
    assert (row["event_count"].item(), row["users"].item()) == (101 * n, 50 * (n + 1)) and not any(s.rows for s in handle.made)
