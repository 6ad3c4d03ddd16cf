"""Streams whose results come by time: states that change without a row, calls that stay open, and
summaries that come later.

Rows wait in state until the watermark has passed them, so that late ones stand in their place; then
they are taken in order of (ts, uid), and timers do what is due in between.  Times are microseconds in
state, so a session's time zone doesn't matter.

What belongs together is a session, or a call of a session.  Those are dealt by hash over ``GROUPS`` groups,
which are the keys of state: each call into state costs the same whatever it carries, so state holds a
group's rows as Arrow batches, and a group takes all of its sessions at once.  A task holds one group's
waiting rows at a time; streams with more than some 10^9 of them want more groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys of state, rows of an Arrow batch in state, and the column that holds the key.
GROUPS, BATCH_ROWS, _GROUP = 1024, 100_000, "_group"

#: Seconds without a row until a session is no longer live, until nobody is awaited
#: any more, and until it is idle.
QUIET, AWAITED, IDLE = 120, 301, 86_400
_SECOND = 1_000_000


def with_timers(spark: SparkSession) -> None:
    """State with timers needs this store; it can't be set once streams run."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Rows (keys..., at, uid, ...) of one group in their order once the watermark has passed them.  Subclasses
    ``take`` those rows, and say what of them is ``kept`` for the rows to come, and when something is due."""

    #: What belongs together, columns of the rows behind at and uid, and those of the result.
    keys: tuple[str, ...] = ()
    more: tuple[tuple[str, pa.DataType], ...] = ()
    out = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([*[(k, pa.string()) for k in self.keys], ("at", pa.int64()), ("uid", pa.string()), *self.more])
        self.batches = handle.getListState("batches", "rows binary")
        self.armed = handle.getValueState("armed", "ms long")
        self.told = handle.getValueState("told", "at long")

    def take(self, rows: pa.Table, kept: np.ndarray, first: np.ndarray, told: int, now: int) -> tuple[list[pd.DataFrame], pa.Table, int | None]:
        """Results, rows to keep, and the time at which something is due next.  ``rows`` are those up to
        ``now``, in order; ``first`` says where another key begins, ``kept`` which of them was kept when
        all up to ``told`` had been taken."""
        raise NotImplementedError

    def _arm(self, at: int | None) -> None:
        ms = None if at is None else -(-at // 1000)
        old = self.armed.get()[0] if self.armed.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.armed.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.armed.update((ms,))

    def _state(self) -> list[pa.Table]:
        return [pa.ipc.open_stream(bytes(data)).read_all() for (data,) in self.batches.get()]

    def _put(self, rows: pa.Table) -> None:
        found = []
        for batch in rows.combine_chunks().to_batches(max_chunksize=BATCH_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            found.append((sink.getvalue().to_pybytes(),))
        if found:
            self.batches.put(found)
        else:
            self.batches.clear()

    def _advance(self, new: list[pa.Table], now: int) -> Iterator[pd.DataFrame]:
        """Take the rows up to ``now``, then what is due by then; the others wait on."""
        flagged = lambda t: t.append_column("kept", pa.array(np.zeros(len(t), bool)))
        tables = [*self._state(), *map(flagged, new)]
        if not tables:
            return
        rows = pa.concat_tables(tables)
        told = self.told.get()[0] if self.told.exists() else 0
        ready = pc.or_(rows["kept"], pc.less_equal(rows["at"], now))
        waiting, rows = rows.filter(pc.invert(ready)), rows.filter(ready)
        found, due = [], None
        if len(rows):
            order = [*self.keys, "gone", "at", "uid"]
            rows = rows.append_column("gone", pc.invert(rows["kept"])).sort_by([(c, "ascending") for c in order])
            codes = [rows[k].combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in self.keys]
            first = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]
            found, kept, due = self.take(rows.select(self.schema.names), rows["kept"].to_numpy(), first, told, now)
            waiting = pa.concat_tables([waiting, kept.append_column("kept", pa.array(np.ones(len(kept), bool)))])
        self._put(waiting)
        self.told.update((now,))
        times = [pc.min(waiting.filter(pc.invert(waiting["kept"]))["at"]).as_py(), due]
        self._arm(min((t for t in times if t is not None), default=None))
        yield from (f for f in found if len(f))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False) for frame in rows]
        if any(t["at"].null_count for t in new):
            raise ValueError("a row of the stream has no time")
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        yield from self._advance([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        """Nothing is open."""


def _until_next(at: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the last of their key, and for each row the time of the next one, or ``end``."""
    last = np.r_[first[1:], True]
    return last, np.where(last, end, np.r_[at[1:], end])


class Changes(Ordered):
    """(session, at, state, awaiting) at each change; kept: a session's last row, with its last speaker."""

    keys, more = ("session",), (("kind", pa.string()),)
    out = "session string, at long, state string, awaiting boolean"
    #: A state can change at a row, and when it has been quiet so long.
    instants = np.array([0, QUIET, AWAITED, IDLE]) * _SECOND
    states = np.array(["live", "waiting", "idle"], object)

    def take(self, rows, kept, first, told, now):
        at, n = rows["at"].to_numpy(), len(rows)
        last, until = _until_next(at, first, now + 1)
        kinds = rows["kind"].to_numpy()
        told_by = np.select([kinds == "say", kinds == "prompt"], [1, 2], 0)
        speaker = told_by[np.maximum.accumulate(np.where((told_by > 0) | first, np.arange(n), 0))][:, None]
        moment = at[:, None] + self.instants
        state = np.where(self.instants < QUIET * _SECOND, 0, np.where((speaker == 1) & (self.instants < IDLE * _SECOND), 1, 2))
        awaiting = (speaker == 2) & (self.instants < AWAITED * _SECOND)
        status = state * 2 + awaiting
        known = (moment < until[:, None]) | (self.instants == 0)
        line = status[known]
        starts = (first[:, None] & (self.instants == 0))[known]
        fresh = ~(kept[:, None] & (moment <= told))[known]
        new = (np.r_[True, line[1:] != line[:-1]] | starts) & fresh
        row, col = (x[new] for x in np.nonzero(known))
        found = pd.DataFrame({"session": rows["session"].to_numpy()[row], "at": moment[row, col], "state": self.states[state[row, col]], "awaiting": awaiting[row, col]})
        ends = rows.filter(pa.array(last))
        said = pa.array(np.array([None, "say", "prompt"], object)[speaker[last, 0]], pa.string())
        ends = ends.set_column(ends.schema.get_field_index("kind"), "kind", said)
        later = last[:, None] & ~known & np.c_[np.zeros(n, bool), status[:, 1:] != status[:, :-1]]
        return [found], ends, int(moment[later].min()) if later.any() else None


class Calls(Ordered):
    """(session, call_id, call, result, kind) for each call, with the result that comes next or, after
    ``keep`` seconds, without; and for each failed result without a call.  Kept: the open calls."""

    keys, more = ("session", "call_id"), (("is_call", pa.bool_()), ("is_error", pa.bool_()))
    out = "session string, call_id string, call string, result string, kind string"

    def __init__(self, keep: int):
        self.keep = keep

    def take(self, rows, kept, first, told, now):
        at = rows["at"].to_numpy()
        last, until = _until_next(at, first, now + 1)
        is_call, is_error = (pc.fill_null(rows[c], False).to_numpy() for c in ("is_call", "is_error"))
        due = at + self.keep * _SECOND
        answered = is_call & ~last & (until <= due) & ~np.r_[is_call[1:], True]
        opened = is_call & last & (due >= until)
        lost = ~is_call & is_error & ~np.r_[False, answered[:-1]]
        session, call_id, uid = (rows[c].to_numpy() for c in ("session", "call_id", "uid"))
        shown = is_call & ~opened
        result = np.where(answered, np.r_[uid[1:], [None]], None)
        calls = pd.DataFrame({"session": session[shown], "call_id": call_id[shown], "call": uid[shown], "result": result[shown], "kind": "tool"})
        fails = pd.DataFrame({"session": session[lost], "call_id": call_id[lost], "call": None, "result": uid[lost], "kind": "fail"})
        return [calls, fails], rows.filter(pa.array(opened)), int(due[opened].min()) if opened.any() else None


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "uid": F.col("uid").cast("string")})


def _grouped(rows: DataFrame, job: Ordered, groups: int) -> DataFrame:
    keyed = rows.withColumns({k: F.col(k).cast("string") for k in job.keys}).withColumn(_GROUP, F.pmod(F.xxhash64(*job.keys), F.lit(groups)))
    return keyed.groupBy(_GROUP).transformWithStateInPandas(job, job.out, "append", "eventTime")


def state_changes(events: DataFrame, late: str = "1 minute", groups: int = GROUPS) -> DataFrame:
    """A row (session, at, state, awaiting) whenever a session's state changes, with or without a row of
    the session.  ``events``: session, uid, ts, kind."""
    return _grouped(_timed(events, late), Changes(), groups).withColumn("at", F.timestamp_micros("at"))


def folded(rows: DataFrame, late: str = "1 minute", keep: int = 86_400, groups: int = GROUPS) -> DataFrame:
    """Calls with the result that follows them, if one comes within ``keep`` seconds, and failed results
    that have no call, however rows come within the watermark.  ``rows``: session, call_id, uid, ts, is_call,
    is_error; rows without an id never pair, and each gets an id of its own."""
    own = F.when(F.col("call_id") == "", F.concat(F.lit("#"), F.col("uid").cast("string"))).otherwise(F.col("call_id"))
    return _grouped(_timed(rows, late).withColumn("call_id", own), Calls(keep), groups)


def swept(events: DataFrame, gists: DataFrame, wait: str = "7 days") -> DataFrame:
    """Events (hash, ts, ...) with the summary (hash, gist, created) of their text, whichever comes first, if
    the two are no more than ``wait`` apart.  An event may be matched by each version."""
    e = events.withWatermark("ts", wait)
    g = gists.select(F.col("hash").alias("g_hash"), "gist", "created").withWatermark("created", wait)
    near = (F.col("created") >= F.col("ts") - F.expr(f"INTERVAL {wait}")) & (F.col("created") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    return e.join(g, (F.col("hash") == F.col("g_hash")) & near).drop("g_hash")
