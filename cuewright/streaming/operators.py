"""Streaming twins of the batch operators: slots, clips, answers, stalls and counters while a recording arrives.

Slots and clips are in event time. Rows of a run may arrive in any order within `delay`: each is held in list state
until the watermark has passed its event time, and rows are handed on in order of start. A run ends by a row with
`closes`, or by an event-time timer once the watermark is `idle` past its last row; then all its state is removed.
Rows older than the watermark change nothing any more: they come out marked `late`, as a stream of their own
(`on_time`, `late_rows`), and `count_late` counts them by an observation. Spark itself drops what lies behind its own
watermark; ours is `reach` ahead of that, so that late rows up to `reach` behind still come out and only older ones
are Spark's to drop (and to count, in numRowsDroppedByWatermark). A longer reach holds nothing longer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS = "run_id string, slot long, start_n long, end_n long, is_hit boolean, covering long, hits long, score double, late boolean"
CLIPS = "run_id string, start_n long, end_n long, late boolean"
STALLS = "run_id string, level string, phase string"


class _InOrder(StatefulProcessor):
    """Holds a run's rows until the watermark has passed them and hands them on in order of start; ends runs by timers.

    `fields` are held besides start_n and end_n; a subclass gives `begin`, `row` and `end`, which take and change the
    run's own progress (a dict of numbers and short lists) and give rows of `columns`."""

    fields: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    kinds: str = ""

    def __init__(self, reach_ms: int, idle_ms: int):
        self.reach_ms, self.idle_ms = reach_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"event_ms long, start_n long, end_n long, closes boolean, {self.kinds}")
        self.progress = handle.getValueState("progress", "told string")
        self.timer = handle.getValueState("timer", "at long, last_ms long")

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns)

    def _wake(self, at: int | None, last_ms: int) -> None:
        """One timer a run: at its next row's event time, or once it has been idle."""
        old = self.timer.get() if self.timer.exists() else None
        if old and old[0] != at:
            self.handle.deleteTimer(old[0] - self.reach_ms)
        if at is not None:
            if not old or old[0] != at:
                self.handle.registerTimer(at - self.reach_ms)
            self.timer.update((at, last_ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        mark = mark + self.reach_ms if mark > 0 else 0  # no watermark yet
        late, held = [], []
        for b in rows:
            ms = b["event_ts"].astype("datetime64[ms]").astype("int64")
            for at, r in zip(ms, b[["start_n", "end_n", "closes", *self.fields]].itertuples(index=False), strict=True):
                if at < mark:
                    late.append(self.late(key[0], r))
                else:
                    held.append((int(at), int(r.start_n), int(r.end_n), bool(r.closes), *(None if pd.isna(x) else x for x in r[3:])))
        if held:
            self.held.appendList(held)
            at, last_ms = min(h[0] for h in held), max(h[0] for h in held)
            if self.timer.exists():
                old = self.timer.get()
                at, last_ms = min(at, old[0]), max(last_ms, old[1])
            self._wake(at, last_ms)
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() + self.reach_ms
        every = list(self.held.get()) if self.held.exists() else []
        due, rest = [h for h in every if h[0] <= mark], [h for h in every if h[0] > mark]
        told = json.loads(self.progress.get()[0]) if self.progress.exists() else self.begin()
        last_ms, out, closed = self.timer.get()[1], [], False
        for h in sorted(due, key=lambda h: (h[1], h[2])):
            out += self.row(key[0], told, h)
            closed |= h[3]
        self.timer.clear()
        if closed or not rest and last_ms + self.idle_ms <= mark:
            out += self.end(key[0], told)
            self.held.clear()
            self.progress.clear()
        else:
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
            self.progress.update((json.dumps(told),))
            self._wake(min(h[0] for h in rest) if rest else last_ms + self.idle_ms, last_ms)
        yield self._frame(out)

    def close(self) -> None:
        pass


class _Slots(_InOrder):
    fields, kinds = ("score", "is_hit", "total_n"), "score double, is_hit boolean, total_n long"
    columns = tuple(c.split()[0] for c in SLOTS.split(", "))

    def __init__(self, reach_ms: int, idle_ms: int, hop_n: int):
        super().__init__(reach_ms, idle_ms)
        self.hop_n = hop_n

    def late(self, run, r) -> tuple:
        return (run, None, int(r.start_n), int(r.end_n), bool(r.is_hit), None, None, float(r.score), True)

    def begin(self) -> dict:
        return {"first": None, "next": 0, "windows": [], "total": None, "until": 0}

    def _vote(self, run, told: dict, end: int) -> list[tuple]:
        slot, start = told["next"], told["next"] * self.hop_n
        cover = [w for w in told["windows"] if w[0] <= start and w[1] >= end]
        told["next"] += 1
        told["windows"] = [w for w in told["windows"] if w[1] > told["next"] * self.hop_n]
        if not cover:
            return []
        hits = sum(w[3] for w in cover)
        hit = hits >= min(told["first"] // self.hop_n // 2 + 1, len(cover))
        agree = [w[2] for w in cover if bool(w[3]) == hit]
        return [(run, slot, start, end, hit, len(cover), hits, sum(agree) / len(agree), False)]

    def row(self, run, told: dict, h: tuple) -> list[tuple]:
        _, start, end, _, score, is_hit, total = h
        out = []
        if told["first"] is None:
            told["first"] = end - start
        while told["next"] * self.hop_n < start:
            out += self._vote(run, told, (told["next"] + 1) * self.hop_n)
        told["windows"].append([start, end, score, int(is_hit)])
        told["until"] = max(told["until"], end)
        told["total"] = total if total is not None else told["total"]
        return out

    def end(self, run, told: dict) -> list[tuple]:
        """A run whose length nobody told ends with its last window."""
        out, total = [], told["until"] if told["total"] is None else told["total"]
        while told["next"] * self.hop_n < total:
            out += self._vote(run, told, min((told["next"] + 1) * self.hop_n, total))
        return out


class _Clips(_InOrder):
    fields, kinds = ("is_hit",), "is_hit boolean"
    columns = tuple(c.split()[0] for c in CLIPS.split(", "))

    def __init__(self, reach_ms: int, idle_ms: int, gap_n: int, window_n: int):
        super().__init__(reach_ms, idle_ms)
        self.gap_n, self.window_n = gap_n, window_n

    def late(self, run, r) -> tuple:
        return (run, int(r.start_n), int(r.end_n), True)

    def begin(self) -> dict:
        return {"start": None, "end": None, "done": 0}

    def end(self, run, told: dict) -> list[tuple]:
        open_ = told["start"] is not None and told["done"] < told["end"]
        out = [(run, max(told["start"], told["end"] - self.window_n), told["end"], False)] if open_ else []
        told["start"] = None
        return out

    def row(self, run, told: dict, h: tuple) -> list[tuple]:
        _, start, end, _, is_hit = h
        if not is_hit:
            return []
        out = []
        if told["start"] is not None and start - told["end"] > self.gap_n:
            out += self.end(run, told)
        if told["start"] is None:
            told["start"] = told["done"] = start
        told["end"] = end
        while told["done"] + self.window_n <= end:
            out.append((run, told["done"], told["done"] + self.window_n, False))
            told["done"] += self.window_n
        return out


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _by_run(sdf: DataFrame, processor: StatefulProcessor, schema: str, columns: list[str], delay: str, reach: str) -> DataFrame:
    behind = f"{_ms(delay) + _ms(reach)} milliseconds"
    return sdf.select("run_id", "event_ts", *columns).withWatermark("event_ts", behind).groupBy("run_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stream_slot_votes(sdf: DataFrame, hop_n: int, delay: str = "10 minutes", reach: str = "1 day", idle: str = "1 hour") -> DataFrame:
    """Slots as soon as they are final: when the watermark has passed a window that starts after the slot's start, or the run ends.

    sdf: run_id STRING, event_ts (of a run, rising with start_n), start_n, end_n, score, is_hit, closes, total_n (on the closing row)."""
    return _by_run(sdf, _Slots(_ms(reach), _ms(idle), hop_n), SLOTS, ["start_n", "end_n", "score", "is_hit", "closes", "total_n"], delay, reach)


def stream_clips(sdf: DataFrame, gap_n: int, window_n: int, delay: str = "10 minutes", reach: str = "1 day", idle: str = "1 hour") -> DataFrame:
    """Clips as soon as the run of hits has grown past their end; the tail when the run of hits breaks, closes or falls idle.

    sdf: run_id STRING, event_ts (of a run, rising with start_n), start_n, end_n, is_hit, closes."""
    return _by_run(sdf, _Clips(_ms(reach), _ms(idle), gap_n, window_n), CLIPS, ["start_n", "end_n", "is_hit", "closes"], delay, reach)


def on_time(out: DataFrame) -> DataFrame:
    """The results, without the late rows."""
    return out.filter("not late").drop("late")


def late_rows(out: DataFrame) -> DataFrame:
    """The rows that came after the watermark, as they were."""
    return out.filter("late").drop("late")


def count_late(out: DataFrame, name: str = "lateness") -> DataFrame:
    """Counts results and late rows of every micro-batch, as observed metrics `results` and `late`."""
    return out.observe(name, F.count_if(~F.col("late")).alias("results"), F.count_if(F.col("late")).alias("late"))


def stream_join_answers(clips: DataFrame, answers: DataFrame, bound: str = "10 minutes") -> DataFrame:
    """Clips with their answers, or pending once the watermark has passed the bound. Both need run_id, clip_idx, event_ts."""
    c = clips.withWatermark("event_ts", bound)
    a = answers.withWatermark("event_ts", bound).select(F.col("run_id").alias("a_run"), F.col("clip_idx").alias("a_clip"), F.col("event_ts").alias("a_ts"), "title")
    near = F.expr(f"run_id = a_run and clip_idx = a_clip and a_ts >= event_ts and a_ts <= event_ts + interval {bound}")
    return c.join(a, near, "left_outer").select("run_id", "clip_idx", "event_ts", "title", F.col("a_run").isNull().alias("pending"))


def stall_watch(sdf: DataFrame, warn_s: int = 12, hard_s: int = 40) -> DataFrame:
    """A warning, then a strong one, when a run's progress (run_id STRING, step) stands still; any event resets."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            phase, level = state.get
            level = "warning" if level == "none" else "strong"
            out.append((key[0], level, phase))
            if level == "strong":
                state.remove()
            else:
                state.update((phase, level))
                state.setTimeoutDuration((hard_s - warn_s) * 1000)
        else:
            last = [b["step"].iloc[-1] for b in batches if len(b)]
            state.update((last[-1] if last else "", "none"))
            state.setTimeoutDuration(warn_s * 1000)
        yield pd.DataFrame(out, columns=["run_id", "level", "phase"])

    return sdf.groupBy("run_id").applyInPandasWithState(run, STALLS, "phase string, level string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_progress(sdf: DataFrame) -> DataFrame:
    """answered, total and found per run, for update mode."""
    return sdf.groupBy("run_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("title").isNotNull()).alias("found"))


#: The steps of a run in order; between the first and the last two, those that a query observes.
STEPS = ("loading", "classifying", "identified", "detecting", "writing", "done")


def observe_step(df: DataFrame, step: str, **counts) -> DataFrame:
    """Marks a place in a streaming plan as a step: its aggregates (Columns by name) are taken for every micro-batch."""
    if step not in STEPS:
        raise ValueError(f"unknown step: {step}")
    return df.observe(step, *(c.alias(n) for n, c in counts.items()))


class StepListener(StreamingQueryListener):
    """Calls progress(step, detail, **fields) for the observed steps of one query, by its name: no call for a row.

    Numbers are summed over the micro-batches. A query that starts is "loading"; one that ends is "writing", then
    "done", or "failed" with the message. Add it by spark.streams.addListener."""

    def __init__(self, name: str, progress: Callable[..., None]):
        self.name, self.progress, self.run = name, progress, None
        self.totals: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run, self.totals = event.runId, {}
            self.progress("loading", detail=f"{event.name} started")

    def onQueryProgress(self, event) -> None:
        if event.progress.runId != self.run:
            return
        seen = event.progress.observedMetrics
        for step in STEPS:
            if step in seen:
                own = self.totals.setdefault(step, {})
                for name, n in seen[step].asDict().items():
                    own[name] = own.get(name, 0) + (n or 0)
                self.progress(step, detail=", ".join(f"{k} {v}" for k, v in own.items()), **own)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId != self.run:
            return
        if event.exception:
            self.progress("failed", detail=event.exception.splitlines()[0])
        else:
            self.progress("writing", detail="")
            self.progress("done", detail="")
