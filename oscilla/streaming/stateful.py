"""Detectors over event time that give what the batch operators give.

Samples (recording_id, ch, label, s, ts, v) may come in any order within the watermark. Each
group holds samples back until the watermark has passed them, feeds them in order of s to a
detector whose state is a few numbers, and closes what is open once nothing has come for
`idle`. Rows later than the watermark are dropped by Spark. States lie in the RocksDB provider:

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.kernels import fir_taps

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Feeds the samples of a group in order to `feed`, and calls `finish` at the end of a recording."""

    columns: list[str] = []  # of the input, kept for each sample
    names: list[str] = []  # of the output

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def feed(self, state: dict, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def finish(self, state: dict) -> list[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "s long, ch int", "ts long, x array<double>")
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for p in rows:
            values = p[self.columns].to_numpy(dtype=float)
            for s, ch, ts, x in zip(p.s.tolist(), p.ch.tolist(), p.ms.tolist(), values.tolist()):
                self.pending.updateValue((s, ch), (ts, x))
                latest = ts if latest is None else max(latest, ts)
        if latest is not None:
            self.handle.registerTimer(latest)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, waiting = [], False
        for (s, ch), (ts, x) in self.pending.iterator():
            if ts <= now:
                ready.append((s, ch, ts, x))
            else:
                waiting = True
        for s, ch, _, _ in ready:
            self.pending.removeKey((s, ch))
        ready.sort()
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = []
        if ready:
            out += self.feed(state, ready)
            state["last"] = max(state.get("last", 0), *(r[2] for r in ready))
        if not waiting and "last" in state and state["last"] + self.idle_ms <= now:
            out += self.finish(state)
            self.state.clear()
        elif state:
            self.state.update((json.dumps(state),))
            self.handle.registerTimer(state["last"] + self.idle_ms)
        yield self.frame(key, out)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.names)

    def close(self) -> None:
        pass


def run(stream: DataFrame, by: list[str], processor: Ordered, schema: str, late: str) -> DataFrame:
    x = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return x.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Suppression(Ordered):
    """Windows of n samples over all channels; short suppressions turn into bursts before neighbours merge."""

    columns = ["v"]
    names = ["recording_id", "type", "start_sample", "end_sample", "duration_ms"]

    def __init__(self, idle_ms: int, n: int, sr: float, threshold: float, min_duration_ms: float):
        super().__init__(idle_ms)
        self.n, self.sr, self.threshold, self.min_ms = n, sr, threshold, min_duration_ms

    def segment(self, kind: str, start: int, stop: int) -> tuple:
        low, high = (start - 1) * self.n + 1, stop * self.n
        return kind, low, high, (high - low + 1) / self.sr * 1000

    def end_run(self, state: dict) -> list[tuple]:
        """The open run of windows has ended: it joins the segment before, or ends that."""
        quiet, start, stop = state.pop("run")
        kind = "suppression" if quiet and (stop - start + 1) * self.n / self.sr * 1000 >= self.min_ms else "burst"
        before = state.get("segment")
        if before and before[0] == kind and before[2] + 1 == start:
            before[2] = stop
            return []
        state["segment"] = [kind, start, stop]
        return [self.segment(*before)] if before else []

    def end_window(self, state: dict) -> list[tuple]:
        at, total, count, _ = state.pop("window")
        quiet, run, out = bool(np.sqrt(total / count) < self.threshold), state.get("run"), []
        if run and run[0] == quiet and run[2] + 1 == at:
            run[2] = at
        else:
            out = self.end_run(state) if run else []
            state["run"] = [quiet, at, at]
        return out

    def feed(self, state: dict, rows: list[tuple]) -> list[tuple]:
        out = []
        for s, _, _, (v,) in rows:
            at = (s - 1) // self.n + 1
            if "window" in state and state["window"][0] != at:
                out += self.end_window(state)
            w = state.setdefault("window", [at, 0.0, 0, 0])
            w[1], w[2], w[3] = w[1] + v * v, w[2] + 1, s
        return out

    def finish(self, state: dict) -> list[tuple]:
        out = []
        if "window" in state and state["window"][3] == state["window"][0] * self.n:  # a short tail is left out
            out += self.end_window(state)
        if "run" in state:
            out += self.end_run(state)
        return out + ([self.segment(*state["segment"])] if "segment" in state else [])


def suppression(stream: DataFrame, sr: float, threshold: float = 10, min_duration_ms: float = 500, window_ms: float = 500, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Segments (recording_id, type, start_sample, end_sample, duration_ms) of a stream of samples, as clinical.suppression gives them."""
    n = max(1, round(window_ms / 1000 * sr))
    schema = "recording_id string, type string, start_sample long, end_sample long, duration_ms double"
    return run(stream, ["recording_id"], Suppression(idle_ms, n, sr, threshold, min_duration_ms), schema, late)


class Spikes(Ordered):
    """Sessions of steep differences; limits come with the samples."""

    columns = ["v", "limit", "ref"]
    names = ["recording_id", "channel", "sample", "time_sec", "amplitude", "duration_ms", "confidence"]

    def __init__(self, idle_ms: int, sr: float, low: int, high: int, min_amplitude: float):
        super().__init__(idle_ms)
        self.sr, self.low, self.high, self.least = sr, low, high, min_amplitude

    def end_session(self, state: dict) -> list[tuple]:
        a, b, ref = state.pop("session")
        n = b - a + 1
        if not self.low <= n <= self.high:
            return []
        around = [(abs(v), -s) for s, v in state["near"] if a - self.low <= s <= b + self.low]
        amplitude, s = max(around)
        if amplitude < self.least:
            return []
        return [(-s, (-s - 1) / self.sr, amplitude, n / self.sr * 1000, min(1.0, amplitude / ref) if ref else 1.0)]

    def feed(self, state: dict, rows: list[tuple]) -> list[tuple]:
        out, near = [], state.setdefault("near", [])
        for s, _, _, (v, limit, ref) in rows:
            if near and near[-1][0] + 1 == s and abs(v - near[-1][1]) > limit:  # the sample before is steep
                at, session = s - 1, state.get("session")
                if session and at - session[1] <= self.high:
                    session[1] = at
                else:
                    out += self.end_session(state) if session else []
                    state["session"] = [at, at, ref]
            near.append([s, v])
            session = state.get("session")
            if session and s - 1 - session[1] > self.high and s >= session[1] + self.low:
                out += self.end_session(state)
            keep = (state["session"][0] if "session" in state else s) - self.low - 1
            while near and near[0][0] < keep:
                near.pop(0)
        return out

    def finish(self, state: dict) -> list[tuple]:
        return self.end_session(state) if "session" in state else []


def spikes(stream: DataFrame, sr: float, min_duration_ms: float = 20, max_duration_ms: float = 200, min_amplitude: float = 50, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Spikes of a stream of samples with their channel's `limit` and `ref`, as clinical.spikes gives them by morphology."""
    low, high = max(1, round(min_duration_ms / 1000 * sr)), round(max_duration_ms / 1000 * sr)
    schema = "recording_id string, channel int, sample long, time_sec double, amplitude double, duration_ms double, confidence double"
    x = stream.withColumn("channel", F.col("ch"))
    return run(x, ["recording_id", "channel"], Spikes(idle_ms, sr, low, high, min_amplitude), schema, late)


class Spindles(Ordered):
    """Band-pass, envelope and runs above a limit, a few samples behind the last one."""

    columns = ["v", "limit"]
    names = ["recording_id", "channel", "start_sample", "end_sample", "duration_ms", "peak_sample", "peak_amplitude", "frequency_hz"]

    def __init__(self, idle_ms: int, sr: float, taps: np.ndarray, half: int, shortest: int, longest: int):
        super().__init__(idle_ms)
        self.sr, self.taps, self.half, self.shortest, self.longest = sr, taps.tolist(), half, shortest, longest

    def end_run(self, state: dict) -> list[tuple]:
        start, stop, peak, at, turns, _ = state.pop("run")
        n = stop - start + 1
        if not self.shortest <= n <= self.longest:
            return []
        ms = n / self.sr * 1000
        return [(start, stop, ms, at, peak, turns / 2 / (ms / 1000))]

    def advance(self, state: dict, last: bool) -> list[tuple]:
        """Filter what has both sides, take the envelope of what has both sides of that, and go on with the run."""
        h, x, y = (len(self.taps) - 1) // 2, state["x"], state["y"]
        first = state["x0"]  # sample number of x[0]
        taps = np.array(self.taps)
        end = first + len(x) - 1
        begin = state["y0"] + len(y)  # the next sample to filter
        until = end if last else end - h
        if until >= begin:
            low, high = begin - h, until + h
            held = np.array([x[min(max(s, first if first == 1 else low), end) - first] for s in range(low, high + 1)])
            y += np.convolve(held, taps, mode="valid").tolist()
        known = state["y0"] + len(y) - 1
        out, s = [], state["next"]
        while s <= (known if last else known - self.half):
            low, high = max(s - self.half, 1), min(s + self.half, known)
            part = np.array(y[low - state["y0"] : high - state["y0"] + 1])
            env, v, run = float(np.sqrt((part**2).mean())), y[s - state["y0"]], state.get("run")
            if env > state["limit"]:
                sign = float(np.sign(v))
                if run:
                    run[1] = s
                    run[4] += sign != run[5]
                    run[5] = sign
                    if env > run[2]:
                        run[2], run[3] = env, s
                else:
                    state["run"] = [s, s, env, s, 0, sign]
            elif run:
                out += self.end_run(state)
            s += 1
        state["next"] = s
        keep = max(0, min(s - self.half, known + 1 - self.half) - state["y0"] - 1)
        state["y"], state["y0"] = y[keep:], state["y0"] + keep
        keep = max(0, state["y0"] + len(state["y"]) - h - first - 1)
        if first + keep > 1 and keep:
            state["x"], state["x0"] = x[keep:], first + keep
        return out

    def feed(self, state: dict, rows: list[tuple]) -> list[tuple]:
        s, _, _, (_, limit) = rows[0]
        if "x" not in state:
            state.update(x=[], x0=s, y=[], y0=s, next=s, limit=limit)
        state["x"] += [x[0] for _, _, _, x in rows]
        return self.advance(state, False)

    def finish(self, state: dict) -> list[tuple]:
        out = self.advance(state, True)
        return out + (self.end_run(state) if "run" in state else [])


def spindles(stream: DataFrame, sr: float, taps: int, freq_range: tuple[float, float] = (11, 16), min_duration_ms: float = 500, max_duration_ms: float = 2000, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Spindles of a gapless stream of samples with their channel's `limit` of the envelope, as sleep.spindles gives them; `taps` of the filter."""
    shortest, longest = max(1, round(min_duration_ms / 1000 * sr)), round(max_duration_ms / 1000 * sr)
    half = max(1, round(0.2 * sr)) // 2
    schema = "recording_id string, channel int, start_sample long, end_sample long, duration_ms double, peak_sample long, peak_amplitude double, frequency_hz double"
    x = stream.withColumn("channel", F.col("ch"))
    return run(x, ["recording_id", "channel"], Spindles(idle_ms, sr, fir_taps("bandpass", sr, *freq_range, taps), half, shortest, longest), schema, late)
