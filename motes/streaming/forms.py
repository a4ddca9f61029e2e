"""Streaming forms of incremental operators. Rows arrive as (exp, particle, frame, x, y, ...); event time is start + frame * dt."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kinematics import KEY


def with_time(rows: DataFrame, dt_seconds: float, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Event time from the frame number: a column time."""
    return rows.withColumn("time", F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.col("frame").cast("long") * int(dt_seconds * 1e6)).cast("long")))


def window_moments(rows: DataFrame, value: str, width: str, late: str = "1 minute") -> DataFrame:
    """Mergeable moments and sign counts per (exp, tumbling window); rows later than the watermark are dropped."""
    v = F.col(value)
    return rows.withWatermark("time", late).groupBy("exp", F.window("time", width)).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("square"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))


def window_statistics(rows: DataFrame, value: str, width: str, low: float, high: float, bins: int, late: str = "1 minute") -> DataFrame:
    """All that the online accumulator keeps, per (exp, tumbling window): n, sum, square, vortex (< 0), strain (> 0), neutral, least, most, and counts, an array over
    equal bins of [low, high], the last closed. Every part is a sum or an extreme, so the state of a window is one row whatever arrives.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    bin_ = F.when(v.between(low, high), F.least(F.floor((v - low) * (bins / (high - low))), F.lit(bins - 1)))
    counts = F.array(*[F.count_if(bin_ == i) for i in range(bins)])
    got = rows.withWatermark("time", late).groupBy("exp", F.window("time", width))
    return got.agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("square"), F.count_if(v < 0).alias("vortex"), F.count_if(v > 0).alias("strain"), F.count_if(v == 0).alias("neutral"), F.min(v).alias("least"), F.max(v).alias("most"), counts.alias("counts"))


def segments(rows: DataFrame, gap: str, late: str = "1 minute") -> DataFrame:
    """Contiguous stretches of each track as session windows with a gap slightly above the frame interval."""
    return rows.withWatermark("time", late).groupBy(*KEY, F.session_window("time", gap)).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def dwell_runs(rows: DataFrame, column: str, enter: float, leave: float, timeout_ms: int | None = None) -> DataFrame:
    """Hysteresis state of each track (1 stopped) and its closed runs as they end: state, first, last, n, censored. A frame gap ends a run as censored, and so does a timeout, if one is set (then the stream plans batches without end, so it suits no drained query).

    Rows of a track must arrive in order of frames between batches; inside a batch they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((held[1], held[2], held[0], held[3], True))
            state.remove()
        else:
            pdf = pd.concat(list(frames)).sort_values("frame")
            for frame, v in zip(pdf.frame, pdf[column], strict=True):
                if v != v:
                    continue
                fresh = held is None or frame != held[0] + 1
                mark = 1 if abs(v) < enter else 0 if v > leave else int(v < (enter + leave) / 2) if fresh else held[1]
                if fresh or mark != held[1]:
                    if held is not None:
                        out.append((held[1], held[2], held[0], held[3], bool(fresh)))
                    held = (int(frame), mark, int(frame), 1)
                else:
                    held = (int(frame), mark, held[2], held[3] + 1)
            if held is not None:
                state.update(held)
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(*key, *r) for r in out], columns=[*KEY, "state", "first", "last", "n", "censored"])

    return rows.groupBy(*KEY).applyInPandasWithState(step, "exp string, particle long, state int, first long, last long, n long, censored boolean", "last long, mark int, first long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def arriving_steps(rows: DataFrame, dt: float = 1.0) -> DataFrame:
    """Speed and turning angle of each arriving row; the state holds the last two points. Both are null across frame gaps."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else []
        pts = [tuple(held[i : i + 3]) for i in range(0, len(held), 3) if held[i] is not None]
        out = []
        pdf = pd.concat(list(frames)).sort_values("frame")
        for frame, x, y in zip(pdf.frame, pdf.x, pdf.y, strict=True):
            v = turn = None
            if pts and frame == pts[-1][0] + 1:
                bx, by = x - pts[-1][1], y - pts[-1][2]
                v = math.hypot(bx, by) / dt
                if len(pts) > 1 and pts[-1][0] == pts[-2][0] + 1:
                    ax, ay = pts[-1][1] - pts[-2][1], pts[-1][2] - pts[-2][2]
                    if ax * ax + ay * ay > 1e-10 and bx * bx + by * by > 1e-10:
                        cross = ax * by - ay * bx
                        turn = math.atan2(cross if cross else 0.0, ax * bx + ay * by)
            out.append((*key, int(frame), v, turn))
            pts = [*pts, (int(frame), float(x), float(y))][-2:]
        flat = [v for p in pts for v in p]
        state.update(tuple(flat + [None] * (6 - len(flat))))
        yield pd.DataFrame(out, columns=[*KEY, "frame", "v", "turn"]).astype({"v": "float64", "turn": "float64"})

    return rows.groupBy(*KEY).applyInPandasWithState(step, "exp string, particle long, frame long, v double, turn double", "f1 long, x1 double, y1 double, f2 long, x2 double, y2 double", "append", GroupStateTimeout.NoTimeout)


def in_order(rows: DataFrame, values: list[str], step: Callable, close: Callable, output: str, late: str, gap_ms: int) -> DataFrame:
    """The rows of each track taken in event time, whatever order they arrive in: a row waits in the track's state until the watermark has passed it.

    step(held, frame, values) gives what is held next (a list of numbers, or None) and rows of output; close(held) gives the rows at a track's end, once the watermark is more
    than gap_ms past its last row; a track that goes on later begins anew. Timers at the first waiting row, or else at that end, wake tracks that get no rows. Rows later than the
    watermark (`late` behind the newest row) are dropped. rows has exp, particle, frame, time and the values; the state of a track is what is held and its waiting rows.
    """
    width = 2 + len(values)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen, flat = state.get if state.exists else (None, None, [])
        waiting = [tuple(flat[i : i + width]) for i in range(0, len(flat), width)]
        if not state.hasTimedOut:
            for pdf in frames:
                waiting += zip(pdf["_ms"].astype(float), pdf["frame"].astype(float), *[pdf[v].astype(float) for v in values], strict=True)
        now, out = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda r: r[:2])
        ready = sum(r[0] < now for r in waiting)
        for at, frame, *given in waiting[:ready]:
            held, done = step(held, int(frame), given)
            out += done
            seen = at
        waiting = waiting[ready:]
        if held is not None and not waiting and seen + gap_ms < now:
            out += close(held)
            held = None
        if held is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((None if held is None else [float(x) for x in held], seen, [x for r in waiting for x in r]))
            state.setTimeoutTimestamp(int(waiting[0][0] if waiting else seen + gap_ms))
        names = [c.split()[0] for c in output.split(", ")]
        yield pd.DataFrame([(*key, *r) for r in out], columns=[*KEY, *names])

    timed = rows.withWatermark("time", late).select(*KEY, "frame", "time", F.unix_millis("time").alias("_ms"), *values)
    return timed.groupBy(*KEY).applyInPandasWithState(run, f"exp string, particle long, {output}", "held array<double>, seen double, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ordered_runs(rows: DataFrame, column: str, enter: float, leave: float, late: str, gap_ms: int) -> DataFrame:
    """O02 for rows in any order: the runs of dwell_runs, and as a track ends its last run, censored."""

    def step(held: list | None, frame: int, given: list[float]) -> tuple[list | None, list[tuple]]:
        v = given[0]
        if v != v:
            return held, []
        fresh = held is None or frame != held[0] + 1
        mark = 1 if abs(v) < enter else 0 if v > leave else int(v < (enter + leave) / 2) if fresh else int(held[1])
        if fresh or mark != held[1]:
            return [frame, mark, frame, 1], [] if held is None else [(*_run(held), fresh)]
        return [frame, mark, held[2], held[3] + 1], []

    return in_order(rows, [column], step, lambda held: [(*_run(held), True)], "state int, first long, last long, n long, censored boolean", late, gap_ms)


def _run(held: list) -> tuple[int, int, int, int]:
    """state, first, last and n of a run held as last, state, first, n."""
    last, mark, first, n = (int(x) for x in held)
    return mark, first, last, n


def ordered_steps(rows: DataFrame, late: str, gap_ms: int, dt: float = 1.0) -> DataFrame:
    """O03 for rows in any order: speed and turning angle of each row, null across frame gaps."""

    def step(held: list | None, frame: int, given: list[float]) -> tuple[list, list[tuple]]:
        x, y = given
        v = turn = None
        bx = by = float("nan")
        if held and frame == held[0] + 1:
            bx, by = x - held[1], y - held[2]
            v = math.hypot(bx, by) / dt
            ax, ay = held[3:]
            if ax * ax + ay * ay > 1e-10 and bx * bx + by * by > 1e-10:
                turn = math.atan2((ax * by - ay * bx) or 0.0, ax * bx + ay * by)
        return [frame, x, y, bx, by], [(frame, v, turn)]

    got = in_order(rows, ["x", "y"], step, lambda held: [], "frame long, v double, turn double", late, gap_ms)
    return got.select(*KEY, "frame", F.nanvl("v", F.lit(None).cast("double")).alias("v"), F.nanvl("turn", F.lit(None).cast("double")).alias("turn"))


def drained(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """All results of a stream over the files there are, as a batch table (for finite inputs): Parquet in a folder, once."""
    path = f"{folder}/{name}"
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
