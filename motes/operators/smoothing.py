"""Velocity by smoothing whole trajectories, as grouped-map jobs: a track's rows are in one task, tracks spread over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .grouped import in_groups
from .kinematics import KEY


def _rts(t: np.ndarray, z: np.ndarray, noise: float, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Constant-velocity Kalman filter and backward smoother of one axis: velocity and its standard error."""
    n = len(t)
    x, p = np.zeros((n, 2)), np.zeros((n, 2, 2))
    xp, pp = np.zeros((n, 2)), np.zeros((n, 2, 2))
    step = lambda h: np.array([[1, h], [0, 1.0]])
    m, c = np.array([z[0], (z[1] - z[0]) / (t[1] - t[0]) if n > 1 else 0.0]), np.diag([noise**2, noise**2 + 1.0])
    for k in range(n):
        if k:
            h = t[k] - t[k - 1]
            f = step(h)
            m, c = f @ m, f @ c @ f.T + power * np.array([[h**3 / 3, h * h / 2], [h * h / 2, h]])
        xp[k], pp[k] = m, c
        gain = c[:, 0] / (c[0, 0] + noise**2)
        m = m + gain * (z[k] - m[0])
        c = c - np.outer(gain, c[0])
        x[k], p[k] = m, c
    for k in range(n - 2, -1, -1):
        g = p[k] @ step(t[k + 1] - t[k]).T @ np.linalg.inv(pp[k + 1])
        x[k] = x[k] + g @ (x[k + 1] - xp[k + 1])
        p[k] = p[k] + g @ (p[k + 1] - pp[k + 1]) @ g.T
    return x[:, 1], np.sqrt(np.maximum(p[:, 1, 1], 0))


def kalman_velocity(tracks: DataFrame, noise: float, power: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Smoothed velocity vx, vy with standard errors, uneven times allowed; both axes are independent two-state filters. Rows that repeat a frame are averaged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.dropna(subset=["x", "y"]).groupby(["exp", "particle", "frame"], as_index=False)[["x", "y"]].mean().sort_values("frame")
        if g.empty:
            return pd.DataFrame(columns=["exp", "particle", "frame", "vx", "vy", "vx_error", "vy_error"])
        t = g.frame.to_numpy(float) * dt
        (vx, ex), (vy, ey) = (_rts(t, g[c].to_numpy(float), noise, power) for c in ("x", "y"))
        return g.assign(vx=vx, vy=vy, vx_error=ex, vy_error=ey)[["exp", "particle", "frame", "vx", "vy", "vx_error", "vy_error"]]

    return tracks.select(*KEY, "frame", "x", "y").groupBy(*KEY).applyInPandas(run, "exp string, particle long, frame int, vx double, vy double, vx_error double, vy_error double")


def whittaker(y: np.ndarray, penalty: float | np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Minimum of |y - z|^2 over known places + penalty |second differences of z|^2: a five-diagonal system, eliminated in one sweep.

    y is (n,) or (n, columns) with a penalty, and known places if (n, columns), for each column, all eliminated side by side. Missing places at either end go on straight; fewer than two known places
    leave y as it is.
    """
    n = len(y)
    known = np.ones(n, bool) if known is None else known.astype(bool)
    if n < 3 or known.sum(0).max(initial=0) < 2:
        return y.astype(float)
    shape = y.shape
    known = known.reshape(n, -1)
    z = np.where(known, y.reshape(n, -1), 0.0).astype(float)
    few = known.sum(0) < 2
    if few.any():  # columns without a curve stay, and are not eliminated
        z = np.where(few, y.reshape(n, -1), z)
        known = known | few
    size = np.broadcast_to(np.asarray(penalty, float), z.shape[1:])
    # bands of the penalty: the sums of 1 -2 1 patterns that cover a place, two or three neighbours
    d = np.convolve(np.ones(n - 2), [1, 4, 1])[:, None] * size + known
    e = np.append(np.convolve(np.ones(n - 2), [-2, -2]), 0)[:, None] * size
    f = np.append(np.ones(n - 2), [0, 0])[:, None] * size
    for i in range(n):
        if i + 1 < n:
            r = e[i] / d[i]
            d[i + 1] -= r * e[i]
            z[i + 1] -= r * z[i]
            if i + 2 < n:
                e[i + 1] -= r * f[i]
                r = f[i] / d[i]
                d[i + 2] -= r * f[i]
                z[i + 2] -= r * z[i]
    for i in range(n - 1, -1, -1):
        if i + 2 < n:
            z[i] -= f[i] * z[i + 2]
        if i + 1 < n:
            z[i] -= e[i] * z[i + 1]
        z[i] /= d[i]
    return np.where(few, y.reshape(n, -1), z).reshape(shape)


#: Penalties tried side by side in a round of the search, and rounds; each narrows the range to its neighbours. The range in powers of ten.
TRIED, SEARCHES, RANGE = 24, 4, (-6.0, 12.0)


def smoothed_to(y: np.ndarray, target: float, known: np.ndarray) -> tuple[np.ndarray, float]:
    """The whittaker curve whose sum of squared residuals at known places is the target, and its penalty.

    The residual rises with the penalty up to that of a straight line; where even that is within the target, the line is the curve (penalty inf).
    """
    at = np.flatnonzero(known)
    if len(at) < 3:
        return whittaker(y, 1.0, known), 1.0
    line = np.polyval(np.polyfit(at, y[at], 1), np.arange(len(y)))
    if ((y - line)[at] ** 2).sum() <= target:
        return line, float("inf")
    low, high = RANGE
    for _ in range(SEARCHES):
        tried = np.linspace(low, high, TRIED)
        curves = whittaker(np.repeat(y[:, None], TRIED, 1), 10.0**tried, known)
        over = ((curves - y[:, None])[at] ** 2).sum(0) > target
        i = int(over.argmax()) if over.any() else TRIED - 1
        low, high = tried[max(i - 1, 0)], tried[i]
    penalty = 10.0 ** ((low + high) / 2)
    return whittaker(y, penalty, known), float(penalty)


def smoothed_each(y: np.ndarray, target: np.ndarray, known: np.ndarray) -> np.ndarray:
    """smoothed_to's curve for each column of y (places, columns), with a target and known places for each, all searched side by side. Places after a column's last known one go on straight."""
    n, m = y.shape
    y = np.where(known, y, 0.0)
    count = known.sum(0)
    at = np.arange(n)[:, None]
    # the straight line of least squares
    size = np.maximum(count, 1)
    t0, y0 = (at * known).sum(0) / size, y.sum(0) / size
    spread = (known * (at - t0) ** 2).sum(0)
    slope = (known * (at - t0) * (y - y0)).sum(0) / np.where(spread > 0, spread, 1)
    out = y0 + slope * (at - t0)
    far = (known * (out - y) ** 2).sum(0)
    search = np.flatnonzero((count >= 3) & (far > target))
    if len(search):
        z, k, most = y[:, search], known[:, search], target[search]
        low, high = np.full(len(search), RANGE[0]), np.full(len(search), RANGE[1])
        wide, every = np.repeat(z, TRIED, axis=1), np.repeat(k, TRIED, axis=1)
        for _ in range(SEARCHES):
            tried = low[:, None] + np.arange(TRIED) * ((high - low) / (TRIED - 1))[:, None]
            tried[:, -1] = high
            curves = whittaker(wide, (10.0**tried).ravel(), every)
            over = ((curves - wide) ** 2 * every).sum(0).reshape(-1, TRIED) > most[:, None]
            i = np.where(over.any(1), over.argmax(1), TRIED - 1)
            rows = np.arange(len(search))
            low, high = tried[rows, np.maximum(i - 1, 0)], tried[rows, i]
        out[:, search] = whittaker(z, 10.0 ** ((low + high) / 2), k)
    return out


#: Places times tracks that are smoothed side by side, about (a longer track is smoothed alone).
SIDE = 8192


def spline_velocity(tracks: DataFrame, penalty: float | None = None, dt: float = 1.0, noise: float = 0.05) -> DataFrame:
    """Positions smoothed by penalised second differences, then central differences: x_smooth, y_smooth, vx, vy.

    The penalty of each coordinate of each track is the one that leaves a residual of N noise^2 over its N positions, unless one penalty is given for all.
    Tracks of about one length are smoothed side by side.
    """
    names = ["x_smooth", "y_smooth", "vx", "vy"]

    def run(pdf: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        g = pdf.dropna(subset=["x", "y"]).groupby([*KEY, "frame"], as_index=False)[["x", "y"]].mean()
        starts = np.flatnonzero(np.append(True, (g[KEY].to_numpy()[1:] != g[KEY].to_numpy()[:-1]).any(1))) if len(g) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(g)))
        at = g.frame.to_numpy(int) - np.repeat(g.frame.to_numpy(int)[starts], size)
        places = at[starts + size - 1] + 1
        out = np.full((len(g), 4), np.nan)
        order = np.argsort(places, kind="stable")
        done = 0
        while done < len(order):
            end = done + 1
            while end < len(order) and (end + 1 - done) * places[order[end]] <= SIDE:
                end += 1
            some = order[done:end]
            done, n, m = end, places[some].max(), len(some)
            rows = np.concatenate([np.arange(a, a + k) for a, k in zip(starts[some], size[some])])
            column = np.repeat(np.arange(m), size[some])
            known = np.zeros((n, m), bool)
            known[at[rows], column] = True  # missing frames are free places
            y = np.zeros((n, 2 * m))
            for i, c in enumerate("xy"):
                y[at[rows], i * m + column] = g[c].to_numpy(float)[rows]
            both = np.concatenate([known, known], axis=1)
            count = np.concatenate([size[some], size[some]])
            s = smoothed_each(y, count * noise**2, both) if penalty is None else whittaker(y, penalty, both)
            v = np.full_like(s, np.nan)
            if n > 1:
                v = np.gradient(s, dt, axis=0)
                last = np.tile(places[some] - 1, 2)
                whole = np.arange(2 * m)
                v[last, whole] = np.where(last > 0, (s[last, whole] - s[np.maximum(last - 1, 0), whole]) / dt, np.nan)
            for i in range(2):
                out[rows, i] = s[at[rows], i * m + column]
                out[rows, 2 + i] = v[at[rows], i * m + column]
        return g[[*KEY, "frame"]].assign(**dict(zip(names, out.T)))

    return in_groups(tracks.select(*KEY, "frame", "x", "y"), KEY, "frame", run, "exp string, particle long, frame int, x_smooth double, y_smooth double, vx double, vy double")
