"""State sequences of trajectories: thresholds, hysteresis, islands, dwell times, transitions, events, and a hidden Markov model by distributed EM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import in_groups
from .kinematics import KEY, segments, track


def islands(df: DataFrame, state: str, keys: list[str] | None = None) -> DataFrame:
    """Runs of equal state along frames: state, first, last, n (rows), next_state, closed_left and closed_right (a run on that side exists)."""
    keys = keys or KEY
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.withColumn("_c", F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("_c").over(w))
    got = rows.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    r = Window.partitionBy(*keys).orderBy("run")
    return got.withColumns({"next_state": F.lead(state).over(r), "closed_left": F.lag("run").over(r).isNotNull(), "closed_right": F.lead("run").over(r).isNotNull()})


def thresholded(speeds: DataFrame, threshold: Column, least: int = 1, drop_edges: bool = True) -> DataFrame:
    """Runs of v >= threshold (run) and below (tumble) inside contiguous stretches with known v; edges are runs without a neighbour on a side."""
    known = segments(speeds.where("v is not null")).withColumn("state", F.when(F.col("v") >= threshold, 1).otherwise(0))
    got = islands(known, "state", [*KEY, "segment"]).where(F.col("n") >= least)
    return got.where("closed_left and closed_right") if drop_edges else got


def by_condition_threshold(speeds: DataFrame, median: bool = False, **options) -> DataFrame:
    """The threshold is the condition's mean or median speed."""
    v = F.percentile("v", 0.5) if median else F.avg("v")
    t = speeds.groupBy("condition").agg(v.alias("_t"))
    return thresholded(speeds.join(t, "condition"), F.col("_t"), **options)


def low_intervals(df: DataFrame, column: str, threshold: float, least: int) -> DataFrame:
    """Stretches with column < threshold that end inside the track and whose last minus first row is at least `least`: first, last, length."""
    rows = df.withColumn("_i", F.row_number().over(track())).withColumn("state", F.coalesce((F.col(column) < threshold).cast("int"), F.lit(0)))
    c = rows.withColumn("_c", F.coalesce((F.col("state") != F.lag("state").over(track())).cast("int"), F.lit(0))).withColumn("run", F.sum("_c").over(track()))
    got = c.groupBy(*KEY, "run").agg(F.first("state").alias("state"), F.min("frame").alias("first"), F.max("frame").alias("last"), (F.max("_i") - F.min("_i")).alias("length"))
    after = F.lead("run").over(Window.partitionBy(*KEY).orderBy("run")).isNotNull()
    return got.withColumn("_ok", after).where((F.col("state") == 1) & F.col("_ok") & (F.col("length") >= least)).drop("_ok", "state", "run")


def hysteresis(df: DataFrame, column: str, enter: float, leave: float) -> DataFrame:
    """1 is stopped: entered at |column| < enter, left at column > leave, else as before; a segment starts stopped iff column < (enter + leave) / 2."""
    seg = segments(df.where(F.col(column).isNotNull()))
    w = Window.partitionBy(*KEY, "segment").orderBy("frame")
    mark = F.when(F.abs(F.col(column)) < enter, 1).when(F.col(column) > leave, 0).when(F.row_number().over(w) == 1, (F.col(column) < (enter + leave) / 2).cast("int"))
    return seg.withColumn("_m", mark).withColumn("state", F.last("_m", True).over(w)).drop("_m")


def dwell_statistics(states: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per state: number of closed runs, their mean length, censored runs, occupancy (share of rows), transitions out, rate per row."""
    runs = islands(states, "state", keys)
    g = runs.groupBy(*group, "state").agg(F.count(F.when(F.col("closed_left") & F.col("closed_right"), 1)).alias("runs"), F.avg(F.when(F.col("closed_left") & F.col("closed_right"), F.col("n"))).alias("mean_length"), F.count(F.when(~(F.col("closed_left") & F.col("closed_right")), 1)).alias("censored"), F.sum("n").alias("rows"), F.count("next_state").alias("transitions"))
    total = F.sum("rows").over(Window.partitionBy(*group)) if group else F.sum("rows").over(Window.partitionBy())
    return g.withColumns({"occupancy": F.col("rows") / total, "rate": F.col("transitions") / F.col("rows")})


def event_average(states: DataFrame, value: str, reach: int, keys: list[str]) -> DataFrame:
    """Mean of value at row offsets -reach..reach around changes of state (kind: 1 stops, 0 starts). One window of neighbours for each event, no join."""
    w = Window.partitionBy(*keys).orderBy("frame")
    around = F.array(*[F.struct(F.lit(k).alias("k"), (F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)).alias("v")) for k in range(-reach, reach + 1)])
    change = F.col("state") != F.lag("state").over(w)
    ev = states.withColumns({"_a": around, "_e": change}).where("_e").select(F.col("state").alias("kind"), F.explode("_a").alias("_p")).where("_p.v is not null")
    return ev.groupBy("kind", F.col("_p.k").alias("offset")).agg(F.avg("_p.v").alias("mean"), F.count("*").alias("n"))


def triggered_sums(states: DataFrame, value: str, reach: int, keys: list[str], unit: list[str], clear: bool = False) -> DataFrame:
    """Sums around changes of state and around their controls: unit, kind, control, offset, s (of the value less its unit's mean), n.

    keys: a contiguous segment; unit: what is resampled, a particle of a movie. kind is the state entered (1 stops, 0 starts). A control (1) of a kind is a
    time of the same unit at which the state that the kind leaves goes on; with clear, only if no change lies within `reach` rows of it, so that
    no control's window overlaps an event. Windows end where the segment does. One window a segment, no join.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    dev = states.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*unit)))
    at = lambda k: F.lead("_d", k).over(w) if k > 0 else F.lag("_d", -k).over(w) if k < 0 else F.col("_d")
    around = F.array(*[F.struct(F.lit(k).alias("k"), at(k).alias("v")) for k in range(-reach, reach + 1)])
    marked = dev.withColumns({"_a": around, "_p": F.lag("state").over(w)})
    if clear:
        change = (F.col("state") != F.col("_p")).cast("int")
        marked = marked.withColumn("_c", F.coalesce(F.max(change).over(w.rowsBetween(-reach, reach)), F.lit(0))).where((F.col("state") != F.col("_p")) | (F.col("_c") == 0))
    rows = marked.where("_p is not null").select(*unit, (1 - F.col("_p")).alias("kind"), (F.col("state") == F.col("_p")).cast("int").alias("control"), F.explode("_a").alias("_e")).where("_e.v is not null")
    return rows.groupBy(*unit, "kind", "control", F.col("_e.k").alias("offset")).agg(F.sum("_e.v").alias("s"), F.count("*").alias("n"))


def triggered_curves(sums: DataFrame, group: list[str]) -> DataFrame:
    """The pooled curves of triggered_sums: kind, offset, event and control means, their difference, and their numbers of rows n and n_control."""
    of = lambda c, k: F.sum(F.when(F.col("control") == k, F.col(c)))
    got = sums.groupBy(*group, "kind", "offset").agg(F.try_divide(of("s", 0), of("n", 0)).alias("event"), F.try_divide(of("s", 1), of("n", 1)).alias("control"), F.coalesce(of("n", 0), F.lit(0)).alias("n"), F.coalesce(of("n", 1), F.lit(0)).alias("n_control"))
    return got.withColumn("difference", F.col("event") - F.col("control"))


def pre_difference(sums: DataFrame, group: list[str], outer: str, inner: str, pre: tuple[int, int] = (-3, -1), n: int = 100, seed: int = 0) -> DataFrame:
    """Mean over the offsets of the pre-window of event less control, with its error and interval when movies (outer), and in them particles (inner), are drawn anew.

    Columns: kind, events (rows at offset 0), difference, se, low, high.
    """
    from .resample import hierarchical_weights, interval

    def effect(df: DataFrame, by: list[str], w: Column) -> DataFrame:
        near = df.where(F.col("offset").between(*pre))
        of = lambda c, k: F.sum(F.when(F.col("control") == k, w * F.col(c)))
        curve = near.groupBy(*by, "kind", "offset").agg((F.try_divide(of("s", 0), of("n", 0)) - F.try_divide(of("s", 1), of("n", 1))).alias("_d"))
        return curve.groupBy(*by, "kind").agg(F.avg("_d").alias("v"))

    events = sums.groupBy(*group, "kind").agg(F.coalesce(F.sum(F.when((F.col("control") == 0) & (F.col("offset") == 0), F.col("n"))), F.lit(0)).alias("events"))
    whole = effect(sums, group, F.lit(1)).withColumnRenamed("v", "difference")
    drawn = sums.join(hierarchical_weights(sums, outer, inner, group, n, seed), [*group, outer, inner])
    spread = interval(effect(drawn, [*group, "b"], F.col("w")), "v", [*group, "kind"])
    return events.join(whole, [*group, "kind"]).join(spread, [*group, "kind"])


def observations(tracks: DataFrame, tau: int, eps: float) -> DataFrame:
    """ln(v + eps) of displacements over exactly tau frames, with contiguous sequences numbered."""
    from .kinematics import frame_displacement

    d = frame_displacement(tracks, [tau]).withColumn("obs", F.log(F.hypot("dx", "dy") / tau + eps))
    return segments(d).select("condition", *KEY, "segment", "frame", "obs")


def transitions(states: DataFrame, steps: list[int], keys: list[str]) -> DataFrame:
    """N-step transition counts and probabilities inside sequences."""
    w = Window.partitionBy(*keys).orderBy("frame")
    nxt = F.array(*[F.struct(F.lit(k).alias("step"), F.lead("state", k).over(w).alias("to")) for k in steps])
    rows = states.withColumn("_n", nxt).select(F.col("state").alias("from"), F.explode("_n").alias("_p")).where("_p.to is not null")
    got = rows.groupBy(F.col("_p.step").alias("step"), "from", F.col("_p.to").alias("to")).agg(F.count("*").alias("n"))
    return got.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("step", "from")))


def triplet_chi2(states: DataFrame, keys: list[str]) -> DataFrame:
    """Chi-square of triplets (a, b, c) against a first-order chain, the number of cells seen, and the degrees of freedom: over all b, (different a - 1) (different c - 1). One row."""
    w = Window.partitionBy(*keys).orderBy("frame")
    t = states.withColumns({"a": F.lag("state").over(w), "c": F.lead("state").over(w)}).where("a is not null and c is not null").groupBy("a", F.col("state").alias("b"), "c").agg(F.count("*").alias("n"))
    e = t.withColumn("_e", F.sum("n").over(Window.partitionBy("a", "b")) * F.sum("n").over(Window.partitionBy("b", "c")) / F.sum("n").over(Window.partitionBy("b")))
    # a cell that was not seen adds its expectation; what is seen of b's table sums to the rows' total
    seen = e.groupBy("b").agg(F.sum((F.col("n") - F.col("_e")) ** 2 / F.col("_e") - F.col("_e")).alias("_x"), F.sum("n").alias("_n"), F.count("*").alias("cells"), ((F.countDistinct("a") - 1) * (F.countDistinct("c") - 1)).alias("freedom"))
    return seen.agg(F.sum(F.col("_x") + F.col("_n")).alias("chi2"), F.sum("cells").alias("cells"), F.sum("freedom").alias("freedom"))


def markov_checks(counts: DataFrame) -> DataFrame:
    """Of transitions() between states 0 and 1, for each step: largest gap between the seen matrix and the power of the one-step matrix, second
    eigenvalue seen and predicted, implied timescale (in steps; null unless 0 < eigenvalue < 0.9999)."""
    m = counts.groupBy("step").agg(F.coalesce(F.max(F.when(F.col("from") < F.col("to"), F.col("p"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("from") > F.col("to"), F.col("p"))), F.lit(0.0)).alias("b"))
    one = m.where("step = 1").select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.lit(1).alias("_one"))
    j = m.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").withColumns({"eigenvalue": 1 - F.col("a") - F.col("b"), "predicted": F.pow(1 - F.col("a1") - F.col("b1"), F.col("step"))})  # one row
    away = lambda x, x1: F.abs(F.col(x) - F.coalesce(F.try_divide(F.col(x1), F.col("a1") + F.col("b1")), F.lit(0.0)) * (1 - F.col("predicted")))
    e = F.col("eigenvalue")
    return j.select("step", F.greatest(away("a", "a1"), away("b", "b1")).alias("gap"), "eigenvalue", "predicted", F.when((e > 0) & (e < 0.9999), -F.col("step") / F.log(F.when((e > 0) & (e < 0.9999), e))).alias("timescale"))


def state_autocorrelation(states: DataFrame, steps: list[int], keys: list[str]) -> DataFrame:
    """Autocorrelation of the state by step inside sequences, about the mean and variance of all rows."""
    w = Window.partitionBy(*keys).orderBy("frame")
    moments = states.agg(F.avg("state").alias("_m"), F.var_pop("state").alias("_v"), F.lit(1).alias("_one"))
    nxt = F.array(*[F.struct(F.lit(k).alias("step"), F.lead("state", k).over(w).alias("to")) for k in steps])
    pairs = states.withColumn("_n", nxt).select("state", F.explode("_n").alias("_p")).where("_p.to is not null")
    s = pairs.groupBy(F.col("_p.step").alias("step")).agg(F.sum(F.col("state") * F.col("_p.to")).alias("_xy"), F.sum(F.col("state") + F.col("_p.to")).alias("_s"), F.count("*").alias("n")).withColumn("_one", F.lit(1))
    j = s.join(F.broadcast(moments), "_one")  # one row
    return j.select("step", "n", F.try_divide(F.col("_xy") - F.col("_m") * F.col("_s") + F.col("n") * F.col("_m") ** 2, F.col("n") * F.col("_v")).alias("correlation"))


def dwell_ks(states: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Per state the distance of closed runs' lengths from the exponential law of their mean, for states with enough runs: distance, mean, n."""
    runs = islands(states, "state", keys).where("closed_left and closed_right")
    c = runs.groupBy("state", "n").agg(F.count("*").alias("_k"))
    w = Window.partitionBy("state")  # one row for each length
    c = c.withColumns({"_n": F.sum("_k").over(w), "_m": F.sum(F.col("n") * F.col("_k")).over(w) / F.sum("_k").over(w), "_up": F.sum("_k").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))})
    law = 1 - F.exp(-F.col("n") / F.col("_m"))
    gap = F.greatest(F.col("_up") / F.col("_n") - law, law - (F.col("_up") - F.col("_k")) / F.col("_n"))
    return c.where(F.col("_n") >= least).groupBy("state").agg(F.max(gap).alias("distance"), F.first("_m").alias("mean"), F.first("_n").alias("n"))


def _without_glitches(s: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Of sequences in a row that begin at starts: their states without short interior runs between equal states."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[starts] = True
    edges = np.append(np.flatnonzero(new), len(s))
    state, size = s[edges[:-1]], np.diff(edges)
    first = np.zeros(len(size) + 2, bool)
    first[np.searchsorted(edges, starts)] = True  # runs that begin a sequence
    inner = ~first[:-2] & ~first[1:-1]
    inner[-1:] = False
    short = inner & (size < least)
    short[1:-1] &= state[:-2] == state[2:]
    firsts = np.append(np.flatnonzero(first), len(size))
    for k in np.unique(np.searchsorted(firsts, np.flatnonzero(short), "right") - 1):
        a, b = firsts[k], firsts[k + 1]
        stack, at = [a], a + 1  # first runs of what is merged so far; the last one is looked at with the run after it
        while at < b:
            if len(stack) > 1 and edges[at] - edges[stack[-1]] < least and state[stack[-2]] == state[at]:
                stack.pop()
            else:
                stack.append(at)
            at += 1
        s[edges[a] : edges[b]] = np.repeat(state[stack], np.diff([*edges[stack], edges[b]]))
    return s


def without_glitches(states: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Interior runs shorter than `least` between equal states take that state, the first of a sequence first, until none is left. One pass over each sequence."""
    rows = states.select(*keys, "frame", "state")
    return in_groups(rows, keys, "frame", lambda pdf, starts: pdf.assign(state=_without_glitches(pdf.state.to_numpy().copy(), starts, least)), rows.schema)


def state_turns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Turns between successive headings: run-run (both 1), any-tumble (one 0), all: mean |turn|, resultant, n."""
    from ..functions.angles import wrap_closed

    w = Window.partitionBy(*keys).orderBy("frame")
    d = df.withColumns({"_t": wrap_closed(F.lead("theta").over(w) - F.col("theta")), "_n": F.lead("state").over(w)}).where("_t is not null")
    kind = F.explode(F.array(F.lit("all"), F.when((F.col("state") == 1) & (F.col("_n") == 1), "run_run").otherwise("any_tumble")))
    return d.withColumn("kind", kind).groupBy("kind").agg(F.avg(F.abs("_t")).alias("mean_turn"), F.hypot(F.avg(F.cos("_t")), F.avg(F.sin("_t"))).alias("resultant"), F.count("*").alias("n"))


#: Frames of a chunk: what one worker holds of a sequence, however long it is. Chunks read side by side.
CHUNK, SIDE = 1024, 256
SEQUENCE = [*KEY, "segment"]


def _side_by_side(arrays: list, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observations, emission densities and a mask of chunks padded to one length: (m, n), (m, n, k), (m, n)."""
    size = np.array([len(x) for x in arrays])
    mask = np.arange(size.max(initial=0)) < size[:, None]
    x = np.zeros(mask.shape)
    x[mask] = np.concatenate(arrays) if len(arrays) else []
    b = np.exp(-0.5 * (x[..., None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
    return x, b, mask


def _products(b: np.ndarray, mask: np.ndarray, a: np.ndarray) -> np.ndarray:
    """diag(b_0) a diag(b_1) ... diag(b_last) of each chunk up to a factor: likelihoods of its rows from the state at its first row to that at its last."""
    out = b[:, 0, :, None] * np.eye(len(a))
    for t in range(1, b.shape[1]):
        step = (out @ a) * b[:, t, None, :]
        out = np.where(mask[:, t, None, None], step / step.max((1, 2), keepdims=True), out)
    return out


def _forward_backward(b: np.ndarray, mask: np.ndarray, a: np.ndarray, enter: np.ndarray, follow: np.ndarray):
    """State probabilities g of every row, forward ones, backward ones and scales. enter: probabilities before each chunk's first row; follow: likelihoods of all after its last row."""
    m, n, _ = b.shape
    alpha, beta, scale = np.zeros_like(b), np.ones_like(b), np.ones((m, n))
    p = enter * b[:, 0]
    for t in range(n):
        p = p if t == 0 else (alpha[:, t - 1] @ a) * b[:, t]
        scale[:, t] = np.where(mask[:, t], p.sum(1), 1.0)
        alpha[:, t] = np.where(mask[:, t, None], p / scale[:, t, None], alpha[:, t - 1])
    beta[:, -1] = follow / (alpha[:, -1] * follow).sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        step = (b[:, t + 1] * beta[:, t + 1]) @ a.T / scale[:, t + 1, None]
        beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
    return alpha * beta, alpha, beta, scale


def chunked(obs: DataFrame, frames: int = CHUNK) -> DataFrame:
    """Sequences in chunks of frames: SEQUENCE, chunk, chunks (of the sequence), begins (the first one), f and x (frames and observations in order)."""
    got = obs.groupBy(*SEQUENCE, F.floor(F.col("frame") / frames).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("frame", "obs"))).alias("s"))
    w = Window.partitionBy(*SEQUENCE)
    got = got.withColumns({"chunks": F.count("*").over(w), "begins": F.col("chunk") == F.min("chunk").over(w)})
    return got.select(*SEQUENCE, "chunk", "chunks", "begins", F.transform("s", lambda v: v["frame"]).alias("f"), F.transform("s", lambda v: v["obs"]).alias("x"))


def _linked(chunks: DataFrame, model: dict, products, scan, schema: str) -> DataFrame:
    """chunks with what each must know of those before and after it. Only chunks of sequences that have several give their matrices (products), which meet by sequence (scan).

    schema: the columns that scan adds; a sequence of one chunk has nulls there.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keys = [*SEQUENCE, "chunk"]

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), SIDE):
                part = pdf.iloc[at : at + SIDE]
                yield part[keys].assign(matrix=[v.ravel() for v in products(list(part.x), model)])

    ids = "exp string, particle long, segment long, chunk long"
    many = chunks.where("chunks > 1")
    matrices = many.select(*keys, "x").mapInPandas(run, f"{ids}, matrix array<double>")
    linked = matrices.groupBy(*SEQUENCE).applyInPandas(lambda pdf: scan(pdf.sort_values("chunk"), model)[[*keys, *names]], f"{ids}, {schema}")
    single = chunks.where("chunks = 1").selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")])
    return single.unionByName(many.join(linked, keys))


def _likely(arrays: list, model: dict) -> np.ndarray:
    _, b, mask = _side_by_side(arrays, model["mean"], model["var"])
    return _products(b, mask, model["a"])


def _likely_scan(pdf: pd.DataFrame, model: dict) -> pd.DataFrame:
    """For the chunks of a sequence: enter, the state probabilities before the first row, and follow, the likelihoods of all later chunks by the state at the next one's first row."""
    a, k = model["a"], len(model["a"])
    steps = [np.reshape(v, (k, k)) for v in pdf.matrix]
    enter, follow = [model["pi"]], [None]
    for s in steps[:-1]:
        q = enter[-1] @ s @ a
        enter.append(q / q.sum())
    after = np.ones(k)
    for s in reversed(steps[1:]):
        w = s @ after
        follow.append(w / w.max())
        after = a @ follow[-1]
    return pdf.assign(enter=enter, follow=follow[::-1])


def _posterior(part: pd.DataFrame, model: dict):
    """Of chunks with enter and follow: observations, mask, g, scales, and expected transitions inside each chunk and on to the next."""
    x, b, mask = _side_by_side(list(part.x), model["mean"], model["var"])
    a, k = model["a"], len(model["a"])
    known = lambda v, other: np.stack([other if r is None else np.asarray(r, float) for r in v]).reshape(-1, k)
    enter, last = known(part.enter, model["pi"]), np.array([r is None for r in part.follow])
    nxt = known(part.follow, np.ones(k))
    g, alpha, beta, scale = _forward_backward(b, mask, a, enter, np.where(last[:, None], 1.0, nxt @ a.T))
    inside = mask[:, 1:, None]
    xi = np.einsum("mti,ij,mtj->ij", alpha[:, :-1] * inside, a, b[:, 1:] * beta[:, 1:] / scale[:, 1:, None]) if b.shape[1] > 1 else np.zeros((k, k))
    cross = alpha[~last, -1][:, :, None] * a * nxt[~last][:, None, :]
    return x, b, mask, g, scale, xi + (cross / cross.sum((1, 2), keepdims=True)).sum(0)


def fit_hmm(obs: DataFrame, states: int = 2, rounds: int = 10, tolerance: float = 1e-4, frames: int = CHUNK) -> dict:
    """Gaussian hidden Markov model. The E-step runs on chunks of sequences in tasks and sums sufficient statistics before one small aggregate; the M-step needs only those.

    Gives pi, a, mean, var (states by rising mean), likelihoods of the rounds, aic and bic. A sequence longer than a chunk is never held whole: products of its chunks'
    matrices carry the state probabilities into each chunk, and the likelihoods of what follows back to it.
    """
    stats = obs.agg(F.avg("obs"), F.var_pop("obs"), F.count("*"), F.percentile_approx("obs", F.array(*[F.lit((i + 0.5) / states) for i in range(states)]))).first()
    from ..sources.io import stashed

    chunks = stashed(chunked(obs, frames), "sequences")
    m = {"pi": np.full(states, 1 / states), "a": np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1)), "mean": np.array(stats[3], float), "var": np.full(states, stats[1])}
    size = 1 + states * 4 + states * states
    seen: list[float] = []
    for _ in range(rounds):

        def estep(batches, m=m):
            total = np.zeros(size)
            for pdf in batches:
                for at in range(0, len(pdf), SIDE):
                    part = pdf.iloc[at : at + SIDE]
                    x, _, mask, g, scale, xi = _posterior(part, m)
                    g, first = g * mask[..., None], part.begins.to_numpy(bool)
                    sums = [g[first, 0].sum(0), g.sum((0, 1)), (g * x[..., None]).sum((0, 1)), (g * x[..., None] ** 2).sum((0, 1))]
                    total += np.concatenate([[np.log(scale).sum()], *sums, xi.ravel()])
            yield pd.DataFrame({"i": np.arange(size), "v": total})

        linked = _linked(chunks, m, _likely, _likely_scan, "enter array<double>, follow array<double>")
        linked = linked.select("x", "begins", "enter", "follow")
        got = np.zeros(size)
        for r in linked.mapInPandas(estep, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r.i] = r.v
        seen.append(got[0])
        first, n, s1, s2 = (got[1 + states * k : 1 + states * (k + 1)] for k in range(4))
        xi = got[1 + 4 * states :].reshape(states, states)
        m = {"pi": first / first.sum(), "a": xi / xi.sum(1, keepdims=True), "mean": s1 / n, "var": np.maximum(s2 / n - (s1 / n) ** 2, 1e-6)}
        if len(seen) > 1 and seen[-1] - seen[-2] < tolerance * abs(seen[-2]):
            break
    order = np.argsort(m["mean"])
    free = states * states - 1 + 2 * states
    return {"pi": m["pi"][order], "a": m["a"][np.ix_(order, order)], "mean": m["mean"][order], "var": m["var"][order], "likelihoods": seen, "aic": 2 * free - 2 * seen[-1], "bic": free * float(np.log(stats[2])) - 2 * seen[-1]}


def _logs(model: dict) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(model["pi"]), np.log(model["a"])


def _best(arrays: list, model: dict) -> np.ndarray:
    """Of each chunk, the likelihood products beside the log weights of the best paths from the state at its first row to that at its last."""
    _, b, mask = _side_by_side(arrays, model["mean"], model["var"])
    _, la = _logs(model)
    lb = np.log(b)
    best = np.where(np.eye(len(la), dtype=bool), lb[:, 0, :, None], -np.inf)
    for t in range(1, b.shape[1]):
        best = np.where(mask[:, t, None, None], (best[:, :, :, None] + la).max(2) + lb[:, t, None, :], best)
    return np.stack([_products(b, mask, model["a"]), best], axis=1)


def _best_scan(pdf: pd.DataFrame, model: dict) -> pd.DataFrame:
    """Besides enter and follow: reach, the best log weights by the state at a chunk's first row, and goal, the best path's state at its last row."""
    k = len(model["a"])
    both = [np.reshape(v, (2, k, k)) for v in pdf.matrix]
    lp, la = _logs(model)
    reach, ends = [lp], []
    for _, v in both:
        ends.append((reach[-1][:, None] + v).max(0))
        reach.append((ends[-1][:, None] + la).max(0))
    goal = [int(ends[-1].argmax())]
    for c in range(len(both) - 1, 0, -1):
        begin = int((reach[c] + both[c][1][:, goal[-1]]).argmax())
        goal.append(int((ends[c - 1] + la[:, begin]).argmax()))
    return _likely_scan(pdf.assign(matrix=[v[0].ravel() for v in both]), model).assign(reach=reach[:-1], goal=goal[::-1])


def decode(obs: DataFrame, model: dict, frames: int = CHUNK) -> DataFrame:
    """Most likely state path of every sequence, and each row's posterior of its state. Sequences longer than a chunk are joined as in fit_hmm, paths by the best weights through each chunk."""
    lp, la = _logs(model)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SIDE):
                part = pdf.iloc[at : at + SIDE]
                _, b, mask, g, _, _ = _posterior(part, model)
                lb, (m, n, _) = np.log(b), b.shape
                d = np.stack([lp if r is None else np.asarray(r, float) for r in part.reach]) + lb[:, 0]
                back = np.zeros(b.shape, np.int8)
                for t in range(1, n):
                    s = d[:, :, None] + la
                    back[:, t] = s.argmax(1)
                    d = np.where(mask[:, t, None], s.max(1) + lb[:, t], d)
                path, rows = np.zeros((m, n), np.int64), np.arange(m)
                state = np.where(part.goal.isna(), d.argmax(1), part.goal.fillna(0)).astype(int)
                for t in range(n - 1, -1, -1):
                    path[:, t] = state
                    if t:
                        state = np.where(mask[:, t], back[rows, t, state], state)
                size = mask.sum(1)
                out = part[SEQUENCE].loc[part.index.repeat(size)].reset_index(drop=True)
                yield out.assign(frame=np.concatenate(list(part.f)), obs=np.concatenate(list(part.x)), state=path[mask], posterior=np.take_along_axis(g, path[..., None], 2)[..., 0][mask])

    chunks = chunked(obs, frames)
    linked = _linked(chunks, model, _best, _best_scan, "enter array<double>, follow array<double>, reach array<double>, goal long")
    paths = linked.select(*SEQUENCE, "f", "x", "enter", "follow", "reach", "goal").mapInPandas(run, "exp string, particle long, segment long, frame int, obs double, state int, posterior double")
    # a sequence has one condition
    return paths.join(obs.select("condition", *SEQUENCE, "frame"), [*SEQUENCE, "frame"]).select("condition", *SEQUENCE, "frame", "obs", "state", "posterior")
