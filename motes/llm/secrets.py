"""Secrets in texts: fixed patterns, and a character convolutional network over further candidates.

The patterns give the base spans. The network reads each candidate, a token of 8 or more characters, in windows of BODY characters
with 16 characters of context on either side; a longer candidate has windows all along, and its largest score counts. It is trained (fit) on
all windows of all documents, those of base spans (each different one once) against those of tokens that are no findings, with digits or without; each of the three weighs
a third. Windows are written once, dealt by hash into SHARES shares; a round adds up the gradient of a share's windows in tasks and makes one step of Adam, and ROUNDS
rounds visit every window, those of few windows several times. Findings are also shown with other tokens' contexts and with their letters and
digits drawn anew and cut, so that the network learns what a secret looks like and not only which keyword the patterns know. A fifth of the
findings and of the other windows calibrates the scores (Platt), another fifth of the findings sets the threshold, the highest (in steps of 1/BINS) that keeps RECALL of
them; the rest trains; windows of one finding stay together. The weights are a fixed number of floats, so they are sent with the tasks.
train and labelled are the same on one machine, for tables of few windows; no query uses them.

Defined results: null counts as the empty text, with no spans; offsets are code points; base spans always stay, and the network
adds spans (kind cnn) that overlap none of them; with fewer than 8 distinct findings in the table nothing is added; rows that repeat a doc_id are scanned each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix, stash, units, written

KINDS = ("assign", "access", "hex", "cnn")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these, in either case, is in every text that ASSIGN matches.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Least length of a candidate, as in CANDIDATE.
SHORTEST = 8
TRAIN_EACH = 4000
RECALL = 0.98
LEFT, BODY, RIGHT, STEP = 16, 32, 16, 8
FILTERS, WIDTH, CLASSES = 16, 5, 12
#: Of findings drawn anew: numbers of signs in the classes digit, a-f, other small, A-F, other capital letter; least length. Rows that training visits in all.
ALPHABETS = np.array([[10, 6, 20, 6, 20], [10, 6, 0, 0, 0], [10, 0, 0, 6, 20], [10, 6, 20, 0, 0]], float)
LEAST, VISITS = 12, 80_000
#: Least number of findings drawn anew, so that few findings give steady thresholds too.
SHOWN = 300
#: Characters of a window that the filters reach; two are packed in a byte.
USED = LEFT + BODY + WIDTH - 1
#: Shares of the windows (a power of two), rounds of training, rows that a share should have at least, first rate of Adam.
SHARES, ROUNDS, SHARE_ROWS, RATE = 64, 64, 1000, 0.05
#: Other windows kept with each finding, for their contexts; bins a unit of the network's output; gradients are added up as multiples of 1/EXACT, so that their order does not matter.
DONORS, BINS, EXACT = 4, 1024, 1 << 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in WORDS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)]  # a run of the class ends only where the class does
    return sorted(out)


def _class_table() -> np.ndarray:
    """Character class by code point below 256; others count as letters of other scripts."""
    t = np.full(257, 10, np.int64)
    for i in range(256):
        c = chr(i)
        t[i] = 0 if c in "0123456789" else 1 if c in "abcdef" else 2 if c in "ghijklmnopqrstuvwxyz" else 3 if c in "ABCDEF" else 4 if "A" <= c <= "Z" else 5 if c in " \t\n" else 6 if c in ":=" else 7 if c in "\"'" else 8 if c in "+/_-" else 9 if c in ".,;!?" else 10
    return t


TABLE = _class_table()


def encode(texts: list[str], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each character in the windows along (text index, start, end), by rows; 11 is outside. Second, the index of each row's span.

    Windows begin every STEP characters, and the last one ends where its span does.
    """
    gap = "\0" * LEFT
    joined = gap + gap.join(texts) + "\0" * (BODY + RIGHT)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = np.where(points == 0, 11, TABLE[np.minimum(points, 256)]).astype(np.uint8)
    first = LEFT + np.concatenate(([0], np.cumsum([len(t) + LEFT for t in texts])))
    who, start, end = np.array(spans, np.int64).reshape(-1, 3).T
    base = first[who]
    n = 1 + np.maximum(0, -(-(end - start - BODY) // STEP))
    of = np.repeat(np.arange(len(n)), n)
    step = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    s = base[of] + np.maximum(start[of], np.minimum(start[of] + step, end[of] - BODY))
    e = np.minimum(base[of] + end[of], s + BODY)
    body = s[:, None] + np.arange(BODY)
    parts = [cls[s[:, None] + np.arange(-LEFT, 0)], np.where(body < e[:, None], cls[body], 11), cls[e[:, None] + np.arange(RIGHT)]]
    return np.concatenate(parts, axis=1).astype(np.uint8), of


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens, without what base spans cover; what is left of a token on either side is a candidate if it is as long as a token must be."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not spans:
        return found
    merged: list[list[int]] = []
    for s, _, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    ends = [e for _, e in merged]
    out = []
    for start, end in found:
        at = bisect_right(ends, start)
        while at < len(merged) and merged[at][0] < end:
            if merged[at][0] - start >= SHORTEST:
                out.append((start, merged[at][0]))
            start = merged[at][1]
            at += 1
        if end - start >= SHORTEST:
            out.append((start, end))
    return out


def _features(x: np.ndarray) -> np.ndarray:
    """One-hot windows, unrolled: (n, positions, WIDTH * CLASSES)."""
    hot = np.eye(CLASSES, dtype=np.float32)[x]
    n = x.shape[1] - WIDTH + 1
    return np.concatenate([hot[:, i : i + n] for i in range(WIDTH)], axis=2)


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    # a filter's value depends on WIDTH classes only: the first three and the last two positions are looked up together
    k = model["k"].reshape(WIDTH, CLASSES, FILTERS)
    three = (k[0][:, None, None] + k[1][None, :, None] + k[2][None, None] + model["b"]).reshape(-1, FILTERS).astype(np.float32)
    two = (k[3][:, None] + k[4][None]).reshape(-1, FILTERS).astype(np.float32)
    every = np.maximum(three[:, None] + two[None], 0).reshape(-1, FILTERS)
    out, n = [], LEFT + BODY
    for i in range(0, len(x), 512):
        u = x[i : i + 512].astype(np.int32)
        at = u[:, :n]
        for j in range(1, WIDTH):
            at = at * CLASSES + u[:, j : j + n]
        h = every[at.T]  # positions first: pooling runs over whole rows
        third = [h[:LEFT].max(0), h[LEFT:].mean(0), h[LEFT:].max(0)]
        out.append(np.concatenate(third, axis=1) @ model["w"] + model["c"])
    z = np.concatenate(out) if out else np.zeros(0, np.float32)
    return 1 / (1 + np.exp(-(model["p1"] * z + model["p0"])))


def shown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels, findings also with contexts of other tokens, with letters and digits drawn anew (each so many times; if None, as SHOWN asks), and with both."""
    found, other = x[y == 1], x[y == 0]
    body = slice(LEFT, LEFT + BODY)

    def moved(w: np.ndarray) -> np.ndarray:
        out = other[rng.integers(0, len(other), len(w))].copy()
        out[:, body] = w[:, body]
        return out

    drawn = np.repeat(found, times or max(1, -(-SHOWN // max(1, len(found)))), axis=0)
    for row in drawn[:, body]:
        free = np.flatnonzero(row <= 4)  # digits and letters
        weights = ALPHABETS[rng.integers(len(ALPHABETS))]
        row[free] = rng.choice(5, len(free), p=weights / weights.sum())
        size = int((row != 11).sum())
        row[rng.integers(min(LEAST, size), size + 1) :] = 11
    every = [x, moved(found), drawn, moved(drawn)]
    return np.concatenate(every), np.concatenate([y, np.ones(len(found) + 2 * len(drawn), y.dtype)])


def parts(y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A number from 0 to 4 for each window, dealt in turn; all windows of one finding have the same."""
    out = np.zeros(len(y), np.int64)
    out[y == 0] = np.arange((y == 0).sum()) % 5
    _, first, which = np.unique(own[y == 1], return_index=True, return_inverse=True)
    out[y == 1] = (np.argsort(np.argsort(first)) % 5)[which]
    return out


def train(x: np.ndarray, y: np.ndarray, own: np.ndarray, visits: int = VISITS, rate: float = 0.02) -> dict | None:
    """Convolution, pooling over context and body, a linear layer; Adam on the log loss; Platt scaling and threshold on findings of their own (own: a hash of each window's token)."""
    if len(set(own[y == 1].tolist())) < 8 or (1 - y).sum() < 8:
        return None
    rng = np.random.default_rng(7)
    part = parts(y, own)
    (xs, ys), (xc, yc), (xt, yt) = (shown(x[at], y[at], rng) for at in (part < 3, part == 3, part == 4))
    m = {"k": rng.normal(0, 0.2, (WIDTH * CLASSES, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    hot, ys, step = _features(xs), ys.astype(np.float32), 0
    for _ in range(max(4, visits // len(ys))):
        for at in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 128)):
            u = hot[at]
            h = np.maximum(u @ m["k"] + m["b"], 0)
            ctx, body = h[:, :LEFT], h[:, LEFT : LEFT + BODY]
            f = np.concatenate([ctx.max(1), body.mean(1), body.max(1)], axis=1)
            d = (1 / (1 + np.exp(-(f @ m["w"] + m["c"]))) - ys[at]) / len(at)
            g = {"w": f.T @ d, "c": d.sum(keepdims=True)}
            df = d[:, None] * m["w"]
            dh = np.zeros_like(h)
            rows = np.arange(len(at))[:, None]
            cols = np.arange(FILTERS)[None]
            dh[rows, ctx.argmax(1), cols] += df[:, :FILTERS]
            dh[:, LEFT : LEFT + BODY] += df[:, None, FILTERS : 2 * FILTERS] / body.shape[1]
            dh[rows, LEFT + body.argmax(1), cols] += df[:, 2 * FILTERS :]
            dh *= h > 0
            g["k"] = np.tensordot(u, dh, ((0, 1), (0, 1)))
            g["b"] = dh.sum((0, 1))
            step += 1
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m |= {"p0": 0.0, "p1": 1.0}
    p = np.clip(scores(m, xc), 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.05 * (((q - yc) * z).mean() + 0.01 * (a - 1)), b - 0.05 * (q - yc).mean()
    m |= {"p0": b, "p1": a}
    own = np.sort(scores(m, xt)[yt == 1])
    m["threshold"] = float(own[int((1 - RECALL) * len(own))]) if len(own) else 1.0
    return m


def strata(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for findings, 2 for other windows with digits in the token, 0 for those without."""
    return np.where(y == 1, 1, 2 * (x[:, LEFT : LEFT + BODY] == 0).any(axis=1)).astype(np.int32)


def keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    key = np.zeros(len(x), np.uint64)
    for part in np.ascontiguousarray(x).view(np.uint64).reshape(len(x), -1).T:
        key = mix(key * np.uint64(31) + part)
    return key


def unit_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All windows of findings and candidates, their strata and hashes of their tokens; None if there are none."""
    rows, y = [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        rows += [(i, ASSIGN.match(text, s).start(2) if k == 0 else s, e) for s, k, e in spans]
        y += [1] * len(spans)
        more = candidates(text, spans)
        rows += [(i, s, e) for s, e in more]
        y += [0] * len(more)
    if not rows:
        return None
    x, of = encode(texts, rows)
    tokens = np.array([zlib.crc32(texts[i][s:e].encode("utf-8", "surrogatepass")) for i, s, e in rows], np.int64)
    return x, strata(x, np.array(y, np.int32)[of]), tokens[of]


def _first(x: np.ndarray, y: np.ndarray, own: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first `each` distinct windows of every stratum by their hash, with strata, hashes of their tokens and their own."""
    key = keys(x)
    at = []
    for stratum in (1, 0, 2):
        of = np.flatnonzero(y == stratum)
        at.append(of[np.unique(key[of], return_index=True)[1][:each]])
    at = np.concatenate(at)
    return x[at], y[at], own[at], key[at]


def labelled(docs: DataFrame, each: int = TRAIN_EACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and hashes of their tokens: of every stratum the first `each` distinct windows of all documents, by hash order."""

    def run(batches):
        kept = np.zeros((0, LEFT + BODY + RIGHT), np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for unit in units(batches, 1_000_000):
            found = unit_windows([t or "" for t in unit["text"]])
            # what is not among a task's first is not among the table's
            if found:
                *kept, key = _first(*(np.concatenate(v) for v in zip(kept, found, strict=True)), each)
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in kept[0]], pa.binary()), pa.array(kept[1]), pa.array(kept[2]), pa.array((key ^ np.uint64(1 << 63)).view(np.int64))], names=["x", "y", "own", "key"])

    found = stash(docs.where("text is not null").select("text").mapInArrow(run, "x binary, y int, own long, key long"), "secret-windows").groupBy("x", "y").agg(F.min("own").alias("own"), F.min("key").alias("key"))
    rows = [r for y in (1, 0, 2) for r in found.where(F.col("y") == y).orderBy("key").limit(each).collect()]
    rows.sort(key=lambda r: (r.key, r.y))
    x = np.array([np.frombuffer(bytes(r.x), np.uint8) for r in rows], np.int64).reshape(len(rows), LEFT + BODY + RIGHT)
    return x, np.array([int(r.y == 1) for r in rows], np.int32), np.array([r.own for r in rows], np.int64)


def pack(x: np.ndarray) -> np.ndarray:
    return x[:, 0:USED:2] | x[:, 1:USED:2] << 4


def unpack(data: bytes) -> np.ndarray:
    two = np.frombuffer(data, np.uint8).reshape(-1, USED // 2)
    out = np.empty((len(two), USED), np.uint8)
    out[:, ::2], out[:, 1::2] = two & 15, two >> 4
    return out


def all_windows(docs: DataFrame) -> DataFrame:
    """Every window of all documents, packed: a row for each finding's (own, key, x, and others' windows o), and a row for many of the others (stratum y, share; share SHARES calibrates)."""

    def run(batches):
        for unit in units(batches, 1_000_000):
            found = unit_windows([t or "" for t in unit["text"]])
            if not found:
                continue
            x, y, own = found
            key, x = keys(x), pack(x)
            signed = (key ^ np.uint64(1 << 63)).view(np.int64)
            other = np.flatnonzero(y != 1)
            rows = []
            for i in np.flatnonzero(y == 1).tolist():
                near = x[other[np.random.default_rng(int(key[i])).integers(0, len(other), DONORS)]].tobytes() if len(other) else b""
                rows.append((1, 0, 1, int(own[i]), int(signed[i]), x[i].tobytes(), near))
            share = np.where(key // np.uint64(SHARES) % np.uint64(5) == 3, SHARES, key % np.uint64(SHARES)).astype(np.int64)
            for stratum in (0, 2):
                at = np.flatnonzero(y == stratum)
                at = at[np.argsort(share[at], kind="stable")]
                ends = np.cumsum(np.bincount(share[at], minlength=SHARES + 1))
                for q, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if a < b:
                        rows.append((stratum, q, int(b - a), None, None, x[at[a:b]].tobytes(), None))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["y", "share", "n", "own", "key", "x", "o"])

    made = docs.where("text is not null").select("text").mapInArrow(run, "y int, share int, n long, own long, key long, x binary, o binary")
    # in order of strata and shares and in pages of few rows, so that a round reads little but its own
    return stash(made.sortWithinPartitions("y", "share"), "secret-windows", {"parquet.page.row.count.limit": 100})


def dealt(found: DataFrame) -> DataFrame:
    """found with part, 0 to 4: findings are dealt in turn by their hashes, and all windows of one finding have the same."""
    owns = found.select("own").distinct().withColumn("bucket", F.col("own") % 256)
    n = np.zeros(256, np.int64)
    for r in owns.groupBy("bucket").count().collect():
        n[r["bucket"]] = r["count"]
    before = F.array(*[F.lit(int(v)) for v in np.cumsum(n) - n])
    at = F.element_at(before, (F.col("bucket") + 1).cast("int")) + F.row_number().over(Window.partitionBy("bucket").orderBy("own")) - 1
    return found.join(owns.select("own", (at % 5).cast("int").alias("part")), "own")


def shown_findings(found: DataFrame, times: int) -> DataFrame:
    """A row for each finding's window with all forms in which it is shown: share (SHARES calibrates, SHARES + 1 sets the threshold), number n, windows x."""

    def run(batches):
        for batch in batches:
            v, rows = batch.to_pydict(), []
            for part, key, x, o in zip(v["part"], v["key"], v["x"], v["o"], strict=True):
                own, other = unpack(x), unpack(o or x)
                every = shown(np.concatenate([other, own]), np.array([0] * len(other) + [1]), np.random.default_rng(key & (1 << 64) - 1), times)[0][len(other) :]
                rows.append((1, key % SHARES if part < 3 else SHARES + part - 3, len(every), pack(every).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["y", "share", "n", "x"])

    return stash(found.select("part", "key", "x", "o").mapInArrow(run, "y int, share int, n long, x binary"), "secret-findings")


def outputs(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The network's outputs before calibration, what is pooled, and the filters' values (positions first)."""
    k = model["k"].reshape(WIDTH, CLASSES, FILTERS)
    three = (k[0][:, None, None] + k[1][None, :, None] + k[2][None, None] + model["b"]).reshape(-1, FILTERS)
    two = (k[3][:, None] + k[4][None]).reshape(-1, FILTERS)
    u, n = x.T.astype(np.int32), LEFT + BODY
    h = three[(u[:n] * CLASSES + u[1 : n + 1]) * CLASSES + u[2 : n + 2]]
    h += two[u[3 : n + 3] * CLASSES + u[4 : n + 4]]
    np.maximum(h, 0, out=h)
    pooled = np.concatenate([h[:LEFT].max(0), h[LEFT:].mean(0), h[LEFT:].max(0)], axis=1)
    return pooled @ model["w"] + model["c"], pooled, h


def gradient(model: dict, x: np.ndarray, y: int) -> np.ndarray:
    """Sum over windows of one label (1 or not) of the squared hinge's gradient, as one vector (k, b, w, c). Windows beyond the margin have none, so only the others go back."""
    total = np.zeros(WIDTH * CLASSES * FILTERS + 4 * FILTERS + 1)
    sign = 1 if y == 1 else -1
    for i in range(0, len(x), 512):
        u = x[i : i + 512]
        z, pooled, h = outputs(model, u)
        on = np.flatnonzero(sign * z < 1)
        if not len(on):
            continue
        d = (2 * (z[on] - sign)).astype(np.float32)
        df, h, n = d[:, None] * model["w"], h[:, on], LEFT + BODY
        dh = np.zeros_like(h)
        dh[LEFT:] = df[:, FILTERS : 2 * FILTERS] / BODY
        rows, cols = np.arange(len(on))[:, None], np.arange(FILTERS)[None]
        dh[h[:LEFT].argmax(0), rows, cols] += df[:, :FILTERS]
        dh[LEFT + h[LEFT:].argmax(0), rows, cols] += df[:, 2 * FILTERS :]
        dh = (dh * (h > 0)).reshape(-1, FILTERS)
        hot = np.eye(CLASSES, dtype=np.float32)[u[on].T]
        dk = [hot[j : n + j].reshape(-1, CLASSES).T @ dh for j in range(WIDTH)]
        total += np.concatenate([np.concatenate(dk).ravel(), dh.sum(0), pooled[on].T @ d, d.sum(keepdims=True)])
    return total


def share_gradient(rows: DataFrame, model: dict, weights: dict[int, float]) -> np.ndarray:
    """Weighted sum of the gradients of all windows of rows(y, x)."""

    def run(batches):
        total = np.zeros(sum(v.size for v in model.values()), np.int64)
        for batch in batches:
            for y, x in zip(batch.column("y").to_pylist(), batch.column("x"), strict=True):
                total += np.rint(weights[y] * EXACT * gradient(model, unpack(x.as_py()), y)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    # 8 KB a task
    return sum(np.frombuffer(bytes(r.g), np.int64) for r in rows.select("y", "x").mapInArrow(run, "g binary").collect()) / EXACT


def held_out(rows: DataFrame, model: dict) -> list:
    """Rows (y, share, bin, n): numbers of windows by the network's output, in bins of 1/BINS."""

    def run(batches):
        for batch in batches:
            for y, share, x in zip(batch.column("y").to_pylist(), batch.column("share").to_pylist(), batch.column("x"), strict=True):
                x = unpack(x.as_py())
                z = np.concatenate([outputs(model, x[i : i + 512])[0] for i in range(0, len(x), 512)])
                at, n = np.unique(np.floor(np.clip(z, -32, 32) * BINS).astype(np.int32), return_counts=True)
                one = np.ones(len(at), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(y * one), pa.array(share * one), pa.array(at), pa.array(n.astype(np.int64))], names=["y", "share", "bin", "n"])

    return rows.select("y", "share", "x").mapInArrow(run, "y int, share int, bin int, n long").groupBy("y", "share", "bin").agg(F.sum("n").alias("n")).collect()


def calibrated(model: dict, held: list) -> dict:
    """The model with Platt's two numbers (each stratum weighs the same) and the threshold that keeps RECALL of its own findings."""
    by: dict[int, int] = {}
    for r in held:
        if r.share == SHARES:
            by[r.y] = by.get(r.y, 0) + r.n
    at = [r for r in held if r.share == SHARES]
    z, y = np.array([(r.bin + 0.5) / BINS for r in at]), np.array([float(r.y == 1) for r in at])
    n = np.array([r.n / by[r.y] / len(by) for r in at])
    one, p = np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p @ one, -50, 50)))
        slope = one @ (n * (q - y)) + 0.01 * (p - [1, 0])
        p = p - np.clip(np.linalg.solve((one * (n * q * (1 - q))) @ one.T + 0.01 * np.eye(2), slope), -1, 1)
    model = model | {"p1": float(p[0]), "p0": float(p[1])}
    own = sorted((r.bin, r.n) for r in held if r.share == SHARES + 1)
    left = int((1 - RECALL) * sum(n for _, n in own))
    for at, n in own:
        left -= n
        if left < 0:
            return model | {"threshold": float(1 / (1 + np.exp(-(p[0] * at / BINS + p[1]))))}
    return model | {"threshold": 1.0}


def fit(docs: DataFrame) -> dict | None:
    """The network, calibrated and with its threshold, from all windows of docs(text); None with fewer than 8 different findings or 8 other windows."""
    with written() as notes:
        every = all_windows(docs)
        found = every.where("y = 1").groupBy("x", "own", "key").agg(F.min("o").alias("o"))
        found = stash(found, "secret-found")
        at = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("own").alias("owns")).first()
        counts = {(r.y, r.share): r.n for r in every.where("y <> 1").groupBy("y", "share").agg(F.sum("n").alias("n")).collect()}
        model = None
        if at.owns >= 8 and sum(counts.values()) >= 8:
            found = shown_findings(dealt(found), max(1, -(-SHOWN // at.n)))
            counts |= {(r.y, r.share): r.n for r in found.groupBy("y", "share").agg(F.sum("n").alias("n")).collect()}
            model = _fit(every.where("y <> 1").select("y", "share", "x").unionByName(found.select("y", "share", "x")), counts)
    discard(docs.sparkSession, notes)
    return model


def _fit(rows: DataFrame, counts: dict[tuple[int, int], int]) -> dict:
    """Training, calibration and threshold over rows(y, share, x); counts are the windows of each stratum and share."""
    strata_n = {s: sum(n for (y, q), n in counts.items() if y == s and q < SHARES) for s in (0, 1, 2)}
    strata_n = {s: n for s, n in strata_n.items() if n}
    # a stratum of few windows has fewer shares, which are visited more often
    cut = {s: 1 << min(SHARES.bit_length() - 1, max(0, (n // SHARE_ROWS).bit_length() - 1)) for s, n in strata_n.items()}
    rng = np.random.default_rng(7)
    m = {"k": rng.normal(0, 0.2, (WIDTH * CLASSES, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
    first = second = 0.0
    for t in range(ROUNDS):
        share = {s: [q for q in range(SHARES) if q % c == t % c] for s, c in cut.items()}
        mine = F.lit(False)
        for s, of in share.items():
            mine = mine | ((F.col("y") == s) & F.col("share").isin(of))
        n = {s: sum(counts.get((s, q), 0) for q in of) for s, of in share.items()}
        g = share_gradient(rows.where(mine), m, {s: 1 / (v or 1) / len(n) for s, v in n.items()})
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = RATE * (1 - t / ROUNDS) * (first / (1 - 0.9 ** (t + 1))) / (np.sqrt(second / (1 - 0.99 ** (t + 1))) + 1e-8)
        ends = np.cumsum([v.size for v in m.values()])[:-1]
        m = {k: (v - d.reshape(v.shape)).astype(np.float32) for (k, v), d in zip(m.items(), np.split(move, ends), strict=True)}
    return calibrated(m, held_out(rows.where(F.col("share") >= SHARES), m))


def secret_scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_cnn (long), base_sha256, spans for docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for unit in units(batches, 1_000_000):
            texts = [t or "" for t in unit["text"]]
            every = [base_spans(t) for t in texts]
            more = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, every[i])] if model else []
            if more:
                x, of = encode(texts, more)
                best = np.zeros(len(more))
                np.maximum.at(best, of, scores(model, x))
                for j in np.flatnonzero(best >= model["threshold"]).tolist():
                    i, s, e = more[j]
                    every[i].append((s, 3, e))
            show = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x)
            base = [[x for x in spans if x[1] < 3] for spans in every]
            cols = [[sum(x[1] == k for x in spans) for spans in every] for k in range(4)]
            cols = [pa.array(unit["doc_id"], pa.int64()), *[pa.array(c, pa.int64()) for c in cols], pa.array([hashlib.sha256(show(b).encode()).hexdigest() for b in base], pa.string()), pa.array([show(sorted(s)) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return secret_scan(docs, fit(docs))
