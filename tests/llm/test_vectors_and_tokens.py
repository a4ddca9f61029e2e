"""Hard negatives, centroids and token counts against brute force, the library, and on hard inputs; and mends of earlier operators."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motes.llm import centroids, hard_negatives, line_dedup, mixing, secrets, token_counts, toxicity
from motes.llm.byte_pairs import Sparse

PATH = public_tokenizers.path(token_counts.FILE)
VOCABULARY = Path(PATH).read_text(encoding="utf-8")
VECTORS = "vec_id long, label int, embedding array<float>, score double, v int"


def scaled(e):
    return [int(np.floor(256 * float(np.float32(x)))) for x in e]


def brute_negatives(rows, step):
    rows = [(i, lab, scaled(e)) for i, lab, e in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, lab, v in rows:
        if i % step:
            continue
        others = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for p, j, _ in [o for o in others if o[2] == lab][:5]:
            near = [(n, k) for n, k, m in others if m != lab and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(near[:10], 1)]
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "zeros", "clusters"])
def test_hard_negatives_brute(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 220, 6
    if kind == "clusters":
        x = rng.normal(0, 0.3, (n, d)) + rng.normal(0, 1, (9, d))[rng.integers(0, 9, n)]
    else:
        x = rng.normal(0, 0.3, (n, d)) if kind == "spread" else rng.integers(-1, 2, (n, d)) * 0.5
    if kind == "ties":
        x[: n // 3] = [0.5, -0.5, 0, 0.5, 0, 0]
    if kind == "zeros":
        x[::20] = 0
    rows = [(i, int(rng.integers(0, 3)), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = hard_negatives.hard_negatives(df, anchor_step=20, group_rows=50)  # several groups, so that ranks are merged
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(brute_negatives(rows, 20))


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    x = np.zeros((5000, 8), np.int64)
    x[:, 0] = np.arange(5000)
    x[:, 1:] = rng.integers(0, 3, (5000, 7))
    lists = hard_negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), x)
    seen = []
    scores = lists.scores
    lists.scores = lambda rows, anchor: seen.append(len(rows)) or scores(rows, anchor)
    anchor = np.array([100, 0, 0, 0, 0, 0, 0, 1])
    got = lists.search(anchor, -1, np.array([-hard_negatives.NEVER]), np.array([hard_negatives.NEVER]), 5)[0]
    want = sorted(range(5000), key=lambda i: (-int(x[i] @ anchor), i))[:5]
    assert got[0].tolist() == want and sum(seen) < 1000


def test_scores_beyond_doubles_are_exact():
    big = hard_negatives.Lists(np.arange(3), np.zeros(3, np.int64), np.array([[1 << 24, 1], [1 << 24, 2], [1 << 24, 0]]))
    got = big.search(np.array([(1 << 24) + 1, 1]), -1, np.array([-hard_negatives.NEVER]), np.array([hard_negatives.NEVER]), 3)[0]
    assert got[0].tolist() == [1, 0, 2] and np.diff(got[1]).tolist() == [-1, -1]


@pytest.fixture(scope="module")
def hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5] * 64
    rows = [(0, 1, one), (100, 1, one), (100, 1, one), (5, 2, one), (5, 2, one), (None, 1, one), (6, None, one), (8, 1, None), (9, 1, [None] * 64), (10, 1, [nan] * 64), (11, 1, [inf] * 64), (12, 1, [0.5]), (13, 2, []), (14, 2, [1e30] * 64), (15, 1, [0.25] * 64), (16, 2, [0.2] * 64)]
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], VECTORS)


def test_hard_negatives_hard(hard_vectors):
    got = Counter(map(tuple, hard_negatives.hard_negatives(hard_vectors).collect()))
    # rows that repeat a vec_id are rows each, and a repeated anchor repeats its result
    assert {r[0] for r in got} == {0, 100} and {r[3] for r in got} == {16} and all(v == 2 for r, v in got.items() if r[0] == 100 and r[1] == 0)
    assert hard_negatives.hard_negatives(hard_vectors.where("false")).count() == 0
    assert not {12, 13, 14, None} & {r[1] for r in got}


def brute_clusters(rows, k, rounds):
    kept = [(i, scaled(e)) for i, e in rows]
    c = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else w for j, w in enumerate(c)]
    got = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in got:
        total[j] += d
    return sorted((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got)


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters"])
def test_centroids_brute(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (150, 4)) if kind == "spread" else rng.integers(0, 2, (150, 4)) * 0.5 if kind == "ties" else rng.normal(0, 0.05, (150, 4)) + rng.normal(0, 2, (7, 4))[rng.integers(0, 7, 150)]
    rows = [(i, x[i].tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = centroids.clustered(df, clusters=12, rounds=3, dims=4)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows, 12, 3)


def test_ptolemaic_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (400, 5)) + 4000 * rng.integers(-3, 4, (400, 1))
    c = x[:20].astype(np.int64)
    pivots = centroids.chosen_pivots(c, 5)
    nearest = centroids.Nearest(c, pivots)
    cached = np.sqrt(np.stack([centroids.squared(x, p) for p in pivots], axis=1).astype(float))
    true = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))
    assert (nearest.bounds(cached) <= true * (1 + 1e-12)).all()
    cluster, distance, measured = nearest(x, cached)
    assert (cluster == (true**2).round().astype(int).argmin(1)).all() and (distance == (true**2).round().astype(int).min(1)).all()
    assert measured < 0.6 * len(x) * len(c)


def test_centroids_hard(hard_vectors):
    got = centroids.clustered(hard_vectors)
    rows = got.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == sorted((i is None, i or 0) for i in [0, 100, 100, 5, 5, None, 6, 15, 16])
    assert {r.cluster for r in rows} <= set(range(9)) and all(r.inertia == 0 for r in rows)
    assert centroids.clustered(hard_vectors.where("false")).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_str(VOCABULARY)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(VOCABULARY, token_counts.settled_points(VOCABULARY))


PARTS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "r", "s", "e", "l", "t", "abc", "The", "12", "!", "é", "漢", " ", "<|endoftext|>", "<|end", "|>", "…", "\U0001f600", "\x1c", "\x85", "don't", "aaaa", "²", "​", "\x00", "͸"]


def test_counts_are_the_librarys(counter, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(32, 127)) for _ in range(rng.randrange(300))) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 3000 + "é" * 4000, " " * 5000, "'s" * 900, "7" * 3000]
    assert counter.count(texts).tolist() == library(texts)


def test_chunks_compose(counter, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(5, 60))) for _ in range(400)] + ["x" * 700, " " * 300, "a  b\n\n c" * 60]
    for size in (1, 7, 150):
        for text, want in zip(texts, library(texts), strict=True):
            chunks = counter.chunks(text, size)
            assert "".join(chunks) == text
            assert counter.total([counter.summary(c, i == 0) for i, c in enumerate(chunks)]) == want, (size, text)


def test_every_code_point_is_cut_as_the_library_cuts_it(counter):
    cut = Tokenizer.from_str(VOCABULARY).pre_tokenizer.pre_tokenize_str
    for low in [*range(0, 0x3400, 0x400), *range(0xA000, 0xAC00, 0x400), *range(0xF800, 0x20000, 0x1000)]:
        text = "".join(f"a{c}1{c}!{c} {c}b\n" for c in map(chr, range(low, low + 0x400)))
        points, _, _ = counter.points([text])
        begins, _ = counter.cuts(counter.classes[points])
        assert np.flatnonzero(begins)[:-1].tolist() == [s for _, (s, _) in cut(text)], hex(low)


def test_states_are_forgotten_in_time(library):
    own = token_counts.Counter(VOCABULARY, {})
    own.transducer.MOST = 200
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(30)] + ["".join(rng.choice("abcdefgh") for _ in range(4000))]
    assert [int(own.count([t])[0]) for t in texts] == library(texts) and len(own.transducer.states) < 20_000


def test_sparse_table():
    rng = random.Random(8)
    keys = rng.sample(range(1 << 40), 9000)
    table = Sparse(4)
    for i in range(0, 9000, 1000):
        table.add(keys[i : i + 1000], list(range(i, i + 1000)))
    at = table.slots(np.array(keys))
    assert (table.keys[at] == keys).all() and (table.values[at] == np.arange(9000)).all()
    assert (table.keys[table.slots(np.array([-5 % (1 << 41), 1 << 50]))] == -1).all()


def test_token_counts_hard(spark, hard, none, library):
    for chunk in (token_counts.CHUNK, 100):  # texts beyond a chunk are counted in pieces
        got = token_counts.token_counts(hard.withColumn("n_tokens", F.lit("x")), VOCABULARY, chunk=chunk).collect()
        texts = {r.doc_id: r.text or "" for r in hard.collect()}
        assert len(got) == 11 and all(r.n_tokens == library([texts[r.doc_id]])[0] and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in got)
        assert all(r._lines == "x" and r.target == 1 for r in got)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(hard, Path(public_tokenizers.path("word_bpe_49k.json")).read_text())


def test_toxicity_of_short_texts(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        rows.append((i, " ".join(([rng.choice(["grobnik", "zulwart"])] if toxic else [f"plain{rng.randrange(200)}"]) + [f"w{rng.randrange(300)}"] * (i % 3 > 0))))
        labels.append((i, None, toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).select("doc_id", "predicted", toxicity.held_out(F.col("doc_id")).alias("held")).where("held").collect()
    assert len(got) > 100 and sum(r.predicted != r.doc_id % 2 for r in got) <= 2


def test_mixing_deals_rows_without_ids(spark):
    rng = random.Random(10)
    rows = [(None if i % 3 == 0 else i, " ".join(f"v{rng.randrange(400)}" for _ in range(5)), "s") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    sized, _ = mixing.mix(d)
    most = sized.groupBy("_b").count().agg(F.max("count"), F.avg("count")).first()
    assert most[0] <= 8 * most[1] and most[0] < 60
    again = lambda df: Counter(map(tuple, mixing.mixed(df).select("doc_id", "size", "taken", "first_slot").collect()))
    assert again(d) == again(d.repartition(3))


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {i} {i * i % 9973}" for i in range(400_000))
    d = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).select("doc_id", "n_removed_lines", F.length("text").alias("n")).collect()}
    assert got[1].n_removed_lines == 0 and got[2].n_removed_lines > 100_000 and time.time() - began < 60


def test_secret_candidates_of_very_many_findings():
    text = " ".join(f"password={i:08d}abcdefgh token{i}xyzabc" for i in range(50_000))
    spans = secrets.base_spans(text)
    began = time.time()
    found = secrets.candidates(text, spans)
    assert len(spans) == 50_000 and len(found) == 50_000 and time.time() - began < 5
    few = "aaaaaaaaaa=bbbbbbbb password=12345678 zzzzzzzz"
    assert secrets.candidates(few, [(10, 0, 15)]) == [(0, 10), (20, 37), (38, 46)]
    covered = {i for s, _, e in secrets.base_spans(few) for i in range(s, e)}
    assert all(not covered & set(range(s, e)) and e - s >= 8 for s, e in secrets.candidates(few, secrets.base_spans(few)))


def test_secret_parts_keep_findings_together():
    own = np.array([5, 5, 7, 7, 9, 1, 2, 3, 4, 6, 6])
    y = np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0])
    got = secrets.parts(y, own)
    assert got[0] == got[1] and got[2] == got[3] and len({got[0], got[2], got[4]}) == 3 and got[5:].tolist() == [0, 1, 2, 3, 4, 0]
