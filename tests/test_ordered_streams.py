"""Streams whose rows arrive out of order equal the batch result, and last runs are emitted as censored."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motes.streaming import forms

SCHEMA = "exp string, particle long, frame int, x double, y double"


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """Files of rows whose frames are up to 5 ahead or behind, one file a batch; a late marker moves the watermark past all of them."""
    rng, rows = random.Random(1), []
    for p in range(6):
        frames = [f for f in range(60) if rng.random() > 0.08 and f < 60 - 7 * p]
        rows += [(f"e{p % 2}", p, f, rng.random() * 100, rng.choice([5.0, 30.0, 70.0, float("nan")])) for f in frames]
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 5)
    path = str(tmp_path_factory.mktemp("arriving"))
    for i in range(0, len(order), 40):
        spark.createDataFrame(order[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", 99, 1000, 0.0, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def stream(spark, path):
    return forms.with_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), 4)


def batch_runs(rows, enter, leave):
    tracks, out = defaultdict(list), []
    for e, p, f, _, v in rows:
        if v == v:
            tracks[e, p].append((f, v))
    for key, t in tracks.items():
        held = None
        for f, v in sorted(t):
            fresh = held is None or f != held[2] + 1
            mark = 1 if abs(v) < enter else 0 if v > leave else int(v < (enter + leave) / 2) if fresh else held[0]
            if fresh or mark != held[0]:
                if held:
                    out.append((*key, *held, fresh))
                held = (mark, f, f, 1)
            else:
                held = (mark, held[1], f, held[3] + 1)
        out.append((*key, *held, True))
    return sorted(out)


def test_runs_of_shuffled_rows(spark, arrived, tmp_path):
    rows, path = arrived
    got = forms.drained(forms.ordered_runs(stream(spark, path), "y", 20.0, 60.0, "30 seconds", 600_000), "runs", str(tmp_path))
    assert sorted(map(tuple, got.collect())) == batch_runs(rows, 20.0, 60.0)


def test_a_silent_track_ends(spark, arrived, tmp_path):
    """With a short limit of silence, runs end as censored at gaps just as without; nothing is emitted twice."""
    rows, path = arrived
    got = forms.drained(forms.ordered_runs(stream(spark, path), "y", 20.0, 60.0, "30 seconds", 12_000), "runs", str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == batch_runs(rows, 20.0, 60.0)


def test_steps_of_shuffled_rows(spark, arrived, tmp_path):
    rows, path = arrived
    got = {(r.exp, r.particle, r.frame): r for r in forms.drained(forms.ordered_steps(stream(spark, path), "30 seconds", 600_000), "steps", str(tmp_path)).collect()}
    at = {r[:3]: r for r in rows}
    assert got.keys() == at.keys()
    for (e, p, f), r in got.items():
        a, b, c = at.get((e, p, f - 2)), at.get((e, p, f - 1)), at[e, p, f]
        assert (r.v is None) == (b is None or c[4] != c[4] or b[4] != b[4])
        if a is None or b is None:
            assert r.turn is None
