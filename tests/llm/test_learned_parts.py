"""What learned operators choose, against plain Python: the pattern graph of personal data, and the terms of the toxicity lexicon."""

import math
import random
from collections import defaultdict

from motes.llm import pii, toxicity


def plain_graph(seen, rounds):
    """Members and patterns as sets and loops: a pattern's trust in a value counts its other members and the value's shape."""
    edge, value = {}, {}
    for p, v, seed, shape in seen:
        a, b = edge.get((p, v), (False, None)), value.get(v, (False, None))
        least = lambda x: shape if x is None else x if shape is None else min(x, shape)  # noqa: B023, E731
        edge[p, v], value[v] = (a[0] or seed, least(a[1])), (b[0] or seed, least(b[1]))
    of = defaultdict(set)
    for p, v in edge:
        of[p].add(v)
    alike = defaultdict(set)
    for v, (_, shape) in value.items():
        alike[shape].add(v)
    seeds = {v for v, (seed, _) in value.items() if seed}
    members, reached = set(seeds), set()
    for _ in range(rounds):
        reached = set()
        for (p, v), (seed, shape) in edge.items():
            if seed:
                continue
            known, own = len(of[p] & members), v in members
            base = known / (len(of[p]) - 1 + pii.PRIOR)
            if known < pii.SUPPORT or 1 - (1 - base) * (1 - pii.SHAPE) < pii.CONFIDENT:
                continue
            like = len(alike[shape] & members) if shape is not None else 0
            part = (like - own) / (len(alike[shape]) - 1 + pii.PRIOR) if like else 0.0
            sure = 1 - (1 - (known - own) / (len(of[p]) - 1 + pii.PRIOR)) * (1 - pii.SHAPE * part)
            if known - own >= pii.SUPPORT and sure >= pii.CONFIDENT:
                reached.add((p, v))
        members = seeds | {v for _, v in reached}
    return reached


def test_pattern_graph_equals_plain_sets(spark):
    found = 0
    for seed in range(4):
        rng = random.Random(seed)
        good, seen = [f"good{i}" for i in range(12)], []
        for i in range(400):
            real = rng.random() < 0.5
            pattern = rng.choice(good) if real or rng.random() < 0.1 else f"other{rng.randrange(40)}"
            seen.append((pattern, f"v{rng.randrange(120) + 1000 * real}", real and rng.random() < 0.5, rng.choice(["9-9", "99", None]) if real else rng.choice(["a9", "99"])))
        # rows of a value may differ in what they say of it
        df = spark.createDataFrame(seen, "pattern string, value string, seed boolean, shape string").repartition(3)
        for rounds in (1, 3):
            got = {(r.pattern, r.value) for r in pii.trusted_patterns(df, rounds).select("pattern", "value").collect()}
            want = plain_graph(seen, rounds)
            assert got == want
            found += len(want)
    assert found > 0
    assert pii.trusted_patterns(df.where("false")).count() == 0


def plain_terms(counts, n, pos):
    """Terms by falling likelihood ratio, each kept unless it begins like one kept, or one kept begins like it."""

    def ratio(a, b):
        total = 0.0
        for m, k in ((a, b), (n - a, pos - b)):
            for part, share in ((k, pos / n), (m - k, 1 - pos / n)):
                total += part * math.log(part / m / share) if part > 0 else 0.0
        return total

    rows = [(t, ratio(a, b)) for t, a, b in counts if b >= (toxicity.WORD_RATE if t[0] == "w" else toxicity.STEM_RATE) * a]
    rows.sort(key=lambda r: (-round(r[1], 6), r[0][0] != "w", -len(r[0]), r[0]))
    kept = []
    for t, g in rows:
        term = t[1:]
        clash = any((len(k) >= toxicity.STEMS[0] and term.startswith(k)) or (len(term) >= toxicity.STEMS[0] and k.startswith(term)) or k == term for _, k in kept)
        if g >= toxicity.GAIN and not clash:
            kept.append((t[0], term))
    return {"words": sorted(k for c, k in kept if c == "w"), "stems": sorted(k for c, k in kept if c != "w")}


def test_chosen_terms_equal_the_plain_rule():
    some = 0
    for seed in range(30):
        rng = random.Random(seed)
        n, pos = 2000, 300
        counts = {}
        for _ in range(200):
            term = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))
            b = rng.randrange(3, 120)
            counts[rng.choice("wsd") + term] = (b + rng.choice([0, 0, 1, rng.randrange(60)]), b)
        counts = [(t, a, b) for t, (a, b) in counts.items()]
        want = plain_terms(counts, n, pos)
        rng.shuffle(counts)
        assert toxicity.chosen_terms(counts, n, pos) == want
        some += len(want["words"]) + len(want["stems"])
    assert some > 30
