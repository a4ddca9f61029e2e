"""Personal data in texts: fixed patterns as seeds, and bootstrapped contextual extraction of further identifiers.

Candidates are tokens with at least MIN_DIGITS digits, or with an @, and groups of digits with spaces between; what a base kind has judged and
dropped (a card number that fails Luhn, an address with a part over 255, a phone number of another length) is none. A lexical pattern is a pair of
words around a candidate: the two before it, the two after it, or one on either side. Members, at first the base spans' values, spread trust
along the graph of patterns and instances, by joins of aggregated tables. In each round a pattern's trust in an instance is the share of
members among its other distinct instances, damped by PRIOR unknown ones; so nothing supports itself. The shape of a value (digits
and letters as classes, runs shortened) is a soft feature: members of the same shape add to the trust, weighing SHAPE, but an unseen
shape takes nothing away. Instances with trust of at least CONFIDENT from a pattern with SUPPORT other members or more become members,
so that later rounds reach patterns without base spans. In the end the occurrences in such patterns are accepted.

Defined results: null counts as the empty text; offsets are code points; base spans always stay; accepted spans (kind found)
overlap none of them; rows that repeat a doc_id are told apart by their text. A limit of what can be found: candidates hold MIN_DIGITS digits or an @, so
identifiers of letters only, or of fewer digits, are never found, whatever their context; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, units

KINDS = ("email", "ip", "card", "phone", "found")
# fixed values: the base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9])\(?[0-9]{2,4}\)?(?:[\x20-]\(?[0-9]{2,4}\)?)+(?![A-Za-z0-9@._/-])|[A-Za-z0-9+(][A-Za-z0-9+()@._/-]*[A-Za-z0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
MIN_DIGITS, ROUNDS, PRIOR, CONFIDENT, SUPPORT, SHAPE = 5, 3, 2, 0.6, 3, 0.25
NOT_WORD, WORD = re.compile(r"\W+"), re.compile(r"\S+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def judged(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end), sorted, and the spans (start, end) that a base kind drops for their value."""
    out, dropped = [], []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if any(d in text for d in "0123456789"):
        for m in IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            out.append((m.start(), 1, m.end())) if fits else dropped.append(m.span())
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19:
                out.append((m.start(), 2, m.end())) if luhn(digits) else dropped.append(m.span())
        for m in PHONE.finditer(text) if "+" in text else ():
            fits = 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15
            out.append((m.start(), 3, m.end())) if fits else dropped.append(m.span())
    return sorted(out), dropped


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    return judged(text)[0]


def shape(value: str) -> str:
    """Digits as 9, letters as a, runs of letters shortened to two: "ab-1234" → "aa-9999"."""
    return re.sub(r"a{3,}", "aa", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", value)))


def around(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence, from the spans of the text's words; ^ and $ are the ends of the text."""
    plain = lambda s, e: NOT_WORD.sub("", text[s:e]).lower()
    i = bisect_left(words, start, key=lambda w: w[0])  # words from here on begin at the occurrence or later
    before = [plain(s, min(e, start)) for s, e in words[max(0, i - 2) : i]]
    j = bisect_right(words, end, key=lambda w: w[1])  # words from here on end after it
    after = [plain(max(s, end), e) for s, e in words[j : j + 2]]
    a, b = ["^", "^", *before][-2:]
    c, d = [*after, "$", "$"][:2]
    return [f"{a} {b} _", f"{b} _ {c}", f"_ {c} {d}"]


def candidates(text: str, spans: list[tuple[int, int, int]], dropped: list[tuple[int, int]]) -> list[tuple[int, int, list[str], str, str, bool]]:
    """(start, end, patterns, shape, value, seed) of base spans and further tokens, which overlap neither those nor what was dropped."""
    out = [(s, e, text[s:e], True) for s, _, e in spans]
    if any(d in text for d in "0123456789@"):
        taken = sorted([(s, e) for s, _, e in spans] + dropped)
        furthest = list(accumulate((e for _, e in taken), max))
        for m in CANDIDATE.finditer(text):
            v = m[0]
            if "@" in v or sum(c.isdigit() for c in v) >= MIN_DIGITS:
                i = bisect_left(taken, m.end(), key=lambda t: t[0])
                if not i or furthest[i - 1] <= m.start():
                    out.append((m.start(), m.end(), v, False))
    words = [m.span() for m in WORD.finditer(text)] if out else []
    return [(s, e, around(text, words, s, e), shape(v), v, seed) for s, e, v, seed in out]


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, value): patterns with the instances, not seeds, that they deserve trust for; from seen(pattern, value, seed[, shape]).

    Each round joins edges with members, patterns and shapes. Members only grow, so the last round holds what all found.
    What was grouped by a key is written before it is joined by that key, so that a hot value or pattern is a skewed key, which joins split.
    """
    if "shape" not in seen.columns:
        seen = seen.withColumn("shape", F.lit(None).cast("string"))
    edges = stash(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.min("shape").alias("shape")), "pii-edges")
    values = edges.groupBy("value").agg(F.max("seed").alias("seed"), F.min("shape").alias("shape"))
    values = stash(values, "pii-values")
    member = values.where("seed").select("value", F.lit(1).alias("in"))
    inside = F.coalesce("in", F.lit(0))
    for _ in range(rounds):
        marked = edges.join(member, "value", "left").withColumn("in", inside)
        shapes = values.join(member, "value", "left").groupBy("shape").agg(F.sum(inside).alias("like"), F.count("*").alias("alike")).where("like > 0")
        shapes = stash(shapes, "pii-shapes")
        # no shape lifts a pattern below this share to CONFIDENT
        able = marked.groupBy("pattern").agg(F.sum("in").alias("known"), F.count("*").alias("n")).where((F.col("known") >= SUPPORT) & (1 - (1 - F.col("known") / (F.col("n") - 1 + PRIOR)) * (1 - SHAPE) >= CONFIDENT))
        both = marked.where("not seed").join(stash(able, "pii-patterns"), "pattern").join(shapes, "shape", "left")
        others = F.col("known") - F.col("in")
        alike = F.coalesce((F.col("like") - F.col("in")) / (F.col("alike") - 1 + PRIOR), F.lit(0.0))
        sure = 1 - (1 - others / (F.col("n") - 1 + PRIOR)) * (1 - SHAPE * alike)
        reached = stash(both.where((others >= SUPPORT) & (sure >= CONFIDENT)).select("pattern", "value"), "pii-reached")
        member = stash(values.where("seed").select("value").unionByName(reached.select("value")).distinct().withColumn("in", F.lit(1)), "pii-members")
    return reached


def _first(batches):
    for unit in units(batches):
        rows = []
        for doc, text in zip(unit["doc_id"], unit["text"], strict=True):
            text = text or ""
            spans, dropped = judged(text)
            cand = candidates(text, spans, dropped)
            key = hashlib.md5(text.encode()).digest()
            rows.append((doc, key, ",".join(f"{s}:{k}:{e}" for s, k, e in spans), [{"s": c[0], "e": c[1], "patterns": c[2], "shape": c[3], "value": c[4], "seed": c[5]} for c in cand]))
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("patterns", pa.list_(pa.string())), ("shape", pa.string()), ("value", pa.string()), ("seed", pa.bool_())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "key", "base", "cand"])


def _last(frames):
    for pdf in frames:
        out = []
        for base, found in zip(pdf.base, pdf.found, strict=True):
            spans = [tuple(map(int, x.split(":"))) for x in base.split(",")] if base else []
            show = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
            more = [] if found is None else [(int(r["s"]), 4, int(r["e"])) for r in found]
            out.append((*[sum(x[1] == k for x in spans) for k in range(4)], len(set(more)), hashlib.sha256(show(spans).encode()).hexdigest(), show({*spans, *more} if more else spans)))
        yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "n_found", "base_sha256", "spans"]).assign(doc_id=pdf.doc_id.to_numpy())[["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_found", "base_sha256", "spans"]]


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_found (long), base_sha256, spans for docs(doc_id, text)."""
    first = stash(docs.select("doc_id", "text").mapInArrow(_first, "doc_id long, key binary, base string, cand array<struct<s:int,e:int,patterns:array<string>,shape:string,value:string,seed:boolean>>"), "pii-spans")
    seen = first.select("doc_id", "key", F.explode("cand").alias("c")).select("doc_id", "key", "c.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    accepted = seen.where("not seed").join(trusted_patterns(seen.select("pattern", "value", "seed", "shape")), ["pattern", "value"], "left_semi")
    found = stash(accepted.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set(F.struct("s", "e")).alias("found")), "pii-found")
    both = first.select("doc_id", "key", "base").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "base", "found")
    return both.mapInPandas(_last, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_found long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pii(table(spark, sf_dir, "documents"))
