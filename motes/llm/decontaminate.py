"""Benchmark decontamination by canonical templates, which also catches re-parameterised questions.

A text becomes a template: numbers, units after numbers and names (capitalised words inside a sentence) turn into typed
placeholders, other words are lower-cased and lose ASCII punctuation. Windows of WIDTH template words, at least LITERALS of them no
placeholders, are hashed and joined with those of the benchmark. The values that placeholders stand for must be consistent
for a document and an item: along one alignment, one item value stands for one document value; windows that break this do
not count. A document is contaminated if its consistent windows cover a share COVERAGE of an item's windows, or RUN of them.
An item without a window (too short, or too many placeholders) is matched by its whole template instead, as one window of its own length
with the same consistency; a template of placeholders only must also have the item's values.

Before the join, documents' windows pass a filter: a bitmap of 2 ** FILTER_BITS bits (16 MB), one set for each window hash of the benchmark, made
by Spark and broadcast. Its size is fixed; a larger benchmark lets more windows through, which the join on whole hashes then drops.
A window that many documents and many items share makes a row for each pair of them, since items are counted one by one.

Defined results: null and empty texts, and items without words, match nothing;
a document matches an item once however often it holds it; rows that repeat a doc_id count as one document.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, packed, place, units, windows, word_hashes

WIDTH, LITERALS, COVERAGE, RUN, FILTER_BITS = 8, 5, 0.5, 6, 27
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
NUMBERS = re.compile(r"(?<!\w)[0-9]+(?:[.,:/][0-9]+)*%?(?!\w)")
# fixed values: units of measure and money
UNITS = re.compile(rf"(?<={NUMBER} )(?:km|kilometers?|miles?|m|meters?|cm|mm|kg|grams?|g|mg|pounds?|lbs?|tons?|liters?|ml|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|kmh|mph|degrees?)\b")
NAMES = re.compile(r"(?<=[a-zß-ÿ,;] )[A-ZÀ-Þ][a-zß-ÿ]+\b")
DIGIT = re.compile(r"[0-9]")
MARKS = re.compile(f"[{NUMBER}{NAME}{UNIT}]")
PUNCT = {i: " " for i in range(33, 127) if not chr(i).isalnum()}


def canonical(text: str) -> tuple[str, list[str]]:
    """Template of a text, and the values of its placeholders in order."""
    values: list[str] = []
    text = MARKS.sub(" ", text)
    if NAMES.search(text) or DIGIT.search(text):
        text = NAMES.sub(lambda m: f" {NAME}{m[0].lower()}{NAME} ", text)
        text = NUMBERS.sub(lambda m: f" {NUMBER}{m[0]}{NUMBER} ", text)
        # the value is taken out, the mark stays
        text = re.sub(f"([{NUMBER}{NAME}])([^{NUMBER}{NAME}]*)\\1", lambda m: values.append(m[2]) or m[1], text)
        text = re.sub(rf"{NUMBER} +", f"{NUMBER} ", text)
        text = UNITS.sub(UNIT, text)
    return text.lower().translate(PUNCT), values


def _windows(texts: list[str | None], width: int, whole: list[tuple[int, bool]] | None):
    """key, first word's index, length of windows; owner, place and slot number of each word; values.

    These are the windows of `width` with enough literals, and those of `whole`, (length, whether placeholders only). whole None: the texts are
    items, and those without a window are one window as a whole.
    """
    made = [canonical(t or "") for t in texts]
    values = [m[1] for m in made]
    (h,), owner = word_hashes([m[0].encode() for m in made])
    marks = word_hashes([m.encode() for m in (NUMBER, NAME)])[0][0]
    slot = np.isin(h, marks)
    unit = h == word_hashes([UNIT.encode()])[0][0][0]
    key, at = windows(h, owner, width)
    total = np.concatenate(([0], np.cumsum(slot | unit)))
    good = width - (total[at + width] - total[at]) >= LITERALS
    slots = np.concatenate(([0], np.cumsum(slot)))
    parts = [(key[good], at[good], np.full(int(good.sum()), width))]
    count = np.bincount(owner, minlength=len(texts))
    alone = (count > 0) & (np.bincount(owner[at[good]], minlength=len(texts)) == 0)
    lengths = sorted({(int(n), bare) for n in np.unique(count[alone]) for bare in (False, True)}) if whole is None else whole
    for n, bare in lengths:
        key, at = windows(h, owner, n)
        fit = (total[at + n] - total[at] == n) == bare
        if whole is None:
            fit &= alone[owner[at]] & (count[owner[at]] == n)
        key, at = mix(key[fit] + np.uint64(n)), at[fit]
        if bare and len(at):
            begin = np.searchsorted(owner, owner[at])
            said = ["\n".join(values[w][a:b]).encode() for w, a, b in zip(owner[at].tolist(), (slots[at] - slots[begin]).tolist(), (slots[at + n] - slots[begin]).tolist(), strict=True)]
            key = mix(key ^ np.array([int.from_bytes(hashlib.md5(v).digest()[:8]) for v in said], np.uint64))
        parts.append((key, at, np.full(len(at), n)))
    key, at, size = (np.concatenate(p) for p in zip(*parts, strict=True))
    return key, at, size, total[at + size] - total[at] == size, owner, place(owner), slots, values


_ROWS = "id long, h long, pos int, slots array<string>, first_slot int, total int, size int, bare boolean"


def _emit(column: str, keep=None, width: int = WIDTH, whole: list[tuple[int, bool]] | None = None):
    """A map over Arrow batches with (id column, text): one row per window whose bit is set in keep, all without keep."""

    def run(batches):
        wanted = keep.value if keep is not None else None
        for unit in units(batches, 3_000_000):
            key, at, size, bare, owner, pos, slots, values = _windows(unit["text"], width, whole)
            n = np.bincount(owner[at], minlength=len(unit["text"]))
            if wanted is not None:
                bit = key >> np.uint64(64 - FILTER_BITS)
                hit = (wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                key, at, size, bare = key[hit], at[hit], size[hit], bare[hit]
            if not len(key):
                continue
            who = owner[at]
            begin = np.searchsorted(owner, who)
            low, high = slots[at] - slots[begin], slots[at + size] - slots[begin]
            held = [values[w][a:b] for w, a, b in zip(who.tolist(), low.tolist(), high.tolist(), strict=True)]
            ids = unit[column]
            cols = [pa.array([ids[w] for w in who.tolist()], pa.int64()), pa.array(key.view(np.int64)), pa.array(pos[at].astype(np.int32)), pa.array(held, pa.list_(pa.string())), pa.array(low.astype(np.int32)), pa.array(n[who].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bare)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "pos", "slots", "first_slot", "total", "size", "bare"])

    return run


def bitmap(bench: DataFrame) -> np.ndarray:
    """The filter of the window hashes in bench(h): 64-bit words, of which Spark sends those that are not 0 (2 ** (FILTER_BITS - 6) at most)."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = bench.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, windows (consistent distinct windows of the item that the document holds), total (the item's windows)."""
    bench = benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(_emit("item_id", width=width), _ROWS)
    own = bench.groupBy("id").agg(F.max("total").alias("total"), F.max("size").alias("size"), F.max("bare").alias("bare")).where("total = 1")
    whole = sorted((r[0], r[1]) for r in own.select("size", "bare").distinct().collect())
    keep = docs.sparkSession.sparkContext.broadcast(bitmap(bench))
    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_emit("doc_id", keep, width, whole), _ROWS)
    b = bench.select(F.col("id").alias("item_id"), "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("first_slot").alias("item_slot"), "total")
    pairs = found.select(F.col("id").alias("doc_id"), "h", "pos", "slots").join(b, "h").withColumn("shift", F.col("pos") - F.col("item_pos")).drop("h", "pos")
    plain = pairs.where(F.size("item_slots") == 0)
    slotted = pairs.where(F.size("item_slots") > 0)
    said = slotted.select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("v"))
    torn = said.groupBy("doc_id", "item_id", "shift", F.col("v.item_slots").alias("value")).agg(F.countDistinct("v.slots").alias("n")).where("n > 1").groupBy("doc_id", "item_id", "shift").agg(F.collect_set("value").alias("torn"))
    sound = slotted.join(torn, ["doc_id", "item_id", "shift"], "left").where(F.col("torn").isNull() | ~F.arrays_overlap("torn", "item_slots"))
    cols = ["doc_id", "item_id", "item_pos", "total"]
    return plain.select(cols).unionByName(sound.select(cols)).groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("windows"), F.max("total").alias("total"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, width: int = WIDTH) -> DataFrame:
    """docs with contaminated (boolean), n_items (long: items it holds) and coverage (double: largest covered share of an item)."""
    hits = matches(docs, benchmark, width)
    share = F.col("windows") / F.col("total")
    strong = F.when((share >= coverage) | (F.col("windows") >= run), 1)
    by_doc = hits.groupBy("doc_id").agg(F.count(strong).alias("n_items"), F.max(share).alias("coverage"))
    docs, rest = packed(docs, ["doc_id", "text"], ["contaminated", "n_items", "coverage"])
    out = docs.join(by_doc.hint("shuffle_hash"), "doc_id", "left")
    return out.select("doc_id", "text", *rest, (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "coverage")
