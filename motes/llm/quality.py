"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Trusted documents are those labelled quality 1. One in FOLDS of them, by a hash of the doc_id, is held out for the quantiles; n-grams of ORDER
symbols of the others are counted per task and summed by a shuffle; lower orders use continuation counts, each order its own three
discounts, the lowest interpolates with the uniform law. A symbol is a UTF-16 code unit, so an n-gram is one long, its context and suffix
are shifts and masks. Scoring: documents are packed into blocks of text, each block asks for its distinct n-grams, and joins sharded by n-gram
bring count, context and suffix probability to every distinct one; the answers return to their block, where each document sums them (a task
holds one block at a time, and there are SPREAD tasks for each split of the input, so what a task reads does not grow with the input). A document
is kept if its perplexity lies between two quantiles of its language's held-out trusted documents (of all held-out ones for
languages with fewer than LEAST of them).

The input must be a deterministic scan (a table); pass anything else through common.stash first, since blocks are packed twice; an n-gram
without an answer raises an error.
Trusted ids are broadcast up to TRUSTED of them (8 bytes each) and joined by shuffle beyond that.

Defined results: null counts as the empty text, with null perplexity, not kept; null is a language of its own; without held-out trusted documents every
text with characters is kept; rows that repeat a doc_id are scored each; a null doc_id is never trusted.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_splits, stash, units

ORDER, BITS, VOCABULARY = 4, 16, 65536
BOUNDARY = 1
BLOCK_BYTES = 32_000_000
#: Text scored at once, in bytes; numpy holds several 8-byte arrays of its length meanwhile.
UNIT_BYTES = 2_000_000
#: Blocks of one split of the input are scored by this many tasks.
SPREAD = 4
TRUSTED = 1_000_000
LOW, HIGH, LEAST, FOLDS = 0.002, 0.995, 20, 5


def ngrams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """n-gram ending at each UTF-16 code unit of each text, and the index of its text."""
    pad = chr(BOUNDARY) * (order - 1)
    units_ = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    gap = pad.encode("utf-16-le")
    points = np.frombuffer(gap + gap.join(units_), np.uint16).astype(np.int64)
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.int64)
    for j in range(order):
        grams = (grams << BITS) | points[j : n + j]
    sizes = np.array([len(u) // 2 for u in units_])
    begin = np.cumsum(np.concatenate(([0], sizes[:-1] + order - 1)))
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return grams[at], np.repeat(np.arange(len(texts)), sizes)


def _counted(batches):
    for unit in units(batches):
        g, c = np.unique(ngrams(unit["text"])[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])


def _blocks(batches):
    """(block, unit): blocks number the text of one split, a new one every BLOCK_BYTES. The split is a column, since a task of a union has a number of its own."""
    held, at = 0, 0
    for unit in units(batches, UNIT_BYTES):
        yield (unit["_split"][0] << 20) + at, unit
        held += sum(len(t) for t in unit["text"] if t)
        if held >= BLOCK_BYTES:
            held, at = 0, at + 1


def _requests(batches):
    block, seen = None, []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(g := reduce(np.union1d, seen)), block, np.int64)), pa.array(g)], names=["block", "g"])
    for b, unit in _blocks(batches):
        if block is not None and b != block:
            yield flush()
            seen = []
        block = b
        seen.append(np.unique(ngrams(unit["text"])[0]))
    if seen:
        yield flush()


def _packed(batches):
    for block, unit in _blocks(batches):
        sink = io.BytesIO()
        table = pa.table({"doc_id": pa.array(unit["doc_id"], pa.int64()), "lang": pa.array(unit["lang"], pa.string()), "text": pa.array(unit["text"], pa.string())})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], names=["block", "data"])


def _perplexity(blobs: list[bytes], g: np.ndarray, logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of one block with their perplexity (nan without characters), by ascending n-grams g and the logarithms of their probabilities."""
    for blob in blobs:
        table = pa.ipc.open_stream(zstandard.decompress(blob)).read_all()
        texts = table.column("text").to_pylist()
        grams, owner = ngrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        at = np.minimum(np.searchsorted(g, grams), max(0, len(g) - 1))
        if len(grams) and (not len(g) or (g[at] != grams).any()):
            raise ValueError("blocks differ between two passes over the input: stash it first")
        total = np.bincount(owner, logp[at], minlength=len(texts)) if len(grams) else np.zeros(len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(n > 0, np.exp(-total / n), np.nan)
        columns = [table.column("doc_id").combine_chunks(), table.column("lang").combine_chunks(), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(p, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_chars", "perplexity"])


def _scored(batches):
    """Rows by block: first its texts, then its n-grams ascending. One block is held at a time."""
    block, blobs, grams, logs = None, [], [], []
    both = lambda: (np.concatenate(grams), np.concatenate(logs)) if grams else (np.zeros(0, np.int64), np.zeros(0))
    for batch in batches:
        owner = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if owner[i] != block:
                yield from _perplexity(blobs, *both())
                block, blobs, grams, logs = owner[i], [], [], []
            part = batch.slice(i, j - i)
            blobs += part.column("data").drop_null().to_pylist()
            grams.append(part.column("g").drop_null().to_numpy())
            logs.append(part.column("logp").drop_null().to_numpy())
    yield from _perplexity(blobs, *both())


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def probabilities(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp) for wanted(g), distinct n-grams of `order` symbols, from counts(g, c) of trusted text."""
    suffix = lambda o: F.col("g").bitwiseAND(F.lit((1 << BITS * o) - 1))
    levels, asked = {order: counts}, {order: wanted}
    for o in range(order - 1, 0, -1):
        levels[o] = stash(levels[o + 1].groupBy(suffix(o).alias("g")).agg(F.count("*").alias("c")), "kn-counts")
        asked[o] = asked[o + 1].select(suffix(o).alias("g")).distinct()
    below = None
    for o in range(1, order + 1):
        d1, d2, d3 = discounts(levels[o])
        context = levels[o].groupBy(F.shiftrightunsigned("g", BITS).alias("h")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)).alias("left"))
        held = F.when(F.col("c") == 1, 1 - d1).when(F.col("c") == 2, 2 - d2).otherwise(F.col("c") - d3)
        rows = asked[o].join(levels[o], "g", "left").withColumn("h", F.shiftrightunsigned("g", BITS)).join(context, "h", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / VOCABULARY))
        else:
            rows = rows.withColumn("s", suffix(o - 1)).join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        p = F.when(F.col("t").isNull(), F.col("lower")).otherwise((F.coalesce(held, F.lit(0.0)) + F.col("left") * F.col("lower")) / F.col("t"))
        below = rows.select("g", p.alias("p"))
    return below.select("g", F.log("p").alias("logp"))


def trusted_ids(labels: DataFrame, held_out: bool) -> DataFrame:
    """Ids labelled quality 1 of the fold that is held out, or of the others; to be broadcast if they are few enough."""
    ids = labels.where("quality = 1 and doc_id is not null").where((F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0) == held_out).select("doc_id").distinct()
    return F.broadcast(ids) if ids.limit(TRUSTED + 1).count() <= TRUSTED else ids


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity for docs(doc_id, lang, text)."""
    docs = docs.select("doc_id", "lang", "text")
    counts = stash(docs.join(trusted_ids(labels, False), "doc_id", "left_semi").select("text").mapInArrow(_counted, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "kn-counts")
    split = docs.withColumn("_split", F.spark_partition_id().cast("long"))
    asked = stash(split.mapInArrow(_requests, "block long, g long"), "kn-asked")  # read for each order and for the answers
    known = stash(probabilities(counts, asked.select("g").distinct()), "kn-model")
    answers = asked.join(known, "g")
    packed = split.mapInArrow(_packed, "block long, data binary").select("block", "data", F.lit(None).cast("long").alias("g"), F.lit(None).cast("double").alias("logp"))
    rows = packed.unionByName(answers.select("block", F.lit(None).cast("binary").alias("data"), "g", "logp"))
    n = n_splits(docs)
    task = F.pmod(F.shiftright("block", 20), F.lit(n)) + n * F.pmod("block", F.lit(SPREAD))
    dealt = rows.withColumn("_task", task.cast("int")).repartitionById(n * SPREAD, "_task").drop("_task").sortWithinPartitions("block", F.asc_nulls_first("g"))
    return dealt.mapInArrow(_scored, "doc_id long, lang string, n_chars long, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, keep."""
    scored = stash(perplexities(docs, labels).withColumn("perplexity", F.nanvl("perplexity", F.lit(None).cast("double"))), "perplexity")
    trusted = scored.join(trusted_ids(labels, True), "doc_id", "left_semi").where("perplexity is not null")
    bounds = lambda: F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), 10000)
    whole = trusted.agg(bounds()).first()[0]
    by_lang = trusted.groupBy(F.col("lang").alias("_lang")).agg(bounds().alias("own"), F.count("*").alias("_n"))
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limits = F.when(F.col("_n") >= LEAST, F.col("own")).otherwise(F.lit(None) if whole is None else F.array(*[F.lit(x) for x in whole]))
    keep = F.col("perplexity").isNotNull() & (limits.isNull() | F.col("perplexity").between(limits[0], limits[1]))
    return joined.select("doc_id", "lang", "n_chars", "perplexity", keep.alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
