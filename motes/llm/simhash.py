"""SimHash fingerprints of documents and search within a Hamming radius.

A text's terms are its pairs of neighbouring words (a one-word text has the word), each occurrence with weight 1; so a term weighs
its frequency. Every term's 64-bit hash votes on 64 signed bits, and the fingerprint holds the signs. Permuted block tables:
fingerprints are cut into `radius + 2` blocks, of which at least two survive when `radius` bits differ; one table for each
pair of blocks, keyed by both, therefore finds every fingerprint within the radius.

Defined results: null counts as the empty text, whose fingerprint is 0; equal texts have equal fingerprints; tied votes give
a 0 bit; rows with equal doc_id follow each other by a hash of their text, then by text, and each has its own result; null doc_ids come last; a single
document is its own next one. A doc_id (or none) of very many rows is cut into several ranges by that hash, so only rows equal in both meet in one task.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_splits, stash, windows, word_hashes

RADIUS = 3
#: A query is every document whose id this number divides.
QUERY_STEP = 50
LAST, FIRST = (1 << 63) - 1, -(1 << 63)


def fingerprints(texts: list[str]) -> np.ndarray:
    (h,), owner = word_hashes([t.encode() for t in texts])
    key, at = windows(h, owner, 2)
    one = np.flatnonzero(np.bincount(owner, minlength=len(texts))[owner] == 1) if len(owner) else np.zeros(0, np.int64)
    key, own = np.concatenate([key, h[one]]), np.concatenate([owner[at], owner[one]])
    out = np.zeros(len(texts), np.uint64)
    if len(own):
        order = np.argsort(own, kind="stable")
        key, own = key[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(key.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        signs = 2 * ones > np.diff(np.append(first, len(own)))[:, None]
        out[own[first]] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / 64


def cuts(keyed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows at which about n ranges of keyed(_k, _h) in this order begin, ascending, as their _k and _h; the first is the first row of all.

    Quantiles of _k (as doubles, so they need not be ids) part the rows, and each part begins with its least _k, whatever the _h: FIRST. A _k of more rows than a
    range should have is cut by quantiles of its own _h, of 52 bits, which are rows of it.
    """
    shares, exact = F.array(*[F.lit(i / n) for i in range(n + 1)]), max(10_000, 2 * n)
    total, found = keyed.agg(F.count("*"), F.percentile_approx("_k", shares, exact)).first()
    points = np.unique(np.array(found or [], np.int64))
    begin: list[tuple[int, int]] = []
    hot: dict[int, int] = {}
    if len(points) < len(found or []):  # one quantile twice: some _k may have a range's worth of rows; at most n of them have
        hot = {k: c for k, c in keyed.groupBy("_k").agg(F.count("*").alias("c")).where(F.col("c") > total / n).collect()}
    if hot:
        for k, least, h in keyed.where(F.col("_k").isin(list(hot))).groupBy("_k").agg(F.min("_h"), F.percentile_approx("_h", shares, exact)).collect():
            parts = min(n, -(-hot[k] * n // total))
            begin += [(k, x) for x in {least, *(h[n * i // parts] for i in range(1, parts))}]

    @F.pandas_udf(T.IntegerType())
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, k.to_numpy(np.int64), "right").astype(np.int32))

    others = keyed.where(~F.col("_k").isin(list(hot))) if hot else keyed
    begin += [(r.k, FIRST) for r in others.groupBy(part("_k").alias("part")).agg(F.min("_k").alias("k")).collect()]
    begin.sort()
    return np.array([k for k, _ in begin], np.int64), np.array([h for _, h in begin], np.int64)


def ranges(k: np.ndarray, h: np.ndarray, bounds_k: np.ndarray, bounds_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (k, h) the range that they lie in, and whether they are the row at which it begins."""
    left, right = np.searchsorted(bounds_k, k, "left"), np.searchsorted(bounds_k, k, "right")
    at, first = right.copy(), right > left
    cut = np.flatnonzero(first & (bounds_h[np.minimum(left, max(0, len(bounds_h) - 1))] != FIRST)) if len(bounds_h) else np.zeros(0, np.int64)
    for value in np.unique(k[cut]):
        rows = cut[k[cut] == value]
        a, b = left[rows[0]], right[rows[0]]
        at[rows] = a + np.searchsorted(bounds_h[a:b], h[rows], "right")
        first[rows] = np.isin(h[rows], bounds_h[a:b])
    return at.astype(np.int32), first


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """run(batch of (doc_id, text, following text)) over docs in ascending doc_id, in ranges as many as docs has splits, one a task.

    A range ends with a copy of the next range's first row (the last one's with the very first), so no task waits for another.
    """
    n = n_splits(docs)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LAST)).alias("_k")).withColumn("_h", F.shiftrightunsigned(F.xxhash64("text"), 12))
    begin_k, begin_h = cuts(keyed, n)
    bounds_k, bounds_h = begin_k[1:], begin_h[1:]

    @F.pandas_udf(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("first", T.BooleanType())]))
    def ranged(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        at, first = ranges(k.to_numpy(np.int64), h.to_numpy(np.int64), bounds_k, bounds_h)
        return pd.DataFrame({"b": at, "first": first})

    own = keyed.withColumn("_r", ranged("_k", "_h"))
    low = [*zip(begin_k.tolist(), begin_h.tolist(), strict=True)][:1]
    very_first = F.lit(False) if not low else (F.col("_k") == low[0][0]) & ((F.col("_h") == low[0][1]) | F.lit(low[0][1] == FIRST))
    here = F.struct(F.col("_r.b").alias("b"), F.lit(0).alias("tail"))
    ends = lambda b: F.array(here, F.struct(b.cast("int").alias("b"), F.lit(1).alias("tail")))
    to = F.when(very_first, ends(F.lit(len(bounds_k)))).when(F.col("_r.first"), ends(F.col("_r.b") - 1)).otherwise(F.array(here))
    dealt = own.select("doc_id", "text", "_k", "_h", F.explode(to).alias("_to")).select("doc_id", "text", "_k", "_h", "_to.b", "_to.tail").repartitionById(len(bounds_k) + 1, "b").sortWithinPartitions("b", "tail", "_k", "_h", "text").drop("_k", "_h")

    def paired(batches):
        held = None
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "b", "tail")], strict=True))
            out, size = [], 0
            for row in rows:
                if held and held[2] == row[2] and not held[3]:
                    out.append((held[0], held[1], row[1]))
                    size += len(held[1]) + len(row[1])
                    if size > 3_000_000:
                        yield run(out)
                        out, size = [], 0
                held = row
            if out:
                yield run(out)

    return dealt.mapInArrow(paired, schema)


def _edited(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, following = (list(x) for x in zip(*rows, strict=True))
    n = [len(t) for t in texts]
    edited = [t[: k - k // 4] + f[: k // 4] for t, f, k in zip(texts, following, n, strict=True)]
    mine, changed, other = (fingerprints(x) for x in (texts, edited, following))
    show = lambda x: pa.array([f"{v:016x}" for v in x.tolist()], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), show(mine), show(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, other)), pa.array(mine.view(np.int64))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bits"],
    )


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and bits (the fingerprint as a long)."""
    return with_next(docs, _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bits long")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query bits, index bits) with at most `radius` different bits, once each; both inputs have a column bits, distinct.

    A pair is reported by the first table whose two blocks agree in it. The merge hint is for the exploded tables, whose size the optimiser underrates.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = lambda x, i: F.shiftrightunsigned(x, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    pairs = list(combinations(range(n), 2))

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i * n + j).alias("t"), F.shiftleft(block(F.col("bits"), i), 32).bitwiseOR(block(F.col("bits"), j)).alias("k")) for i, j in pairs])
        return df.select(F.col("bits").alias(name), F.explode(keys).alias("_e")).select(name, "_e.t", "_e.k")

    differ = F.col("query").bitwiseXOR(F.col("match"))
    same: list[Column] = [block(differ, i) == 0 for i in range(n)]
    first = F.lit(None)
    for i, j in reversed(pairs):
        first = F.when(same[i] & same[j], F.lit(i * n + j)).otherwise(first)
    return tables(queries, "query").join(tables(index, "match").hint("merge"), ["t", "k"]).where((F.bit_count(differ) <= radius) & (F.col("t") == first)).select("query", "match")


def searched(docs: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """simhash(docs) without bits, and n_within_radius (long): other rows within RADIUS, null for documents that are no queries."""
    prints = stash(simhash(docs), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % step == 0, F.lit(False))
    asked = prints.where(asks)
    # written, so that a fingerprint of very many rows is a skewed key which joins split
    index = stash(prints.groupBy("bits").agg(F.count("*").alias("_n")), "fingerprint-index")
    found = stash(within_radius(asked.select("bits").distinct(), index.select("bits")), "fingerprint-pairs")
    near = found.join(index.withColumnRenamed("bits", "match"), "match").groupBy(F.col("query").alias("bits")).agg(F.sum("_n").alias("_all"))
    counted = asked.join(stash(near, "fingerprint-counts"), "bits", "left").withColumn("n_within_radius", F.col("_all") - 1).select(*prints.columns, "n_within_radius")
    others = prints.where(~asks).withColumn("n_within_radius", F.lit(None).cast("long"))
    return counted.unionByName(others).drop("bits")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return searched(table(spark, sf_dir, "documents"))
