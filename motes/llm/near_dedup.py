"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is its distinct runs of five words (a shorter text is one run), each weighing 1 + ln(occurrences). For ProbMinHash each run sends
arrivals of a Poisson process with its weight as rate; an arrival picks one of ROWS * BANDS slots, and a slot keeps the
earliest. A run stops when its next arrival is later than every slot's earliest, so work ends early; two texts agree in a slot with
their probability Jaccard similarity. Slots are banded, candidates share a band, and links are pairs whose sets of runs have Jaccard similarity
of at least `similarity`, computed exactly. Where a text repeats runs, its weights differ and its probability Jaccard similarity may be far below
that of the sets; so such a text also has the bands of equal weights, and any two texts are compared at the similarity that links use.

Equal texts are one representative (the smallest doc_id) before anything else. In each band bucket every member is verified against
one leader, the member with the most bucket mates; so a bucket of k alike texts costs k comparisons. After connected components, texts
in buckets that still hold several classes are joined exactly, by a prefix filter on their rarest runs, so that no link
between candidates is lost.

Defined results: a text without words (null, empty) is a class of its own, also when repeated; a null doc_id has a null class (one row in
classes for each row of docs) and is no one's copy; rows that repeat doc_id and text are one document; an id with several texts is one for each,
and where it is the smallest id of several, the text with the smallest md5 stands for it. Extra columns of the input are ignored by near_duplicates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, packed, stash, units, windows, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair whose sets have similarity 0.8 shares a band of equal weights with probability 1 - (1 - 0.8 ** 8) ** 40 = 0.9994.
ROWS, BANDS = 8, 40


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, the index of their text (ascending), their weight."""
    (h,), owner = word_hashes([(t or "").encode() for t in texts])
    key, at = windows(h, owner, width)
    own = owner[at]
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(owner, short)
        whole = np.array([np.bitwise_xor.reduce(mix(h[b : b + count[s]] + np.arange(1, count[s] + 1, dtype=np.uint64))) for s, b in zip(short, begin, strict=True)], np.uint64)
        key, own = np.concatenate([key, whole]), np.concatenate([own, short])
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))) if len(key) else np.zeros(0, np.int64)
    return key[new], own[new], 1 + np.log(np.diff(np.append(new, len(key))))


def signatures(key: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """ProbMinHash: for each text and slot the shingle whose arrival came first."""
    best = np.full(n * slots, np.inf)
    sig = np.zeros(n * slots, np.uint64)
    time, stop = np.zeros(len(key)), np.full(n, np.inf)
    active, round_, step = np.arange(len(key)), 0, 1
    while len(active):
        clock = time[active]
        k, o, w = key[active], owner[active], weight[active]
        for _ in range(step):
            r = mix(k + np.uint64(round_ * 0x9E3779B97F4A7C15 % (1 << 64)))
            round_ += 1
            clock = clock - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
            hit = clock < stop[o]
            at = o[hit] * slots + (mix(r[hit] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(slots)).astype(np.int64)
            t = clock[hit]
            np.minimum.at(best, at, t)
            won = best[at] == t
            sig[at[won]] = k[hit][won]
        time[active] = clock
        seen = np.unique(o)
        stop[seen] = best.reshape(n, slots)[seen].max(axis=1)
        active = active[clock < stop[o]]
        step = min(64, step * 2)
    return sig.reshape(n, slots)


def band_keys(key: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, rows: int, bands: int) -> np.ndarray:
    """(n, bands): the hash of each band of a text's signature, different for different bands."""
    sig = signatures(key, owner, weight, n, rows * bands).reshape(n, bands, rows)
    total = np.zeros(sig.shape[:2], np.uint64)
    for i in range(rows):
        total = mix(total * np.uint64(31) + sig[:, :, i])
    return total ^ mix(np.arange(1, bands + 1, dtype=np.uint64))[None]


def _sign(rows: int, bands: int, width: int):
    def run(batches):
        for unit in units(batches, 3_000_000):
            texts = unit["text"]
            key, owner, weight = shingles(texts, width)
            n = np.bincount(owner, minlength=len(texts))
            total = np.zeros((len(texts), 2 * bands), np.uint64)
            total[:, :bands] = band_keys(key, owner, weight, len(texts), rows, bands)
            keep = np.zeros(total.shape, bool)
            keep[:, :bands] = (n > 0)[:, None]
            # texts without repeats have equal weights already, so their bands serve both comparisons
            uneven = np.zeros(len(texts), bool)
            uneven[owner[weight > 1]] = True
            again = np.flatnonzero(uneven)
            own = uneven[owner]
            flat = band_keys(key[own], np.searchsorted(again, owner[own]), np.ones(int(own.sum())), len(again), rows, bands)
            total[again, bands:] = flat
            keep[again, bands:] = flat != total[again, :bands]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep.sum(1)))), pa.int32()), pa.array(total[keep].view(np.int64)))
            digest = pa.array([hashlib.md5((t or "").encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(unit["doc_id"], pa.int64()), digest, pa.array(n, pa.int32()), lists], names=["doc_id", "digest", "n", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for unit in units(batches, 3_000_000):
            key, owner, _ = shingles(unit["text"], width)
            edge = np.searchsorted(owner, np.arange(len(unit["text"]) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(unit["doc_id"], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())], names=["id", "items"])

    return run


def _jaccard(batches):
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.sort(np.concatenate([x, y]), kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            out.append(same / max(1, len(both) - same))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, tag: str) -> DataFrame:
    """pairs(a, b) with their exact Jaccard similarity if it is at least `similarity`; each pair travels with one set at a time."""
    half = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    full = half.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")
    return stash(full.mapInArrow(_jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= similarity), tag)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each id's connected component, by neighbours' minima and pointer jumping, until nothing changes."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stash(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    label = stash(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).select("u", "l"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m")).join(label, "u").select("u", F.least("m", "l").alias("m"), F.col("l").alias("old"))
        jump = near.join(label.select(F.col("u").alias("m"), F.col("l").alias("j")), "m", "left").select("u", F.least("m", F.coalesce("j", "m")).alias("l"), "old")
        label = stash(jump, "labels")
        if label.where("l <> old").isEmpty():
            return label.select(F.col("u").alias("id"), F.col("l").alias("label"))
        label = label.drop("old")


def _listed(batches):
    for batch in batches:
        items = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("items")]
        at = np.repeat(np.arange(batch.num_rows), [len(x) for x in items])
        flat = np.concatenate(items) if items else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("id", "n", "label")], pa.array(flat)], names=["id", "n", "label", "item"])


def prefix_pairs(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of rows(id, n, label) with different labels that may reach the similarity, by the prefix filter.

    With shingles in one order, rarest first, two sets of n and m items with similarity t share one among the first n - ceil(t n) + 1 and
    m - ceil(t m) + 1. Texts of one family that changed too much start with shingles of their own, so they make no pair.
    """
    listed = stash(rows.join(sets, "id").mapInArrow(_listed, "id long, n int, label long, item long"), "items")
    count = listed.groupBy("item").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))
    first = listed.join(count, "item").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).where("df > 1")
    own = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("prefix"))
    first = stash(first.select("id", "n", "label", "item", "rank").join(own, "id"), "prefixes")
    other = first.select("item", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("rank").alias("place"), F.col("prefix").alias("theirs"))
    near = F.least("n", "m") >= similarity * F.greatest("n", "m")
    # what follows the first shared item bounds the overlap, which the similarity demands to be t / (1 + t) of both sizes
    enough = 1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    once = F.get(F.array_intersect("prefix", "theirs"), F.lit(0)) == F.col("item")
    return first.withColumnRenamed("id", "a").join(other, "item").where((F.col("label") < F.col("other")) & near & enough & once).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: doc_id, digest (md5 of the text), copy_of (smallest doc_id with the same text), class_id (smallest of its class).

    links: verified pairs a, b, jaccard between representatives of different texts.
    """
    nameless = docs.where("doc_id is null").select("doc_id", *[F.lit(None).cast(k).alias(c) for c, k in (("digest", "binary"), ("copy_of", "long"), ("class_id", "long"))])
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    signed = stash(docs.mapInArrow(_sign(rows, bands, width), "doc_id long, digest binary, n int, bands array<long>"), "signed")
    # written, so that a text of very many copies is a skewed key, which the join splits
    reps = stash(signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("copy_of")), "representatives")
    named = signed.where("n > 0").select("doc_id", "digest").join(reps, "digest")
    member = named.unionByName(signed.where("n = 0").select("doc_id", "digest", F.col("doc_id").alias("copy_of"))).distinct()
    own = reps.groupBy(F.col("copy_of").alias("doc_id")).agg(F.min("digest").alias("digest"))
    slot = signed.join(own, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("id"), "digest", "n", F.explode("bands").alias("key"))
    shared = slot.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    bucket = stash(slot.join(shared, "key"), "buckets")
    central = bucket.groupBy("id", "digest").agg(F.sum("mates").alias("s"))
    told = docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    sets = stash(told.join(central.select(F.col("id").alias("doc_id"), "digest").hint("shuffle_hash"), ["doc_id", "digest"], "left_semi").mapInArrow(_sets(width), "id long, items binary").dropDuplicates(["id"]), "sets")
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)  # noqa: E731  sizes that allow the similarity
    leader = bucket.join(central.drop("digest"), "id").groupBy("key").agg(F.max(F.struct("s", (-F.col("id")).alias("neg"), F.col("n").alias("m"))).alias("_l")).select("key", (-F.col("_l.neg")).alias("a"), F.col("_l.m").alias("m"))
    stars = bucket.join(leader, "key").where((F.col("id") != F.col("a")) & alike(F.col("n"), F.col("m"))).select("a", F.col("id").alias("b")).distinct()
    stars = stash(stars, "stars")
    first = verified(stars, sets, similarity, "links-1")
    label = components(first)
    parted = bucket.join(label, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    open_ = parted.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = stash(parted.join(open_, "key", "left_semi").select("id", "n", "label").distinct(), "open")
    rest = prefix_pairs(left, sets, similarity)
    tried = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = verified(rest.join(tried, ["a", "b"], "left_anti"), sets, similarity, "links-2")
    links = first.unionByName(second)
    final = components(links)
    classes = member.join(final, member["copy_of"] == final["id"], "left").select("doc_id", "digest", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))
    return classes.unionByName(nameless), links


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id; all columns and rows of the others stay."""
    classes, _ = near_duplicates(docs, **options)
    held, rest = packed(docs, ["doc_id", "text"], [])
    gone = classes.where("class_id < doc_id").select("doc_id", "digest").hint("shuffle_hash")
    kept = held.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).join(gone, ["doc_id", "digest"], "left_anti")
    return kept.select("doc_id", "text", *rest).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    classes, links = near_duplicates(table(spark, sf_dir, "documents"))
    ends = links.select(F.col("a").alias("copy_of")).unionByName(links.select(F.col("b").alias("copy_of"))).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    return classes.join(stash(ends, "link-counts"), "copy_of", "left").select("doc_id", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
