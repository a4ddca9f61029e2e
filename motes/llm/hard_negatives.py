"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Anchors are a stated set of rows. An anchor's positives are its `positives` best other rows of the same label by integer inner product; for each positive
with score p, its negatives are the `negatives` best rows of other labels whose score n satisfies 30 p <= 100 n <= 90 p. Ties go to the smaller vec_id.

Rows are dealt into groups of bounded size by a row number, anchors into chunks of bounded size, and each pair of a group and a chunk is a task of its
own. A task sorts its rows once in every dimension. For an anchor, each list is read from the end that the sign of the anchor's component asks for,
the same depth in all lists; rows seen for the first time are scored whole, in exact integers, and the sum over dimensions of component times the last value
read bounds every row not yet seen. Reading stops once that bound is strictly below the last score kept in each window (below the window's lower end while it
has room), or when no row is left. What the groups keep is merged by ranks for each anchor and positive, so no task holds an anchor's scores of all rows.

Defined results: rows with a null label, vec_id or vector, with a null or non-finite component or one beyond vectors.LIMIT take no part; rows meet only rows with
as many components; a row is no candidate for an anchor with its own vec_id; rows that repeat a vec_id are rows each, and a repeated anchor
repeats its result; rows that tie in score and vec_id are equal in the result; a positive below 0 has an empty window; an anchor without positives or
a positive without negatives gives no row; an empty table gives none. Columns other than the three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table
from .vectors import packed_vectors, unpacked

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
#: Shares of the positive's score, in percent.
LOW, HIGH = 30, 90
#: Most rows of a group and most anchors of a chunk: what one task holds. A group has fewer rows where that keeps all cores busy, but not below LEAST_ROWS.
GROUP_ROWS = 1 << 17
LEAST_ROWS = 1 << 12
CHUNK_ROWS = 1 << 13
NEVER = 1 << 62


class Lists:
    """Rows with a list for each dimension that sorts them by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.most = int(np.abs(vectors).max(initial=1))
        self.doubles = vectors.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while every sum stays below 2**53, else in 64-bit integers."""
        if anchor.size * self.most * int(np.abs(anchor).max(initial=0)) < 1 << 53:
            return (self.doubles[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def search(self, anchor: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, k: int, other_than: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low <= score <= high: ids and scores of its k best rows, best first, without the id `own` and the label `other_than`."""
        n = len(self.ids)
        used = np.flatnonzero(anchor)
        a, down = anchor[used], anchor[used] > 0
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, most = low.copy(), high.max(initial=-NEVER)
        begin = end = np.zeros(len(low), np.int64)
        depth, step = 0, max(16, n // 64)
        while depth < n and len(low):
            last = min(n, depth + step)
            mark = np.zeros(n, bool)
            mark[self.up[used[down], n - last : n - depth]] = True
            mark[self.up[used[~down], depth:last]] = True
            if not len(used):  # every score is 0, and no list tells rows apart
                mark[:] = True
            new = np.flatnonzero(mark & ~seen)
            seen |= mark
            got = self.scores(new, anchor)
            near = (got >= floor.min()) & (got <= most) & (self.ids[new] != own)
            if other_than is not None:
                near &= self.labels[new] != other_than
            ids, scores = np.concatenate([ids, self.ids[new[near]]]), np.concatenate([scores, got[near]])
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            begin = np.searchsorted(-scores, -high, "left")
            end = np.maximum(begin, np.minimum(begin + k, np.searchsorted(-scores, -low, "right")))
            full = end - begin >= k
            floor[full] = scores[end[full] - 1]
            depth, step = last, 2 * step
            edge = np.where(down, self.vectors[self.up[used, n - depth], used], self.vectors[self.up[used, depth - 1], used])
            if seen.all() or (int((a * edge).sum()) < floor).all():
                break
        return [(ids[b:e], scores[b:e]) for b, e in zip(begin, end, strict=True)]


def window(score: int) -> tuple[int, int]:
    """The scores n with LOW * score <= 100 * n <= HIGH * score, as the least and the most."""
    return -(-LOW * score // 100), HIGH * score // 100


def _prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label and packed vector of the rows that take part, and their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors = packed_vectors(batch.column("embedding"))
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), vectors], names=["vec_id", "label", "v"])

    known = rows.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    # written, so that the row numbers stay the same whoever reads them
    return stash(known.mapInArrow(run, "vec_id long, label long, v binary").withColumn("n", F.monotonically_increasing_id()), "vectors")


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, chunks: int, k: int) -> DataFrame:
    """The k best rows of each window in each group: anchor (its n), anchor_id, w (place of the positive), positive_id, positive_score, vec_id, score.

    rows has d and g, anchors d and c. Where anchors have a column p (positives as structs s, negated score, and vec_id), each positive has a window among
    other labels; else the only window is all scores of the anchor's own label.
    """
    names = ["anchor", "anchor_id", "w", "positive_id", "positive_score", "vec_id", "score"]
    same = "p" not in anchors.columns

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, labels, vectors = left["vec_id"].to_numpy(np.int64), left["label"].to_numpy(np.int64), unpacked(left["v"])
            all_lists = None if same else Lists(ids, labels, vectors)
            for label, own in right.groupby("label"):
                at = np.flatnonzero(labels == label) if same else None
                lists = Lists(ids[at], labels[at], vectors[at]) if same else all_lists
                points = unpacked(own["v"])
                for point, n, vec_id, p in zip(points, own["n"], own["vec_id"], [None] * len(own) if same else own["p"], strict=True):
                    given = [(0, -NEVER, NEVER)] if same else [(x["vec_id"], *window(-x["s"])) for x in p]
                    low, high = (np.array([x[i] for x in given], np.int64) for i in (1, 2))
                    found = lists.search(point, vec_id, low, high, k, None if same else label)
                    for w, (i, s) in enumerate(found):
                        out.append((np.full((len(i), 5), (n, vec_id, w, given[w][0], 0 if same else -p[w]["s"])), i, s))
        if not out:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        keys, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame(dict(zip(names, [*keys.T, i, s], strict=True)))

    spread = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = spread(rows.select("d", "g", "vec_id", "label", "v"), chunks, "c").groupBy("d", "g", "c")
    # aliases: both sides come from one table, and a cogroup tells columns apart by their identity
    named = [F.col(c).alias(c) for c in ("d", "c", "n", "vec_id", "label", "v", *([] if same else ["p"]))]
    right = spread(anchors.select(*named), groups, "g").groupBy("d", "g", "c")
    found = left.cogroup(right).applyInPandas(run, ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows with vec_id, label and embedding."""
    held = _prepared(rows)
    is_anchor = F.col("vec_id") % anchor_step == 0
    n_rows, n_anchors = held.agg(F.count("*"), F.count_if(is_anchor)).first()
    cores = held.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_rows // group_rows), min(2 * cores, n_rows // LEAST_ROWS))
    chunks = max(1, -(-n_anchors // CHUNK_ROWS))
    dealt = held.withColumn("d", F.length("v")).withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int"))
    anchors = dealt.where(is_anchor).withColumn("c", F.pmod(F.xxhash64("n", F.lit("c")), F.lit(chunks)).cast("int"))
    near = _searched(dealt, anchors, groups, chunks, positives)
    # the positives in order: score descending, then vec_id
    ranked = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("p"))
    asked = stash(anchors.join(ranked, F.col("n") == F.col("anchor")).select(*anchors.columns, "p"), "anchors")
    found = _searched(dealt, asked, groups, chunks, negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose vec_id 7 divides get the next label of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def query(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
