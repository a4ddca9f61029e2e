"""Helpers shared by the text operators: tables, shared storage, tokens and vectorised hashes.

Words are runs of bytes other than space and U+0009..U+000D, unchanged. Hashes are polynomials modulo 2**64 over UTF-8
bytes, computed for whole batches with numpy, so the same text gives the same hash in every task and on every machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one unit of work inside a task, in bytes; bounds a Python worker's memory whatever the batch size.
UNIT_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a local session without one (as in tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="motes-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where stash notes the folders that it writes, while written() asks for them; each thread has its own.
_NOTES: ContextVar[list[str] | None] = ContextVar("notes", default=None)


@contextmanager
def written() -> Iterator[list[str]]:
    """The folders that stash writes in this thread meanwhile, in order, for those who know when they are no longer read (see discard)."""
    notes: list[str] = []
    token = _NOTES.set(notes)
    try:
        yield notes
    finally:
        _NOTES.reset(token)


def stash(df: DataFrame, tag: str, options: dict | None = None) -> DataFrame:
    """Write df to the shared folder (with a writer's options) and read it back: cuts the lineage and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    notes = _NOTES.get()
    if notes is not None:
        notes.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stashed folders, through the file system that holds them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame, used: list[str], made: list[str]) -> tuple[DataFrame, list]:
    """docs as its used columns and a struct _rest of the others, so that no name clashes with one an operator uses inside.

    Second, the columns that restore the others. Columns named as one that the operator makes give way to it.
    """
    rest = [c for c in docs.columns if c not in used and c not in made]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    struct = F.struct(*[F.col(quoted(c)) for c in rest]) if rest else F.lit(None).cast("struct<none:int>")
    return docs.select(*used, struct.alias("_rest")), [F.col("_rest").getField(c).alias(c) for c in rest]


def n_splits(df: DataFrame) -> int:
    """Number of input partitions: a measure of the input's size that needs no job."""
    return max(1, df.rdd.getNumPartitions())


def word_count(text) -> F.Column:
    """Number of words of a column, null counting as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def units(batches: Iterator, size: int = UNIT_BYTES) -> Iterator[dict[str, list]]:
    """Cut Arrow batches with a column `text` into column lists whose texts have about `size` bytes together."""
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        at, held = 0, 0
        for i, t in enumerate(columns["text"]):
            held += len(t) if t else 0
            if held >= size or i + 1 == batch.num_rows:
                yield {n: v[at : i + 1] for n, v in columns.items()}
                at, held = i + 1, 0


def slices(batches: Iterator, size: int = UNIT_BYTES) -> Iterator:
    """Arrow batches with a column `text` cut into batches whose texts have about `size` bytes together."""
    for batch in batches:
        text = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            begun = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begun + size, "right")))
            yield batch.slice(at, end - at)
            at = end


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SEEDS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number and of its inverse modulo 2**64."""
    if seed not in _POWERS or len(_POWERS[seed][0]) <= n:
        n = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[seed] = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64)))) for b in (seed, pow(seed, -1, 1 << 64)))
    return _POWERS[seed]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], seeds: tuple[int, ...] = SEEDS[:1]) -> tuple[list[np.ndarray], np.ndarray]:
    """A 64-bit hash of every word of every text, for each seed, and each word's index of text."""
    hashes: list[list[np.ndarray]] = [[] for _ in seeds]
    owners = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < 1_000_000):
            held += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]), np.uint8)
        gap = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = edge[0::2], edge[1::2]
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts[at : end - 1]])
        owners.append(np.searchsorted(firsts, start, "right") - 1 + at)
        for out, seed in zip(hashes, seeds, strict=True):
            up, down = _powers(seed, len(data) + 1)
            total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
            out.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    none = np.zeros(0, np.uint64)
    return [np.concatenate(h) if h else none for h in hashes], np.concatenate(owners).astype(np.int64) if owners else np.zeros(0, np.int64)


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words inside one text, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(width):
        total += hashes[j : n + j] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total[at]), at


def place(owner: np.ndarray) -> np.ndarray:
    """Index of each word within its text."""
    if not len(owner):
        return owner
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
