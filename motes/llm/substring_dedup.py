"""Removal of repeated passages: runs of `width` words that also start in a document with a smaller doc_id.

Difference cover: the residues {0, 1, 3} modulo 7 hold every difference modulo 7. So two equal 13-word windows, wherever they
start, have a common offset below 7 at which both stand on a cover position, and the 7 words there, an aligned anchor, lie
inside both. Anchors are hashed at cover positions only (3 of 7); those that two documents share are extended to all
windows around them, which are compared by 96 bits.

Hashes are dealt to buckets whose number follows the input's. A map task sends one representative for a hash that
several of its own documents hold (the smallest doc_id's), and settles the others itself; those go to buckets by their doc_id.
So what reaches a bucket for one hash is bounded by the number of units of text (UNIT_BYTES each), not by the number of documents.

Defined results: null and empty texts have no words; texts shorter than the window lose nothing; a window repeated inside one
document only stays; rows that repeat a doc_id count as one document; a null doc_id loses nothing and is no one's source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEEDS, mix, n_splits, place, units, windows, word_hashes

#: Residues that hold every difference modulo PERIOD (fixed values of a perfect difference set).
COVER, PERIOD = (0, 1, 3), 7
WIDTH = 13
_SENT = "bucket int, known boolean, n int, least long, h binary, doc binary, pos binary"


def _bytes(x: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in x]


def _send(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, later_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets. later_only: a hash's smallest doc is not settled by others that hold it."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    last = doc[np.append(np.flatnonzero(new)[1:], len(doc)) - 1][np.cumsum(new) - 1]
    settled = doc != first if later_only else first != last
    travels = (doc == first) & (new | (first == last) | later_only)
    rows = []
    for known, at in ((True, np.flatnonzero(settled)), (False, np.flatnonzero(travels))):
        key = ((mix(doc[at].astype(np.uint64)) if known else h1[at]) % np.uint64(buckets)).astype(np.int64)
        at = at[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(key)) + 1):
            if len(part):
                i = at[part]
                least = int(doc[i].min())
                rows.append((int(key[part[0]]), known, len(i), least, b"" if known else _pack(h1[i], h2[i], later_only), _small(doc[i] - least), _small(pos[i])))
    if rows:
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "known", "n", "least", "h", "doc", "pos"])


def _small(x: np.ndarray) -> bytes:
    """The values in as few bytes each as hold the largest."""
    top = int(x.max())
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _pack(h1: np.ndarray, h2: np.ndarray, whole: bool) -> bytes:
    """Hashes for the shuffle: 96 bits of a window that decides, 48 of an anchor, where an accidental match only adds work."""
    if whole:
        return h1.tobytes() + (h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
    return (h1 & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((h1 >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(h: bytes, n: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    if whole:
        return np.frombuffer(h, np.uint64, n), np.frombuffer(h, np.uint32, n, 8 * n)
    return np.frombuffer(h, np.uint32, n).astype(np.uint64) | (np.frombuffer(h, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)), np.zeros(n, np.uint32)


def _anchors(buckets: int, anchor: int):
    def run(batches):
        for unit in units(batches):
            (h,), owner = word_hashes(_bytes(unit["text"]))
            key, at = windows(h, owner, anchor)
            pos = place(owner)[at]
            held = np.isin(pos % PERIOD, COVER)
            key, at, pos = key[held], at[held], pos[held]
            if len(key):
                yield from _send(key, np.zeros(len(key), np.uint64), np.array(unit["doc_id"], np.int64)[owner[at]], pos, buckets, False)

    return run


def _extended(buckets: int, width: int, anchor: int):
    def run(batches):
        for unit in units(batches):
            if all(found is None for found in unit["found"]):
                continue
            (h1, h2), owner = word_hashes(_bytes(unit["text"]), SEEDS)
            a, at = windows(h1, owner, width)
            b, _ = windows(h2, owner, width)
            if not len(at):
                continue
            ids = np.array([-1 if d is None else d for d in unit["doc_id"]], np.int64)  # without an id nothing is found
            begin = np.searchsorted(owner, np.arange(len(unit["text"])))
            marked = np.zeros(len(h1) + width, np.int64)
            for i, found in enumerate(unit["found"]):
                if found is not None:
                    marked[begin[i] + np.asarray(found, np.int64)] = 1
            seen = np.concatenate(([0], np.cumsum(marked)))
            near = seen[at + width - anchor + 1] > seen[at]  # an anchor starts at one of the window's first width - anchor + 1 words
            a, b, at = a[near], b[near], at[near]
            if len(at):
                yield from _send(a, b, ids[owner[at]], place(owner)[at], buckets, True)

    return run


def _settle(later_only: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = lambda r: (np.frombuffer(r.doc, f"<u{len(r.doc) // r.n}").astype(np.int64) + r.least, np.frombuffer(r.pos, f"<u{len(r.pos) // r.n}").astype(np.int64))
        join = lambda rows: tuple(np.concatenate(x) for x in zip(*map(wide, rows.itertuples()), strict=True)) if len(rows) else (np.zeros(0, np.int64),) * 2
        sent = pdf[~pdf.known]
        doc, pos = join(sent)
        if len(doc):
            h1, h2 = (np.concatenate(x) for x in zip(*[_unpack(r.h, r.n, later_only) for r in sent.itertuples()], strict=True))
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            starts = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            count = np.diff(np.append(starts, len(doc)))
            first = np.repeat(doc[starts], count)
            settled = doc != first if later_only else first != np.repeat(doc[starts + count - 1], count)
            doc, pos = doc[settled], pos[settled]
        known = join(pdf[pdf.known])
        out = pd.DataFrame({"doc_id": np.concatenate([doc, known[0]]), "pos": np.concatenate([pos, known[1]])})
        return out.drop_duplicates()

    return run


def _cut(width: int, keep_text: bool):
    def run(batches):
        for unit in units(batches):
            out = []
            for text, found in zip(unit["text"], unit["found"], strict=True):
                words = (text or "").encode().split()  # exactly the six separators
                n = len(words)
                if found is not None and n >= width:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.asarray(found, np.int64), 1)
                    np.add.at(edge, np.asarray(found, np.int64) + width, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            n, gone, sha, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(unit["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_sha256 and kept (the words that stay, joined by one space) for docs(doc_id, text)."""
    if width < PERIOD + 1:
        raise ValueError(f"width must be over {PERIOD}")
    anchor = width - PERIOD + 1
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id is not null")
    buckets = 4 * n_splits(docs)
    gather = lambda sent, later: sent.groupBy("bucket").applyInPandas(_settle(later), "doc_id long, pos int").groupBy("doc_id").agg(F.collect_set("pos").alias("found"))
    shared = gather(named.mapInArrow(_anchors(buckets, anchor), _SENT), False)
    # both joins read one shuffle of the texts: the same columns, rows and join type
    windows_ = docs.join(shared.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_extended(buckets, width, anchor), _SENT)
    return docs.join(gather(windows_, True).hint("shuffle_hash"), "doc_id", "left").mapInArrow(_cut(width, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: The same in DuckDB: every window of every text, grouped as a whole.
ORACLE = r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), starts as (
  select doc_id, w, unnest(range(greatest(len(w) - 12, 0))) as i from words
), windows as (
  select doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') as t from starts
), firsts as (
  select doc_id, i, min(doc_id) over (partition by t) as first from windows
), covered as (
  select distinct doc_id, i + unnest(range(13)) as p from firsts where first < doc_id
), gone as (
  select doc_id, list(p) as ps from covered group by doc_id
), kept as (
  select words.doc_id, w, list_filter(range(len(w)), lambda p: not list_contains(coalesce(ps, []), p)) as k from words left join gone on words.doc_id = gone.doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - len(k))::bigint as n_removed, sha256(array_to_string(list_transform(k, lambda p: w[p + 1]), ' ')) as kept_sha256 from kept
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
