"""Removal of repeated runs of lines, with boundaries that depend on content only.

A text is cut at "\\n". Each line has a hash, a rolling hash covers three lines, and a chunk ends after every line whose
rolling hash is 0 modulo `modulus`; so an insertion moves boundaries near itself only. A chunk of at least `min_lines`
lines which occurs more than once in the corpus, byte for byte, stays where (doc_id, position) is smallest and goes elsewhere.

Defined results: a null text has no lines and stays null; an empty text is one empty line, never a multi-line chunk;
repeated doc_ids count as one document whose rows are cut alike; a null doc_id never loses lines and never keeps others from staying.
Columns besides doc_id and text pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stash

MODULUS = 4
MIN_LINES = 2
#: Of the rolling hash; 32-bit line hashes times these stay below 2**63.
FACTORS = (1, 31, 961)


def _chunked(docs: DataFrame, modulus: int) -> DataFrame:
    """Adds _chunks: array of (text, lines), in order."""
    line_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    return (
        docs.withColumn("_lines", F.split("text", "\n", -1))
        .withColumn("_h", F.transform("_lines", line_hash))
        .withColumn("_at", F.sequence(F.lit(0), F.size("_lines") - 1))
        .withColumn("_from", F.filter("_at", lambda i: (i == 0) | ((F.get("_h", i - 1) * FACTORS[0] + F.coalesce(F.get("_h", i - 2), F.lit(0)) * FACTORS[1] + F.coalesce(F.get("_h", i - 3), F.lit(0)) * FACTORS[2]) % modulus == 0)))
        .withColumn(
            "_chunks",
            F.transform(
                F.arrays_zip(F.col("_from").alias("a"), F.concat(F.slice("_from", 2, F.size("_from")), F.array(F.size("_lines"))).alias("b")),
                lambda s: F.struct(F.array_join(F.slice("_lines", s["a"] + 1, s["b"] - s["a"]), "\n", "").alias("text"), (s["b"] - s["a"]).alias("lines")),
            ),
        )
        .drop("_lines", "_h", "_at", "_from")
    )


def line_dedup(docs: DataFrame, modulus: int = MODULUS, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text replaced by what stays (kept chunks joined by "\\n"), and n_lines, n_chunks, n_removed_lines, n_removed_chunks (long).

    A hash per chunk finds the repeated ones; only those travel with their bytes. Both groupings combine before the
    shuffle. A chunk that a third of all documents hold is a skewed key of the joins with what was grouped; AQE splits such a
    key only where both sides are shuffled for the join, so the grouped side is written first.
    """
    docs, rest = packed(docs, ["doc_id", "text"], ["n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks"])
    chunks = (
        _chunked(docs.select("doc_id", "text").where("doc_id is not null"), modulus)
        .select("doc_id", F.posexplode_outer("_chunks").alias("_pos", "_chunk"))  # outer: else the optimiser adds a filter that computes the chunks once more
        .where(F.col("_chunk.lines") >= min_lines)
        .select("doc_id", "_pos", F.col("_chunk.text").alias("_text"), F.xxhash64("_chunk.text").alias("_key"))
    )
    repeated = chunks.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    repeated = stash(repeated, "line-keys")
    shared = stash(chunks.join(repeated, "_key", "left_semi"), "line-chunks")
    first = shared.groupBy("_key", "_text").agg(F.min(F.struct("doc_id", "_pos")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = stash(first, "line-firsts")
    later = shared.join(first, ["_key", "_text"]).where((F.col("doc_id") != F.col("_first.doc_id")) | (F.col("_pos") != F.col("_first._pos")))
    gone = later.groupBy("doc_id").agg(F.collect_set("_pos").alias("_gone"))
    out = _chunked(docs.join(gone.hint("shuffle_hash"), "doc_id", "left"), modulus)
    # array_except hashes, so a text of very many chunks takes time in proportion
    kept = F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), "_gone")
    stays = F.when(F.col("_gone").isNull(), F.col("_chunks")).otherwise(F.transform(kept, lambda i: F.get("_chunks", i)))
    total = lambda x: F.coalesce(F.aggregate(x, F.lit(0).cast("long"), lambda a, c: a + c["lines"]), F.lit(0)).cast("long")
    return (
        out.withColumn("_stays", stays)
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stays", lambda c: c["text"]), "\n", "")))
        .withColumn("n_lines", total("_chunks"))
        .withColumn("n_chunks", F.coalesce(F.size("_chunks"), F.lit(0)).cast("long"))
        .withColumn("n_removed_lines", F.col("n_lines") - total("_stays"))
        .withColumn("n_removed_chunks", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .select("doc_id", "text", *rest, "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks")
    )


#: The same in DuckDB; `documents` is a view.
ORACLE = """
with lines as (
  select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents
), hashed as (
  select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from lines
), rolled as (
  select *, coalesce(lag(h, 1) over w, 0) as h1, coalesce(lag(h, 2) over w, 0) as h2, coalesce(lag(h, 3) over w, 0) as h3 from hashed window w as (partition by doc_id order by i)
), cut as (
  select *, sum(case when i = 0 or (h1 + 31 * h2 + 961 * h3) % 4 = 0 then 1 else 0 end) over (partition by doc_id order by i) - 1 as pos from rolled
), chunks as (
  select doc_id, pos, string_agg(line, chr(10) order by i) as chunk, count(*) as lines from cut group by doc_id, pos
), ranked as (
  select *, row_number() over (partition by chunk, lines >= 2 order by doc_id, pos) as nth from chunks
), marked as (
  select *, lines >= 2 and nth > 1 as gone from ranked
)
select d.doc_id, coalesce(sum(m.lines), 0)::bigint as n_lines, count(m.pos)::bigint as n_chunks,
  coalesce(sum(case when gone then m.lines end), 0)::bigint as n_removed_lines, (count(*) filter (where gone))::bigint as n_removed_chunks,
  case when d.text is not null then sha256(coalesce(string_agg(case when not gone then chunk end, chr(10) order by pos), '')) end as kept_sha256
from documents d left join marked m on d.doc_id = m.doc_id group by d.doc_id, d.text
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
