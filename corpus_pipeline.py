"""A corpus pipeline: five stages, each an operator of motes.llm on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages run() writes Parquet in the shared folder and rereads it. All stages but
the last return the columns of documents. A null text passes through toxicity, line dedup, near-dedup and
decontamination as an empty one; the mix never takes it. Rows that repeat a doc_id, or have none, are rows each; of equal texts near-dedup keeps one, the smallest id
first, and rows equal in id and text are interchangeable to the mix; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm import decontaminate as decontamination
from motes.llm import line_dedup as lines
from motes.llm import mixing, near_dedup, toxicity
from motes.llm.common import discard, packed, stash, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    held, rest = packed(docs, ["doc_id", "text"], [])
    held = held.withColumnRenamed("_rest", "held")
    scored = toxicity.toxicity(held, table(spark, sf_dir, "labels")).where("predicted = 0")
    return scored.withColumnRenamed("held", "_rest").select("doc_id", "text", *rest).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines, n_chars following; documents that lost all they had go."""
    held, rest = packed(docs, ["doc_id", "text"], [])
    # written first: a filter on computed texts would be pushed down and compute them once more inside itself
    out = stash(lines.line_dedup(held.withColumnRenamed("_rest", "held")), "lines").where((F.col("n_removed_lines") == 0) | (F.col("text") != ""))
    out = out.withColumnRenamed("held", "_rest").select("doc_id", "text", *rest, F.col("n_removed_lines").alias("__gone"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    held, rest = packed(docs, ["doc_id", "text"], [])
    out = decontamination.decontaminate(held.withColumnRenamed("_rest", "held"), table(spark, sf_dir, "benchmark")).where("not contaminated")
    return out.withColumnRenamed("held", "_rest").select("doc_id", "text", *rest).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with size, source_size, target, taken (words, repeats counted) and first_slot (order of the mix).

    Rows are told apart by a key of their own, so null and repeated doc_ids are rows like any other.
    """
    made = ("size", "source_size", "target", "taken", "first_slot")
    # written, so that the keys stay the same on both ways
    keyed = stash(docs.drop(*made).withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.mixed(keyed.select("doc_id", "source", "text", "__row")).where("taken > 0").select("__row", *made)
    return keyed.join(taken, "__row").drop("__row")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The learned lexicon and exact near-duplicate classes are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote for itself, and its input, are deleted once its output is written; the last stage's remain, since it is returned unread."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with written() as folders:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, [*before, *folders[:-1]])
        before = folders[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
