"""Mixing of sources to target weights by a low-discrepancy schedule.

Every source has a weight; its target is its share of all words, at most `epochs` times its own words, the excess going to
the other sources by weight. The mix is a row of equal slots of `block` words. A slot is a point of the van der Corput
sequence: the bit-reversed position falls into a source's share of the cumulative weights, so that every stretch of the
mix holds the sources in their proportions. A slot's rank among its source's slots names a block of the source's text:
the source's documents in the order of md5(doc_id|md5(text)), repeated `epochs` times, cut every `block` words. Both ranks and running
sums work in hash buckets first and then over bucket totals, so no task sees a whole source.

Defined results: a null text has 0 words; null is a source of its own, the last; documents without words are never
taken; an empty table gives an empty mix. Rows without doc_id, and rows that share one, are rows each and are dealt by their texts; only rows equal in
both meet in one task, and which of those stands first does not show but in other columns. Other columns named as a result give way to it. Per source only totals
meet in one task: one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_splits, packed, stash, word_count

EPOCHS = 3
#: Slots for each document, on average.
SLOTS = 8


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of sizes(source, size): source, sid (rank by code point, null last), weight, source_size, target, capped.

    Water filling in closed form: by rising ratio of limit to weight, sources are at their limit while that ratio
    is at most the level which the rest would get.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = by_source.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", (F.col("sid") % 3 + 1).cast("long")).withColumn("_limit", F.col("source_size") * epochs)
    filling = Window.orderBy(F.col("_limit") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = ranked.withColumn("_rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(filling), F.lit(0))).withColumn("_share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
    held = rest.withColumn("capped", F.col("_limit") * F.col("_share") <= F.col("_rest") * F.col("weight"))
    free = lambda c: F.min(F.when(~F.col("capped"), F.struct(F.col("_limit") / F.col("weight"), "sid", c))).over(whole)[c]
    level = free("_rest").cast("double") / free("_share")
    return held.select("source", "sid", "weight", "source_size", F.when(F.col("capped"), F.col("_limit").cast("double")).otherwise(level * F.col("weight")).alias("target"), "capped")


def running(df: DataFrame, key: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows before this one, by (bucket, order) within key: inside buckets, plus the totals of earlier buckets.

    Rows may come from generators, whose size the optimiser underrates; the merge hint keeps it from broadcasting them.
    """
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(key, bucket).agg(F.sum(value).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base.hint("merge"), [key, bucket]).withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base")


def reverse_bits(x: Column, bits: int) -> Column:
    """x with its `bits` lowest bits in reverse order, in whole-stage code."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(shares: DataFrame, block: int, n_slots: int, buckets: int) -> DataFrame:
    """The mix as slots: sid, slot (position in the mix, rising but not dense), rank (among the source's slots). shares: sid, need (slots).

    Ranks are taken in 2 ** buckets stretches of the mix.
    """
    bits = max(12, n_slots.bit_length())
    end = F.sum("need").over(Window.orderBy("sid"))
    # a source's points are the integers of its share; runs of them keep every generated array short
    runs = shares.where("need > 0").withColumn("_end", end).withColumn("_from", F.col("_end") - F.col("need")).withColumn("_run", F.explode(F.sequence(F.shiftright("_from", 12), F.shiftright(F.col("_end") - 1, 12)))).repartition("_run")
    low, high = F.greatest("_from", F.shiftleft("_run", 12)), F.least(F.col("_end"), F.shiftleft(F.col("_run") + 1, 12)) - 1
    points = runs.select("sid", F.explode(F.sequence(low, high)).alias("_v")).select("sid", reverse_bits(F.col("_v"), bits).alias("slot"))
    return running(points.withColumn("_b", F.shiftright("slot", max(0, bits - buckets))), "sid", "_b", ["slot"], F.lit(1), "rank").select("sid", "slot", "rank")


def mix(docs: DataFrame, epochs: int = EPOCHS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(sized, pieces) of docs(doc_id, source, text, _rest). sized: docs' columns but text, and size, sid, source_size, target, _start (words of the source before it).

    pieces: one row for each document's part of a slot: sid, slot, _start, words, epoch; ordered by slot they are the mix.
    """
    sizes = stash(docs.withColumn("size", word_count("text")).withColumn("_md5", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5("text"), F.lit(""))))).drop("text"), "mix-sizes")
    total, n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = max(1, -(-total // max(1, n * slots)))
    shares = stash(targets(sizes, epochs).withColumn("_words", F.round("target").cast("long")).withColumn("need", F.ceil(F.col("_words") / block)), "mix-shares")
    digits = max(2, -(-(64 * n_splits(docs)).bit_length() // 4))  # of md5, in hexadecimal: some 64 buckets for each split of the input
    n_slots = shares.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    named = sizes.join(shares, sizes["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    sized = running(named.withColumn("_b", F.conv(F.substring("_md5", 1, digits), 16, 10).cast("long")), "sid", "_b", ["_md5", "size"], F.col("size"), "_start")
    offset = lambda e: F.col("_start") + e * F.col("source_size")
    spans = sized.where("size > 0").select("sid", "_start", "size", "source_size", "_words", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch")).withColumn("_a", offset(F.col("epoch"))).withColumn("_z", F.least(F.col("_a") + F.col("size"), "_words")).where("_a < _z")
    parts = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_z") - 1) / block))))
    words = F.least("_z", (F.col("rank") + 1) * block) - F.greatest("_a", F.col("rank") * block)
    pieces = parts.select("sid", "rank", "_start", "epoch", words.alias("words")).join(schedule(shares.select("sid", "need"), block, n_slots, 4 * digits).hint("merge"), ["sid", "rank"])
    return sized, pieces


def mixed(docs: DataFrame, epochs: int = EPOCHS, slots: int = SLOTS) -> DataFrame:
    """docs' columns but text, and size, source_size, target, taken (words that the mix takes, repeats counted), first_slot (null: not taken)."""
    docs, rest = packed(docs, ["doc_id", "source", "text"], ["size", "source_size", "target", "taken", "first_slot"])
    sized, pieces = mix(docs, epochs, slots)
    taken = pieces.groupBy("sid", "_start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    some = sized.where("size > 0").join(taken, ["sid", "_start"], "left")
    return some.unionByName(sized.where("size = 0").withColumns({"taken": F.lit(None).cast("long"), "first_slot": F.lit(None).cast("long")})).select("doc_id", "source", *rest, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


#: The same in DuckDB: a document's first slot is the one of its source whose rank is that of its first word's block.
ORACLE = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || '|' || coalesce(md5(text), '')) as h from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sizes group by source
), ranked as (
  select *, (row_number() over (order by source is null, encode(source)) - 1) as sid from by_source
), weighed as (
  select *, (sid % 3 + 1) as weight, source_size * 3 as lim from ranked
), filling as (
  select *, sum(source_size) over () - coalesce(sum(lim) over (order by lim / weight, sid rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over (order by lim / weight, sid rows between unbounded preceding and 1 preceding), 0) as share from weighed
), level as (
  select rest::double / share as level from filling where not (lim * share <= rest * weight) order by lim / weight, sid limit 1
), goal as (
  select source, sid, source_size, case when lim * share <= rest * weight then lim::double else (select level from level) * weight end as target from filling
), placed as (
  select s.doc_id, s.size, g.sid, g.source_size, g.target, round(g.target)::bigint as words,
    coalesce(sum(s.size) over (partition by g.sid order by s.h, s.size rows between unbounded preceding and 1 preceding), 0) as a
  from sizes s join goal g on s.source is not distinct from g.source
), block as (
  select greatest(1, ceil(coalesce(sum(size), 0) / greatest(1, count(*) * 8)))::bigint as block from sizes
), need as (
  select sid, ceil(round(target)::bigint / block)::bigint as need, sum(ceil(round(target)::bigint / block)::bigint) over (order by sid) as stop from goal, block
), bits as (
  select greatest(12, length(bin(sum(need)::bigint))) as bits from need
), slots as (
  select sid, list_sum(list_transform(range(bits), lambda i: ((v >> i) & 1) << (bits - 1 - i)))::bigint as slot from (select sid, unnest(range((stop - need)::bigint, stop::bigint)) as v from need where need > 0), bits
), schedule as (
  select sid, slot, row_number() over (partition by sid order by slot) - 1 as rank from slots
), taken as (
  select *,
  (greatest(0, least(a + size, words) - a) + greatest(0, least(a + size + source_size, words) - a - source_size) + greatest(0, least(a + size + 2 * source_size, words) - a - 2 * source_size))::bigint as taken
  from placed
)
select doc_id, size, source_size, target, taken, coalesce(slot, -1)::bigint as first_slot
from taken t cross join block left join schedule s on s.sid = t.sid and s.rank = t.a // block and t.taken > 0
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))
