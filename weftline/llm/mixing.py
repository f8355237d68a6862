"""Mixing sources to target weights: a splitting tree over blocks (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A word, as sizes count it.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of each source, output shards of the mix, and how often a document may be taken.
BLOCKS, SHARDS, REPEATS = 256, 16, 3
#: Slices of a shard that are shuffled apart when the mix is written out.
SLICES = 4096
WEIGHTS = (5.0, 2.0, 1.0)
#: Up to so many rows (sources times blocks) the plan is broadcast; beyond, it is joined by shuffle.
PLAN_ROWS = 200_000
#: Ranges of hashes in which tickets are ranked apart, and parts of the block that passes a source's target.
RANGES, PARTS = 1024, 4096
#: Columns that mix_documents and mixed_rows add.
MIXED, ROWS = ("size", "source_size", "target", "placed"), ("copy", "shard")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): shares by weight of all words, none above repeats times its source's words.

    Sources by code point, null last, take the weights in turn; only their names are numbered in one window. The targets are min(cap, level * weight): the
    level rises from that without caps, each time by what the sources that have reached their caps leave, until no other one reaches its cap.
    sizes: source, words (one row per source).
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    weighed = cut(weighed.withColumn("cap", F.lit(float(repeats)) * F.col("words")), "sources")
    level, full = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        left = F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight")))
        row = weighed.agg(F.sum(at_cap.cast("int")).alias("full"), F.sum("words").alias("all"), F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)).alias("caps"), left.alias("left")).first()
        if not row["left"] or row["full"] == full:
            break
        level, full = (row["all"] - row["caps"]) / row["left"], row["full"]
    return weighed.select("source", F.col("words").alias("source_size"), F.least("cap", F.lit(level) * F.col("weight") if row["left"] else F.col("cap")).alias("target"))


def split_tree(tickets: DataFrame, shards: int, seed: int) -> DataFrame:
    """Give each ticket (one draw of one block) a shard, by halving the shards again and again.

    At a node the tickets are permuted by hash and the first half's share goes left. What goes left of each source is then a
    draw without replacement: multivariate hypergeometric in the sources' quotas, and exact in sum at every node.
    A ticket's rank is its place in its range of hashes plus the ranges' counts before it, so no node is ranked in one task.
    tickets: one row per draw of a block, so sources times blocks times repeats at most.
    """
    now = tickets.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    for level in range(max(1, math.ceil(math.log2(shards)))):
        now = now.withColumn("h", F.xxhash64(F.lit(seed), F.lit(level), "source", "block", "round"))
        now = now.withColumn("range", F.floor(F.col("h") / (2**64 // RANGES)).cast("int"))
        counts = now.groupBy("lo", "range").agg(F.count("*").alias("n"))
        node = Window.partitionBy("lo")
        before = F.coalesce(F.sum("n").over(node.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(F.col("lo").alias("lo_"), F.col("range").alias("range_"), before.alias("before"), F.sum("n").over(node).alias("all"))
        now = now.withColumn("place", F.row_number().over(Window.partitionBy("lo", "range").orderBy("h", "source", "block", "round")))
        now = now.join(counts, (F.col("lo") == F.col("lo_")) & (F.col("range") == F.col("range_"))).drop("lo_", "range_")
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        share = F.round(F.col("all") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        now = now.withColumn("mid", mid).withColumn("left", F.col("before") + F.col("place") <= share).drop("before", "all", "place", "h", "range")
        now = now.withColumn("hi", F.when(F.col("left"), F.col("mid")).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("left"), F.col("lo")).otherwise(F.least("mid", F.col("hi") - 1))).drop("mid", "left")
    return now.withColumnRenamed("lo", "shard").drop("hi")


def _permuted(doc_id: Column, seed: int) -> Column:
    """A document's place in the permuted order of its source: its block is the first bits (PARTS of them in the block the next ones)."""
    return F.xxhash64(F.lit(seed), doc_id)


def mix_documents(docs: DataFrame, weights=WEIGHTS, seed: int = 42, shards: int = SHARDS, repeats: int = REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """docs with size, source_size, target and ``placed``: the shards that take the document, one entry per copy.

    A source's documents are permuted by hash into blocks. The mix takes all blocks of a source as many whole times as its target
    has its words; of the rest it takes whole blocks in permuted order and, of the block that would pass the target,
    documents in permuted order up to the nearest one. So a source's words miss its target by half a document
    at most, and no document is taken over ``repeats`` times. split_tree deals the drawn blocks over the shards;
    mixed_rows writes the copies out, shuffled within each shard.
    Words are counted twice, for the plan and for the result: joining them back would shuffle the texts.

    Null texts have size 0; a null source is a source; equal rows are dealt alike but counted each; documents of size 0
    go with their block; an empty table gives no rows; columns of docs that clash with the added ones are replaced, all others keep name and value.
    """
    base = docs.drop(*MIXED)
    key = _permuted(F.col("doc_id"), seed)
    ids = base.select(key.alias("key"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "doc_id", "source", words(F.col("text")).alias("size"))
    ids = cut(ids.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")), "sizes")
    held = cut(ids.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    targets = cut(source_targets(held.groupBy("source").agg(F.sum("words").alias("words")), weights, repeats), "targets")
    targets = targets.withColumnRenamed("source", "t_")
    plan = held.join(targets, F.col("source").eqNullSafe(F.col("t_"))).drop("t_")
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("int"))
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "source", "block"), "block")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plan = plan.withColumn("room", F.when(F.col("rounds") < repeats, rest - (upto - F.col("words"))).otherwise(0.0))
    plan = plan.withColumn("whole", (F.col("rounds") < repeats) & (F.col("room") >= F.col("words")) & (F.col("room") > 0))
    plan = cut(plan.withColumn("partial", ~F.col("whole") & (F.col("room") > 0)), "plan")
    draws = F.col("rounds") + (F.col("whole") | F.col("partial")).cast("int")
    tickets = plan.where(draws > 0).select("source", "block", F.explode(F.sequence(F.lit(1), draws)).alias("round"))
    dealt = split_tree(tickets, shards, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("round", "shard"))).alias("dealt")).withColumnsRenamed({"source": "s_", "block": "b_"})
    small = plan.join(dealt, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")), "left").drop("s_", "b_")
    small = cut(small.select(F.col("source").alias("s_"), F.col("block").alias("b_"), "source_size", "target", "rounds", "whole", "partial", "room", F.transform("dealt", lambda d: d["shard"]).alias("shards")), "dealt")
    # of a size known here: a row for each source and block, or for each source
    sent = F.broadcast if small.count() <= PLAN_ROWS else lambda df: df
    same = F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_"))

    # the block that passes the target, one per source: its parts in permuted order, and in the part that passes the target documents up to the nearest one
    passes = small.where("partial").select("s_", "b_", "room")
    inside = cut(ids.join(sent(passes), same).drop("s_", "b_").withColumn("part", F.pmod(F.floor(F.col("key") / blocks), F.lit(PARTS)).cast("int")), "edge_blocks")
    parts = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("begin", F.coalesce(F.sum("words").over(by_part), F.lit(0)))
    parts = cut(parts.select(F.col("source").alias("s_"), F.col("part").alias("b_"), "begin", (F.col("begin") + F.col("words") <= F.col("room")).alias("all"), (F.col("begin") < F.col("room")).alias("some")), "edge_parts")
    edge = inside.join(parts.where("some and not all"), F.col("source").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("b_"))).drop("s_", "b_")
    place = Window.partitionBy("source").orderBy("key", "doc_id", "crc")
    edge = edge.withColumn("upto", F.col("begin") + F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.where(F.col("upto") - F.col("size") / 2 <= F.col("room")).groupBy("source").agg(F.max(F.struct("key", "doc_id", "crc")).alias("last"))
    first = parts.groupBy("s_").agg(F.min(F.when(~F.col("all"), F.col("b_"))).alias("edge_part"))
    first = first.join(edge.withColumnRenamed("source", "e_"), F.col("s_").eqNullSafe(F.col("e_")), "left").select(F.col("s_").alias("p_"), "edge_part", "last")
    small = small.join(sent(first), F.col("partial") & F.col("s_").eqNullSafe(F.col("p_")), "left").drop("p_")

    mine = base.select(F.struct("*").alias("doc"), F.col("source"), words(F.col("text")).alias("n"), key.alias("key"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    mine = mine.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("part", F.pmod(F.floor(F.col("key") / blocks), F.lit(PARTS)).cast("int"))
    out = mine.join(sent(small), same, "left")
    upto_last = F.coalesce(F.struct("key", F.col("doc.doc_id").alias("doc_id"), "crc") <= F.col("last"), F.lit(False))
    inside_edge = F.col("edge_part").isNull() | (F.col("part") < F.col("edge_part")) | ((F.col("part") == F.col("edge_part")) & upto_last)
    copies = F.col("rounds") + (F.col("whole") | (F.col("partial") & inside_edge)).cast("int")
    placed = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.coalesce(copies, F.lit(0)))
    return out.select("doc.*", F.col("n").alias("size"), "source_size", "target", placed.alias("placed"))


def mixed_rows(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: a row for each copy with ``copy`` and its shard, in shuffled order within slices of a shard.

    A shard is dealt over SLICES slices by the order's own first bits, so that the tasks aren't bound to the number of shards. Documents that the mix
    doesn't take have no row; an empty table gives none; columns named copy or shard are replaced, all others keep name and value.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c not in (*ROWS, "placed")]).alias("doc")
    rows = mixed.select(doc, F.posexplode("placed").alias("copy", "shard"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), F.lit("order"), "doc.doc_id", "copy", "doc.text"))
    dealt = rows.repartition("shard", F.pmod(F.floor(F.col("order") / (2**64 // SLICES)), F.lit(SLICES)))
    return dealt.sortWithinPartitions("shard", "order").select("doc.*", "copy", "shard")
