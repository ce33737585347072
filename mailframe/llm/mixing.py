"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources in code-point order, null last, have the given weights in turn and share ``share`` times all words.
A source's target stops at ``repeats`` times its own words; the excess is shared again by weight.

Each source's documents are dealt by hash over S shards. In its cell (source, shard) a source's documents stand in seeded
order and are cut into blocks of B words, the last one of what is left. A shard's house has as many seats as the targets ask
for there; its parties are the sources with their part of the target, in blocks, as votes; and Sainte-Laguë gives the seats to
the highest quotients votes / (2 k + 1). What floor(votes / d + 1/2) gives at a divisor d that is surely too large is
settled, and so is what none gets at one that is surely too small; only the quotients between the two, at most two for
each party on average, become rows and are ranked. A cell takes no more than ``repeats`` times its blocks.

A quota of q seats over n blocks takes all blocks q div n times and q mod n of them once more: those that a seeded
step around the cell, prime to n, comes to first. What a document gives is thus a sum over its own blocks.

S grows with the root of all words, so that neither a cell nor a shard's list of cells is large. B is the
largest power of two (2048 at most) with 256 blocks for each shard in the smallest target. Rows that are the same are
counted before they move and their copies dealt over the shards in turn.

Null or empty texts have size 0 and are taken 0 words. A null source is a source. Rows that are the same take
their places in any order, with the same results. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, each_copy, numbered, power_of_two, stash

WEIGHTS = (5, 2, 1)


def _marked(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """df with its size, source key and seeded hash."""
    source = F.col(source_col).cast("string")
    return df.withColumns({
        "_mix_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "_mix_key": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")),
        "_mix_hash": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), source, F.col(text_col))),
    })


def _number(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """sizes (key, source, words) with weight and target of each source.

    A source is at its stop as soon as its equal share passes it; each round shares the excess among the
    rest and ends when no other source passes its stop. The driver sees three sums a round.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    of = stash(numbered(sizes, "source", "place").withColumns({"weight": weight, "most": F.col("words") * float(repeats)}), "sources")
    total, all_weights = of.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, free, stopped = share * total, all_weights, -1
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(left) / F.lit(free or 1.0)
        n, kept, rest = of.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not rest:
            break
        left, free, stopped = share * total - kept, rest, n
    return of.withColumn("target", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(left) / F.lit(free or 1.0)))


#: Votes are counted in this part of a block, as whole numbers, so that sums don't depend on their order.
PART = 1 << 20
# Primes above any number of blocks in a cell; one modulo that number is a step around the cell.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def quotas(cells: DataFrame) -> DataFrame:
    """cells (key, shard, blocks, votes; votes in ``PART`` of a block) with ``seats``: for each shard the highest quotients of its house."""
    shard = Window.partitionBy("shard")
    cells = cells.withColumns({"_all": F.sum("votes").over(shard), "_parties": F.count_if(F.col("votes") > 0).over(shard)})
    house = F.floor(F.col("_all") / PART + 0.5)

    def at(more: Column) -> Column:
        """Seats at the divisor for which all shares together are ``more`` seats."""
        return F.floor(F.col("votes") * F.greatest(F.lit(0.0), more) / F.greatest("_all", F.lit(1)) + 0.5)

    cells = cells.withColumns({"_base": at(house - F.col("_parties") / 2), "_top": at(house + F.col("_parties") / 2)})
    cells = stash(cells.withColumn("_left", house - F.sum("_base").over(shard)), "cells")
    open_ = cells.where("_top > _base").select("key", "shard", "_left", "votes", F.explode(F.sequence(F.col("_base"), F.col("_top") - 1)).alias("k"))
    ranked = open_.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), "key", "k")))
    won = ranked.where(F.col("place") <= F.col("_left")).groupBy("key", "shard").agg(F.count("*").alias("_won"))
    return cells.join(won, ["key", "shard"], "left").withColumn("seats", F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_all", "_parties", "_base", "_top", "_left", "_won")


def mix(df: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of df's: size, source_size, target, taken and whole_copies, with the columns of ``keep``.

    ``taken`` counts words, repeats included, and parts of documents. ``whole_copies`` is for mixes of whole
    documents: how often the blocks taken hold the document's first word. With ``keep``, rows that are the same aren't counted
    first but share a cell.
    """
    marked = _marked(df.select(*dict.fromkeys((id_col, text_col, source_col, *keep))), id_col, text_col, source_col, seed)
    source = F.col(source_col).cast("string").alias("_mix_source")
    slim = stash(marked.select(F.col(id_col).alias("_mix_id"), "_mix_key", source, "_mix_size", "_mix_hash"), "sizes")
    of = stash(targets(slim.groupBy(F.col("_mix_key").alias("key"), F.col("_mix_source").alias("source")).agg(F.sum("_mix_size").alias("words")), share, repeats, weights), "targets")
    total, least = of.agg(F.coalesce(F.sum("words"), F.lit(0)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    shards = power_of_two(math.sqrt(total) / 16, 1 << 20)
    block = power_of_two((least or 1) / (256 * shards), 2048)

    copies = each_copy(stash(slim.groupBy("_mix_id", "_mix_key", "_mix_size", "_mix_hash").agg(F.count("*").alias("_mix_n")), "copies"), "_mix_n", "_mix_copy")
    shard = F.pmod(_number(F.col("_mix_hash")) + F.col("_mix_copy"), F.lit(shards))
    if keep:
        placed = marked.withColumns({"_mix_copy": F.lit(0).cast("long"), "_mix_id": F.col(id_col)}).withColumn("_mix_shard", shard)
        dealt = placed.select("_mix_key", "_mix_shard", "_mix_size")
    else:
        placed = dealt = stash(copies.withColumn("_mix_shard", shard), "dealt")
    cells = dealt.groupBy(F.col("_mix_key").alias("key"), F.col("_mix_shard").alias("shard")).agg(F.sum("_mix_size").alias("cell"))
    cells = cells.join(of.select("key", F.col("words").alias("source_size"), "target"), "key").withColumn("blocks", F.ceil(F.col("cell") / block))
    cells = quotas(cells.withColumn("votes", F.floor(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)) * PART)))
    ring = F.greatest("blocks", F.lit(1))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "key", F.col("shard").cast("string")))
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.conv(F.substring(drawn, 9, 4), 16, 10).cast("int") % len(STEPS) + 1).cast("int"))
    cells = cells.withColumn("seats", F.least("seats", F.col("blocks") * repeats)).select(
        F.col("key").alias("_mix_key"), F.col("shard").alias("_mix_shard"), "source_size", "target", ring.alias("_mix_ring"), F.floor(F.col("seats") / ring).alias("_mix_rounds"),
        F.pmod(F.col("seats"), ring).alias("_mix_rest"), F.pmod(step.cast("long"), ring).alias("_mix_step"), F.pmod(_number(drawn), ring).alias("_mix_first"),
    )

    placed = placed.join(cells.withColumnsRenamed({x: f"_mix_{x}" for x in ("source_size", "target")}), ["_mix_key", "_mix_shard"])
    order = Window.partitionBy("_mix_key", "_mix_shard").orderBy("_mix_hash", "_mix_size", F.asc_nulls_first("_mix_id"), "_mix_copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_mix_from", F.coalesce(F.sum("_mix_size").over(order), F.lit(0)))
    start, size, rest = F.col("_mix_from"), F.col("_mix_size"), F.col("_mix_rest")

    def once_more(j: Column) -> Column:
        """Whether the step around the cell comes to block j among the first."""
        return F.pmod(j * F.col("_mix_step") + F.col("_mix_first"), F.col("_mix_ring")) < rest

    blocks = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    part = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, j: a + F.when(once_more(j), F.least(start + size, (j + 1) * block) - F.greatest(start, j * block)).otherwise(0))
    some = (size > 0) & (rest > 0)
    return placed.select(
        *(dict.fromkeys((id_col, *keep)) if keep else [F.col("_mix_id").alias(id_col)]), size.alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_rounds") * size + F.when(some, part).otherwise(0)).cast("long").alias("taken"),
        F.when(size > 0, F.col("_mix_rounds") + once_more(F.floor(start / block)).cast("long")).otherwise(0).cast("int").alias("whole_copies"),
    )
