"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Leaves hang in a tree of regions, racks and shards. At each level a key draws, for every child, the clock
-ln(u) / weight with u hashed from the key and the child's name; the earliest clock wins, so that each child
gets keys in proportion to its weight. A key passes three levels and not all shards.

Weight that is added later is a tranche of its own: it joins the race at the root under its own name, with its
own weight. A region's clock is then the earliest of its first weight and its tranches, and what a tranche wins
goes straight down to the shard that brought the weight. Thus growing a tree by a shard moves keys into that
shard only, inside the one region and rack whose weights changed, and nothing elsewhere. Weight that goes leaves the races
as they were: a key that they send to the lowered shard stays with the share of its weight that is left, by a draw of its
own, and otherwise descends once more by the weights that are left. So only the lowered shard's keys move.

Null keys hash as a value of their own. Rows with one key share a shard. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import let
from .common import each_copy, power_of_two, stash


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    #: False for weight that came after the tree was first built.
    first: bool = True
    #: The share of the weight that is left.
    kept: float = 1.0


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1 dealt in turn to the racks of the regions."""
    return [Leaf(s, s % regions, s // regions % racks) for s in range(shards)]


def grown(tree: list[Leaf], region: int = 0, rack: int = 0, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard."""
    return [*tree, Leaf(max(x.shard for x in tree) + 1, region, rack, weight, False)]


def lowered(tree: list[Leaf], shard: int, kept: float = 0.0) -> list[Leaf]:
    """The tree with a share of a shard's weight left, or none: the shard is empty then."""
    return [replace(x, kept=x.kept * kept) if x.shard == shard else x for x in tree]


def _draw(key: Column, name: Column, seed: str) -> Column:
    """A number between 0 and 1 from 52 bits of a digest of key and name."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * 2.0**-52


def _clock(key: Column, name: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight."""
    return -F.log(_draw(key, name, seed)) / weight


def _levels(tree: list[Leaf]) -> list[list[list[tuple[str, float, int]]]]:
    """For each level the nodes' children: name, weight, and place in the next level (in the last, the shard).

    A tranche is a region with one rack with one shard, its own.
    """
    regions: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for i, x in enumerate(tree):
        if x.first:
            regions[f"{x.region}"][f"{x.rack}"].append(x)
        else:
            regions[f"+{x.shard}.{i}"]["+"].append(x)
    root, racks, shards = [], [], []
    for r, below in sorted(regions.items()):
        root.append((r, sum(x.weight for own in below.values() for x in own), len(racks)))
        racks.append([])
        for k, own in sorted(below.items()):
            racks[-1].append((f"{r}/{k}", sum(x.weight for x in own), len(shards)))
            shards.append([(f"{r}/{k}/{x.shard}", x.weight, x.shard) for x in own])
    return [[root], racks, shards]


def _descend(key: Column, tree: list[Leaf], seed: str) -> Column:
    """The shard of a key: three races down the tree; the first in order wins ties."""
    at = F.lit(0)
    for level in _levels(tree):
        table = F.array(*(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(to).alias("to")) for n, w, to in own)) for own in level))
        race = F.transform(F.element_at(table, at + 1), lambda x: F.struct(_clock(key, x["name"], x["weight"], seed).alias("clock"), x["to"].alias("to")))
        at = F.array_min(race)["to"]
    return at.cast("int")


def shard_of(key: Column, tree: list[Leaf], seed: str = "tree") -> Column:
    """The shard of a key, as an int column."""
    at, weights = _descend(key, tree, seed), defaultdict(lambda: [0.0, 0.0])
    for x in tree:
        weights[x.shard][0] += x.weight
        weights[x.shard][1] += x.weight * x.kept
    less = [(s, left / was) for s, (was, left) in sorted(weights.items()) if left < was]
    if not less:
        return at
    again = _descend(key, [replace(x, weight=x.weight * x.kept, kept=1.0) for x in tree if x.weight * x.kept > 0], f"{seed}/again")

    def decided(s: Column) -> Column:
        share = F.coalesce(*(F.when(s == shard, F.lit(kept)) for shard, kept in less), F.lit(1.0))
        return F.when(_draw(key, F.concat(F.lit("kept/"), s.cast("string")), seed) < share, s).otherwise(again)

    return let(at, decided)


def place(df: DataFrame, tree: list[Leaf], larger: list[Leaf], id_col: str = "doc_id", text_col: str = "text", seed: str = "tree") -> DataFrame:
    """A row for each of df's: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps, by bucket of the row's hash, then id. A shard's rows are
    split over buckets, as many as the root of the rows asks for, and equal rows are counted before they are
    placed and dealt to tasks again after that, so that neither a large shard nor a row of very many copies meets in one task.
    """
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = df.select(key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("same"))
    n = df.count()
    buckets = power_of_two(math.sqrt(n) / 8, 1 << 20)
    same = same.withColumns({
        "shard": shard_of(F.col("doc_id"), tree, seed), "grown_shard": shard_of(F.col("doc_id"), larger, seed),
        "bucket": F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(buckets)),
    })
    full = same.groupBy("shard", "bucket").agg(F.sum("same").alias("rows"))
    before = full.select("shard", "bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = same.join(before, ["shard", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("same").over(order), F.lit(0)))
    each = each_copy(stash(start.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "start", "same"), "starts"), "same", "copy")
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
