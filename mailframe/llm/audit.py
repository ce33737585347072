"""How filters that follow each other act on a corpus, in every order: what each removes, what another would have removed.

Filters. A: fewer than 100 words. B: under 80% of the words are distinct. C: over 10% of the code points are A-Z. D: one of ``#$%&*|``.
E: a smaller id has the same text, anywhere in the table. A document's failures are a mask of five bits, so all orders are counted
from the documents by part and mask, 32 rows a part, and not from documents again.

Duplicates by partition refinement. Documents are split by their number of code points; classes of one are dropped; those left are split by
the hash of a first block of their text, then of a second one four times as long, and so on, dropping classes of one each time. One pass over the
texts takes all block hashes, whose number grows with the logarithm of the length. Only texts of documents that are left after
their last block move, and are compared as texts: a class is grouped by its whole texts, copies meeting before they move. Of a class whose
documents have one text the least id is not marked; one with several texts, which hashes mixed up, is marked text by text.

Rows are documents, repeated ones too; two with the same id and text mark each other not, since none is smaller. Null texts are
empty. A null id has no place in the order: it marks nothing and isn't marked. A null language is the part "". A document is good, or toxic, if
one row of the labels says so. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import inner_join, left_join, semi_join, stash

FILTERS = "ABCDE"
#: Bytes of the first block; each further one has four times as many.
BLOCK = 4096
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def failures(text: bytes, points: int) -> int:
    """The mask of what a text fails by itself: bit 0 for A to bit 3 for D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3


def blocks(text: bytes, first: int) -> list[int]:
    """A hash for each block."""
    out, at, size = [], 0, first
    while at < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[at : at + size]) - (1 << 63))
        at, size = at + size, size * 4
    return out


def measured(rows: DataFrame, first: int = BLOCK) -> DataFrame:
    """(r, doc_id, part, mask, points, blocks), written, of rows (r, doc_id, part, t)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = pc.utf8_length(b.column(3))
            masks, hashes = [], []
            for t, n in zip(b.column(3).cast(pa.binary()), points.to_pylist(), strict=True):
                masks.append(failures(t.as_py(), n))
                hashes.append(blocks(t.as_py(), first))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks, pa.int32()), points.cast(pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["r", "doc_id", "part", "mask", "points", "blocks"])

    return stash(rows.select("r", "doc_id", "part", "t").mapInArrow(each, "r long, doc_id long, part string, mask int, points int, blocks array<long>"), "measured")


def refined(rows: DataFrame) -> DataFrame:
    """(r, doc_id, cls): rows that agree with another one in length and in all blocks, in classes."""
    left, done, k = stash(rows.select("r", "doc_id", F.xxhash64("points").alias("cls"), "blocks"), "lengths"), None, 0
    while True:
        many = stash(left.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1"), "classes")
        live = stash(semi_join(left, many, ["cls"], "n"), f"round-{k}")
        ended = live.where(F.size("blocks") <= k).select("r", "doc_id", "cls")
        done = ended if done is None else done.unionAll(ended)
        left = live.where(F.size("blocks") > k).withColumn("cls", F.xxhash64("cls", F.element_at("blocks", k + 1)))
        if left.isEmpty():
            return stash(done, "alike")
        k += 1


def repeated(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """(r) of documents whose text a smaller id has; alike: the classes of ``refined``."""
    # the same join at every size, not a broadcast where few are alike: how many are alike grows with the rows
    texts = rows.select("r", "t").hint("merge").join(alike, "r")
    firsts = stash(texts.groupBy("cls", "t").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("cls", "first", "n"), "firsts")
    classes = stash(firsts.groupBy("cls").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("texts")), "classes")
    one = inner_join(alike, classes.where("texts = 1").select("cls", "first", "n"), ["cls"], "n").where("doc_id > first").select("r")
    mixed = classes.where("texts > 1")
    if mixed.isEmpty():
        return one
    # different texts with equal hashes
    those = texts.join(mixed.select("cls"), "cls", "left_semi")
    return one.unionAll(those.join(those.groupBy("cls", "t").agg(F.min("doc_id").alias("first")), ["cls", "t"]).where("doc_id > first").select("r"))


def masks(docs: DataFrame, labels: DataFrame, first: int = BLOCK) -> DataFrame:
    """(doc_id, part, mask, good, toxic), a row a document: which filters it fails and what the labels say."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stash(docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t")), "rows")
    known = measured(rows, first)
    marked = repeated(rows, refined(known)).withColumn("e", F.lit(1 << FILTERS.index("E")))
    every = stash(known.drop("blocks", "points").join(marked, "r", "left").select("doc_id", "part", (F.col("mask") + F.coalesce("e", F.lit(0))).alias("mask")), "masks")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    return left_join(every, said, ["doc_id"])


def _bits(letters: Column) -> Column:
    return sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))


def interactions(found: DataFrame) -> DataFrame:
    """From ``masks`` a row for each part, order of the filters and step."""
    few = stash(found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")), "counts")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = few.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns({"letter": letter, "own": _bits(letter), "before": _bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    here = fails & ~earlier

    def of(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        of(~fails & ~earlier).alias("kept"), of(here).alias("removed"), of(fails & earlier).alias("redundant"), of(F.col("mask") == F.col("own")).alias("unique_fails"),
        of(here, "good").alias("good_lost"), of(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, zeros included."""
    return interactions(masks(docs, labels))
