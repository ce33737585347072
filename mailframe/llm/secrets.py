"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

A version of a file is a row; its content's SHA-256 is the address of its blob. The ledger is a Parquet table of
(blob, rules, found) under a path of its own: which blobs a set of rules has seen and the spans it found there. An update reads
the addresses of all versions, leaves out the pairs of blob and rules that the ledger has before a text moves, scans each remaining blob once
however many versions or paths hold it, and appends the pairs to the ledger, those without findings too. The findings are then joined
back to all versions by address. A new version of the rules has a new name and so scans every blob once more.

The ledger outlives sessions. A row is true on its own, so an update that ends halfway leaves a ledger that is right, and the
next one scans what is missing; two at a time may add a pair twice, which reads once.

Spans are code points of the text, end exclusive, leftmost and non-overlapping per rule; matches that fail a
rule's length are dropped without a second try. They are found by splitting the text at the rule's matches: a
match's place is the length of all that precedes it.

Copies of a blob meet before they move, so that a blob with very many versions is small; joining back leaves the versions of
such a blob where they are (``common.left_join``). Null texts are the empty blob. Repeated rows give repeated results. Empty tables
give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import let, running
from .common import left_join, stash

LEDGER = "blob string, rules string, found array<struct<start:int,kind:int,end:int>>"
#: Addresses that are broadcast, at most: 64 bytes each.
SENT = 1 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1


# The rules' patterns.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
VERSION = "base-1"


def _matches(text: Column, rule: Rule, kind: int) -> Column:
    """Spans (start, kind, end) of a rule's matches in the text."""
    pattern = F.lit(rule.pattern)
    before = F.transform(F.slice(F.split(text, rule.pattern, -1), 1, 1 << 30), F.length)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = matches if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.arrays_zip(before.alias("before"), F.transform(matches, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def placed(x: Column) -> Column:
        at = running(F.transform(x, lambda y: y["before"] + F.coalesce(y["size"], F.lit(0))))
        each = F.transform(F.arrays_zip(x.alias("x"), at.alias("at")), lambda y: F.struct((y["at"] + y["x"]["before"]).cast("int").alias("start"), y["x"]["size"].alias("size"), y["x"]["tested"].alias("tested")))
        good = F.filter(each, lambda y: y["tested"] >= rule.least)
        return F.transform(good, lambda y: F.struct(y["start"].alias("start"), F.lit(kind).alias("kind"), (y["start"] + y["size"]).alias("end")))

    return F.when(text.rlike(rule.pattern), let(sizes, placed)).otherwise(none)


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans by start, then rule."""
    return F.array_sort(F.concat(*(_matches(text, r, k) for k, r in enumerate(rules))))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _scanned(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], version: str, text_col: str) -> DataFrame | None:
    """The rows that the ledger lacks, or None if there are none. Addresses meet the ledger before a text moves."""
    text = F.col(text_col).cast("string")
    blobs = docs.select(address(text).alias("blob"), F.coalesce(text, F.lit("")).alias("t"))
    if ledger is not None:
        known = ledger.where(F.col("rules") == version).select("blob")
        unseen = stash(blobs.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        n = unseen.count()
        if not n:
            return None
        # few are sent to where the texts are; of many, the copies of a text meet first
        blobs = blobs.join(F.broadcast(unseen), "blob", "left_semi").dropDuplicates(["blob"]) if n <= SENT else blobs.dropDuplicates(["blob"]).join(unseen, "blob", "left_semi")
    else:
        blobs = blobs.dropDuplicates(["blob"])
    return blobs.select("blob", F.lit(version).alias("rules"), spans(F.col("t"), rules).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION, text_col: str = "text") -> DataFrame:
    """The rows that a ledger lacks for docs, written to the shared folder for as long as the driver lives."""
    found = _scanned(docs, ledger, rules, version, text_col)
    return docs.sparkSession.createDataFrame([], LEDGER) if found is None else stash(found, "ledger")


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path, a folder for each version of the rules; an empty one is made where there is none."""
    spark.createDataFrame([], LEDGER).write.partitionBy("rules").mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION, text_col: str = "text") -> DataFrame:
    """The ledger at a durable path after the blobs of docs that these rules haven't seen were scanned and appended to it."""
    spark = docs.sparkSession
    found = _scanned(docs, open_ledger(spark, path), rules, version, text_col)
    if found is not None:
        found.write.partitionBy("rules").mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each version: doc_id, blob and found, the spans in its blob."""
    found = ledger.where((F.col("rules") == version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    versions = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), address(F.col(text_col)).alias("blob")), "versions")
    return left_join(versions, found, ["blob"]).withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind, digest and text of the spans of ``findings``."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    line = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    return found.select("doc_id", *counts, F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"), "blob")
