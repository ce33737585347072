"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, with A-Z in lower case; its hash has 128 bits, so that of 10^12 keys two
agree by a chance of 10^-15. A document's keys count once, and keys that ``least`` documents have lose all their lines everywhere.

Runs. A run is a table of (h, n): the hashes of a batch of documents and how many documents had them by then, bucketed and sorted by
hash, so that batches meet runs by merge joins that move nothing stored. Each batch is counted by itself and joined with every run: hashes
that a run has closed (``least`` documents or more) are left out, the rest add what the runs have to their own count and become a run of
level 0. ``fan`` runs of a level are merged to one of the level above, so there are ``fan`` times the logarithm of the batches at most,
and a hash is rewritten once a level. A closed hash needs no more rows, so frequent lines don't grow with the batches. The manifest of a
path names its batches and runs; it is written whole under a new number, so that a batch that ends halfway has added nothing, and a
batch whose name is there adds nothing again. One writer at a time.

Removal. Lines meet the closed hashes by a join in which the rows of hot keys stay where they are (``common.inner_join``); only line
numbers go back to their documents.

A row is a document, also if it repeats another one. A null or empty text is one empty line. Lines without a key (only white space)
are kept and not counted. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_bound, inner_join, new_path, stash

LEAST = 10
FAN = 4
#: Batches that the documents of a table come in, by ranges of their ids.
BATCHES = 6
WHITE = b" \t\n\x0b\x0c\r"


def keyed(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # of bytes, only A-Z changes


def rows_of(df: DataFrame, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(r, batch, doc_id, t), written: a number of its own for each row of df, and which of the batches it comes in, by ranges of ids."""
    doc = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    low, high = doc.agg(F.min("doc_id"), F.max("doc_id")).first()
    batch = F.lit(0) if low is None else F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low)) / (float(high) - float(low) + 1) * batches), F.lit(0)).cast("int")
    return stash(doc.select(F.monotonically_increasing_id().alias("r"), batch.alias("batch"), "doc_id", "t"), "rows")


def lines(rows: DataFrame) -> DataFrame:
    """(r, batch, i, first, h), written: each line that has a key, and whether it is the first of its document with that key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, batch, at, sizes, first, hashes = b.column(0).to_numpy(), b.column(1).to_numpy(), [], [], [], []
            for t in b.column(2):
                seen: set[bytes] = set()
                n = len(at)
                for i, line in enumerate(t.as_py().split(b"\n")):
                    if key := keyed(line):
                        h = xxhash.xxh3_128_digest(key)
                        at.append(i)
                        hashes.append(h)
                        first.append(h not in seen)
                        seen.add(h)
                sizes.append(len(at) - n)
            offsets = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * 16)
            h = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(b"".join(hashes))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r, sizes)), pa.array(np.repeat(batch, sizes)), pa.array(at, pa.int32()), pa.array(first, pa.bool_()), h], names=["r", "batch", "i", "first", "h"])

    return stash(rows.select("r", "batch", "t").mapInArrow(each, "r long, batch int, i int, first boolean, h binary"), "lines")


class Runs:
    """The levels of runs under a path that driver and executors share; they outlive the session."""

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST, fan: int = FAN) -> None:
        self.spark, self.path, self.least, self.fan = spark, path, least, fan
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{path}/manifests"))
        self._tables: dict[str, str] = {}

    # -- the manifest ------------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at(f"{self.path}/manifests")) if f.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """``batches``: names; ``levels``: the runs of each; ``buckets``: of all runs, as many as the first one's session shuffled to."""
        numbers = self._numbers()
        if not numbers:
            return {"batches": [], "levels": [], "buckets": int(self.spark.conf.get("spark.sql.shuffle.partitions"))}
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at(f"{self.path}/manifests/{numbers[-1]}")), "UTF-8"))

    def _commit(self, manifest: dict) -> None:
        number = (self._numbers() or [0])[-1] + 1
        made = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(made, self._at(f"{self.path}/manifests/{number}")):
            raise RuntimeError(f"another writer has committed manifest {number} of {self.path}")

    # -- runs --------------------------------------------------------------------------------------------------------

    def _open(self, run: str, buckets: int) -> DataFrame:
        if run not in self._tables:
            name = f"mailframe_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BINARY, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, rows: DataFrame, buckets: int) -> str:
        run = f"run-{uuid.uuid4().hex}"
        self._open(run, buckets)
        rows.select("h", "n").write.insertInto(self._tables[run])
        self.spark.catalog.refreshTable(self._tables[run])
        return run

    def close(self) -> None:
        """Forgets the session's names of the runs; the runs stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def _merged(self, runs: list[str], buckets: int, least: int = 0) -> DataFrame:
        """(h, n) of the runs, the greatest n of a hash.

        Read as plain files: Spark takes a union of bucketed tables for bucketed, leaves out the shuffle, and then need not read them by buckets.
        """
        if not runs:
            return self.spark.createDataFrame([], "h binary, n long")
        every = self.spark.read.schema("h binary, n long").parquet(*(f"{self.path}/{run}" for run in runs))
        return every.where(F.col("n") >= least).repartition(buckets, "h").groupBy("h").agg(F.max("n").alias("n"))

    def totals(self, least: int = 0) -> DataFrame:
        """(h, n) over all runs, of those with ``least`` or more; n is exact below the ledger's ``least``, and above at least that."""
        m = self.manifest()
        return self._merged([run for level in m["levels"] for run in level], m["buckets"], least)

    def closed(self) -> DataFrame:
        return self.totals(self.least)

    def add(self, batch: str, counts: DataFrame) -> None:
        """Adds a batch's (h, n), a written table: what isn't closed yet becomes a run; full levels are merged.

        A closed hash that is hot in this batch adds its row too, at most 4096 a batch, so that totals show which hashes are hot.
        """
        m = self.manifest()
        if batch in m["batches"]:
            return
        most = hot_bound(counts.agg(F.sum("n")).first()[0] or 0)
        met, before = counts, []
        for k, run in enumerate(run for level in m["levels"] for run in level):
            met = met.join(self._open(run, m["buckets"]).withColumnRenamed("n", f"n{k}"), "h", "left")
            before.append(F.coalesce(f"n{k}", F.lit(0)))
        had = F.greatest(F.lit(0), F.lit(0), *before)
        rows = met.where((had < self.least) | (F.col("n") > most)).select("h", (F.col("n") + had).alias("n"))
        m["levels"] = m["levels"] or [[]]
        m["levels"][0].append(self._write(rows, m["buckets"]))
        m["batches"].append(batch)
        self._commit(m)
        self._compact(m)

    def _compact(self, m: dict) -> None:
        level = 0
        while level < len(m["levels"]):
            old = m["levels"][level]
            if len(old) >= self.fan:
                merged = self._write(self._merged(old, m["buckets"]), m["buckets"])
                m["levels"][level] = []
                m["levels"][level + 1 :] = [[*(m["levels"][level + 1] if level + 1 < len(m["levels"]) else []), merged], *m["levels"][level + 2 :]]
                self._commit(m)
                for run in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}")
                    self._fs.delete(self._at(f"{self.path}/{run}"), True)
            level += 1


def counted(found: DataFrame) -> DataFrame:
    """(h, n), written: how many documents of ``lines`` have each key."""
    return stash(found.where("first").groupBy("h").agg(F.count("*").alias("n")), "counts")


def remove(rows: DataFrame, found: DataFrame, closed: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text if asked for) of ``rows_of`` without the lines whose hashes are closed (a written table)."""
    total = found.count()
    gone = inner_join(found.select("r", "i", "h"), closed, ["h"], "n", total).groupBy("r").agg(F.collect_list("i").alias("gone"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, drop in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                kept, dropped, n = t.as_py(), 0, 0
                n = kept.count(b"\n") + 1
                if drop.is_valid:
                    every, dropped = kept.split(b"\n"), len(drop.values)
                    keep = np.ones(n, bool)
                    keep[drop.values.to_numpy()] = False
                    kept = b"\n".join([every[i] for i in np.flatnonzero(keep).tolist()])
                out.append((doc, n, dropped, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.join(gone, "r", "left").select("doc_id", "t", "gone").mapInArrow(cut, schema)


def dedup(df: DataFrame, path: str | None = None, least: int = LEAST, fan: int = FAN, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each of df's without its frequent lines. df comes in batches; the runs stay at ``path``, or in the shared folder as long as the driver lives."""
    spark = df.sparkSession
    rows = rows_of(df, batches, id_col, text_col)
    found = lines(rows)
    runs = Runs(spark, path or new_path(spark, "runs"), least, fan)
    for k in range(batches):
        runs.add(f"{k + 1} of {batches}", counted(found.where(F.col("batch") == k)))
    closed = stash(runs.closed(), "closed")
    runs.close()
    return remove(rows, found, closed, with_text)
