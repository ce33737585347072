"""Benchmark decontamination: which documents contain a benchmark item, however long the document is.

Words are runs of letters, digits and underscores in lower case; shingles are five of them. An item is in a
document if at least ``threshold`` of the item's distinct shingles are. An item of fewer words is one
shingle, its whole sequence; an item without words is in nothing.

Items are partitioned by the size of their shingle set: class c of a shingle length holds the sets of 2^c up to twice as many. The
MinHash sketch of an item of n shingles is its k = floor((1 - threshold) n) + 1 least hashes. A document that contains the
item misses at most k - 1 of its shingles, so it holds one of the sketch at least: no such document is missed, whatever its
length. A class has the bound that its sketches lie under, and a document's sketch for the class is its shingles'
hashes up to that bound, so that the share of a long document that is looked up falls as the class's items grow. A class is
left out for documents with too few shingles for its items. Where sketches meet is a candidate; its
containment is counted on the shingles themselves.

The benchmark goes to executors in blocks of at most ``block_words`` words, with one pass over the documents
a block, and is taken back after it where others follow: memory is bounded however large the benchmark is. Documents don't move.

Null and empty texts contain nothing. Items that are the same are reported each. Repeated documents are reported
each. Tables may be empty and have other columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

N = 5
_words = re.compile(r"\w+").findall
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_BITS = 20


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words that follow each other."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = (h ^ ids[i : i + count]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return h


class _Class:
    """The sketches of the items of one size class."""

    def __init__(self) -> None:
        self.least, self.owners, self.bound = 1 << 62, defaultdict(list), np.uint64(0)

    def add(self, item: int, hashes: np.ndarray, threshold: float) -> None:
        k = int((1 - threshold) * len(hashes) + 1e-9) + 1
        self.least = min(self.least, int(np.ceil(threshold * len(hashes) - 1e-9)))
        for h in hashes[:k].tolist():
            self.owners[h].append(item)

    def close(self) -> None:
        self.keys = np.array(sorted(self.owners), np.uint64)
        self.bound = self.keys[-1]
        self.owners = dict(self.owners)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.keys & np.uint64((1 << _BITS) - 1)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items whose sketch meets the document's sketch."""
        h = h[h <= self.bound]
        h = h[self.seen[h & np.uint64((1 << _BITS) - 1)]]
        if not len(h):
            return set()
        h = np.unique(h[self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h])
        return {a for x in h.tolist() for a in self.owners[x]}


class Items:
    """A block of benchmark items in classes by shingle length and size."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = 0.8) -> None:
        self.threshold, hashes = threshold, _Hashes()
        self.items: list[tuple[int, int, frozenset[str], np.ndarray]] = []  # id, shingle length, shingles, their hashes
        self.classes: dict[int, dict[int, _Class]] = defaultdict(lambda: defaultdict(_Class))
        for key, text in items:
            words = _words((text or "").lower())
            if not words:
                continue
            n = min(N, len(words))
            own = frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            got = np.unique(_shingles(np.fromiter((hashes[w] for w in words), np.uint64, len(words)), n))
            self.classes[n][len(got).bit_length() - 1].add(len(self.items), got, threshold)
            self.items.append((key, n, own, got))
        self.classes = {n: dict(sorted(by.items())) for n, by in self.classes.items()}
        for by in self.classes.values():
            for c in by.values():
                c.close()

    def found(self, words: list[str], ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those in the document) for each item that the document contains."""
        out = []
        for n, by in self.classes.items():
            count = len(words) - n + 1
            if count < min(c.least for c in by.values()):
                continue
            h = _shingles(ids, n)
            candidates = sorted({a for c in by.values() if count >= c.least for a in c.candidates(h)})
            if candidates:
                # the words of those shingles alone that a candidate has
                there = {" ".join(words[i : i + n]) for i in np.flatnonzero(np.isin(h, np.concatenate([self.items[a][3] for a in candidates]))).tolist()}
                for a in candidates:
                    key, _, own, _ = self.items[a]
                    shared = len(own & there)
                    if shared >= self.threshold * len(own) - 1e-9:
                        out.append((key, len(own), shared))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    block, words = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        words += len(r[1] or "") // 2
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def _marked(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block and whether it is the last."""
    held = next(blocks, None)
    while held is not None:
        block, held = held, next(blocks, None)
        yield block, held is None


def _scanner(items: Items):  # noqa: ANN202
    hashes = _Hashes()

    def scan(text: str | None) -> list[tuple[int, int, int]]:
        words = _words((text or "").lower())
        return items.found(words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))) if words else []

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item in it: doc_id, item_id, n_shingles, n_shared, containment."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")), None
    for block, last in _marked(_blocks(benchmark, item_col, item_text_col, block_words)):
        sent = spark.sparkContext.broadcast(Items(block, threshold))

        def pairs(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = _scanner(sent.value)
            for b in batches:
                got = [(i, *x, x[2] / x[1]) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in scan(t.as_py())]
                if got:
                    cols = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.float64()], strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        found = rows.mapInArrow(pairs, schema)
        if not last:
            found = stash(found, "contaminated")
            sent.destroy()
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_words: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns; a pass over the documents for each block."""
    spark, out, at = docs.sparkSession, docs, docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    for block, last in _marked(_blocks(benchmark, item_col, item_text_col, block_words)):
        sent = spark.sparkContext.broadcast(Items(block, threshold))

        def passed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = _scanner(sent.value)
            for b in batches:
                yield b.filter(pa.array([not scan(t.as_py()) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(passed, schema)
        if not last:
            out = stash(out, "clean")
            sent.destroy()
    return out
