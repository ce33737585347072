"""Substring deduplication: words in a window of ``window`` words that starts at another place as well are removed.

The corpus is a de Bruijn graph: an edge is a window of 35 words, a token k-mer, and leads from its first 34 words
to its last 34. A document is a walk. A window is repeated if its edge is walked more than once.

Paths. Each edge is named by its anchor, the one of its 28 short k-mers of 8 words with the least hash, which depends
on the edge's words alone. Edges that follow each other under one anchor form a path, about one for each 14
words, and only paths are written: (anchor, hash of the path's words, source document, first edge, number of edges).

Compaction by joins. A path whose anchor occurs once has no repeated edge and goes. A path that occurs whole in
another place is a nonbranching repeated path: all its edges are repeated together, and it is kept as one span.
Only paths that share an anchor but not all words, which branch somewhere, are opened: their edges are counted under (anchor, edge).
Paths are not merged across anchors, since the spans that they cover are the same. Repeated edges and paths
are joined to spans of the source, and the words under them leave the text.

Verification. Anchors come from sums of word hashes. Paths and edges are told apart by a second hash, read from the bytes of
the words at their source coordinates: what is removed agrees in both, 128 bits in all.

Documents are known by 96 bits of hash of their text, so that copies share spans. Within a task copies are read
once; a text that has copies, of at least a window's words, is repeated whatever its paths say. Anchors, paths, edges and texts
that very many rows have are counted first and never meet in one task (``common.semi_join``).

Windows are judged on the input: all occurrences go, the first included. Null texts are empty. Texts of fewer
words than a window stay as they are. Repeated rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_bound, semi_join, stash, unstash

#: Words in a window, and in the short k-mers that anchors are taken from.
WINDOW, SHORT = 35, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Text:
    """Hashes of runs of words of a text: quick ones, by sums of its words' hashes times powers of an odd number, and those of the words' bytes."""

    def __init__(self, words: list[bytes]) -> None:
        self.n, self.joined = len(words), b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]])

    def anchors(self, words: list[bytes], hashes: _Hashes, size: int) -> np.ndarray:
        """A quick hash for each run of ``size`` words."""
        ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, self.n)
        powers = np.multiply.accumulate(np.full(self.n + 1, _ODD, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(ids * powers[: self.n])])
        back = np.multiply.accumulate(np.full(self.n + 1, _INVERSE, np.uint64))
        at = np.arange(self.n - size + 1)
        return _mixed((sums[at + size] - sums[at]) * back[at])

    def runs(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """A hash of the bytes of each run of words."""
        digest, joined = xxhash.xxh3_64_intdigest, self.joined
        a, b = self.starts[starts].tolist(), (self.ends[starts + sizes - 1] - 1).tolist()
        return np.fromiter((digest(joined[i:j]) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def paths(words: list[bytes], hashes: _Hashes, window: int = WINDOW, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """(anchor hash, path hash, first edge, number of edges) of a text's paths."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    t = _Text(words)
    k = t.anchors(words, hashes, short)
    w = window - short + 1
    place = np.lib.stride_tricks.sliding_window_view(k, w).argmin(axis=1) + np.arange(t.n - window + 1)
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(place)) + 1])
    edges = np.diff(np.concatenate([first, [len(place)]]))
    return k[place[first]], t.runs(first, edges + window - 1), first, edges


def edge_hashes(words: list[bytes], starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    return _Text(words).runs(starts, window)


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), (F.crc32(text.cast("binary")) - (1 << 31)).cast("int").alias("k2")]


def _once(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """The texts of a batch (columns k1, k2, t) that the task hasn't read before."""
    for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        if x[:2] not in seen:
            seen.add(x[:2])
            yield x[0], x[1], x[2].as_py()


def _batch(columns: list, names: str, rows: int) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names.split()) if rows else None


def repeated_spans(texts: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """(k1, k2, first, edges): runs of repeated edges of the texts in columns k1, k2, t (binary)."""
    schema = "h long, s long, k1 long, k2 int, first int, edges short"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for b in batches:
            held, n = [[] for _ in range(6)], 0
            for k1, k2, t in _once(b, seen):
                h, s, first, edges = paths(t.split(), hashes, window, short)
                if len(h):
                    for c, x in zip(held, (h.view(np.int64), s.view(np.int64), np.full(len(h), k1, np.int64), np.full(len(h), k2, np.int32), first.astype(np.int32), edges.astype(np.int16)), strict=True):
                        c.append(x)
                    n += len(h)
            if n:
                yield _batch(held, "h s k1 k2 first edges", n)

    every = stash(texts.select("k1", "k2", "t").mapInArrow(walk, schema), "paths")
    more = stash(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    shared = stash(semi_join(every, more, ["h"], "n"), "shared")
    unstash(every, more)
    # a path and its first place; one that occurs once is its own place
    kinds = stash(shared.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "edges")).alias("x")).select("h", "s", "n", "x.*"), "kinds")
    whole = semi_join(shared, kinds.where("n > 1").select("h", "s", "n"), ["h", "s"], "n").select("k1", "k2", "first", "edges")
    branching = stash(kinds.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("n")).where("least = 1"), "branching")
    opened = semi_join(kinds.withColumn("whole", F.col("n") > 1), branching, ["h"], "n").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "first", "edges", "whole")).alias("p"))
    sources = texts.select("k1", "k2", "t")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            got = list(_once(b, seen))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["k1", "k2", "t"])

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [[] for _ in range(6)], 0
            for k1, k2, t, p in zip(*(b.column(i) for i in range(4)), strict=True):
                p, words = p.as_py(), t.as_py().split()
                sizes = np.array([x["edges"] for x in p])
                starts = np.concatenate([np.arange(x["first"], x["first"] + x["edges"]) for x in p])
                e = edge_hashes(words, starts, window)
                h, known = (np.repeat(np.array([x[c] for x in p]), sizes) for c in ("h", "whole"))
                for c, x in zip(held, (h, e.view(np.int64), np.full(len(e), k1.as_py(), np.int64), np.full(len(e), k2.as_py(), np.int32), starts.astype(np.int32), known), strict=True):
                    c.append(x)
                n += len(e)
            if n:
                yield _batch(held, "h e k1 k2 at whole", n)

    # a task keeps a text's first copy, and of those one goes on
    single = sources.mapInArrow(once, "k1 long, k2 int, t binary").groupBy("k1", "k2").agg(F.first("t").alias("t"))
    edges = stash(single.join(opened, ["k1", "k2"]).select("k1", "k2", "t", "p").mapInArrow(edges_of, "h long, e long, k1 long, k2 int, at int, whole boolean"), "edges")
    again = edges.groupBy("h", "e").agg(F.sum(F.when(F.col("whole"), 2).otherwise(1)).alias("times"), F.count_if(~F.col("whole")).alias("n")).where("times > 1 AND n > 0")
    alone = semi_join(edges.where("not whole"), stash(again, "again"), ["h", "e"], "n").select("k1", "k2", F.col("at").alias("first"), F.lit(1).cast("short").alias("edges"))
    return whole.unionAll(alone)


def remove_repeats(df: DataFrame, window: int = WINDOW, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each of df's: doc_id, n_words, n_removed, kept_sha256, and the kept text if asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *_key(text), text.cast("binary").alias("t"))
    spans = repeated_spans(docs, window, short)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "edges")).alias("p"))
    copies = stash(docs.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    most = hot_bound(copies.agg(F.sum("n")).first()[0] or 0)
    # texts of very many copies need no spans: they are marked where they are and dealt evenly
    hot = copies.where(F.col("n") > most).select("k1", "k2", F.lit(True).alias("hot"))
    gone = spans.join(copies.where(F.col("n") <= most).select("k1", "k2", F.lit(True).alias("copied")), ["k1", "k2"], "full").withColumn("deal", F.lit(-1).cast("long"))
    marked = docs.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("deal", F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(-1))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, p, copied in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                words = t.as_py().split()
                keep = np.ones(len(words), bool)
                if copied and len(words) >= window:
                    keep[:] = False
                elif p.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = p.values
                    first = at.field("first").to_numpy().astype(np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + at.field("edges").to_numpy() + window - 1, -1)
                    keep = np.cumsum(change)[:-1] == 0
                kept = b" ".join([words[j] for j in np.flatnonzero(keep).tolist()])
                rows.append((i, len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return marked.join(gone, ["k1", "k2", "deal"], "left").select("doc_id", "t", "p", F.coalesce("hot", "copied").alias("copied")).mapInArrow(cut, schema)
