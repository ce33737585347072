"""Periodic runs of words: every stretch that repeats with a smallest period q at least ``times`` times.

All lags are scanned: the array of a text's word ids is compared with itself shifted by q, for each q up to a third of its words, and
stretches of agreement are the runs of that lag. A stretch must be ``wanted(q)`` long, at least 2q, so a shift is compared first on
a grid of an eighth of that, and word by word only around grid points of which as many in a row agree as a stretch would hold: nothing is missed, and a
lag costs 4/q of the words. Many texts lie one after the other in one array, shortest first, so that each shift is one comparison of
those that are long enough. Between texts stand ids of their own; what agrees across one is shorter than q and so no run.

A stretch whose smallest period is a divisor of q is the run of the divisor, with the same ends: of runs with the same ends that of
the least period counts.

A text of over ``part`` bytes is dealt out: as many rows as parts, each with a range of the lags, meet again by row.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and no runs. A null id takes no rewriting. Repeated rows give
repeated results; empty tables none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

TIMES = 3
LEAST = 24
#: Bytes of texts that are scanned in one array, and of a text whose lags are one row.
SLICE = 1 << 22
PART = 1 << 21

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with the tail that a document's id asks for, in one of ten, repeated with a period."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last) of each run of at least so many true values."""
    t = np.flatnonzero(same)
    if len(t) < least:
        return []
    cut = np.flatnonzero(np.diff(t) != 1)
    first, last = t[np.concatenate(([0], cut + 1))], t[np.concatenate((cut, [len(t) - 1]))]
    keep = last - first >= least - 1
    return list(zip(first[keep].tolist(), last[keep].tolist(), strict=True))


def scan(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST, part: int = 0, parts: int = 1) -> list[list[Run]]:
    """For each text its runs (start, length, period) by start, then period; of the lags only a range if there are parts."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((x for k, i in enumerate(order) for x in (*(ids.setdefault(w, len(ids)) for w in texts[i]), -1 - k)), np.int32)
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    lags = int(sizes[-1]) // times if len(sizes) else 0
    for q in range(1 + lags * part // parts, 1 + lags * (part + 1) // parts):
        k = int(np.searchsorted(sizes, max(least, times * q)))
        if k == len(sizes):
            break
        base = int(begins[k])
        a = flat[base:]
        wanted = max(least - q, (times - 1) * q)
        step = max(1, wanted // 8)
        end = len(a) - q
        for x, y in _stretches(a[:end:step] == a[q::step], max(1, wanted // step)):
            lo = max(0, (x - 1) * step)
            hi = min(end, (y + 1) * step + 1)
            for s, e in _stretches(a[lo:hi] == a[lo + q : hi + q], wanted):
                doc = int(np.searchsorted(begins, base + lo + s, "right")) - 1
                start = base + lo + s - int(begins[doc])
                # lags come in ascending order
                found[order[doc]].setdefault((start, e - s + 1 + q), q)
    return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]


def smallest(runs: list[Run]) -> list[Run]:
    """Of runs with the same ends that of the least period; by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for s, n, q in sorted(runs, key=lambda x: x[2]):
        best.setdefault((s, n), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def report(words: list[bytes], runs: list[Run]) -> tuple:
    """n_runs, the run with the greatest exponent, digests of the runs and of the words that are kept, runs, kept words."""
    runs = sorted(runs, key=lambda x: (x[0], x[2]))
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    kept = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if runs else b" ".join(words)
    best: tuple = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
        best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), runs, kept.decode()


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2
_RUNS, _RUNS_ARROW = "array<struct<start:int,length:int,period:int>>", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))


def _as_rows(runs: list[Run]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def find(df: DataFrame, times: int = TIMES, least: int = LEAST, rewrite: Rewrite | None = None, part: int = PART, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each of df's: doc_id, how many runs, the run with the greatest exponent (ties: least start, then period), digests; with_text: also the runs and the kept text."""
    schema = COLUMNS + f", runs {_RUNS}, collapsed_text string" * with_text
    names, kinds = [x.split()[0] for x in COLUMNS.split(", ")], [*_KINDS]
    if with_text:
        names, kinds = [*names, "runs", "collapsed_text"], [*kinds, _RUNS_ARROW, pa.string()]

    def words_of(doc: int | None, t: pa.Scalar) -> list[bytes]:
        words = t.as_py().split()  # bytes split at ASCII white space
        return rewrite(doc, words) if rewrite else words

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        shown = [(*r[:-2], *([_as_rows(r[-2]), r[-1]] if with_text else [])) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*shown, strict=True), kinds, strict=True)], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, held, size = b.column(0).to_pylist(), [], 0
            for i, t in enumerate(b.column(1)):
                held.append((docs[i], words_of(docs[i], t)))
                size += len(t.as_buffer())
                if size >= SLICE or i + 1 == b.num_rows:
                    found = scan([w for _, w in held], times, least)
                    yield batch([(doc, *report(w, runs)) for (doc, w), runs in zip(held, found, strict=True)])
                    held, size = [], 0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, doc, t, k, n in zip(*(b.column(i) for i in range(5)), strict=True):
                runs = scan([words_of(doc.as_py(), t)], times, least, k.as_py(), n.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array([r.as_py()]), pa.array([_as_rows(runs)], _RUNS_ARROW)], names=["r", "found"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, found in zip(*(b.column(i) for i in range(3)), strict=True):
                runs = smallest([(x["start"], x["length"], x["period"]) for some in found.as_py() for x in some])
                yield batch([(doc.as_py(), *report(words_of(doc.as_py(), t), runs))])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    size = F.octet_length("t")
    few = docs.where(size <= part).mapInArrow(short, schema)
    large = stash(docs.where(size > part).withColumn("r", F.monotonically_increasing_id()), "long")
    if large.isEmpty():
        return few
    parts = F.ceil(size / part).cast("int")
    dealt = large.withColumns({"parts": parts, "part": F.explode(F.sequence(F.lit(0), parts - 1))}).repartition("r", "part")
    runs = dealt.select("r", "doc_id", "t", "part", "parts").mapInArrow(ranges, f"r long, found {_RUNS}").groupBy("r").agg(F.collect_list("found").alias("found"))
    return few.unionAll(large.join(stash(runs, "runs"), "r").select("doc_id", "t", "found").mapInArrow(long, schema))
