"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Each component x becomes floor(scale * x), x as double; scores are integers and exact. Tasks pack the rows they read into
tiles of at most ``TILE`` vectors of one length, of 2 bytes a component where the integers fit; queries are packed likewise
beside them. The tiles are written once. Query tiles and candidate tiles are dealt to the cells of a grid, so that each
query tile meets each candidate tile in one cell; a cell has about ``CELL`` bytes of either side, whatever the number of rows. In a
cell each pair of tiles gives, by one matrix product and one partial selection a query, its k best candidates, merged as
they come: k a query and cell at most. The lists of the cells are then merged as a tree: first within groups of
columns of the grid, then among the groups. The driver gets two sums.

Products are taken in float64 where every partial sum is below 2^53, so that it is exact, and otherwise in
Python's integers; a score beyond 64 bits becomes the nearest long. Vectors meet only others of their own length.

Vectors that are null, or hold a null or a component that is not finite, take no part, nor do null ids.
Empty vectors score 0 with each other. A query is a row and isn't its own candidate; other rows of its id are. Repeated query
rows give a result each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

TILE, QUERIES_AT_ONCE, GROUP, CELL = 4096, 512, 64, 1 << 24
_LONG = np.iinfo(np.int64)


def _usable(df: DataFrame, id_col: str, vector_col: str, query: Column, candidate: Column) -> DataFrame:
    """(vec_id, v, query, candidate) of the rows that take part."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("query"), candidate.alias("candidate"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)


_TILES = "dim int, role string, kind string, n int, ids binary, places binary, numbers binary"


def _packed(v: np.ndarray, scale: int) -> tuple[str, bytes]:
    """Scaled integers, as 2 bytes or doubles; components whose product isn't finite stay as they are."""
    scaled = np.floor(v * float(scale))
    if not np.isfinite(scaled).all():
        return "raw", v.tobytes()
    if (np.abs(scaled) < 1 << 15).all():
        return "short", scaled.astype("<i2").tobytes()
    return "double", scaled.tobytes()


def _unpacked(kind: str, numbers: bytes, n: int, dim: int, scale: int) -> np.ndarray:
    v = np.frombuffer(numbers, "<i2" if kind == "short" else "<f8").reshape(n, dim)
    if kind == "raw":
        # a component of 2^53 or more is whole, and so is its product
        return np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in v.tolist()], object).reshape(n, dim)
    return v.astype(np.float64)


def _pack(scale: int):  # noqa: ANN202
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple[np.ndarray, ...]]] = {}
        place = TaskContext.get().partitionId() << 40

        def tile(dim: int, role: str) -> pa.RecordBatch:
            ids, places, v = (np.concatenate(x) for x in zip(*held.pop((dim, role)), strict=True))
            kind, numbers = _packed(v, scale)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([role]), pa.array([kind]), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), places.tobytes(), numbers))], names=[x.split()[0] for x in _TILES.split(", ")])

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            places = place + np.arange(b.num_rows)
            place += b.num_rows
            offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for role, flag in (("query", b.column(2)), ("candidate", b.column(3))):
                own = flag.to_numpy(zero_copy_only=False).astype(bool)
                for dim in np.unique(sizes[own]).tolist():
                    at = np.flatnonzero(own & (sizes == dim))
                    rows = flat[offsets[at][:, None] + np.arange(dim)].reshape(len(at), dim)
                    for start in range(0, len(at), TILE):
                        part = slice(start, start + TILE)
                        held.setdefault((dim, role), []).append((ids[at[part]], places[at[part]], rows[part]))
                        if sum(len(x[0]) for x in held[dim, role]) >= TILE:
                            yield tile(dim, role)
        for dim, role in list(held):
            yield tile(dim, role)

    return pack


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q times the transpose of c, exact."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    if object not in (q.dtype, c.dtype) and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = [m if m.dtype == object else np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
    return np.clip(whole[0] @ whole[1].T, int(_LONG.min), int(_LONG.max)).astype(np.int64)


class _Best:
    """For each query the k best candidates so far: scores descending, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.score, self.vec_id = k, np.zeros((queries, 0), np.int64), np.zeros((queries, 0), np.int64)
        self.real = np.zeros((queries, 0), bool)

    def add(self, at: slice, score: np.ndarray, vec_id: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        score, vec_id, real = (np.concatenate(x, axis=1) for x in ((self.score[at], score), (self.vec_id[at], vec_id), (self.real[at], real)))
        order = np.lexsort((vec_id, ~score, ~real), axis=1)[:, : self.k]
        return tuple(np.take_along_axis(x, order, 1) for x in (score, vec_id, real))


def _select(score: np.ndarray, vec_id: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of a tile for each query, of the others; vec_id is ascending, so that of equal scores the first places win."""
    n = score.shape[1]
    if n > k:
        # rank of each score in the tile, then place: a key that no two candidates share
        low = score.min(axis=1, keepdims=True)
        span = int(score.max()) - int(score.min())
        if span < (1 << 62) // n:
            key = np.where(other, (score - low + 1) * n - np.arange(n), -np.arange(1, n + 1))
            at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            at = np.stack([np.lexsort((np.arange(n), ~s, ~o))[:k] for s, o in zip(score, other, strict=True)])
    else:
        at = np.broadcast_to(np.arange(n), score.shape)
    return np.take_along_axis(score, at, 1), vec_id[at], np.take_along_axis(other, at, 1)


def _merged(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """Lists (n = -1 - score, vec_id) joined to one of at most k for each key."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return lists.groupBy(*by).agg(best.alias("best"))


def search(vectors: DataFrame, queries: Column | DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each query and rank: query_id, rank (from 1), vec_id, score.

    queries: a condition that says which of the vectors are queries too, or a table of others.
    """
    if isinstance(queries, Column):
        rows = _usable(vectors, id_col, vector_col, queries, F.lit(True))
    else:
        rows = _usable(vectors, id_col, vector_col, F.lit(False), F.lit(True)).unionAll(_usable(queries, id_col, vector_col, F.lit(True), F.lit(False)))
    tiles = stash(rows.mapInArrow(_pack(scale), _TILES), "tiles")
    side = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("numbers"))), F.lit(0))
    there, sought, filled = tiles.agg(side("candidate"), side("query"), F.count_if(F.col("role") == "candidate")).first()
    # as many columns as the cluster has cores, if there are so many tiles, and more where cells would grow
    across = max(-(-there // CELL), min(filled, vectors.sparkSession.sparkContext.defaultParallelism), 1)
    down = max(-(-sought // CELL), 1)
    own = F.xxhash64("ids", "places")
    i, j = (lambda n: F.pmod(own, F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    asked = tiles.where("role = 'query'").select("*", i(down).alias("i"), j(across).alias("j"))
    offered = tiles.where("role = 'candidate'").select("*", j(down).alias("i"), i(across).alias("j"))

    def cell(t: pa.Table) -> pa.Table:
        read = {"query": [], "candidate": []}
        for r in t.select(["role", "dim", "kind", "n", "ids", "places", "numbers", "j"]).to_pylist():
            read[r["role"]].append(r)
        out: dict[str, list] = {x: [] for x in ("place", "query_id", "part", "best")}
        for q in read["query"]:
            ids, places, v = np.frombuffer(q["ids"], np.int64), np.frombuffer(q["places"], np.int64), _unpacked(q["kind"], q["numbers"], q["n"], q["dim"], scale)
            best = _Best(len(ids), k)
            for c in read["candidate"]:
                order = np.argsort(np.frombuffer(c["ids"], np.int64), kind="stable")
                vec_id, at = (np.frombuffer(c[x], np.int64)[order] for x in ("ids", "places"))
                w, parts = _unpacked(c["kind"], c["numbers"], c["n"], c["dim"], scale)[order], []
                for start in range(0, len(ids), QUERIES_AT_ONCE):
                    s = slice(start, start + QUERIES_AT_ONCE)
                    parts.append(best.add(s, *_select(_products(v[s], w), vec_id, at[None, :] != places[s][:, None], k)))
                best.score, best.vec_id, best.real = (np.concatenate(x) for x in zip(*parts, strict=True))
            for row in range(len(ids)):
                found = [{"n": ~int(s), "vec_id": int(x)} for s, x, real in zip(best.score[row], best.vec_id[row], best.real[row], strict=True) if real]
                if found:
                    for x, y in zip(out.values(), (int(places[row]), int(ids[row]), q["j"], found), strict=True):
                        x.append(y)
        return pa.table(out, pa.schema([("place", pa.int64()), ("query_id", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.struct([("n", pa.int64()), ("vec_id", pa.int64())])))]))

    lists = asked.unionAll(offered).groupBy("dim", "i", "j").applyInArrow(cell, "place long, query_id long, part int, best array<struct<n:long,vec_id:long>>")
    grouped = _merged(lists.withColumn("part", F.floor(F.col("part") / GROUP)), k, "place", "query_id", "part")
    merged = _merged(grouped, k, "place", "query_id")
    each = merged.select("query_id", F.posexplode("best").alias("i", "x"))
    return each.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-1 - F.col("x.n")).alias("score"))
