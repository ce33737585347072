"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius by vantage-point trees, components.

A text's words, A-Z in lower case, give shingles of three (the whole sequence if it is shorter). A bit of the
64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats included. A text
without words has fingerprint 0.

Links. The distinct fingerprints are dealt to shards, the leaves of a vantage-point tree: a node has a vantage
fingerprint v and a radius m; a fingerprint x is at home inside if d(x, v) <= m, else outside. By the triangle
bound, whatever lies within r of x is inside or outside as x is, unless |d(x, v) - m| is small; in that overlap x
visits the other side as well. So every pair within r meets in the home leaf of either. In a leaf the home
fingerprints are compared with all others, rings of equal distance to a further vantage with the rings at most r
away, down to blocks small enough to compare bit by bit. The tree is as deep as it takes to have ``HOME`` fingerprints
at home in a leaf. Its upper levels are fitted on a bounded sample (at most ``SAMPLE`` fingerprints, by a range of
hashes); below them, where the sample ends, a node's vantage is a number mixed from its place, so that no table grows with the
rows. Every fingerprint is dealt through the tree, so that results are exact whatever the sample and the vantages. Leaves that
are large all the same are cut into a grid of blocks of at most ``BLOCK`` fingerprints a side.

Copies share a fingerprint and count once. A block gives a star for each of its groups and not all pairs.
Stars of all blocks are joined to components by rounds of alternating large and small stars, each written to the
shared folder.

Null texts are empty texts. A null id is never the least of its component unless all its ids are null.
Repeated rows and ids stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import inner_join, stash, unstash

RADIUS = 3
#: Fingerprints that the tree is fitted on; those at home in a leaf, about; side of a block; comparisons done at once.
SAMPLE, HOME, BLOCK, AT_ONCE = 1 << 16, 2048, 1 << 14, 1 << 19
#: Dealt fingerprints that leave a task at once, about.
DEALT = 1 << 16
_ALL = (1 << 64) - 1
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: bytes | None, n: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[n - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with its texts' fingerprints as a long column (the 64 bits as they are)."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields), T.StructField("_simhash_text", T.BinaryType())])
    out = T.StructType([*schema.fields[:-1], T.StructField(name, T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py()) for x in b.columns[-1]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.view(np.int64))], names=[f.name for f in out.fields])

    return df.withColumn("_simhash_text", F.col(text_col).cast("string").cast("binary")).mapInArrow(each, out)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(place: int) -> int:
    """A number of 64 mixed bits for a node below the sample."""
    x = (place * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & _ALL
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * odd & _ALL
    return x ^ (x >> 31)


class Tree:
    """The vantage-point tree: upper levels fitted on a sample, those below by place.

    The root's place is 1; a node's children have twice its place and one more than that.
    """

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS, seed: int = 1) -> None:
        self.radius, self.depth = radius, depth
        self.nodes: dict[int, tuple[int, int]] = {}  # place: vantage, greatest distance inside
        self._grow(sample, 1, depth, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, place: int, depth: int, rng: np.random.Generator) -> None:
        best = None
        if depth and len(x) > 16:
            for v in rng.choice(x, min(12, len(x)), replace=False):
                d = _distance(x, v)
                m = int(np.median(d))
                for m in (m - 1, m):
                    inside, both = int((d <= m).sum()), int(((d > m - self.radius) & (d <= m + self.radius)).sum())
                    worst = max(inside, len(x) - inside) + both
                    if 0 < inside < len(x) and (best is None or worst < best[0]):
                        best = (worst, v, m, d)
        if best is not None:
            _, v, m, d = best
            self.nodes[place] = int(v), m
            self._grow(x[d <= m], 2 * place, depth - 1, rng)
            self._grow(x[d > m], 2 * place + 1, depth - 1, rng)

    def node(self, place: int) -> tuple[int, int]:
        """Vantage and greatest distance inside; for numbers of 64 random bits half the distances are up to 31 or 32."""
        return self.nodes.get(place) or (_vantage(place), 31 + place.bit_length() % 2)

    def deal(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, fingerprints that reach it, whether each is at home there)."""
        todo = [(1, x, np.ones(len(x), bool))]
        while todo:
            place, x, home = todo.pop()
            if place.bit_length() > self.depth:
                yield place, x, home
                continue
            v, m = self.node(place)
            d = _distance(x, np.uint64(v)).astype(np.int16)
            a, b = d <= m + self.radius, d > m - self.radius
            if a.any():
                todo.append((2 * place, x[a], home[a] & (d[a] <= m)))
            if b.any():
                todo.append((2 * place + 1, x[b], home[b] & (d[b] > m)))


class _Groups:
    """Least-index labels of points joined by pairs; pairs are folded in as they come. ``joined`` (if kept): a spanning forest of them."""

    def __init__(self, n: int, keep: bool = False) -> None:
        self.of, self.waiting, self.held = np.arange(n), [], 0
        self.keep, self.joined = keep, [(np.zeros(0, np.int64),) * 2]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > 1 << 21:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.held = [], 0
            while len(a):
                x, y = self.of[a], self.of[b]
                differ = x != y
                a, b = a[differ], b[differ]
                low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
                np.minimum.at(self.of, high, low)
                if self.keep:
                    # one pair for each label that a lesser one takes in
                    won = np.flatnonzero(self.of[high] == low)
                    won = won[np.unique(high[won], return_index=True)[1]]
                    self.joined.append((a[won], b[won]))
                while (self.of[self.of] != self.of).any():
                    self.of = self.of[self.of]
        return self.of


def _meet(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, radius: int, groups: _Groups, depth: int = 0) -> None:
    """Pairs within the radius of a's and b's fingerprints (of which ia and ib are the indices) go to groups."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= AT_ONCE or depth > 12:
        rows = max(1, AT_ONCE // len(b))
        for at in range(0, len(a), rows):
            i, j = np.nonzero(_distance(a[at : at + rows, None], b[None, :]) <= radius)
            if len(i):
                groups.add(ia[at + i], ib[j])
        return
    v = a[len(a) // 2]
    da, db = _distance(a, v), _distance(b, v).astype(np.int16)
    order = np.argsort(db, kind="stable")
    b, ib, db = b[order], ib[order], db[order]
    for k in np.unique(da).tolist():
        lo, hi = np.searchsorted(db, (k - radius, k + radius + 1))
        ring = da == k
        _meet(a[ring], b[lo:hi], ia[ring], ib[lo:hi], radius, groups, depth + 1)


def _stars(home: np.ndarray, others: np.ndarray, radius: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least of its group) of the groups that the links between home and others make; pairs: links that span them."""
    points = np.unique(np.concatenate([home, others]))
    groups = _Groups(len(points), pairs)
    home, others = np.unique(home), np.unique(others)
    _meet(home, others, np.searchsorted(points, home), np.searchsorted(points, others), radius, groups)
    of = groups.fold()
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*groups.joined, strict=True))
        return points[a].view(np.int64), points[b].view(np.int64)
    at = np.flatnonzero(of != np.arange(len(points)))
    return points[at].view(np.int64), points[of[at]].view(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (a, b) over a column ``fp`` of distinct fingerprints: as connected as all pairs within the radius."""
    return _links(distinct, radius, False)[0]


def pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a below b, a written table: as ``links``, but each within the radius, so that what is linked can be compared."""
    found, read = _links(distinct, radius, True)
    out = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    unstash(*read)
    return out


def _links(distinct: DataFrame, radius: int, real: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Stars, or links that span them, of each block of the tree's leaves, and the tables that this reads."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / HOME))))
    # a share of the hashes' range that holds half of the sample's bound on average: no sort, no exchange
    share = min(SAMPLE, 64 << min(depth, 10)) / 2 / max(1, n)
    some = distinct if share >= 1 else distinct.where(F.xxhash64("fp") < F.lit(int(share * 2.0**64) - (1 << 63)))
    taken = some.select("fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    tree = Tree(taken.view(np.uint64), depth, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            leaves = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            return pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(np.concatenate([h[1] for h in held]).view(np.int64)), pa.array(np.concatenate([h[2] for h in held]))], names=["leaf", "fp", "home"])

        held, n = [], 0
        for b in batches:
            for part in tree.deal(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                held.append(part)
                n += len(part[1])
                if n >= DEALT:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    dealt = stash(distinct.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean"), "leaves")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("down"), F.ceil(F.count("*") / BLOCK).cast("int").alias("across"))
    # only leaves that are one block need no place in a grid; Spark broadcasts the others' sizes if they are few
    grids = stash(sizes.where("down <> 1 OR across <> 1"), "grids")
    there = dealt.join(grids, "leaf", "left").withColumns({"down": F.coalesce("down", F.lit(1)), "across": F.coalesce("across", F.lit(1))})
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest("down", F.lit(1))).cast("int")
    place = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("across")).cast("int")
    a = there.where("home").select("leaf", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), "fp", F.lit(True).alias("home"))
    b = there.where("down > 0").select("leaf", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), place.alias("j"), "fp", F.lit(False).alias("home"))

    def block(t: pa.Table) -> pa.Table:
        fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy()
        x, y = _stars(fp[home], fp[~home], radius, real)
        return pa.table({"a": pa.array(x), "b": pa.array(y)})

    return a.unionAll(b).groupBy("leaf", "i", "j").applyInArrow(block, "a long, b long"), [dealt, grids]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each a of the edges that is not the least of its component, b being the least."""
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = edges.count()
    while n:
        # large stars: whatever is above a point hangs from the least around it; a point of very many edges is hot
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
        large = stash(inner_join(up, least, ["a"], "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small stars: a point and its lesser ones hang from the least of them
        lower = stash(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        joined = inner_join(large.withColumnRenamed("b", "v"), lower, ["a"], "n").select(F.col("v").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stash(joined.where("a <> b").unionAll(lower.select("a", F.col("m").alias("b"))).distinct(), "stars")
        unstash(last, least, large, lower)
        n, points = edges.agg(F.count("*"), F.count_distinct("a")).first()
        # each point has one edge, and none to a point that has one: the stars are the components
        if n == points and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return edges


def near_duplicates(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of df's: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    docs = stash(fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")), "_t", "fp").drop("_t"), "fingerprints")
    known = stash(docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(known.select("fp"), radius))
    # (fingerprint, its component's least fingerprint), then the least id of each component
    of = stash(known.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", F.coalesce("b", "fp").alias("root"), "doc_id", "n"), "roots")
    least = stash(of.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")), "components")
    own = stash(inner_join(of.select("root", "fp", "n"), least, ["root"], "m").select("fp", "component_id", "n"), "own")
    return inner_join(docs, own, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of df for each component: the one with the least id (null last), then the least hash of the row."""
    own, row = ["own1", "own2"], F.struct("*")
    marked = df.select(row.alias("row"), F.xxhash64(row).alias(own[0]), F.xxhash64(F.lit(1), row).alias(own[1]), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    slim = stash(fingerprints(marked.select("id", *own, "_t"), "_t", "fp").drop("_t"), "fingerprints")
    known = stash(slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *own)).alias("best")), "distinct")
    roots = components(links(known.select("fp"), radius))
    best = known.join(roots.withColumnRenamed("a", "fp"), "fp", "left").groupBy(F.coalesce("b", "fp").alias("root")).agg(F.min("best").alias("best"))
    # rows that are the same meet before they move
    return marked.dropDuplicates(own).join(best.select(*(F.col(f"best.{x}").alias(x) for x in own)), own, "left_semi").select("row.*")
