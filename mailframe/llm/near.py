"""Near copies by exact similarity: texts whose sets of 5-word shingles have a Jaccard similarity of at least ``THRESHOLD``.

Words, A-Z in lower case, give shingles of five; fewer words are one shingle, the whole sequence. Texts of the same words
are copies, known by 64 bits of hash. Texts without words are copies of each other.

SimHash. Fingerprints, the vantage-point tree and star components are those of ``simhash``: what lies within its radius is linked
first, each link of a spanning forest compared on words. A radius of 3 bits holds texts that differ in little; at a similarity of 0.8
fingerprints differ in up to 17 of 64 bits and more, where a tree sends every fingerprint both ways. What the tree leaves apart is searched for exactly:

Search. All shingles stand in one order. Of a text of n shingles the first n - ceil(0.8 n) + 1 in that order are its
prefix. Two similar texts share at least ceil(0.8 n) shingles of either, so their prefixes meet: no pair is missed, at any length.
The order is by hash, after which come common shingles, such as license lines, so that few pairs meet in them only: those that
most of a sample's texts hold. The sample is a share of the texts, so that what is common shows at any size. Any set of common ones leaves the results as they are.

No pairs are made under a shingle. All texts of a shingle go to the group of its least text, and a group's texts are compared in memory, in
blocks of bounded size, by parity bitmaps of ``BITS`` bits: a shingle flips one bit, so that two texts differ in at least as many shingles as their
bitmaps in bits; and two texts that share few shingles of their prefixes with any text can't share many. First a group gives a spanning forest of the pairs that may be similar by that bound, of the least differences, between what SimHash left apart, so that large groups of near copies are
joined by fewer pairs than they have texts. A large group does so within each of its blocks, where some ``PIVOTS`` of its texts come to all blocks and join what the
blocks find, so that this is linear in the group. Then it gives the pairs that may be similar between different components, each from the first group that both are
in: texts of one component are not compared any more, and blocks of one component don't meet, so that what is left to compare is what the forest left apart. All pairs that leave a group are compared on their words before they join anything.

Null texts are empty texts. Repeated rows and ids count once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import simhash
from .common import inner_join, left_join, salted_join, semi_join, stash, unstash
from .decontaminate import _shingles
from .simhash import components
from .substring import _Hashes

N, THRESHOLD = 5, 0.8
#: Texts that common shingles are looked for in, about, or this share of all, if that is more; how many of them make a shingle common; shingles at most (8 bytes each).
SAMPLE, SHARE, COMMON, MOST = 1 << 13, 1 / 64, 6, 1 << 20
#: Bits of a parity bitmap; texts of a block; texts of a large group that all its blocks hold, about; comparisons done at once; groups of a text that its pairs are known by.
BITS, BLOCK, PIVOTS, AT_ONCE, KNOWN = 2048, 4096, 64, 1 << 18, 16


def shingles(text: bytes | None) -> frozenset[tuple[bytes, ...]]:
    words = (text or b"").lower().split()
    n = min(N, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def similar(a: frozenset, b: frozenset, threshold: float = THRESHOLD) -> bool:
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def _hashed(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(_shingles(ids, min(N, len(words)))) if words else ids


def common(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the shingles, up to ``MOST``, that most texts of a sample hold."""
    h, share = F.xxhash64(F.lit(2), text_col), max(SHARE, SAMPLE / max(1, docs.count()))
    some = docs if share >= 1 else docs.where(h < F.lit(int(share * 2.0**64) - (1 << 63)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_hashed((t.as_py() or b"").lower().split(), hashes).view(np.int64))], names=["h"])

    found = some.select(F.col(text_col).cast("string").cast("binary").alias("t")).distinct().mapInArrow(each, "h long")
    top = found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST)
    return np.sort(top.toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def prefixes(df: DataFrame, last: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """df, whose last column is a text as binary, with key, n, prefix, bits (the parity bitmap) and fp (the SimHash fingerprint) in the text's place."""
    names, plain = [*df.columns[:-1], "key", "n", "prefix", "bits", "fp"], df.drop(df.columns[-1]).schema
    out = T.StructType([*plain.fields, T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("fp", T.LongType())])
    sent = df.sparkSession.sparkContext.broadcast(last)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, late = _Hashes(), sent.value
        for b in batches:
            keys, sizes, firsts, bits, fps = [], [], [], [], []
            for t in b.columns[-1]:
                words = (t.as_py() or b"").lower().split()
                fps.append(simhash.fingerprint(t.as_py()))
                h = _hashed(words, hashes)
                if len(late) and len(h):
                    is_late = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate([h[~is_late], h[is_late]])
                keys.append(xxhash.xxh64_intdigest(b" ".join(words), 11))
                sizes.append(len(h))
                bits.append(np.packbits(np.bincount((h >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes())
                firsts.append(h[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(bits, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=names)

    return df.mapInArrow(each, out)


def linked(known: DataFrame) -> DataFrame:
    """(a, b): keys, a below b, of texts that the vantage-point tree links, a written table: as connected as all fingerprints within its radius.

    Each fingerprint stands for its text of the least key; the other texts of a fingerprint are linked to that one.
    """
    least = stash(known.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("c")), "fingerprints")
    found = simhash.pairs(least.select("fp"))
    one = stash(left_join(found, least.select(F.col("fp").alias("a"), F.col("least").alias("x")), ["a"]).select("b", "x"), "one")
    both = left_join(one, least.select(F.col("fp").alias("b"), F.col("least").alias("y")), ["b"]).select("x", "y")
    same = inner_join(known.select("fp", "key"), least.where("c > 1"), ["fp"], "c").where("key <> least").select(F.col("least").alias("x"), F.col("key").alias("y"))
    out = stash(both.unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "linked")
    unstash(least, found, one)
    return out


def shared_shingles(known: DataFrame) -> DataFrame:
    """(h, key) of the shingles in the prefixes of more texts than one."""
    rows = stash(known.select("key", F.explode("prefix").alias("h")), "prefix-rows")
    counts = stash(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    shared = stash(semi_join(rows, counts, ["h"], "c"), "shared")
    unstash(rows, counts)
    return shared


class _Group:
    """A group's texts, of one block or of two of which only pairs across count."""

    def __init__(self, n: np.ndarray, met: np.ndarray, key: np.ndarray, bits: np.ndarray, block: np.ndarray, root: np.ndarray, across: bool, threshold: float) -> None:
        self.n, self.met, self.key, self.bits, self.block, self.root, self.across, self.threshold = n, met, key, bits, block, root, across, threshold

    def rows(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some texts at a time of those asked for, their share of differing shingles with all, at least, and which pairs may be similar."""
        n, met, key, t = self.n, self.met, self.key, self.threshold
        for at in range(0, len(which), step := max(1, AT_ONCE // len(key))):
            x = which[at : at + step]
            sizes, differ = n[x, None] + n[None, :], np.zeros((len(x), len(key)), np.int64)
            for w in range(self.bits.shape[1]):
                differ += np.bitwise_count(self.bits[x, None, w] ^ self.bits[None, :, w])
            shared, larger = np.ceil(t / (1 + t) * sizes - 1e-9), np.maximum(n[x, None], n[None, :])
            may = (differ <= sizes - 2 * shared) & (key[x, None] != key[None, :])
            may &= np.minimum(n[x, None], n[None, :]) >= t * larger - 1e-9
            # what the prefixes share, at most what either shares with any text, and all that follows the one that ends first
            may &= np.minimum(met[x, None], met[None, :]) + np.ceil(t * larger - 1e-9) - 1 >= shared
            if self.across:
                may &= self.block[x, None] != self.block[None, :]
            yield x, differ / np.maximum(sizes, 1), may

    def forest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that span the group's possible pairs between its roots: in each round every component but the largest takes its least difference to another."""
        _, first, place = np.unique(self.root, return_index=True, return_inverse=True)
        of = first[place]
        while True:
            best, to = np.full(len(of), np.inf), np.zeros(len(of), np.int64)
            for x, share, may in self.rows(np.flatnonzero(of != np.bincount(of).argmax())):
                share = np.where(may & (of[x, None] != of[None, :]), share, np.inf)
                to[x] = share.argmin(axis=1)
                best[x] = share[np.arange(len(share)), to[x]]
            order = np.lexsort((best, of))
            first = order[np.concatenate([[True], np.diff(of[order]) != 0])] if len(of) else order
            first = first[np.isfinite(best[first])]
            if not len(first):
                return
            yield self.key[first], self.key[to[first]]
            for i, j in zip(of[first].tolist(), of[to[first]].tolist(), strict=True):
                a, b = (self._root(of, x) for x in (i, j))
                of[max(a, b)] = min(a, b)
            while (of[of] != of).any():
                of = of[of]

    @staticmethod
    def _root(of: np.ndarray, x: int) -> int:
        while of[x] != x:
            x = int(of[x])
        return x

    def pairs(self, groups: np.ndarray, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of different components that no earlier group has: the texts outside the largest component are compared with all."""
        root = self.root
        _, place, sizes = np.unique(root, return_inverse=True, return_counts=True)
        largest = place == sizes.argmax()
        for x, _, may in self.rows(np.flatnonzero(~largest)):
            i, j = np.nonzero(may & (root[x, None] != root[None, :]) & (largest[None, :] | (self.key[x, None] < self.key[None, :])))
            i = x[i]
            for part in range(0, len(i), 4096):
                a, b = i[part : part + 4096], j[part : part + 4096]
                own = groups[a]
                new = ~((own[:, :, None] == groups[b][:, None, :]) & (own < group)[:, :, None]).any(axis=(1, 2))
                yield self.key[a[new]], self.key[b[new]]


def _blocks(large: DataFrame, forest: bool) -> tuple[DataFrame, list[DataFrame]]:
    """large, a written table (leader, key, root, m), with at, i, j, block: the cells of its group that a text goes to, one where i is j; and the tables that this reads.

    In the forest a text goes to its block, a pivot to all. Afterwards any two blocks meet but those of one component: a component
    of more texts than a block has blocks of its own, which follow those that the other texts share.
    """
    if forest:
        parts = F.ceil(F.col("m") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("key"), parts).cast("int")
        pivot = F.pmod(F.xxhash64(F.lit(3), "key"), F.ceil(F.col("m") / PIVOTS)) == 0
        cells = F.explode(F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)))
        return large.select("leader", "key", F.col("leader").alias("at"), cells.alias("i")).withColumns({"j": F.col("i"), "block": F.lit(0)}), []
    own = large.groupBy("leader", "root").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).withColumn("places", F.ceil(F.col("c") / BLOCK).cast("int"))
    # a group has fewer such components than it has blocks
    before = F.sum("places").over(Window.partitionBy("leader").orderBy("root")).cast("int") - F.col("places")
    own = stash(own.withColumn("before", before), "components-of-groups")
    taken = own.groupBy("leader").agg(F.sum("c").alias("taken"), F.sum("places").cast("int").alias("more"))
    groups = large.groupBy("leader").agg(F.count("*").alias("m")).join(taken, "leader", "left").fillna(0)
    others = F.ceil((F.col("m") - F.col("taken")) / BLOCK).cast("int")
    groups = stash(groups.select("leader", "m", others.alias("others"), (others + F.col("more")).alias("all")), "groups")
    placed = inner_join(left_join(large.drop("m"), own.select("leader", "root", "before", "places"), ["leader", "root"]), groups, ["leader"], "m")
    alone, h, start = F.col("places").isNotNull(), F.xxhash64("key"), F.col("others") + F.col("before")
    block = F.when(alone, start + F.pmod(h, "places")).otherwise(F.pmod(h, "others")).cast("int")
    # all blocks, but none of the component's own
    every = F.sequence(F.lit(0), F.col("all") - 1)
    meets = F.when(alone, F.filter(every, lambda k: (k < start) | (k >= start + F.col("places")))).otherwise(every)
    placed = placed.select("leader", "key", F.col("leader").alias("at"), block.alias("block"), meets.alias("meets"))
    placed = placed.select("leader", "key", "at", "block", F.explode("meets").alias("k"))
    return placed.select("leader", "key", "at", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block"), [own, groups]


def rooted(known: DataFrame, roots: DataFrame) -> DataFrame:
    """known with the least key of each text's component; roots: a in b's."""
    return known.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def meetings(shared: DataFrame, known: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The texts of each group under the cells (at, i, j) in which they are compared, and the tables that this reads; known may have roots for a forest.

    The cells are written before texts come to them: a plan of both would have the driver prepare the stages of all its scans at once.
    """
    least = stash(shared.groupBy("h").agg(F.min("key").alias("leader"), F.count("*").alias("c")), "least")
    led = stash(inner_join(shared, least, ["h"], "c").select("leader", "key").distinct(), "led")
    total = led.count()
    # the least groups of a text, by which a pair of two groups is known; leaving some out only makes a pair twice
    first = led.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("leader")), 1, KNOWN).alias("groups"))
    of = known.select("key", "n", "bits", "root" if "root" in known.columns else F.col("key").alias("root")) if roots is None else rooted(known.select("key", "n", "bits"), roots)
    texts = of.join(first, "key").join(shared.groupBy("key").agg(F.count("*").alias("met")), "key")
    sizes = stash(led.groupBy("leader").agg(F.count("*").alias("m")).where("m > 1").withColumn("c", F.col("m")), "sizes")
    slim = inner_join(led, sizes, ["leader"], "c")
    # small groups share tasks; a group of many texts is cut into blocks before its texts' bitmaps come to them
    small = slim.where(F.col("m") <= BLOCK).select("leader", "key", F.pmod(F.xxhash64("leader"), F.lit(total // BLOCK + 1)).alias("at"), *(F.lit(0).alias(x) for x in ("i", "j", "block")))
    cells, read = small, []
    if (sizes.agg(F.max("m")).first()[0] or 0) > BLOCK:
        large = stash(slim.where(F.col("m") > BLOCK).join(of.select("key", "root"), "key").select("leader", "key", "root", "m"), "large")
        cut, read = _blocks(large, roots is None)
        cells, read = small.unionByName(cut), [large, *read]
    cells = stash(cells, "cells")
    unstash(least, sizes, *read)
    return cells.join(texts, "key"), [led, cells]


def candidates(shared: DataFrame, known: DataFrame, threshold: float = THRESHOLD, roots: DataFrame | None = None) -> DataFrame:
    """(a, b): keys, a below b, of texts that meet in a shingle and may be similar: a spanning forest of each group, or all of different components (roots: a in b's)."""
    forest = roots is None

    def compare(t: pa.Table) -> pa.Table:
        of = t.column("leader").to_numpy()
        order = np.argsort(of, kind="stable")
        across = t.column("i")[0] != t.column("j")[0]
        t, of = t.take(pa.array(order)), of[order]
        n, met, key, block, root = (t.column(x).to_numpy().astype(np.int64) for x in ("n", "met", "key", "block", "root"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
        groups = np.full((len(key), KNOWN), np.iinfo(np.int64).max)
        for row, own in enumerate(t.column("groups").to_pylist()):
            groups[row, : len(own)] = own
        edges = np.flatnonzero(np.diff(of, prepend=of[0] - 1 if of[0] > np.iinfo(np.int64).min else of[0] + 1)) if len(of) else np.zeros(0, np.int64)
        found = [(np.zeros(0, np.int64),) * 2]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], strict=True):
            g = _Group(n[a:b], met[a:b], key[a:b], bits[a:b], block[a:b], root[a:b], across, threshold)
            found += g.forest() if forest else g.pairs(groups[a:b], int(of[a]))
        x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    cells, read = meetings(shared, known, roots)
    out = stash(cells.groupBy("at", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "candidates")
    unstash(*read)
    return out


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, bits) of texts (key, t): parity bitmaps of four bits a shingle or more."""
    hashes = _Hashes()
    for b in batches:
        got = [_hashed(t.as_py().lower().split(), hashes) for t in b.column(1)]
        bits = [np.packbits(np.bincount((h >> np.uint64(17)).astype(np.int64) % (1 << max(9, (4 * len(h)).bit_length())), minlength=1 << max(9, (4 * len(h)).bit_length())) & 1).tobytes() for h in got]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in got], pa.int32()), pa.array(bits, pa.binary())], names=["key", "n", "bits"])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap folded to fewer bits, each the parity of those that meet in it."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def possible(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that bitmaps as large as the texts ask for allow to be similar: a twelfth of the texts moves."""
    large = stash(texts.mapInArrow(_large, "key long, n int, bits binary"), "bitmaps")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, x, nb, y in zip(*(b.column(i) for i in range(2, 6)), strict=True):
                x, y, size = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8), na.as_py() + nb.as_py()
                least = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum())
                keep.append(differ <= size - 2 * np.ceil(threshold / (1 + threshold) * size - 1e-9))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = salted_join(salted_join(pairs, large.toDF("a", "na", "xa"), "a", pairs), large.toDF("b", "nb", "xb"), "b", pairs)
    out = stash(both.select("a", "b", "na", "xa", "nb", "xb").mapInArrow(allowed, "a long, b long"), "possible")
    unstash(large)
    return out


def verified(pairs: DataFrame, known: DataFrame, marked: DataFrame, own: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The pairs, a written table, whose texts are similar by their words. Only texts in pairs move, and with pairs only where larger bitmaps allow it."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = stash(known.join(met, "key", "left_semi").select("key", *(F.col(f"best.{x}").alias(x) for x in own)), "met")
    texts = stash(marked.join(rows, own).select("key", "t").dropDuplicates(["key"]), "texts")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("ta"), b.column("tb")
            yield b.select(["a", "b"]).filter(pa.array([similar(shingles(s.as_py()), shingles(t.as_py()), threshold) for s, t in zip(x, y, strict=True)], pa.bool_()))

    left = possible(pairs, texts, threshold)
    both = salted_join(salted_join(left, texts.toDF("a", "ta"), "a", left), texts.toDF("b", "tb"), "b", left)
    out = stash(both.select("a", "b", "ta", "tb").mapInArrow(compared, "a long, b long"), "similar")
    unstash(texts, rows, pairs, left)
    return out


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The components of roots and what was found between them, both written tables that go."""
    out = components(roots.unionAll(found))
    unstash(roots, found)
    return out


def first_of_each(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of df for each component of similar texts: the one with the least id (null last), then the least hash of the row."""
    own, row = ["own1", "own2"], F.struct("*")
    # a row is carried as one value, whatever its columns are called
    marked = df.select(row.alias("row"), F.xxhash64(row).alias(own[0]), F.xxhash64(F.lit(1), row).alias(own[1]), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    slim = marked.select("id", *own, "t")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *own)).alias("best")
    rows = stash(prefixes(slim, common(df, text_col), threshold), "prefixes")
    known = stash(rows.groupBy("key").agg(best, F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "distinct")
    # rows that are the same in all columns
    same = stash(rows.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(*own), "same")
    unstash(rows)
    # what the tree links, by words; then what it left apart
    tree = verified(linked(known), known, marked, own, threshold)
    shared = shared_shingles(known)
    roots = components(tree)
    near = verified(candidates(shared, rooted(known, roots), threshold), known, marked, own, threshold)
    # stars are as connected as what they were made of
    roots = joined(roots, near)
    more = verified(candidates(shared, known, threshold, roots), known, marked, own, threshold)
    roots = joined(roots, more)
    best = known.join(roots.withColumnRenamed("a", "key"), "key", "left").groupBy(F.coalesce("b", "key").alias("root")).agg(F.min("best").alias("best")).select(*(F.col(f"best.{x}").alias(x) for x in own))
    kept = stash(best.join(same.withColumn("again", F.lit(True)), own, "left"), "kept")
    unstash(known, shared, tree, same, roots)
    # of rows that are the same one stays; they meet before they move
    single = marked.join(kept.where("again IS NULL").select(*own), own, "left_semi")
    return single.unionAll(marked.join(kept.where("again").select(*own), own, "left_semi").dropDuplicates(own)).select("row.*")
