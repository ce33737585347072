"""What the operators of this subpackage share: the shared folder, written tables, ranks over all rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's bound of a batch that goes to Python, 64 MB by default; what it is lowered to.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Lets texts go to Python in batches of about ``BATCH`` bytes, for all that the session runs from now on; a bound that the session has set itself stays.

    A batch is in an executor several times at once, outside the heap and in the worker, for each task, and neither gives memory back.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs inside one machine is a temporary folder taken.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/mailframe-shared"


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, under the application's id; removed by ``clear`` or when the driver's process ends."""
    path = f"{shared_dir(spark)}/mailframe/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stash(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._mailframe_path = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more: what was made of them is written too."""
    paths = {x._mailframe_path for x in tables}
    for at in [x for x in _written if x[1] in paths]:
        _delete(*at)
        _written.remove(at)


def clear(spark: SparkSession) -> None:
    """Removes all tables and files that operators of this session have written; for long-lived drivers, after results are stored elsewhere."""
    for at in [x for x in _written if x[0] is spark]:
        _delete(*at)
        _written.remove(at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for at in _written:
        try:
            _delete(*at)
        except Exception:  # noqa: BLE001  the JVM has gone already; the folder's owner clears it
            return


#: A key is hot if over one in so many rows have it, and over so many: there are never more hot keys than that.
HOT = 4096


def hot_bound(total: int) -> int:
    return max(HOT, total // HOT)


def semi_join(rows: DataFrame, found: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows whose keys are in ``found``: a written table with a row a key and, in n, how many of the rows have it.

    Hot keys, at most ``HOT`` by their definition, are broadcast, so that their rows stay where they are; the
    others meet by a shuffle that no key fills. If no key is hot, that is all there is to prepare.
    """
    total, largest = found.agg(F.sum(n), F.max(n)).first()
    most = hot_bound(total or 0)
    if (largest or 0) <= most:
        return rows.join(found.select(*keys), keys, "left_semi")
    hot = F.broadcast(found.where(F.col(n) > most).select(*keys))
    others = rows.join(hot, keys, "left_anti").join(found.where(F.col(n) <= most).select(*keys), keys, "left_semi")
    return rows.join(hot, keys, "left_semi").unionAll(others)


def inner_join(rows: DataFrame, found: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """rows joined to ``found`` as in ``semi_join``, with found's other columns but n; total: the sum of n or more, if it is known."""
    largest = total
    if total is None:
        total, largest = (x or 0 for x in found.agg(F.sum(n), F.max(n)).first())
    most = hot_bound(total)
    if largest <= most:
        return rows.join(found.drop(n), keys)
    hot, others = (found.where(x).drop(n) for x in (F.col(n) > most, F.col(n) <= most))
    return rows.join(F.broadcast(hot), keys).unionAll(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others, keys))


def left_join(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows, a written table, with the other columns of ``found``, which has a row a key at most, null where there is none.

    Rows of hot keys get them from a broadcast of at most ``HOT`` keys and are dealt evenly; the others meet by a shuffle.
    """
    values = [x for x in found.columns if x not in keys]
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_bound(rows.count())).select(*keys)
    hot = hot.join(found.withColumnsRenamed({x: f"_hot_{x}" for x in values}), keys, "left").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", F.when(F.col("_hot"), F.monotonically_increasing_id()).otherwise(-1))
    out = marked.join(found.withColumn("_deal", F.lit(-1).cast("long")), [*keys, "_deal"], "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{x}")).otherwise(F.col(x)).alias(x) for x in values))


def salted_join(rows: DataFrame, found: DataFrame, key: str, by: DataFrame) -> DataFrame:
    """rows joined to ``found``, which has a row a key with much in it, such as a text.

    A hot key's rows are dealt over as many places as they have bounds, and its row of ``found`` goes to each; ``by`` has the
    keys of rows to count.
    """
    total, largest = by.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    most = hot_bound(total or 0)
    if (largest or 0) <= most:
        return rows.join(found, key)
    hot = F.broadcast(by.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_places")).where("_places > 1"))
    places = F.coalesce("_places", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_place", F.pmod(F.xxhash64(*by.columns), places)).drop("_places")
    each = found.join(hot, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), places - 1))).drop("_places")
    return dealt.join(each, [key, "_place"]).drop("_place")


#: Copies of a row that one task writes, at most.
COPIES = 1 << 16


def each_copy(df: DataFrame, n: str, name: str) -> DataFrame:
    """df, a written table, with each row n times (a column that goes), numbered from 0; the copies of a row are dealt to tasks by thousands."""
    few = df.where(F.col(n) <= COPIES).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    parts = df.where(F.col(n) > COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)))).repartition("_part")
    last = F.least(F.col(n), (F.col("_part") + 1) * COPIES) - 1
    many = parts.withColumn(name, F.explode(F.sequence(F.col("_part") * COPIES, last))).drop("_part")
    return few.unionAll(many).drop(n)


def power_of_two(x: float, most: int) -> int:
    """The largest power of two up to x, from 1 to most."""
    n = 1
    while n * 2 <= min(x, most):
        n *= 2
    return n


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows numbered from 1 in the order of a distinct column, nulls last.

    No task sorts more than its own range: a row's number is its place in its range and the
    rows of the ranges before it. The window over the ranges has a row a partition.
    """
    part = f"_{name}_part"
    ranged = stash(df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn(part, F.spark_partition_id()), name)
    counts = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy(part).orderBy(F.col(order).asc_nulls_last()))
    return ranged.join(F.broadcast(before), part).withColumn(name, here + F.col("_before")).drop(part, "_before")
