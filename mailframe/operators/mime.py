"""Messages to part trees: one row a part, with paths for the tree that Spark has no type for.

``nodes`` is the source of part trees for batch and streaming frames alike; it has no state and no Python (``functions.tree``).
``parse_mail`` gives the same rows to SQL's LATERAL through a Python table function, which SQL can take by name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grammar
from ..functions import codec, fields, tree

SCHEMA = (
    "path array<int>, parent_path array<int>, depth int, kind string, ty string, subty string, params array<struct<key:string,value:string>>, encoding string, "
    "header array<struct<ord:int,name:string,value:string,a:int,b:int>>, body binary, has_body boolean, error string"
)
_NAMES = ("path", "parent_path", "depth", "kind", "ty", "subty", "params", "encoding", "header", "body", "has_body", "error")


def rows_of(raw: bytes, transfer: bool = True) -> list[dict]:
    """The parts of a message as rows; one row of kind ``malformed`` if it isn't one."""
    try:
        root = grammar.parse(raw, transfer)
    except grammar.Malformed as e:
        return [dict.fromkeys(_NAMES) | {"path": [], "depth": 0, "kind": "malformed", "has_body": False, "header": [], "params": [], "error": str(e)}]
    out = []
    for n in root.walk():
        ty, sub, params = n.type or (None, None, [])
        out.append({
            "path": n.path, "parent_path": n.path[:-1] if n.path else None, "depth": len(n.path), "kind": n.kind, "ty": ty, "subty": sub,
            "params": [{"key": k, "value": v} for k, v in params], "encoding": n.encoding,
            "header": [{"ord": i, "name": f[0], "value": f[1], "a": f[2], "b": f[3]} for i, f in enumerate(n.header)],
            "body": n.body, "has_body": n.has_body, "error": None,
        })
    return out


def nodes(mails: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ("mail_id",), transfer: bool = True, partial: bool = False) -> DataFrame:
    """A row for each part of each message, with the columns of ``keep``. A null message gives no rows.

    Built-in expressions only, in the scan's stage, so that batch and streaming frames are alike. transfer: whether transfer encodings are decoded.
    A message with a fault, broken base64 too, is one row of kind malformed; with ``partial`` its other parts stay and the fault is beside its own.
    """
    found = mails.select(*keep, F.col(raw_col).cast("binary").alias("_raw")).select(*keep, tree.nodes(F.col("_raw"), partial).alias("_nodes"))
    broken = lambda n: (n["encoding"] == "base64") & n["text"].isNotNull() & codec.decode_base64(n["text"]).isNull()
    if transfer and not partial:
        found = found.withColumn("_nodes", F.when(F.exists("_nodes", broken), F.transform(F.slice("_nodes", 1, 1), _malformed)).otherwise(F.col("_nodes")))
    n = lambda x: F.col(f"_n.{x}")
    body = codec.decode_text(n("text"), n("encoding")) if transfer else F.encode(n("text"), codec.LATIN)
    depth = F.size(n("path"))
    # the outer form, since Spark infers a filter for the other one and so reads a message three times
    rows = found.select(*keep, F.explode_outer("_nodes").alias("_n")).where("_n IS NOT NULL").withColumn("_body", body)
    return rows.select(
        *keep, n("path"), F.when(depth > 0, F.slice(n("path"), 1, F.greatest(depth - 1, F.lit(0)))).alias("parent_path"), depth.alias("depth"), *(n(x) for x in ("kind", "ty", "subty", "params", "encoding", "header")),
        F.col("_body").alias("body"), n("text").isNotNull().alias("has_body"), F.coalesce(n("error"), F.when(n("text").isNotNull() & F.col("_body").isNull(), _NOT_BASE64)).alias("error"),
    )


_NOT_BASE64 = "not base64"


def _malformed(n: Column) -> Column:
    gone = {"kind": F.lit("malformed"), "params": F.array().cast(tree.PARAMS), "header": fields.empty(), "error": F.lit(_NOT_BASE64), "path": n["path"]}
    return F.struct(*(gone.get(x, F.lit(None).cast("string")).alias(x) for x in ("path", "kind", "ty", "subty", "params", "encoding", "header", "text", "error")))


class ParseMail:
    """parse_mail(raw): the same rows as a table function for SQL's LATERAL."""

    def eval(self, raw: bytes) -> Iterator[tuple]:
        if raw is not None:
            for r in rows_of(bytes(raw)):
                header = [(h["ord"], h["name"], h["value"], h["a"], h["b"]) for h in r["header"]]
                yield (*(r[k] for k in ("path", "parent_path", "depth", "kind", "ty", "subty")), [(p["key"], p["value"]) for p in r["params"]], r["encoding"], header, r["body"], r["has_body"], r["error"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_mail", F.udtf(ParseMail, returnType=SCHEMA))
