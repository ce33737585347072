"""Rows of headers and parts to well-formed messages.

Everything but folding is a built-in expression. Parts of one parent are joined by one ordered aggregation, a level of the
tree at a time, deepest first: one shuffle a level, keyed by message, so that a message's parts meet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, ctype, fields, let

CRLF = "\r\n"


def boundary(mail_id: Column, path: Column) -> Column:
    """A boundary that a message's place in the tree decides, so that a repeated task writes the same bytes."""
    return F.substring(F.sha2(F.concat_ws("/", mail_id.cast("string"), F.array_join(path.cast("array<string>"), ".")), 256), 1, 12)


def part(header: Column, text: Column, encoding: Column) -> Column:
    """A leaf: header lines, an empty line, and the text in its transfer encoding."""
    return F.concat(fields.render(header), F.lit(CRLF), codec.encode_body(text, encoding))


def multipart_header(header: Column, mark: Column, subtype: str = "mixed") -> Column:
    """The header with a boundary: one that its Content-Type has wins, else ``mark`` is added; without a Content-Type one is made."""
    made = F.concat(F.lit(f"multipart/{subtype}; boundary="), ctype.escape(mark))
    given = let(ctype.parse(fields.last(header, "content-type")), lambda have: F.when(have.isNull(), made).otherwise(ctype.render(ctype.with_parameter(have, "boundary", mark))))
    return F.when(fields.exists(header, "content-type"), fields.replace(header, "Content-Type", given)).otherwise(fields.add(header, fields.make(F.lit("Content-Type"), made)))


def join_parts(parts: Column, mark: Column) -> Column:
    """Parts between boundary lines; the delimiter's CRLF belongs to the delimiter."""
    opened = F.transform(parts, lambda p: F.concat(F.lit("--"), mark, F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.array_join(opened, ""), F.lit("--"), mark, F.lit("--" + CRLF))


def message(header: Column, body: Column) -> Column:
    """The bytes of a message: header, empty line, body."""
    return F.concat(fields.render(header), F.lit(CRLF), body).cast("binary")


def messages(parts: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, raw) from rows (key, path, kind, header, text, encoding): kind is leaf, multipart or message.

    The root has an empty path. A level is joined to its parents until only roots are left. Leaves need text and
    encoding; nodes above need neither. The number of levels comes from one aggregation.
    """
    parent = F.when(F.size("path") > 0, F.slice("path", 1, F.size("path") - 1))
    rows = parts.select(F.col(key), "path", F.size("path").alias("depth"), "kind", "header", F.when(F.col("kind") == "leaf", part(F.col("header"), F.coalesce("text", F.lit("")), F.coalesce("encoding", F.lit("7bit")))).alias("out"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    done = rows.where(F.col("depth") == deepest)
    for depth in range(deepest, 0, -1):
        below = done.groupBy(F.col(key).alias("_k"), parent.alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("i"), "out"))), lambda x: x["out"]).alias("_parts"))
        above = rows.where(F.col("depth") == depth - 1)
        joined = above.join(below, F.col(key).eqNullSafe(F.col("_k")) & (F.col("path") == F.col("_p")), "left")
        joined = joined.withColumn("_mark", boundary(F.col(key), F.col("path"))).withColumn("_head", multipart_header(F.col("header"), F.col("_mark")))
        real = F.coalesce(ctype.boundary(ctype.parse(fields.last(F.col("_head"), "content-type"))), F.col("_mark"))
        many = F.concat(fields.render(F.col("_head")), F.lit(CRLF), let(real, lambda r: join_parts(F.coalesce("_parts", F.array().cast("array<string>")), r)))
        one = F.concat(fields.render(F.col("header")), F.lit(CRLF), F.element_at("_parts", 1))
        done = joined.withColumn("out", F.when(F.col("kind") == "leaf", F.col("out")).when(F.col("kind") == "multipart", many).otherwise(one)).drop("_k", "_p", "_parts", "_mark", "_head")
    return done.select(F.col(key), F.col("out").cast("binary").alias("raw"))


#: Last entries of a piece's place: before a part, a part itself, behind the parts in it, behind a part.
_OPENS, _OWN, _CLOSES, _ENDS = -2, -1, (1 << 31) - 1, 0


def pieces(parts: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, place, data): the bytes of ``messages`` as rows, which a key's rows in the order of ``place`` make.

    No row holds more than one part, so a message may have any number of parts and any size. Texts stay where they are: only
    keys and paths meet, in one join of parts with their parents' boundaries. Rows must make trees; a message in a part has one part.
    """
    rows = parts.select(F.col(key), "path", "kind", "header", "text", "encoding")
    place = lambda *last: F.concat(F.col("path"), F.array(*map(F.lit, last)))
    own = boundary(F.col(key), F.col("path"))
    head = F.when(F.col("kind") == "multipart", multipart_header(F.col("header"), own)).otherwise(F.col("header"))
    leaf = part(F.col("header"), F.coalesce("text", F.lit("")), F.coalesce("encoding", F.lit("7bit")))
    texts = rows.select(key, place(_OWN).alias("place"), F.when(F.col("kind") == "leaf", leaf).otherwise(F.concat(fields.render(head), F.lit(CRLF))).alias("data"))
    marks = rows.where("kind = 'multipart'").select(F.col(key), "path", F.coalesce(ctype.boundary(ctype.parse(fields.last(head, "content-type"))), own).alias("mark"))
    ends = marks.select(key, place(_CLOSES, _OWN).alias("place"), F.concat(F.lit("--"), "mark", F.lit("--" + CRLF)).alias("data"))
    below = parts.where(F.size("path") > 0).select(F.col(key).alias("_k"), F.col("path").alias("_path"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("_up"))
    around = below.join(marks, F.col("_k").eqNullSafe(F.col(key)) & (F.col("_up") == F.col("path"))).select(key, F.col("_path").alias("path"), "mark")
    lines = F.array(F.struct(place(_OPENS).alias("place"), F.concat(F.lit("--"), "mark", F.lit(CRLF)).alias("data")), F.struct(place(_CLOSES, _ENDS).alias("place"), F.lit(CRLF).alias("data")))
    return texts.unionByName(ends).unionByName(around.select(key, F.inline(lines))).withColumn("data", F.col("data").cast("binary"))


def write_pieces(made: DataFrame, path: str, key: str = "mail_id") -> None:
    """Pieces as Parquet by ranges of (key, place): a large message is several tasks' work, and files are in order."""
    made.repartitionByRange(F.col(key), F.col("place")).sortWithinPartitions(key, "place").write.mode("errorifexists").parquet(path)
