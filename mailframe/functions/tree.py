"""Messages to part trees with built-in expressions, level by level, in one pass over a column: no Python, no shuffle, any depth.

The frontier of a message is an array of texts that are still to be read: first the message itself, then the parts of its
multiparts and the messages in its messages. A step reads the header of each text on the frontier, writes its node, splits
multiparts at their boundary lines, and makes the pieces the next frontier; a fold takes as many steps as the message can
have levels. So a level copies a text once, and a message takes its size times its depth.

A piece is all that its parents know of it: a part ends at the first boundary line of any multipart around it, closed or not.
A boundary line starts a part if only blanks follow the boundary; at the first other one, the list ends, and all behind it is
dropped. A part without an empty line after its header has no body; the message itself must have one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codec, ctype, fields, let, running

PARAMS = "array<struct<key:string,value:string>>"
#: A node without its body's bytes: text is the undecoded body, a character a byte.
NODE = f"struct<path:array<int>,kind:string,ty:string,subty:string,params:{PARAMS},encoding:string,header:array<{fields.FIELD}>,text:string,error:string>"
_PIECE = "struct<path:array<int>,at:int,text:string>"
NO_LINE, NO_BOUNDARY, NO_PART = "expected an empty line after the header", "expected boundary", "expected a boundary line"
_AFTER = r"^[ \t]*+\r\n"


def _last(header: Column, name: str, parse) -> Column:  # noqa: ANN001
    """The last field of a name that parses."""
    every = F.transform(F.filter(header, lambda f: F.lower(f["name"]) == name), lambda f: parse(f["value"]))
    return F.try_element_at(F.filter(every, lambda x: x.isNotNull()), F.lit(-1))


def _read(piece: Column) -> Column:
    """A piece as ``struct<piece,head,header,body,at,type>``: header null for lines that are none, body null without an empty line."""

    def cut(p: Column) -> Column:
        t, end = p["text"], F.instr(p["text"], "\r\n\r\n")
        bare = t.startswith("\r\n")
        head = F.when(bare, "").when(end > 0, F.substr(t, F.lit(1), end + 1)).when((t == "") | t.endswith("\r\n"), t)
        skip = F.when(bare, 2).when(end > 0, end + 3)
        return F.struct(p.alias("p"), fields._lines(head).alias("lines"), F.substr(t, skip + 1).alias("body"), (p["at"] + skip).alias("at"))

    def headed(c: Column) -> Column:
        good = F.forall(c["lines"], lambda x: x.rlike(fields._LINE))
        return F.struct(c["p"].alias("p"), F.when(good, fields._fields(c["lines"], c["p"]["at"])).alias("header"), c["body"].alias("body"), c["at"].alias("at"))

    def typed(c: Column) -> Column:
        kind = F.coalesce(_last(c["header"], "content-type", ctype.parse), ctype.default())
        return F.struct(c["p"].alias("p"), c["header"].alias("header"), c["body"].alias("body"), c["at"].alias("at"), F.when(c["body"].isNotNull(), kind).alias("type"))

    return let(piece, lambda p: let(cut(p), lambda c: let(headed(c), typed)))


def _mark(type: Column) -> Column:
    """The boundary as the bytes' characters."""
    return codec.latin(ctype.parameter(type, "boundary").cast("binary"))


def _node(r: Column) -> Column:
    ty = r["type"]["ty"]
    kind = F.when(ty.isin("message", "multipart"), ty).otherwise("leaf")
    faulty = F.when(r["header"].isNull() | (r["body"].isNull() & (F.size(r["p"]["path"]) == 0)), NO_LINE)
    faulty = faulty.when((ty == "multipart") & _mark(r["type"]).isNull(), NO_BOUNDARY).when((ty == "multipart") & (F.instr(r["body"], F.concat(F.lit("--"), _mark(r["type"]))) == 0), NO_PART)
    params = F.coalesce(F.transform(r["type"]["params"], lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))), F.array().cast(PARAMS))
    encoding = F.coalesce(F.when(r["body"].isNotNull(), _last(r["header"], "content-transfer-encoding", ctype.encoding)), F.lit("7bit"))
    return F.struct(
        r["p"]["path"].alias("path"), kind.alias("kind"), ty.alias("ty"), r["type"]["subty"].alias("subty"), params.alias("params"), encoding.alias("encoding"),
        F.coalesce(r["header"], fields.empty()).alias("header"), F.when(kind == "leaf", r["body"]).alias("text"), faulty.alias("error"),
    )


def _pieces(r: Column) -> Column:
    """What a node's body holds: the message of a message, the parts of a multipart."""

    def parts(mark: Column) -> Column:
        first = F.instr(r["body"], F.concat(F.lit("--"), mark))
        start = first + 1 + F.length(mark)
        quoted = F.concat(F.lit("\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        every = F.split(F.substr(r["body"], start + 1), F.concat(F.lit("\r\n--"), quoted), -1)

        def opened(texts: Column) -> Column:
            last = F.array_position(F.transform(texts, lambda x: x.rlike(_AFTER)), False)
            return F.when(last > 0, F.slice(texts, 1, (last - 1).cast("int"))).otherwise(texts)

        def placed(texts: Column) -> Column:
            starts = running(F.transform(texts, lambda x: F.length(x) + F.length(mark) + 4))

            def one(y: Column, i: Column) -> Column:
                pad = F.length(F.regexp_extract(y["x"], _AFTER, 0))
                return F.struct(F.concat(r["p"]["path"], F.array(i)).alias("path"), (r["at"] + start + y["s"] + pad).cast("int").alias("at"), F.substr(y["x"], pad + 1).alias("text"))

            return F.transform(F.arrays_zip(texts.alias("x"), starts.alias("s")), one)

        return F.when(first > 0, let(every, lambda x: let(opened(x), placed)))

    inner = F.array(F.struct(F.concat(r["p"]["path"], F.array(F.lit(0))).alias("path"), r["at"].alias("at"), r["body"].alias("text")))
    found = F.when(r["type"]["ty"] == "message", inner).when((r["type"]["ty"] == "multipart") & r["header"].isNotNull(), let(_mark(r["type"]), parts))
    return F.coalesce(found, F.array().cast(f"array<{_PIECE}>"))


def nodes(raw: Column, partial: bool = False) -> Column:
    """``array<NODE>`` of a message; null for null.

    A fault anywhere makes it one node of kind malformed, with the fault of the first node that has one; with ``partial`` all that could be read stays, a fault beside its node.
    """

    def step(s: Column) -> Column:
        return let(F.transform(s["left"], _read), lambda read: F.struct(F.concat(s["done"], F.transform(read, _node)).alias("done"), F.flatten(F.transform(read, _pieces)).alias("left")))

    def levels(t: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{NODE}>").alias("done"), F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(0).alias("at"), t.alias("text"))).cast(f"array<{_PIECE}>").alias("left"))
        # a level needs a Content-Type
        most = 2 + F.regexp_count(t, F.lit("(?i)content-type"))
        return F.aggregate(F.sequence(F.lit(1), most), start, lambda s, _: F.when(F.size(s["left"]) > 0, step(s)).otherwise(s), lambda s: s["done"])

    def whole(done: Column) -> Column:
        fault = F.try_element_at(F.filter(F.transform(done, lambda n: n["error"]), lambda e: e.isNotNull()), F.lit(1))
        none = F.lit(None).cast("string")
        broken = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit("malformed").alias("kind"), none.alias("ty"), none.alias("subty"), F.array().cast(PARAMS).alias("params"), none.alias("encoding"), fields.empty().alias("header"), none.alias("text"), fault.alias("error")))
        return F.when(fault.isNotNull(), broken).otherwise(done)

    found = let(codec.latin(raw), levels)
    return F.when(raw.isNotNull(), found if partial else let(found, whole))
