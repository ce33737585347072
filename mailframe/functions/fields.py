"""Headers as arrays of fields, with built-in Spark expressions: splitting, names, and the operations on field lists.

A header is ``array<struct<ord:int,name:string,value:string,a:int,b:int>>``: order matters, names may repeat, values are
unfolded but otherwise as they stand, a and b are the field's place in the message's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let, running, scanned
from .codec import latin, text_of

FIELD = "struct<ord:int,name:string,value:string,a:int,b:int>"
NAME = r"[\x21-\x39\x3B-\x7E]+"

# Names of fields that have constants.
NAMES = (
    "Date", "From", "Sender", "Reply-To", "Cc", "Bcc", "Subject", "Message-ID", "In-Reply-To", "References",
    "Comments", "Keywords", "Received", "Return-Path", "Content-Type", "Content-Transfer-Encoding", "MIME-Version",
    "Content-ID", "Content-Description", "Resent-Date", "Resent-From", "Resent-Sender", "Resent-To", "Resent-Cc",
    "Resent-Bcc", "Resent-Message-ID", "Resent-Reply-To",
)
# The type of a field's value by its name in lower case; all others are unstructured.
KINDS = {
    "date": "Date", "from": "Mailboxes", "sender": "Mailbox", "reply-to": "Addresses", "to": "Addresses", "cc": "Addresses", "bcc": "Addresses",
    "subject": "Unstructured", "comments": "Unstructured", "message-id": "MessageID", "content-type": "Content", "content-transfer-encoding": "Encoding",
}


def unfold(text: Column) -> Column:
    """Each line break with the white space after it becomes one space."""
    return F.regexp_replace(text, r"\r\n[ \t]+", " ")


#: What matters between comments: quoted pairs, quotes, parentheses, and runs of anything else.
_PIECE = r'(?s)\\.|["()\\]|[^"()\\]++'


def strip_comments(text: Column) -> Column:
    """Text without comments of any depth; parentheses in quoted strings stay. An open comment runs to the end.

    The state before a piece is how many comments are open there, or -1 in a quoted string.
    """

    def step(s: Column, x: Column) -> Column:
        opened = F.when(x == "(", s + 1).when((x == ")") & (s > 0), s - 1).otherwise(s)
        return F.when(s == -1, F.when(x == '"', 0).otherwise(-1)).when((s == 0) & (x == '"'), -1).otherwise(opened)

    def kept(pieces: Column) -> Column:
        states = scanned(pieces, 0, step)
        stays = F.filter(F.arrays_zip(pieces.alias("x"), states.alias("s")), lambda y: (y["s"] < 0) | ((y["s"] == 0) & (y["x"] != "(")))
        return F.array_join(F.transform(stays, lambda y: y["x"]), "")

    return let(text, lambda t: F.when(F.instr(t, "(") > 0, let(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), kept)).otherwise(t))


def _split(text: Column) -> Column:
    """(header with its last CRLF, characters before the body) of a message; null without an empty line."""
    at = F.instr(text, "\r\n\r\n")
    bare = F.struct(F.lit("").alias("head"), F.lit(2).alias("skip"))
    return F.when(F.substring(text, 1, 2) == "\r\n", bare).when(at > 0, F.struct(F.substr(text, F.lit(1), at + 1).alias("head"), (at + 3).alias("skip")))


def body(raw: Column) -> Column:
    """The bytes after the empty line."""
    return let(raw, lambda r: F.substr(r, let(latin(r), lambda t: _split(t)["skip"]) + 1))


_LINE = rf"(?s)^{NAME}[ \t]*:"


def _fields(lines: Column, start: Column | int = 0) -> Column:
    """The fields of lines (a field's lines together, in latin-1) that follow each other from a place in a message."""

    def one(x: Column, a: Column, i: Column) -> Column:
        # only values with other than ASCII are bytes again to be read as UTF-8
        value = let(F.regexp_extract(x, rf"(?s)^{NAME}[ \t]*:(.*)$", 1), lambda v: unfold(F.when(v.rlike("[^\\x00-\\x7F]"), text_of(F.encode(v, "ISO-8859-1"))).otherwise(v)))
        return F.struct(i.alias("ord"), F.regexp_extract(x, rf"^({NAME})", 1).alias("name"), value.alias("value"), a.alias("a"), (a + F.length(x) + 2).alias("b"))

    at = running(F.transform(lines, lambda x: F.length(x) + 2))
    return F.transform(F.arrays_zip(lines.alias("x"), at.alias("at")), lambda y, i: one(y["x"], (y["at"] + start).cast("int"), i))


def _lines(head: Column) -> Column:
    """One element a field: its lines up to a CRLF that no white space follows."""
    return F.filter(F.split(head, r"\r\n(?![ \t])", -1), lambda x: x != "")


def header(raw: Column) -> Column:
    """The header of a message; null where a line is no field or there is no empty line."""

    def whole(lines: Column) -> Column:
        return F.when(F.forall(lines, lambda x: x.rlike(_LINE)), _fields(lines))

    return let(let(latin(raw), lambda t: _split(t)["head"]), lambda head: let(_lines(head), whole))


def decode(raw: Column) -> Column:
    """``struct<fields,malformed>``: the fields before the first line that is none, and that line; null where all are.

    Without an empty line all lines are read, and malformed is an empty text if each is a field.
    """

    def found(s: Column) -> Column:
        lines = s["lines"]
        bad = F.array_position(F.transform(lines, lambda x: x.rlike(_LINE)), False)
        good = F.when(bad > 0, F.slice(lines, 1, (bad - 1).cast("int"))).otherwise(lines)
        at_fault = F.when(bad > 0, F.try_element_at(lines, bad.cast("int"))).when(~s["whole"], F.lit(""))
        return F.struct(let(good, _fields).alias("fields"), at_fault.alias("malformed"))

    def split(t: Column) -> Column:
        return let(_split(t)["head"], lambda head: F.struct(_lines(F.coalesce(head, t)).alias("lines"), head.isNotNull().alias("whole")))

    return let(let(latin(raw), split), found)


# -- names -------------------------------------------------------------------------------------------------------


def valid_name(name: Column) -> Column:
    return name.rlike(f"^{NAME}$")


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def capitalize(name: Column) -> Column:
    """Upper case for the first letter and any after - or a space; all others as they are."""
    letters = F.regexp_extract_all(name, F.lit(r"(?s)[- ]?[^- ]*"), F.lit(0))
    raised = F.transform(letters, lambda x: F.when(x.rlike("^[- ]"), F.concat(F.substring(x, 1, 1), F.upper(F.substring(x, 2, 1)), F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))))
    return F.array_join(raised, "")


def canonicalize(name: Column) -> Column:
    return F.lower(name)


def prefixed_by(prefix: str, name: Column) -> Column:
    """Whether the name's part before its first dash is the prefix; false without a dash."""
    if "-" in prefix:
        raise ValueError("a prefix has no dash")
    return (F.instr(name, "-") > 0) & (F.lower(F.substring_index(name, "-", 1)) == prefix.lower())


def kind(name: Column, schema: dict[str, str] | None = None) -> Column:
    """The type of a field's value: Date, Mailboxes, ... ; ``schema`` overrides the table by name."""
    table = KINDS | {k.lower(): v for k, v in (schema or {}).items()}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(name)), F.lit("Unstructured"))


# -- field lists -------------------------------------------------------------------------------------------------


def make(name: Column, value: Column) -> Column:
    """A field that stands in no message."""
    none = F.lit(None).cast("int")
    return F.struct(none.alias("ord"), name.alias("name"), value.alias("value"), none.alias("a"), none.alias("b"))


def empty() -> Column:
    return F.array().cast(f"array<{FIELD}>")


def of_pairs(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*(make(n, v) for n, v in pairs))


def assoc(header: Column, name: str) -> Column:
    return F.filter(header, lambda f: F.lower(f["name"]) == name.lower())


def remove_assoc(header: Column, name: str) -> Column:
    return F.filter(header, lambda f: F.lower(f["name"]) != name.lower())


def exists(header: Column, name: str) -> Column:
    return F.exists(header, lambda f: F.lower(f["name"]) == name.lower())


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def add(header: Column, field: Column) -> Column:
    """The field comes first."""
    return F.concat(F.array(field), header)


def add_unless_exists(header: Column, name: str, value: Column) -> Column:
    return F.when(exists(header, name), header).otherwise(add(header, make(F.lit(name), value)))


def replace(header: Column, name: str, value: Column) -> Column:
    """The first field of the name gets the value; later ones stay; without one, the field comes last."""
    new = make(F.lit(name), value)
    at = F.array_position(F.transform(header, lambda f: F.lower(f["name"])), name.lower())
    return F.when(at > 0, F.transform(header, lambda f, i: F.when(i + 1 == at, new).otherwise(f))).otherwise(F.concat(header, F.array(new)))


def first(header: Column, name: str) -> Column:
    """The value of the first field of the name, or null."""
    return F.try_element_at(assoc(header, name), F.lit(1))["value"]


def last(header: Column, name: str) -> Column:
    return F.try_element_at(assoc(header, name), F.lit(-1))["value"]


def fold(line: Column, margin: int = 78) -> Column:
    """A line folded before a space wherever it would pass the margin; a word that is longer stays whole, and so does a line with breaks."""
    # from where the last part ended: as much as fits up to a single space, or else the least that reaches one
    part = rf"\G(?=.{{{margin + 1}}})(?:.{{1,{margin}}}|.{{{margin + 1},}}?)(?<=[^ ])(?= [^ ])"
    return let(line, lambda x: F.when((F.length(x) > margin) & ~x.rlike("[\r\n]"), F.regexp_replace(x, part, "$0\r\n")).otherwise(x))


def render(header: Column) -> Column:
    """Header lines with CRLF ends, folded, names capitalized; a value that starts with white space gets no other space."""
    lines = F.transform(header, lambda f: F.concat(fold(F.concat(capitalize(f["name"]), F.when(f["value"].rlike("^[ \t]"), ":").otherwise(": "), f["value"])), F.lit("\r\n")))
    return F.array_join(lines, "")


# -- spans -------------------------------------------------------------------------------------------------------


def span(a: Column, b: Column) -> Column:
    """A place in a message's bytes; null if either end is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))


def span_union(x: Column, y: Column) -> Column:
    """From the least start to the greatest end; with one span null, the other."""
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(span(F.least(x["a"], y["a"]), F.greatest(x["b"], y["b"])))


def span_length(x: Column) -> Column:
    return x["b"] - x["a"]
