"""Addresses, ids and encoded words of header values, with built-in expressions (``lists``, ``charsets``).

Only encoded words in charsets that neither Spark nor a table knows, such as those of many bytes, need Python: ``encoded_word``,
``decode_words`` and, if asked for, ``addresses`` send those values alone through ``mailframe.grammar`` in Arrow batches. The functions
whose names end in ``_native`` never do. SQL knows the functions by the names of ``register``, as Arrow functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import grammar
from . import charsets, codec, fields, let, lists
from .lists import ADDRESS, MAILBOX

WORD = "struct<charset:string,encoding:string,data:string,error:string>"
_WORD = r"=\?([^?\s()<>@,;:\"/\[\].=]+)\?([QqBb])\?([^? ]+)\?="


def _each(f, kind: str):  # noqa: ANN001, ANN202
    def own(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    def frame(values: pd.Series) -> pd.DataFrame:
        rows = [None if v is None else f(v) for v in values]
        keys = [x.split(":")[0] for x in _fields(kind)]
        return pd.DataFrame({k: pd.Series([None if r is None else r[k] for r in rows], dtype=object) for k in keys})

    body = frame if kind.startswith("struct<") else own
    body.__annotations__ = {"values": pd.Series, "return": pd.DataFrame if kind.startswith("struct<") else pd.Series}
    return F.pandas_udf(body, kind)


def _fields(kind: str) -> list[str]:
    """The fields of a struct type's text, at its own level."""
    out, depth, start, inner = [], 0, 0, kind[len("struct<") : -1]
    for i, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[start:i])
            start = i + 1
    return [*out, inner[start:]]


def _rare(text: Column) -> Column:
    """Whether a text has an encoded word in a charset without a table."""
    return F.exists(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)), lambda c: ~charsets.known(c))


def addresses(value: Column, rare: bool = False) -> Column:
    """``array<address>`` of an address list, or null. rare: values with names in charsets without a table go through Python."""
    out = lists.addresses(value, decode_words_native)
    return F.when(_rare(value), _each(grammar.addresses, f"array<{ADDRESS}>")(F.when(_rare(value), value))).otherwise(out) if rare else out


def mailboxes(value: Column) -> Column:
    return lists.mailboxes(value, decode_words_native)


def mailbox(value: Column, whole: bool = False) -> Column:
    """``array<mailbox>`` of none or one; whole: nothing may follow the mailbox."""
    return lists.mailbox(value, decode_words_native, whole)


def first_message_id(values: Column) -> Column:
    """The first message id of an array of values that parses, or null."""
    return F.try_element_at(F.filter(F.transform(values, lists.message_id), lambda m: m.isNotNull()), F.lit(1))


def message_id(value: Column) -> Column:
    return lists.message_id(value)


def render_addresses(value: Column) -> Column:
    """An address list read and written again: its canonical text."""
    return let(addresses(value), lambda found: F.array_join(F.transform(F.coalesce(found, F.array().cast(f"array<{ADDRESS}>")), lists.render), ", "))


def strip_comments(value: Column) -> Column:
    """Text without comments of any depth."""
    return fields.strip_comments(value)


def fold(line: Column) -> Column:
    """A header line folded at 78 columns, without Python."""
    return fields.fold(line)


def encoded_word(text: Column) -> Column:
    """The encoded word at the start of a text, in any charset that Python knows, as a struct with nulls if there is none."""
    one = lambda v: [m] if (m := grammar.encoded_word(v)) else []
    rare = ~charsets.known(F.regexp_extract(text, "^" + _WORD, 1))
    return F.when(text.rlike("^" + _WORD) & rare, F.try_element_at(_each(one, f"array<{WORD}>")(F.when(rare, text)), F.lit(1))).otherwise(encoded_word_native(text))


def encoded_word_native(text: Column) -> Column:
    """The same for the charsets that Spark or a table knows, without Python; others are unknown. ``text`` is written twice: bind it with ``let`` if it is dear."""

    def one(t: Column) -> Column:
        charset, encoding, inner = (F.regexp_extract(t, "^" + _WORD, i) for i in (1, 2, 3))
        raw = let(inner, lambda x: F.when(F.upper(encoding) == "B", codec.decode_base64(x)).otherwise(codec.decode_q(x)))
        name = F.upper(charset)

        def read(r: Column) -> Column:
            return F.struct(r.isNull().alias("broken"), charsets.decode(r, charset).alias("data"))

        def told(x: Column) -> Column:
            error = F.when(x["broken"], "not base64").when(~charsets.known(charset), F.concat(F.lit(grammar.UNKNOWN + " "), name)).when(x["data"].isNull(), F.concat(F.lit("not "), name))
            return F.struct(name.alias("charset"), F.upper(encoding).alias("encoding"), x["data"].alias("data"), error.alias("error"))

        return let(let(raw, read), told)

    return F.when(text.rlike("^" + _WORD), let(text, one))


def decode_words_native(text: Column) -> Column:
    """Text with its encoded words decoded in place, in the charsets that Spark or a table knows; all else stays, and so does the space between two."""

    def joined(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), lambda w: F.coalesce(encoded_word_native(w)["data"], w))
        return F.array_join(F.transform(F.arrays_zip(F.split(t, _WORD, -1).alias("a"), found.alias("b")), lambda y: F.concat(y["a"], F.coalesce(y["b"], F.lit("")))), "")

    return let(text, lambda t: F.when(t.contains("=?") & t.rlike(_WORD), joined(t)).otherwise(t))


def decode_words(text: Column) -> Column:
    """The same in any charset that Python knows."""
    return F.coalesce(_each(grammar.decode_words, "string")(F.when(text.rlike(_WORD) & _rare(text), text)), decode_words_native(text))


def make_word(text: Column, encoding: str = "B", charset: str = "UTF-8") -> Column:
    """An encoded word of UTF-8 text; null for bytes that are none."""
    inner = F.regexp_replace(F.base64(text.cast("binary")), "\r\n", "") if encoding.upper() == "B" else codec.encode_q(text)
    return F.when(F.is_valid_utf8(text.cast("string")), F.concat(F.lit(f"=?{charset}?{encoding.upper()}?"), inner, F.lit("?=")))


def is_normalized(word: Column) -> Column:
    """Whether the word's charset is known."""
    return F.coalesce(~word["error"].startswith(grammar.UNKNOWN), word.isNotNull())


def same_word(a: Column, b: Column) -> Column:
    """Equal charset, encoding and data; any two errors are equal."""
    return (F.lower(a["charset"]) == F.lower(b["charset"])) & (a["encoding"] == b["encoding"]) & a["data"].eqNullSafe(b["data"])


def register(spark: SparkSession) -> None:
    """The functions as SQL functions: mail_addresses, mail_mailboxes, mail_decode_words, mail_strip_comments, mail_fold."""
    for name, f, kind in (
        ("mail_addresses", grammar.addresses, f"array<{ADDRESS}>"),
        ("mail_mailboxes", grammar.mailboxes, f"array<{MAILBOX}>"),
        ("mail_decode_words", grammar.decode_words, "string"),
        ("mail_strip_comments", grammar.strip_comments, "string"),
        ("mail_fold", grammar.fold, "string"),
    ):
        spark.udf.register(name, _each(f, kind))
