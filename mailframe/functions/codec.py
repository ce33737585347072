"""Transfer encodings and charsets as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets, let

LATIN = "ISO-8859-1"


def latin(raw: Column) -> Column:
    """Bytes as a string with a character for each byte."""
    return F.decode(raw, LATIN)


def text_of(raw: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else ISO-8859-1."""
    return let(raw, lambda r: F.when(F.is_valid_utf8(r.cast("string")), F.decode(r, "UTF-8")).otherwise(latin(r)))


def encode_base64(raw: Column) -> Column:
    """Lines of 76 characters with CRLF between them."""
    return F.base64(raw)


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text with any line breaks; null where it isn't base64 or its padding is wrong."""

    def whole(bare: Column) -> Column:
        return F.when((F.length(bare) % 4 == 0) & bare.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.unbase64(bare))

    return let(F.regexp_replace(text, r"[\r\n\t ]+", ""), whole)


def _bytes_of_escapes(text: Column) -> Column:
    """The bytes of latin-1 text in which =XX stands for a byte: hexadecimal of the parts between escapes."""

    def each(t: Column) -> Column:
        hexed = F.transform(F.split(t, "=", -1), lambda x, i: F.when(i == 0, F.hex(F.encode(x, LATIN))).otherwise(F.concat(F.substring(x, 1, 2), F.hex(F.encode(F.substring(x, 3, 1 << 30), LATIN)))))
        return F.unhex(F.array_join(hexed, ""))

    return let(text, lambda t: F.when(F.instr(t, "=") > 0, each(t)).otherwise(F.encode(t, LATIN)))


def _decode_quoted_printable(text: Column) -> Column:
    """A scan of lines: each loses its white space at the end, one that ends with = is joined to the next. Linear in any text."""

    def joined(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.when(x.endswith("="), F.substr(x, F.lit(1), F.length(x) - 1)).when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x)

        return F.array_join(F.transform(F.transform(lines, lambda x: F.rtrim(x, F.lit(" \t"))), one), "")

    return _bytes_of_escapes(F.regexp_replace(let(F.split(text, "\r\n", -1), joined), r"=(?![0-9A-Fa-f]{2})", "=EF=BF=BD"))


def decode_quoted_printable(raw: Column) -> Column:
    """Soft breaks joined, white space at line ends dropped, CRLF to LF; a malformed escape becomes U+FFFD."""
    return _decode_quoted_printable(latin(raw))


def _escape(text: Column, keep: str) -> Column:
    """UTF-8 text as latin-1 characters, with =XX for each byte outside ``keep`` (a regular expression's class)."""

    def each(t: Column) -> Column:
        # runs that stay and runs that don't, in order
        runs = F.regexp_extract_all(t, F.lit(f"[{keep}]+|[^{keep}]+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(f"^[{keep}]"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, LATIN)), "(..)", "=$1"))), "")

    return let(latin(text.cast("binary")), lambda t: F.when(t.rlike(f"[^{keep}]"), each(t)).otherwise(t))


def encode_quoted_printable(text: Column) -> Column:
    """Text (LF line ends) as lines of at most 76 characters with CRLF between them; soft breaks never cut an escape."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: _escape(x, r"\x21-\x3C\x3E-\x7E "))
    ends = F.transform(lines, lambda x: F.regexp_replace(x, " $", "=20"))
    # of a line over 76, the first 75 go, or up to two fewer so that no escape is cut
    wide = F.transform(ends, lambda x: F.regexp_replace(x, r"(?=.{77})(.{75}(?<!=)(?<!=[0-9A-F])|.{74}(?<!=)|.{73})", "$1=\r\n"))
    return F.array_join(wide, "\r\n")


def encode_q(text: Column) -> Column:
    """The inline "Q" form of text: letters and digits stay, a space is _, all else =XX."""

    def each(t: Column) -> Column:
        # an address's form differs in four characters that it leaves, and in how a space and an escape are written
        out = F.url_encode(t)
        for a, b in (("_", "%5F"), (".", "%2E"), ("*", "%2A"), ("-", "%2D"), ("+", "_"), ("%", "=")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(F.is_valid_utf8(t), out).otherwise(F.replace(_escape(t, "A-Za-z0-9 "), F.lit(" "), F.lit("_")))

    return let(text.cast("string"), each)


def decode_q(text: Column) -> Column:
    """Bytes of the inline "Q" form; a malformed escape becomes U+FFFD."""
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"=(?![0-9A-Fa-f]{2})", "=EF=BF=BD")
    return _bytes_of_escapes(spaced)


def decode_text(text: Column, encoding: Column) -> Column:
    """The bytes of a body, given as latin-1 text, under its transfer encoding; null for broken base64."""
    kind = F.lower(encoding)
    return let(text, lambda t: F.when(kind == "base64", decode_base64(t)).when(kind == "quoted-printable", _decode_quoted_printable(t)).otherwise(F.encode(t, LATIN)))


def decode_body(raw: Column, encoding: Column) -> Column:
    """The bytes of a body under its transfer encoding; null for broken base64."""
    kind = F.lower(encoding)
    return let(raw, lambda r: F.when(kind == "base64", decode_base64(latin(r))).when(kind == "quoted-printable", decode_quoted_printable(r)).otherwise(r))


def encode_body(text: Column, encoding: Column) -> Column:
    """Text as the characters of a body; encodings without a transformation get CRLF line ends."""
    kind = F.lower(encoding)
    return (
        F.when(kind == "base64", encode_base64(text.cast("binary")))
        .when(kind == "quoted-printable", encode_quoted_printable(text))
        .otherwise(F.regexp_replace(text, "(?<!\r)\n", "\r\n"))
    )


def decode_charset(raw: Column, charset: Column) -> Column:
    """Bytes in one of the charsets that Spark or a table knows (``charsets``); null for others (``mailframe.functions.words`` knows more)."""
    return charsets.decode(raw, charset)
