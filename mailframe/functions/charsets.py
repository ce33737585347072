"""Charsets as mapping tables: bytes to text for single-byte charsets with built-in expressions, aliases included.

A table is a rule: what the platform's codec of a charset says of the bytes 128 to 255, taken when a plan is built. Bytes without a
character make a text null, as broken UTF-8 does.
"""

from __future__ import annotations

from encodings.aliases import aliases
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

LATIN = "ISO-8859-1"
#: Single-byte charsets that have a table; their bytes below 128 are ASCII.
TABLES = (
    *(f"iso8859_{i}" for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)), "koi8_r", "koi8_u", "koi8_t", *(f"cp{i}" for i in range(1250, 1259)),
    "cp437", "cp850", "cp852", "cp855", "cp866", "mac_roman", "mac_cyrillic", "tis_620", "kz1048", "ptcp154",
)
HIGH = "".join(map(chr, range(128, 256)))


def normal(charset: Column) -> Column:
    """A charset's name as the aliases write it."""
    return F.regexp_replace(F.lower(charset), "[^a-z0-9]+", "_")


@cache
def names(codec: str) -> tuple[str, ...]:
    """A codec's own name and its aliases."""
    own = aliases.get(codec, codec)
    return tuple(sorted({codec, own, *(a.lower() for a, c in aliases.items() if c == own)}))


@cache
def table(codec: str) -> tuple[str, str]:
    """(characters of the bytes from 128 on that have one, what they stand for)."""
    there = [(chr(i), t) for i in range(128, 256) if (t := bytes([i]).decode(codec, "ignore"))]
    return "".join(a for a, _ in there), "".join(b for _, b in there)


def decode(raw: Column, charset: Column) -> Column:
    """Text of bytes in a charset that Spark or a table knows; null for others, and for bytes that are none of its."""

    def one(x: Column) -> Column:
        name, latin = x["name"], x["latin"]
        out = (
            F.when(name.isin(*names("utf_8")), F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")))
            .when(name.isin(*names("ascii")), F.when(~latin.rlike(r"[^\x00-\x7F]"), latin))
            .when(name.isin(*names("latin_1")), latin)
            .when(name.isin(*names("utf_16_le")), F.decode(raw, "UTF-16LE")).when(name.isin(*names("utf_16_be")), F.decode(raw, "UTF-16BE")).when(name.isin(*names("utf_16")), F.decode(raw, "UTF-16"))
        )
        for codec in TABLES:
            a, b = table(codec)
            missing = "".join(f"\\x{ord(c):02X}" for c in HIGH if c not in a)
            text = F.translate(latin, a, b)
            out = out.when(name.isin(*names(codec)), F.when(~latin.rlike(f"[{missing}]"), text) if missing else text)
        return out

    return let(F.struct(normal(charset).alias("name"), F.decode(raw, LATIN).alias("latin")), one)


def known(charset: Column) -> Column:
    return normal(charset).isin(*(n for c in ("utf_8", "ascii", "latin_1", "utf_16_le", "utf_16_be", "utf_16", *TABLES) for n in names(c)))
