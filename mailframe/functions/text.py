"""Builders for unstructured text, with and without encoded words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import make_word


def sp(n: int) -> Column:
    """n spaces."""
    return F.lit(" " * n)


def v(text: str | Column) -> Column:
    return F.lit(text) if isinstance(text, str) else text


def b(text: str | Column) -> Column:
    """An encoded word in base64."""
    return make_word(v(text), "B")


def q(text: str | Column) -> Column:
    """An encoded word in the "Q" form."""
    return make_word(v(text), "Q")


def compile(*parts: Column) -> Column:  # noqa: A001
    """The parts as one text, without anything between them."""
    return F.concat(*parts)


def concat(a: Column, b: Column) -> Column:
    """Two texts with a space between them."""
    return F.concat(a, F.lit(" "), b)


def render(text: Column) -> Column:
    """Text as it is written: line breaks folded, what isn't UTF-8 replaced."""
    return F.regexp_replace(F.make_valid_utf8(text), r"\r?\n[ \t]*", "\r\n ")
