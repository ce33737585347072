"""Content-Type and Content-Transfer-Encoding values with built-in Spark expressions.

A content type is ``struct<ty,ty_tag,subty,subty_tag,params:array<struct<key,tag,value>>>``: parameters in order,
duplicates kept, names in lower case, quoted pairs resolved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let, registry
from .fields import last, strip_comments, unfold

TOKEN = r"[^\x00-\x20\x7F()<>@,;:\"/\[\]?=\\]+"
DISCRETE, COMPOSITE = ("text", "image", "audio", "video", "application"), ("message", "multipart")
ENCODINGS = ("7bit", "8bit", "binary", "quoted-printable", "base64")
#: Possessive, so that long values need no stack.
_VALUE = rf'"[^"\\]*+(?:\\.[^"\\]*+)*+"|{TOKEN}'
PARAMETER = rf"\s*;\s*({TOKEN})\s*=\s*({_VALUE})"
#: Type, subtype and all parameters that follow without a break.
_WHOLE = rf"(?s)^\s*({TOKEN})\s*/\s*({TOKEN})((?:{PARAMETER})*+)"
# What a quoted pair stands for; others are themselves.
PAIRS = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}


def is_token(text: Column) -> Column:
    return text.rlike(rf"^{TOKEN}$")


def unescape(quoted: Column) -> Column:
    """The inside of a quoted string with its pairs resolved."""
    parts = F.regexp_extract_all(quoted, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in PAIRS.items() for x in kv))
    one = lambda x: F.coalesce(F.try_element_at(table, F.substring(x, 2, 1)), F.substring(x, 2, 1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("\\"), one(x)).otherwise(x)), "")


def escape(text: Column) -> Column:
    """A parameter's value as written: a token as it is, anything else quoted."""
    quoted = F.regexp_replace(text, r'(["\\])', r"\\$1")
    return F.when(is_token(text), text).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def type_tag(ty: Column) -> Column:
    return F.when(ty.isin(*DISCRETE), "discrete").when(ty.isin(*COMPOSITE), "composite").when(ty.rlike("^[xX]-"), "x").otherwise("ietf")


def registered(ty: Column, subty: Column, more: tuple[str, ...] = ()) -> Column:
    """The registry's spelling of a subtype, or null: a lookup in one literal of the registry's fixed size."""
    listed = ",".join(f"{t}/{s}".lower() + ":" + s for t, s in registry.entries(more))
    return F.try_element_at(F.str_to_map(F.lit(listed), F.lit(","), F.lit(":")), F.lower(F.concat(ty, F.lit("/"), subty)))


def parse(value: Column, more: tuple[str, ...] = ()) -> Column:
    """The content type at the start of a value (comments and folds aside), or null.

    A subtype that isn't registered and starts with x but not with x- is invalid.
    """

    def one(p: Column) -> Column:
        quoted = p["v"].startswith('"')
        inner = unescape(F.regexp_replace(p["v"], r'(?s)^"|"$', ""))
        return F.struct(F.lower(p["k"]).alias("key"), F.when(quoted, "String").otherwise("Token").alias("tag"), F.when(quoted, inner).otherwise(p["v"]).alias("value"))

    def whole(x: Column) -> Column:
        known, sub, rest = x["known"], x["sub"], x["rest"]
        pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(PARAMETER), F.lit(1)).alias("k"), F.regexp_extract_all(rest, F.lit(PARAMETER), F.lit(2)).alias("v"))
        tag = F.when(known.isNotNull(), "iana").when(sub.rlike("^[xX]-"), "x").otherwise("ietf")
        good = x["fits"] & (known.isNotNull() | ~sub.rlike("^[xX](?!-)"))
        return F.when(good, F.struct(x["ty"].alias("ty"), type_tag(x["ty"]).alias("ty_tag"), F.coalesce(known, sub).alias("subty"), tag.alias("subty_tag"), F.transform(pairs, one).alias("params")))

    def split(text: Column) -> Column:
        ty, sub, rest = (F.regexp_extract(text, _WHOLE, i) for i in (1, 2, 3))
        return F.struct(text.rlike(_WHOLE).alias("fits"), F.lower(ty).alias("ty"), sub.alias("sub"), rest.alias("rest"), registered(ty, sub, more).alias("known"))

    return let(strip_comments(unfold(value)), lambda text: let(split(text), whole))


def default() -> Column:
    params = F.array(F.struct(F.lit("charset").alias("key"), F.lit("Token").alias("tag"), F.lit("us-ascii").alias("value")))
    return F.struct(F.lit("text").alias("ty"), F.lit("discrete").alias("ty_tag"), F.lit("plain").alias("subty"), F.lit("iana").alias("subty_tag"), params.alias("params"))


def of_header(header: Column) -> Column:
    """The last Content-Type that parses, or text/plain in us-ascii."""
    all_of = F.transform(F.filter(header, lambda f: F.lower(f["name"]) == "content-type"), lambda f: parse(f["value"]))
    return F.coalesce(F.try_element_at(F.filter(all_of, lambda x: x.isNotNull()), F.lit(-1)), default())


def make(ty: Column, subty: Column, params: Column) -> Column:
    return F.struct(ty.alias("ty"), type_tag(ty).alias("ty_tag"), subty.alias("subty"), F.when(registered(ty, subty).isNotNull(), "iana").otherwise("ietf").alias("subty_tag"), params.alias("params"))


def with_parameter(ctype: Column, key: str, value: Column) -> Column:
    """The pair comes first; an existing value of the key stays, as later pairs win."""

    def more(c: Column) -> Column:
        pair = F.struct(F.lit(key.lower()).alias("key"), F.when(is_token(value), "Token").otherwise("String").alias("tag"), value.alias("value"))
        there = F.exists(c["params"], lambda p: p["key"] == key.lower())
        params = F.when(there, c["params"]).otherwise(F.concat(F.array(pair), c["params"]))
        return F.struct(*(c[x].alias(x) for x in ("ty", "ty_tag", "subty", "subty_tag")), params.alias("params"))

    return let(ctype, more)


def parameter(ctype: Column, key: str) -> Column:
    """The first value of a parameter, or null."""
    return F.try_element_at(F.filter(ctype["params"], lambda p: p["key"] == key.lower()), F.lit(1))["value"]


def boundary(ctype: Column) -> Column:
    return parameter(ctype, "boundary")


def parameters(ctype: Column) -> Column:
    """Parameters as a map; the last of a key wins."""

    def final(params: Column) -> Column:
        keys = F.array_distinct(F.transform(params, lambda p: p["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(params, lambda p: p["key"] == k), -1)["value"]))

    return let(ctype["params"], final)


def is_discrete(ctype: Column) -> Column:
    return ctype["ty"].isin(*DISCRETE)


def is_multipart(ctype: Column) -> Column:
    return ctype["ty"] == "multipart"


def is_message(ctype: Column) -> Column:
    return ctype["ty"] == "message"


def same(a: Column, b: Column) -> Column:
    """Equal types and subtypes in any case, whatever their tags, and the same map of parameters."""
    entries = lambda x: F.array_sort(F.map_entries(parameters(x)))
    return (F.lower(a["ty"]) == F.lower(b["ty"])) & (F.lower(a["subty"]) == F.lower(b["subty"])) & (entries(a) == entries(b))


def render(ctype: Column) -> Column:

    def text(c: Column) -> Column:
        pairs = F.transform(c["params"], lambda p: F.concat(F.lit("; "), p["key"], F.lit("="), escape(p["value"])))
        return F.concat(c["ty"], F.lit("/"), c["subty"], F.array_join(pairs, ""))

    return let(ctype, text)


# -- types, subtypes and parameters by themselves --------------------------------------------------------------------


def type_of_string(text: Column) -> Column:
    """A type's name: one of the seven in lower case, another token as it is, null for no token."""
    return F.when(F.lower(text).isin(*DISCRETE, *COMPOSITE), F.lower(text)).when(is_token(text), text)


def extension(text: Column) -> Column:
    """A name of one's own: X- before a token; null for other text."""
    return F.when(text.rlike("^[xX]-") & is_token(text) & (F.length(text) > 2), text)


def subtype_iana(ty: Column, text: Column, more: tuple[str, ...] = ()) -> Column:
    """The registered subtype, or null."""
    return registered(ty, text, more)


def key(text: Column) -> Column:
    """A parameter's name in lower case; null for no token."""
    return F.when(is_token(text), F.lower(text))


def value(text: Column) -> Column:
    """A parameter's value with its tag: Token, or String for any other UTF-8; null for what is none."""
    return F.when(F.is_valid_utf8(text), F.struct(F.when(is_token(text), "Token").otherwise("String").alias("tag"), text.alias("value")))


def of_map(params: Column) -> Column:
    """A map of parameters as the list in order of names."""
    return F.transform(F.array_sort(F.map_entries(params)), lambda e: F.struct(e["key"].alias("key"), F.when(is_token(e["value"]), "Token").otherwise("String").alias("tag"), e["value"].alias("value")))


def param_add(params: Column, name: str, text: Column) -> Column:
    """The map with a parameter set."""
    return F.map_concat(param_remove(params, name), F.create_map(F.lit(name.lower()), text))


def param_remove(params: Column, name: str) -> Column:
    return F.map_filter(params, lambda k, _: k != name.lower())


def param_mem(params: Column, name: str) -> Column:
    return F.map_contains_key(params, name.lower())


def param_find(params: Column, name: str) -> Column:
    return F.try_element_at(params, F.lit(name.lower()))


# -- transfer encodings ------------------------------------------------------------------------------------------


def encoding(value: Column) -> Column:
    """The mechanism of a Content-Transfer-Encoding value in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(strip_comments(unfold(value)), rf"^\s*({TOKEN})", 1)), F.lit(""))


def encoding_tag(name: Column) -> Column:
    return F.when(name.isin(*ENCODINGS), name).when(name.rlike("^[xX]-"), "x").when(name.isNotNull(), "ietf")


def encoding_of_string(name: Column) -> Column:
    """One of the five mechanisms, in lower case only; null for others."""
    return F.when(name.isin(*ENCODINGS), name)


def encoding_of_header(header: Column) -> Column:
    return F.coalesce(encoding(last(header, "content-transfer-encoding")), F.lit("7bit"))
