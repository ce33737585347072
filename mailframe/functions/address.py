"""Builders and checks for address parts, with built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x2D\x{80}-\x{10FFFF}]+$"
# Characters that have a letter after the backslash.
ESCAPES = {"\x07": "a", "\b": "b", "\t": "t", "\n": "n", "\x0b": "v", "\f": "f", "\r": "r", "\x00": "0"}


def is_atom(text: Column) -> Column:
    return text.rlike(ATOM)


def escape_string(text: Column) -> Column:
    """Backslashes before quotes, backslashes and control characters."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for c, letter in ESCAPES.items():
        out = F.replace(out, F.lit(c), F.lit("\\" + letter))
    return out


def word(text: Column) -> Column:
    """An atom, or a quoted string of anything else; null for empty text."""
    return F.when(F.length(text) > 0, F.struct(F.when(is_atom(text), "Atom").otherwise("String").alias("tag"), text.alias("value")))


def render_word(w: Column) -> Column:
    return F.when(w["tag"] == "Atom", w["value"]).otherwise(F.concat(F.lit('"'), escape_string(w["value"]), F.lit('"')))


def local(*words: Column) -> Column:
    """A local part of words; null if one is empty."""
    made = F.array(*(word(w) for w in words))
    return F.when(F.forall(made, lambda w: w.isNotNull()), made)


def render_local(parts: Column) -> Column:
    return F.array_join(F.transform(parts, render_word), ".")


def domain(text: Column) -> Column:
    """A domain of atoms; null if a part isn't one."""
    atoms = F.split(text, r"\.", -1)
    return F.when(F.forall(atoms, is_atom), F.struct(F.lit("Domain").alias("tag"), atoms.alias("atoms"), F.lit(None).cast("string").alias("literal")))


def ipv4(text: Column) -> Column:
    """[1.2.3.4]; null if it is none."""
    part = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(text.rlike(rf"^{part}(?:\.{part}){{3}}$"), _literal("IPv4", text))


def ipv6(text: Column) -> Column:
    good = text.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (text.rlike("^[0-9A-Fa-f:]+$") & (F.size(F.split(text, "::", -1)) == 2) & (F.size(F.split(text, ":", -1)) <= 8))
    return F.when(good, _literal("IPv6", F.concat(F.lit("IPv6:"), text)))


def extension(ldh: Column, content: Column) -> Column:
    """[ldh:content]; null unless both keep to their characters."""
    good = ldh.rlike("^[A-Za-z0-9-]*[A-Za-z0-9]$") & content.rlike(r"^[\x21-\x5A\x5E-\x7E]+$")
    return F.when(good, _literal("Extension", F.concat(ldh, F.lit(":"), content)))


def literal(text: Column) -> Column:
    return F.when(text.rlike(r"^[\x21-\x5A\x5E-\x7E]*$"), _literal("Literal", text))


def _literal(tag: str, text: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.array().cast("array<string>").alias("atoms"), text.alias("literal"))


def render_domain(d: Column) -> Column:
    return F.when(d["tag"] == "Domain", F.array_join(d["atoms"], ".")).otherwise(F.concat(F.lit("["), d["literal"], F.lit("]")))


def mailbox(local_part: Column, at: Column, name: Column | None = None) -> Column:
    """name <local@domain> or local@domain as text."""
    inner = F.concat(render_local(local_part), F.lit("@"), render_domain(at))
    if name is None:
        return inner
    plain = name.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~ \x2D]+$")
    shown = F.when(plain, name).otherwise(F.concat(F.lit('"'), escape_string(name), F.lit('"')))
    return F.when(F.length(name) > 0, F.concat(shown, F.lit(" <"), inner, F.lit(">"))).otherwise(inner)


#: A dot of a phrase: it joins the word before it.
DOT = "."


def phrase(*parts: Column | str) -> Column:
    """A display name of words, encoded words (``words.make_word``) and ``DOT``s as text; null if a word is null or empty, or it starts with a dot."""
    if not parts or isinstance(parts[0], str):
        return F.lit(None).cast("string")
    shown = [p if isinstance(p, str) else F.when(p.rlike(r"^=\?[^? ]+\?[QqBb]\?[^? ]*\?=$"), p).otherwise(render_word(word(p))) for p in parts]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p if i == 0 else F.concat(F.lit(" "), p) for i, p in enumerate(shown)))


def named(shown: Column, mailbox_text: Column) -> Column:
    """phrase <local@domain>."""
    return F.concat(shown, F.lit(" <"), mailbox_text, F.lit(">"))


def group(name: Column, members: Column) -> Column:
    """name: a, b; as text; null without members."""
    return F.when(F.size(members) > 0, F.concat(name, F.lit(": "), F.array_join(members, ", "), F.lit(";")))


def same(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """Equal mailbox structs: names and locals as they are or in any case, domains in any case."""
    text = (lambda x: x) if case_sensitive else F.lower
    key = lambda m: F.struct(text(F.coalesce(m["name"], F.lit(""))), text(render_local(m["local"])), F.lower(render_domain(m["domain"])))
    return key(a) == key(b)


def with_name(m: Column, name: Column) -> Column:
    """The mailbox under another display name."""
    return m.withField("name", name)


def same_address(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """Equal addresses: a group is no mailbox; groups are equal in name and members, in order."""
    text = (lambda x: x) if case_sensitive else F.lower
    members = lambda x: F.transform(x["mailboxes"], lambda m: F.struct(text(F.coalesce(m["name"], F.lit(""))), text(render_local(m["local"])), F.lower(render_domain(m["domain"]))))
    return (a["tag"] == b["tag"]) & text(F.coalesce(a["group"], F.lit(""))).eqNullSafe(text(F.coalesce(b["group"], F.lit("")))) & (members(a) == members(b))


def same_message_id(a: Column, b: Column) -> Column:
    """Equal ids: locals as they are, domains in any case."""
    lower = lambda x: F.transform(x["domain"], F.lower)
    return (a["local"] == b["local"]) & (lower(a) == lower(b))


def message_id(local_part: Column, at: Column) -> Column:
    """<local@domain>; null where the domain is an IP literal or a part is null."""
    return F.when(at["tag"].isin("Domain", "Literal"), F.concat(F.lit("<"), render_local(local_part), F.lit("@"), render_domain(at), F.lit(">")))
