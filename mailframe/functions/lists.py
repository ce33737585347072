"""Address lists and message ids with built-in expressions: tokens, then one regular expression over their kinds.

A value is unfolded, loses its comments, and is cut into tokens. Each token has a kind of one letter: an atom, a quoted string, a
literal, a mark that stands for itself, or another character. Over the string of kinds the grammar of addresses is regular, groups
included, since they don't nest: a possessive pattern finds the addresses one after the other, and the tokens under a match are its words.
What follows the last whole address is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields, let, running

ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x2D\x{80}-\x{10FFFF}]"
#: White space goes with the token after it.
_TOKEN = rf'(?s)[ \t\r\n]*+({ATEXT}++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\[[^\[\]\\]*+(?:\\.[^\[\]\\]*+)*+\]|[^ \t\r\n])'

_WORDS = r"[aq](?:\.[aq])*+(?!\.)"
_DOMAIN = r"(?:l|a(?:\.a)*+(?!\.))"
_PHRASE = "[aq][aq.]*+"
_ROUTE = rf"(?:,*+(?=@)(?:,|@{_DOMAIN})*+:|,*+)"
_MAILBOX = rf"(?:(?:{_PHRASE})?+<{_ROUTE}{_WORDS}@{_DOMAIN}>|{_WORDS}@{_DOMAIN})"
#: Two patterns, since a group of an alternative that failed keeps what it held.
_ANGLED, _BARE = rf"^((?:{_PHRASE})?+)<({_ROUTE})({_WORDS})@({_DOMAIN})>$", rf"^({_WORDS})@({_DOMAIN})$"
_MEMBERS = rf",*+(?:{_MAILBOX}(?:,++{_MAILBOX})*+,*+)?+"
_GROUP = rf"{_PHRASE}:{_MEMBERS};"
_ADDRESS = rf"(?>{_GROUP}|{_MAILBOX})"

WORD = "struct<tag:string,value:string>"
DOMAIN = "struct<tag:string,atoms:array<string>,literal:string>"
MAILBOX = f"struct<name:string,local:array<{WORD}>,domain:{DOMAIN},route:array<string>,address:string>"
ADDRESS = f"struct<tag:string,group:string,mailboxes:array<{MAILBOX}>>"
MESSAGE_ID = "struct<local:array<string>,domain:array<string>,text:string>"


def tokens(value: Column) -> Column:
    """``array<struct<k,v>>``: kind and value; quoted pairs resolved in quoted strings."""

    def one(t: Column) -> Column:
        long = F.length(t) > 1
        quoted, literal = long & t.startswith('"'), long & t.startswith("[")
        kind = F.when(quoted, "q").when(literal, "l").when(long, "a").when(t.isin(*"<>@,;:."), t).when(t.rlike(rf"^{ATEXT}"), "a").otherwise("o")
        inner = F.substr(t, F.lit(2), F.length(t) - 2)
        text = F.when(quoted, F.regexp_replace(inner, r"(?s)\\(.)", "$1")).when(literal, F.btrim(inner, F.lit(" \t\r\n"))).otherwise(t)
        return F.struct(kind.alias("k"), text.alias("v"))

    return F.transform(F.regexp_extract_all(fields.strip_comments(fields.unfold(value)), F.lit(_TOKEN), F.lit(1)), one)


def _kinds(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda t: t["k"]), "")


def _each(found: Column, pattern: str, one, first: bool = False) -> Column:  # noqa: ANN001
    """one(kinds, tokens) of each match, matches following each other from the start with commas between; the commas before a match are not its."""

    def matched(kinds: Column) -> Column:
        return F.regexp_extract_all(kinds, F.lit(rf"(?:^,*+|\G,++){pattern}"), F.lit(0))

    def placed(matches: Column) -> Column:
        starts = running(F.transform(matches, F.length))

        def cut(y: Column) -> Column:
            skip = F.length(F.regexp_extract(y["m"], "^,*+", 0))
            return F.struct(F.substr(y["m"], skip + 1).alias("k"), F.slice(found, (y["s"] + skip + 1).cast("int"), F.length(y["m"]) - skip).alias("t"))

        return F.transform(F.transform(F.arrays_zip(matches.alias("m"), starts.alias("s")), cut), lambda y: one(y["k"], y["t"]))

    return let(let(_kinds(found), matched), placed)


def _part(found: Column, start: Column, size: Column) -> Column:
    return F.slice(found, (start + 1).cast("int"), size.cast("int"))


def _words(found: Column) -> Column:
    return F.transform(F.filter(found, lambda t: t["k"].isin("a", "q")), lambda t: F.struct(F.when(t["k"] == "a", "Atom").otherwise("String").alias("tag"), t["v"].alias("value")))


def word_text(w: Column) -> Column:
    return F.when(w["tag"] == "Atom", w["value"]).otherwise(F.concat(F.lit('"'), F.regexp_replace(w["value"], r'(["\\])', r"\\$1"), F.lit('"')))


def _local_text(local: Column) -> Column:
    return F.array_join(F.transform(local, word_text), ".")


def _domain(found: Column) -> Column:
    v = F.try_element_at(found, F.lit(1))["v"]
    literal = F.try_element_at(found, F.lit(1))["k"] == "l"
    tag = F.when(~literal, "Domain").when(F.lower(v).startswith("ipv6:"), "IPv6").when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "IPv4").when(v.rlike("^[A-Za-z0-9-]*[A-Za-z0-9]:.+$"), "Extension").otherwise("Literal")
    atoms = F.when(literal, F.array().cast("array<string>")).otherwise(F.transform(F.filter(found, lambda t: t["k"] == "a"), lambda t: t["v"]))
    return F.struct(tag.alias("tag"), atoms.alias("atoms"), F.when(literal, v).alias("literal"))


def _domain_text(found: Column) -> Column:
    v = F.try_element_at(found, F.lit(1))
    return F.when(v["k"] == "l", F.concat(F.lit("["), v["v"], F.lit("]"))).otherwise(F.array_join(F.transform(found, lambda t: t["v"]), ""))


def _name(found: Column, decoded) -> Column:  # noqa: ANN001
    """The words of a phrase; a dot joins the word before it."""
    shown = F.transform(found, lambda t, i: F.when(t["k"] == ".", F.lit(".")).otherwise(F.concat(F.when(i > 0, " ").otherwise(""), F.when(t["k"] == "a", decoded(t["v"])).otherwise(t["v"]))))
    return F.nullif(F.array_join(shown, ""), F.lit(""))


def _route(kinds: Column, found: Column) -> Column:
    pieces = F.regexp_extract_all(kinds, F.lit("[^@]*@[la.]++"), F.lit(0))

    def placed(ps: Column) -> Column:
        starts = running(F.transform(ps, F.length))

        def one(y: Column) -> Column:
            size = F.length(F.regexp_extract(y["p"], "@([^@]*)$", 1))
            return _domain_text(_part(found, y["s"] + F.length(y["p"]) - size, size))

        return F.transform(F.arrays_zip(ps.alias("p"), starts.alias("s")), one)

    return let(pieces, placed)


def _mailbox(kinds: Column, found: Column, decoded) -> Column:  # noqa: ANN001
    def size(i: int, bare: int = 0) -> Column:
        return F.when(kinds.endswith(">"), F.length(F.regexp_extract(kinds, _ANGLED, i))).otherwise(F.length(F.regexp_extract(kinds, _BARE, bare)) if bare else 0)

    def built(n: Column) -> Column:
        phrase, route, angled, local, domain = (n[x] for x in ("phrase", "route", "angled", "local", "domain"))
        at = phrase + route + angled

        def joined(x: Column) -> Column:
            address = F.concat(_local_text(x["local"]), F.lit("@"), _domain_text(x["domain"]))
            way = _route(F.substr(kinds, phrase + 2, route), _part(found, phrase + 1, route))
            return F.struct(_name(_part(found, F.lit(0), phrase), decoded).alias("name"), x["local"].alias("local"), _domain(x["domain"]).alias("domain"), way.alias("route"), address.alias("address"))

        return let(F.struct(_words(_part(found, at, local)).alias("local"), _part(found, at + local + 1, domain).alias("domain")), joined)

    sizes = F.struct(size(1).alias("phrase"), size(2).alias("route"), F.when(kinds.endswith(">"), 1).otherwise(0).alias("angled"), size(3, 1).alias("local"), size(4, 2).alias("domain"))
    return let(sizes, built)


def _some(found: Column, kind: str) -> Column:
    """Null for none."""
    return let(found, lambda x: F.when(F.size(x) > 0, x.cast(f"array<{kind}>")))


def mailboxes(value: Column, decoded) -> Column:  # noqa: ANN001
    """``array<mailbox>`` of the mailboxes that a value starts with, or null. decoded: what becomes of an atom of a name."""
    return let(tokens(value), lambda t: _some(_each(t, _MAILBOX, lambda k, x: _mailbox(k, x, decoded)), MAILBOX))


def mailbox(value: Column, decoded, whole: bool = False) -> Column:  # noqa: ANN001
    """``array<mailbox>`` of none or one; whole: nothing may follow it."""

    def one(found: Column) -> Column:
        kinds = F.regexp_extract(_kinds(found), f"^{_MAILBOX}" + ("$" if whole else ""), 0)
        none = F.array().cast(f"array<{MAILBOX}>")
        return let(kinds, lambda k: F.when(F.length(k) > 0, F.array(_mailbox(k, F.slice(found, 1, F.greatest(F.length(k), F.lit(1))), decoded)).cast(f"array<{MAILBOX}>")).otherwise(none))

    return let(tokens(value), one)


def addresses(value: Column, decoded) -> Column:  # noqa: ANN001
    """``array<address>`` of the mailboxes and groups that a value starts with, or null."""

    def one(kinds: Column, found: Column) -> Column:
        name = F.length(F.regexp_extract(kinds, f"^({_PHRASE}):", 1))
        inside = _part(found, name + 1, F.length(kinds) - name - 2)
        group = F.when(name > 0, _name(_part(found, F.lit(0), name), decoded))
        # a mailbox is a list of one
        members = let(F.when(name > 0, inside).otherwise(found), lambda x: _each(x, _MAILBOX, lambda k, y: _mailbox(k, y, decoded)))
        return F.struct(F.when(name > 0, "Group").otherwise("Mailbox").alias("tag"), group.alias("group"), members.cast(f"array<{MAILBOX}>").alias("mailboxes"))

    return let(tokens(value), lambda t: _some(_each(t, _ADDRESS, one), ADDRESS))


def message_id(value: Column) -> Column:
    """``struct<local,domain,text>`` of the id that a value starts with; null for none, and for a domain that is an IP or an extension literal."""

    def one(found: Column) -> Column:
        pattern = rf"^<({_WORDS})@({_DOMAIN})>"
        kinds = _kinds(found)
        size = F.length(F.regexp_extract(kinds, pattern, 1))
        parts = F.struct(_words(_part(found, F.lit(1), size)).alias("local"), _part(found, size + 2, F.length(F.regexp_extract(kinds, pattern, 2))).alias("domain"))

        def built(x: Column) -> Column:
            text = F.concat(F.lit("<"), _local_text(x["local"]), F.lit("@"), _domain_text(x["domain"]), F.lit(">"))
            d = _domain(x["domain"])
            atoms = F.when(d["tag"] == "Domain", d["atoms"]).otherwise(F.array(d["literal"]))
            good = (F.size(x["local"]) > 0) & d["tag"].isin("Domain", "Literal")
            return F.array(F.struct(good.alias("good"), F.transform(x["local"], lambda w: w["value"]).alias("local"), atoms.alias("domain"), text.alias("text")))

        ids = let(parts, built)
        return F.try_element_at(F.transform(F.filter(ids, lambda i: i["good"]), lambda i: F.struct(i["local"].alias("local"), i["domain"].alias("domain"), i["text"].alias("text"))), F.lit(1))

    return let(tokens(value), one)


def render_mailbox(m: Column) -> Column:
    """name <@route:local@domain>, with no more of it than there is."""
    plain = m["name"].rlike(rf"^{ATEXT}+(?: {ATEXT}+)*$")
    name = F.when(plain, m["name"]).otherwise(F.concat(F.lit('"'), F.regexp_replace(m["name"], r'(["\\])', r"\\$1"), F.lit('"')))
    inner = F.when(F.size(m["route"]) > 0, F.concat(F.array_join(F.transform(m["route"], lambda d: F.concat(F.lit("@"), d)), ","), F.lit(":"), m["address"])).otherwise(m["address"])
    return F.when(m["name"] != "", F.concat(name, F.lit(" <"), inner, F.lit(">"))).when(F.size(m["route"]) > 0, F.concat(F.lit("<"), inner, F.lit(">"))).otherwise(inner)


def render(a: Column) -> Column:
    """A mailbox, or a group with its members."""
    inner = F.array_join(F.transform(a["mailboxes"], render_mailbox), ", ")
    return F.when(a["tag"] == "Group", F.concat(a["group"], F.lit(": "), inner, F.lit(";"))).otherwise(inner)
