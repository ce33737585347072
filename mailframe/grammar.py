"""The grammars that no regular expression can express, in plain Python: comments, addresses, message ids, part trees.

Only Arrow functions of this library call these; whatever is regular is a built-in Spark expression instead
(``mailframe.functions``). All input is one header value without its final CRLF, or the bytes of one message.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from .functions import registry

ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-\u0080-\U0010FFFF]"
_FOLD = re.compile(r"\r\n[ \t]+")
_TOKEN = re.compile(rf"(?P<wsp>[ \t\r\n]+)|(?P<atom>{ATEXT}+)|\"(?P<quoted>(?:[^\"\\]|\\.)*)\"|\[(?P<literal>(?:[^\[\]\\]|\\.)*)\]|(?P<mark>[<>()@,;:.])", re.DOTALL)
ENCODED_WORD = re.compile(r"=\?([^?\s()<>@,;:\"/\[\].=]+)\?([QqBb])\?([^? ]+)\?=")


class Malformed(ValueError):
    """The input isn't what the grammar asks for."""


def unfold(value: str) -> str:
    """Each line break with the white space that follows it becomes one space."""
    return _FOLD.sub(" ", value)


def strip_comments(value: str) -> str:
    """value without comments, nested ones included; parentheses in quoted strings stay. An open comment runs to the end."""
    if "(" not in value:
        return value
    out, depth, quoted, i = [], 0, False, 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            if not depth:
                out.append(value[i : i + 2])
            i += 2
            continue
        if c == '"' and not depth:
            quoted = not quoted
        if not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
        i += 1
    return "".join(out)


# -- encoded words -----------------------------------------------------------------------------------------------


def decode_q(text: str) -> bytes:
    """The "Q" encoding: _ is a space, =XX a byte; a malformed escape becomes U+FFFD."""
    out, i, raw = bytearray(), 0, text.replace("_", " ").encode()
    while i < len(raw):
        if raw[i : i + 1] == b"=":
            digits = raw[i + 1 : i + 3]
            if re.fullmatch(rb"[0-9A-Fa-f]{2}", digits):
                out.append(int(digits, 16))
                i += 3
            else:
                out += "\ufffd".encode()
                i += 1
        else:
            out.append(raw[i])
            i += 1
    return bytes(out)


UNKNOWN = "unknown charset"


def decode_charset(raw: bytes, charset: str) -> tuple[str, str | None]:
    """(text, error). The text of an unknown charset is its bytes read as UTF-8, with what isn't replaced."""
    try:
        return raw.decode(charset), None
    except LookupError:
        return raw.decode("utf-8", "replace"), f"{UNKNOWN} {charset}"
    except UnicodeDecodeError as e:
        return raw.decode(charset, "replace"), f"not {charset}: {e.reason}"


def encoded_word(word: str) -> dict | None:
    """The encoded word at the start of a text: charset, encoding, data and error; None if there is none."""
    m = ENCODED_WORD.match(word)
    if not m:
        return None
    charset, encoding, text = m[1], m[2].upper(), m[3]
    out = {"charset": charset.upper() if charset.lower() != "utf-8" else "UTF-8", "encoding": encoding, "data": None, "error": None}
    if encoding == "B":
        try:
            raw = base64.b64decode(text, validate=True)
        except ValueError as e:
            return out | {"error": f"not base64: {e}"}
    else:
        raw = decode_q(text)
    data, error = decode_charset(raw, charset)
    return out | ({"error": error} if error else {"data": data})


def decode_words(text: str) -> str:
    """text with its encoded words decoded; what isn't a valid one stays, and so does the space between two."""

    def one(m: re.Match) -> str:
        got = encoded_word(m[0])
        return m[0] if got is None or got["data"] is None else got["data"]

    return ENCODED_WORD.sub(one, text)


# -- addresses ---------------------------------------------------------------------------------------------------


@dataclass
class _Tokens:
    """Tokens of an address value without comments; white space is not kept."""

    items: list[tuple[str, str]]
    at: int = 0

    @classmethod
    def of(cls, value: str) -> _Tokens:
        items, i, value = [], 0, strip_comments(unfold(value))
        while i < len(value):
            m = _TOKEN.match(value, i)
            if not m:
                items.append(("other", value[i]))
                i += 1
                continue
            if m.lastgroup != "wsp":
                text = m[m.lastgroup]
                items.append((m.lastgroup, re.sub(r"\\(.)", r"\1", text) if m.lastgroup == "quoted" else text))
            i = m.end()
        return cls(items)

    def peek(self, *marks: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] == "mark" and self.items[self.at][1] in marks

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    def take(self, mark: str) -> bool:
        if self.peek(mark):
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise Malformed(f"expected {mark}")


def _word(t: _Tokens) -> dict:
    kind, value = t.items[t.at] if t.at < len(t.items) else ("end", "")
    if kind not in ("atom", "quoted"):
        raise Malformed("expected a word")
    t.at += 1
    return {"tag": "Atom" if kind == "atom" else "String", "value": value}


def _local(t: _Tokens) -> list[dict]:
    out = [_word(t)]
    while t.take("."):
        out.append(_word(t))
    return out


def _domain(t: _Tokens) -> dict:
    if t.kind() == "literal":
        value = t.items[t.at][1].strip()
        t.at += 1
        tag = "IPv6" if value.lower().startswith("ipv6:") else "IPv4" if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value) else "Extension" if re.fullmatch(r"[A-Za-z0-9-]*[A-Za-z0-9]:.+", value) else "Literal"
        return {"tag": tag, "atoms": [], "literal": value}
    atoms = []
    while True:
        if t.kind() != "atom":
            raise Malformed("expected an atom of a domain")
        atoms.append(t.items[t.at][1])
        t.at += 1
        if not t.take("."):
            return {"tag": "Domain", "atoms": atoms, "literal": None}


def domain_text(d: dict) -> str:
    return ".".join(d["atoms"]) if d["tag"] == "Domain" else f"[{d['literal']}]"


def word_text(w: dict) -> str:
    return w["value"] if w["tag"] == "Atom" else '"' + re.sub(r'(["\\])', r"\\\1", w["value"]) + '"'


def _mailbox(name: str | None, local: list[dict], domain: dict, route: list[str]) -> dict:
    return {"name": name, "local": local, "domain": domain, "route": route, "address": ".".join(map(word_text, local)) + "@" + domain_text(domain)}


def _phrase(t: _Tokens) -> str | None:
    """A display name: words and dots, encoded words decoded; None if there is none."""
    out: list[str] = []
    while t.kind() in ("atom", "quoted") or t.peek("."):
        kind, value = t.items[t.at]
        t.at += 1
        if kind == "mark":
            if not out:
                raise Malformed("a name can't start with a dot")
            out[-1] += "."
        else:
            out.append(decode_words(value) if kind == "atom" else value)
    return " ".join(out) or None


def _one_mailbox(t: _Tokens) -> dict:
    start = t.at
    try:
        name = _phrase(t)
        t.need("<")
        route = []
        while t.peek("@", ","):
            if t.take("@"):
                route.append(domain_text(_domain(t)))
            else:
                t.take(",")
        if route:
            t.need(":")
        local = _local(t)
        t.need("@")
        domain = _domain(t)
        t.need(">")
        return _mailbox(name, local, domain, route)
    except Malformed:
        t.at = start
    local = _local(t)
    t.need("@")
    return _mailbox(None, local, _domain(t), [])


def _mailboxes(t: _Tokens) -> list[dict]:
    out = []
    while True:
        while t.take(","):
            pass
        start = t.at
        try:
            out.append(_one_mailbox(t))
        except Malformed:
            t.at = start
            return out
        if not t.peek(","):
            return out


def _one_address(t: _Tokens) -> dict:
    start = t.at
    try:
        name = _phrase(t)
        if name is None:
            raise Malformed("a group has a name")
        t.need(":")
        members = _mailboxes(t)
        t.need(";")
        return {"tag": "Group", "group": name, "mailboxes": members}
    except Malformed:
        t.at = start
    return {"tag": "Mailbox", "group": None, "mailboxes": [_one_mailbox(t)]}


def addresses(value: str) -> list[dict] | None:
    """Mailboxes and groups of a list; what follows the last whole one is ignored. None if there is none."""
    t, out = _Tokens.of(value), []
    while True:
        while t.take(","):
            pass
        start = t.at
        try:
            out.append(_one_address(t))
        except Malformed:
            t.at = start
            return out or None
        if not t.peek(","):
            return out


def mailboxes(value: str) -> list[dict] | None:
    return _mailboxes(_Tokens.of(value)) or None


def mailbox(value: str, whole: bool = False) -> dict | None:
    """One mailbox; with ``whole``, nothing may follow it."""
    t = _Tokens.of(value)
    try:
        got = _one_mailbox(t)
    except Malformed:
        return None
    return got if not whole or t.kind() == "end" else None


def message_id(value: str) -> dict | None:
    """<local@domain>; an address literal of an IP kind is refused."""
    t = _Tokens.of(value)
    try:
        t.need("<")
        local = _local(t)
        t.need("@")
        domain = _domain(t)
        t.need(">")
    except Malformed:
        return None
    if domain["tag"] not in ("Domain", "Literal"):
        return None
    return {"local": [w["value"] for w in local], "domain": domain["atoms"] or [domain["literal"]], "text": f"<{'.'.join(map(word_text, local))}@{domain_text(domain)}>"}


def render_mailbox(m: dict) -> str:
    words = m["name"] and (m["name"] if re.fullmatch(rf"{ATEXT}+(?: {ATEXT}+)*", m["name"]) else '"' + re.sub(r'(["\\])', r"\\\1", m["name"]) + '"')
    route = "".join(f"@{x}," for x in m["route"] or [])[:-1]
    inner = (route + ":" if route else "") + m["address"]
    return f"{words} <{inner}>" if words else f"<{inner}>" if route else inner


def render_address(a: dict) -> str:
    inner = ", ".join(map(render_mailbox, a["mailboxes"]))
    return f"{a['group']}: {inner};" if a["tag"] == "Group" else inner


def fold(line: str, margin: int = 78) -> str:
    """A header line folded before a space wherever it would pass the margin; a word that is longer stays whole."""
    out, width = [], 0
    for i, word in enumerate(re.split(r"(?<=[^ ]) (?=[^ ])", line)):
        if i and width + 1 + len(word) > margin:
            out.append("\r\n " + word)
            width = 1 + len(word)
        else:
            out.append(" " * bool(i) + word)
            width += bool(i) + len(word)
    return "".join(out)


# -- content types -----------------------------------------------------------------------------------------------

_TYPE = re.compile(r"\s*([^\s()<>@,;:\"/\[\]?=\\]+)\s*/\s*([^\s()<>@,;:\"/\[\]?=\\]+)")
_PARAMETER = re.compile(r"\s*;\s*([^\s()<>@,;:\"/\[\]?=\\]+)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^\s()<>@,;:\"/\[\]?=\\]+))", re.DOTALL)
# What a quoted pair of a parameter stands for.
_PAIRS = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}


def content_type(value: str) -> tuple[str, str, list[tuple[str, str]]] | None:
    """(type, subtype, parameters in order); what follows the last whole parameter is ignored."""
    value = strip_comments(unfold(value))
    m = _TYPE.match(value)
    if not m or (re.match("[xX](?!-)", m[2]) and (m[1].lower(), m[2].lower()) not in registry.known()):
        return None
    params, at = [], m.end()
    while p := _PARAMETER.match(value, at):
        params.append((p[1].lower(), p[3] if p[3] is not None else re.sub(r"\\(.)", lambda x: _PAIRS.get(x[1], x[1]), p[2], flags=re.DOTALL)))
        at = p.end()
    return m[1].lower(), m[2], params


# -- bodies ------------------------------------------------------------------------------------------------------


def decode_quoted_printable(raw: bytes) -> bytes:
    """Soft breaks joined, white space at line ends dropped, CRLF to LF; a malformed escape becomes U+FFFD."""
    lines = [line.rstrip(b" \t") for line in raw.split(b"\r\n")]
    ends = [b"\n"] * (len(lines) - 1) + [b""]
    joined = b"".join(x[:-1] if x.endswith(b"=") else x + end for x, end in zip(lines, ends, strict=True))
    return re.sub(rb"=([0-9A-Fa-f]{2})?", lambda m: bytes([int(m[1], 16)]) if m[1] else "\ufffd".encode(), joined)


def decode_base64(raw: bytes) -> bytes:
    try:
        return base64.b64decode(re.sub(rb"[\r\n\t ]+", b"", raw), validate=True)
    except ValueError as e:
        raise Malformed(f"not base64: {e}") from None


def decode_body(raw: bytes, encoding: str) -> bytes:
    return decode_base64(raw) if encoding == "base64" else decode_quoted_printable(raw) if encoding == "quoted-printable" else raw


# -- messages ----------------------------------------------------------------------------------------------------

_FIELD = re.compile(rb"([\x21-\x39\x3B-\x7E]+)[ \t]*:((?:[^\r]|\r(?!\n)|\r\n[ \t])*)\r\n")
#: Parts within parts that this reader follows, since it calls itself; ``functions.tree`` follows any.
DEEPEST = 200


@dataclass
class Node:
    """A part of a message. kind: leaf, multipart, message. body is None for parts with parts and for parts without one."""

    path: list[int]
    kind: str
    header: list[tuple[str, str, int, int]]
    body: bytes | None = None
    has_body: bool = True
    encoding: str = "7bit"
    type: tuple[str, str, list[tuple[str, str]]] | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def header(data: bytes, at: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """((name, unfolded value, start, end) of each field, where the fields end)."""
    out = []
    while m := _FIELD.match(data, at):
        out.append((m[1].decode(), unfold(text_of(m[2])), m.start(), m.end()))
        at = m.end()
    return out, at


def _last(fields: list[tuple[str, str, int, int]], name: str, parse):  # noqa: ANN001, ANN202
    return next((got for n, v, _, _ in reversed(fields) if n.lower() == name and (got := parse(v)) is not None), None)


def encoding_of(value: str) -> str | None:
    m = re.match(r"\s*([^\s()<>@,;:\"/\[\]?=\\]+)", strip_comments(value))
    return m[1].lower() if m else None


class _Reader:
    def __init__(self, data: bytes, transfer: bool) -> None:
        self.data, self.transfer = data, transfer

    def end(self, boundary: bytes | None, at: int) -> int:
        found = self.data.find(b"\r\n--" + boundary, at) if boundary else -1
        return len(self.data) if found < 0 else found

    def message(self, at: int, boundary: bytes | None, path: list[int]) -> tuple[Node, int]:
        fields, at = header(self.data, at)
        if self.data[at : at + 2] != b"\r\n":
            raise Malformed("expected an empty line after the header")
        return self.body(at + 2, boundary, fields, path)

    def body(self, at: int, boundary: bytes | None, fields: list, path: list[int]) -> tuple[Node, int]:
        if len(path) > DEEPEST:
            raise Malformed("too many parts within parts")
        kind = _last(fields, "content-type", content_type) or ("text", "plain", [("charset", "us-ascii")])
        encoding = _last(fields, "content-transfer-encoding", encoding_of) or "7bit"
        node = Node(path, "leaf", fields, None, True, encoding, kind)
        if kind[0] == "message":
            node.kind, node.has_body = "message", False
            child, at = self.message(at, boundary, [*path, 0])
            node.children.append(child)
        elif kind[0] == "multipart":
            node.kind, node.has_body = "multipart", False
            own = next((v for k, v in kind[2] if k == "boundary"), None)
            if own is None:
                raise Malformed("expected boundary")
            at = self.parts(at, own.encode(), boundary, node)
        else:
            to = self.end(boundary, at)
            raw = self.data[at:to]
            node.body, at = decode_body(raw, encoding) if self.transfer else raw, to
        return node, at

    def parts(self, at: int, own: bytes, parent: bytes | None, node: Node) -> int:
        first = self.data.find(b"--" + own, at)
        if first < 0:
            raise Malformed("expected a boundary line")
        at = self.after(first + 2 + len(own))
        while at is not None:
            fields, at = header(self.data, at)
            path = [*node.path, len(node.children)]
            if self.data.startswith(b"\r\n--" + own, at):
                node.children.append(Node(path, "leaf", fields, None, False, "7bit", None))
            elif self.data[at : at + 2] == b"\r\n":
                child, at = self.body(at + 2, own, fields, path)
                node.children.append(child)
            else:
                raise Malformed("expected an empty line after a part's header")
            if not self.data.startswith(b"\r\n--" + own, at):
                return at
            stop, at = at, self.after(at + 4 + len(own))
        return self.end(parent, stop) if node.children else len(self.data)

    def after(self, at: int) -> int | None:
        """Where a part starts after its boundary line; None after the last or where the line goes on."""
        m = re.compile(rb"[ \t]*\r\n").match(self.data, at)
        return m.end() if m else None


def parse(data: bytes, transfer: bool = True) -> Node:
    """The part tree of a message. transfer: whether transfer encodings are decoded."""
    return _Reader(bytes(data), transfer).message(0, None, [])[0]
