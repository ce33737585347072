import hashlib
import random
import re

from mailframe.llm import pii, queries


def brute(text):
    """The contract's patterns as they stand."""
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(found)]


def test_plain_equals_the_patterns():
    rng = random.Random(4)
    alphabet = ["a", "Z", "@", ".", "-", "+", " ", "(", ")", "1", "4", "0", "25", "é", "_", "%", "\n", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "@x.y"]
    for _ in range(20000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(30)))
        assert pii.plain(t) == brute(t), t


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_pii(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute(text[r.doc_id])
        line = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in base) for k in pii.KINDS)
        assert set(line) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_card for r in rows) > 5


DISGUISED = [
    ("write to jane.doe at example dot org today", "jane.doe at example dot org", "email"),
    ("mail jane (at) mail4 [dot] example.com!", "jane (at) mail4 [dot] example.com", "email"),
    ("mail <jane[at]example.com>", "jane[at]example.com", "email"),
    ("mail jаne@exаmple.com now", "jаne@exаmple.com", "email"),
    ("mail jane＠example．com now", "jane＠example．com", "email"),
    ("mail ja​ne@example.com now", "ja​ne@example.com", "email"),
    ("call + one five five five one two three four five six seven now", None, None),
    ("call +one five five five one two three four five six seven now", "+one five five five one two three four five six seven", "phone"),
    ("we look at site.com daily, mail bob(at)x.org now", "bob(at)x.org", "email"),
    ("host 10 [.] 0 [.] 0 [.] 1 is down", "10 [.] 0 [.] 0 [.] 1", "ip"),
    ("card four one one one one one one one one one one one one one one one ok", "four one one one one one one one one one one one one one one one", "card"),
]
CLEAN = ["we met at noon and the dot was red", "look at example.org for more", "one two three", "one two three four five six", "Größe über élan, at dot at dot", "привет мир", "un dos tres quatre cinq seis sieben", "f(at) [dot]"]


def test_disguises_map_back_to_the_source():
    for text, want, kind in DISGUISED:
        base, every = pii.spans(text)
        added = [(text[a:b], k) for a, b, k in every if (a, b, k) not in base]
        assert added == ([(want, kind)] if want else []), (text, added)
    for text in CLEAN:
        assert pii.spans(text) == ([], []), text
    assert pii.redact("ask jane at example dot org or a@b.co") == "ask [email] or [email]"


def test_odd_rows(odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    assert pii.find(none).collect() == []


def test_long_runs_are_linear():
    for t in ("a" * 200000, "1" * 200000, "1." * 100000, "+1 " * 60000, "a@" * 100000, "[at] " * 40000, "one " * 50000):
        pii.spans(t)
    long = "x" * 5000
    assert pii.spans("0" * 5000 + ".1.1.1")[0] == [(0, 5006, "ip")] and pii.spans("9" * 5000 + ".1.1.1")[0] == []
    assert pii.spans(f"{long} (at) host dot org")[1] == [(0, 5018, "email")]
    for t in (" " * 300000 + "(at)", "( " * 100000, "one" + " " * 200000 + "x", "a@b.c (at) " * 20000, "1.2.3.4 dot " * 20000, "а@b.cc " * 20000):
        pii.spans(t)


def slow_added(text):
    """The rules tried at each character, one entry a written character, matches against all known spans: what disguised() must give."""
    words = "|".join(sorted(pii.SPELLED, key=len, reverse=True))
    closed = r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*"
    host = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    digit, dots = rf"(?:{words}|[0-9]+)", rf"(?:{closed}|\s+dot\s+|[.])"
    opened = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I)
    said_at = re.compile(rf"\s+at\s+(?=[\w-]+(?:[.․。．][\w-]+)*(?:\s+dot\s+|{closed})[\w-])", re.I)
    real_at = re.compile(rf"\s+at\s+(?={host})", re.I)
    number = re.compile(rf"{digit}(?:(?:(?:{dots}|[\s-]+){digit}){{4,}}|(?:{dots}{digit}){{3}})(?!\w)", re.I)
    dot, said_dot = re.compile(closed, re.I), re.compile(r"\s+dot\s+(?=[\w-])", re.I)
    cells, i = [], 0  # (character, from, to, by a rule)

    def copy(a, b):
        cells.extend((text[j], j, j + 1, False) for j in range(a, b))

    while i < len(text):
        before = text[i - 1] if i else " "
        after_name = bool(re.match(r"[\w.%+-]", before))
        name = re.search(r"[A-Za-z0-9._%+-]*$", text[:i])[0]
        cued = name.lower() not in pii._NO_NAME and bool(_CUE.search(text[: i - len(name)]))
        named = cued if name.isalpha() else (any(c.isalpha() for c in name) and name[-1] not in ".-")
        if m := opened.match(text, i) or (after_name and said_at.match(text, i)) or (after_name and named and real_at.match(text, i)):
            cells.append(("@", i, m.end(), True))
            i = m.end()
        elif not re.match(r"\w", before) and (m := number.match(text, i)):
            parts = list(re.finditer(rf"(?P<w>{words})|(?P<n>[0-9]+)|(?P<d>{closed}|\s+dot\s+)|(?P<p>[.])", m[0], re.I))
            read = sum(bool(x["w"]) for x in parts) >= 3 or sum(bool(x["d"]) for x in parts) >= 3
            at = i
            for x in parts:
                if not read and (x["w"] or x["n"] or x["p"]):
                    continue
                if not read:
                    copy(at, i + x.start())
                if x["n"] or x["p"]:
                    copy(i + x.start(), i + x.end())
                else:
                    cells.append((pii.SPELLED[x[0].lower()] if x["w"] else ".", i + x.start(), i + x.end(), True))
                at = i + x.end()
            if not read:
                copy(at, m.end())
            i = m.end()
        elif m := dot.match(text, i) or (re.match(r"[\w-]", before) and said_dot.match(text, i)):
            cells.append((".", i, m.end(), True))
            i = m.end()
        elif text[i] in pii._CHARACTERS:
            if pii._CHARACTERS[text[i]]:
                cells.append((pii._CHARACTERS[text[i]], i, i + 1, True))
            i += 1
        else:
            copy(i, i + 1)
            i += 1
    known, out = brute(text), []
    for x, y, kind in brute("".join(c[0] for c in cells)):
        p, q = cells[x][1], cells[y - 1][2]
        if (any(c[3] for c in cells[x:y]) or q - p != y - x) and all(k != kind or d <= p or q <= c or (p <= c and d <= q and d - c < q - p) for c, d, k in known):
            out.append((p, q, kind))
    return out


def test_added_spans_equal_the_slow_way():
    rng = random.Random(9)
    parts = ["jane", "j.doe", "mail ", " at ", " dot ", "(at)", " [dot] ", "example", ".com", "@", ".", " ", "-", "+", "one", " two", " three ", "four", "five", "1", "23", "192", "а", "\u200b", "．", "look", "4111 1111 1111 1111", "1.2.3.4", "a@b.cc", "( at )", "{.}", "é"]
    some = 0
    for _ in range(12000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 16)))
        base, every = pii.spans(t)
        added = [x for x in every if x not in base]
        some += bool(added)
        assert added == sorted(slow_added(t), key=lambda x: (x[0], pii.KINDS.index(x[2]))), t
    assert some > 1000


_CUE = re.compile(r"\b(?:e-?mails?|mails?|mailto|contact|kontakt|correo|courriel|write|reach|address)(?:\s+(?:to|is))?\s*[:<(]?\s*$", re.IGNORECASE)


def test_a_cue_before_any_white_space():
    for gap in (" ", " " * 60, "\n" * 5000, "  to \t :" + " " * 300):
        text = f"mail{gap}user at example.com"
        assert [text[a:b] for a, b, _ in pii.spans(text)[1]] == ["user at example.com"]
    assert pii.spans("gmail user at example.com")[1] == []


def test_plain_at_needs_a_name():
    for text, want in (("mail jane at example.com", "jane at example.com"), ("j.doe at example.com", "j.doe at example.com"), ("E-Mail: bob7 at mail.example.com now", "bob7 at mail.example.com")):
        assert [(text[a:b], k) for a, b, k in pii.spans(text)[1]] == [(want, "email")], text
    for text in ("look at example.com", "mail us at example.com", "the file is at example.com", "it costs 5 at example.com"):
        assert pii.spans(text) == ([], []), text


def test_digits_partly_written():
    text = "ping 192 dot one six eight dot zero dot one or call +1 five five five 12 34567"
    assert [(text[a:b], k) for a, b, k in pii.spans(text)[1]] == [("192 dot one six eight dot zero dot one", "ip"), ("+1 five five five 12 34567", "phone")]


def test_marks_hold_every_rule():
    for text, want, kind in (
        ("server 192 dot 168 dot 0 dot 1 up", "192 dot 168 dot 0 dot 1", "ip"),
        ("mail jane@example dot com", "jane@example dot com", "email"),
        ("mail: jane at mail.example dot com", "jane at mail.example dot com", "email"),
        ("ip one nine two dot one six eight dot zero dot one ok", "one nine two dot one six eight dot zero dot one", "ip"),
        ("ip one dot two dot three dot four ok", "one dot two dot three dot four", "ip"),
    ):
        assert [(text[a:b], k) for a, b, k in pii.spans(text)[1]] == [(want, kind)], text
