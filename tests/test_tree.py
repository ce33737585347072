"""The part tree by levels against the recursive reader, deep trees, faults, places; linear codecs against byte-wise ones."""

import random
import time

import pytest
from mailframe import grammar
from mailframe.functions import codec
from mailframe.operators import mime
from pyspark.sql import functions as F


def made(rng, depth, n):
    """(bytes of a part, how many parts): leaves in all encodings, multiparts, messages, parts without a body."""
    kind = rng.choice(["leaf", "leaf", "leaf", "none", "multipart", "multipart", "message"]) if depth else "leaf"
    extra = rng.choice([b"", b"X-A: 1\r\n", b"Subject: caf\xc3\xa9\r\n two\r\n", b"x-latin : \xe9\r\n"])
    if kind == "none":
        return extra + b"Content-Type: text/plain\r\n", n + 1
    if kind == "leaf":
        enc = rng.choice([b"7bit", b"base64", b"quoted-printable", b"8bit"])
        body = {b"base64": b"aGVs\r\nbG8=", b"quoted-printable": b"a=C3=A9 \t\r\nb=\r\nc=Zz=", b"7bit": b"line\r\n\r\n--no\r\n", b"8bit": bytes(range(128, 160))}[enc]
        return extra + rng.choice([b"", b"Content-Type: text/html; charset=x (note)\r\n", b"CONTENT-TYPE: application/x-y; a=\"q\\\"r\"; b=c\r\n"]) + b"Content-Transfer-Encoding: " + enc + b"\r\n\r\n" + (body if rng.random() < 0.8 else b""), n + 1
    if kind == "message":
        inner, n = made(rng, depth - 1, n)
        if b"\r\n\r\n" not in inner:
            inner += b"\r\n"
        return extra + b"Content-Type: message/rfc822\r\n\r\n" + inner, n + 1
    mark = b"b%d" % n + rng.choice([b"", b" x", b"(+?)", b"\\E."])
    parts = []
    n += 1
    for _ in range(rng.randrange(1, 4)):
        part, n = made(rng, depth - 1, n)
        parts.append(part)
    out = extra + b'Content-Type: multipart/mixed; boundary="' + mark.replace(b"\\", b"\\\\") + b'!"\r\n\r\n' + rng.choice([b"", b"preamble\r\n"])
    for p in parts:
        out += (b"" if out.endswith(b"\r\n") else b"\r\n") + b"--" + mark + b"!" + rng.choice([b"", b" \t"]) + b"\r\n" + p + b"\r\n"
    return out[:-2] + b"\r\n--" + mark + b"!--" + rng.choice([b"", b"\r\nepilogue"]), n


def shown(rows):
    return sorted((list(r["path"]), r["depth"], r["kind"], r["ty"], r["subty"], [(p["key"], p["value"]) for p in r["params"] or []], r["encoding"], [tuple(h[k] for k in ("ord", "name", "value", "a", "b")) for h in r["header"] or []], bytes(r["body"]) if r["body"] is not None else None, r["has_body"], r["error"] and r["error"][:10]) for r in rows)


@pytest.mark.parametrize("transfer", (True, False))
def test_equals_the_recursive_reader(spark, transfer):
    rng = random.Random(9)
    raws = [b"\r\n", b"A: b\r\n", b"", b"no field\r\n\r\n", b"A: b\r\n\r\nbody\r\n", b"Content-Type: multipart/mixed\r\n\r\n--x\r\n", b"Content-Transfer-Encoding: base64\r\n\r\n!", b"Content-Type: multipart/mixed; boundary=b\r\n\r\nnothing", b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--bX\r\n\r\n"]
    while len(raws) < 150:
        raw, _ = made(rng, rng.randrange(1, 5), 0)
        raws.append(raw if b"\r\n\r\n" in raw else raw + b"\r\n")
    frame = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)] + [(999, None)], "mail_id int, raw binary").repartition(3)
    got = {}
    for r in mime.nodes(frame, transfer=transfer).collect():
        got.setdefault(r.mail_id, []).append(r)
    assert set(got) == set(range(len(raws)))
    for i, raw in enumerate(raws):
        assert shown(got[i]) == shown(mime.rows_of(raw, transfer)), raw


def test_eighty_levels_and_no_python(spark):
    raw = b"Subject: deepest\r\n\r\nleaf"
    for i in range(80):
        raw = b"Content-Type: multipart/mixed; boundary=%dz\r\n\r\n--%dz\r\n" % (i, i) + raw + b"\r\n--%dz--" % i
    nodes = mime.nodes(spark.createDataFrame([(1, bytearray(raw))], "mail_id int, raw binary"))
    rows = nodes.collect()
    assert len(rows) == 81 and max(r.depth for r in rows) == 80 and [bytes(r.body) for r in rows if r.has_body] == [b"leaf"]
    assert not any(x in nodes._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Exchange"))


def test_outer_boundaries_end_inner_parts(spark):
    """A part ends at the first boundary line of any multipart around it; what follows stays with its own parent."""
    raw = b'Content-Type: multipart/mixed; boundary=out\r\n\r\n--out\r\nContent-Type: multipart/mixed; boundary=in\r\n\r\n--in\r\n\r\nnot closed\r\n--out\r\n\r\nsecond\r\n--out--'
    rows = mime.nodes(spark.createDataFrame([(1, bytearray(raw))], "mail_id int, raw binary")).collect()
    assert sorted((list(r.path), r.kind, r.body and bytes(r.body)) for r in rows) == [([], "multipart", None), ([0], "multipart", None), ([0, 0], "leaf", b"not closed"), ([1], "leaf", b"second")]


def test_partial_keeps_what_was_read(spark):
    raw = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Transfer-Encoding: base64\r\n\r\n!!\r\n--b\r\n\r\ngood\r\n--b\r\nno field\r\n\r\nx\r\n--b--"
    frame = spark.createDataFrame([(1, bytearray(raw))], "mail_id int, raw binary")
    assert [(r.kind, r.error) for r in mime.nodes(frame).collect()] == [("malformed", "expected an empty line after the header")]
    rows = {tuple(r.path): r for r in mime.nodes(frame, partial=True).collect()}
    assert bytes(rows[1,].body) == b"good" and rows[0,].error == "not base64" and rows[2,].error and rows[()].error is None


def test_many_parts_and_columns_of_any_name(spark):
    raw = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n" + b"".join(b"--b\r\n\r\n%d\r\n" % i for i in range(3000)) + b"--b--"
    frame = spark.createDataFrame([(1, bytearray(raw), "x", "y")], "mail_id int, raw binary, text string, body2 string")
    began = time.perf_counter()
    rows = mime.nodes(frame, keep=("mail_id", "body2")).collect()
    assert len(rows) == 3001 and {bytes(r.body) for r in rows if r.has_body} == {b"%d" % i for i in range(3000)} and time.perf_counter() - began < 30


def test_quoted_printable_equals_bytes(spark):
    rng = random.Random(3)
    pieces = [b"=", b"=\r\n", b"= \t\r\n", b" ", b"\t", b"\r\n", b"\r", b"\n", b"=C3=A9", b"=c3", b"=Z", b"a", b"\xff", b"==", b" \r\n"]
    raws = [b"".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(400)] + [b""]
    frame = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    got = {r.i: bytes(r.x) for r in frame.select("i", codec.decode_quoted_printable(F.col("raw")).alias("x")).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == grammar.decode_quoted_printable(raw), raw


@pytest.mark.parametrize("piece", (" ", "\t ", "=", "=\r\n", " \r\n", "=C3", "\r\n"))
def test_quoted_printable_is_linear(spark, piece):
    text = F.repeat(F.lit(piece), (4 << 20) // len(piece))
    began = time.perf_counter()
    assert spark.range(1).select(F.length(codec.decode_quoted_printable(F.concat(text, F.lit("x")).cast("binary")))).first()[0] > 0
    assert time.perf_counter() - began < 20


def test_q_words_of_any_text(spark):
    texts = ["", "a b_c.d*e-f+g%h", "été 𝒳", "=?=?", "~!'()", "\t\r\n\x00", "x" * 5000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in frame.select("i", codec.encode_q(F.col("t")).alias("q"), F.decode(codec.decode_q(codec.encode_q(F.col("t"))), "UTF-8").alias("back")).collect():
        want = "".join(chr(b) if chr(b).isascii() and chr(b).isalnum() else "_" if b == 32 else f"={b:02X}" for b in texts[r.i].encode())
        assert (r.q, r.back) == (want, texts[r.i])
    bad = spark.range(1).select(codec.encode_q(F.unhex(F.lit("C3")).cast("string"))).first()[0]
    assert bad == "=C3"
