"""Columns against the grammar and fixed vectors, part trees, generators, sources and streams."""

import datetime
import random

import pytest
from mailframe import grammar
from mailframe.functions import codec, ctype, dates, fields, registry, running, words
from mailframe.operators import generate, headers, mime
from mailframe.plans import queries, synth
from mailframe.sources import mail as source
from mailframe.streaming import mail as stream
from pyspark.sql import functions as F

DATES = [
    ("Fri, 21 Nov 1997 09:55:06 -0600", ("Fri", 21, 11, 1997, 9, 55, 6, -6, 0)),
    ("Tue, 1 Jul 2003 10:52:37 +0200", ("Tue", 1, 7, 2003, 10, 52, 37, 2, 0)),
    ("Thu, 13 Feb 1969 23:32:54 -0330", ("Thu", 13, 2, 1969, 23, 32, 54, -3, 30)),
    ("Thu,\r\n 13\r\n   Feb\r\n     1969\r\n 23:32\r\n          -0330 (Newfoundland Time)", ("Thu", 13, 2, 1969, 23, 32, None, -3, 30)),
    ("21 Nov 97 09:55:06 GMT", (None, 21, 11, 97, 9, 55, 6, 0, 0)),
    ("Fri, 21 Nov 1997 09(comment):   55  :  06 -0600", ("Fri", 21, 11, 1997, 9, 55, 6, -6, 0)),
    ("Fri, 21 Nov 1990 00:00:00.1234 -0000", ("Fri", 21, 11, 1990, 0, 0, 0, 0, 0)),
    ("     26 Aug 76 14:29 EDT", (None, 26, 8, 76, 14, 29, None, -4, 0)),
]


def test_dates(spark):
    frame = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(DATES)], "i int, x string").select("i", dates.parse(F.col("x")).alias("d"))
    got = {r.i: r.d for r in frame.collect()}
    for i, (_, want) in enumerate(DATES):
        assert tuple(got[i][c] for c in ("dow", "day", "month", "year", "hour", "minute", "second", "off_h", "off_m")) == want
    none = spark.createDataFrame([("fri, 1 jan 2020 00:00 Z",), ("1 Jan 2020",), (None,)], "x string").select(dates.parse(F.col("x")).alias("d"))
    assert [r.d for r in none.collect()] == [None] * 3


def test_header_of_a_folded_message(spark):
    raw = b"From  : John Doe <jdoe@machine(comment).  example>\r\nTo    : Mary Smith\r\n  \r\n          <mary@example.net>\r\nBcc:\r\nX: caf\xc3\xa9 \r\n\r\nbody\r\n\r\n"
    bad = [b"From: a\r\nnot a field\r\n\r\n", b"From: a\n\n", b""]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([raw, *bad, b"\r\nonly body"])], "i int, raw binary")
    got = {r.i: r for r in headers.with_header(frame).select("i", "header", fields.body(F.col("raw")).alias("body")).collect()}
    assert [(f.name, f.value) for f in got[0].header] == [("From", " John Doe <jdoe@machine(comment).  example>"), ("To", " Mary Smith  <mary@example.net>"), ("Bcc", ""), ("X", " café ")]
    assert got[0].body == b"body\r\n\r\n" and all(raw[f.a : f.b].startswith(f.name.encode()) and raw[f.b - 2 : f.b] == b"\r\n" for f in got[0].header)
    assert [got[i].header for i in (1, 2, 3)] == [None] * 3 and got[4].header == [] and got[4].body == b"only body"


def test_native_and_grammar_agree(spark):
    values = ['text/plain; charset="a\\"b\\n" (c); x=y junk', "a / b", "text/xfoo", "TEXT/HTML;A=1;a=2", "text", "", "multipart/mixed; boundary=\"x y\"", 'a/b; c="unclosed']
    frame = spark.createDataFrame([(v,) for v in values], "v string").select("v", ctype.parse(F.col("v")).alias("c"), fields.strip_comments(F.col("v")).alias("s"))
    for r in frame.collect():
        want = grammar.content_type(r.v)
        assert (r.c and (r.c.ty, r.c.subty.lower(), [(p.key, p.value) for p in r.c.params])) == (want and (want[0], want[1].lower(), want[2])), r.v
        assert r.s == grammar.strip_comments(r.v)
    wires = [b"a=\r\nb  \r\nc=3D=", b"", b"=ZZ", b"x \t\r\n\r\n", "é=C3=A9".encode(), b"=\r\n=\r\n"]
    for raw, got in spark.createDataFrame([(x,) for x in wires], "x binary").select("x", codec.decode_quoted_printable(F.col("x"))).collect():
        assert bytes(got) == grammar.decode_quoted_printable(bytes(raw)), raw
    for raw, got in spark.createDataFrame([("aGk=",), ("aG\r\nk=",), ("aGk",), ("a!",), ("",)], "x string").select("x", codec.decode_base64(F.col("x"))).collect():
        assert (None if got is None else bytes(got)) == {"aGk=": b"hi", "aG\r\nk=": b"hi", "": b""}.get(raw)


def test_long_values_need_no_stack(spark):
    """A megabyte in a comment, a quoted value, escapes, parameters; many parentheses; 100,000 fields."""
    n = 1 << 20
    values = ["a/b (" + "c" * n + "); x=y", 'a/b; x="' + "q" * n + '"', 'a/b; x="' + "\\q" * n + '"', "a/b (" + "\\)" * n + "); x=y", "a/b" + "; p=v" * 50000, "a/b " + "(" * 20000, "a/b " + "(x)" * 20000 + "; x=y"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r for r in frame.select("i", ctype.parse(F.col("v")).alias("c"), dates.parse(F.concat(F.lit("1 Jan 2020 10:00 Z "), F.col("v"))).alias("d")).collect()}
    assert [len(got[i].c.params) for i in range(7)] == [1, 1, 1, 1, 50000, 0, 1] and all(r.d.year == 2020 for r in got.values())
    assert [len(got[i].c.params[0].value) for i in (0, 1, 2, 3)] == [1, n, n, 1]
    raw = "".join(f"X-{i}: {i}\r\n" for i in range(100000)).encode() + b"\r\n"
    h = spark.createDataFrame([(raw,)], "raw binary").select(fields.header(F.col("raw")).alias("h")).select(F.size("h").alias("n"), F.col("h")[99999].alias("last")).first()
    assert h.n == 100000 and h.last.value == " 99999" and h.last.b == len(raw) - 2


def test_comments_of_any_depth(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices(["(", ")", "a", '"', "\\", " "], weights=[4, 4, 3, 1, 1, 1], k=rng.randrange(30))) for _ in range(2000)] + ["(" * 40 + "x" + ")" * 40 + "y"]
    # what is open to the end or closed without a start is no comment to both
    whole = [v for v in values if v.count('"') % 2 == 0 and "\\" not in v and '"' not in v and _balanced(v)]
    got = spark.createDataFrame([(v,) for v in whole], "v string").select("v", fields.strip_comments(F.col("v")).alias("s")).collect()
    assert len(whole) > 100 and all(r.s == grammar.strip_comments(r.v) for r in got)


def _balanced(text):
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def test_folding_equals_the_plain_way(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choices(["a", "bc", " ", "  ", "word", "x" * 30, "é"], weights=[3, 3, 6, 1, 4, 1, 1], k=rng.randrange(120))) for _ in range(2000)] + ["x" * 200 + " y " + "z" * 100, "", " ", "a " * 100000]
    for margin in (78, 20):
        got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", fields.fold(F.col("x"), margin).alias("y")).collect()
        for r in got:
            assert r.y == grammar.fold(r.x, margin), r.x


def test_fields_before_a_fault(spark):
    raws = [b"A: 1\r\nB: 2\r\n\r\nbody", b"A: 1\r\nno field\r\nB: 2\r\n\r\n", b"", b"A: 1\r\n", b"\r\nbody", b"x\r\n"]
    got = [r.d for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw binary").orderBy("i").select(fields.decode(F.col("raw")).alias("d")).collect()]
    assert [([f.name for f in d.fields], d.malformed) for d in got] == [(["A", "B"], None), (["A"], "no field"), ([], ""), (["A"], ""), ([], None), ([], "x")]


def test_registry_file(spark, tmp_path):
    (tmp_path / "types").write_text("# a registry\napplication/made-up  mup\nAudio/XMade\nnot a type\n")
    more = registry.read(spark, str(tmp_path / "types"))
    assert more == ("Audio/XMade", "application/made-up")
    got = spark.createDataFrame([("audio/xmade",), ("application/MADE-UP",), ("audio/xother",)], "v string").select(ctype.parse(F.col("v"), more).alias("c")).collect()
    assert [r.c and (r.c.subty, r.c.subty_tag) for r in got] == [("XMade", "iana"), ("made-up", "iana"), None]


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 3, 5, 10, 97, 1000)]
    got = spark.createDataFrame([(x,) for x in rows], "x array<int>").select("x", running(F.col("x")).alias("y")).collect()
    assert all(r.y == [sum(r.x[:i]) for i in range(len(r.x))] for r in got) and len(got) == len(rows)


def test_encoded_words_without_python(spark):
    frame = spark.createDataFrame([("=?ISO-8859-1?Q?Keld_J=F8rn?=",), ("=?utf-8?b?w6k=?= rest",), ("=?KOI8-R?Q?=D1?=",), ("=?gb2312?b?xOM=?=",), ("plain",)], "x string")
    got = frame.select(words.encoded_word_native(F.col("x")).alias("w")).collect()
    assert [r.w and r.w["data"] for r in got] == ["Keld Jørn", "é", "я", None, None]


def test_typed_fields(spark):
    raw = b"Date: 21 Nov 97 09:55:06 GMT\r\nFrom: A <a@b>\r\nSender: broken <\r\nMessage-ID: <1@x.y>\r\nSubject: =?UTF-8?Q?x?=\r\n\r\n"
    rows = headers.typed(headers.field_rows(spark.createDataFrame([(1, raw)], "mail_id long, raw binary"))).orderBy("ord").collect()
    assert [r.kind for r in rows] == ["Date", "Mailboxes", "Unstructured", "MessageID", "Unstructured"]
    assert rows[0].date.year == 97 and rows[1].addresses[0].mailboxes[0].address == "a@b" and rows[3].message_id.text == "<1@x.y>" and rows[4].value == " =?UTF-8?Q?x?="


def test_golden_multipart(spark):
    """Two parts with boundary foo, byte by byte."""
    part = lambda kind, enc: fields.of_pairs((F.lit("content-transfer-encoding"), F.lit(enc)), (F.lit("content-type"), F.lit(kind)))
    top = fields.of_pairs((F.lit("to"), F.lit("a@b.example")), (F.lit("content-type"), F.lit("multipart/mixed; boundary=foo")))
    none = F.lit(None).cast("string")
    cell = lambda path, kind, head, text, enc: F.struct(F.array(*map(F.lit, path)).cast("array<int>").alias("path"), F.lit(kind).alias("kind"), head.alias("header"), text.alias("text"), enc.alias("encoding"))
    rows = F.array(cell((), "multipart", top, none, none), cell((0,), "leaf", part("text/plain", "quoted-printable"), F.lit("Hello World=!"), F.lit("quoted-printable")), cell((1,), "leaf", part("image/png", "base64"), F.lit("png" * 30), F.lit("base64")))
    made = generate.messages(spark.range(1).select(F.col("id").alias("mail_id"), F.inline(rows))).first().raw
    assert bytes(made).decode() == (
        "To: a@b.example\r\nContent-Type: multipart/mixed; boundary=foo\r\n\r\n--foo\r\nContent-Transfer-Encoding: quoted-printable\r\nContent-Type: text/plain\r\n\r\nHello World=3D!\r\n"
        "--foo\r\nContent-Transfer-Encoding: base64\r\nContent-Type: image/png\r\n\r\n" + "cG5n" * 19 + "\r\n" + "cG5n" * 11 + "\r\n--foo--\r\n"
    )
    assert [n.body for n in grammar.parse(bytes(made)).walk() if n.kind == "leaf"] == [b"Hello World=!", b"png" * 30]


def test_malformed_rows_and_sql_function(spark):
    frame = spark.createDataFrame([(1, b"x\n\n"), (2, None), (3, b"Subject: x\r\n\r\nhello")], "mail_id long, raw binary")
    got = {r.mail_id: r for r in mime.nodes(frame).collect()}
    assert got[1].kind == "malformed" and got[1].error and 2 not in got and bytes(got[3].body) == b"hello"
    mime.register(spark)
    words.register(spark)
    frame.createOrReplaceTempView("mails")
    rows = spark.sql("SELECT mail_id, kind, CAST(body AS STRING) b FROM mails, LATERAL parse_mail(raw) WHERE mail_id = 3").collect()
    assert [tuple(r) for r in rows] == [(3, "leaf", "hello")]
    assert spark.sql("SELECT mail_addresses('a@b, c@d')[1].mailboxes[0].address x").first().x == "c@d"


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.eml").write_bytes(f"Date: {i + 1} Jan 2020 10:00 Z\r\nSubject: {i}\r\n\r\nbody {i}".encode())
    batch = source.read_mails(spark, str(tmp_path / "in"))
    want = sorted(bytes(r.body) for r in mime.nodes(batch).collect())
    assert want == sorted(f"body {i}".encode() for i in range(5))
    mails = source.stream_mails(spark, str(tmp_path / "in"), files_per_trigger=2)
    stream.bodies(mails, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(bytes(r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    q = stream.counts(source.stream_mails(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.date(), r.n) for r in spark.table("counts").collect()) == [(datetime.date(2020, 1, i + 1), 1) for i in range(5)]
    (tmp_path / "box").write_text("From x\nSubject: 1\n\none\n>From here\n\nFrom y\nSubject: 2\n\ntwo\n")
    got = sorted(bytes(r.raw) for r in source.read_mbox(spark, str(tmp_path / "box")).collect())
    assert got == [b"Subject: 1\r\n\r\none\r\nFrom here\r\n", b"Subject: 2\r\n\r\ntwo\r\n"]


def test_header_path_is_native(spark):
    """No Python and one scan of the columns that are used."""
    plan = queries.src6_header_and_body(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("FileScan") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute("set timezone='UTC'")
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())


def test_synthetic_messages_parse(spark):
    assert mime.nodes(synth.mails(spark, "/root/testdata/sf0.001"), keep=("doc_id",)).where("kind <> 'leaf'").count() == 0


def test_quoted_words_are_whole(spark, monkeypatch):
    """A fault after the first 60 characters of a text shows."""
    from pyspark.sql import functions as F

    own = queries.words.make_word
    monkeypatch.setattr(queries.words, "make_word", lambda text, *encoding: own(F.substring(text, 1, 60), *encoding))
    rows = queries.QUERIES["ew1_encoded_words"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.q == "Q lost text" for r in rows)


def test_words_of_empty_texts(spark, tmp_path):
    """Texts that have no word, none and the empty one, beside others, against the query's SQL."""
    import duckdb

    name, texts = "ew1_encoded_words", [None, "", " ", "\n", "x", "=", "?=", "é" * 61, "\U0001f389" * 61, "=?UTF-8?Q??="]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
