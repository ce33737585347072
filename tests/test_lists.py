"""Addresses, ids, comments and charsets in built-in expressions against the plain grammar."""

import codecs
import random
import time

import pytest
from mailframe import grammar as g
from mailframe.functions import charsets, fields, words
from mailframe.plans import queries
from pyspark.sql import functions as F

from .test_grammar import ADDRESSES, IDS

OWN = [
    "a@b.", "a.@b", "a@b c@d", "x: a@b,,c@d,;,e@f", "<,,a@b>", "<@a,@b.c,,@[d]:e@f>", "x:;", "x: y: a@b;;", '"" <a@b>', 'a (x (y) "z) b@c', ".a <b@c>",
    "a@[1.2.3.4], b@[IPv6:::1], c@[x:y], d@[ z ]", '"q\\"x\\\\"@b.c, N. M. <x@y>', "a\r\n\t@ b (c) . d", "=?x-none?q?a?= <a@b>", "=?koi8-r?q?=D1?= =?utf-8?b?w6k=?= <a@b>", "(" * 50 + ")" * 50 + "a@b",
]
PIECES = ["a", "b.c", '"q r"', '"\\""', "<", ">", "@", ",", ";", ":", ".", "[1.2.3.4]", "[x]", " ", "(c)", "(n(e)\\))", '"', "(", "\\", "é", "=?utf-8?q?=C3=A9?=", "a@b", "<a@b>", "G:", "a@b,"]


def test_lists_equal_the_grammar(spark):
    rng = random.Random(5)
    values = [v for v, _ in ADDRESSES] + [v for v, _, _ in IDS] + OWN + ["".join(rng.choices(PIECES, k=rng.randrange(1, 14))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(values)) + [(99999, None)], "i int, v string").repartition(4)
    v = F.col("v")
    rows = frame.select(
        "i", words.addresses(v).alias("a"), words.mailboxes(v).alias("m"), words.mailbox(v, True).alias("w"), words.message_id(v).alias("id"), words.render_addresses(v).alias("r"), fields.strip_comments(v).alias("c")
    )
    assert not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))
    shown = lambda x: [y.asDict(True) for y in x] if x is not None else None
    for r in rows.collect():
        if r.i == 99999:
            assert r.a is None and r.m is None and r.id is None and r.c is None
            continue
        t = values[r.i]
        m = g.mailbox(t, True)
        assert (shown(r.a), shown(r.m), shown(r.w), r.id and r.id.asDict(True)) == (g.addresses(t), g.mailboxes(t), [m] if m else [], g.message_id(t)), t
        assert (r.r, r.c) == (", ".join(map(g.render_address, g.addresses(t) or [])), g.strip_comments(t)), t


@pytest.mark.parametrize("value", ("(" * 1000 + ")" * 1000 + "x", "(" * 200000, '("' * 50000 + "x", "\\(" * 100000 + "(y)"))
def test_comments_of_any_depth(spark, value):
    began = time.perf_counter()
    got = spark.createDataFrame([(value,)], "v string").select(fields.strip_comments(F.col("v"))).first()[0]
    assert got == g.strip_comments(value) and time.perf_counter() - began < 20


def test_charsets_equal_the_codecs(spark):
    """Every byte in every charset with a table, under an alias of each; names that no table has are unknown."""
    raws = [bytes([i]) for i in range(256)] + [bytes(range(128)), bytes(range(192, 256)), "é".encode(), b"\xff\xfe"]
    for codec in ("utf-8", "US-ASCII", "latin1", "ISO-8859-2", "iso_8859-15", "KOI8-R", "koi8-u", "windows-1252", "Windows-1251", "CP866", "macintosh", "TIS-620", "iso-8859-8"):
        frame = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, r binary")
        for r in frame.select("i", charsets.decode(F.col("r"), F.lit(codec)).alias("t")).collect():
            try:
                want = raws[r.i].decode(codec)
            except UnicodeDecodeError:
                want = None
            assert r.t == want, (codec, raws[r.i])
    names = ["utf8", "UTF-8", "iso-8859-1", "koi8-r", "cp1250", "gb2312", "shift_jis", "none", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(charsets.known(F.col("n"))).collect()
    assert [r[0] for r in got] == [True] * 5 + [False] * 4
    assert all(codecs.lookup(n) for n in charsets.TABLES)


def test_rare_charsets_go_through_python(spark):
    word = "=?gb2312?b?" + __import__("base64").b64encode("你好".encode("gb2312")).decode() + "?="
    frame = spark.createDataFrame([(word,), ("=?utf-8?q?=C3=A9?= x",), (None,)], "v string")
    got = frame.select(words.decode_words(F.col("v")).alias("d"), words.decode_words_native(F.col("v")).alias("n"), words.encoded_word(F.col("v"))["data"].alias("w"), words.encoded_word_native(F.col("v"))["error"].alias("e")).collect()
    assert [tuple(r) for r in got] == [("你好", word, "你好", "unknown charset GB2312"), ("é x", "é x", "é", None), (None, None, None, None)]
    named = frame.select(words.addresses(F.concat("v", F.lit(" <a@b>")), rare=True)[0]["mailboxes"][0]["name"]).collect()
    assert [r[0] for r in named] == ["你好", "é x", None]


@pytest.mark.parametrize("name", ("src1_mail_tree", "src2_stream_leaves", "src10_multipart_edges", "ad1_mailbox", "ad2_address_list", "ad13_groups", "id1_message_id", "hdr12_message_id", "ew4_charsets", "ue1_unstructured_with_encoded", "un5_comments"))
def test_no_python_in_the_plans(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "InPandas"))
