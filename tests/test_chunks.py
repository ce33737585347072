"""Messages in chunks: against the whole reader at every cut, large bodies in little memory, pieces against whole messages, resumed headers."""

import base64
import random
import tracemalloc

import pytest
from mailframe import grammar
from mailframe.functions import fields
from mailframe.operators import chunks, generate, mime
from mailframe.streaming import mail
from pyspark.sql import functions as F

from .test_tree import made


def whole_mails(n, seed):
    rng = random.Random(seed)
    out = [b"\r\n", b"A: b\r\n\r\nbody\r\n", b"", b"no field\r\n\r\nx", b"Content-Type: multipart/mixed\r\n\r\n--x\r\n", b"Content-Type: multipart/mixed; boundary=b\r\n\r\nnothing",
           b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--bX\r\n\r\n", b"Content-Type: multipart/mixed; boundary=b\r\n\r\npre --b\r\n\r\none\r\n--b\r\n--b\r\n\r\ntwo"]
    while len(out) < n:
        raw, _ = made(rng, rng.randrange(1, 5), 0)
        out.append(raw if b"\r\n\r\n" in raw else raw + b"\r\n")
    return out


def test_any_cut_gives_the_same_parts():
    rng = random.Random(3)
    for raw in whole_mails(300, 4):
        try:
            want = {tuple(n.path): n.body or b"" for n in grammar.parse(raw, False).walk()}
        except grammar.Malformed:
            want = None
        for step in (1, 2, 5, 40, len(raw) + 1):
            got = {}
            for path, _, _, n, data, _, _ in chunks._Splitter(rng.choice([1, 5, 100])).rows(raw[i : i + step] for i in range(0, len(raw), step)):
                assert n == 0 or data is not None
                got[tuple(path)] = got.get(tuple(path), b"") + (data or b"")
            if want is None:
                want = got
            assert got == want, (step, raw)


@pytest.mark.parametrize("size", (7, 1 << 20))
def test_equals_the_whole_reader(spark, size):
    raws = whole_mails(150, 8)
    mails = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "mail_id int, raw binary")
    cut = spark.createDataFrame([(i, j, bytearray(r[j : j + 11])) for i, r in enumerate(raws) for j in range(0, max(len(r), 1), 11)] + [(1000, 0, None)], "mail_id int, n int, data binary").repartition(5)
    want = {(r.mail_id, tuple(r.path)): (r.kind, r.ty, r.subty, r.has_body, r.error, r.header and [(h.name, h.value) for h in r.header], None if r.body is None else bytes(r.body)) for r in mime.nodes(mails, partial=True).collect()}
    got, bodies, last = {}, {}, {}
    for r in chunks.of_pieces(cut, size=size).orderBy("mail_id", "path", "n").collect():
        k = (r.mail_id, tuple(r.path))
        if r.n == 0:
            got[k] = [r.kind, r.ty, r.subty, r.has_body, r.error, [(h.name, h.value) for h in r.header]]
        got[k][4] = got[k][4] or r.error
        assert r.n == 0 or (last[k][0] == r.n - 1 and not last[k][1])
        last[k] = (r.n, r.last)
        if r.body is not None:
            bodies[k] = bodies.get(k, b"") + bytes(r.body)
    assert all(x for _, x in last.values())
    assert got.pop((1000, ()))[4]
    for k, w in want.items():
        g = tuple(got[k])
        assert (*g, bodies.get(k) if w[6] is not None or not g[4] else None) == (w[0], w[1], w[2], w[3], w[4], w[5] or [], w[6]), raws[k[0]]
    assert set(got) == set(want)


@pytest.mark.parametrize("encoding", ("base64", "quoted-printable", "8bit"))
def test_a_large_body_takes_little_memory(encoding):
    line = {"base64": b"QUJD" * 19 + b"\r\n", "quoted-printable": b"=41bc" * 15 + b"=\r\n", "8bit": b"x--y \r\n--" * 7 + b"\r\n"}[encoding]
    block, n = line * 4000, 60

    def reads():
        yield b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Transfer-Encoding: " + encoding.encode() + b"\r\n\r\n"
        for _ in range(n):
            yield block
        yield b"\r\n--b--"

    tracemalloc.start()
    size = sum(len(r[4]) for r in chunks._Splitter(1 << 17).rows(reads()) if r[4] is not None)
    assert size == n * len(block) and tracemalloc.get_traced_memory()[1] < 20 * (1 << 17) + 6 * len(block)
    tracemalloc.stop()


def test_runs_that_must_not_be_cut_stay_linear():
    for run in (b" " * 3_000_000, b"=" * 3_000_000, b"\t=" * 1_500_000):
        rows = list(chunks._Splitter(1000).rows(iter([b"Content-Transfer-Encoding: quoted-printable\r\n\r\n", *(run[i : i + 50_000] for i in range(0, len(run), 50_000))])))
        assert b"".join(r[4] for r in rows) == run


def test_files_and_a_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = bytes(range(256)) * 20_000
    for i in range(3):
        (tmp_path / "in" / f"{i}.eml").write_bytes(b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.encodebytes(body).replace(b"\n", b"\r\n") + b"--b\r\n\r\n%d\r\n--b--" % i)
    found = chunks.of_files(chunks.listed(spark, str(tmp_path / "in")), size=100_000)
    q = chunks.of_files(chunks.listed(spark, str(tmp_path / "in"), stream=True), size=100_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    for rows in (found.collect(), spark.read.parquet(str(tmp_path / "out")).collect()):
        first = sorted((r for r in rows if list(r.path) == [0]), key=lambda r: (r.file, r.n))
        assert len(first) > 150 and max(len(r.body) for r in first) <= 100_000
        assert b"".join(bytes(r.body) for r in first) == body * 3
        assert sorted(bytes(r.body) for r in rows if list(r.path) == [1]) == [b"0", b"1", b"2"]


def test_a_key_that_clashes_is_refused(spark):
    with pytest.raises(ValueError, match="clashes"):
        chunks.of_pieces(spark.createDataFrame([("a", 0, bytearray(b""))], "path string, n int, data binary"), key="path")


def test_pieces_make_the_same_bytes(spark):
    rng = random.Random(5)
    rows = []
    head = [(0, "X-A", "1", 0, 0)]

    def grow(mail, path, depth):
        kind = rng.choice(["leaf", "multipart", "message"]) if depth else "leaf"
        given = [*head, (1, "Content-Type", 'multipart/mixed; boundary="given %d"' % len(path), 0, 0)] if kind == "multipart" and rng.random() < 0.4 else head
        rows.append((mail, path, kind, given, "text %d\n--x" % rng.randrange(99) if kind == "leaf" else None, rng.choice(["base64", "8bit", None])))
        for i in range({"leaf": 0, "message": 1, "multipart": rng.randrange(1, 12)}[kind]):
            grow(mail, [*path, i], depth - 1)

    for m in range(40):
        grow(m, [], 4)
    parts = spark.createDataFrame(rows, f"mail_id int, path array<int>, kind string, header array<{fields.FIELD}>, text string, encoding string").repartition(4)
    want = {r.mail_id: bytes(r.raw) for r in generate.messages(parts).collect()}
    got = {}
    for r in generate.pieces(parts).orderBy("mail_id", "place").collect():
        got[r.mail_id] = got.get(r.mail_id, b"") + bytes(r.data)
    assert got == want and len(got) == 40


def test_a_message_of_many_parts_is_written_and_read_in_pieces(spark, tmp_path):
    n = 20_000
    leaf = spark.range(n).select(F.lit(1).alias("mail_id"), F.array(F.col("id").cast("int")).alias("path"), F.lit("leaf").alias("kind"), fields.empty().alias("header"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("text"), F.lit("8bit").alias("encoding"))
    root = spark.range(1).select(F.lit(1).alias("mail_id"), F.array().cast("array<int>").alias("path"), F.lit("multipart").alias("kind"), fields.empty().alias("header"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("encoding"))
    generate.write_pieces(generate.pieces(leaf.unionByName(root)), str(tmp_path / "pieces"))
    read = chunks.of_pieces(spark.read.parquet(str(tmp_path / "pieces")), order="place")
    got = read.where("kind = 'leaf'").agg(F.count("*"), F.countDistinct("path"), F.count_if(F.decode("body", "UTF-8") == F.concat(F.lit("part "), F.col("path")[0].cast("string")))).first()
    assert tuple(got) == (n, n, n)


def test_headers_resume_at_any_byte(spark, tmp_path):
    raws = [b"A: 1\r\nB : two\r\n three\r\n\t.\r\nSubject: caf\xc3\xa9\r\n\r\nbody\r\nC: no\r\n\r\n", b"A: 1\r\nno field\r\nB: 2\r\n\r\n", b"\r\nA: 1\r\n", b"A: 1\r\nB: open", b" x: 1\r\nA: 1\r\n\r\n"]
    folder = str(tmp_path / "in")
    rng = random.Random(1)
    # pieces of one byte, out of order and repeated, over several micro-batches
    rows = [(f"{i}/{w}", n, bytearray(r[n * w : n * w + w])) for i, r in enumerate(raws) for w in (1, 3, 100) for n in range(-(-len(r) // w))]
    rng.shuffle(rows)
    schema = "mail_id string, n int, data binary"
    for i in range(3):
        spark.createDataFrame([*rows[i::3], rows[0], (None, 0, None), ("gap", 1, bytearray(b"A: 1\r\n\r\n"))], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = mail.resumed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("mail_id", "ord").collect():
        got.setdefault(r.mail_id, []).append((r.name, r.value, r.a, r.b) if r.malformed is None else r.malformed)
    for i, raw in enumerate(raws):
        d = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(fields.decode(F.col("raw")).alias("d")).first().d
        want = [(f.name, f.value, f.a, f.b) for f in d.fields] + ([d.malformed] if d.malformed else [])
        if i == 3:
            want = want[:1]  # the second field has no end yet
        for w in (1, 3, 100):
            assert got.get(f"{i}/{w}", []) == want, (i, w)
    assert "gap" not in got
