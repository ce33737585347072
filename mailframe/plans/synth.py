"""Messages made from the tables: the input of the registered queries, since no table holds e-mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, dates, fields
from ..operators import generate

ZONES = ("GMT", "+0000", "-0500", "EST", "+0530", "Z", "PDT")
ENCODINGS = ("base64", "quoted-printable", "8bit")
START = 1577836800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], key: str) -> Column:
    """One of the values, in turn by a key column."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with what a message of each has: sender, date, id and the name of a transfer encoding."""
    docs = table(spark, sf_dir, "documents")
    sent = F.lit(START) + F.col("doc_id") * 61
    return docs.withColumns({
        "sender": F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("@"), F.col("source"), F.lit(".example.org")),
        "subject": F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" in "), F.col("lang")),
        "sent": sent, "date": dates.render(dates.of_epoch(sent, pick(ZONES, "doc_id"))),
        "msgid": F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("."), F.col("n_chars").cast("string"), F.lit("@"), F.col("source"), F.lit(".example.org>")),
        "encoding": pick(ENCODINGS, "doc_id"),
    })


def header(extra: tuple[tuple[str, Column], ...] = ()) -> Column:
    lit = F.lit
    return fields.of_pairs(
        (lit("from"), F.concat(lit('"Writer '), F.col("doc_id").cast("string"), lit('" <'), F.col("sender"), lit(">"))),
        (lit("to"), F.concat(lit("Reader <reader@"), F.col("lang"), lit(".example.net>, List: a@b.example, "), F.col("sender"), lit(";"))),
        (lit("subject"), F.col("subject")), (lit("date"), F.col("date")), (lit("message-ID"), F.col("msgid")), *((lit(n), v) for n, v in extra),
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw, text, ...): a message with one body for each document, in one of three transfer encodings."""
    docs = documents(spark, sf_dir)
    head = header((("content-type", F.lit("text/plain; charset=utf-8")), ("content-transfer-encoding", F.col("encoding"))))
    return docs.withColumn("raw", generate.message(head, codec.encode_body(F.col("text"), F.col("encoding"))))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mail_id, raw) of ``parts``."""
    return generate.messages(parts(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a message of each document: mixed [text in an encoding, alternative [language, source]]."""
    docs = documents(spark, sf_dir)
    typed = lambda ty, enc: fields.of_pairs((F.lit("content-type"), ty), (F.lit("content-transfer-encoding"), enc))
    node = lambda path, kind, head, text, enc: F.struct(F.array(*map(F.lit, path)).cast("array<int>").alias("path"), F.lit(kind).alias("kind"), head.alias("header"), text.alias("text"), enc.alias("encoding"))
    none = F.lit(None).cast("string")
    rows = F.array(
        node((), "multipart", header(), none, none),
        node((0,), "leaf", typed(F.lit("text/plain; charset=utf-8"), F.col("encoding")), F.col("text"), F.col("encoding")),
        node((1,), "multipart", fields.of_pairs((F.lit("content-type"), F.lit("multipart/alternative"))), none, none),
        node((1, 0), "leaf", typed(F.lit("text/plain"), F.lit("7bit")), F.col("lang"), F.lit("7bit")),
        node((1, 1), "leaf", typed(F.lit("text/html"), F.lit("base64")), F.col("source"), F.lit("base64")),
    )
    return docs.select(F.col("doc_id").alias("mail_id"), F.inline(rows))
