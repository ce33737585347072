"""Messages from files and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mails(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(mail_id, path, raw): one row a file below a folder, a whole message each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("mail_id"), "path", F.col("content").alias("raw"))


def stream_mails(spark: SparkSession, path: str, pattern: str = "*.eml", files_per_trigger: int = 1000) -> DataFrame:
    """The same for files as they come."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("mail_id"), "path", F.col("content").alias("raw"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(mail_id, path, raw) of mbox files: messages start at lines "From "; line ends become CRLF."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r?\n", "\r\n")
    each = files.select("path", F.posexplode(F.split(text, r"(?m)^From [^\r\n]*\r\n", -1)).alias("ord", "part")).where("ord > 0")
    whole = F.regexp_replace(F.regexp_replace("part", r"\r\n\r\n$", "\r\n"), r"(?m)^>(>*From )", "$1")
    return each.select(F.xxhash64("path", "ord").alias("mail_id"), "path", F.encode(whole, "ISO-8859-1").alias("raw"))


def write_mails(mails: DataFrame, path: str, raw_col: str = "raw") -> None:
    """One Parquet row a message; the bytes are as they are."""
    mails.write.mode("errorifexists").parquet(path)
