"""Streams of messages: parsing has no state, so that it is the batch code on a streaming frame.

``bodies`` is the sink for leaf bodies: each micro-batch writes its leaves once, under the batch's number, so that a
repeated batch overwrites its own files. ``counts`` shows event time: windows over the Date field with a watermark.
``resumed`` has state: headers that come in pieces, over any number of micro-batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import dates, fields
from ..operators import mime

_FIELD_END = re.compile(rb"\r\n(?![ \t])")
_IS_FIELD = re.compile(rb"[\x21-\x39\x3B-\x7E]+[ \t]*:")


def nodes(mails: DataFrame, keep: tuple[str, ...] = ("mail_id",)) -> DataFrame:
    return mime.nodes(mails, keep=keep)


def bodies(mails: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...] = ("mail_id",)) -> DataStreamWriter:
    """A writer of (keep, path, body) of each leaf; start it with a trigger of choice."""

    def write(batch: DataFrame, number: int) -> None:
        mime.nodes(batch, keep=keep).where("kind = 'leaf' AND has_body").select(*keep, "path", "ty", "subty", "body").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mails.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def counts(mails: DataFrame, window: str = "1 day", late: str = "7 days", raw_col: str = "raw") -> DataFrame:
    """Messages by window of their Date field; messages without a date are left out, late ones are dropped after the watermark."""
    sent = F.timestamp_seconds(dates.epoch(dates.parse(fields.first(fields.header(F.col(raw_col)), "date"))))
    dated = mails.select(sent.alias("sent")).where("sent IS NOT NULL").withWatermark("sent", late)
    return dated.groupBy(F.window("sent", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def resumed(pieces: DataFrame, key: str = "mail_id", order: str = "n", data: str = "data") -> DataFrame:
    """(key, ord, name, value, a, b, malformed): the fields of a stream of pieces of headers, each as soon as it is whole.

    ``order`` counts a key's pieces from 0; those that come early wait in the state, repeated ones are ignored. The state is the
    bytes of a field without its end, and nothing once the empty line was met. A line that is no field ends a header: one row with
    the line in ``malformed`` and no name. Null pieces are empty, rows with a null key or order are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = pieces.schema[key].dataType.simpleString()
    state = "tail binary, next bigint, ord int, at bigint, done boolean, early array<struct<n:bigint,data:binary>>"

    def cut(k: tuple, frames: Iterator, s: GroupState) -> Iterator:
        import pandas as pd

        tail, at_piece, ord_, at, done, early = s.get if s.exists else (b"", 0, 0, 0, False, [])
        waiting = {n: bytes(d) for n, d in early}
        for f in frames:
            if not done:
                waiting |= {int(n): bytes(d) for n, d in zip(f["n"], f["data"], strict=True) if n >= at_piece}
        out, tail = [], bytes(tail)
        joined = [tail]
        while at_piece in waiting:
            joined.append(waiting.pop(at_piece))
            at_piece += 1
        tail = b"".join(joined)
        while not done:
            # whether a line goes on shows in the byte behind its end; an empty line shows at once
            m = _FIELD_END.search(tail)
            if tail.startswith(b"\r\n"):
                done = True
            elif not m or m.end() == len(tail):
                break
            else:
                line, tail, good = tail[: m.end()], tail[m.end() :], bool(_IS_FIELD.match(tail))
                out.append((*k, ord_, line, at, good))
                ord_, at, done = ord_ + 1, at + len(line), not good
        if done:
            tail, waiting = b"", {}
        s.update((tail, at_piece, ord_, at, done, sorted(waiting.items())))
        yield pd.DataFrame(out, columns=[key, "ord", "line", "a", "good"])

    rows = pieces.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key), F.col(order).cast("bigint").alias("n"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    found = rows.groupBy(key).applyInPandasWithState(cut, f"`{key}` {kind}, ord int, line binary, a bigint, good boolean", state, "append", GroupStateTimeout.NoTimeout)
    field = fields.decode(F.concat("line", F.lit(b"\r\n")))["fields"][0]
    read = found.withColumn("f", F.when(F.col("good"), field))
    line = F.decode("line", "ISO-8859-1")
    return read.select(key, "ord", "f.name", "f.value", "a", (F.col("a") + F.length("line")).alias("b"), F.when(~F.col("good"), F.substr(line, F.lit(1), F.length("line") - 2)).alias("malformed"))
