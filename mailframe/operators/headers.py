"""Header tables: one row a field, with typed columns beside the text, without touching bodies.

All of it is built-in expressions, so that a filter on names or a choice of columns prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ctype, dates, fields, words


def with_header(mails: DataFrame, raw_col: str = "raw") -> DataFrame:
    """mails with a column ``header``; null for malformed messages."""
    return mails.withColumn("header", fields.header(F.col(raw_col)))


def field_rows(mails: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ("mail_id",), schema: dict[str, str] | None = None) -> DataFrame:
    """(keep, ord, name, name_lc, kind, value, a, b): a row a field, in order."""
    # the outer form, since Spark infers a filter for the other one and so splits a header three times
    rows = mails.select(*keep, F.explode_outer(fields.header(F.col(raw_col))).alias("_f")).where("_f IS NOT NULL").select(*keep, "_f.*")
    return rows.withColumns({"name_lc": F.lower("name"), "kind": fields.kind(F.col("name"), schema)})


def first_message_id(mails: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ("mail_id",)) -> DataFrame:
    """(keep, message_id): the first Message-ID of each message that parses, or null."""
    values = F.transform(fields.assoc(fields.header(F.col(raw_col)), "message-id"), lambda f: f["value"])
    return mails.select(*keep, words.first_message_id(values).alias("message_id"))


def typed(rows: DataFrame) -> DataFrame:
    """Field rows with a column for each kind of value, null where the kind is another or the value doesn't parse.

    ``kind`` becomes Unstructured where the value doesn't parse; the text stays in ``value`` in any case.
    """
    value = F.col("value")
    of = lambda *kinds: F.when(F.col("kind").isin(*kinds), value)
    out = rows.withColumns({
        "date": dates.parse(of("Date")), "content": ctype.parse(of("Content")), "encoding": ctype.encoding(of("Encoding")),
        "addresses": words.addresses(of("Mailboxes", "Mailbox", "Addresses")), "message_id": words.message_id(of("MessageID")),
    })
    failed = F.col("kind").isin("Date", "Content", "Encoding", "Mailboxes", "Mailbox", "Addresses", "MessageID") & F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in ("date", "content", "encoding", "addresses", "message_id"))).isNull()
    return out.withColumn("kind", F.when(failed, "Unstructured").otherwise(F.col("kind")))
