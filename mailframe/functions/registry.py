"""Registered media types: a two-column table, by default made from the standard library's list."""

from __future__ import annotations

import mimetypes
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Registered types that the standard library's list of file types lacks; all whose subtypes start with x are among them.
COMPOSITE = (
    "application/atom+xml", "application/calendar+json", "application/cbor", "application/cms", "application/ecmascript", "application/edifact",
    "application/epub+zip", "application/geo+json", "application/gzip", "application/hal+json", "application/http", "application/javascript",
    "application/jose", "application/json-patch+json", "application/jwt", "application/ld+json", "application/mbox", "application/merge-patch+json",
    "application/octet-stream", "application/ogg", "application/pgp-encrypted", "application/pgp-keys", "application/pgp-signature", "application/pkcs10",
    "application/pkcs7-signature", "application/pkcs8", "application/pkix-cert", "application/pkix-crl", "application/problem+json", "application/rdf+xml",
    "application/rtf", "application/sgml", "application/smil+xml", "application/soap+xml", "application/sql", "application/timestamp-reply",
    "application/vcard+json", "application/vnd.ms-fontobject", "application/vnd.oasis.opendocument.presentation", "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.text", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/x-www-form-urlencoded", "application/x400-bp", "application/xacml+xml", "application/xcap-att+xml", "application/xcap-caps+xml",
    "application/xcap-diff+xml", "application/xcap-el+xml", "application/xcap-error+xml", "application/xcap-ns+xml", "application/xcon-conference-info+xml",
    "application/xcon-conference-info-diff+xml", "application/xenc+xml", "application/xfdf", "application/xhtml+xml", "application/xliff+xml",
    "application/xml", "application/xml-dtd", "application/xml-external-parsed-entity", "application/xml-patch+xml", "application/xmpp+xml",
    "application/xop+xml", "application/xslt+xml", "application/xv+xml", "application/yaml", "application/yang", "application/zlib",
    "audio/ac3", "audio/amr", "audio/flac", "audio/l16", "audio/mp4", "audio/ogg", "audio/pcma", "audio/pcmu", "audio/speex", "audio/vorbis",
    "font/collection", "font/otf", "font/sfnt", "font/ttf", "font/woff", "font/woff2",
    "image/apng", "image/cgm", "image/fits", "image/g3fax", "image/jp2", "image/jxl", "image/naplps", "image/t38", "image/vnd.dwg", "image/vnd.djvu",
    "message/delivery-status", "message/disposition-notification", "message/external-body", "message/feedback-report", "message/global",
    "message/global-delivery-status", "message/global-headers", "message/http", "message/news", "message/partial", "message/rfc822", "message/sip", "message/tracking-status",
    "model/gltf+json", "model/gltf-binary", "model/iges", "model/mesh", "model/obj", "model/step", "model/stl", "model/vrml",
    "multipart/alternative", "multipart/appledouble", "multipart/byteranges", "multipart/digest", "multipart/encrypted", "multipart/form-data",
    "multipart/header-set", "multipart/mixed", "multipart/multilingual", "multipart/parallel", "multipart/related", "multipart/report", "multipart/signed", "multipart/voice-message",
    "multipart/x-mixed-replace", "text/calendar", "text/directory", "text/ecmascript", "text/enriched", "text/html", "text/markdown", "text/parameters",
    "text/plain", "text/rfc822-headers", "text/sgml", "text/troff", "text/turtle", "text/uri-list", "text/vcard", "text/xml", "text/xml-external-parsed-entity",
    "video/3gpp", "video/h264", "video/h265", "video/jpeg", "video/mp4", "video/ogg", "video/raw", "video/vc1", "video/vp8", "video/vp9",
)


def entries(more: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(type, subtype) pairs; ``more`` adds "type/subtype" strings, such as those ``read`` gives."""
    known = {*mimetypes.MimeTypes(filenames=()).types_map[True].values(), *COMPOSITE, *more}
    return sorted(tuple(x.split("/", 1)) for x in known if "/x-" not in x and "/" in x)


@lru_cache(8)
def known(more: tuple[str, ...] = ()) -> frozenset[tuple[str, str]]:
    """The pairs in lower case."""
    return frozenset((t.lower(), s.lower()) for t, s in entries(more))


def read(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The types of a full registry's file for ``more``: a line each, what follows the first space aside. The registry's size bounds it."""
    first = F.split(F.trim("value"), r"\s+")[0]
    return tuple(r[0] for r in spark.read.text(path).where(first.rlike(r"^[^/#\s]+/[^/\s]+$")).select(first).distinct().orderBy(first).collect())


def table(spark: SparkSession, more: tuple[str, ...] = ()) -> DataFrame:
    """The registry as (ty, subty): a dimension to join with lower-cased keys."""
    return spark.createDataFrame(entries(more), "ty string, subty string")
