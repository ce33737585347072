"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: log likelihoods of hashed byte trigrams of the whole text, in lower case with digits and marks as
  spaces. They are tempered to ``EFFECTIVE`` trigrams, since neighbouring trigrams aren't independent.
* Declared markup language: right with a rate that is estimated by aggregation over all rows, as the share of
  rows whose text alone says the same.
* Address suffix: one level of the priors below; a suffix of a country (``COUNTRY``) counts as a weak declaration.
* Host priors: expected counts of languages from texts alone, by grouped aggregation for host, domain, suffix and
  all rows. Each level's prior is smoothed towards the level above with ``SMOOTHING`` rows' weight.

A further class, ``und``, gives every trigram the same probability. It wins where the text is like none of the
languages. A row is accepted if its best class is a language with a posterior of at least ``LEAST``.

The text model is fitted on at most ``sample`` distinct labelled texts of each label, those with the least hashes, so that every
label of the table is a class, however rare it is and however often other texts are repeated; nothing else is sampled.
Without labelled rows every text is ``und``.

Texts that are null, empty or without letters are ``und`` and not accepted. A null or unknown declaration says
nothing. A null host uses the suffix's prior, then that of all rows. Repeated rows and ids stay. Empty tables give no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import let
from .common import left_join, stash

SAMPLE, BINS, EFFECTIVE, SMOOTHING, LEAST = 1500, 1 << 16, 300, 20.0, 0.5
UND = "und"
# Suffixes of countries and the language they hint at.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt"}

_SPACES = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def _bins(text: str | None) -> np.ndarray:
    """A bin for each byte trigram of the text that isn't all space."""
    cleaned = b" ".join((text or "").lower().encode().translate(_SPACES).split())
    if not cleaned:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + cleaned + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Log probabilities of the bins for each language; the last column is ``und``'s."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def fit(cls, labelled: Iterable[tuple[str, str]], smoothing: float = 0.5) -> Model:
        by: dict[str, np.ndarray] = {}
        for language, text in labelled:
            if language not in by:
                by[language] = np.full(BINS, smoothing)
            np.add.at(by[language], _bins(text), 1)
        languages = sorted(by)
        columns = [np.log(by[x] / by[x].sum()) for x in languages]
        return cls(languages, np.stack([*columns, np.full(BINS, -np.log(BINS))], axis=1).astype(np.float32))

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UND]

    def scores(self, text: str | None) -> np.ndarray | None:
        """Tempered log likelihoods; None without letters."""
        bins = _bins(text)
        if not len(bins):
            return None
        if len(bins) > BINS // 8:
            sums = np.bincount(bins, minlength=BINS) @ self.table
        else:
            sums = self.table[bins].sum(axis=0, dtype=np.float64)
        return sums * min(1.0, EFFECTIVE / len(bins))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the ``sample`` distinct labelled texts with the least hashes of each label; the driver sees no others, and one at a time."""
    own = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.xxhash64(label_col, text_col).alias("h"))
    seen = stash(own.select("label", "h").distinct(), "labels")
    # over twice the sample's share of the range of the label's own distinct hashes holds it, however many rows and copies there are
    share = F.lit(2.0 * sample + 64) / F.count("*")
    last = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    near = seen.join(F.broadcast(seen.groupBy("label").agg(last.alias("last"))), "label").where("h <= last").select("label", "h")
    # written, so that Spark knows that it is small before it moves a text
    least = stash(near.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("i") <= sample).select("label", "h"), "least")
    rows = own.join(least, ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("label", "text")
    return Model.fit((r.label, r.text) for r in rows.toLocalIterator())


def scored(df: DataFrame, model: Model, text_col: str, name: str = "_ll") -> DataFrame:
    """df with the tempered log likelihoods of the classes, null without letters."""
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields), T.StructField(name, T.ArrayType(T.DoubleType()))])
    at, spark = df.columns.index(text_col), df.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.scores(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else x.tolist() for x in got], pa.list_(pa.float64()))], names=[f.name for f in out.fields])

    return df.mapInArrow(each, out)


def _softmax(logs: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda t: F.transform(e, lambda x: x / t))

    return let(logs, lambda ll: let(F.array_max(ll), lambda m: let(F.transform(ll, lambda x: F.exp(x - m)), shares)))


def _levels(host: Column) -> tuple[Column, Column, Column]:
    """host, domain and suffix of a host name, in lower case; a name without dots is its own domain and has no suffix."""
    host = F.lower(host)
    parts = F.split(host, r"\.")
    return host, F.when(host.isNull() | (F.size(parts) < 2), host).otherwise(F.concat_ws(".", F.slice(parts, -2, 2))), F.when(F.size(parts) >= 2, F.element_at(parts, -1))


@dataclass
class Fusion:
    """What all rows say: the rate of right declarations, the prior of all rows, and each host's and suffix's prior."""

    rate: float
    overall: list[float]
    hosts: DataFrame
    suffixes: DataFrame


def gather(slim: DataFrame, model: Model) -> Fusion:
    """From a written table (_ll, declared, host) of all rows: priors by grouped aggregation, level by level."""
    k = len(model.classes)
    host, domain, suffix = _levels(F.col("host"))
    soft = slim.where("_ll IS NOT NULL").select(_softmax(F.col("_ll")).alias("p"), F.col("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)]
    counts = stash(soft.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    classes = F.array(*map(F.lit, model.classes))
    best = F.element_at(classes, F.array_position("p", F.array_max("p")).cast("int"))
    seen, right = soft.where(F.col("declared").isin(model.languages)).agg(F.count("*"), F.count_if(best == F.col("declared"))).first()
    rate = min((right + 9.0) / (seen + 10.0), 0.999)
    total = counts.agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0.0)) for i in range(k))).first()
    overall = [(total[i] + 1.0) / (sum(total) + k) for i in range(k)]

    def level(by: str, above: DataFrame | None, link: str | None) -> DataFrame:
        own = counts.where(F.col(by).isNotNull()).groupBy(by, *([link] if link else [])).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)))
        own = own.withColumn("n", sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0)))
        base = F.array(*map(F.lit, overall))
        if above is not None:
            own, base = own.join(above.withColumnRenamed("prior", "up"), link, "left"), F.coalesce("up", base)
        return own.select(by, *([link] if link else []), F.array(*((F.col(f"c{i}") + SMOOTHING * base[i]) / (F.col("n") + SMOOTHING) for i in range(k))).alias("prior"))

    suffixes = stash(level("suffix", None, None), "suffixes")
    domains = level("domain", suffixes, "suffix").select("domain", "prior")
    hosts = stash(level("host", domains, "domain").select("host", "prior"), "priors")
    return Fusion(rate, overall, hosts, suffixes)


def with_priors(df: DataFrame, found: Fusion, host: Column) -> DataFrame:
    """df with what the priors of its host and suffix are; the rows of a hot host stay where they are."""
    name, _, suffix = _levels(host)
    df = df.withColumns({"_host": name, "_suffix": suffix})
    df = left_join(df, found.hosts.select(F.col("host").alias("_host"), F.col("prior").alias("_prior")), ["_host"])
    return left_join(df, found.suffixes.select(F.col("suffix").alias("_suffix"), F.col("prior").alias("_above")), ["_suffix"])


def fused(df: DataFrame, model: Model, found: Fusion, declared: Column) -> DataFrame:
    """df (with _ll and the columns of ``with_priors``) with columns _lang, _posterior and _accepted."""
    k = len(model.classes)
    prior = F.coalesce("_prior", "_above", F.array(*map(F.lit, found.overall)))
    primary = F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1))
    hint = F.coalesce(*(F.when(F.col("_suffix") == s, F.lit(v)) for s, v in COUNTRY.items())) if COUNTRY else F.lit(None)

    def says(value: Column, rate: float, language: str) -> Column:
        """Log likelihood of a declaration; one that is null or names none of the languages says nothing."""
        other = (1 - rate) / max(1, k - 1)
        if language == UND:
            return F.when(value.isin(model.languages), F.lit(float(np.log(1 / k)))).otherwise(0.0)
        return F.when(value == language, F.lit(float(np.log(rate)))).when(value.isin(model.languages), F.lit(float(np.log(other)))).otherwise(0.0)

    logs = F.array(*(F.col("_ll")[i] + F.log(prior[i]) + says(primary, found.rate, c) + says(hint, 0.6, c) for i, c in enumerate(model.classes)))
    df = df.withColumn("_p", F.when(F.col("_ll").isNotNull(), _softmax(logs)))
    best = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("_p", F.array_max("_p")).cast("int"))
    df = df.withColumns({"_lang": F.coalesce(best, F.lit(UND)), "_posterior": F.coalesce(F.array_max("_p"), F.lit(1.0))})
    return df.withColumn("_accepted", (F.col("_lang") != UND) & (F.col("_posterior") >= LEAST)).drop("_p", "_prior", "_above", "_host", "_suffix")


def identify(df: DataFrame, model: Model, keys: list[str], text_col: str = "text", declared_col: str = "declared", host_col: str = "host") -> DataFrame:
    """A row for each of df's: its keys, lang, posterior, accepted, text_lang (by the text alone)."""
    slim = scored(df.select(F.struct(*keys).alias("_keys"), F.col(text_col).cast("string").alias("_text"), F.col(declared_col).cast("string").alias("declared"), F.col(host_col).cast("string").alias("host")), model, "_text").drop("_text")
    slim = stash(slim, "likelihoods")
    alone = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("_ll", F.array_max("_ll")).cast("int"))
    found = gather(slim.select("_ll", "declared", "host"), model)
    out = fused(with_priors(slim.withColumn("_alone", F.coalesce(alone, F.lit(UND))), found, F.col("host")), model, found, F.col("declared"))
    return out.select("_keys.*", F.col("_lang").alias("lang"), F.round("_posterior", 6).alias("posterior"), F.col("_accepted").alias("accepted"), F.col("_alone").alias("text_lang"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", declared_col: str | None = None, host_col: str = "source") -> DataFrame:
    """The documents whose language is known, with all their columns as they are, whatever their names: a row is carried as one value.

    A column of labels that the model was fitted on is no declaration. Texts are scored twice, once for the counts of all rows and once to decide, so that they need not be written.
    """
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    slim = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"), declared.cast("string").alias("declared"), F.col(host_col).cast("string").alias("host"))
    found = gather(stash(scored(slim.drop("_row"), model, "_text").drop("_text"), "likelihoods"), model)
    return fused(scored(with_priors(slim, found, F.col("host")), model, "_text"), model, found, F.col("declared")).where("_accepted").select("_row.*")


_OPENED = re.compile(r"<(?:!--|(script|style)\b)", re.IGNORECASE | re.ASCII)
_CLOSED = {x: re.compile(rf"</{x}\s*+>", re.IGNORECASE | re.ASCII) for x in ("script", "style")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.IGNORECASE | re.ASCII)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]+)", re.IGNORECASE | re.ASCII)


def visible(html: str) -> str:
    """A page's text: scripts, styles, comments and tags are a space each; one that nothing closes is text.

    Each search starts where the last one ended, and one that found nothing isn't tried again, so that a page takes linear time.
    """
    out, at, gone = [], 0, set()
    while m := _OPENED.search(html, at):
        kind = (m[1] or "").lower()
        end = -1
        if kind not in gone:
            if kind:
                close = _CLOSED[kind].search(html, m.end())
                end = close.end() if close else -1
            else:
                close = html.find("-->", m.end())
                end = close + 3 if close >= 0 else -1
        if end < 0:
            gone.add(kind)
            out.append(html[at : m.end()])
            at = m.end()
        else:
            out += [html[at : m.start()], " "]
            at = end
    text = "".join([*out, html[at:]])
    last = text.rfind(">") + 1  # no tag ends after it
    return _TAG.sub(" ", text[:last]) + text[last:]


def declared_language(html: str) -> str | None:
    """The lang of the first html element that has one before its end."""
    at = 0
    while at >= 0 and (m := _HTML.search(html, at)):
        at = html.find(">", m.end())
        if got := _LANG.search(html, m.end(), at if at >= 0 else len(html)):
            return got[1]
    return None


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of raw pages: visible text, the html element's lang, the address's host."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [x.as_py() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(map(visible, html), pa.string()), pa.array(map(declared_language, html), pa.string())], names=["page_id", "host", "text", "declared"])

    own = pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(each, T.StructType([own.schema[0], own.schema[1], T.StructField("text", T.StringType()), T.StructField("declared", T.StringType())])).select("page_id", "text", "declared", "host")
