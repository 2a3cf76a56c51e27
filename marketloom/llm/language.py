"""Language identification by Bayesian evidence fusion.

log P(language | row) adds up
  - the text: byte trigrams (lower case) under a naive Bayes model, tempered to EVIDENCE trigrams, as neighbouring
    trigrams aren't independent; "und" is a uniform model, for texts in none of the languages;
  - the language that the markup declares (<html lang>), right with probability DECLARED;
  - the address: its country suffix or a language segment in its path, right with probability ADDRESS;
  - the host's prior: its rows' text languages, counted by grouped aggregation over all rows, smoothed towards
    its domain's, that towards all rows', that towards equal shares.

The model is fitted on at most SAMPLE labelled documents per language, a bound that is a parameter; its tables
have BUCKETS rows whatever the corpus. Counts for priors cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, packed
from .words import chunks, text_buffer

SAMPLE = 2_000
#: Languages that a model knows: a table of BUCKETS numbers each, 64 MB in all.
MOST_LANGUAGES = 128
BUCKETS = 1 << 16
EVIDENCE = 60
DECLARED, ADDRESS = 0.9, 0.8
SMOOTH = 20.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.02

#: Country suffixes and the language most used there.
SUFFIXES = {
    "at": "de", "au": "en", "ca": "en", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl",
    "nz": "en", "pl": "pl", "pt": "pt", "uk": "en", "us": "en",
}

# What is never closed lasts to the end of the page, so that no scan of it starts over.
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*+>|\Z)|<!--.*?(?:-->|\Z)|</?[a-z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each trigram, bucket) for runs of whole texts; digits count alike."""
    data, offsets = text_buffer(pc.utf8_lower(column.fill_null("")))
    for a, b in chunks(offsets, 1 << 19):
        part = data[offsets[a] : offsets[b]].astype(np.uint32)
        part[(part >= 48) & (part <= 57)] = 48
        part[part < 32] = 32
        edges = offsets[a : b + 1] - offsets[a]
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:] if len(part) > 2 else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(b - a), np.diff(edges))[: len(code)]
        inside = row == np.repeat(np.arange(b - a), np.diff(edges))[2:] if len(code) else np.zeros(0, bool)
        yield a, b - a, row[inside], ((code * np.uint32(2654435761)) >> np.uint32(16))[inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, n, row, bucket in _trigrams(batch.column("text")):
            for name in set(lang[first : first + n]):
                mine = (lang[first : first + n] == name)[row]
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += np.bincount(bucket[mine], minlength=BUCKETS)
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])


class Model:
    """Log likelihood of each trigram bucket in each language; the last column is the unknown language's."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def score(self, column: pa.Array) -> np.ndarray:
        """Tempered log likelihood, rows x languages; zeros for a text without a trigram."""
        out = np.zeros((len(column), len(self.languages)))
        for first, n, row, bucket in _trigrams(column):
            size = np.bincount(row, minlength=n)
            for j in range(len(self.languages)):
                out[first : first + n, j] = np.bincount(row, weights=self.table[j][bucket], minlength=n)
            out[first : first + n] *= np.minimum(1.0, EVIDENCE / np.maximum(size, 1))[:, None]
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most `sample` different texts of each language, chosen by a hash of the text.

    The languages are the MOST_LANGUAGES labels with most different texts, ties by name; texts with another label are judged by these. Copies
    of a text count once. Rows with a null text or language are left out. Without any labelled row the model knows only "und".
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(lang_col).cast("string")).alias("lang"))
    rows = rows.where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    different = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r.lang: r.n for r in different.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    # an even share of the hash range, wide enough to hold the sample, so no ranking of all rows is needed; then the bound
    names, tables, wide = sorted(counts), [], sample + 8 * sample**0.5 + 32
    shares = [F.lit(x) for lang in names for x in (lang, -int(-1_000_000 * min(1.0, wide / counts[lang]) // 1))]
    kept = rows.where(F.pmod("h", F.lit(1_000_000)) < F.try_element_at(F.create_map(*shares), F.col("lang"))) if counts else rows
    kept = kept.groupBy("lang", "h").agg(F.min("text").alias("text"))
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= sample)
    found = map_arrow(kept.select("text", "lang"), _counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas() if counts else None
    for name in names:
        c = np.zeros(BUCKETS)
        mine = found[found.lang == name]
        c[mine.bucket.to_numpy()] = mine.n.to_numpy()
        tables.append(np.log((c + 0.1) / (c.sum() + 0.1 * BUCKETS)))
    return Model([*names, UNKNOWN], np.array([*tables, np.full(BUCKETS, -np.log(BUCKETS))], dtype=np.float64))


def _scored(batches: Iterator[pa.RecordBatch], model, markup: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        if markup:
            text = pa.array([None if x is None else _MARKUP.sub(" ", x) for x in text.to_pylist()], pa.string())
        score = model.value.score(text)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * score.shape[1]), pa.array(score.reshape(-1)))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], names=[*names, "score"])


def _fused(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds language, probability and text_language to rows with score, host, domain, declared and address."""
    known = [x for x in languages if x != UNKNOWN]
    if not known:  # nothing to tell apart
        return rows.withColumns({"text_language": F.lit(None).cast("string"), "language": F.lit(UNKNOWN), "probability": F.lit(1.0)})
    text = F.array_max(F.arrays_zip(F.col("score").alias("s"), F.array(*map(F.lit, languages)).alias("l")))["l"]
    rows = materialize(rows.withColumn("text_language", F.when(F.array_max("score") != 0, text)), "scored")
    count = [F.count_if(F.col("text_language") == x).cast("double").alias(f"n{i}") for i, x in enumerate(known)]
    hosts = rows.groupBy("domain", "host").agg(*count)
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(known))]
    domains = hosts.groupBy("domain").agg(*sums)
    total = domains.agg(*sums).first()  # one number a language
    everything = sum(x or 0 for x in total)
    top = [((x or 0) + 1) / (everything + len(known)) for x in total]

    def smooth(df: DataFrame, above: list[Column]) -> list[Column]:
        n = sum((F.col(f"n{i}") for i in range(len(known))), F.lit(0.0))
        return [(F.col(f"n{i}") + SMOOTH * p) / (n + SMOOTH) for i, p in enumerate(above)]

    domains = domains.select(F.col("domain").alias("_d"), F.array(*smooth(domains, [F.lit(x) for x in top])).alias("p"))
    hosts = hosts.join(domains, F.col("domain").eqNullSafe(F.col("_d"))).select("domain", "host", F.array(*smooth(hosts, [F.col("p")[i] for i in range(len(known))])).alias("prior"))
    hosts = hosts.select(F.col("domain").alias("_d"), F.col("host").alias("_h"), "prior")
    rows = rows.join(hosts, F.col("domain").eqNullSafe(F.col("_d")) & F.col("host").eqNullSafe(F.col("_h")))

    def given(said: str, lang: str, right: float) -> Column:
        wrong = (1 - right) / max(1, len(known) - 1) if lang != UNKNOWN else 1 / max(1, len(known))
        told = F.log(F.when(F.col(said) == lang, right if lang != UNKNOWN else wrong).otherwise(wrong))
        return F.when(F.col(said).isin(known), told).otherwise(0.0)

    sums = []
    for i, x in enumerate(languages):
        prior = F.log(F.lit(UNKNOWN_PRIOR)) if x == UNKNOWN else F.log(F.col("prior")[known.index(x)] * (1 - UNKNOWN_PRIOR))
        sums.append(F.col("score")[i] + prior + given("declared", x, DECLARED) + given("address", x, ADDRESS))
    rows = rows.withColumn("all", F.array(*sums)).withColumn("top", F.array_max("all"))
    language = F.array_max(F.arrays_zip(F.col("all").alias("s"), F.array(*map(F.lit, languages)).alias("l")))["l"]
    share = 1 / sum((F.exp(F.col("all")[i] - F.col("top")) for i in range(len(languages))), F.lit(0.0))
    return rows.withColumn("language", language).withColumn("probability", share)


def _accepted(model: Model) -> Column:
    known = (F.col("language") != UNKNOWN) & F.col("text_language").isNotNull()
    return (known if len(model.languages) > 1 else F.lit(None).cast("boolean")).alias("accepted")


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, text_key, text_language, language, probability, accepted): one row per row of docs.

    The source stands for the host; there is no markup or address. text_language is the text model's alone and
    null if there is no text of three bytes. accepted: the language isn't "und", and there is a text; null if the
    model knows no language, as then nothing is judged. Null ids and sources are values of their own. Repeated rows
    count each. An empty table gives an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    rows = map_arrow(rows, lambda b: _scored(b, known, False), "doc_id long, text_key long, host string, score array<double>")
    rows = rows.withColumns({"domain": F.lit(None).cast("string"), "declared": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
    out = _fused(rows, model.languages)
    return out.select("doc_id", "text_key", "text_language", "language", "probability", _accepted(model))


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, text_language, declared, address, language, probability, accepted): one row per row of pages.

    A null address or page has no evidence of that kind. See identify_documents() for the rest.
    """
    known = pages.sparkSession.sparkContext.broadcast(model)
    html, url = F.col(html_col).cast("string"), F.lower(F.col(url_col).cast("string"))
    host = F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/:?#]*\.([a-z]+)(?:[/:?#]|$)", 1), F.lit(""))
    segment = F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1), F.lit(""))
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        host.alias("host"),
        F.nullif(F.regexp_extract(url, r"^[a-z]+://(?:[^/:?#]*\.)?([^./:?#]+\.[^./:?#]+)(?:[/:?#]|$)", 1), F.lit("")).alias("domain"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit("")).alias("declared"),
        F.coalesce(segment, F.try_element_at(country, suffix)).alias("address"),
        html.alias("text"),
    )
    schema = "page_id long, host string, domain string, declared string, address string, score array<double>"
    out = _fused(map_arrow(rows, lambda b: _scored(b, known, True), schema), model.languages)
    return out.select("page_id", "text_language", "declared", "address", "language", "probability", _accepted(model))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows that identify_documents() rejects; columns of any name are carried along.

    A model that knows no language rejects nothing.
    """
    bad = identify_documents(docs, model).where("not accepted").select("doc_id", "text_key").distinct()
    bad = materialize(bad.withColumnsRenamed({"doc_id": "i", "text_key": "t"}), "rejected")
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(F.col("text").cast("string")))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")), "left_anti").select("row.*")
