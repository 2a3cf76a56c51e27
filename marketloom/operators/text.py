"""Prose: passages of documents, the numbers that it cites, and whether computed values bear them out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A number as prose writes it, with the word or bracket before it.
CITED = r"([A-Za-z]+(?:\(|\s+))?([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?)"
#: CITED as one match that begins at a word's first letter only and never steps back, so that long words cost no more than short ones.
_WORD = r"[A-Za-z]+(?:\(|\s+)"
_FOUND = r"(?:(?<![A-Za-z])[A-Za-z]++(?:\(|\s++))?+" + CITED[CITED.index(")?(") + 2 :]
#: Words that make a number a reference, and a number of four digits a year.
REFERENCE = "figure fig figures table tables chart exhibit panel step section appendix model equation note".split()
DATED = "in since during from to by until through after before of and between the over".split()
YEARS = (1900, 2100)
#: Places after the decimal point to which computed values are kept for comparison.
PLACES = 12

_BREAK = re.compile(r"(?<=[.!?])\s+")


def _passages(text: str, size: int, overlap: int) -> list[str]:
    """Runs of whole sentences of about `size` characters; each begins with the last sentences before it, up to `overlap`."""
    sentences = [s for s in (x.strip() for x in _BREAK.split(text.strip())) if s]
    cost = [len(s) + 1 for s in sentences]
    out, first, held, i = [], 0, 0, 0
    for i, c in enumerate(cost):
        if i > first and held + c > size:
            out.append(" ".join(sentences[first:i]))
            back, kept = i, 0
            while overlap > 0 and back > first and kept + cost[back - 1] <= overlap:
                back -= 1
                kept += cost[back]
            first, held = back, kept
        held += c
    return [*out, " ".join(sentences[first:])] if sentences else []


def passages(docs: DataFrame, size: int = 1200, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ordinal, text: a sentence longer than size stays whole. A null or empty text has none."""
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, p) for i, t in pdf.itertuples(index=False) for n, p in enumerate(_passages(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "text"])

    out = docs.select(F.col(id_col), F.col(text_col)).mapInPandas(cut, f"id {kind}, ordinal int, text string")
    return out.withColumnRenamed("id", id_col)


def cited_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, word, cited, value, places, percent: the numbers of each text in order, without references, years and model orders."""
    docs = docs.where(F.col(text_col).rlike("[0-9]"))
    rows = docs.select(F.col(id_col), F.posexplode(F.regexp_extract_all(text_col, F.lit(_FOUND), F.lit(0))).alias("place", "x"))
    before = F.regexp_extract("x", f"^({_WORD})?", 1)
    rows = rows.select(id_col, "place", F.lower(F.regexp_replace(before, r"[\s(]+$", "")).alias("word"), before.endswith("(").alias("order"), F.regexp_replace("x", f"^{_WORD}", "").alias("cited"))
    plain = F.regexp_replace("cited", "[,%]", "")
    rows = rows.withColumns({"value": plain.try_cast("double"), "places": F.length(F.regexp_extract("cited", r"\.(\d+)", 1)), "percent": F.col("cited").endswith("%")})
    year = F.col("cited").rlike(r"^\d{4}$") & F.col("value").between(*YEARS) & F.col("word").isin(*DATED)
    return rows.where(~(F.col("word").isin(*REFERENCE) | year | F.col("order"))).drop("order")


def grounded(docs: DataFrame, allowed: DataFrame, id_col: str = "doc_id", text_col: str = "text", value: str = "value") -> DataFrame:
    """id, checked, unsupported: numbers of each text, and how many match no allowed value at the precision they are cited with.

    A percentage may stand for itself or a hundredth. Allowed values are joined by their rounded forms, never compared pairwise.
    """
    numbers = cited_numbers(docs, id_col, text_col)
    forms = F.array(F.struct(F.col("value").alias("v"), F.col("places").alias("p")), F.when(F.col("percent"), F.struct((F.col("value") / 100).alias("v"), (F.col("places") + 2).alias("p"))))
    asked = numbers.select(id_col, "place", F.posexplode(forms).alias("form", "f")).where("f is not null")
    asked = asked.select(id_col, "place", "form", F.col("f.p").alias("p"), F.round(F.col("f.v") * F.pow(F.lit(10.0), "f.p")).alias("k"))
    known = allowed.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct().select("v", F.explode(F.sequence(F.lit(0), F.lit(PLACES))).alias("p"))
    known = known.select("p", F.round(F.col("v") * F.pow(F.lit(10.0), "p")).alias("k")).distinct().withColumn("ok", F.lit(True))
    # the texts are read once: numbers keep their id and place through the join, and a number is borne out where one of its forms is
    borne = asked.join(known, ["p", "k"], "left").groupBy(id_col, "place").agg(F.count_if(F.col("form") == 0).alias("n"), F.max("ok").alias("ok"))
    return borne.groupBy(id_col).agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("ok") & F.col(id_col).isNotNull(), 0).otherwise(F.col("n"))).alias("unsupported"))
