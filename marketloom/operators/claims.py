"""Numbers of prose in their context: which of them claim something, and which claims computed values bear out.

A text falls into sentences, a sentence into numbers and the text between them. Windows over that stream carry what stands around a
number (the last word before, the numbers next to it, whether it begins its line), by which references, citations of steps, list
markers, years, orders of models and usual levels of significance are told from claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import DATED, PLACES, REFERENCE, YEARS

#: A number as prose writes it, signs that part a range of years, levels of significance and words that speak of it.
NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
DASH = "[-\u2010\u2011\u2012\u2013\u2014\u2015\u2212]"
LEVELS, SIGNIFICANCE = (1.0, 5.0, 10.0, 0.01, 0.05, 0.10), ("level", "significan", "confidence", "reject", "alpha")
ORDER = r"([A-Za-z])\([\d,\s]+\)"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, sentence: parted at line ends, and where a capital follows . ! or ? and white space; blank ones are left out."""
    parted = F.split(F.regexp_replace(text_col, r"([.!?])\s+(?=[A-Z])", "$1\n"), "\n")
    rows = docs.select(F.col(id_col), F.posexplode(parted).alias("line", "sentence"))
    return rows.where(F.trim(F.regexp_replace("sentence", r"\s", " ")) != "")


def number_context(docs: DataFrame, steps: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, nth, cited, value, places, percent, word, exempt: each number, and why it claims nothing (null where it does).

    exempt: reference, step, list, year or level; orders in brackets right behind a name are passed over altogether. steps: the ids
    that a citation may name. A null text has no numbers.
    """
    rows = sentences(docs, id_col, text_col).withColumn("said", F.regexp_replace("sentence", ORDER, "$1()"))
    between, found = F.split("said", NUMBER, -1), F.regexp_extract_all("said", F.lit(NUMBER), F.lit(0))
    about = F.lower("said").rlike("|".join(SIGNIFICANCE))
    rows = rows.select(F.col(id_col), "line", about.alias("about"), between.alias("between"), F.posexplode(found).alias("nth", "cited"))
    rows = rows.select(id_col, "line", "nth", "cited", "about", F.get("between", F.col("nth")).alias("ahead"), F.get("between", F.col("nth") + 1).alias("behind"))
    order = Window.partitionBy(id_col, "line").orderBy("nth")
    own = F.nullif(F.regexp_extract("ahead", r"([A-Za-z]+)[^A-Za-z]*$", 1), F.lit(""))
    rows = rows.withColumns({
        "word": F.lower(F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))), "next": F.lead("cited").over(order), "last": F.lag("cited").over(order),
        "next_behind": F.lead("behind").over(order), "last_ahead": F.lag("ahead").over(order),
    })
    cited = F.col("cited")
    whole = cited.rlike(r"^[\d,]+(?:[eE][-+]?\d+)?$")  # without sign, decimals and per cent
    plain = F.regexp_replace("cited", "[,%]", "")
    rows = rows.withColumns({"value": plain.try_cast("double"), "places": F.length(F.regexp_extract("cited", r"\.(\d+)", 1)), "percent": cited.endswith("%")})
    digits = F.regexp_extract("cited", r"^[-+]?([\d,]+)", 1)
    step = F.lit(False)
    if steps:
        letters = F.regexp_extract("ahead", r"([A-Za-z]+)$", 1)
        step = whole & (letters != "") & F.lower(F.concat(letters, digits)).isin(*[s.lower() for s in steps])
    marker = whole & (F.col("nth") == 0) & (F.trim(F.regexp_replace("ahead", r"\s", " ")) == "") & F.col("behind").rlike(r"^[.)](?:\s|$)") & ~((F.length("behind") == 1) & F.col("next").isNotNull())
    exempt = (
        F.when(F.col("word").isin(*REFERENCE), "reference").when(step, "step").when(marker, "list").when(_year(digits), "year").when(F.col("value").isin(*LEVELS) & F.col("about"), "level")
    )
    return rows.select(id_col, "line", "nth", "cited", "value", "places", "percent", "word", exempt.alias("exempt"))


def _between_years(gap: Column, sign: Column) -> Column:
    return F.concat(gap, sign).rlike(rf"^\s*{DASH}?\s*$")


def _year(digits: Column) -> Column:
    """A year by itself after a word that dates, or next to another year, with nothing but a dash between."""
    fits = ~F.col("cited").rlike(r"\.|%") & digits.rlike(r"^\d{4}$") & digits.try_cast("int").between(*YEARS)
    dated = ~F.col("cited").rlike("^[-+]") & F.col("word").isin(*DATED)
    ahead = F.regexp_extract("next", r"^[-+]?(\d{4})(?![\d,eE]|,\d)", 1)
    after = _between_years(F.col("behind"), F.regexp_extract("next", r"^([-+]?)", 1)) & ahead.try_cast("int").between(*YEARS)
    glued = F.col("next").rlike(r"^[-+]?\d{4}$") & F.col("next_behind").rlike(r"^\w")
    back = F.regexp_extract("last", r"(?:^|[^\w])(\d{4})$", 1)
    stuck = F.col("last").rlike(r"^\d{4}$") & F.col("last_ahead").rlike(r"\w$")
    before = _between_years(F.col("ahead"), F.lit("")) & back.try_cast("int").between(*YEARS)
    return fits & (dated | F.coalesce(after & ~F.coalesce(glued, F.lit(False)), F.lit(False)) | F.coalesce(before & ~F.coalesce(stuck, F.lit(False)), F.lit(False)))


def claims(docs: DataFrame, steps: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return number_context(docs, steps, id_col, text_col).where("exempt is null").drop("exempt", "word")


def unsupported(docs: DataFrame, allowed: DataFrame, steps: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", value: str = "value") -> DataFrame:
    """id, line, nth, cited, value: claims that no allowed value, rounded to the places they give, bears out. A percentage may stand for a hundredth too.

    Allowed values are joined by their rounded forms, of PLACES places at most; the claims' order is kept by line and nth.
    """
    made = claims(docs, steps, id_col, text_col)
    forms = F.array_compact(F.array(F.struct(F.col("value").alias("v"), F.col("places").alias("p")), F.when(F.col("percent"), F.struct((F.col("value") / 100).alias("v"), (F.col("places") + 2).alias("p")))))
    asked = made.select(id_col, "line", "nth", F.explode(forms).alias("f")).select(id_col, "line", "nth", F.col("f.p").alias("p"), F.round(F.col("f.v") * F.pow(F.lit(10.0), "f.p")).alias("k"))
    known = allowed.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct().select("v", F.explode(F.sequence(F.lit(0), F.lit(PLACES))).alias("p"))
    known = known.select("p", F.round(F.col("v") * F.pow(F.lit(10.0), "p")).alias("k")).distinct()
    borne = asked.join(known, ["p", "k"], "left_semi").select(id_col, "line", "nth").distinct()
    return made.join(borne, [id_col, "line", "nth"], "left_anti").select(id_col, "line", "nth", "cited", "value")
