"""Text files as documents: read whole, decoded, with one kind of line end; what can't be read is refused by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "markdown", "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """name, text, refused: a row for each file below path; text is null where refused says why.

    Bytes that aren't UTF-8 become replacement characters, \\r\\n and \\r become \\n, a leading byte order mark goes. Files are read in parallel, each
    in one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    rows = files.select(name.alias("name"), suffix.alias("suffix"), F.when(suffix.isin(*SUFFIXES), text).alias("text"))
    kind = F.when(F.col("suffix") == "", "a file without a suffix").otherwise(F.concat(F.lit("."), "suffix"))
    why = F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("can't index "), kind)).when(~F.col("text").rlike(r"\S"), "has no text to index")
    return rows.withColumn("refused", why).select("name", F.when(F.col("refused").isNull(), F.col("text")).alias("text"), "refused")
