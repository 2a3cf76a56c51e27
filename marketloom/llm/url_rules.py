"""URL filters: host suffixes and path prefixes, looked up by short hashes and confirmed by full digests.

A rule is an expression: a host and the start of a path. A URL's candidates are the expressions made of one of its host's
suffixes (at a dot) and one of its path's prefixes, of the shapes (labels of the host, length of the path) that some rule has,
so their number follows from the rules, not from the URL's length. Candidates meet rules by the first 32 bits of their SHA-256;
the full digests of what met are then compared, and the longest rule left decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed

VERDICTS = ("allow", "block")
#: Rules longer than this are refused: with it the shapes, which are sent to every task, are bounded (128 labels, such lengths).
LONGEST_HOST, LONGEST_PATH = 255, 2_048
_BY_LENGTH = 1_024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*+)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def _prepared(rules: DataFrame) -> DataFrame:
    """One row a rule: labels, prefix, short, digest, rank. Of equal rules, a block wins."""
    name, start = F.translate(F.col("host"), _UPPER, _UPPER.lower()), F.coalesce("path", F.lit(""))
    right = F.col("verdict").isin(*VERDICTS) & (F.length("host") > 0) & (F.length("host") <= LONGEST_HOST) & (F.length(start) <= LONGEST_PATH)
    checked = F.when(F.coalesce(right, F.lit(False)), F.concat(name, start)).otherwise(F.raise_error(F.lit("a rule has a host, a path and the verdict allow or block")))
    each = rules.select(checked.alias("rule"), _labels(name).alias("labels"), F.length(start).alias("prefix"), "verdict")
    each = each.groupBy("rule", "labels", "prefix").agg(F.max("verdict").alias("verdict"))
    # one number: longest first, then by labels, which tell the rules of one length that fit one url apart; the last bit is the verdict
    rank = F.length("rule").cast("long") * _BY_LENGTH + F.col("labels") * 2 + (F.col("verdict") == "block").cast("int")
    return each.select("labels", "prefix", _short(F.col("rule")).alias("short"), F.sha2("rule", 256).alias("digest"), rank.alias("rank"))


def _short(expression: Column) -> Column:
    return F.conv(F.substring(F.sha2(expression, 256), 1, 8), 16, 10).cast("long")


def _expressions(shapes: dict[int, list[int]]) -> Column:
    """The expressions of host and path that have a shape, in an array."""

    def made(labels: int, lengths: list[int]) -> Column:
        suffix = F.substring_index("host", ".", -labels)
        fits = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path"))
        every = F.transform(fits, lambda n: F.concat(suffix, F.substring(F.col("path"), F.lit(1), n)))
        return F.when(_labels(F.col("host")) >= labels, every).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array().cast("array<string>"), *[made(*x) for x in sorted(shapes.items())])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of pages.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts with the rule's,
    letter by letter; a rule without a path fits any. The longest rule that fits decides (host and path counted together);
    without one, rule is null and the verdict is `default`. A null url, or one without ://, has an empty host and path, which
    no rule fits. Ports and user names count as parts of the host. Repeated and null ids keep a row each, other columns are
    ignored, empty tables give empty ones, and without rules every url has the default. Of equal rules a block wins.
    """
    if default not in VERDICTS:
        raise ValueError(f"{default!r} is no verdict")
    rules = materialize(_prepared(rules), "rules")
    shapes: dict[int, list[int]] = {}
    for r in rules.select("labels", "prefix").distinct().collect():  # bounded by LONGEST_HOST and LONGEST_PATH
        shapes.setdefault(r.labels, []).append(r.prefix)
    urls = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    urls = materialize(urls.withColumn("at", F.monotonically_increasing_id()), "urls")
    asked = urls.select("at", F.explode(_expressions(shapes)).alias("asked")).withColumn("short", _short(F.col("asked")))
    met = asked.join(rules, "short")
    # in an aggregate's argument, so that the join is by the short hash and only what met it is confirmed
    same = F.when(F.sha2("asked", 256) == F.col("digest"), F.col("rank"))
    best = met.groupBy("at").agg(F.max(same).alias("rank"))
    length, labels, blocks = F.floor(F.col("rank") / _BY_LENGTH), F.floor(F.col("rank") / 2) % (_BY_LENGTH // 2), F.col("rank") % 2 == 1
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), (-labels).cast("int"))
    rule = F.concat(suffix, F.substring(F.col("path"), F.lit(1), (length - F.length(suffix)).cast("int")))
    verdict = F.when(F.col("rank").isNull(), default).when(blocks, "block").otherwise("allow")
    return urls.join(best, "at", "left").select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def drop_blocked(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages, all columns, without those whose url is blocked."""
    rows = packed(pages, url=F.col(url_col))
    return judge(rows, rules, default, "row", "url").where("verdict = 'allow'").select("row.*")
