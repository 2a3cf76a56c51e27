"""Charts that a result's shape implies: a table of rules, joined with the keys of each result.

A rule is a set of parts; each takes the keys of one kind that a pattern fits. It fires for a step where every part finds what it
needs. Rules are constants and few, keys are few for a result, so all of it is joins and aggregations over a small table, whatever
the results' length, and any number of steps is decided at once. A chart only names keys that its result has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .results import shape

#: Series in one chart, groups of a scatter, numbers of a result that are told as tiles.
MOST_SERIES, MOST_GROUPS, MOST_TILES = 8, 3, 4
#: Numbers that describe a fit and answer no question.
BOOKKEEPING = "nobs n n_obs num_obs observations lags lags_used n_windows df dof degrees_of_freedom".split()
#: Types, and the roles that each needs.
TYPES = {
    "line": "series", "band": "center lower upper", "stem": "series lower upper", "panels": "panel", "scatter": "x y", "bar": "series", "forest": "estimate",
    "heatmap": "table", "qq": "series", "histogram": "series", "area_stack": "series", "underwater": "series", "stat_tile": "scalar", "table": "table",
}


@dataclass
class Rule:
    """parts: pattern of a key by role. least and most keys of a part; further ones than `most` are left out of the chart.

    each: every key has a chart of its own. last: only for steps that no other rule fits, and the first such rule alone.
    labels: how a key is shown, as it is, as an arrow, or with spaces. {TOOL} and {KEY} in a title stand for those.
    """

    type: str
    title: str
    parts: dict[str, str]
    subtitle: str = ""
    tool: str = ".*"
    unless: str | None = None
    kind: str = "series"
    least: int = 1
    most: int = 1
    by_name: bool = False
    labels: str = "key"
    each: bool = False
    last: bool = False


_GARCH = "garch|egarch|gjr_garch"
_SINGLE = {"realized_vol": "Realized volatility", "ewma_vol": "EWMA volatility", "spread": "Cointegrating spread", "rs_by_window": "Rescaled range by window"}

#: In the order in which charts are shown.
RULES = [
    Rule("panels", "{TOOL} fit", {"panel 1": "conditional_volatility", "panel 2": "standardized_residuals"}, "Fitted volatility and the residuals it leaves behind", _GARCH),
    Rule("line", "Conditional volatility", {"series": "conditional_volatility"}, tool=_GARCH, unless="standardized_residuals"),
    Rule("panels", "Impulse responses", {"panel": ".*->.*"}, "Response of each variable to a one-standard-deviation shock", "irf", least=2, most=1_000, labels="arrow"),
    Rule("area_stack", "Forecast error variance decomposition", {"series": ".*->.*"}, tool="fevd", most=MOST_SERIES, labels="arrow"),
    Rule("band", "Rolling beta", {"center": "beta", "lower": "beta_ci_low", "upper": "beta_ci_high"}, "Shaded band is the confidence interval"),
    *[Rule("stem", title, {"series": k, "lower": f"{k}_lower", "upper": f"{k}_upper"}, "Bars outside the band are significant at the tested level") for k, title in (("acf", "Autocorrelation"), ("pacf", "Partial autocorrelation"))],
    Rule("bar", "Variance ratio by horizon", {"series": "vr_by_horizon"}, "A random walk sits at 1 across every horizon"),
    Rule("underwater", "Drawdown", {"series": "drawdown"}, "Depth below the running maximum"),
    Rule("area_stack", "Regime probabilities", {"series": "regime_.*"}, least=2, most=MOST_SERIES, by_name=True, labels="spaces"),
    *[Rule("line", title, {"series": k}) for k, title in _SINGLE.items()],
    Rule("forest", "Coefficients", {"estimate": ".*"}, "Intervals crossing zero are not distinguishable from no effect", kind="estimate", least=2, most=1_000),
    Rule("qq", "Residual QQ plot", {"series": "residuals"}, "Departure from the line is departure from normality"),
    Rule("table", "{KEY}", {"table": ".*"}, kind="table", last=True),
    Rule("stat_tile", "{KEY}", {"scalar": f"(?!(?i:{'|'.join(BOOKKEEPING)})$).*"}, kind="scalar", most=MOST_TILES, each=True, last=True),
]


def _rules(spark: SparkSession) -> DataFrame:
    """A row for each part of each rule; the role ! bars a step from a rule."""
    rows = []
    for n, r in enumerate(RULES):
        parts = [*r.parts.items(), *([("!", r.unless)] if r.unless else [])]
        rows += [(n, r.type, r.title, r.subtitle, r.kind, f"^(?:{r.tool})$", role, f"^(?:{p})$", len(r.parts), r.least, r.most, r.by_name, r.labels, r.each, r.last) for role, p in parts]
    names = "rule int, type string, title string, subtitle string, of string, for string, role string, asked string, roles int, least int, most int, by_name boolean, labels string, each boolean, last boolean"
    return spark.createDataFrame(rows, names)


def _spoken(name: Column) -> Column:
    said = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, F.lit(2), F.length(said))))


def proposed(results: DataFrame) -> DataFrame:
    """step, tool, place, type, title, subtitle, refs (role, rank, kind, key, label), points of each chart, most informative first.

    points: the numbers of the result that it draws. Estimates count where they have an interval. Steps that no rule fits show
    their first table, or their first numbers that aren't bookkeeping, or nothing. The results are read once.
    """
    keys = shape(results).where("kind <> 'estimate' or intervals > 0")
    rules = F.broadcast(_rules(results.sparkSession))  # a constant table of few dozen rows
    held = keys.join(rules, (F.col("kind") == F.col("of")) & F.regexp_like("tool", F.col("for")) & F.regexp_like("key", F.col("asked")))
    order = Window.partitionBy("step", "tool", "rule", "role").orderBy(F.when(~F.col("by_name"), F.col("nth")), "key")
    held = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("most"))
    label = F.when(F.col("labels") == "arrow", F.replace(F.col("key"), F.lit("->"), F.lit(" → "))).when(F.col("labels") == "spaces", F.replace(F.col("key"), F.lit("_"), F.lit(" "))).otherwise(F.col("key"))
    ref = F.struct("role", "rank", "kind", "key", label.alias("label"))
    within = F.when(F.col("each"), F.col("rank")).otherwise(0).alias("within")
    names = ["step", "tool", "rule", "type", "title", "subtitle", "roles", "least", "last"]
    found = held.groupBy(*names, within).agg(
        F.array_sort(F.collect_list(ref)).alias("refs"), F.count_distinct("role").alias("found"), F.count("*").alias("n"), F.count_if(F.col("role") == "!").alias("barred"), F.sum("points").alias("points")
    )
    found = found.where((F.col("found") == F.col("roles")) & (F.col("n") >= F.col("least")) & (F.col("barred") == 0))
    step = Window.partitionBy("step", "tool")
    found = found.withColumn("first", F.min("rule").over(step)).where(~F.col("last") | (F.col("rule") == F.col("first")))
    key = F.get("refs", F.lit(0))["key"]
    title = F.replace(F.replace(F.col("title"), F.lit("{TOOL}"), F.upper("tool")), F.lit("{KEY}"), _spoken(key))
    place = F.row_number().over(step.orderBy("rule", "within"))
    return found.select("step", "tool", place.alias("place"), "type", title.alias("title"), "subtitle", "refs", "points")


def unresolved(charts: DataFrame, results: DataFrame) -> DataFrame:
    """step, tool, place, kind, key: what charts (also ones made elsewhere) name and the result hasn't."""
    refs = charts.select("step", "tool", "place", F.explode("refs").alias("r")).select("step", "tool", "place", "r.kind", "r.key")
    return refs.join(shape(results).select("step", "tool", "kind", "key"), ["step", "tool", "kind", "key"], "left_anti").select(*refs.columns)


def refused(charts: DataFrame) -> DataFrame:
    """step, tool, place, reason: charts that would mislead or can't be drawn; a chart may have several reasons.

    charts may also have low, high and scale (a heatmap's domain and colours) and bins (a histogram's).
    """
    has = lambda c, t: F.col(c).cast(t) if c in charts.columns else F.lit(None).cast(t)
    count = lambda role: F.size(F.filter("refs", lambda r: F.split(r["role"], " ")[0] == role))
    missing = F.lit(False)
    for type_, roles in TYPES.items():
        for role in roles.split():
            missing = missing | ((F.col("type") == type_) & (count(role) == 0))
    across = (has("low", "double") < 0) & (has("high", "double") > 0) & (has("scale", "string") != "diverging")
    reasons = {
        "unknown type": ~F.col("type").isin(*TYPES), "a chart has a title": F.coalesce(F.trim("title") == "", F.lit(True)), "a part is missing": missing,
        f"more than {MOST_SERIES} series": F.col("type").isin("line", "bar", "area_stack") & (count("series") > MOST_SERIES),
        "panels are two or more": (F.col("type") == "panels") & (count("panel") < 2),
        f"more than {MOST_GROUPS} groups": (F.col("type") == "scatter") & (count("group") > MOST_GROUPS),
        "values on both sides of zero need a diverging scale": (F.col("type") == "heatmap") & across,
        "5 to 200 bins": (F.col("type") == "histogram") & ~has("bins", "int").between(5, 200),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in reasons.items()])))
    return charts.select("step", "tool", "place", each.alias("reason"))
