"""Published factor files as a Spark data source: `spark.read.format("factor_file").load(path)`.

A file has lines of prose, then sections. A section is a line of comma-separated names whose first is blank, and lines of a period
and figures in per cent; it ends at a line that is neither. Periods of six digits are months, of eight days, of four years; the
section asked for (option `block`: monthly, daily or annual) is the first of its kind. A figure of -99.99 or -999 is missing.
Files are partitions, bounds on ts reach the reader, and files that other file systems hold are read through pyarrow's.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from .panel import compounded

BLOCKS = {"monthly": 6, "daily": 8, "annual": 4}
#: Figures that stand for a missing one.
MISSING = (-99.99, -999.0)
#: The published names of columns, and what the tools call them.
COLUMNS = {"Mkt-RF": "mkt_rf", "SMB": "smb", "HML": "hml", "RMW": "rmw", "CMA": "cma", "Mom": "mom", "RF": "rf"}
#: The files that each set of factors is made of, and its factors. Momentum goes with the three-factor file.
SETS = {
    "ff3": ({"daily": ("F-F_Research_Data_Factors_daily",), "monthly": ("F-F_Research_Data_Factors",)}, ("mkt_rf", "smb", "hml")),
    "ff5": ({"daily": ("F-F_Research_Data_5_Factors_2x3_daily",), "monthly": ("F-F_Research_Data_5_Factors_2x3",)}, ("mkt_rf", "smb", "hml", "rmw", "cma")),
    "carhart4": ({"daily": ("F-F_Research_Data_Factors_daily", "F-F_Momentum_Factor_daily"), "monthly": ("F-F_Research_Data_Factors", "F-F_Momentum_Factor")}, ("mkt_rf", "smb", "hml", "mom")),
}


def period_end(period: str) -> dt.date:
    """The last day of a year, month or day written in digits."""
    year, month = int(period[:4]), int(period[4:6] or 12)
    return dt.date(year, month, int(period[6:8] or calendar.monthrange(year, month)[1]))


def parsed(lines: Iterator[str], digits: int) -> Iterator[tuple[list[str], dt.date, list[float | None]]]:
    """(names, period's end, figures as fractions) of the first section whose periods have so many digits."""
    names, begun = None, False
    for line in lines:
        cells = [c.strip() for c in line.rstrip("\r\n").split(",")]
        if len(cells) > 1 and re.fullmatch(rf"\d{{{digits}}}", cells[0]) and names and len(cells) == len(names) + 1:
            begun = True
            numbers = [float(c) if c else None for c in cells[1:]]
            yield names, period_end(cells[0]), [None if x is None or x in MISSING else x / 100 for x in numbers]
        elif begun:
            return
        elif len(cells) > 1 and not cells[0] and all(cells[1:]):
            names = cells[1:]


def _open(path: str):
    """A file system and the path in it. Imported where it is used: its threads are no good in a process that forks workers."""
    import pyarrow.fs as pafs

    system, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


def _lines(path: str) -> Iterator[str]:
    system, inner = _open(path)
    with system.open_input_stream(inner) as stream:
        held = b""
        while chunk := stream.read(1 << 20):
            *whole, held = (held + chunk).split(b"\n")
            for line in whole:
                yield line.decode("utf-8", "replace")
        yield held.decode("utf-8", "replace")


def _files(path: str) -> list[str]:
    system, inner = _open(path)
    import pyarrow.fs as pafs

    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_")))
    lead = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [lead + f for f in found]


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FactorReader(DataSourceReader):
    def __init__(self, path: str, digits: int, columns: list[str]):
        self.path, self.digits, self.columns = path, digits, columns
        self.low, self.high = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on ts for itself; the others are Spark's."""
        day = dt.timedelta(days=1)
        for f in filters:
            on_ts = getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), dt.date)
            if on_ts and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                self.low = max(self.low, f.value + day * isinstance(f, GreaterThan))
            if on_ts and isinstance(f, LessThanOrEqual | LessThan | EqualTo):
                self.high = min(self.high, f.value - day * isinstance(f, LessThan))
            if not on_ts or not isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo | LessThanOrEqual | LessThan):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in _files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for names, ts, figures in parsed(_lines(partition.path), self.digits):
            if self.low <= ts <= self.high:
                held = dict(zip(names, figures, strict=True))
                yield (name, ts, *[held.get(c) for c in self.columns])


class FactorFiles(DataSource):
    """Options: path (a file or a folder), block, and columns (comma-separated; else those of the first file)."""

    @classmethod
    def name(cls) -> str:
        return "factor_file"

    def _digits(self) -> int:
        block = self.options.get("block", "monthly")
        if block not in BLOCKS:
            raise ValueError(f"unknown block {block!r}: {', '.join(BLOCKS)}")
        return BLOCKS[block]

    def schema(self) -> StructType:
        if "columns" in self.options:
            names = self.options["columns"].split(",")
        else:
            files = _files(self.options["path"])
            names = next((n for f in files for n, _, _ in parsed(_lines(f), self._digits())), None)
            if names is None:
                raise ValueError(f"{self.options['path']} has no section with {self.options.get('block', 'monthly')} periods")
        return StructType([StructField("file", StringType()), StructField("ts", DateType()), *[StructField(n, DoubleType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FactorReader(self.options["path"], self._digits(), [f.name for f in schema.fields[2:]])


def read_factors(spark: SparkSession, path: str, block: str = "monthly", start: str | None = None, end: str | None = None) -> DataFrame:
    """file, ts and a column for each factor; bounds on ts are the reader's work."""
    spark.dataSource.register(FactorFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("factor_file").option("block", block).load(path)
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("date"))
    return rows.where(F.col("ts") <= F.lit(end).cast("date")) if end else rows


def factor_set(spark: SparkSession, root: str, name: str, start: str, end: str, frequency: str = "D", suffix: str = ".csv") -> DataFrame:
    """ts, the set's factors and rf, as fractions: dates that all its files have, compounded to the frequency (D, W, M, Q or A).

    Daily files serve D and W, monthly ones the rest. A set that isn't known, an empty window and a file without rows in it are errors.
    """
    if name not in SETS:
        raise ValueError(f"unknown set {name!r}: {', '.join(sorted(SETS))}")
    if end <= start:
        raise ValueError(f"the window {start}..{end} is empty")
    block = "daily" if frequency in ("D", "W") else "monthly"
    files, wanted = SETS[name]
    parts = []
    for file in files[block]:
        rows = read_factors(spark, f"{root.rstrip('/')}/{file}{suffix}", block, start, end)
        if rows.isEmpty():
            raise ValueError(f"{name}: {file} has nothing from {start} to {end}")
        named = {c: COLUMNS[c] for c in rows.columns if c in COLUMNS}
        parts.append(rows.select("ts", *[F.col(f"`{c}`").alias(v) for c, v in named.items()]))
    taken, held = set(), []
    for p in parts:  # of a column that two files have, the first file's counts
        held.append(p.select("ts", *[c for c in p.columns[1:] if c not in taken]))
        taken |= set(p.columns[1:])
    joined = reduce(lambda a, b: a.join(b, "ts"), held)
    columns = [c for c in (*wanted, "rf") if c in taken]
    joined = joined.select("ts", *columns).na.drop("all", subset=columns)
    if frequency in ("D", "M"):
        return joined
    long = compounded(joined.unpivot(["ts"], columns, "symbol", "r"), frequency)
    return long.groupBy(F.col("period_end").alias("ts")).pivot("symbol", columns).agg(F.first("r"))


def write_factor_file(rows: DataFrame, path: str, columns: list[str], digits: int = 6) -> None:
    """One file in the published form of rows (ts and columns, in per cent, null as -99.99), in order of ts: as long as its calendar."""
    ts = F.date_format("ts", "yyyyMMdd"[: {4: 4, 6: 6, 8: 8}[digits]])
    cells = [F.format_string("%8.4f", F.coalesce(F.col(c), F.lit(MISSING[0]))) for c in columns]
    lines = rows.select(F.lit(1).alias("part"), ts.alias("at"), F.concat_ws(",", ts, *cells).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "0", "Returns by segment, made of orders"), (0, "1", ""), (0, "2", "," + ",".join(columns)), (2, "0", ""), (2, "1", "  Copyright of nobody")], "part int, at string, line string")
    lines.unionByName(head).repartition(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)
