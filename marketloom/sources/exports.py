"""Exports with a manifest, as a Spark data source: `df.write.format("export").option("path", p).option("params", json).save()`.

Tasks write their rows as JSON lines, CSV or a Markdown table into a staging folder; the commit moves the files in place and writes
manifest.json last, with the rows, bytes and SHA-256 of each, the columns and a hash of the parameters. A folder without
that file is no export, so a job that fails leaves none. Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMATS = {"json": "jsonl", "csv": "csv", "markdown": "md"}
MANIFEST = "manifest.json"


def _place(path: str):
    """A file system and the path in it. Imported where it is used: its threads are no good in a process that forks workers."""
    import pyarrow.fs as pafs

    system, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner.rstrip("/")


def params_hash(params: str) -> str:
    """Of JSON, whatever its spaces and the order of its names."""
    return hashlib.sha256(json.dumps(json.loads(params), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


def _cell(x) -> str:
    return "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, params: str, columns: list[str], overwrite: bool):
        self.path, self.kind, self.params, self.columns, self.overwrite = path, kind, params, columns, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        system, inner = _place(path)
        if not overwrite and system.get_file_info(f"{inner}/{MANIFEST}").is_file:
            raise ValueError(f"{path} holds an export already")

    def _line(self, row: Row) -> str:
        if self.kind == "json":
            return json.dumps(dict(zip(self.columns, row, strict=True)), default=str) + "\n"
        if self.kind == "markdown":
            return "| " + " | ".join(map(_cell, row)) + " |\n"
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if x is None else x for x in row])
        return out.getvalue()

    def _head(self) -> str:
        if self.kind == "markdown":
            return "| " + " | ".join(map(_cell, self.columns)) + " |\n|" + " --- |" * len(self.columns) + "\n"
        return self._csv_head() if self.kind == "csv" else ""

    def _csv_head(self) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(self.columns)
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> Part:
        system, inner = _place(self.path)
        folder, name = f"{inner}/{self.staging}", f"part-{uuid.uuid4().hex}.{FORMATS[self.kind]}"
        system.create_dir(folder, recursive=True)
        digest, rows, size = hashlib.sha256(), 0, 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            size += self._put(out, digest, self._head())
            for row in iterator:
                size += self._put(out, digest, self._line(row))
                rows += 1
        return Part(name, rows, size, digest.hexdigest())

    @staticmethod
    def _put(out, digest, line: str) -> int:
        data = line.encode()
        out.write(data)
        digest.update(data)
        return len(data)

    def commit(self, messages: list[Part | None]) -> None:
        import pyarrow.fs as pafs

        system, inner = _place(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        old = [f.path for f in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.is_file]
        for m in parts:
            system.move(f"{inner}/{self.staging}/{m.name}", f"{inner}/{m.name}")
        manifest = {
            "format": self.kind, "columns": self.columns, "rows": sum(m.rows for m in parts), "params_hash": params_hash(self.params), "params": json.loads(self.params),
            "fingerprint": hashlib.sha256("\n".join(sorted(m.sha256 for m in parts)).encode()).hexdigest(),
            "files": [{"name": m.name, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in parts],
        }
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{self.staging}-{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=1).encode())
        system.move(f"{inner}/{self.staging}-{MANIFEST}", f"{inner}/{MANIFEST}")
        for path in old:  # what an export that is overwritten has left
            if not path.endswith(f"/{MANIFEST}"):
                system.delete_file(path)
        self._clear(system, inner)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system, inner: str) -> None:
        import pyarrow.fs as pafs

        if system.get_file_info(f"{inner}/{self.staging}").type == pafs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staging}")


class Export(DataSource):
    """Options: path, kind (json, csv or markdown), params (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "export"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kind = self.options.get("kind", "json")
        if kind not in FORMATS:
            raise ValueError(f"unknown kind {kind!r}: {', '.join(FORMATS)}")
        return ExportWriter(self.options["path"], kind, self.options.get("params", "{}"), schema.names, overwrite)


def write_export(rows: DataFrame, path: str, kind: str = "json", params: dict | None = None, overwrite: bool = False) -> None:
    rows.sparkSession.dataSource.register(Export)
    mode = "overwrite" if overwrite else "append"  # onto an export that is there already, append is refused
    rows.write.format("export").mode(mode).option("path", path).option("kind", kind).option("params", json.dumps(params or {})).save()


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A folder without one is an error."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path.rstrip('/')}/{MANIFEST}").collect()))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, as_written: the files of an export, and whether each still has the bytes that the manifest tells; missing ones haven't."""
    manifest = read_manifest(spark, path)
    listed = spark.createDataFrame([(f["name"], f["rows"], f["sha256"]) for f in manifest["files"]], "name string, rows long, told string")
    held = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("has"))
    return listed.join(held, "name", "left").select("name", "rows", F.coalesce(F.col("told") == F.col("has"), F.lit(False)).alias("as_written"))


def read_export(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of an export of kind json or csv; one whose files aren't as they were written is an error."""
    manifest = read_manifest(spark, path)
    if bad := [r.name for r in verified(spark, path).where("not as_written").limit(5).collect()]:
        raise ValueError(f"{path}: {', '.join(bad)} is not as it was written")
    files = [f"{path.rstrip('/')}/{f['name']}" for f in manifest["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(files) if manifest["format"] == "json" else spark.read.schema(schema).option("header", True).csv(files)
