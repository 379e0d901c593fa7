"""SARIF logs as a data source: `df.write.format("sarif").save(folder)`, `spark.read.format("sarif").load(folder)`.

Each task writes a log of its own rows, result by result, and tells the rules it used; the commit merges them into the folder's
`index.json`, which names the logs in the order of partitions. Only logs in the index are read, so those of failed or repeated tasks don't
count. Rows have rule_id, level, message, file, line, column; other columns are written as properties. Rows without a file have no place.
Folders are paths or URIs that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX = "index.json"
COLUMNS = ("rule_id", "level", "message", "file", "line", "column")
_SCHEMA = "rule_id string, level string, message string, file string, line int, column int"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _read(folder: str, name: str) -> dict | None:
    store, at = _store(folder)
    if store.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{at}/{name}") as file:
        return json.loads(file.read())


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    log: str
    rules: dict[str, str]
    results: dict[str, int]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, tool: str, overwrite: bool):
        self.folder, self.tool, self.overwrite = folder, tool, overwrite

    def write(self, iterator: Iterator[Row]) -> _Written:
        from ..plans.report import SARIF_SCHEMA, SARIF_VERSION

        partition = TaskContext.get().partitionId()
        store, at = _store(self.folder)
        store.create_dir(at, recursive=True)
        log = f"log-{partition:05d}-{uuid.uuid4().hex}.sarif"
        rules: dict[str, str] = {}
        results: Counter[str] = Counter()
        with store.open_output_stream(f"{at}/{log}") as out:
            out.write(f'{{"$schema": {json.dumps(SARIF_SCHEMA)}, "version": "{SARIF_VERSION}", "runs": [{{"results": ['.encode())
            for row in iterator:
                values = row.asDict(recursive=True)
                rule, level, message, file, line, column = (values.pop(c, None) for c in COLUMNS)
                result = {"ruleId": rule, "level": level, "message": {"text": message}}
                if file is not None:
                    result["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": file}, "region": {"startLine": line, "startColumn": column}}}]
                if values:
                    result["properties"] = values
                out.write(("\n" if not results else ",\n").encode() + json.dumps(result, default=str).encode())
                rules.setdefault(str(rule), str(level))
                results[str(rule)] += 1
            driver = {"name": self.tool, "rules": [{"id": k, "defaultConfiguration": {"level": v}} for k, v in sorted(rules.items())]}
            out.write(f'\n], "tool": {{"driver": {json.dumps(driver)}}}}}]}}\n'.encode())
        return _Written(partition, log, rules, dict(results))

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.folder)
        before = _read(self.folder, INDEX) or {"logs": [], "rules": {}, "results": {}}
        now = {"logs": [], "rules": {}, "results": {}} if self.overwrite else before
        results = Counter(now["results"])
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            now["logs"].append(m.log)
            now["rules"] = m.rules | now["rules"]
            results.update(m.results)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{INDEX}") as out:
            out.write(json.dumps({"logs": now["logs"], "rules": dict(sorted(now["rules"].items())), "results": dict(sorted(results.items()))}, indent=1).encode())
        if self.overwrite:
            for log in before["logs"]:
                store.delete_file(f"{at}/{log}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/{m.log}")


@dataclass
class _Log(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Log]:
        index = _read(self.folder, INDEX)
        return [_Log(name) for name in index["logs"]] if index else []

    def read(self, partition: _Log) -> Iterator[tuple]:
        store, at = _store(self.folder)
        with store.open_input_stream(f"{at}/{partition.name}") as file:
            runs = json.loads(file.read())["runs"]
        for run in runs:
            for r in run["results"]:
                place = r["locations"][0]["physicalLocation"] if r.get("locations") else {}
                region = place.get("region", {})
                yield r["ruleId"], r["level"], r["message"]["text"], place.get("artifactLocation", {}).get("uri"), region.get("startLine"), region.get("startColumn")


class SarifSource(DataSource):
    """Options: path (the folder), tool (the name that logs give)."""

    @classmethod
    def name(cls) -> str:
        return "sarif"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        missing = [c for c in COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"a SARIF log needs the columns {missing}")
        return _Writer(self.options["path"], self.options.get("tool", "seamwright"), overwrite)


def register(spark: SparkSession) -> None:
    """Make format("sarif") known to a session."""
    spark.dataSource.register(SarifSource)
