"""Source trees as a table of files (S1), and parsers applied to it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut
from . import go_source, python_source, ts_source
from .modules import module_files
from .python_routers import with_prefixes
from .types import DYNAMIC

# Folders that hold no source of their own.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "venv")
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "py": "py", "go": "go", "graphql": "graphql", "gql": "graphql"}
SOURCES = "{" + ",".join([*(f"*.{x}" for x in LANGUAGES), "tsconfig*.json"]) + "}"
CALLS = "id string, method string, route string, dynamic boolean, framework string, schema string, ref string, line int, col int"
FIELDS = ["id", "method", "route", "dynamic", "framework", "schema", "ref", "line", "col"]


def read_files(spark: SparkSession, root: str, snapshot: str = "current") -> DataFrame:
    """Snapshot, path (below root), lang, text of every source file below root, in any store Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SOURCES).load(root)
    return named_files(found, root).select(F.lit(snapshot).alias("snapshot"), "path", "lang", "text")


def named_files(found: DataFrame, root: str) -> DataFrame:
    """path (below root), lang and text of binaryFile rows (path, content); no file in an ignored folder."""
    full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.substring_index(full, base.rsplit("/", 1)[-1] + "/", -1), "^/+", "")
    parts = F.split(path, "/")
    inner = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = ~F.exists(inner, lambda p: p.isin(*IGNORED) | F.startswith(p, F.lit(".")))
    kinds = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return found.select(path.alias("path"), F.coalesce(F.try_element_at(kinds, F.regexp_extract("path", r"\.([a-z]+)$", 1)), F.lit("tsconfig")).alias("lang"), F.decode("content", "UTF-8").alias("text")).where(keep)


def in_memory(spark: SparkSession, files: dict[str, str], snapshot: str = "current") -> DataFrame:
    """Sources given as path -> text."""
    rows = [(snapshot, p, "tsconfig" if p.endswith(".json") else LANGUAGES.get(p.rsplit(".", 1)[-1]), t) for p, t in files.items()]
    return spark.createDataFrame(rows, "snapshot string, path string, lang string, text string")


def dealt(files: DataFrame) -> DataFrame:
    """files (with a path), dealt out by path for a scan in Python: a small table of many files is often read by one task."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "path")


def _apply(files: DataFrame, parsers: dict[str, Callable[[str, str], list[dict]]]) -> DataFrame:
    """A row for each parsed item; a file that can't be parsed gives one row with an error and spares the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        names = ["snapshot", "path", *FIELDS, "error"]
        for batch in batches:
            rows: list[tuple] = []
            for snapshot, path, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if lang not in parsers or text is None:
                    continue
                try:
                    for c in parsers[lang](path, text):
                        key = f"{path}:{c['line']}:{c['col']}:{c['method']}:{ts_source.without_holes(c['route'])}"
                        schema = None if c.get("schema") is None else json.dumps(c["schema"])
                        rows.append((snapshot, path, key, c["method"], c["route"], bool(c.get("dynamic")), c["framework"], schema, c.get("ref"), c["line"], c["col"], None))
                except (SyntaxError, ValueError, RecursionError, IndexError, KeyError) as e:
                    rows.append((snapshot, path, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    wanted = dealt(files.select("snapshot", "path", "lang", "text"))
    return wanted.mapInArrow(run, f"snapshot string, path string, {CALLS}, error string")


def client_calls(files: DataFrame) -> DataFrame:
    """HTTP calls of TypeScript, Python and Go sources."""
    rows = parsed(files, "client")
    return fill_constants(resolve_imported(rows.where("error is null").drop("error"), files), files)


def server_handlers(files: DataFrame) -> DataFrame:
    """Handlers of TypeScript, Python and Go sources, with the prefixes of Python routers that mount theirs."""
    rows = parsed(files, "server").where("error is null").drop("error")
    if not files.where("lang = 'py'").isEmpty():
        rows = with_prefixes(rows, files)
    return resolve_imported(rows, files)


PARSERS = {
    "client": {"ts": ts_source.client_calls, "py": python_source.client_calls, "go": go_source.client_calls},
    "server": {"ts": ts_source.server_handlers, "py": python_source.server_handlers, "go": go_source.server_handlers},
}


def parsed(files: DataFrame, side: str) -> DataFrame:
    """Calls (client) or handlers (server) as their own file tells them, and an error for each file that couldn't be read; parsed once."""
    return cut(_apply(files, PARSERS[side]))


def ts_constants(files: DataFrame) -> DataFrame:
    """Snapshot, path, name, key, value of string constants at the top of TypeScript files; key is that of an object's property, or empty."""
    return _names(files, ts_source.constants, "name string, key string, value string")


def fill_constants(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Routes whose imported constants are known, one import away; the others' parts are dynamic."""
    inside = F.regexp_extract_all("route", F.lit(f"{ts_source.HOLE[0]}([^{ts_source.HOLE[1]}]*){ts_source.HOLE[1]}"), F.lit(1))
    holes = rows.select("snapshot", "path", F.explode(F.array_distinct(inside)).alias("hole")).distinct()
    holes = holes.withColumns({"head": F.substring_index("hole", ".", 1), "key": F.when(F.contains("hole", F.lit(".")), F.substring_index("hole", ".", -1)).otherwise("")})
    brought = ts_imports(files).withColumnsRenamed({"snapshot": "i_snapshot", "path": "i_path"})
    named = cut(holes.join(brought, F.expr("snapshot = i_snapshot and path = i_path and head = local")).select("snapshot", "path", "hole", "key", "specifier", "imported"))
    target = cut(module_files(named, files))
    known = ts_constants(among(files, target)).withColumnsRenamed({"snapshot": "c_snapshot", "path": "c_path", "key": "c_key"})
    met = named.join(target, ["snapshot", "path", "specifier"]).join(known, F.expr("snapshot = c_snapshot and file = c_path and imported = name and key = c_key"))
    values = met.groupBy(F.col("snapshot").alias("v_snapshot"), F.col("path").alias("v_path")).agg(F.collect_set(F.struct("hole", "value")).alias("known"))
    joined = rows.join(values, F.expr("snapshot = v_snapshot and path = v_path"), "left")
    of = F.map_from_entries(F.coalesce("known", F.array().cast("array<struct<hole:string,value:string>>")))
    mark = lambda h: F.concat(F.lit(ts_source.HOLE[0]), h, F.lit(ts_source.HOLE[1]))
    route = F.aggregate(F.array_distinct(inside), F.col("route"), lambda r, h: F.replace(r, mark(h), F.coalesce(F.try_element_at(of, h), F.lit(DYNAMIC))))
    filled = joined.withColumn("route", route)
    return filled.select(*[F.contains("route", F.lit(DYNAMIC)).alias("dynamic") if c == "dynamic" else F.col(c) for c in rows.columns])


def among(files: DataFrame, target: DataFrame) -> DataFrame:
    """The files that imports (snapshot, file) lead to: others needn't be scanned for what they export."""
    led = target.select(F.col("snapshot").alias("t_snapshot"), F.col("file").alias("t_path")).distinct()
    return files.join(led, F.expr("snapshot = t_snapshot and path = t_path"), "left_semi")


def _names(files: DataFrame, read: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """snapshot, path and what read finds in each TypeScript file; files that can't be read have nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["snapshot", "path", *[c.split()[0] for c in schema.split(", ")]]
        for batch in batches:
            rows: list[tuple] = []
            for snapshot, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    rows += [(snapshot, path, *[v if isinstance(v, str) else json.dumps(v) for v in r]) for r in read(path, text or "")]
                except (SyntaxError, ValueError, RecursionError, IndexError, KeyError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    return dealt(files.where("lang = 'ts'").select("snapshot", "path", "text")).mapInArrow(run, f"snapshot string, path string, {schema}")


def ts_imports(files: DataFrame) -> DataFrame:
    """Snapshot, path, local, specifier, imported."""
    return _names(files, ts_source.imports, "local string, specifier string, imported string")


def ts_declarations(files: DataFrame) -> DataFrame:
    """Snapshot, path, name, schema of declared object types."""
    return _names(files, ts_source.declarations, "name string, schema string")


def usages(files: DataFrame) -> DataFrame:
    """B2: snapshot, path, line, col, accessed, computed, unguarded of every TypeScript call."""
    rows = _names(files, lambda p, t: [(u,) for u in ts_source.usages(p, t)], "u string")
    kind = "struct<line:int,col:int,accessed:array<string>,computed:boolean,unguarded:array<string>>"
    return rows.select("snapshot", "path", F.from_json("u", kind).alias("u")).select("snapshot", "path", "u.*")


def resolve_imported(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Schemas of types that an import brings in, one hop out, by relative path or alias. Packages are never followed."""
    wanted = rows.where("ref is not null").select(F.col("snapshot").alias("r_snapshot"), F.col("path").alias("r_path"), F.col("ref").alias("r_ref")).distinct()
    if wanted.isEmpty():
        return rows.drop("ref")
    named = cut(ts_imports(files).join(wanted, F.expr("snapshot = r_snapshot and path = r_path and local = r_ref"), "left_semi"))
    target = cut(module_files(named, files))
    declared = ts_declarations(among(files, target)).select(F.col("snapshot").alias("d_snapshot"), F.col("path").alias("d_path"), "name", F.col("schema").alias("i_schema"))
    met = named.join(target, ["snapshot", "path", "specifier"]).join(declared, F.expr("snapshot = d_snapshot and file = d_path and imported = name"))
    best = met.groupBy(F.col("snapshot").alias("i_snapshot"), F.col("path").alias("i_path"), F.col("local").alias("i_ref")).agg(F.min("i_schema").alias("i_schema"))
    out = rows.join(best, F.expr("snapshot = i_snapshot and path = i_path and ref = i_ref"), "left")
    return out.select(*[F.coalesce("i_schema", "schema").alias("schema") if c == "schema" else F.col(c) for c in rows.columns if c != "ref"])


def parse_errors(files: DataFrame) -> DataFrame:
    """Files that a parser gave up on, and why."""
    return reduce(DataFrame.unionByName, [_apply(files, p).where("error is not null").select("snapshot", "path", "error") for p in PARSERS.values()]).distinct()


def graphql_fields(files: DataFrame) -> DataFrame:
    """(path, type, field, kind, name, nullable) of the types in GraphQL files, by regular expressions alone."""
    clean = F.regexp_replace("text", r"#[^\n]*", "")
    blocks = F.regexp_extract_all(clean, F.lit(r"type\s+\w+[^{}]*\{[^{}]*\}"), F.lit(0))
    one = files.where("lang = 'graphql'").select("path", F.explode(blocks).alias("b"))
    named = one.select("path", F.regexp_extract("b", r"type\s+(\w+)", 1).alias("type"), F.explode(F.regexp_extract_all(F.regexp_extract("b", r"\{([^}]*)\}", 1), F.lit(r"\w+\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+"), F.lit(0))).alias("f"))
    raw = F.regexp_extract("f", r":\s*([\w\[\]!]+)$", 1)
    return named.select("path", "type", F.regexp_extract("f", r"^(\w+)", 1).alias("field"), graphql_kind(raw).alias("kind"), graphql_name(raw).alias("name"), (~F.endswith(raw, F.lit("!"))).alias("nullable"))


def graphql_kind(raw: Column) -> Column:
    bare = F.regexp_replace(raw, "!$", "")
    return F.when(F.startswith(bare, F.lit("[")), "array").when(bare.isin("String", "ID", "Int", "Float", "Boolean"), "primitive").otherwise("reference")


def graphql_name(raw: Column) -> Column:
    """The primitive's or reference's name, of a list that of its elements."""
    inner = F.regexp_replace(raw, r"[\[\]!]", "")
    return F.when(inner.isin("String", "ID"), "string").when(inner.isin("Int", "Float"), "number").when(inner == "Boolean", "boolean").otherwise(inner)


def next_app_route(path: Column) -> Column:
    """The route of a Next.js app-router file: what follows the first /app/, without the file, `[x]` as `:x`."""
    below = F.regexp_extract(path, r"(?:^|/)app/(.*?)/?route\.(?:ts|tsx|js|jsx)$", 1)
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(below, "/"), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^\[(\w+)\]$", ":$1")), "/"))
