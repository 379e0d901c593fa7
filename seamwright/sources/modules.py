"""Where TypeScript imports lead (X2-X7, X9, X10): relative paths and tsconfig aliases, as joins on the table of files.

Settings files are rows of the files table (lang `tsconfig`); packages are never followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut

# What is tried after an import's path, in order.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx")
#: Levels of folders above a file, and of `extends`, that are looked at.
LEVELS, EXTENDS = 20, 10
_CONFIG = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>,extends:string>"


def join_path(folder: Column, relative: Column) -> Column:
    """Folder and a path relative to it, without `.` and `..`."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, empty, lambda kept, p: F.when(p == "..", up(kept)).otherwise(F.concat(kept, F.array(p)))), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def strip_json_comments(text: Column) -> Column:
    """Without comments and trailing commas; comment marks within strings are not told apart."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r"(?m)(^|[^:])//.*$", "$1")
    return F.regexp_replace(bare, r",(\s*[}\]])", "$1")


def settings(files: DataFrame) -> DataFrame:
    """Snapshot, path, base (folder), paths (entries in order), extends (a path below the root, or null) of each settings file."""
    c = F.from_json(strip_json_comments(F.col("text")), _CONFIG)
    rows = files.where("lang = 'tsconfig'").select("snapshot", "path", c.alias("c"))
    here, up = folder_of(F.col("path")), F.col("c.extends")
    base = F.when(F.col("c.compilerOptions.baseUrl").isNotNull(), join_path(here, F.col("c.compilerOptions.baseUrl"))).otherwise(here)
    extends = F.when(F.startswith(up, F.lit(".")), join_path(here, F.when(F.endswith(up, F.lit(".json")), up).otherwise(F.concat(up, F.lit(".json")))))
    return rows.select("snapshot", "path", base.alias("base"), F.map_entries("c.compilerOptions.paths").alias("paths"), extends.alias("extends"))


def aliases(files: DataFrame) -> DataFrame:
    """Snapshot, path, base, paths of each settings file; one without paths has those of the nearest it extends that has any."""
    every = cut(settings(files))
    has = F.coalesce(F.size("paths"), F.lit(0)) > 0
    up = every.select(F.col("snapshot").alias("u_snapshot"), F.col("path").alias("u_path"), F.col("base").alias("u_base"), F.col("paths").alias("u_paths"), F.col("extends").alias("u_extends"))
    now = every
    for _ in range(EXTENDS):
        if now.where(~has & F.col("extends").isNotNull()).isEmpty():
            break
        met = now.join(up, F.expr("snapshot = u_snapshot and extends = u_path"), "left")
        pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b)).alias(a)
        now = cut(met.select("snapshot", "path", pick("base", "u_base"), F.when(has, F.lit(None)).otherwise(F.col("u_extends")).alias("extends"), pick("paths", "u_paths")))
    return now.where(has).select("snapshot", "path", "base", "paths")


def nearest_settings(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (snapshot, folder) with the path of the nearest tsconfig.json at or above each."""
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.transform(F.sequence(F.size(parts), F.greatest(F.size(parts) - LEVELS + 1, F.lit(0)), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tried = folders.select("snapshot", "folder", F.posexplode(above).alias("up", "at"))
    known = files.where("lang = 'tsconfig'").select("snapshot", F.col("path").alias("settings"), folder_of(F.col("path")).alias("at")).where("settings rlike '(^|/)tsconfig\\\\.json$'")
    return tried.join(known, ["snapshot", "at"]).groupBy("snapshot", "folder").agg(F.min_by("settings", "up").alias("settings"))


def module_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Asked (snapshot, path, specifier) with file, the module's source, where it is one of the table's.

    Of a settings file's aliases an import only meets those whose letters before the star it starts with.
    """
    asked = asked.select("snapshot", "path", "specifier").distinct()
    endings = lambda base: F.transform(F.array(*[F.lit(x) for x in SUFFIXES]), lambda x: F.concat(base, x))
    zero = F.lit(0)
    relative = join_path(folder_of(F.col("path")), F.regexp_replace("specifier", r"\.js$", ""))
    near = asked.where("startswith(specifier, '.')").select("snapshot", "path", "specifier", zero.alias("pattern"), zero.alias("target"), F.posexplode(endings(relative)).alias("ending", "file"))
    bare = asked.where("not startswith(specifier, '.')").withColumn("folder", folder_of(F.col("path")))
    of = nearest_settings(bare.select("snapshot", "folder").distinct(), files)
    known = aliases(files).select("snapshot", F.col("path").alias("settings"), "base", F.posexplode("paths").alias("pattern", "entry"))
    star = F.locate("*", F.col("entry.key"))
    known = known.withColumn("star", star > 0).withColumn("head", F.when(star > 0, F.substr("entry.key", F.lit(1), star - 1)).otherwise(F.col("entry.key")))
    known = known.withColumn("tail", F.when(star > 0, F.substr("entry.key", star + 1)).otherwise(F.lit("")))
    # an index of patterns by their first letters: an import asks for its own beginnings, of lengths that some pattern has
    sizes = known.groupBy("snapshot", "settings").agg(F.collect_set(F.length("head")).alias("sizes"))
    spec, head, tail, star = F.col("specifier"), F.col("head"), F.col("tail"), F.col("star")
    asks = bare.join(of, ["snapshot", "folder"]).join(sizes, ["snapshot", "settings"]).withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("specifier"))))
    each = asks.withColumn("head", F.substr("specifier", F.lit(1), F.col("size"))).join(known, ["snapshot", "settings", "head"])
    fits = F.when(star, F.endswith(spec, tail) & (F.length(spec) >= F.length(head) + F.length(tail))).otherwise(spec == head)
    part = F.when(star, F.substr(spec, F.length(head) + 1, F.length(spec) - F.length(head) - F.length(tail))).otherwise(F.lit(""))
    hit = each.where(fits).select("snapshot", "path", "specifier", "base", "pattern", part.alias("part"), F.posexplode("entry.value").alias("target", "to"))
    at = F.locate("*", F.col("to"))
    filled = F.when(at > 0, F.concat(F.substr(F.col("to"), F.lit(1), at - 1), "part", F.substr(F.col("to"), at + 1))).otherwise(F.col("to"))
    far = hit.select("snapshot", "path", "specifier", "pattern", "target", F.posexplode(endings(join_path(F.col("base"), filled))).alias("ending", "file"))
    there = files.where("lang = 'ts'").select(F.col("snapshot").alias("f_snapshot"), F.col("path").alias("f_path"))
    met = near.unionByName(far).join(there, F.expr("snapshot = f_snapshot and file = f_path"))
    return met.groupBy("snapshot", "path", "specifier").agg(F.min_by("file", F.struct("pattern", "target", "ending")).alias("file"))
