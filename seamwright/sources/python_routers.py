"""Routers mounted in other Python files (P9-P13): small facts of each file, joined to prefixes.

A file gives its imports, its `include_router` calls, its string constants and its routers as flat rows. Modules are
resolved to files by dotted suffixes, settings-like prefixes by one more join, and prefixes are handed down the mounting graph in rounds.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .python_source import imports, prefixes, template

#: Mounting is followed so many levels deep; a cycle of routers ends there.
ROUNDS = 10

_FACTS = "snapshot string, path string, kind string, ord int, name string, object string, attribute string, value string"


def facts_of(text: str) -> Iterator[tuple[str, str | None, str | None, str | None, str | None]]:
    """(kind, name, object, attribute, value): import, router, constant or mount.

    import: local name, module, symbol. constant: name, its string. mount: the mounting router, the mounted one as object and
    attribute, its prefix, as a string or (in a row of kind `mount-by`) as object.attribute.
    """
    tree = ast.parse(text)
    for local, module, symbol in imports(text):
        # `import a.b` is known by its last part here
        yield "import", local.rsplit(".", 1)[-1], module, symbol or None, None
    for name in prefixes(tree):
        yield "router", name, None, None, None
    for n in ast.walk(tree):
        if isinstance(n, (ast.Assign, ast.AnnAssign)):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                for t in targets:
                    if isinstance(t, ast.Name):
                        yield "constant", t.id, None, None, n.value.value
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "include_router" and isinstance(n.func.value, ast.Name) and n.args:
            mounted, given = n.args[0], next((k.value for k in n.keywords if k.arg == "prefix"), None)
            if isinstance(mounted, ast.Attribute) and isinstance(mounted.value, ast.Name):
                place = (mounted.value.id, mounted.attr)
            elif isinstance(mounted, ast.Name):
                place = (mounted.id, None)
            else:
                continue
            by = isinstance(given, ast.Attribute) and isinstance(given.value, ast.Name)
            value = f"{given.value.id}.{given.attr}" if by else (template(given) if given is not None else None) or ""
            yield "mount-by" if by else "mount", n.func.value.id, *place, value


def facts(files: DataFrame) -> DataFrame:
    """Facts of every Python file; files that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FACTS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for snapshot, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    rows += [(snapshot, path, f[0], k, *f[1:]) for k, f in enumerate(facts_of(text or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            kinds = [pa.int32() if n == "ord" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.where("lang = 'py'").select("snapshot", "path", "text").mapInArrow(run, _FACTS)


def dotted(path: Column) -> Column:
    """The module that a file is, by its path below the root."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(bare, r"(^|\.)__init__$", "")


def resolve_modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """P10: asked (snapshot, module) with file: the module's, else that of the longest dotted suffix that is one."""
    known = files.where("lang = 'py'").select("snapshot", F.col("path").alias("file"), dotted(F.col("path")).alias("suffix")).where("suffix <> ''")
    known = known.groupBy("snapshot", "suffix").agg(F.min("file").alias("file"))
    parts = F.split("module", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    tried = asked.select("snapshot", "module").distinct().select("snapshot", "module", F.posexplode(tails).alias("drop", "suffix"))
    return tried.join(known, ["snapshot", "suffix"]).groupBy("snapshot", "module").agg(F.min_by("file", "drop").alias("file"))


def router_edges(files: DataFrame) -> DataFrame:
    """Snapshot, ord (path and place), mounting file and router, mounted file and router, prefix."""
    every = cut(facts(files))
    mounts = every.where("kind in ('mount', 'mount-by')").select("snapshot", "path", "ord", F.col("kind").alias("how"), F.col("name").alias("mounting"), "object", "attribute", "value")
    brought = every.where("kind = 'import'").groupBy("snapshot", "path", "name").agg(F.max_by(F.struct(F.col("object").alias("module"), F.col("attribute").alias("symbol")), "ord").alias("i"))
    brought = brought.select(F.col("snapshot").alias("i_snapshot"), F.col("path").alias("i_path"), F.col("name").alias("i_name"), F.col("i.module").alias("module"), F.col("i.symbol").alias("symbol"))
    local = every.where("kind = 'router'").select(F.col("snapshot").alias("l_snapshot"), F.col("path").alias("l_path"), F.col("name").alias("l_name")).distinct()
    named = mounts.join(brought, F.expr("snapshot = i_snapshot and path = i_path and object = i_name"), "left").join(local, F.expr("snapshot = l_snapshot and path = l_path and object = l_name"), "left")
    # users.router: the module may be a package's member; router: the symbol of a module
    module = F.when(F.col("attribute").isNotNull(), F.concat_ws(".", "module", "symbol")).when(F.col("symbol").isNotNull(), F.col("module"))
    own = F.col("attribute").isNull() & F.col("l_name").isNotNull()
    named = named.withColumns({"module": F.when(~own, module), "own": own}).select("snapshot", "path", "ord", "how", "mounting", "object", "attribute", "value", "module", "symbol", "own")
    # a prefix that is settings.NAME: the constant of that name in the file that `settings` comes from
    value = named.where("how = 'mount-by'").select("snapshot", "path", F.col("value").alias("reference")).distinct()
    value = value.withColumns({"head": F.substring_index("reference", ".", 1), "name": F.substring_index("reference", ".", -1)})
    value = value.join(brought.select(F.col("i_snapshot"), "i_path", "i_name", F.col("module").alias("v_module"), F.col("symbol").alias("v_symbol")), F.expr("snapshot = i_snapshot and path = i_path and head = i_name and v_symbol is not null"))
    wanted = named.select("snapshot", "module").unionByName(value.select("snapshot", F.col("v_module").alias("module"))).where("module is not null")
    modules = cut(resolve_modules(wanted, files))
    constants = every.where("kind = 'constant'").groupBy("snapshot", F.col("path").alias("c_path"), F.col("name").alias("c_name")).agg(F.min_by("value", "ord").alias("constant"))
    value = value.select("snapshot", "path", "reference", "name", "v_module").join(modules.select("snapshot", F.col("module").alias("v_module"), F.col("file").alias("v_file")), ["snapshot", "v_module"])
    value = value.join(constants.withColumnRenamed("snapshot", "c_snapshot"), F.expr("snapshot = c_snapshot and v_file = c_path and name = c_name"))
    value = value.select(F.col("snapshot").alias("r_snapshot"), F.col("path").alias("r_path"), "reference", "constant")
    out = named.join(modules, ["snapshot", "module"], "left").join(value, F.expr("how = 'mount-by' and snapshot = r_snapshot and path = r_path and value = reference"), "left")
    mounted_file = F.when(F.col("own"), F.col("path")).otherwise(F.col("file"))
    mounted = F.when(F.col("own"), F.col("object")).otherwise(F.coalesce("attribute", "symbol"))
    prefix = F.when(F.col("how") == "mount-by", F.coalesce("constant", F.lit(""))).otherwise(F.col("value"))
    rows = out.select("snapshot", F.struct("path", "ord").alias("ord"), F.col("path").alias("mounting_file"), "mounting", mounted_file.alias("mounted_file"), mounted.alias("mounted"), prefix.alias("prefix"))
    return rows.where("mounted_file is not null and mounted is not null")


def router_prefixes(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(snapshot, file, router, prefix) that each mounted router gets from all levels above it.

    Each round gives every mounted router the mounting one's prefix of the round before and the mount's own; a router mounted
    more than once gets all of them, one after the other in the order of the mounts. Rounds end when nothing changes.
    """
    edges = cut(edges)
    now = None
    for _ in range(rounds):
        each = edges.select("snapshot", "ord", "mounted_file", "mounted", F.col("prefix").alias("given"))
        if now is not None:
            above = now.select(F.col("snapshot").alias("a_snapshot"), F.col("file").alias("a_file"), F.col("router").alias("a_router"), F.col("prefix").alias("above"))
            each = edges.join(above, F.expr("snapshot = a_snapshot and mounting_file = a_file and mounting = a_router"), "left")
            each = each.select("snapshot", "ord", "mounted_file", "mounted", F.concat(F.coalesce("above", F.lit("")), "prefix").alias("given"))
        ordered = F.array_sort(F.collect_list(F.struct("ord", "given")))  # the mounts of one router
        new = each.groupBy("snapshot", F.col("mounted_file").alias("file"), F.col("mounted").alias("router")).agg(F.array_join(F.transform(ordered, lambda x: x["given"]), "").alias("prefix"))
        new = cut(new)
        if now is not None and new.exceptAll(now).isEmpty():
            return new
        now = new
    return now


def with_prefixes(handlers: DataFrame, files: DataFrame) -> DataFrame:
    """handlers (snapshot, path, route, ref = the router's variable) of Python files with the prefixes of routers that mount theirs."""
    p = router_prefixes(router_edges(files)).select(F.col("snapshot").alias("p_snapshot"), F.col("file").alias("p_file"), F.col("router").alias("p_router"), F.col("prefix").alias("p_prefix"))
    out = handlers.join(p, F.expr("snapshot = p_snapshot and path = p_file and ref = p_router"), "left")
    return out.select(*[F.concat(F.coalesce("p_prefix", F.lit("")), "route").alias("route") if c == "route" else F.col(c) for c in handlers.columns])
