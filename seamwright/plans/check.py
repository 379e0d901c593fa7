"""End to end: two source trees in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routes import parse_route
from ..operators import diff, graph, impact, matching, typecheck
from ..operators.graph import contract_id
from ..sources.files import client_calls, server_handlers, usages
from .scratch import cut


def check_trees(client_files: DataFrame, server_files: DataFrame, threshold: float = matching.THRESHOLD) -> DataFrame:
    """Findings (client_id, server_id, ord, kind, severity, path, message, expected, actual, file, line, column) of one snapshot."""
    calls, handlers = client_calls(client_files), server_handlers(server_files)
    c = calls.select(F.col("id").alias("client_id"), "method", "route", "dynamic", parse_route(F.col("route")).alias("segments"), F.col("schema").alias("client_schema"), F.col("path").alias("file"), "line", F.col("col").alias("column"))
    s = handlers.select(F.col("id").alias("handler"), "method", "route", parse_route(F.col("route")).alias("segments"), F.col("schema").alias("server_schema"))
    s = s.withColumn("server_id", F.xxhash64("handler"))
    c, s = cut(c), cut(s)
    m = cut(matching.match_routes(c, s, threshold, candidates=True))
    hit = m.where("server_id is not null").join(c.select("client_id", "client_schema"), "client_id").join(s.select("server_id", "server_schema"), "server_id")
    lost = m.where("server_id is null").select("client_id", "reason").join(c.select("client_id", "method", "route"), "client_id")
    found = typecheck.validate_all(hit, lost.join(matching.candidate_routes(m, c, s), "client_id", "left"))
    return found.join(c.select("client_id", "file", "line", "column"), "client_id")


def contracts(handlers: DataFrame) -> DataFrame:
    """One row for each contract of a snapshot; of handlers with one contract id the last by place counts."""
    rows = handlers.select(
        contract_id(F.col("method"), F.col("route")).alias("contract_id"),
        F.concat_ws(" ", "method", "route").alias("name"),
        F.col("path").alias("file"),
        F.lit(100.0).alias("confidence"),
        F.when(F.col("schema").isNotNull(), F.concat(F.lit('{"kind":"object",'), F.substring("schema", 2, 1 << 30))).alias("shape"),
        F.struct("path", "line", "col").alias("ord"),
    )
    values = ["name", "file", "confidence", "shape"]
    return rows.groupBy("contract_id").agg(F.max_by(F.struct(*values), "ord").alias("v")).select("contract_id", "v.*")


def _called(client_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls of a client tree and what their files read of the results: both scanned once, whatever handlers they are matched to."""
    calls = cut(client_calls(client_files))
    c = calls.select(F.col("id").alias("client_id"), "method", parse_route(F.col("route")).alias("segments"), "dynamic", F.col("path").alias("file"), "line", "col")
    u = usages(client_files).select(F.col("path").alias("u_file"), F.col("line").alias("u_line"), F.col("col").alias("u_col"), "accessed", "computed", "unguarded")
    return c, cut(u)


def _consumers(called: tuple[DataFrame, DataFrame], handlers: DataFrame, threshold: float) -> DataFrame:
    """(contract_id, consumer_id, edge and node confidence, resolution, what the call's file reads of its result)."""
    c, u = called
    s = handlers.select("method", "route", parse_route(F.col("route")).alias("segments"), F.xxhash64("id").alias("server_id"))
    m = matching.match_routes(c.select("client_id", "method", "segments", "dynamic"), s.select("server_id", "method", "segments"), threshold).where("server_id is not null")
    full = m.join(s.select("server_id", contract_id(F.col("method"), F.col("route")).alias("contract_id")), "server_id").join(c.select("client_id", "dynamic", "file", "line", "col"), "client_id")
    full = full.join(u, F.expr("file = u_file and line = u_line and col = u_col"), "left")
    edge = F.col("confidence") * 100
    return full.select(
        "contract_id",
        F.col("client_id").alias("consumer_id"),
        (F.col("dynamic") | F.coalesce("computed", F.lit(False))).alias("dynamic"),
        "accessed",
        "unguarded",
        F.when(F.col("strategy") == "exact", "exact").otherwise("fuzzy").alias("resolution"),
        edge.alias("edge_confidence"),
        edge.alias("node_confidence"),
    )


def impact_trees(client_files: DataFrame, base_server: DataFrame, current_server: DataFrame, base_client: DataFrame | None = None, threshold: float = matching.THRESHOLD) -> DataFrame:
    """F1, I1, I2 end to end: impacts of the changes between two server snapshots on the calls of a client tree.

    Consumers of a removed contract are looked up in the base, where the dependency existed.
    """
    base, current, changes = snapshot_changes(base_server, current_server)
    return snapshot_impacts(changes, client_files, base, current, base_client, threshold)


def snapshot_changes(base_server: DataFrame, current_server: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Handlers of both snapshots and the changes between them."""
    base, current = cut(server_handlers(base_server)), cut(server_handlers(current_server))
    return base, current, cut(diff.compare_graphs(contracts(base), contracts(current)))


def place_of(consumer_id: Column) -> Column:
    """STRUCT<path, line, column, key> of a consumer: its call's place."""
    part = lambda k: F.regexp_extract(consumer_id, r"^(.*?):([0-9]+):([0-9]+):[A-Z]+:", k)
    return F.struct(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), F.concat_ws(":", part(1), part(2), part(3)).alias("key"))


def graph_faults(client_files: DataFrame, server_files: DataFrame, threshold: float = matching.THRESHOLD) -> DataFrame:
    """B1, B11 end to end: faults of the graph that two source trees give."""
    calls, handlers = cut(client_calls(client_files)), cut(server_handlers(server_files))
    c = calls.select(F.col("id").alias("client_id"), "method", "route", parse_route(F.col("route")).alias("segments"), "dynamic", F.col("path").alias("file"), F.lit(False).alias("computed"))
    s = handlers.select(F.xxhash64("id").alias("server_id"), "method", "route", parse_route(F.col("route")).alias("segments"), F.col("path").alias("file"), F.col("schema").alias("shape"))
    m = cut(matching.match_routes(c, s, threshold))
    nodes = graph.build_nodes(c, s, m).withColumn("ord", F.xxhash64("origin"))
    edges = graph.build_edges(s, m).withColumn("ord", F.xxhash64("id"))
    return graph.validate_graph(nodes, edges)


def snapshot_impacts(changes: DataFrame, client_files: DataFrame, base: DataFrame, current: DataFrame, base_client: DataFrame | None, threshold: float) -> DataFrame:
    listed = F.transform("field_changes", lambda c: F.struct(F.regexp_replace(c["path"], r"^root\.", "").alias("path"), c["kind"].alias("kind"), diff.widened(c).alias("widened")))
    changed = changes.select("contract_id", F.col("kind").alias("change_kind"), listed.alias("changes"))
    removed, called = F.col("change_kind") == "removed", _called(client_files)
    found = changed.where(~removed).join(_consumers(called, current, threshold), "contract_id")
    if not changed.where(removed).isEmpty():
        before = called if base_client is None else _called(base_client)
        found = found.unionByName(changed.where(removed).join(_consumers(before, base, threshold), "contract_id"))
    return impact.dedupe_impacts(impact.classify_impacts(found.withColumn("ord", F.lit(0))))
