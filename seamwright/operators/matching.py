"""Route matching (J1-J6): exact by equi-join, then scored fuzzy matching with a margin.

clients: client_id, method, segments, dynamic. servers: server_id, method, segments. Extra columns are
kept on neither side; join them back by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routes import exact_key, explain_route, round_half_up, route_score

THRESHOLD, MARGIN = 0.6, 0.05


def exact_candidates(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """One row for each client with exact matches: how many, and the smallest server id."""
    c = clients.select("client_id", "method", F.size("segments").alias("depth"), exact_key(F.col("segments")).alias("key"))
    s = servers.select("server_id", "method", F.size("segments").alias("depth"), exact_key(F.col("segments")).alias("key"))
    # equal routes are counted before the join, so a route that many handlers share makes one row
    s = s.groupBy("method", "depth", "key").agg(F.count(F.lit(1)).alias("n_exact"), F.min("server_id").alias("server_id"))
    return c.join(s, ["method", "depth", "key"]).select("client_id", "n_exact", "server_id")


def least_ratio(least: float) -> float:
    """The depth ratio r below which no pair scores `least`: segments score 1 at most, so a pair's score is at most r x (0.7 + 0.3 r)."""
    return (math.sqrt(0.49 + 1.2 * max(least, 0.0)) - 0.7) / 0.6 - 1e-9


def fuzzy_ranked(clients: DataFrame, servers: DataFrame, score: Callable[[Column, Column], Column] = route_score, least: float | None = None) -> DataFrame:
    """Best and second score, and their servers, of every given client.

    Scores are computed once for each distinct pair of routes of a method. Ties go to the smaller server id.
    With `least` (for route_score only) pairs of depths that can't reach it are not formed; a client all of whose pairs are such has no row.
    """
    c = clients.select("client_id", "method", "segments")
    twin = Window.partitionBy("method", "segments").orderBy("server_id")
    s = servers.withColumn("nth", F.row_number().over(twin)).where("nth <= 2").groupBy("method", F.col("segments").alias("server_segments"))
    s = s.agg(F.min("server_id").alias("server_id"), F.max(F.when(F.col("nth") == 2, F.col("server_id"))).alias("twin"))
    routes = c.select("method", "segments").distinct()
    keys = ["method"]
    if least is not None:
        r, depth = least_ratio(least), F.size("segments")
        routes = routes.withColumn("depth", F.explode(F.sequence(F.ceil(depth * r).cast("int"), F.floor(depth / F.lit(r)).cast("int"))))
        s, keys = s.withColumn("depth", F.size("server_segments")), ["method", "depth"]
    scored = routes.join(s, keys).select("method", "segments", "server_id", "twin", score(F.col("segments"), F.col("server_segments")).alias("score"))
    order = Window.partitionBy("method", "segments").orderBy(F.desc("score"), "server_id")
    two = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    best = two.groupBy("method", "segments").agg(
        F.max(F.when(F.col("rank") == 1, F.col("server_id"))).alias("server_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("twin"))).alias("twin"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") == 2, F.col("server_id"))).alias("second_id"),
    )
    best = best.withColumns({"second": F.when(F.col("twin").isNotNull(), F.col("best")).otherwise(F.col("second")), "second_id": F.coalesce("twin", "second_id")}).drop("twin")
    return c.join(best, [c["method"].eqNullSafe(best["method"]), c["segments"].eqNullSafe(best["segments"])]).select("client_id", "server_id", "best", "second", "second_id")


def match_routes(clients: DataFrame, servers: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, score: Callable[[Column, Column], Column] = route_score, candidates: bool = False) -> DataFrame:
    """One row for each client: server_id, confidence, strategy; or a reason (J5) why it has none.

    candidates: with an array of (server_id, confidence), best first, of a call that scoring left unresolved. Without them only
    pairs that may score threshold - margin are formed, as no other can be accepted or make an accepted one ambiguous.
    """
    exact = exact_candidates(clients, servers)
    base = clients.select("client_id", "method", "segments", "dynamic").join(exact.withColumnRenamed("server_id", "exact_id"), "client_id", "left")
    methods = servers.select(F.col("method").alias("known")).distinct()
    base = base.join(methods, base["method"] == methods["known"], "left")
    opaque = ~F.exists("segments", lambda x: x["kind"] == "static")
    open_ = base.where(F.col("known").isNotNull() & ~opaque & F.col("n_exact").isNull() & F.col("dynamic"))
    bounded = not candidates and score is route_score and threshold - margin > 0.01
    fuzzy = fuzzy_ranked(open_, servers, score, threshold - margin if bounded else None)
    all_ = base.join(fuzzy, "client_id", "left")
    close = F.col("second").isNotNull() & (F.col("best") - F.col("second") < margin)
    reason = (
        F.when(F.col("known").isNull(), "no-same-method-candidates")
        .when(opaque, "opaque-dynamic-route")
        .when(F.col("n_exact") > 1, "multiple-exact-matches")
        .when(F.col("n_exact") == 1, F.lit(None).cast("string"))
        .when(~F.col("dynamic"), "no-dynamic-route")
        .when(F.coalesce("best", F.lit(0.0)) < threshold, "below-threshold")
        .when(close, "ambiguous")
    )
    out = all_.withColumn("reason", reason)
    scored = F.col("reason").isin("below-threshold", "ambiguous")
    item = lambda server, value: F.when(F.col(server).isNotNull(), F.struct(F.col(server).alias("server_id"), round_half_up(F.col(value), 3).alias("confidence")))
    named = [F.when(scored, F.array_compact(F.array(item("server_id", "best"), item("second_id", "second")))).alias("candidates")] if candidates else []
    matched, is_exact = F.col("reason").isNull(), F.col("n_exact") == 1
    return out.select(
        "client_id",
        F.when(matched & is_exact, F.col("exact_id")).when(matched, F.col("server_id")).alias("server_id"),
        F.when(matched & is_exact, F.lit(1.0)).when(matched, round_half_up(F.col("best"), 3)).alias("confidence"),
        F.when(matched & is_exact, "exact").when(matched, "fuzzy-sequence").alias("strategy"),
        "reason",
        *named,
    )


def candidate_routes(matches: DataFrame, clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client_id and candidates ARRAY<STRUCT<route, confidence>> of unresolved calls: the two best scored, or all handlers that are exact.

    matches: with candidates. clients: client_id, method, segments. servers: server_id, method, segments, route.
    """
    scored = matches.where("candidates is not null").select("client_id", F.posexplode("candidates").alias("at", "c")).select("client_id", "at", F.col("c.server_id").alias("server_id"), F.col("c.confidence").alias("confidence"))
    scored = scored.join(servers.select("server_id", "route"), "server_id").select("client_id", "at", "route", "confidence")
    many = matches.where("reason = 'multiple-exact-matches'").select("client_id").join(clients.select("client_id", "method", "segments"), "client_id")
    keyed = lambda x, *more: x.select(*more, "method", F.size("segments").alias("depth"), exact_key(F.col("segments")).alias("key"))
    at = F.row_number().over(Window.partitionBy("client_id").orderBy("server_id"))
    exact = keyed(many, "client_id").join(keyed(servers, "server_id", "route"), ["method", "depth", "key"]).select("client_id", at.alias("at"), "route", F.lit(1.0).alias("confidence"))
    rows = F.array_sort(F.collect_list(F.struct("at", "route", "confidence")))  # the handlers of one route
    return scored.unionByName(exact).groupBy("client_id").agg(F.transform(rows, lambda x: F.struct(x["route"].alias("route"), x["confidence"].alias("confidence"))).alias("candidates"))


def explain_matches(matches: DataFrame, clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Evidence by segment of every match."""
    c = clients.select("client_id", F.col("segments").alias("cs"))
    s = servers.select("server_id", F.col("segments").alias("ss"))
    return matches.where("server_id is not null").join(c, "client_id").join(s, "server_id").select("client_id", "server_id", F.explode(explain_route(F.col("cs"), F.col("ss"))).alias("e")).select("client_id", "server_id", "e.*")
