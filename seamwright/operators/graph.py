"""Provenance graph as two relations.

nodes: id, type, name, file, confidence, ... edges: id, src, dst, relation, confidence, resolution.
`ord` is the order of insertion: of several rows with one id the last counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routes import round_half_up
from ..plans.scratch import cut

LEVELS = ("UNKNOWN", "POTENTIAL", "STRONG", "PROVEN")


def contract_id(method: Column, raw: Column) -> Column:
    """Raw text, so `/x/:id` and `/x/{id}` are two contracts."""
    return F.concat_ws(":", F.lit("contract"), method, raw)


def build_nodes(clients: DataFrame, servers: DataFrame, matches: DataFrame) -> DataFrame:
    """B1: contract and producer nodes of handlers, consumer nodes of calls.

    clients: client_id, method, route, file, dynamic, computed (computed access to the result). servers: server_id, method,
    route, file, shape. A consumer's confidence is that of its match, rounded, 0 without one.
    """
    cid = contract_id(F.col("method"), F.col("route"))
    contract = servers.select(cid.alias("id"), F.lit("contract").alias("type"), F.concat_ws(" ", "method", "route").alias("name"), "file", F.lit(100.0).alias("confidence"), "shape", F.lit(False).alias("dynamic"), F.col("server_id").cast("string").alias("origin"))
    producer = servers.select(F.concat(F.lit("producer:"), F.col("server_id")).alias("id"), F.lit("producer").alias("type"), F.concat_ws(" ", "method", "route").alias("name"), "file", F.lit(100.0).alias("confidence"), F.lit(None).cast("string").alias("shape"), F.lit(False).alias("dynamic"), F.col("server_id").cast("string").alias("origin"))
    matched = matches.where("server_id is not null").select(F.col("client_id").alias("m_id"), F.col("confidence").alias("m"))
    c = clients.join(matched, clients["client_id"] == matched["m_id"], "left")
    consumer = c.select(F.concat(F.lit("consumer:"), F.col("client_id")).alias("id"), F.lit("consumer").alias("type"), F.concat_ws(" ", "method", "route").alias("name"), "file", round_half_up(F.coalesce("m", F.lit(0.0)) * 100, 0).alias("confidence"), F.lit(None).cast("string").alias("shape"), (F.col("dynamic") | F.col("computed")).alias("dynamic"), F.col("client_id").cast("string").alias("origin"))
    return contract.unionByName(producer).unionByName(consumer)


def build_edges(servers: DataFrame, matches: DataFrame) -> DataFrame:
    """B1: produces edges (exact, 100) and consumes edges, whose confidence isn't rounded."""
    cid = contract_id(F.col("method"), F.col("route"))
    made = servers.select(F.concat(F.lit("produces:"), F.col("server_id")).alias("id"), F.concat(F.lit("producer:"), F.col("server_id")).alias("src"), cid.alias("dst"), F.lit("produces").alias("relation"), F.lit(100.0).alias("confidence"), F.lit("exact").alias("resolution"))
    m = matches.where("server_id is not null").select("client_id", "server_id", F.col("confidence").alias("m"), "strategy")
    used = m.join(servers.select("server_id", cid.alias("contract")), "server_id")
    used = used.select(F.concat(F.lit("consumes:"), F.col("client_id")).alias("id"), F.col("contract").alias("src"), F.concat(F.lit("consumer:"), F.col("client_id")).alias("dst"), F.lit("consumes").alias("relation"), (F.col("m") * 100).alias("confidence"), F.when(F.col("strategy") == "exact", "exact").otherwise("fuzzy").alias("resolution"))
    return made.unionByName(used)


def last_write(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of several rows with one key the last; `repeats` tells how many there were besides."""
    values = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*values), F.col("ord")).alias("v"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return out.select(key, "v.*", "repeats")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col("id").alias("node")).distinct()
    return reduce(DataFrame.unionByName, [edges.join(ids, edges[end] == ids["node"], "left_anti").select("id", F.lit(end).alias("end")) for end in ("src", "dst")])


def direct_consumers(edges: DataFrame) -> DataFrame:
    """(contract, consumer)."""
    return edges.where("relation = 'consumes'").select(F.col("src").alias("contract"), F.col("dst").alias("consumer")).distinct()


def producers(edges: DataFrame) -> DataFrame:
    """(contract, producer)."""
    return edges.where("relation = 'produces'").select(F.col("dst").alias("contract"), F.col("src").alias("producer")).distinct()


def shortest_paths(sources: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hops, edge, pred) of every node reachable from each source, itself left out: a tree of shortest paths.

    Breadth first by frontiers: each round joins new nodes to their outgoing edges and drops what was reached before, so it ends on
    cycles. Of equally short paths that of the smallest sequence of edge ids counts, as discovery in the order of sorted edges gives it.
    Sequences of a round compare as (rank of the predecessor, edge id), and sorting by these ranks the round's nodes for the
    next; so a row is of one width, however long its path. path_hops rebuilds the paths that are asked for.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("id").alias("edge"))
    front = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("long").alias("rank")).distinct())
    seen, rounds = front.select("source", "node"), 0
    tree = front.select("source", "node", F.lit(0).alias("hops"), F.col("node").cast("string").alias("edge"), F.col("node").alias("pred")).where("false")
    while not front.isEmpty() and (most is None or rounds < most):
        rounds += 1
        moved = front.select("source", "node", "rank").join(step, F.col("node") == F.col("at")).select("source", F.col("next").alias("node"), F.struct("rank", "edge", F.col("at").alias("pred")).alias("by"))
        new = moved.groupBy("source", "node").agg(F.min("by").alias("by")).join(seen, ["source", "node"], "left_anti")
        # numbers in the order of a distributed sort: only their order counts
        ranked = new.orderBy("source", "by.rank", "by.edge", "node").withColumn("rank", F.monotonically_increasing_id())
        front = cut(ranked.select("source", "node", "rank", "by.edge", "by.pred"))
        seen = seen.unionByName(front.select("source", "node"))
        tree = tree.unionByName(front.select("source", "node", F.lit(rounds).alias("hops"), "edge", "pred"))
        if rounds % 8 == 0:
            seen, tree = cut(seen), cut(tree)
    return tree


def path_hops(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """(source, node, hops, at, edge) of the asked (source, node): a row for each hop of its path, `at` from 0.

    By pointer jumping: a table of ancestors 2, 4, 8, ... hops up is made by joining the one before with itself, and every hop finds its
    node by the bits of its distance, so the rounds grow with the logarithm of the longest path.
    """
    tree = cut(tree)
    up = tree.select(F.col("source").alias("js"), F.col("node").alias("jn"), F.col("pred").alias("up"))
    rows = asked.select("source", "node").distinct().join(tree.select("source", "node", "hops"), ["source", "node"])
    rows = rows.withColumns({"left": F.explode(F.sequence(F.lit(0), F.col("hops") - 1)), "here": F.col("node")})
    longest = tree.agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0]
    for bit in range(max(longest - 1, 0).bit_length()):
        asks = (F.shiftright("left", bit) % 2 == 1) & (F.col("source") == F.col("js")) & (F.col("here") == F.col("jn"))
        rows = rows.join(up, asks, "left").withColumn("here", F.coalesce("up", "here")).drop("js", "jn", "up")
        second = up.select(F.col("js").alias("s2"), F.col("jn").alias("n2"), F.col("up").alias("further"))
        up = cut(up.join(second, F.expr("js = s2 and up = n2")).select("js", "jn", F.col("further").alias("up")))
    edge = tree.select(F.col("source").alias("es"), F.col("node").alias("en"), "edge")
    return rows.join(edge, F.expr("source = es and here = en")).select("source", "node", "hops", (F.col("hops") - 1 - F.col("left")).alias("at"), "edge")


def transitive_consumers(contracts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(contract, consumer, hops) of nodes reached over any relation that are consumers or end a consumes edge."""
    reached = shortest_paths(contracts, edges)
    typed = nodes.where("type = 'consumer'").select(F.col("id").alias("node")).distinct()
    ended = edges.where("relation = 'consumes'").select(F.col("dst").alias("node")).distinct()
    wanted = typed.unionByName(ended).distinct()
    return reached.join(wanted, "node", "left_semi").select(F.col("source").alias("contract"), F.col("node").alias("consumer"), "hops")


def proof_level(resolution: Column, confidence: Column, inferred: Column, dynamic: Column) -> Column:
    """B13."""
    c = confidence
    over = lambda least, yes, no: F.when(c >= least, yes).otherwise(no)
    return (
        F.when(dynamic, "UNKNOWN")
        .when(resolution.isNull(), over(50, "POTENTIAL", "UNKNOWN"))
        .when(resolution == "inferred", over(80, "POTENTIAL", "UNKNOWN"))
        .when((resolution == "exact") & inferred, over(80, "STRONG", "POTENTIAL"))
        .when(resolution == "exact", F.when(c >= 95, "PROVEN").when(c >= 80, "STRONG").otherwise("POTENTIAL"))
        .when(resolution.isin("symbol", "type"), F.when(c >= 80, "STRONG").when(c >= 40, "POTENTIAL").otherwise("UNKNOWN"))
        .otherwise(over(40, "POTENTIAL", "UNKNOWN"))
    )


def proof_rank(level: Column) -> Column:
    """0 to 3; the least rank of a chain is its weakest link."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def classify_paths(asked: DataFrame, tree: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Category, weakest proof level and rendering of the paths to the asked (source, node) in a tree of shortest paths."""
    e = edges.select(F.col("id").alias("edge"), F.col("dst").alias("to"), "relation", "resolution", proof_rank(proof_level(F.col("resolution"), F.col("confidence"), F.lit(False), F.lit(False))).alias("rank"))
    names = nodes.select(F.col("id").alias("nid"), "name")
    hop = path_hops(asked, tree).join(e, "edge").join(names, F.col("to") == F.col("nid"), "left")
    grouped = hop.groupBy("source", "node", "hops").agg(
        F.min("rank").alias("weakest"),
        F.max(F.col("resolution").isin("fuzzy", "heuristic")).alias("loose"),
        F.max_by("relation", "at").alias("last"),
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "to").alias("name")))).alias("steps"),
    )
    first = nodes.select(F.col("id").alias("sid"), F.col("name").alias("start"))
    category = F.when(F.col("weakest") == 0, "UNKNOWN").when(F.col("loose") | (F.col("weakest") == 1), "POTENTIAL").when((F.col("hops") == 1) & (F.col("last") == "consumes"), "DIRECT").otherwise("TRANSITIVE")
    text = F.array_join(F.concat(F.array(F.coalesce("start", "source")), F.transform("steps", lambda s: s["name"])), " -> ")
    out = grouped.join(first, grouped["source"] == first["sid"], "left")
    return out.select("source", "node", "hops", category.alias("category"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("weakest") + 1).cast("int")).alias("proof_level"), text.alias("explanation"))


def bad_confidence(c: Column) -> Column:
    """Missing, not finite, or outside 0 to 100."""
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 100)


def bad_evidence(evidence: Column) -> Column:
    """Some entry (file, description, confidence) is blank or its confidence is bad."""
    return F.exists(evidence, lambda e: (F.coalesce(e["file"], F.lit("")) == "") | (F.coalesce(e["description"], F.lit("")) == "") | bad_confidence(e["confidence"]))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Code, severity and subject of every fault. nodes: id, type, confidence, ord; edges: id, src, dst, relation, confidence, ord.

    Either may have evidence ARRAY<STRUCT<file, description, confidence>>. An index of edges by their ends is no part of these
    tables, as joins find them, so it can't disagree with them.
    """
    fault = lambda code, severity, subject: [F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject")]
    parts = []
    for rows, kind in ((nodes, "node"), (edges, "edge")):
        n = rows.groupBy("id").agg((F.count(F.lit(1)) - 1).cast("int").alias("more")).where("more > 0")
        parts.append(n.select(F.col("id"), F.explode(F.sequence(F.lit(1), "more"))).select(*fault(f"duplicate-{kind}-id", "warning", F.col("id"))))
    kept_nodes, kept_edges = last_write(nodes), last_write(edges)
    order = Window.partitionBy("src", "dst", "relation").orderBy("ord", "id")
    parts.append(kept_edges.withColumn("k", F.row_number().over(order)).where("k > 1").select(*fault("duplicate-edge", "warning", F.col("id"))))
    parts.append(kept_nodes.where(bad_confidence(F.col("confidence"))).select(*fault("invalid-node-confidence", "error", F.col("id"))))
    ends = kept_nodes.select(F.col("id").alias("nid"), F.col("type").alias("ntype"))
    a, b = (ends.select(F.col("nid").alias(f"{k}_id"), F.col("ntype").alias(f"{k}_type")) for k in ("src", "dst"))
    full = kept_edges.join(a, F.col("src") == F.col("src_id"), "left").join(b, F.col("dst") == F.col("dst_id"), "left")
    lost = F.col("src_id").isNull() | F.col("dst_id").isNull()
    parts.append(full.where(lost).select(*fault("orphan-edge", "error", F.col("id"))))
    whole = full.where(~lost)
    parts.append(whole.where(bad_confidence(F.col("confidence"))).select(*fault("invalid-edge-confidence", "error", F.col("id"))))
    for rows, kind in ((kept_nodes, "node"), (whole, "edge")):
        if "evidence" in rows.columns:
            parts.append(rows.where(bad_evidence(F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)))).select(*fault(f"invalid-{kind}-evidence", "error", F.col("id"))))
    wrong = ((F.col("relation") == "produces") & ~((F.col("src_type") == "producer") & (F.col("dst_type") == "contract"))) | ((F.col("relation") == "consumes") & ~((F.col("src_type") == "contract") & (F.col("dst_type") == "consumer")))
    parts.append(whole.where(wrong).select(*fault("invalid-relation", "error", F.col("id"))))
    return reduce(DataFrame.unionByName, parts)
