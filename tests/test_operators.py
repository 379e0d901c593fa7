import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamwright.functions import routes
from seamwright.operators import diff, graph, impact, intent, matching, typecheck
from seamwright.plans import report

from . import brute_types

P = lambda name: {"kind": "primitive", "name": name}
FIELD = lambda t, optional=False, nullable=False: {"type": t, "optional": optional, "nullable": nullable}
ENUM = lambda *v: {"kind": "enum", "name": "E", "variants": list(v)}
UNION = lambda *o: {"kind": "union", "options": list(o)}
LIT = lambda v: {"kind": "literal", "value": v}


def kinds(client, server):
    return [(v["kind"], v["path"]) for v in brute_types.compare_schemas(json.dumps({"fields": client}), json.dumps({"fields": server}))]


def test_route_syntaxes(spark):
    raws = ["/a/:id", "/a/[id]", "/a/{id}", "/a/*id", "/a/__DYN__", "/a/[[...id]]", "/a/*", " /a//b?x=/c ", "", "/a/{id:path}", "/a-__DYN__"]
    seg = routes.parse_route(F.col("raw"))
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(routes.stringify_route(seg).alias("s")).collect()
    assert [r.s for r in got] == ["/a/:id", "/a/:id", "/a/:id", "/a/:id", "/a/:?", "/a/:id", "/a/:wildcard", "/a/b", "/", "/a/{id:path}", "/a-__DYN__"]


def test_route_score_and_evidence(spark):
    df = spark.createDataFrame([("/api/v2/orderstatus/__DYN__", "/api/v2/order-status/:id"), ("/a", "/a/b"), ("/", "/")], "c string, s string")
    c, s = routes.parse_route(F.col("c")), routes.parse_route(F.col("s"))
    rows = df.select(routes.round_half_up(routes.route_score(c, s), 3).alias("x"), routes.explain_route(c, s).alias("e")).collect()
    assert [r.x for r in rows] == [0.942, 0.425, 1.0]
    assert [e.kind for e in rows[0].e] == ["static-exact", "static-exact", "static-fuzzy", "dynamic-compatible"]
    assert rows[1].e[1].client == "∅" and rows[1].e[1].score == 0.0


def test_every_reason(spark):
    clients = [(1, "DELETE", "/x", False), (2, "GET", "/__DYN__", True), (3, "GET", "/two/__DYN__", True), (4, "GET", "/nothing", False), (5, "GET", "/zzzzzzzz/qqqqqqq/wwwww/__DYN__", True), (6, "GET", "/order-statu/__DYN__", True), (7, "POST", "/widgetz/__DYN__", True), (8, "POST", "/widgets/__DYN__", True)]
    servers = [(1, "GET", "/two/:a"), (2, "GET", "/two/:b"), (3, "GET", "/order-state/:id"), (4, "GET", "/order-stats/:id"), (5, "POST", "/widgets/:id")]
    c = spark.createDataFrame(clients, "client_id long, method string, route string, dynamic boolean").withColumn("segments", routes.parse_route(F.col("route")))
    s = spark.createDataFrame(servers, "server_id long, method string, route string").withColumn("segments", routes.parse_route(F.col("route")))
    m = matching.match_routes(c, s)
    got = {r.client_id: r.reason or r.strategy for r in m.collect()}
    assert got == {1: "no-same-method-candidates", 2: "opaque-dynamic-route", 3: "multiple-exact-matches", 4: "no-dynamic-route", 5: "below-threshold", 6: "ambiguous", 7: "fuzzy-sequence", 8: "exact"}
    assert {e.kind for e in matching.explain_matches(m, c, s).where("client_id = 7").collect()} == {"static-fuzzy", "dynamic-compatible"}


def test_depths_that_cannot_win_change_no_match(spark):
    words = ["users", "user", "orders", "order", "items", ":id", ":key", "v1", "v2"]
    rng = random.Random(5)
    route = lambda: "/" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    c = spark.createDataFrame([(k, rng.choice(["GET", "POST"]), route(), True) for k in range(120)], "client_id long, method string, route string, dynamic boolean").withColumn("segments", routes.parse_route(F.col("route")))
    s = spark.createDataFrame([(k, rng.choice(["GET", "POST"]), route()) for k in range(40)], "server_id long, method string, route string").withColumn("segments", routes.parse_route(F.col("route")))
    for threshold, margin in ((0.6, 0.05), (0.3, 0.1), (1.0, 0.0)):
        pruned, full = (matching.match_routes(c, s, threshold, margin, candidates=k).drop("candidates") for k in (False, True))
        assert sorted(map(str, pruned.collect())) == sorted(map(str, full.collect()))


def test_validator_rules():
    assert kinds({"a": FIELD(P("string"))}, {}) == [("missing-field", "a")]
    assert kinds({"a": FIELD(P("string"), optional=True)}, {}) == []
    assert kinds({"a": FIELD(P("string"))}, {"a": FIELD(P("number"), True, True)}) == [("nullability-introduced", "a"), ("optionality-introduced", "a"), ("type-mutation", "a")]
    assert kinds({"a": FIELD(P("any"))}, {"a": FIELD(P("number"))}) == []
    assert kinds({"a": FIELD(P("null"))}, {"a": FIELD(P("undefined"))}) == []
    assert kinds({"a": FIELD(ENUM("x", "y"))}, {"a": FIELD(ENUM("x", "z", "w"))}) == [("enum-variant-added", "a")] * 2
    assert kinds({"a": FIELD(ENUM("x"))}, {"a": FIELD(P("string"))}) == []
    assert kinds({"a": FIELD(ENUM("x"))}, {"a": FIELD(LIT("q"))}) == [("type-mutation", "a")]
    assert kinds({"a": FIELD(LIT(1))}, {"a": FIELD(LIT("1"))}) == [("type-mutation", "a")]
    both = UNION(P("string"), P("number"))
    assert kinds({"a": FIELD(both)}, {"a": FIELD(both)}) == [("type-mutation", "a")]
    assert kinds({"a": FIELD(P("string"))}, {"a": FIELD(UNION(P("string"), P("null")))}) == [("type-mutation", "a")]
    inner = {"kind": "array", "element": {"kind": "object", "fields": {"b": FIELD(P("string"))}}}
    assert kinds({"a": FIELD(inner)}, {"a": FIELD({"kind": "array", "element": {"kind": "object", "fields": {}}})}) == [("missing-field", "a[].b")]
    assert kinds({"a": FIELD(P("string"))}, {"a": FIELD({"kind": "object", "fields": {}})}) == []
    assert brute_types.compare_schemas(None, "{}") == []


def test_labels():
    assert brute_types.label({"kind": "array", "element": UNION(P("string"), ENUM("a", "b"), LIT("x"))}) == 'string | enum(a | b) | "x"[]'


LEAF = st.sampled_from([P(n) for n in ("string", "number", "boolean", "null", "any")])
FLAT = st.dictionaries(st.sampled_from("abcdef"), st.builds(FIELD, LEAF, st.booleans(), st.booleans()), max_size=5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(FLAT, FLAT), min_size=1, max_size=8))
def test_flat_join_agrees_with_recursion(spark, pairs):
    flat = lambda side: [(k, p, f["type"]["kind"], f["type"]["name"], f["optional"], f["nullable"]) for k, pair in enumerate(pairs) for p, f in pair[side].items()]
    schema = "match_id int, path string, kind string, name string, optional boolean, nullable boolean"
    got = typecheck.compare_flat(spark.createDataFrame(flat(0), schema), spark.createDataFrame(flat(1), schema)).collect()
    want = [(k, p, kind) for k, (c, s) in enumerate(pairs) for kind, p in kinds(c, s)]
    assert sorted((r.match_id, r.path, r.kind) for r in got) == sorted(want)


def test_unresolved_messages(spark):
    rows = [("GET", "/a", "no-same-method-candidates", None), ("GET", "/a", "ambiguous", [("/x", 0.942), ("/y", 0.9)]), ("GET", "/a", "multiple-exact-matches", [("/x/:a", 1.0), ("/x/:b", 1.0)])]
    df = spark.createDataFrame(rows, "m string, r string, reason string, c array<struct<route:string,confidence:double>>")
    got = [x.t for x in df.select(typecheck.unresolved_message(F.col("m"), F.col("r"), F.col("reason"), F.col("c")).alias("t")).collect()]
    assert got[0].endswith(": no server handler exists for GET at all.")
    assert got[1].endswith("too close to call — /x (0.942) vs /y (0.9).")
    assert got[2].endswith("ambiguous between 2 structurally identical server handlers (/x/:a, /x/:b).")


def shape(**fields):
    return json.dumps({"kind": "object", "fields": fields})


def test_graph_diff_and_renames(spark):
    base = [("c1", "n", "f", 100.0, shape(email=FIELD(P("string")), age=FIELD(P("number")))), ("gone", "n", "f", 90.0, None), ("same", "n", "f", 1.0, shape(a=FIELD(P("string"))))]
    now = [("c1", "n", "f", 80.0, shape(emailAddress=FIELD(P("string")), age=FIELD(P("number"), True))), ("new", "n", "f", 70.0, None), ("same", "n", "f", 1.0, shape(a=FIELD(P("string"))))]
    schema = "contract_id string, name string, file string, confidence double, shape string"
    got = {r.contract_id: r for r in diff.compare_graphs(spark.createDataFrame(base, schema), spark.createDataFrame(now, schema)).collect()}
    assert {k: r.kind for k, r in got.items()} == {"c1": "modified", "gone": "removed", "new": "added"}
    assert [(c.path, c.kind) for c in got["c1"].field_changes] == [("root.age", "optionality-changed"), ("root.email", "removed"), ("root.emailAddress", "added")]
    assert [(r.old_path, r.new_path, r.proof_level) for r in got["c1"].renames] == [("root.email", "root.emailAddress", "POTENTIAL")]
    assert got["c1"].confidence == 80.0


def test_greedy_renames():
    changes = [{"path": f"root.{n}", "kind": "removed", "before": FIELD(P("string"))} for n in ("firstName", "lastName")]
    changes += [{"path": f"root.{n}", "kind": "added", "after": FIELD(P("string"))} for n in ("firstNm", "lastNm")]
    assert [(r["old_path"], r["new_path"]) for r in brute_types.detect_renames(changes)] == [("root.firstName", "root.firstNm"), ("root.lastName", "root.lastNm")]
    changes[2]["after"] = changes[3]["after"] = FIELD(P("number"))
    assert brute_types.detect_renames(changes) == []


def test_rename_rounds_are_the_greedy_order(spark):
    rng = random.Random(7)
    rows = [(f"c{k}", f"o{i}", f"n{j}", rng.choice([0.2, 0.5, 0.5, 0.9])) for k in range(4) for i in range(6) for j in range(5)]
    want = set()
    for contract, old, new, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if not any(c == contract and (o == old or n == new) for c, o, n in want):
            want.add((contract, old, new))
    schema = "contract_id string, old_path string, new_path string, score double"
    got = diff.pair_renames(spark.createDataFrame([*rows, rows[0], (None, "o", "n", 1.0)], schema)).collect()
    assert len(got) == len(want) and {(r.contract_id, r.old_path, r.new_path) for r in got} == want
    assert diff.pair_renames(spark.createDataFrame([], schema)).count() == 0


def test_equal_schemas_are_probed_only_for_unions(spark):
    schema = lambda t: json.dumps({"fields": {"a": FIELD(t)}})
    texts = [(1, schema(P("string")), schema(P("string"))), (2, schema(UNION(P("string"), P("number"))), schema(UNION(P("string"), P("number")))), (3, None, schema(P("string"))), (4, schema(P("string")), schema(P("number")))]
    got = typecheck.validate_matches(spark.createDataFrame([(k, k, a, b) for k, a, b in texts], "client_id int, server_id int, client_schema string, server_schema string")).collect()
    assert sorted((r.client_id, r.kind) for r in got) == sorted((k, v["kind"]) for k, a, b in texts for v in brute_types.compare_schemas(a, b))


def edges(spark, rows):
    return spark.createDataFrame(rows, "id string, src string, dst string, relation string, confidence double, resolution string")


def test_paths(spark):
    rows = [("e1", "c", "x", "consumes", 100.0, "exact"), ("f1", "d", "s", "defines", 100.0, "exact"), ("f2", "s", "a", "aliases", 90.0, "symbol"), ("f3", "a", "y", "consumes", 90.0, "symbol"), ("f4", "a", "s", "aliases", 90.0, "symbol"), ("g1", "w", "z", "consumes", 55.0, "fuzzy")]
    nodes = spark.createDataFrame([(n, "consumer" if n in "xyz" else "contract", n.upper()) for n in "cdswaxyz"], "id string, type string, name string")
    sources = spark.createDataFrame([("c",), ("d",), ("w",), ("lone",)], "id string")
    e = edges(spark, rows)
    paths = graph.shortest_paths(sources, e)
    got = {(r.source, r.node): r for r in graph.classify_paths(paths, paths, e, nodes).collect()}
    assert (got["c", "x"].category, got["c", "x"].proof_level, got["c", "x"].explanation) == ("DIRECT", "PROVEN", "C -> X")
    assert (got["d", "y"].category, got["d", "y"].hops) == ("TRANSITIVE", 3)
    assert got["w", "z"].category == "POTENTIAL"
    assert not [k for k in got if k[0] == "lone"]
    reached = graph.transitive_consumers(sources, nodes, e).collect()
    assert {(r.contract, r.consumer) for r in reached} == {("c", "x"), ("d", "y"), ("w", "z")}


def test_paths_of_cyclic_graphs(spark):
    rng = random.Random(9)
    for n, m in ((12, 20), (30, 45), (6, 40)):
        rows = [(f"e{k:03d}" if rng.random() < 0.9 else f"e{k}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", "consumes", 90.0, "exact") for k in range(m)]
        rows += [(f"x{k}", f"n{k}", f"n{k + 1}", "aliases", 90.0, "exact") for k in range(n - 1)]
        sources = [f"n{k}" for k in range(3)]
        want = {}
        for source in sources:  # breadth first, edges in order
            queue, path = [source], {source: []}
            for here in queue:
                for edge, _, to, *_ in sorted(r for r in rows if r[1] == here):
                    if to not in path:
                        path[to] = [*path[here], edge]
                        queue.append(to)
            want |= {(source, node): p for node, p in path.items() if node != source}
        tree = graph.shortest_paths(spark.createDataFrame([(s,) for s in sources], "id string"), edges(spark, rows))
        assert tree.columns == ["source", "node", "hops", "edge", "pred"] and max(map(len, want.values())) >= 2
        got = {}
        for r in sorted(graph.path_hops(tree, tree).collect(), key=lambda r: r.at):
            got.setdefault((r.source, r.node), []).append(r.edge)
        assert got == want


def test_graph_build(spark):
    clients = spark.createDataFrame([(1, "GET", "/u/__DYN__", "a.ts", True, False), (2, "GET", "/none", "a.ts", False, False)], "client_id long, method string, route string, file string, dynamic boolean, computed boolean")
    servers = spark.createDataFrame([(7, "GET", "/u/:id", "s.ts", None)], "server_id long, method string, route string, file string, shape string")
    m = spark.createDataFrame([(1, 7, 0.9424, "fuzzy-sequence"), (2, None, None, None)], "client_id long, server_id long, confidence double, strategy string")
    nodes = {r.id: r for r in graph.build_nodes(clients, servers, m).collect()}
    assert nodes["consumer:1"].confidence == 94.0 and nodes["consumer:2"].confidence == 0.0 and nodes["contract:GET:/u/:id"].type == "contract"
    built = {r.relation: r for r in graph.build_edges(servers, m).collect()}
    assert built["consumes"].confidence == pytest.approx(94.24) and built["consumes"].resolution == "fuzzy"


def test_risk_golden(spark):
    counts = spark.createDataFrame([(1, 0, 0, "TIER_0_CRITICAL", True, "production")], "breaking int, unknown int, transitive int, tier string, is_public boolean, environment string")
    config = impact.RiskConfig(breaking=20, public_bonus=25, multipliers={"TIER_0_CRITICAL": 2.0}, levels=(70, 50, 25))
    row = impact.risk(counts, config).first()
    assert (row.risk_score, row.risk_level) == (70, "CRITICAL")
    with pytest.raises(ValueError):
        impact.RiskConfig(levels=(10, 50, 25))
    points = impact.sensitive_points(F.array(F.lit("user.email")), ["email"])
    assert impact.risk(counts, config, points).first().risk_score == 95


def test_intents():
    assert intent.parse_rename("contract:GET:/u.email=mail") == {"kind": "rename-field", "contract_id": "contract:GET:/u", "from": "email", "to": "mail"}
    assert intent.parse_rename("c.a.b->c.x") == {"kind": "rename-field", "contract_id": "c", "from": "a.b", "to": "x"}
    assert intent.parse_widen("c.a.b")["field"] == "a.b"
    with pytest.raises(ValueError):
        intent.parse_rename("nothing")
    assert impact.validate_services({"": {}, "a": {"criticality": "high"}, "b": {"criticality": "TIER_3_LOW"}}) == ["service name must not be empty (entry 0)", "service 'a' has unknown criticality 'high'"]


def test_reports(spark):
    f = spark.createDataFrame([(0, "missing-field", "error", "gone", "a.ts", 3, 1), (1, "unresolved-route", "note", "lost", None, None, None)], "ord int, kind string, severity string, message string, file string, line int, column int")
    log = json.loads(report.written(report.sarif(f)))
    assert log["version"] == "2.1.0" and [r["ruleId"] for r in log["runs"][0]["results"]] == ["missing-field"]
    assert "| error | missing-field | a.ts:3 | gone |" in report.written(report.markdown(f))
    assert "No contract violations" in report.written(report.markdown(f.limit(0)))
    assert report.written(report.text(f)).endswith("2 findings\n")


def test_impact_reports(spark):
    cols = "contract_id string, consumer_id string, severity string, category string, reason string, confidence double, proof_level string"
    rows = spark.createDataFrame([("c", "a/b.ts:3:7:GET:/x", "BREAKING", "DIRECT", "gone", 89.5, "PROVEN"), ("c", "z.ts:1:1:GET:/x", "SAFE", "UNUSED", "fine", 100.0, "PROVEN")], cols)
    log = json.loads(report.written(report.impact_sarif(rows, {"risk_score": 80, "risk_level": "CRITICAL"})))["runs"][0]
    assert [(r["ruleId"], r["level"]) for r in log["results"]] == [("impact-breaking", "error"), ("impact-safe", "note"), ("contract-risk-critical", "error")]
    assert log["results"][0]["message"]["text"] == "gone [DIRECT, confidence 90%]" and log["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "startColumn": 7}
    assert len(json.loads(report.written(report.impact_sarif(rows, {"risk_score": 1, "risk_level": "LOW"})))["runs"][0]["results"]) == 2
    text = report.written(report.impact_markdown(rows, {"risk_score": 80, "risk_level": "CRITICAL"}, "FAIL", ["mend it"]))
    assert "### BREAKING" in text and "`a/b.ts:3`" in text and "**Verdict:** FAIL" in text and "- mend it" in text
    faults = spark.createDataFrame([("orphan-edge", "error", "e1"), ("duplicate-node-id", "warning", "n1")], "code string, severity string, subject string")
    assert report.written(report.validation_text(faults)).splitlines()[:2] == ["Contract graph: INVALID", "1 errors, 1 warnings"] and "valid" in report.written(report.validation_text(faults.limit(0)))
    assert "VALID (with warnings)" in report.written(report.validation_text(faults.where("severity = 'warning'")))


def test_explanations(spark):
    from pyspark.sql import functions as F

    s = "array<struct<client:string,server:string,kind:string,score:double>>"
    row = spark.createDataFrame([([("users", "users", "static-exact", 1.0), (":id", ":userId", "dynamic", 0.85), ("x", "y", "unaligned", 0.0)], 0.93, 1.0)], f"s {s}, a double, d double")
    assert row.select(intent.explanation_text(F.col("s"), F.col("a"), F.col("d")).alias("t")).first().t == "users=users(1.0) + :id≈:userId(0.85) + xvsy(0.0) — alignment 0.93, depth-agreement 1.00"
