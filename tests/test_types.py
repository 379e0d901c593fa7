"""Nested types compared and diffed in rows, against the row-by-row forms."""

import json
import random

from seamwright.operators import diff, type_pairs, typecheck

from . import brute_types as brute

LEAVES = [{"kind": "primitive", "name": n} for n in ("string", "number", "boolean", "null", "undefined", "any", "unknown")]
LEAVES += [{"kind": "literal", "value": v} for v in ("a", "1", 1, 2.5, True, False, 'q"é')]
LEAVES += [{"kind": "enum", "name": "E", "variants": v} for v in ([], ["a"], ["a", "b"], ["b", "c", "c"])] + [{"kind": "reference", "name": n} for n in ("R", "S")]
NAMES = ["a", "b", "user_name", "userName", "é\"x", "a.b"]


def some_type(rng, deep):
    kind = rng.choice(["leaf", "leaf", "array", "object", "union"]) if deep else "leaf"
    if kind == "array":
        return {"kind": "array", "element": some_type(rng, deep - 1)}
    if kind == "object":
        return {"kind": "object", "fields": some_fields(rng, deep - 1)}
    if kind == "union":
        return {"kind": "union", "options": [some_type(rng, deep - 1) for _ in range(rng.randint(0, 3))]}
    return rng.choice(LEAVES)


def some_fields(rng, deep):
    return {n: {"type": some_type(rng, deep), "optional": rng.random() < 0.3, "nullable": rng.random() < 0.3} for n in rng.sample(NAMES, rng.randint(0, 4))}


def changed(rng, t, deep):
    """A type like t, with some of it replaced."""
    if rng.random() < 0.15:
        return some_type(rng, deep)
    if t["kind"] == "array":
        return {"kind": "array", "element": changed(rng, t["element"], deep - 1)}
    if t["kind"] == "union":
        return {"kind": "union", "options": [changed(rng, o, deep - 1) for o in t["options"]]}
    if t["kind"] == "object":
        fields = {(n if rng.random() < 0.85 else rng.choice(NAMES)): {"type": changed(rng, f["type"], deep - 1), "optional": f["optional"] ^ (rng.random() < 0.2), "nullable": f["nullable"]} for n, f in t["fields"].items()}
        return {"kind": "object", "fields": fields}
    return t


def pairs(seed, n=250, deep=4):
    rng = random.Random(seed)
    for _ in range(n):
        first = {"kind": "object", "fields": some_fields(rng, deep)}
        second = changed(rng, first, deep)
        while second["kind"] != "object":
            second = changed(rng, first, deep)
        yield first, second


def found(spark, rows):
    frame = spark.createDataFrame(rows, "client_id long, server_id long, client_schema string, server_schema string")
    out = typecheck.validate_matches(frame)
    return out, sorted((r.client_id, r.server_id, r.ord, r.kind, r.severity, r.path, r.message, str(r.expected), str(r.actual)) for r in out.collect())


def test_findings_of_nested_types(spark):
    rows = [(k, k + 1, json.dumps({"fields": a["fields"]}), json.dumps({"fields": b["fields"]}, separators=(",", ":"))) for k, (a, b) in enumerate(pairs(1))]
    rows += [(900, 900, None, "{}"), (901, 901, "{}", None), (902, 902, "{}", "{}"), (903, 903, '{"fields":{}}', "not json"), rows[0], rows[1], rows[1]]
    out, got = found(spark, rows)
    want = [(c, s, k, v["kind"], v["severity"], v["path"], v["message"], str(v["expected"]), str(v["actual"])) for c, s, a, b in rows if b != "not json" for k, v in enumerate(brute.compare_schemas(a, b) if "fields" in str(a) and "fields" in str(b) else [])]
    assert got == sorted(want) and len(got) > 200
    assert {r[3] for r in got} >= {"missing-field", "type-mutation", "enum-variant-added", "nullability-introduced", "optionality-introduced"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "InArrow", "InPandas"))
    assert found(spark, [])[1] == []


def test_unions_within_unions(spark):
    p = lambda n: {"kind": "primitive", "name": n}
    u = lambda *o: {"kind": "union", "options": list(o)}
    o = lambda **f: {"kind": "object", "fields": {k: {"type": t} for k, t in f.items()}}
    deep = {"kind": "array", "element": u(o(a=u(p("string"), p("number"))), p("null"))}
    cases = [(u(p("string"), p("number")), p("number")), (u(p("string"), p("number")), u(p("string"), p("number"))), (o(a=p("string")), u(o(a=p("string")), o(b=p("string")), p("null"))), (deep, deep), (deep, {"kind": "array", "element": p("null")}), (u(), p("string")), (p("string"), u()), (u(u(p("string"))), p("string"))]
    rows = [(k, k, json.dumps({"fields": {"f": {"type": a}}}), json.dumps({"fields": {"f": {"type": b}}})) for k, (a, b) in enumerate(cases)]
    want = [(c, s, k, v["kind"], v["severity"], v["path"], v["message"], str(v["expected"]), str(v["actual"])) for c, s, a, b in rows for k, v in enumerate(brute.compare_schemas(a, b))]
    assert found(spark, rows)[1] == sorted(want)


def test_type_hashes_are_equal_for_equal_types(spark):
    types = [t for pair in pairs(3, 60) for t in pair] + LEAVES + [{"kind": "literal", "value": 1.0}]
    texts = sorted({json.dumps(t) for t in types})
    got = {r.text: r.hash for r in type_pairs.type_hashes(spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string")).collect()}
    assert set(got) == set(texts)
    plain = {t: brute.canonical(json.loads(t)).replace('"value": 1.0', '"value": 1') for t in texts}
    assert all((got[a] == got[b]) == (plain[a] == plain[b]) for a in texts for b in texts)


def diffed(spark, rows):
    frame = lambda side: spark.createDataFrame([(f"c{k}", "n", "f", 90.0, r[side]) for k, r in enumerate(rows)], "contract_id string, name string, file string, confidence double, shape string")
    out = diff.compare_graphs(frame(0), frame(1))
    return out, {r.contract_id: r for r in out.collect()}


def test_changes_and_renames_of_nested_shapes(spark):
    rows = list(pairs(11))
    out, got = diffed(spark, [(json.dumps(a), json.dumps(b, separators=(",", ":"))) for a, b in rows])
    n_renames = 0
    for k, (a, b) in enumerate(rows):
        changes = list(brute.diff_types("root", a, b))
        if not changes:
            assert f"c{k}" not in got
            continue
        row = got[f"c{k}"]
        load = lambda x: None if x is None else json.loads(x)
        assert [(c.path, c.kind, load(c.before), load(c.after)) for c in row.field_changes] == [(c["path"], c["kind"], c.get("before"), c.get("after")) for c in changes]
        want = [(r["old_path"], r["new_path"], r["type"], r["confidence"], r["proof_level"], round(r["structural_similarity"], 9)) for r in brute.detect_renames(changes)]
        assert [(r.old_path, r.new_path, r.type, r.confidence, r.proof_level, round(r.structural_similarity, 9)) for r in row.renames] == want
        n_renames += len(want)
    assert n_renames > 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "InArrow", "InPandas"))
    assert diffed(spark, [])[1] == {}


def test_renames_of_equal_and_other_types(spark):
    field = lambda t: {"type": t, "optional": False, "nullable": False}
    text, inner = {"kind": "primitive", "name": "string"}, lambda name, t: {"kind": "object", "fields": {"in": {"kind": "object", "fields": {name: field(t)}}}}
    wrap = lambda name, t: json.dumps({"kind": "object", "fields": {"in": field({"kind": "object", "fields": {name: field(t)}}), "x": field(text)}})
    listed = {"kind": "array", "element": {"kind": "object", "fields": {"p": field(text), "q": field(text)}}}
    turned = {"kind": "array", "element": {"kind": "object", "fields": {"q": field(text), "p": field(text)}}}
    _, got = diffed(spark, [(wrap("user_id", listed), wrap("userId", turned)), (wrap("user_id", listed), wrap("userId", text))])
    (rename,) = got["c0"].renames
    assert (rename.old_path, rename.new_path, rename.type, rename.confidence, rename.proof_level) == ("root.in.user_id", "root.in.userId", "{ p, q }[]", 100, "STRONG")
    assert got["c1"].renames == []


def test_equal_pairs_of_fields_are_judged_once(spark, monkeypatch):
    p = lambda n: {"kind": "primitive", "name": n}
    o = lambda **f: {"kind": "object", "fields": {k or "": {"type": t} for k, t in f.items()}}
    inner, other = {"kind": "object", "fields": {"": {"type": o(q=p("string"))}, "z": {"type": p("string")}}}, {"kind": "object", "fields": {"": {"type": o(q=p("number"))}}}
    schema = lambda k, t, u: {"fields": {f"f{k}": {"type": t}, "": {"type": t}, "x": {"type": u}}}
    rows = [(k, k, json.dumps(schema(k, inner, p("string"))), json.dumps(schema(k, other, p("null")))) for k in range(150)]
    rows += [rows[3], rows[3], (900, 900, json.dumps({"fields": {"a": {"type": p("string")}}}), '{"fields":5}'), (901, 901, json.dumps({"fields": {"a": {"type": p("string")}}}), '{"fields":"x"}'), (902, 902, json.dumps({"fields": {"a": {"type": p("string")}}}), "{}"), (903, 903, '{"fields":{"a":null}}', json.dumps({"fields": {"a": {"type": p("string")}}}))]
    started = []
    monkeypatch.setattr(typecheck, "unfold", lambda nodes, step, real=typecheck.unfold: started.append(nodes.count()) or real(nodes, step))
    want = sorted((c, s, k, v["kind"], v["severity"], v["path"], v["message"], str(v["expected"]), str(v["actual"])) for c, s, a, b in rows[:152] for k, v in enumerate(brute.compare_schemas(a, b)))
    got = found(spark, rows)[1]
    assert [r for r in got if r[0] < 900] == want and [(r[0], r[3]) for r in got if r[0] >= 900] == [(900, "missing-field"), (902, "missing-field")]
    assert started == [5]  # of inner and other, by a name and by none, of the two primitives, and of the fields that one side lacks
    monkeypatch.setattr(typecheck, "AT_ONCE", -1)
    frame = spark.createDataFrame(rows, "client_id long, server_id long, client_schema string, server_schema string")
    assert sorted((r.client_id, r.kind, r.path, r.message) for r in typecheck.findings(frame).collect()) == sorted((r[0], r[3], r[5], r[6]) for r in got)


def test_schemas_are_read_once(spark):
    frame = spark.range(3).selectExpr("id AS client_id", "id AS server_id", "concat('{\"fields\":{\"a\":', id, '}}') AS client_schema", "concat('{\"fields\":{\"b\":', id, '}}') AS server_schema")
    plan = typecheck._differing(frame, ["client_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 4  # of each side one reading, and another where that found nothing
