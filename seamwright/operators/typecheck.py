"""Directional structural subtyping of response schemas.

A type is JSON: {"kind": primitive | literal | array | object | union | enum | reference, ...}; a field is
{"type", "optional", "nullable"}, a schema {"name"?, "fields"}.

* findings, and validate_matches in order: any types. A pair of schemas becomes pairs of fields, of which each distinct one is taken
  apart once, to pairs of nodes, level by level, in rows; what a pair of leaves can't agree on is a finding. Below unions findings only count as verdicts: an AND/OR tree of them (every option of the server's,
  any of the client's) is folded from the innermost unions out.
* compare_flat: one left outer join of flattened primitive fields.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, stored
from .type_pairs import below, label_parts, literal_kind, parent, parsed, part, rows_of, same_literal, strings, struct_of, unfold, write_labels

# The wording of findings.
MESSAGES = {
    "object": "Client expects an object at '{path}' but server now returns {actual}.",
    "array": "Client expects an array at '{path}' but server now returns {actual}.",
    "enum-variant-added": "Server may now return enum variant '{variant}' at '{path}', which the client contract does not declare.",
    "enum": "Server now returns {actual} at '{path}', outside the client's enum.",
    "literal": "Server type at '{path}' is not compatible with the client's literal {expected}.",
    "union": "Server type at '{path}' is not compatible with any member of the client's expected union.",
    "server-union": "Server may return {offers} at '{path}', which is incompatible with the client's expected {expected}.",
    "primitive": "Field '{path}' changed type from '{expected}' to '{actual}'.",
    "nullability-introduced": "Server may now return 'null' for '{path}', which the client's contract does not account for.",
    "optionality-introduced": "Server may now omit '{path}' entirely, but the client treats it as required.",
    "missing-field": "Required field '{path}' is missing from the server response.",
}
UNRESOLVED = {
    None: ".",
    "no-same-method-candidates": ": no server handler exists for {method} at all.",
    "no-dynamic-route": ": the client path is static and no exact server match exists (fuzzy matching is only attempted for dynamically-built paths, to avoid guesses like '/users' ~ '/user-settings').",
    "opaque-dynamic-route": ": every segment of the client path is a runtime value, so there is no literal path evidence to match against (typically a base URL or full URL held in a variable).",
}
UNRESOLVED_BASE = "Client call to {method} {route} could not be confidently resolved to any server handler"
#: Opaque to the validator: nothing can be said about them.
OPEN_NAMES = ("any", "unknown")


_FIELDS = ["kind", "severity", "path", "message", "expected", "actual"]
_ROW = ["client_id", "server_id", "row"]
#: Findings of distinct pairs of fields go to every task of their join with all fields if they have at most so many bytes.
AT_ONCE = 16 << 20
#: A pair of nodes. c, s: their JSON; owner: the option of a union that it is a part of, if any, and nest: the number of unions around it; words: what was found, or how a union's options count.
_COLUMNS = {"id": "array<int>", "path": "string", "state": "string", "c": "string", "s": "string", "owner": "array<int>", "nest": "int", "words": "string", "detail": "string", "got": "string"}
_NONE = f"CAST(array() AS {rows_of(_COLUMNS)})"


def unverifiable(t: str) -> str:
    """References and names that say nothing; so is what can't be read."""
    names = ", ".join(f"'{n}'" for n in OPEN_NAMES)
    return f"coalesce({t}.kind = 'reference' OR ({t}.kind = 'primitive' AND {t}.name IN ({names})), true)"


def widened(t: str) -> str:
    """The primitive that a leaf type belongs to."""
    return f"CASE {t}.kind WHEN 'primitive' THEN {t}.name WHEN 'enum' THEN 'string' WHEN 'literal' THEN {literal_kind(f'{t}.value')} END"


def _node(state: str, ident: str = "id", path: str = "path", **more: str) -> str:
    """A node with the given columns; it belongs to the option that its row belongs to, unless told otherwise."""
    return struct_of(_COLUMNS, {"owner": "owner", "nest": "nest"} | more | {"id": ident, "path": path, "state": f"'{state}'"})


def _found(words: str, **more: str) -> str:
    return f"array({_node('found', words=f"'{words}'", c='c', s='s', **more)})"


def _union(words: str, options: str, client: str, server: str) -> str:
    """A union and its options (o, at place i), each of which has a verdict of its own."""
    option = _node("type", below("id", "i"), c=client, s=server, owner=below("id", "i"), nest="nest + 1")
    return f"concat(array({_node('union', words=f"'{words}'", c='c', s='s')}), transform({strings(options)}, (o, i) -> {option}))"


#: D4, its rules in order: the nodes that a pair of types becomes. x, y: the client's type and the server's, read.
_TYPES = f"""CASE WHEN {unverifiable("x")} OR {unverifiable("y")} THEN {_NONE}
WHEN x.kind = 'object' AND y.kind = 'object' THEN coalesce(transform(map_entries(x.fields), (e, i) -> {_node("field", below("id", "i"), "CASE WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END", c="e.value", s="try_element_at(y.fields, e.key)")}), {_NONE})
WHEN x.kind = 'object' THEN {_found("object")}
WHEN x.kind = 'array' AND y.kind = 'array' THEN array({_node("type", below("id", 0), "concat(path, '[]')", c="x.element", s="y.element")})
WHEN x.kind = 'array' THEN {_found("array")}
WHEN x.kind = 'enum' AND y.kind = 'enum' THEN transform(filter({strings("y.variants")}, v -> NOT array_contains({strings("x.variants")}, v)), (v, i) -> {_node("found", below("id", "i"), words="'enum-variant-added'", c="c", s="s", detail="v")})
WHEN x.kind = 'enum' AND y.kind = 'literal' THEN CASE WHEN {literal_kind("y.value")} = 'string' AND array_contains({strings("x.variants")}, try_variant_get(y.value, '$', 'string')) THEN {_NONE} ELSE {_found("enum")} END
WHEN x.kind = 'enum' AND coalesce({widened("y")}, '') = 'string' THEN {_NONE}
WHEN x.kind = 'literal' THEN CASE WHEN y.kind = 'literal' AND {same_literal("x.value", "y.value")} THEN {_NONE} ELSE {_found("literal")} END
WHEN x.kind = 'union' THEN {_union("union", "x.options", "o", "s")}
WHEN y.kind = 'union' THEN {_union("server-union", "y.options", "c", "o")}
WHEN {widened("x")} <> {widened("y")} AND NOT ({widened("x")} IN ('null', 'undefined') AND {widened("y")} IN ('null', 'undefined')) THEN {_found("primitive", detail=widened("x"), got=widened("y"))}
ELSE {_NONE} END"""

#: The nodes that a client's field and the server's of its name become.
_FIELD_PAIR = f"""CASE WHEN s IS NOT NULL THEN array_compact(array(
  CASE WHEN coalesce(y.nullable, false) AND NOT coalesce(x.nullable, false) THEN {_node("found", below("id", 0), words="'nullability-introduced'")} END,
  CASE WHEN coalesce(y.optional, false) AND NOT coalesce(x.optional, false) THEN {_node("found", below("id", 1), words="'optionality-introduced'")} END,
  {_node("type", below("id", 2), c="x.type", s="y.type")}))
WHEN coalesce(x.optional, false) THEN {_NONE} ELSE array({_node("found", c="x.type", words="'missing-field'")}) END"""

#: Equal nodes end where they are met: only a union can differ from itself.
_SAME = """(c = s AND NOT contains(c, '"union"'))"""
_OPEN = "state IN ('type', 'field')"
_DEEPER = f"CASE WHEN {_OPEN} AND {_SAME} THEN {_NONE} WHEN state = 'type' THEN {_TYPES} WHEN state = 'field' THEN {_FIELD_PAIR} ELSE array({struct_of(_COLUMNS, {k: k for k in _COLUMNS})}) END"


def _deeper(rows: DataFrame) -> DataFrame:
    """One level of all open pairs; others stay as they are."""
    read = lambda c: F.expr(f"CASE WHEN {_OPEN} AND NOT coalesce({_SAME}, false) THEN {parsed(c)} END")
    return rows.withColumns({"x": read("c"), "y": read("s")}).select("pair", F.explode(F.expr(_DEEPER)).alias("n")).select("pair", "n.*")


_REFUSED = "array<int>"


def _fold(nodes: DataFrame, nest: int) -> DataFrame:
    """Unions that the other side is not compatible with: verdicts on options make those on the unions around them.

    A client's union has to have an option that takes all, of a server's every option has to be taken. refused: places of the options that aren't.
    """
    bad: DataFrame | None = None  # parts of options that are not compatible
    tops: list[DataFrame] = []
    for level in range(nest, -1, -1):
        here = nodes.where(F.col("nest") == level)
        unions = here.where("state = 'union'").withColumn("n", F.when(F.col("words") == "union", F.size(F.expr(f"{parsed('c')}.options"))))
        if bad is None:
            unions = unions.withColumn("refused", F.array().cast(_REFUSED))
        else:
            met = bad.groupBy(F.col("pair").alias("p"), parent(F.col("owner")).alias("up")).agg(F.array_sort(F.collect_set(F.element_at("owner", -1))).alias("refused"))
            unions = unions.join(met, F.expr("pair = p and id = up"), "left").drop("p", "up").withColumn("refused", F.coalesce("refused", F.array().cast(_REFUSED)))
        wrong = cut(unions.where(F.when(F.col("words") == "union", F.size("refused") == F.coalesce("n", F.lit(0))).otherwise(F.size("refused") > 0)).drop("n"))
        tops.append(wrong.where("owner is null"))
        bad = here.where("state = 'found'").select("pair", "owner").unionByName(wrong.select("pair", "owner")).where("owner is not null")
    return reduce(DataFrame.unionByName, tops)


def _message() -> Column:
    """The message of a finding, by its words; what stands in braces are columns."""

    def filled(template: str) -> Column:
        parts = [F.coalesce(F.col(p), F.lit("None")) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"{(\w+)}", template))]
        return F.concat(*parts)

    cases = [F.when(F.col("words") == words, filled(template)) for words, template in MESSAGES.items()]
    return F.coalesce(*cases)


def _differing(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, path, c, s: the fields of the clients' schemas, at their places, beside the servers' of their names (or null), without those that can't differ."""
    # only a union can differ from itself; equal texts without one need no probing
    probed = F.col("client_schema").isNotNull() & F.col("server_schema").isNotNull() & ((F.col("client_schema") != F.col("server_schema")) | F.contains("client_schema", F.lit('"union"')))
    sides = {"x": "client_schema", "y": "server_schema"}
    # no filter here: it would be put below what it asks for, so that schemas are written or read anew for it
    rows = matches.withColumn("probed", probed)
    rows = rows.withColumns({k: F.expr(f"CASE WHEN probed THEN from_json({c}, 'fields map<string,string>').fields END") for k, c in sides.items()})
    # what has no fields that are read like this has none, or says nothing where it can't be read as an object
    shape = lambda c: f"""concat('{{"kind":"object","fields":', coalesce(get_json_object({c}, '$.fields'), '{{}}'), '}}')"""
    rows = rows.withColumns({f"{k}_whole": F.expr(f"CASE WHEN probed AND {k} IS NULL THEN {parsed(shape(c))} END") for k, c in sides.items()})
    told = " AND ".join(f"({k} IS NOT NULL OR {k}_whole.kind IS NOT NULL)" for k in sides)
    rows = rows.withColumns({"told": F.expr(told), **{k: F.coalesce(k, f"{k}_whole.fields") for k in sides}})
    fields = "CASE WHEN told THEN transform(map_entries(x), (e, i) -> named_struct('at', i, 'path', e.key, 'c', e.value, 's', try_element_at(y, e.key))) END"
    return rows.select(*keys, F.explode(F.expr(fields)).alias("f")).select(*keys, "f.*").where(f"NOT coalesce({_SAME}, false)")


def _told(pairs: DataFrame) -> DataFrame:
    """What is found in pairs (pair, bare, c, s) of fields: pair, below (the place within), tail (the path from there, after a letter unless bare), and what is told of it."""
    root = _node("field", "array()", "CASE WHEN bare THEN '' ELSE '*' END", c="c", s="s", owner="NULL", nest="0")
    nodes = unfold(pairs.select("pair", F.expr(root).alias("n")).select("pair", "n.*"), _deeper)
    found = nodes.where("state = 'found' and owner is null").withColumn("refused", F.array().cast(_REFUSED))
    nest = nodes.where("state = 'union'").agg(F.max("nest")).first()[0]
    if nest is not None:
        found = found.unionByName(_fold(nodes, nest + 1).select(*found.columns))
    labelled = ["object", "array", "enum-variant-added", "enum", "literal", "union", "server-union"]
    offers = f"""flatten(transform(refused, (r, i) -> CASE WHEN i > 0 THEN array({part("' or '")}, {part("y.options[r]", True)}) ELSE {label_parts("y.options[r]")} END))"""
    words = lambda names: ", ".join(f"'{n}'" for n in names)
    side = lambda c, plain, names: F.expr(f"CASE WHEN words IN ({words(names)}) THEN {label_parts(c)} WHEN words = 'primitive' THEN array({part(plain)}) END")
    told = found.withColumn("y", F.expr(f"CASE WHEN words = 'server-union' THEN {parsed('s')} END")).select(
        "pair",
        F.col("id").alias("below"),
        F.col("path").alias("tail"),
        "words",
        F.col("detail").alias("variant"),
        side("c", "detail", [*labelled, "missing-field"]).alias("expected"),
        side("s", "got", labelled).alias("actual"),
        F.expr(f"CASE WHEN words = 'server-union' THEN {offers} END").alias("offers"),
    )
    return write_labels(told, "expected", "actual", "offers")


def _findings(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id (its order within a row) and columns of each finding of each row.

    Each distinct pair of fields is judged once; its findings come to all fields like it by a join.
    """
    fields = stored(_differing(matches, keys)).withColumn("bare", F.col("path") == "")
    own = [F.col(c) for c in ("c", "s", "bare")]
    # hashes pass over nulls, so which side has none is hashed, too
    hashed = [*own, F.col("c").isNull(), F.col("s").isNull()]
    pair = F.struct(F.xxhash64(*hashed).alias("x"), F.xxhash64(F.lit("second"), *hashed).alias("y")).alias("pair")
    told = cut(_told(fields.select(*own).distinct().select(pair, *own)))
    size = told.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    met = fields.select(*keys, "at", "path", pair).join(F.broadcast(told) if size <= AT_ONCE else told, "pair")
    path = F.when(F.col("path") == "", F.col("tail")).otherwise(F.concat("path", F.expr("substring(tail, 2)")))
    out = met.withColumns({"id": F.concat(F.array("at"), "below"), "path": path})
    plain = ["missing-field", "nullability-introduced", "optionality-introduced", "enum-variant-added"]
    kind = F.when(F.col("words").isin(*plain), F.col("words")).otherwise("type-mutation")
    severity = F.when(F.col("words") == "nullability-introduced", "warning").otherwise("error")
    return out.select(*keys, "id", kind.alias("kind"), severity.alias("severity"), "path", _message().alias("message"), "expected", "actual")


def findings(matches: DataFrame) -> DataFrame:
    """client_id, server_id and columns of the findings of matches (client_id, server_id, client_schema, server_schema as JSON), in no order.

    Matches with an unknown schema have no findings. Equal rows have equal findings, once for each row.
    """
    return _findings(matches, ["client_id", "server_id"]).select("client_id", "server_id", *_FIELDS)


def validate_matches(matches: DataFrame) -> DataFrame:
    """The findings of matches with their places (ord) in those of their row."""
    own = [F.col(c) for c in ("client_id", "server_id", "client_schema", "server_schema")]
    keyed = matches.withColumn("row", F.struct(F.xxhash64(*own).alias("x"), F.xxhash64(F.lit("second"), *own).alias("y")))
    listed = _findings(keyed, _ROW).select(*_ROW, F.struct("id", *_FIELDS).alias("v"))
    # the findings of a pair of schemas, in order; those of equal rows come together, each as often as there are rows
    grouped = listed.groupBy(*_ROW).agg(F.collect_list("v").alias("all")).withColumn("v", F.array_sort(F.array_distinct("all")))
    each = grouped.select("client_id", "server_id", "v", F.explode(F.sequence(F.lit(1), (F.size("all") / F.size("v")).cast("int"))))
    return each.select("client_id", "server_id", F.posexplode("v").alias("ord", "x")).select("client_id", "server_id", "ord", *[f"x.{f}" for f in _FIELDS])


def compare_flat(client: DataFrame, server: DataFrame) -> DataFrame:
    """D5, D6 and the primitive rule of D4 on flattened fields: one left outer join on (match_id, path).

    Both sides: match_id, path, kind, name, optional, nullable; the client's path set decides.
    """
    c = client.select("match_id", "path", *[F.col(k).alias(f"c_{k}") for k in ("kind", "name", "optional", "nullable")])
    s = server.select("match_id", "path", F.lit(True).alias("found"), *[F.col(k).alias(f"s_{k}") for k in ("kind", "name", "optional", "nullable")])
    both = c.join(s, ["match_id", "path"], "left")
    here = F.col("found").isNotNull()
    closed = ~((F.col("c_kind") == "reference") | F.col("c_name").isin(*OPEN_NAMES) | (F.col("s_kind") == "reference") | F.col("s_name").isin(*OPEN_NAMES))
    differ = (F.col("c_name") != F.col("s_name")) & ~(F.col("c_name").isin("null", "undefined") & F.col("s_name").isin("null", "undefined"))
    found = F.array_compact(
        F.array(
            F.when(~here & ~F.col("c_optional"), F.struct(F.lit("missing-field").alias("kind"), F.lit("error").alias("severity"))),
            F.when(here & F.col("s_nullable") & ~F.col("c_nullable"), F.struct(F.lit("nullability-introduced").alias("kind"), F.lit("warning").alias("severity"))),
            F.when(here & F.col("s_optional") & ~F.col("c_optional"), F.struct(F.lit("optionality-introduced").alias("kind"), F.lit("error").alias("severity"))),
            F.when(here & closed & differ, F.struct(F.lit("type-mutation").alias("kind"), F.lit("error").alias("severity"))),
        )
    )
    return both.select("match_id", "path", F.explode(found).alias("v")).select("match_id", "path", "v.kind", "v.severity")


def unresolved_message(method: Column, route: Column, reason: Column, candidates: Column) -> Column:
    """Candidates are ARRAY<STRUCT<route, confidence>>, best first."""
    base = F.format_string(UNRESOLVED_BASE.replace("{method}", "%s").replace("{route}", "%s"), method, route)
    top, second = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    many = F.format_string(": ambiguous between %d structurally identical server handlers (%s).", F.size(candidates), F.array_join(F.transform(candidates, lambda c: c["route"]), ", "))
    below = F.format_string(": closest candidate was %s at confidence %s, below the acceptance threshold.", top["route"], number_text(top["confidence"]))
    tie = F.format_string(": top two candidates were too close to call — %s (%s) vs %s (%s).", top["route"], number_text(top["confidence"]), second["route"], number_text(second["confidence"]))
    tail = (
        F.when(reason == "no-same-method-candidates", F.format_string(UNRESOLVED["no-same-method-candidates"].replace("{method}", "%s"), method))
        .when(reason == "no-dynamic-route", UNRESOLVED["no-dynamic-route"])
        .when(reason == "opaque-dynamic-route", UNRESOLVED["opaque-dynamic-route"])
        .when((reason == "multiple-exact-matches") & candidates.isNotNull(), many)
        .when((reason == "below-threshold") & top.isNotNull(), below)
        .when((reason == "ambiguous") & second.isNotNull(), tie)
        .otherwise(UNRESOLVED[None])
    )
    return F.concat(base, tail)


def number_text(x: Column) -> Column:
    """A number as the report prints it: whole ones without a fraction."""
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""))


def validate_all(matches: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Findings of matches, then one note for each unresolved client (client_id, method, route, reason, candidates)."""
    found = validate_matches(matches).select("client_id", "server_id", "ord", *_FIELDS)
    none = F.lit(None).cast("string")
    notes = unresolved.select(
        "client_id",
        F.lit(None).cast(dict(found.dtypes)["server_id"]).alias("server_id"),
        F.lit(0).alias("ord"),
        F.lit("unresolved-route").alias("kind"),
        F.lit("note").alias("severity"),
        F.lit("").alias("path"),
        unresolved_message(F.col("method"), F.col("route"), F.col("reason"), F.col("candidates")).alias("message"),
        none.alias("expected"),
        none.alias("actual"),
    )
    return found.unionByName(notes)
