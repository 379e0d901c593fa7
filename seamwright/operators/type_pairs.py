"""Types as JSON, taken apart level by level in rows: no Python worker, and no schema has to fit in one value.

A type is {"kind": primitive | literal | array | object | union | enum | reference, ...}; a field is {"type",
"optional", "nullable"}. `unfold` takes open nodes to their children until none is open; a node's id is the list of places
that lead to it, so the first places of an id are its parent, and ids in order are a walk in depth.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Types and fields have different keys, so one schema reads both; nested ones stay JSON text.
PARSED = "kind string, name string, element string, fields map<string,string>, options array<string>, variants array<string>, value variant, type string, optional boolean, nullable boolean"
#: Levels taken between two looks whether any node is still open.
STRIDE = 3
PARTS = "array<struct<open:boolean,text:string>>"


def parsed(text: str) -> str:
    return f"from_json({text}, '{PARSED}')"


def struct_of(columns: dict[str, str], values: dict[str, str]) -> str:
    """A row of a table with these columns (name: kind), null where no value is given."""
    return "named_struct(" + ", ".join(f"'{k}', CAST({values.get(k, 'NULL')} AS {kind})" for k, kind in columns.items()) + ")"


def rows_of(columns: dict[str, str]) -> str:
    return f"array<struct<{', '.join(f'{k}: {kind}' for k, kind in columns.items())}>>"


def unfold(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows, with what `step` makes of those whose state is type or field, over and over until none is left."""
    is_open = F.col("state").isin("type", "field")
    done: list[DataFrame] = []
    while True:
        for _ in range(STRIDE):
            rows = step(rows)
        rows = cut(rows)
        done.append(rows.where(~is_open))
        rows = rows.where(is_open)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def parent(node: Column) -> Column:
    return F.slice(node, 1, F.greatest(F.size(node) - 1, F.lit(0)))


def below(node: str, place: str | int) -> str:
    return f"concat({node}, array(int({place})))"


def strings(x: str) -> str:
    return f"coalesce({x}, CAST(array() AS array<string>))"


# ---------------------------------------------------------------- literals
def literal_kind(value: str) -> str:
    """D1 for literals: string, boolean or number."""
    return f"CASE schema_of_variant({value}) WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


def literal_text(value: str) -> str:
    """Equal for equal literals of one kind: numbers go by value."""
    return f"CASE WHEN {literal_kind(value)} = 'number' THEN string(try_variant_get({value}, '$', 'double')) ELSE to_json({value}) END"


def same_literal(a: str, b: str) -> str:
    return f"coalesce({literal_kind(a)} = {literal_kind(b)} AND {literal_text(a)} = {literal_text(b)}, false)"


def quoted(text: str) -> str:
    """A string as JSON."""
    return f"CASE WHEN {text} IS NULL THEN 'null' ELSE substring(to_json(array({text})), 2, length(to_json(array({text}))) - 2) END"


# ---------------------------------------------------------------- labels
def part(text: str, is_open: bool = False) -> str:
    return f"named_struct('open', {str(is_open).lower()}, 'text', {text})"


def label_parts(text: str) -> str:
    """A type's label, before anything of it is written: one open part."""
    return f"array({part(text, True)})"


#: A type's own part of its label; types within it stay open. t: the type, read.
_NEXT = f"""CASE t.kind
WHEN 'array' THEN array({part("t.element", True)}, {part("'[]'")})
WHEN 'union' THEN coalesce(flatten(transform(t.options, (o, i) -> CASE WHEN i > 0 THEN array({part("' | '")}, {part("o", True)}) ELSE array({part("o", True)}) END)), CAST(array() AS {PARTS}))
WHEN 'object' THEN array({part(f"concat('{{ ', array_join({strings('map_keys(t.fields)')}, ', '), ' }}')")})
WHEN 'enum' THEN array({part(f"concat('enum(', array_join({strings('t.variants')}, ' | '), ')')")})
WHEN 'literal' THEN array({part("to_json(t.value)")})
ELSE array({part("t.name")}) END"""


def write_labels(rows: DataFrame, *columns: str) -> DataFrame:
    """D3: rows with the parts in columns (null or PARTS) rewritten level by level and joined to text."""

    def once(c: str) -> Column:
        # t is the type of each open part, read once
        step = f"CASE WHEN x.part.open THEN {_NEXT.replace('t.', 'x.t.')} ELSE array(x.part) END"
        read = f"transform({c}, p -> named_struct('part', p, 't', CASE WHEN p.open THEN {parsed('p.text')} END))"
        return F.expr(f"CASE WHEN exists({c}, p -> p.open) THEN flatten(transform({read}, x -> {step})) ELSE {c} END")

    more = F.expr(" OR ".join(f"coalesce(exists({c}, p -> p.open), false)" for c in columns))
    done: list[DataFrame] = []
    while True:
        for _ in range(2):
            rows = rows.withColumns({c: once(c) for c in columns})
        rows = cut(rows)
        done.append(rows.where(~more))
        rows = rows.where(more)
        if rows.isEmpty():
            break
    text = {c: F.expr(f"CASE WHEN {c} IS NOT NULL THEN array_join(transform({c}, p -> p.text), '') END") for c in columns}
    return reduce(DataFrame.unionByName, done).withColumns(text)


# ---------------------------------------------------------------- Merkle hashes
_COLUMNS = {"id": "array<int>", "edge": "string", "state": "string", "text": "string", "payload": "string"}
_NONE = f"CAST(array() AS {rows_of(_COLUMNS)})"


def _child(place: str | int, edge: str, text: str) -> str:
    return struct_of(_COLUMNS, {"id": below("id", place), "edge": edge, "state": "'type'", "text": text})


def _own(state: str, payload: str) -> str:
    return f"array({struct_of(_COLUMNS, {'id': 'id', 'edge': 'edge', 'state': state, 'payload': payload})})"


#: One level of a type t: a node of its own, and its children by name or place. Flags of fields don't count.
_PAYLOAD = f"""concat_ws(':', coalesce(t.kind, '?'), CASE WHEN t.kind IN ('primitive', 'reference') THEN t.name WHEN t.kind = 'literal' THEN concat({literal_kind("t.value")}, ':', {literal_text("t.value")})
WHEN t.kind = 'enum' THEN to_json(named_struct('name', t.name, 'variants', t.variants)) END)"""
_APART = f"""CASE WHEN state <> 'type' THEN {_own("state", "payload")}
WHEN t.kind IN ('array', 'object', 'union') THEN concat({_own("'whole'", _PAYLOAD)}, coalesce(CASE t.kind WHEN 'array' THEN array({_child(0, "''", "t.element")})
  WHEN 'object' THEN transform(map_entries(t.fields), (e, i) -> {_child("i", "e.key", "get_json_object(e.value, '$.type')")}) ELSE transform(t.options, (o, i) -> {_child("i", "lpad(string(i), 9, '0')", "o")}) END, {_NONE}))
ELSE {_own("'leaf'", _PAYLOAD)} END"""


def _apart(rows: DataFrame) -> DataFrame:
    read = rows.withColumn("t", F.expr(f"CASE WHEN state = 'type' THEN {parsed('text')} END"))
    return read.select("key", F.explode(F.expr(_APART)).alias("n")).select("key", "n.*")


def type_hashes(types: DataFrame) -> DataFrame:
    """F4 as hashes: (text, hash) of the distinct types of a column `text`, equal where the types are.

    A node's hash is that of its kind, its own values and its children's hashes, by name or place; it is built from the deepest level up.
    """
    texts = cut(types.select("text").where("text is not null").distinct().withColumn("key", F.sha2("text", 256)))
    start = texts.select("key", F.array().cast("array<int>").alias("id"), F.lit("").alias("edge"), F.lit("type").alias("state"), "text", F.lit(None).cast("string").alias("payload"))
    nodes = unfold(start, _apart).select("key", "id", "edge", "state", "payload")
    none = F.array().cast("array<struct<edge:string,hash:string>>")
    known: DataFrame | None = None
    deepest = nodes.agg(F.coalesce(F.max(F.size("id")), F.lit(0))).first()[0]
    for level in range(deepest, -1, -1):
        here = nodes.where(F.size("id") == level)
        if known is None:
            here = here.withColumn("held", none)
        else:
            held = known.groupBy(F.col("key").alias("k"), parent(F.col("id")).alias("up")).agg(F.array_sort(F.collect_set(F.struct("edge", "hash"))).alias("held"))
            here = here.join(held, F.expr("key = k and id = up"), "left").withColumn("held", F.coalesce("held", none))
        known = here.select("key", "id", "edge", F.sha2(F.to_json(F.struct("payload", "held")), 256).alias("hash"))
    return texts.join(known.select(F.col("key").alias("k"), "hash"), F.expr("key = k")).select("text", "hash")
