"""Building types as JSON-like values."""

from __future__ import annotations


def primitive(name: str) -> dict:
    return {"kind": "primitive", "name": name}


def literal(value: str | float | bool) -> dict:
    return {"kind": "literal", "value": value}


def array(element: dict) -> dict:
    return {"kind": "array", "element": element}


def reference(name: str) -> dict:
    return {"kind": "reference", "name": name}


def obj(fields: dict[str, dict]) -> dict:
    return {"kind": "object", "fields": fields}


def field(t: dict, optional: bool = False, nullable: bool = False) -> dict:
    return {"type": t, "optional": optional, "nullable": nullable}


def schema_of(t: dict | None) -> dict | None:
    """Schemas are objects; anything else is unknown."""
    return {"fields": t["fields"]} if t and t["kind"] == "object" else None


VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
SERVER_VERBS = VERBS[:5]
DYNAMIC = "__DYN__"


def union(options: list[dict]) -> dict:
    """Strings only make an enum; null and undefined are dropped; a single option is itself."""
    kept = [o for o in options if o not in (primitive("null"), primitive("undefined"))]
    if not kept:
        return primitive("null")
    if len(kept) == 1:
        return kept[0]
    if all(o["kind"] == "literal" and isinstance(o["value"], str) for o in kept):
        return {"kind": "enum", "name": "inline", "variants": [o["value"] for o in kept]}
    return {"kind": "union", "options": kept}
