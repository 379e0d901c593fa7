"""Go sources: Gin handlers and net/http calls (G1-G8), by regular expressions over text without comments."""

from __future__ import annotations

import re

from .types import DYNAMIC, SERVER_VERBS, array, field, obj, primitive, reference, schema_of

_COMMENT = re.compile(r'("(?:\\.|[^"\\])*"|`[^`]*`)|//[^\n]*|/\*.*?\*/', re.DOTALL)
_STRUCT = re.compile(r"\btype\s+(\w+)\s+struct\s*\{(.*?)\n\}", re.DOTALL)
_FIELD = re.compile(r'^\s*(\w+)\s+([\w.\[\]*{}]+(?:\[[^\]]*\][\w.*]+)?)\s*(?:`([^`]*)`)?\s*$')
_GROUP = re.compile(r'\b(\w+)\s*:?=\s*(\w+)\.Group\(\s*"([^"]*)"')
_ROUTE = re.compile(r'\b(\w+)\.(GET|POST|PUT|PATCH|DELETE)\(\s*"([^"]*)"\s*,(.*)\)')
_FUNC = re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(\s*\w+\s+\*gin\.Context\s*\)\s*\{(.*?)\n\}", re.DOTALL)
_JSON = re.compile(r"\.JSON\(\s*[^,]+,\s*&?(\w+)\{")
_CALL = re.compile(r"\b(http|client)\.(\w+)\(\s*([^,)]*)")
# Go's numeric types.
_NUMBERS = re.compile(r"^(u?int(8|16|32|64)?|float(32|64)|byte|rune|uintptr)$")


def bare(text: str) -> str:
    """text with comments as blanks; line breaks stay."""
    return _COMMENT.sub(lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), text)


def go_type(t: str, structs: dict[str, dict]) -> tuple[dict, bool]:
    """G1: (type, is a pointer)."""
    if t.startswith("*"):
        return go_type(t[1:], structs)[0], True
    if t.startswith("["):
        return array(go_type(t[t.index("]") + 1 :], structs)[0]), False
    if t.startswith("map") or t in ("interface{}", "any"):
        return primitive("any"), False
    if "." in t:
        return primitive("unknown"), False
    if _NUMBERS.match(t):
        return primitive("number"), False
    if t in ("string", "bool"):
        return primitive("string" if t == "string" else "boolean"), False
    return (obj(structs[t]) if t in structs else reference(t)), False


def structs_of(text: str) -> dict[str, dict]:
    """Json names of tags; `-` is left out, omitempty makes optional."""
    found: dict[str, dict] = {}
    for name, body in _STRUCT.findall(text):
        fields = {}
        for line in body.split("\n"):
            m = _FIELD.match(line)
            if not m:
                continue
            tag = re.search(r'json:"([^"]*)"', m[3] or "")
            parts = tag[1].split(",") if tag else [""]
            if parts[0] == "-":
                continue
            t, pointer = go_type(m[2], found)
            fields[parts[0] or m[1]] = field(t, pointer or "omitempty" in parts[1:], pointer)
        found[name] = fields
    return found


def groups_of(text: str) -> dict[str, str]:
    """Full prefix of each route group; a cycle ends where it closes."""
    own = {v: (p, x) for v, p, x in _GROUP.findall(text)}

    def full(v: str, seen: frozenset[str]) -> str:
        if v not in own or v in seen:
            return ""
        return full(own[v][0], seen | {v}) + own[v][1]

    return {v: full(v, frozenset()) for v in own}


def _place(text: str, at: int) -> dict:
    return {"line": text.count("\n", 0, at) + 1, "col": at - text.rfind("\n", 0, at)}


def server_handlers(path: str, text: str) -> list[dict]:
    """G4-G6."""
    text = bare(text)
    structs, groups = structs_of(text), groups_of(text)
    shapes: dict[str, dict | None] = {}
    for name, body in _FUNC.findall(text):
        hit = _JSON.search(body)
        shapes[name] = obj(structs[hit[1]]) if hit and hit[1] in structs else None
    out = []
    for m in _ROUTE.finditer(text):
        if not (re.fullmatch(r"router\d*", m[1]) or m[1] in groups):
            continue
        last = m[4].split(",")[-1].strip().rsplit(".", 1)[-1]
        out.append({"method": m[2], "route": groups.get(m[1], "") + m[3], "framework": "gin", "schema": schema_of(shapes.get(last)), **_place(text, m.start())})
    return out


def url_template(expression: str) -> str:
    """Literals joined by +, everything else dynamic."""
    parts = [p.strip() for p in expression.split("+")]
    return "".join(p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in '"`' else DYNAMIC for p in parts)


def client_calls(path: str, text: str) -> list[dict]:
    """G8."""
    text = bare(text)
    out = []
    for m in _CALL.finditer(text):
        if m[2].lower() in SERVER_VERBS:
            route = url_template(m[3])
            out.append({"method": m[2].upper(), "route": route, "dynamic": DYNAMIC in route, "framework": "unknown", "schema": None, **_place(text, m.start())})
    return out
