"""Row-by-row forms of the type operators: what the relational ones are held against."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from seamwright.operators.typecheck import MESSAGES, OPEN_NAMES


def widened(t: dict) -> str | None:
    """The primitive that a leaf type belongs to."""
    if t["kind"] == "primitive":
        return t["name"]
    if t["kind"] == "enum":
        return "string"
    if t["kind"] != "literal":
        return None
    value = t["value"]
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


def unverifiable(t: dict) -> bool:
    """D2."""
    return t["kind"] == "reference" or (t["kind"] == "primitive" and t["name"] in OPEN_NAMES)


def label(t: dict) -> str:
    """D3: how a type reads in a finding."""
    show = {
        "primitive": lambda: t["name"],
        "reference": lambda: t["name"],
        "literal": lambda: json.dumps(t["value"], ensure_ascii=False, separators=(",", ":")),
        "array": lambda: label(t["element"]) + "[]",
        "object": lambda: "{ " + ", ".join(t["fields"]) + " }",
        "union": lambda: " | ".join(map(label, t["options"])),
        "enum": lambda: "enum(" + " | ".join(t["variants"]) + ")",
    }
    return show[t["kind"]]()


def _finding(kind: str, path: str, words: str, severity: str = "error", expected: str | None = None, actual: str | None = None, **more: str) -> dict:
    text = MESSAGES[words].format(path=path, expected=expected, actual=actual, **more)
    return {"kind": kind, "severity": severity, "path": path, "message": text, "expected": expected, "actual": actual}


def _mutation(words: str, path: str, client: dict, server: dict, **more: str) -> dict:
    return _finding("type-mutation", path, words, expected=label(client), actual=label(server), **more)


def _same_literal(a: dict, b: dict) -> bool:
    x, y = a["value"], b.get("value")
    return b["kind"] == "literal" and isinstance(x, bool) == isinstance(y, bool) and isinstance(x, str) == isinstance(y, str) and x == y


def check_type(client: dict, server: dict, path: str) -> Iterator[dict]:
    """Findings where a value of the server's type may not be one of the client's."""
    kind, other = client["kind"], server["kind"]
    if unverifiable(client) or unverifiable(server):
        return
    if kind in ("object", "array"):
        if other != kind:
            yield _mutation(kind, path, client, server)
        elif kind == "object":
            yield from check_fields(client["fields"], server["fields"], path)
        else:
            yield from check_type(client["element"], server["element"], path + "[]")
    elif kind == "enum" and other == "enum":
        for variant in server["variants"]:
            if variant not in client["variants"]:
                yield _finding("enum-variant-added", path, "enum-variant-added", expected=label(client), actual=label(server), variant=variant)
    elif kind == "enum" and other == "literal":
        if server["value"] not in client["variants"] or not isinstance(server["value"], str):
            yield _mutation("enum", path, client, server)
    elif kind == "enum" and widened(server) == "string":
        return
    elif kind == "literal":
        if not _same_literal(client, server):
            yield _mutation("literal", path, client, server)
    elif kind == "union":
        if not any(accepts(option, server, path) for option in client["options"]):
            yield _mutation("union", path, client, server)
    elif other == "union":
        refused = [label(option) for option in server["options"] if not accepts(client, option, path)]
        if refused:
            yield _mutation("server-union", path, client, server, offers=" or ".join(refused))
    else:
        want, got = widened(client), widened(server)
        if want and got and want != got and {want, got} != {"null", "undefined"}:
            yield _finding("type-mutation", path, "primitive", expected=want, actual=got)


def accepts(client: dict, server: dict, path: str) -> bool:
    return next(check_type(client, server, path), None) is None


def check_fields(client: dict, server: dict, base: str = "") -> Iterator[dict]:
    """Field by field in the client's order; fields that only the server has don't count."""
    for name, want in client.items():
        path = f"{base}.{name}" if base else name
        got = server.get(name)
        if got is None:
            if not want.get("optional"):
                yield _finding("missing-field", path, "missing-field", expected=label(want["type"]))
            continue
        if got.get("nullable") and not want.get("nullable"):
            yield _finding("nullability-introduced", path, "nullability-introduced", "warning")
        if got.get("optional") and not want.get("optional"):
            yield _finding("optionality-introduced", path, "optionality-introduced")
        yield from check_type(want["type"], got["type"], path)


def compare_schemas(client: str | None, server: str | None) -> list[dict]:
    """Findings of two schemas as JSON; none where one is unknown."""
    if client is None or server is None:
        return []
    return list(check_fields(json.loads(client)["fields"], json.loads(server)["fields"]))


_PLAIN = {"primitive": "name", "reference": "name", "literal": "value"}


def diff_types(path: str, before: dict, after: dict) -> Iterator[dict]:
    """F3. Unions differ only in their number of options; enums of either kind never do."""
    kind = before["kind"]
    if kind != after["kind"]:
        yield {"path": path, "kind": "type-changed", "before": before, "after": after}
    elif kind in _PLAIN:
        a, b = before[_PLAIN[kind]], after[_PLAIN[kind]]
        if a != b or isinstance(a, bool) != isinstance(b, bool):
            yield {"path": path, "kind": "type-changed", "before": a, "after": b}
    elif kind == "array":
        yield from diff_types(path + "[]", before["element"], after["element"])
    elif kind == "object":
        yield from diff_fields(path, before["fields"], after["fields"])
    elif kind == "union" and len(before["options"]) != len(after["options"]):
        yield {"path": path, "kind": "type-changed", "before": before, "after": after}


def _flags(field: dict) -> dict:
    return {k: bool(field.get(k)) for k in ("optional", "nullable")}


def diff_fields(prefix: str, before: dict, after: dict) -> Iterator[dict]:
    """by name, sorted."""
    for name in sorted(before.keys() | after.keys()):
        path, a, b = (f"{prefix}.{name}" if prefix else name), before.get(name), after.get(name)
        if a is None or b is None:
            yield {"path": path, "kind": "added" if a is None else "removed"} | ({"after": b} if a is None else {"before": a})
            continue
        if _flags(a) != _flags(b):
            yield {"path": path, "kind": "optionality-changed", "before": _flags(a), "after": _flags(b)}
        yield from diff_types(path, a["type"], b["type"])


def canonical(t: dict) -> str:
    """equal strings for equal types; flags of object fields don't count."""
    if t["kind"] == "object":
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(t['fields'][k]['type'])}" for k in sorted(t["fields"])) + "}"
    if t["kind"] == "array":
        return canonical(t["element"]) + "[]"
    if t["kind"] == "union":
        return "(" + "|".join(map(canonical, t["options"])) + ")"
    return json.dumps(t, sort_keys=True)


def similarity(a: str, b: str) -> float:
    """of names without case, '_' and '-'."""
    x, y = (s.lower().replace("_", "").replace("-", "") for s in (a, b))
    if x == y:
        return 1.0
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return max(0.0, 1 - row[-1] / max(len(x), len(y), 1))


def detect_renames(changes: list[dict]) -> list[dict]:
    """pairs of a removed and an added field of equal type under one parent, most similar names first, each field once."""
    split = lambda p: p.rpartition(".")  # noqa: E731  F6
    gone, new = ([c for c in changes if c["kind"] == k] for k in ("removed", "added"))
    pairs = [
        (similarity(split(r["path"])[2], split(a["path"])[2]), r, a)
        for r in gone
        for a in new
        if split(r["path"])[0] == split(a["path"])[0] and canonical(r["before"]["type"]) == canonical(a["after"]["type"])
    ]
    pairs.sort(key=lambda p: -p[0])
    taken: set[tuple[str, str]] = set()
    out = []
    for s, r, a in pairs:
        keys = {("r", r["path"]), ("a", a["path"])}
        if taken & keys:
            continue
        taken |= keys
        confidence = math.floor(60 + 40 * s + 0.5)
        out.append({"old_path": r["path"], "new_path": a["path"], "type": label(r["before"]["type"]), "structural_similarity": min(1.0, 0.7 + 0.3 * s), "confidence": confidence, "proof_level": "STRONG" if confidence >= 80 else "POTENTIAL"})
    return sorted(out, key=lambda x: x["old_path"])
