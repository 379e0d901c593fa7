"""Python sources: FastAPI-like handlers and requests/httpx calls, by the standard library's ast."""

from __future__ import annotations

import ast

from .types import DYNAMIC, SERVER_VERBS, array, field, obj, primitive, reference, schema_of

# Fixed values.
_NAMES = {"str": "string", "int": "number", "float": "number", "bool": "boolean", "None": "null", "Any": "any", "dict": "any", "Dict": "any"}
_LISTS = ("List", "list", "Sequence", "Set", "set", "Tuple", "tuple")
_BASES = ("BaseModel", "Schema")
_RECEIVERS = ("requests", "httpx", "client", "session")


def annotation(node: ast.expr | None, models: dict[str, dict]) -> dict:
    """A field (type and flags) of an annotation."""
    if node is None:
        return field(primitive("unknown"))
    if isinstance(node, ast.Constant):
        if node.value is None:
            return field(primitive("null"))
        return annotation(ast.parse(node.value, mode="eval").body, models) if isinstance(node.value, str) else field(primitive("unknown"))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        sides = [node.left, node.right]
        none = [isinstance(s, ast.Constant) and s.value is None for s in sides]
        if any(none) and not all(none):
            return field(annotation(sides[none.index(False)], models)["type"], True, True)
        return field(primitive("unknown"))
    if isinstance(node, ast.Subscript):
        base = node.value.attr if isinstance(node.value, ast.Attribute) else getattr(node.value, "id", "")
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
        if base == "Optional":
            return field(annotation(inner, models)["type"], True, True)
        if base in _LISTS:
            return field(array(annotation(inner, models)["type"]))
        return field(primitive("any") if _NAMES.get(base) == "any" else reference(base))
    name = node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", "")
    if name in models:
        return field(obj(models[name]))
    return field(primitive(_NAMES[name]) if name in _NAMES else reference(name))


def models_of(tree: ast.Module) -> dict[str, dict]:
    """Pydantic models in order; a model named before its definition is seen as empty."""
    found: dict[str, dict] = {}
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef) and any((b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", "")) in _BASES for b in n.bases)]
    for c in classes:
        found[c.name] = {}
    for c in classes:
        found[c.name] = {s.target.id: annotation(s.annotation, found) for s in c.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)}
    return found


def template(node: ast.expr) -> str | None:
    """P5: a string, or an f-string with its interpolations as dynamic parts."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(p.value if isinstance(p, ast.Constant) else DYNAMIC for p in node.values)
    return None


def _literal(node: ast.expr) -> dict:
    if isinstance(node, ast.Constant):
        kinds = {bool: "boolean", str: "string", int: "number", float: "number", type(None): "null"}
        return primitive(kinds.get(type(node.value), "unknown"))
    if isinstance(node, (ast.List, ast.Tuple)):
        return array(_literal(node.elts[0]) if node.elts else primitive("unknown"))
    return primitive("any") if isinstance(node, ast.Dict) else primitive("unknown")


def _returned(function: ast.AST) -> dict | None:
    """The first non-empty dict that the function returns."""
    for n in ast.walk(function):
        if isinstance(n, ast.Return) and isinstance(n.value, ast.Dict) and n.value.keys:
            return obj({k.value: field(_literal(v)) for k, v in zip(n.value.keys, n.value.values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)})
    return None


def _keyword(call: ast.Call, name: str) -> ast.expr | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def prefixes(tree: ast.Module) -> dict[str, str]:
    """Routers of the file and their own prefixes."""
    out = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and getattr(n.value.func, "id", getattr(n.value.func, "attr", "")) == "APIRouter":
            p = _keyword(n.value, "prefix")
            for t in n.targets:
                if isinstance(t, ast.Name):
                    out[t.id] = (template(p) if p is not None else "") or ""
    return out


def server_handlers(path: str, text: str) -> list[dict]:
    """Decorated functions; the response is response_model, else the return annotation, else a returned dict."""
    tree = ast.parse(text)
    models, own, out = models_of(tree), prefixes(tree), []
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        for d in f.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in SERVER_VERBS and isinstance(d.func.value, ast.Name)):
                continue
            where = d.args[0] if d.args else _keyword(d, "path")
            route = template(where) if where is not None else None
            if route is None:
                continue
            model = _keyword(d, "response_model")
            shape = obj(models[model.id]) if isinstance(model, ast.Name) and model.id in models else None
            if shape is None and f.returns is not None:
                t = annotation(f.returns, models)["type"]
                shape = t["element"] if t["kind"] == "array" else t
                shape = shape if shape["kind"] == "object" else None
            shape = shape or _returned(f)
            out.append({"method": d.func.attr.upper(), "route": own.get(d.func.value.id, "") + route, "framework": "fastapi", "schema": schema_of(shape), "ref": d.func.value.id, "line": d.lineno, "col": d.col_offset + 1})
    return out


def client_calls(path: str, text: str) -> list[dict]:
    """`requests.get("…")` and the like."""
    out = []
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in SERVER_VERBS and isinstance(n.func.value, ast.Name) and n.func.value.id in _RECEIVERS and n.args:
            route = template(n.args[0])
            if route is not None:
                out.append({"method": n.func.attr.upper(), "route": route, "dynamic": DYNAMIC in route, "framework": "unknown", "schema": None, "line": n.lineno, "col": n.col_offset + 1})
    return out


def imports(text: str) -> list[tuple[str, str, str]]:
    """(local name, module, imported name or ''); stars and relative imports are left out."""
    out = []
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, ast.Import):
            out += [(a.asname or a.name, a.name, "") for a in n.names]
        elif isinstance(n, ast.ImportFrom) and not n.level:
            out += [(a.asname or a.name, n.module or "", a.name) for a in n.names if a.name != "*"]
    return out
