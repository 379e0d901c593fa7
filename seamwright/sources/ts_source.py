"""TypeScript and JavaScript sources: calls, handlers and types, by a scanner and small recursive readers.

Types and constants are looked up in the same file; an imported constant leaves a hole in a route, between the marks HOLE, to be filled by joins. Anything not understood is left unknown, never guessed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

from .types import DYNAMIC, SERVER_VERBS, VERBS, array, field, literal, obj, primitive, reference, schema_of, union

_SCAN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|(?P<mark>=>|\?\.|\.\.\.|[-+*/%&|^!=<>?:;,.(){}\[\]@#~])""",
    re.DOTALL,
)
# Fixed values.
_KEYWORDS = {"string": "string", "number": "number", "boolean": "boolean", "any": "any", "unknown": "unknown", "null": "null", "undefined": "undefined", "void": "undefined", "never": "unknown", "object": "unknown", "bigint": "number"}
_NOT_HTTP = ("headers", "searchparams", "map")
_HTTP = ("axios", "api", "client", "http")
HOLE = ("\x01", "\x02")
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Source:
    """Tokens of a file with matching brackets, declared types and constants."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[Token] = []
        self._scan(0, len(text), self.tokens)
        self.tokens.append(Token("end", "", len(text)))
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(k)
            elif t.kind == "mark" and t.text in ")]}" and stack:
                j = stack.pop()
                self.match[j], self.match[k] = k, j
        self.lines = [m.end() for m in re.finditer("\n", text)]
        self.types: dict[str, int] = {}
        self.consts: dict[str, int] = {}
        self.functions: dict[str, int] = {}
        self.imported = {name for name, _, _ in imports("", text)}
        depth = 0
        for k, t in enumerate(self.tokens[:-2]):
            if t.text in _OPEN and t.kind == "mark":
                depth += 1
            elif t.kind == "mark" and t.text in ")]}":
                depth -= 1
            after = self.tokens[k + 1]
            if depth or t.kind != "name" or after.kind != "name":
                continue
            if t.text in ("interface", "type"):
                self.types.setdefault(after.text, k)
            elif t.text == "const":
                self.consts.setdefault(after.text, k + 1)
            elif t.text == "function":
                self.functions.setdefault(after.text, k)

    @classmethod
    @lru_cache(1)
    def of(cls, text: str) -> Source:
        """A file that several readers ask for in turn is scanned once; readers only read it."""
        return cls(text)

    def _scan(self, at: int, end: int, out: list[Token]) -> int:
        while at < end:
            m = _SCAN.match(self.text, at)
            if not m:
                at += 1
                continue
            if m["tick"]:
                stop = self._template_end(at)
                out.append(Token("template", self.text[at + 1 : stop - 1], at))
                at = stop
                continue
            if not m["skip"]:
                out.append(Token(m.lastgroup or "mark", m[0], at))
            at = m.end()
        return at

    def _template_end(self, at: int) -> int:
        at += 1
        while at < len(self.text) and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 1
            elif self.text.startswith("${", at):
                depth, at = 1, at + 2
                while at < len(self.text) and depth:
                    if self.text[at] == "`":
                        at = self._template_end(at) - 1
                    depth += {"{": 1, "}": -1}.get(self.text[at], 0)
                    at += 1
                continue
            at += 1
        return min(at + 1, len(self.text))

    def is_(self, k: int, text: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].text == text and self.tokens[k].kind in ("mark", "name")

    def place(self, k: int) -> dict:
        at = self.tokens[k].at
        line = bisect_right(self.lines, at)
        return {"line": line + 1, "col": at - (self.lines[line - 1] if line else 0) + 1}

    def arguments(self, k: int) -> list[tuple[int, int]]:
        """Token ranges between commas of the bracket at k."""
        out, start, j, close = [], k + 1, k + 1, self.match.get(k, k + 1)
        while j < close:
            if self.is_(j, ","):
                out.append((start, j))
                start = j + 1
            j = self.match[j] if j in self.match and self.tokens[j].text in _OPEN else j
            j += 1
        return [*out, (start, close)] if start < close else out

    def generic(self, k: int) -> tuple[int, int]:
        """(first token inside, token after `>`) of type arguments at k, or (k, k)."""
        if not self.is_(k, "<"):
            return k, k
        depth, j = 0, k
        while j < len(self.tokens) - 1:
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if not depth:
                    return k + 1, j + 1
            elif self.tokens[j].text in _OPEN and j in self.match:
                j = self.match[j]
            elif self.tokens[j].text in (";", ")"):
                break
            j += 1
        return k, k

    # ------------------------------------------------------------ types
    def type_at(self, k: int, seen: tuple[str, ...] = ()) -> tuple[dict, int]:
        """(type, token after it) of the type that begins at k."""
        if self.is_(k, "|"):
            k += 1
        first, k = self._one_type(k, seen)
        options = [first]
        while self.is_(k, "|"):
            more, k = self._one_type(k + 1, seen)
            options.append(more)
        return (first if len(options) == 1 else union(options)), k

    def _one_type(self, k: int, seen: tuple[str, ...]) -> tuple[dict, int]:
        t = self.tokens[k]
        if t.kind == "string":
            out, k = literal(t.text[1:-1]), k + 1
        elif t.kind == "number":
            out, k = literal(float(t.text) if "." in t.text else int(t.text, 0)), k + 1
        elif t.text == "(" and k in self.match:
            out, k = self.type_at(k + 1, seen)[0], self.match[k] + 1
            if self.is_(k, "=>"):
                _, k = self.type_at(k + 1, seen)
                out = primitive("unknown")
        elif t.text == "{" and k in self.match:
            out, k = obj(self.members(k, seen)), self.match[k] + 1
        elif t.text == "[" and k in self.match:
            inner = [self.type_at(a, seen)[0] for a, _ in self.arguments(k)]
            out, k = array(union(inner) if inner else primitive("unknown")), self.match[k] + 1
        elif t.kind == "name":
            out, k = self._named(k, seen)
        else:
            return primitive("unknown"), k + 1
        while self.is_(k, "[") and self.is_(k + 1, "]"):
            out, k = array(out), k + 2
        return out, k

    def _named(self, k: int, seen: tuple[str, ...]) -> tuple[dict, int]:
        name = self.tokens[k].text
        k += 1
        while self.is_(k, ".") and self.tokens[k + 1].kind == "name":
            name, k = f"{name}.{self.tokens[k + 1].text}", k + 2
        inside, after = self.generic(k)
        if name in ("Array", "ReadonlyArray") and after > k:
            return array(self.type_at(inside, seen)[0]), after
        if name == "Partial" and after > k:
            t = self.type_at(inside, seen)[0]
            return (obj({f: {**v, "optional": True} for f, v in t["fields"].items()}) if t["kind"] == "object" else t), after
        if name in ("true", "false"):
            return literal(name == "true"), after
        if name in _KEYWORDS:
            return primitive(_KEYWORDS[name]), after
        if name in self.types and name not in seen:
            return self.declared(name, (*seen, name)), after
        return reference(name), after

    def declared(self, name: str, seen: tuple[str, ...]) -> dict:
        k = self.types[name]
        if self.tokens[k].text == "type":
            j = k + 2
            while not self.is_(j, "=") and self.tokens[j].kind != "end":
                j += 1
            return self.type_at(j + 1, seen)[0]
        fields: dict[str, dict] = {}
        j = k + 2
        while not self.is_(j, "{") and self.tokens[j].kind != "end":
            base = self.tokens[j].text
            if base in self.types and base not in seen:
                up = self.declared(base, (*seen, base))
                fields |= up["fields"] if up["kind"] == "object" else {}
            j += 1
        return obj(fields | self.members(j, seen))

    def members(self, k: int, seen: tuple[str, ...]) -> dict[str, dict]:
        """Property signatures of the braces at k."""
        out: dict[str, dict] = {}
        j, close = k + 1, self.match.get(k, k + 1)
        while j < close:
            if self.is_(j, "readonly") and self.tokens[j + 1].kind in ("name", "string"):
                j += 1
            name = self.tokens[j]
            optional = self.is_(j + 1, "?")
            colon = j + 1 + optional
            if name.kind in ("name", "string") and self.is_(colon, ":"):
                parts, j = self._parts(colon + 1, seen)
                none, missing = primitive("null") in parts, primitive("undefined") in parts and len(parts) > 1
                out[name.text.strip("\"'")] = field(union(parts) if len(parts) > 1 else parts[0], optional or missing, none and len(parts) > 1)
            elif name.kind in ("name", "string") and (self.is_(colon, ";") or self.is_(colon, ",") or colon >= close):
                out[name.text.strip("\"'")] = field(primitive("unknown"), optional)
                j = colon
            while j < close and not (self.is_(j, ";") or self.is_(j, ",")):
                if self.tokens[j].kind in ("name", "string") and (self.is_(j + 1, ":") or (self.is_(j + 1, "?") and self.is_(j + 2, ":"))):
                    break
                j = (self.match[j] if j in self.match and self.tokens[j].text in _OPEN else j) + 1
            if self.is_(j, ";") or self.is_(j, ","):
                j += 1
        return out

    def _parts(self, k: int, seen: tuple[str, ...]) -> tuple[list[dict], int]:
        k += self.is_(k, "|")
        one, k = self._one_type(k, seen)
        parts = [one]
        while self.is_(k, "|"):
            one, k = self._one_type(k + 1, seen)
            parts.append(one)
        return parts, k

    # ------------------------------------------------------------ values
    def path(self, lo: int, hi: int, hops: int = 2) -> str:
        """The route that tokens lo..hi build: literals as they are, anything else dynamic."""
        parts, start, j = [], lo, lo
        while j < hi:
            if self.is_(j, "+"):
                parts.append((start, j))
                start = j + 1
            j = (self.match[j] if j in self.match and self.tokens[j].text in _OPEN else j) + 1
        parts.append((start, hi))
        return "".join(self._path_part(a, b, hops) for a, b in parts)

    def _path_part(self, lo: int, hi: int, hops: int) -> str:
        t = self.tokens[lo]
        if hi - lo == 1 and t.kind == "string":
            return t.text[1:-1]
        if hi - lo == 1 and t.kind == "template":
            return re.sub(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: self._constant(m[1].strip(), hops), t.text)
        if all(x.kind == "name" or x.text == "." for x in self.tokens[lo:hi]):
            return self._constant("".join(x.text for x in self.tokens[lo:hi]), hops)
        return DYNAMIC

    def _constant(self, name: str, hops: int) -> str:
        """A module constant's string, or that of a constant object's property; else dynamic."""
        head, _, key = name.partition(".")
        if head not in self.consts or hops <= 0:
            return f"{HOLE[0]}{name}{HOLE[1]}" if head in self.imported and hops > 0 and "." not in key else DYNAMIC
        j = self.consts[head] + 1
        while not self.is_(j, "=") and self.tokens[j].kind != "end" and not self.is_(j, ";"):
            j += 1
        value = self.tokens[j + 1]
        if not key and value.kind == "string":
            return value.text[1:-1]
        if not key and value.kind == "template":
            return self._path_part(j + 1, j + 2, hops - 1)
        if key and value.text == "{":
            for a, b in self.arguments(j + 1):
                if b - a == 3 and self.tokens[a].text.strip("\"'") == key and self.tokens[a + 2].kind == "string":
                    return self.tokens[a + 2].text[1:-1]
        return DYNAMIC

    def value_type(self, lo: int, hi: int) -> dict:
        """The type of a literal value; spreads and computed keys are left out."""
        t = self.tokens[lo]
        if t.text == "{" and lo in self.match:
            out: dict[str, dict] = {}
            for a, b in self.arguments(lo):
                if self.tokens[a].kind in ("name", "string"):
                    whole = b - a > 2 and self.is_(a + 1, ":")
                    out[self.tokens[a].text.strip("\"'")] = field(self.value_type(a + 2, b) if whole else primitive("unknown"))
            return obj(out)
        if t.text == "[" and lo in self.match:
            inner = self.arguments(lo)
            return array(self.value_type(*inner[0]) if inner else primitive("unknown"))
        if t.kind in ("string", "template"):
            return primitive("string")
        if t.kind == "number" or (t.text == "-" and self.tokens[lo + 1].kind == "number"):
            return primitive("number")
        if t.kind == "name" and t.text in ("true", "false", "null", "undefined"):
            return primitive("boolean" if t.text in ("true", "false") else t.text)
        if t.kind == "name":
            return reference(t.text + ("()" if self.is_(lo + 1, "(") else ""))
        return primitive("unknown")

    def option(self, lo: int, name: str) -> tuple[int, int] | None:
        """Tokens of a property's value in the object literal at lo."""
        if not self.is_(lo, "{"):
            return None
        for a, b in self.arguments(lo):
            if self.tokens[a].text.strip("\"'") == name and self.is_(a + 1, ":"):
                return a + 2, b
        return None

    def expected(self, call: int, inside: int, after: int, close: int) -> dict | None:
        """What a client expects: the call's type argument, the variable's annotation, the names taken apart, a cast of json()."""
        if after > inside:
            return self.type_at(inside)[0]
        j = call - 1
        while j > 0 and (self.tokens[j].text in ("await", "(", "=>", "async") or self.is_(j, ")")):
            j -= 1
        if self.is_(j, "="):
            k = j
            while k > 0 and self.tokens[k].text not in ("const", "let", "var", ";"):
                k -= 1
            if self.tokens[k].text in ("const", "let", "var"):
                if self.tokens[k + 1].kind == "name" and self.is_(k + 2, ":"):
                    return self._unwrapped(k + 3)
                if self.is_(k + 1, "{") and k + 1 in self.match and self.match[k + 1] + 1 == j:
                    names = {}
                    for a, b in self.arguments(k + 1):
                        if self.tokens[a].kind == "name":
                            names[self.tokens[a].text] = field(primitive("unknown"), any(self.is_(x, "=") for x in range(a, b)))
                    return obj(names) if names else None
        if self.is_(close + 1, ".") and self.is_(close + 2, "then") and close + 3 in self.match:
            for x in range(close + 3, self.match[close + 3]):
                if self.is_(x, "json") and self.is_(x + 1, "(") and self.is_(x + 3, "as"):
                    return self._unwrapped(x + 4)
        return None

    def _unwrapped(self, k: int) -> dict:
        """A type; of one with a single type argument, such as a promise, the argument."""
        inside, after = self.generic(k + 1)
        if self.tokens[k].kind == "name" and after > k + 1 and self.tokens[k].text not in ("Array", "ReadonlyArray", "Record", "Partial"):
            return self.type_at(inside)[0]
        return self.type_at(k)[0]


def client_calls(path: str, text: str) -> list[dict]:
    """C1-C17. A call found inside another one's arguments is part of it."""
    s, out, k = Source.of(text), [], 0
    while k < len(s.tokens) - 1:
        found = _call_at(s, k)
        if found is None:
            k += 1
            continue
        row, close = found
        out.append(row)
        k = close + 1
    return out


def _call_at(s: Source, k: int) -> tuple[dict, int] | None:
    t = s.tokens[k]
    if t.kind != "name":
        return None
    inside, after = s.generic(k + 1)
    if not s.is_(after, "(") or after not in s.match:
        return None
    member = s.is_(k - 1, ".") or s.is_(k - 1, "?.")
    close, args = s.match[after], s.arguments(after)
    start = k
    while s.is_(start - 1, ".") and s.tokens[start - 2].kind == "name":
        start -= 2
    receiver = "".join(x.text for x in s.tokens[start : k - 1]).lower()
    method, where, framework = None, None, "unknown"
    if member and t.text in VERBS and args:
        if receiver.rsplit(".", 1)[-1] in _NOT_HTTP or not receiver:
            return None
        lo, hi = args[0]
        url = s.option(lo, "url")
        http = any(p in receiver for p in _HTTP)
        if url or http or _looks_like_path(s, lo):
            method, where, framework = t.text.upper(), url or (lo, hi), "axios" if http else "unknown"
    elif member and t.text == "request" and args:
        url, verb = s.option(args[0][0], "url"), s.option(args[0][0], "method")
        if url:
            method, where, framework = _verb(s, verb), url, "axios"
    elif not member and t.text == "fetch" and args:
        verb = s.option(args[1][0], "method") if len(args) > 1 else None
        method, where, framework = _verb(s, verb), args[0], "fetch"
    elif not member and t.text in ("useQuery", "useSuspenseQuery"):
        method, framework = "GET", "react-query"
        at = next((j for j in range(after + 1, close) if _looks_like_path(s, j)), None)
        if at is None:
            return None
        where = (at, at + 1)
    if method is None or where is None:
        return None
    route = s.path(*where)
    shape = s.expected(start, inside, after, close)
    return {"method": method, "route": route, "dynamic": DYNAMIC in route, "framework": framework, "schema": schema_of(shape), "ref": reference_of(shape), **s.place(start)}, close


def reference_of(t: dict | None) -> str | None:
    """The name of a type that this file doesn't declare."""
    return t["name"] if t and t["kind"] == "reference" else None


def imports(path: str, text: str) -> list[tuple[str, str, str]]:
    """(local name, specifier, imported name) of named imports; default and namespace imports are left out."""
    out = []
    for names, spec in re.findall(r"""\bimport\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\s*["']([^"']+)["']""", text):
        for part in names.split(","):
            words = part.replace("type ", " ").split()
            if words:
                out.append((words[-1], spec, words[0]))
    return out


def without_holes(route: str) -> str:
    return re.sub(f"{HOLE[0]}[^{HOLE[1]}]*{HOLE[1]}", DYNAMIC, route)


def constants(path: str, text: str) -> list[tuple[str, str, str]]:
    """(name, key, string) of constants at the top of a file, and of the string properties of constant objects."""
    s, out = Source.of(text), []
    for name, k in s.consts.items():
        j = k + 1
        while not s.is_(j, "=") and not s.is_(j, ";") and s.tokens[j].kind != "end":
            j += 1
        if not s.is_(j, "="):
            continue
        if s.tokens[j + 1].kind == "string" and not s.is_(j + 2, "+"):
            out.append((name, "", s.tokens[j + 1].text[1:-1]))
        elif s.is_(j + 1, "{"):
            out += [(name, s.tokens[a].text.strip("\"'"), s.tokens[a + 2].text[1:-1]) for a, b in s.arguments(j + 1) if b - a == 3 and s.is_(a + 1, ":") and s.tokens[a + 2].kind == "string"]
    return out


def declarations(path: str, text: str) -> list[tuple[str, dict]]:
    """The object types that a file declares at its top."""
    s = Source.of(text)
    found = [(name, s.declared(name, (name,))) for name in s.types]
    return [(name, {"fields": t["fields"]}) for name, t in found if t["kind"] == "object"]


def _looks_like_path(s: Source, k: int) -> bool:
    t = s.tokens[k]
    return (t.kind == "string" and t.text[1:2] == "/") or (t.kind == "template" and "/" in t.text)


def _verb(s: Source, where: tuple[int, int] | None) -> str:
    t = s.tokens[where[0]] if where else None
    name = t.text[1:-1].upper() if t and t.kind == "string" else "GET"
    return name if name.lower() in VERBS else "UNKNOWN"


def framework_of(text: str) -> str:
    """V1."""
    return next((f for f in ("fastify", "express", "next") if re.search(rf"\b{f}\b", text, re.IGNORECASE)), "express")


def _response(s: Source, lo: int, hi: int) -> dict | None:
    """V2-V7: a handler's return type, else its first literal answer."""
    body = next((j for j in range(lo, hi) if s.is_(j, "{") and (s.is_(j - 1, "=>") or s.is_(j - 1, ")") or s.tokens[j - 1].kind == "name" or s.is_(j - 1, ">"))), lo)
    opening = next((j for j in range(lo, hi) if s.is_(j, "(") and j in s.match), None)
    if opening is not None and s.is_(s.match[opening] + 1, ":"):
        found = s._unwrapped(s.match[opening] + 2)
        if found["kind"] == "object":
            return found
    for j in range(body, hi):
        answer = s.tokens[j].text in ("json", "send") and s.is_(j - 1, ".") and s.is_(j + 1, "(") and j + 1 in s.match
        if answer or (s.is_(j, "return") and s.tokens[j + 1].text in "{["):
            a, b = (j + 2, s.match[j + 1]) if answer else (j + 1, s.match.get(j + 1, j + 1) + 1)
            t = s.tokens[a]
            if t.text == "{":
                return s.value_type(a, b)
            if answer and t.kind == "name":
                at = next((x for x in range(lo, j) if s.tokens[x].text in ("const", "let", "var") and s.tokens[x + 1].text == t.text), None)
                if at is not None and s.is_(at + 2, ":"):
                    return s.type_at(at + 3)[0]
                if at is not None and s.is_(at + 2, "="):
                    return s.value_type(at + 3, hi)
            return None
    return None


def _shape(s: Source, lo: int, hi: int) -> dict:
    """schema as far as the file tells, and the name of an annotated type from elsewhere, which would win."""
    answer = _response(s, lo, hi)
    opening = next((j for j in range(lo, hi) if s.is_(j, "(") and j in s.match), None)
    named = s._unwrapped(s.match[opening] + 2) if opening is not None and s.is_(s.match[opening] + 1, ":") else None
    return {"schema": schema_of(answer), "ref": reference_of(named) or reference_of(answer)}


def server_handlers(path: str, text: str) -> list[dict]:
    """V8, V9: `<x>.<verb>("path", …, handler)`, then exported functions of an app-router file."""
    s, out, kind = Source.of(text), [], framework_of(text)
    for k in range(2, len(s.tokens) - 2):
        if s.tokens[k].text in SERVER_VERBS and s.is_(k - 1, ".") and s.is_(k + 1, "(") and k + 1 in s.match:
            args = s.arguments(k + 1)
            if len(args) < 2 or s.tokens[args[0][0]].kind != "string":
                continue
            lo, hi = args[-1]
            name = s.tokens[lo].text
            if hi - lo == 1 and name in s.functions:
                lo, hi = s.functions[name], len(s.tokens) - 1
                hi = next((s.match[j] for j in range(lo, hi) if s.is_(j, "{") and j in s.match), hi)
            start = k - 2
            out.append({"method": s.tokens[k].text.upper(), "route": s.tokens[args[0][0]].text[1:-1], "framework": kind, **_shape(s, lo, hi), **s.place(start)})
    found = re.search(r"(?:^|/)app/(.*?)/?route\.(?:ts|tsx|js|jsx)$", path)
    if found:
        parts = [re.sub(r"^\[(\w+)\]$", r":\1", p) for p in found[1].split("/") if p]
        for name, k in s.functions.items():
            if name in {v.upper() for v in SERVER_VERBS}:
                close = next((s.match[j] for j in range(k, len(s.tokens)) if s.is_(j, "{") and j in s.match), len(s.tokens) - 1)
                out.append({"method": name, "route": "/" + "/".join(parts), "framework": "nextjs", **_shape(s, k, close), **s.place(k)})
    return out + _pages_api(s, path)


def _pages_api(s: Source, path: str) -> list[dict]:
    """The default export of a file below pages/api, by the methods its branches name; else one GET.

    The type argument of the second parameter's NextApiResponse wins over what the branches answer.
    """
    found = re.search(r"(?:^|/)pages/api/(.*)\.(?:ts|tsx|js|jsx)$", path)
    k = next((k for k in range(len(s.tokens) - 2) if s.is_(k, "export") and s.is_(k + 1, "default")), None)
    if not found or k is None:
        return []
    k += 2 + s.is_(k + 2, "async")
    opening = next((j for j in range(k, min(k + 3, len(s.tokens))) if s.is_(j, "(") and j in s.match), None)
    body = next((j for j in range(s.match[opening] + 1, len(s.tokens)) if s.is_(j, "{") and j in s.match), None) if opening is not None else None
    if body is None or not (s.is_(k, "function") or s.is_(body - 1, "=>")):
        return []
    parts = [re.sub(r"^\[(\w+)\]$", r":\1", p) for p in re.sub(r"/index$", "", found[1]).split("/") if p]
    declared = _response_argument(s, opening)
    own = {"schema": schema_of(declared), "ref": reference_of(declared)} if declared else None
    row = lambda method, lo, hi: {"method": method, "route": "/api/" + "/".join(parts), "framework": "nextjs", **(own or _shape(s, lo, hi)), **s.place(lo)}
    out = []
    for j in range(body, s.match[body]):
        if s.is_(j, "if") and j + 1 in s.match and (method := _method_check(s, j + 1)):
            then = s.match[j + 1] + 1
            stop = s.match[then] if s.is_(then, "{") and then in s.match else next((x for x in range(then, s.match[body]) if s.is_(x, ";")), s.match[body])
            out.append(row(method, j, stop + 1))
    return out or [row("GET", k, s.match[body])]


def _method_check(s: Source, k: int) -> str | None:
    """The method that the condition in the brackets at k compares req.method with."""
    inner = s.tokens[k + 1 : s.match[k]]
    words = " ".join(t.text for t in inner)
    if not inner or inner[-1].kind != "string" or any(t.text in "&|" and t.kind == "mark" for t in inner) or "req . method" not in words:
        return None
    name = inner[-1].text[1:-1].upper()
    return name if name.lower() in VERBS else "UNKNOWN"


def _response_argument(s: Source, k: int) -> dict | None:
    """T of a second parameter `res: NextApiResponse<T>`; `any` or none tells nothing."""
    args = s.arguments(k)
    if len(args) < 2:
        return None
    at = next((j for j in range(*args[1]) if s.is_(j, "NextApiResponse")), None)
    inside, after = s.generic(at + 1) if at is not None else (0, 0)
    return None if after <= inside or s.is_(inside, "any") else s.type_at(inside)[0]


def usages(path: str, text: str) -> list[dict]:
    """B2: for each call, what the file reads of the variable it is bound to.

    accessed: property names read by name, and the source names of renamed destructured ones; computed: is any index no string;
    unguarded: names that are read further (`.x`, `[x]`, a call) without `?.`. Names count file-wide, whatever their scope.
    """
    s = Source.of(text)
    at = {s.tokens[k].at: k for k in range(len(s.tokens))}
    out = []
    for call in client_calls(path, text):
        start = s.lines[call["line"] - 2] if call["line"] > 1 else 0
        names, accessed = _bound(s, at[start + call["col"] - 1])
        computed, unguarded = False, set()
        for k, t in enumerate(s.tokens):
            if t.kind != "name" or t.text not in names or s.is_(k - 1, ".") or s.is_(k - 1, "?."):
                continue
            if (s.is_(k + 1, ".") or s.is_(k + 1, "?.")) and s.tokens[k + 2].kind == "name":
                prop, after = s.tokens[k + 2].text, k + 3
            elif s.is_(k + 1, "[") and k + 1 in s.match:
                if s.tokens[k + 2].kind != "string" or s.match[k + 1] != k + 3:
                    computed = True
                    continue
                prop, after = s.tokens[k + 2].text[1:-1], k + 4
            else:
                continue
            accessed.add(prop)
            if s.tokens[after].kind == "mark" and s.tokens[after].text in (".", "[", "("):
                unguarded.add(prop)
        out.append({"line": call["line"], "col": call["col"], "accessed": sorted(accessed), "computed": computed, "unguarded": sorted(unguarded)})
    return out


def _bound(s: Source, k: int) -> tuple[set[str], set[str]]:
    """(names that the declaration around token k binds, source names of renamed ones)."""
    j = k
    while j > 0:
        j -= 1
        t = s.tokens[j]
        if t.kind == "mark" and t.text in ")]}":
            j = s.match.get(j, j)
        elif t.text == ";" or (t.text == "{" and not s.is_(j - 1, "=>")):
            return set(), set()
        elif t.text in ("const", "let", "var"):
            break
    else:
        return set(), set()
    if s.tokens[j + 1].kind == "name":
        return {s.tokens[j + 1].text}, set()
    names, renamed = set(), set()
    if s.is_(j + 1, "{") and j + 1 in s.match:
        for a, b in s.arguments(j + 1):
            if s.is_(a + 1, ":") and s.tokens[a].kind == "name" and a + 2 < b:
                renamed.add(s.tokens[a].text)
                names.add(s.tokens[a + 2].text)
            elif s.tokens[a].kind == "name":
                names.add(s.tokens[a].text)
    return names, renamed
