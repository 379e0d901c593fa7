from collections import Counter

from pyspark.sql import functions as F

from seamwright.plans import check
from seamwright.plans.check import check_trees, impact_trees
from seamwright.sources import files, go_source, python_source, ts_source
from seamwright.streaming.landing import keep_parsed

CLIENT = {
    "src/user.ts": 'import axios from "axios";\nexport interface Person { id: number; name: string; email: string; age: number; role: "admin" | "guest" }\nexport const one = async (id: string) => (await axios.get<Person>(`/api/v1/people/${id}`)).data;\nexport const all = async () => axios.get<{ people: Person[] }>("/api/v1/people");\nexport const purge = () => axios.delete<{ ok: boolean }>("/api/v1/old");\n',
    "src/settings.ts": 'interface S { bio: string; nick: string; state: "on" | "off" }\nexport const get = (id) => axios.get<S>(`/api/v1/settings/${id}`);\n',
    "src/stock.ts": "interface Item { id: number; sku: string }\nasync function f(id) { const d: Item = await fetch(`/api/v1/stock/${id}`).then((r) => r.json()); return d; }\n",
    "src/order.ts": 'interface O { id: string; status: "open" | "done" }\nasync function f(id) { const d: O = await fetch("/api/v2/orderstatus/" + id).then((r) => r.json()); return d; }\n',
    "node_modules/x.ts": "fetch('/ignored')",
}
SERVER = {
    "src/people.ts": 'import express from "express";\nrouter.get("/api/v1/people/:id", (req, res) => { res.json({ id: 1, name: "a", age: "34", role: "admin" }); });\nrouter.get("/api/v1/people", (req, res) => { res.json({ people: [{ id: 1, name: "a", email: "e", age: 3, role: "x" }] }); });\n',
    "src/settings.ts": 'import Fastify from "fastify";\ninterface R { bio?: string; nick: string | null; state: "on" | "off" | "pending" }\nfastify.get("/api/v1/settings/:id", async (req, reply): Promise<R> => { return { bio: "b" }; });\n',
    "stock.py": "class Item(BaseModel):\n    id: int\n    name: str\n@app.get('/api/v1/stock/{item_id}')\ndef get(item_id: int) -> Item: ...\n",
    "order.go": 'type O struct {\n\tID string `json:"id"`\n\tStatus string `json:"status"`\n}\nfunc get(c *gin.Context) {\n\tc.JSON(200, O{})\n}\nfunc main() {\n\trouter.GET("/api/v2/order-status/:id", get)\n}\n',
}


def _write(folder, tree):
    for path, text in tree.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
    return str(folder)


def test_trees_with_seeded_drift(spark, tmp_path):
    client, server = (files.read_files(spark, _write(tmp_path / k, t)) for k, t in (("client", CLIENT), ("server", SERVER)))
    assert {r.path for r in client.collect()} == set(CLIENT) - {"node_modules/x.ts"}
    rows = check_trees(client, server).collect()
    assert Counter(r.kind for r in rows) == {"unresolved-route": 1, "missing-field": 2, "type-mutation": 1, "nullability-introduced": 1, "optionality-introduced": 1, "enum-variant-added": 1}
    by = {r.kind: r for r in rows}
    assert {r.path for r in rows if r.kind == "missing-field"} == {"email", "sku"}
    assert by["type-mutation"].path == "age" and (by["type-mutation"].expected, by["type-mutation"].actual) == ("number", "string")
    assert by["enum-variant-added"].path == "state" and by["nullability-introduced"].path == "nick" and by["optionality-introduced"].path == "bio"
    assert by["unresolved-route"].message.endswith("no server handler exists for DELETE at all.")


def test_bad_files_spare_the_others(spark):
    f = files.in_memory(spark, {"a.py": "def (", "b.py": "import requests\nrequests.get(f'/u/{i}')\n", "c.ts": "fetch('/x' + (((", "d.py": "x = " + "(" * 500})
    assert [(r.route, r.line) for r in files.client_calls(f).where("path = 'b.py'").collect()] == [("/u/__DYN__", 2)]
    assert "a.py" in {r.path for r in files.parse_errors(f).collect()}


def test_ts_calls():
    text = """
    import axios from "axios";
    const BASE = "/api"; const ROUTES = { users: "/users" };
    let moving = "/no";
    interface A { id: number; tags: string[]; kind?: "x" | "y"; note: string | null }
    interface B extends A { extra: Array<number> }
    // fetch("/commented")
    const a = await axios.get<B>(`${BASE}/b/${id}`);
    const b: Promise<A> = api.post(BASE + ROUTES.users, {});
    const { first, second = 1 } = await fetch("/c", { method: "delete" });
    client.request({ url: "/d", method: "PATCH" });
    headers.get("x-y"); new Map().get("/z");
    useQuery(["k"], () => fetch(`/e/${x}`).then((r) => r.json()));
    fetch("/f").then((r) => r.json() as Promise<A>);
    fetch(moving + "/g");
    """
    got = [(c["method"], c["route"], c["framework"], c["dynamic"]) for c in ts_source.client_calls("x.ts", text)]
    assert got == [("GET", "/api/b/__DYN__", "axios", True), ("POST", "/api/users", "axios", False), ("DELETE", "/c", "fetch", False), ("PATCH", "/d", "axios", False), ("GET", "/e/__DYN__", "react-query", True), ("GET", "/f", "fetch", False), ("GET", "__DYN__/g", "fetch", True)]
    schemas = [c["schema"] for c in ts_source.client_calls("x.ts", text)]
    b = schemas[0]["fields"]
    assert list(b) == ["id", "tags", "kind", "note", "extra"] and b["kind"]["optional"] and b["note"]["nullable"] and b["extra"]["type"]["element"]["name"] == "number"
    assert b["kind"]["type"]["variants"] == ["x", "y"] and list(schemas[1]["fields"]) == list(schemas[5]["fields"]) == ["id", "tags", "kind", "note"]
    assert {k: v["optional"] for k, v in schemas[2]["fields"].items()} == {"first": False, "second": True}


def test_types_come_one_import_away(spark):
    tree = {
        "web/src/a.ts": "import { User as U, type Other } from './types/user';\nconst x = axios.get<U>('/u');\nconst y: Promise<Other> = fetch('/o');\nconst z = axios.get<Far>('/f');",
        "web/src/types/user.ts": "export interface User { id: number }\nexport type Other = { b: string };",
        "web/src/types/user/index.ts": "export interface User { wrong: number }",
    }
    got = {r.route: r.schema for r in files.client_calls(files.in_memory(spark, tree)).collect()}
    assert '"id"' in got["/u"] and '"b"' in got["/o"] and got["/f"] is None


def test_ts_handlers():
    text = "import express from 'express';\nfunction one(req, res) { res.json({ a: 1, ...rest, b: { c: [true] } }); }\nrouter.get('/one/:id', auth, one);\nrouter.post('/two', async (req, res): Promise<{ z: string }> => { return other; });\n"
    one, two = ts_source.server_handlers("r.ts", text)
    assert (one["method"], one["route"], one["framework"]) == ("GET", "/one/:id", "express") and list(one["schema"]["fields"]) == ["a", "b"]
    assert list(two["schema"]["fields"]) == ["z"]
    app, = ts_source.server_handlers("src/app/users/[id]/route.ts", "export async function GET() { return Response.json({ ok: true }); }")
    assert (app["method"], app["route"], app["framework"]) == ("GET", "/users/:id", "nextjs")


def test_python_handlers():
    text = "from pydantic import BaseModel\nr = APIRouter(prefix='/p')\nclass M(BaseModel):\n    a: int\n    b: str | None = None\n    c: Later\nclass Later(BaseModel):\n    d: dict\n@r.get('/m', response_model=M)\ndef m(): ...\n@r.post('/n')\ndef n(): return {'x': [1], 'y': True}\n@r.delete('/o')\ndef o() -> list[Later]: ...\n"
    m, n, o = python_source.server_handlers("a.py", text)
    assert (m["route"], list(m["schema"]["fields"])) == ("/p/m", ["a", "b", "c"])
    b = m["schema"]["fields"]["b"]
    assert b["optional"] and b["nullable"] and m["schema"]["fields"]["c"]["type"]["fields"] == {}
    assert list(n["schema"]["fields"]) == ["x", "y"] and list(o["schema"]["fields"]) == ["d"]


def test_go_handlers():
    text = 'type U struct {\n\tID int `json:"id"`\n\tNick *string `json:"nick,omitempty"`\n\tHidden int `json:"-"`\n\tAt time.Time\n\tL []string `json:"l"`\n}\nfunc get(c *gin.Context) {\n\tc.JSON(200, U{})\n}\nfunc main() {\n\tv1 := router.Group("/v1")\n\tu := v1.Group("/u")\n\tu.GET("/:id", get) // u.GET("/no", get)\n\tclient.Get("http://x/" + id)\n}\n'
    h, = go_source.server_handlers("a.go", text)
    assert (h["method"], h["route"]) == ("GET", "/v1/u/:id")
    f = h["schema"]["fields"]
    assert list(f) == ["id", "nick", "At", "l"] and f["nick"]["optional"] and f["nick"]["nullable"] and f["At"]["type"]["name"] == "unknown"
    assert [c["route"] for c in go_source.client_calls("a.go", text)] == ["http://x/__DYN__"]


def test_graphql_fields(spark):
    f = files.in_memory(spark, {"s.graphql": "type User { # comment: x\n id: ID!\n tags: [String!]!\n active: Boolean\n friend(n: Int): User }"})
    got = {r.field: (r.kind, r.name, r.nullable) for r in files.graphql_fields(f).collect()}
    assert got == {"id": ("primitive", "string", False), "tags": ("array", "string", False), "active": ("primitive", "boolean", True), "friend": ("reference", "User", True)}


def test_app_routes(spark):
    df = spark.createDataFrame([("src/app/a/[id]/route.ts",), ("app/route.js",)], "p string")
    assert [r[0] for r in df.select(files.next_app_route(F.col("p"))).collect()] == ["/a/:id", "/"]


def test_usages():
    text = 'const { mail: m, other } = await fetch("/a");\nshow(m.x);\nconst r = await axios.get("/b");\nf(r.age.toFixed(0), r.name, r?.opt?.y, r["q"], r[key]);\n'
    a, b = ts_source.usages("x.ts", text)
    assert (a["accessed"], a["computed"]) == (["mail", "x"], False)
    assert (b["accessed"], b["computed"], b["unguarded"]) == (["age", "name", "opt", "q"], True, ["age"])


def test_impacts_of_a_rename_and_a_removal(spark):
    server = lambda body, more="": files.in_memory(spark, {"s.ts": f"router.get('/u', async (req, res): Promise<{{ {body} }}> => {{ return x; }});{more}"})
    client = files.in_memory(spark, {"a.ts": "const r = await axios.get('/u');\nshow(r.email);", "b.ts": "const q = await axios.get('/u');\nshow(q.name);", "c.ts": "const g = await axios.get('/gone');\nshow(g.x);", "d.ts": "const w = await axios.get('/u');\nshow(w.age);"})
    base = server("name: string; email: string; age: number", "\nrouter.get('/gone', async (req, res): Promise<{ x: string }> => { return x; });")
    got = {r.consumer_id.split(":")[0]: r for r in impact_trees(client, base, server("name: string; mail: string; age?: number")).collect()}
    assert {k: (r.severity, r.category) for k, r in got.items()} == {"a.ts": ("BREAKING", "DIRECT"), "b.ts": ("SAFE", "UNUSED"), "c.ts": ("BREAKING", "DIRECT"), "d.ts": ("SAFE", "DIRECT")}
    assert got["a.ts"].changed_paths == ["email"] and got["a.ts"].proof_level == "PROVEN"


def test_routers_mounted_twice_and_in_a_cycle(spark):
    from seamwright.sources import python_routers

    edge = lambda k, mounting, mounted, prefix: ("s", ("m.py", k), "m.py", mounting, "m.py", mounted, prefix)
    kinds = "snapshot string, ord struct<path:string,ord:int>, mounting_file string, mounting string, mounted_file string, mounted string, prefix string"
    rows = [edge(1, "app", "a", "/v1"), edge(2, "app", "b", "/v2"), edge(3, "a", "c", "/x"), edge(4, "b", "c", "/y")]
    got = {r.router: r.prefix for r in python_routers.router_prefixes(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"a": "/v1", "b": "/v2", "c": "/v1/x/v2/y"}
    loop = [edge(1, "a", "b", "/b"), edge(2, "b", "a", "/a")]
    assert python_routers.router_prefixes(spark.createDataFrame(loop, kinds), 3).count() == 2


def test_nearest_settings_win_and_packages_are_never_followed(spark):
    from seamwright.sources import files, modules

    tree = files.in_memory(spark, {"tsconfig.json": '{"compilerOptions": {"paths": {"@a/*": ["x/*"]}}}', "p/tsconfig.json": "{}", "p/q/c.ts": "", "c.ts": "", "x/b.ts": "", "x/d/index.tsx": "", "broken/tsconfig.json": "{", "broken/e.ts": ""})
    asked = spark.createDataFrame([("current", p, s) for p, s in (("c.ts", "@a/b"), ("c.ts", "@a/d"), ("p/q/c.ts", "@a/b"), ("p/q/c.ts", "../../x/b.js"), ("c.ts", "react"), ("broken/e.ts", "@a/b"), ("c.ts", "./nothing"))], "snapshot string, path string, specifier string")
    got = {(r.path, r.specifier): r.file for r in modules.module_files(asked, tree).collect()}
    assert got == {("c.ts", "@a/b"): "x/b.ts", ("c.ts", "@a/d"): "x/d/index.tsx", ("p/q/c.ts", "../../x/b.js"): "x/b.ts"}


def test_landed_snapshots_are_parsed_once(spark, tmp_path):
    landing, table, marks = tmp_path / "landing", str(tmp_path / "calls"), str(tmp_path / "marks")
    for snapshot in ("one", "two"):
        _write(landing / snapshot, CLIENT)
        keep_parsed(spark, str(landing), "client", table, marks).awaitTermination()
    keep_parsed(spark, str(landing), "client", table, marks).awaitTermination()
    rows = spark.read.parquet(table)
    want = {(r.path, r.route) for r in files.client_calls(files.in_memory(spark, {k: v for k, v in CLIENT.items() if "node_modules" not in k})).collect()}
    for snapshot in ("one", "two"):
        got = rows.where(F.col("snapshot") == snapshot).collect()
        assert len(got) == len(want) and {(r.path, r.route) for r in got} == want


def test_files_in_one_partition_are_scanned_by_many_tasks(spark):
    one = files.in_memory(spark, {f"a{k}.ts": f"fetch('/x{k}');\n" for k in range(40)}).coalesce(1)
    for rows in (files._apply(one, files.PARSERS["client"]), files.usages(one)):
        assert rows.count() == 40 and rows.select(F.spark_partition_id()).distinct().count() > 2


def test_a_client_is_scanned_once_whatever_changed(spark, monkeypatch):
    scans = Counter()
    for name in ("client_calls", "usages"):
        monkeypatch.setattr(check, name, lambda f, name=name, real=getattr(check, name): scans.update([name]) or real(f))
    client = files.in_memory(spark, {"a.ts": "const r = await axios.get('/a');\nshow(r.x);\n", "b.ts": "const r = await axios.get('/b');\nshow(r.x);\n"})
    server = lambda **routes: files.in_memory(spark, {"s.ts": "\n".join(f"app.get('/{k}', (req, res) => {{ res.json({{ {v}: 1 }}) }});" for k, v in routes.items())})
    got = {r.consumer_id.split(":")[0]: r.severity for r in impact_trees(client, server(a="x", b="x"), server(a="y")).collect()}
    assert got == {"a.ts": "BREAKING", "b.ts": "BREAKING"} and scans == {"client_calls": 1, "usages": 1}


def test_only_files_that_imports_lead_to_are_scanned_for_exports(spark, monkeypatch):
    scanned = []
    for name in ("ts_constants", "ts_declarations"):
        monkeypatch.setattr(files, name, lambda f, real=getattr(files, name): scanned.append({r.path for r in f.collect()}) or real(f))
    tree = {"a.ts": "import { BASE, T } from './shared';\nconst r: T = await axios.get(`${BASE}/a`);\n", "b.ts": "fetch('/b');\n", "shared.ts": "export const BASE = '/api';\nexport interface T { id: number }\n"}
    got = {r.route: r.schema for r in files.client_calls(files.in_memory(spark, tree)).collect()}
    assert set(got) == {"/api/a", "/b"} and '"id"' in got["/api/a"] and scanned == [{"shared.ts"}] * 2
