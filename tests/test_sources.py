import subprocess

from pyspark.sql import functions as F

from plexgraph.operators import incremental
from plexgraph.plans import branches
from plexgraph.plans.analyze import analyze
from plexgraph.plans.tools import Tools
from plexgraph.sources import files, store
from plexgraph.sources.parsers import parse

AUTH = """from .util import check
from typing import Protocol

class Base:
    def login(self):
        self.audit()
    def audit(self):
        pass

class User(Base):
    def __init__(self, n: str):
        self.n = n
    def login(self):
        return check(self.n)

class Runner(Protocol):
    def go(self): ...

class Fast:
    def go(self):
        return 1

def validate(u: User) -> bool:
    return check(u.n)

def orphan():
    return 1
"""
REPO = {
    "app/__init__.py": "X = 1\n",
    "app/main.py": "from app.auth import validate, User\n\ndef main():\n    u = User('x')\n    validate(u)\n    u.login()\n    run(validate)\n\ndef run(f):\n    return f()\n",
    "app/auth.py": AUTH,
    "app/util.py": "def check(x):\n    return verify(x)\n\ndef verify(x):\n    def inner():\n        return 2\n    return x\n",
    "srv/routes.py": "@app.get('/api/users/{id}')\ndef get_user(id):\n    return 1\n",
    "web/api.ts": "import { get } from './client';\nexport function handler(req: Request) {\n  return get(req);\n}\nfunction load(id) { return axios.get(`/api/users/{id}`); }\n",
    "web/client.ts": "export function get(r) { return load(r); }\n",
    "lib/user.rb": "class Account\n  attr_reader :name\n  include Greet\n  def name\n    helper\n  end\n  def helper\n    1\n  end\nend\n",
    "main.go": "package main\nimport \"x/models\"\nfunc main() {\n\tu := models.NewUser()\n\tu.Save()\n}\nfunc unused() {}\n",
    "models/user.go": "package models\ntype User struct {\n\tBase\n\tName string\n}\ntype Base struct {}\nfunc NewUser() *User { return &User{} }\nfunc (u *User) Save() { u.check() }\nfunc (u *User) check() {}\n",
}


def table(spark, repo):
    rows = spark.createDataFrame(list(repo.items()), "path string, content string")
    return rows.withColumn("language", files.language(F.col("path")))


def edge_set(edges, *kinds):
    return {(r["rel_type"], r["src"], r["dst"]) for r in edges.where(F.col("rel_type").isin(*kinds)).collect()}


def test_whole_analysis(spark):
    g = analyze(table(spark, REPO), spark.createDataFrame([(k, p) for k in (1, 2) for p in ("app/auth.py", "app/main.py")], "commit long, item string"))
    calls = {(r["src"], r["dst"]): r["confidence"] for r in g.edges.where("rel_type = 'calls'").collect()}
    f = lambda p, n: f"function:{p}:{n}"
    assert calls[f("app/main.py", "main"), f("app/auth.py", "validate")] == 1.0
    assert calls[f("app/auth.py", "validate"), f("app/util.py", "check")] == 1.0
    assert calls["method:app/auth.py:Base.login", "method:app/auth.py:Base.audit"] == 1.0
    assert calls[f("app/main.py", "main"), "method:app/auth.py:User.login"] in (0.5, 0.8)
    assert calls["method:models/user.go:User.Save", "method:models/user.go:User.check"] == 1.0
    assert calls[f("web/api.ts", "load"), f("srv/routes.py", "get_user")] == 1.0
    assert edge_set(g.edges, "imports") >= {("imports", "file:app/auth.py:", "file:app/util.py:"), ("imports", "file:web/api.ts:", "file:web/client.ts:"), ("imports", "file:main.go:", "file:models/user.go:")}
    assert edge_set(g.edges, "extends") == {("extends", "class:app/auth.py:User", "class:app/auth.py:Base"), ("extends", "class:models/user.go:User", "class:models/user.go:Base")}
    assert g.edges.where("rel_type = 'coupled_with'").first()["strength"] == 1.0
    marks = {r["id"]: r for r in g.nodes.collect()}
    dead = {i for i, r in marks.items() if r["is_dead"]}
    assert f("app/auth.py", "orphan") in dead and f("main.go", "unused") in dead
    # An inner function, a macro's method, a protocol's stub and a method that conforms to it stay alive.
    assert not dead & {f("app/util.py", "inner"), "method:lib/user.rb:Account.name", "method:app/auth.py:Runner.go", "method:app/auth.py:Fast.go"}
    assert marks["class:app/auth.py:Runner"]["is_protocol"] and marks[f("app/main.py", "main")]["is_entry_point"]
    tools = Tools(g.nodes, g.edges)
    assert {r["id"] for r in tools.context("verify").where("kind = 'caller'").collect()} == {f("app/util.py", "check")}
    assert tools.query("check", 3).first()["name"] == "check"
    assert {r["id"] for r in tools.changed_symbols(spark.createDataFrame([("app/util.py", 1, 2)], "file string, start long, stop long")).collect()} == {f("app/util.py", "check")}
    assert tools.sql("SELECT count(*) AS n FROM nodes WHERE label = 'file'").first()["n"] == len(REPO)


def test_parsers_read_kinds_and_places():
    py = parse(AUTH, "python")
    assert [(s["name"], s["kind"]) for s in py["symbols"]][:3] == [("Base", "class"), ("login", "method"), ("audit", "method")]
    assert py["heritage"] == [{"class_name": "User", "kind": "extends", "parent_name": "Base"}, {"class_name": "Runner", "kind": "extends", "parent_name": "Protocol"}]
    ts = parse("export class A extends B implements C, D {\n  run(x: Foo): Bar { return this.go(x); }\n}\nexport const f = (x) => { g(x); };\ninterface I { a: string }\ntype T = string;\nenum E { X }\n", "typescript")
    assert {(s["name"], s["kind"], s["class_name"]) for s in ts["symbols"]} == {("A", "class", ""), ("run", "method", "A"), ("f", "function", ""), ("I", "interface", ""), ("T", "type_alias", ""), ("E", "enum", "")}
    assert {(h["kind"], h["parent_name"]) for h in ts["heritage"]} == {("extends", "B"), ("implements", "C"), ("implements", "D")}
    assert {(c["name"], c["receiver"]) for c in ts["calls"]} >= {("go", "this"), ("g", "")} and set(ts["exports"]) == {"A", "f"}
    go = parse(REPO["models/user.go"], "go")
    assert {(s["name"], s["kind"], s["class_name"]) for s in go["symbols"]} >= {("User", "class", ""), ("Save", "method", "User"), ("models", "module", "")}
    rb = parse(REPO["lib/user.rb"], "ruby")
    assert rb["symbols"][0]["decorators"] == ["attr_reader:name"] and rb["symbols"][0]["end_line"] == 10
    assert [(c["name"], c["line"]) for c in rb["calls"]] == [("helper", 5)]
    assert all(v == [] for v in parse("def broken(:\n", "python").values())


def test_rest_extraction():
    go = parse('r.GET("/x", h)\nresp := http.Get("http://a/y")\n', "go")
    assert [(e["url_pattern"], e["function_name"]) for e in go["endpoints"]] == [("/x", "h")] and [c["url"] for c in go["http_calls"]] == ["http://a/y"]
    py = parse("@app.route('/a', methods=['POST'])\ndef h(): pass\nrequests.get('http://b/c')\n", "python")
    assert [(e["url_pattern"], e["http_method"], e["function_name"]) for e in py["endpoints"]] == [("/a", "post", "h")] and py["http_calls"][0]["url"] == "http://b/c"


def test_repository_scan_log_and_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for p, t in {"a.py": "x = 1\n", "b/c.ts": "let y;\n", "node_modules/z.js": "1", "bin.py": "\x00", "note.txt": "hi"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(t)
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    git("commit", "-qam", "two")
    found = {(r["path"], r["language"]) for r in files.from_repo(spark, str(tmp_path)).collect()}
    assert found >= {("a.py", "python"), ("b/c.ts", "typescript")} and not any("node_modules" in p or p == "note.txt" for p, _ in found)
    log = files.git_log(spark, str(tmp_path))
    assert log.select("commit").distinct().count() == 2 and log.where("item = 'a.py'").count() == 2
    (tmp_path / "new.py").write_text("1")
    assert files.changed_files(str(tmp_path), "HEAD~1") == {"a.py": "M", "new.py": "A"}
    assert files.content_at(str(tmp_path), "HEAD~1", "a.py") == "x = 1\n" and files.content_at(str(tmp_path), "HEAD", "zz") is None
    diff = "diff --git a/auth.py b/auth.py\n--- a/auth.py\n+++ b/auth.py\n@@ -1,4 +2,5 @@\n x\n@@ -9 +20,0 @@\n"
    assert {tuple(r) for r in files.hunks(spark.createDataFrame([(1, diff)], "id long, diff string")).collect()} == {("auth.py", 2, 6), ("auth.py", 20, 20)}
    assert files.git_log(spark, str(tmp_path / "nowhere")).count() == 0


def test_differences_between_refs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("import os\n\n\ndef load():\n    return digest()\n\n\ndef digest():\n    return 1\n\n\ndef old():\n    return 2\n")
    (tmp_path / "b.py").write_text("def far():\n    return load()\n\n\ndef twice():\n    return 1\n")
    (tmp_path / "c.py").write_text("def twice():\n    return 2\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("import sys\n\n\ndef load():\n    return fresh()\n\n\ndef digest():\n    return 3\n\n\ndef fresh():\n    return twice()\n")
    git("commit", "-qam", "two")
    (tmp_path / "b.py").write_text("def far():\n    return fresh()\n\n\ndef twice():\n    return 1\n")
    d = branches.scoped(spark, str(tmp_path), "HEAD~1", "HEAD")
    assert {(r["name"], r["change"]) for r in d.nodes.collect()} == {("load", "modified"), ("digest", "modified"), ("old", "removed"), ("fresh", "added")}
    edges = {(r["rel_type"], r["src"], r["dst"], r["change"]) for r in d.edges.collect()}
    f = "function:a.py:"
    assert edges == {("imports", "file:a.py:", "os", "removed"), ("imports", "file:a.py:", "sys", "added"), ("calls", f + "load", f + "digest", "removed"), ("calls", f + "load", f + "fresh", "added")}
    assert "added symbols: 1\n  function fresh (a.py)" in d.listing() and "and 1 more" in d.listing(most=1)
    tree = branches.scoped(spark, str(tmp_path), "HEAD")  # the work tree: b.py alone has changed, so fresh is out of sight
    assert {(r["name"], r["change"]) for r in tree.nodes.collect()} == {("far", "modified")} and tree.edges.count() == 0
    whole = branches.full(spark, str(tmp_path), "HEAD")
    calls = {(r["src"], r["dst"], r["change"]) for r in whole.edges.where("rel_type = 'calls'").collect()}
    assert calls == {("function:b.py:far", f + "load", "removed"), ("function:b.py:far", f + "fresh", "added")}
    assert branches.scoped(spark, str(tmp_path), "HEAD~1", "HEAD~1").listing() == "no structural changes"


def test_ignore_patterns(spark):
    paths = ["a/node_modules/x.js", "a.min.js", "src/a.js", "out/gen/x.py", "x/out/y.py", "k.log"]
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0] for r in d.where(files.is_ignored(F.col("p"), ["/out/", "*.log"])).collect()}
    assert got == {"a/node_modules/x.js", "a.min.js", "out/gen/x.py", "k.log"}


def test_snapshots_flip_and_manifests_guard(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    n = spark.createDataFrame([("a", "file", "x"), ("b", "function", "y")], "id string, label string, content string")
    first = store.save(root, {"nodes": n})
    store.save(root, {"nodes": n.where("id = 'a'")})
    assert store.load(spark, root, "nodes").count() == 1 and store.load(spark, root, "nodes", first).count() == 2
    assert store.read_manifest(spark, root) is None
    store.write_manifest(root, n, {"git_head": "x"})
    assert store.read_manifest(spark, root)[1]["git_head"] == "x"
    store.write_text(spark, f"{root}/MANIFEST", "{broken")
    assert store.read_manifest(spark, root) is None
    store.write_meta(spark, f"file://{tmp_path}/reg", "r", "/x", n, spark.createDataFrame([("calls",)], "rel_type string"))
    row = files.registry(spark, f"file://{tmp_path}/reg").first()
    assert row["name"] == "r" and row["stats"]["file"] == 1


def test_delta_equals_rebuild_over_edits(spark):
    repo = {k: REPO[k] for k in ("app/__init__.py", "app/main.py", "app/auth.py", "app/util.py")}
    old = analyze(table(spark, repo))
    edits = [
        {**repo, "app/util.py": repo["app/util.py"].replace("return x", "return x + 1")},
        {**{k: v for k, v in repo.items() if k != "app/util.py"}, "app/more.py": "def verify(x):\n    return x\n"},
    ]
    from plexgraph.operators.changes import apply_delta

    for edit in edits:
        new = analyze(table(spark, edit))
        again = analyze(table(spark, edit), before=old.parsed)
        assert again.nodes.exceptAll(new.nodes).isEmpty() and new.nodes.exceptAll(again.nodes).isEmpty() and again.edges.exceptAll(new.edges).isEmpty() and new.edges.exceptAll(again.edges).isEmpty()
        n, e = apply_delta(old.nodes, old.edges, *incremental.delta(old.nodes, old.edges, new.nodes, new.edges))
        assert n.exceptAll(new.nodes).isEmpty() and new.nodes.exceptAll(n).isEmpty()
        assert e.exceptAll(new.edges).isEmpty() and new.edges.exceptAll(e).isEmpty()


def test_plan_draws_in_dependants_only_for_identity_changes(spark):
    repo = {k: REPO[k] for k in ("app/__init__.py", "app/main.py", "app/auth.py", "app/util.py")}
    old = analyze(table(spark, repo))

    def planned(edit):
        t = table(spark, edit)
        new = analyze(t)
        hashed = t.select("path", F.sha2("content", 256).alias("sha"))
        return incremental.plan(old.nodes, old.edges, hashed, incremental.symbol_manifest(new.nodes), old.unresolved)

    body = planned({**repo, "app/util.py": repo["app/util.py"].replace("return x", "return x + 1")})
    assert {r["path"] for r in body.rebuild.collect()} == {"app/util.py"} and body.verdict == "incremental"
    renamed = planned({**repo, "app/util.py": repo["app/util.py"].replace("def check(x)", "def check(x, y=1)")})
    assert {r["path"] for r in renamed.rebuild.collect()} == {"app/util.py", "app/auth.py"}
