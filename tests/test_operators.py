from itertools import product

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import predicates, questions, text
from plexgraph.operators import changes, components, coupling, embedding, flows, incremental, intervals, lookup, memory, resolve, search, traverse, urls


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(d):
    return {tuple(r) for r in d.collect()}


def test_coupling_counts_and_totals(spark):
    c = df(spark, [(k, f) for k in range(3) for f in ("auth", "models")] + [(3, "views"), (3, "utils")] + [(9, f"f{i}") for i in range(60)] + [(9, "views")], "commit long, item string")
    assert pairs(coupling.pairs(c)) == {("auth", "models", 3), ("utils", "views", 1)}
    # The large commit gives no pairs, but counts in the totals.
    assert pairs(coupling.coupling(c)) == {("auth", "models", 3, 1.0), ("utils", "views", 1, 0.5)}


def test_coupling_takes_sets_and_counts_null_items(spark):
    c = df(spark, [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, None), (3, "a"), (3, None)], "commit long, item string")
    assert pairs(coupling.pairs(c, 3)) == {("a", "b", 2)} and pairs(coupling.pairs(c, 2)) == {("a", "b", 1)}
    # Items are shuffled once by commit, pairs once.
    assert coupling.pairs(c)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_fusion_of_two_lists(spark):
    a = df(spark, [("a", 3.0), ("b", 2.0), ("c", 1.0)], "id string, score double")
    b = df(spark, [("b", 3.0), ("d", 2.0), ("a", 1.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in search.fuse([(a, 1.0), (b, 1.0)]).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 61, "c": 1 / 63, "d": 1 / 62})


def test_fallback_only_if_first_is_empty(spark):
    a, b = df(spark, [("a", 1.0)], "id string, score double"), df(spark, [("b", 1.0)], "id string, score double")
    assert pairs(search.with_fallback(a, b)) == {("a", 1.0)}
    assert pairs(search.with_fallback(a.limit(0), b)) == {("b", 1.0)}


def test_bm25_parts_words_at_underscores(spark):
    d = df(spark, [("x", "load_user_data from disk"), ("y", "save data"), ("z", None)], "id string, text string")
    assert [r["id"] for r in search.bm25(d, "user").collect()] == ["x"]


def test_vector_width_is_checked(spark):
    e = df(spark, [("x", [1.0, 0.0])], "id string, vec array<float>")
    with pytest.raises(Exception, match="width"):
        search.vectors(e, [1.0, 0.0, 0.0]).collect()


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a")]


@pytest.mark.parametrize("small", [0, 1000])
def test_strong_components_in_one_task_and_by_rounds(spark, small):
    e = df(spark, EDGES, "src string, dst string")
    assert pairs(components.strong_components(e, small=small)) == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_no_strong_component_is_lost_where_rounds_end(spark):
    e = df(spark, EDGES, "src string, dst string")
    with pytest.raises(RuntimeError, match="1 rounds"):
        components.strong_components(e, rounds=1, small=0)


def test_traversal_and_shortest_path(spark):
    e = df(spark, EDGES, "src string, dst string").withColumn("confidence", F.lit(0.9))
    r = traverse.reach(e, df(spark, [("a",), ("d",)], "root string"), 2)
    assert pairs(r) == {("a", "b", 1), ("a", "c", 2), ("d", "e", 1)}
    assert traverse.path(e, "g", "e").first()["path"] == ["g", "a", "b", "c", "d", "e"]
    assert traverse.path(e, "d", "a").count() == 0
    assert {(x["node"], x["tag"]) for x in traverse.impact(e, "a", 2).collect()} == {("c", "direct"), ("g", "direct"), ("b", "indirect")}


def test_pagerank_follows_the_focus(spark):
    e = df(spark, [("fa", "fb"), ("fb", "fc"), ("C", "fa")], "src string, dst string")
    r = {x["node"]: x["rank"] for x in components.pagerank(e, df(spark, [("fa",)], "node string")).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["fa"] > r["fb"] > r["fc"] and "C" not in r
    assert components.pagerank(e, df(spark, [("zz",)], "node string")).count() == 0


def test_cohesion_counts_cross_edges_on_both_sides(spark):
    e = df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("c", "d")], "src string, dst string")
    m = df(spark, [(n, "1") for n in "abc"] + [(n, "2") for n in "de"], "node string, community string")
    assert {r["community"]: r["cohesion"] for r in components.cohesion(e, m).collect()} == {"1": 0.75, "2": 0.5}


def brute_greedy(found):
    kept = []
    for entry, steps, _ in sorted(found, key=lambda f: (-len(f[1]), f[2])):
        if all(len(set(steps) & set(k)) / min(len(steps), len(k)) <= 0.5 for _, k in kept):
            kept.append((entry, steps))
    return {e for e, _ in kept}


def test_flow_dedup_equals_the_greedy_pass(spark):
    import random

    rng = random.Random(3)
    found = [(f"e{i}", sorted(rng.sample("abcdefghij", rng.randint(1, 6))), i) for i in range(60)]
    got = flows.distinct_flows(df(spark, found, "entry string, steps array<string>, ord long"))
    assert {r["entry"] for r in got.collect()} == brute_greedy(found)


def brute_trace(edges, entry, depth=6, branch=3, size=25):
    best = {}
    for s, d, c in edges:
        best.setdefault(s, {})[d] = max(c, best.get(s, {}).get(d, 0))
    steps, queue = [entry], [(entry, 0)]
    while queue and len(steps) < size:
        node, at = queue.pop(0)
        if at >= depth:
            continue
        n = 0
        for d, _ in sorted(best.get(node, {}).items(), key=lambda x: (-x[1], x[0])):
            if n >= branch or len(steps) >= size:
                break
            if d not in steps and d != node:
                steps.append(d)
                queue.append((d, at + 1))
                n += 1
    return steps


def test_trace_keeps_its_budgets(spark):
    import random

    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    e = [(rng.choice(names), rng.choice(names), rng.choice([0.5, 0.8, 1.0])) for _ in range(400)]
    got = flows.trace(df(spark, e, "src string, dst string, confidence double"), df(spark, [(n,) for n in names[:12]], "entry string"))
    for r in got.collect():
        assert r["steps"] == brute_trace(e, r["entry"])


def test_innermost_span_with_and_without_buckets(spark):
    spans = df(spark, [("A", "f", 1, 100, 0), ("B", "f", 10, 20, 1), ("C", "f", 10, 30, 2), ("D", "g", 1, 5, 3)], "span string, key string, start long, stop long, ord long")
    points = df(spark, [(1, "f", 15), (2, "f", 25), (3, "f", 50), (4, "f", 200), (5, "g", 5)], "point long, key string, pos long")
    want = {(1, "C"), (2, "C"), (3, "A"), (4, None), (5, "D")}
    assert pairs(intervals.innermost(points, spans)) == pairs(intervals.innermost(points, spans, 16)) == want


def joins(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Join")


def test_innermost_sweeps_each_row_once(spark):
    import random

    rng = random.Random(7)
    spans = [(f"s{i}", rng.choice("fg"), (a := rng.randint(0, 60)), a + rng.randint(-2, 30), i) for i in range(200)] + [("x", None, 0, 60, 900)]
    points = [(i, rng.choice("fgh"), rng.randint(-5, 95)) for i in range(200)] + [(900, None, 5), (901, "f", None), (None, "f", 30)]
    want = set()
    for p, key, pos in points:
        around = [(a, o, s) for s, k, a, b, o in spans if None not in (p, key, pos) and k == key and a <= pos <= b]
        want.add((p, max(around)[2] if around else None))
    p, s = df(spark, points, "point long, key string, pos long"), df(spark, spans, "span string, key string, start long, stop long, ord long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on from one batch to the next
    try:
        assert pairs(intervals.innermost(p, s)) == pairs(intervals.innermost(p, s, 16)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A join on the key would make a row for each point and span that meet: 40,000 of these.
    assert joins(intervals.innermost(p, s)) == joins(intervals.innermost(p, s, 16)) == 0


def test_next_mark_is_carried_to_points(spark):
    import random

    rng = random.Random(11)
    marks = [(f"m{i}", rng.choice("fg"), rng.randint(-20, 60)) for i in range(80)] + [("x", None, 9), ("y", "f", None)]
    points = [(i, rng.choice("fgh"), rng.randint(-40, 80)) for i in range(200)] + [(900, None, 5), (901, "f", None), (None, "f", 9)]
    p, m = df(spark, points, "point long, key string, pos long"), df(spark, marks, "mark string, key string, pos long")
    for most in (0, 2, 7, 500):
        want = set()
        for q, key, pos in points:
            near = [(at, n) for n, k, at in marks if None not in (q, key, pos, at) and k == key and pos <= at <= pos + most]
            want.add((q, min(near)[1], min(near)[0] - pos) if near else (q, None, None))
        assert pairs(intervals.next_within(p, m, most)) == want
    # A join would make a row for each point and mark within 500 of it.
    assert joins(intervals.next_within(p, m, 500)) == 0


def test_url_matches_against_all_pairs(spark):
    rs = [("r1", "/users/{id}", "get"), ("r2", "/users", "post"), ("r3", "/users/:id", "get"), ("r4", "/x/<int:k>/", "get"), ("r5", "", "get")]
    cs = [("c1", "https://h.com/users/{uid}", "get"), ("c2", "/users", "post"), ("c3", "/users/7/", "get"), ("c4", "https://h.com", "get"), ("c5", "/x/{k}", "put")]
    got = {(r["route"], r["call"]): r["confidence"] for r in urls.links(df(spark, rs, "route string, url string, method string"), df(spark, cs, "call string, url string, method string")).collect()}
    assert got[("r2", "c2")] == 1.0 and got[("r1", "c1")] == 1.0 and got[("r3", "c1")] == 1.0
    assert got[("r2", "c3")] == 0.5 and ("r4", "c5") not in got and got[("r5", "c4")] == 1.0


def test_tiers_and_the_cap_on_namesakes(spark):
    defs = df(spark, [("f", f"t{i}", f"p{i}/a.py", i) for i in range(6)] + [("g", "g1", "a/b/x.py", 7), ("g", "g2", "a/c/y.py", 8), ("h", "h1", "m.py", 9), ("h", "h2", "n.py", 10)], "name string, target string, path string, ord long")
    refs = df(spark, [(1, "f", "z.py"), (2, "f", "p3/a.py"), (3, "g", "a/c/z.py"), (4, "h", "q.py")], "ref long, name string, path string")
    imports = df(spark, [("q.py", "n.py", ["h"]), ("q.py", "m.py", ["other"])], "path string, imported string, symbols array<string>")
    assert pairs(resolve.tiered(refs, defs, imports)) == {(2, "t3", 1.0, 1), (3, "g2", 0.5, 3), (4, "h2", 1.0, 2)}


def test_delta_order_and_cascade(spark):
    nodes = df(spark, [("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    edges = df(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls")], "src string, dst string, rel_type string")
    out = df(spark, [("a", "c", "calls")], "src string, dst string, rel_type string")
    n, e = changes.apply_delta(nodes, edges, out, df(spark, [("b",)], "id string"), df(spark, [("d", "D"), ("a", "A2")], "id string, name string"), df(spark, [("d", "a", "calls"), ("d", "zz", "calls")], "src string, dst string, rel_type string"))
    assert pairs(n) == {("a", "A2"), ("c", "C"), ("d", "D")} and pairs(e) == {("d", "a", "calls")}


def test_verdicts_in_order(spark):
    t, f = F.lit(True), F.lit(False)
    cases = [((f, f, f, 1.0, 1.0), "no_manifest"), ((t, f, f, 1.0, 1.0), "version_mismatch"), ((t, t, f, 1.0, 1.0), "corrupt"), ((t, t, t, 0.31, 1.0), "file_ratio"), ((t, t, t, 0.3, 0.41), "symbol_ratio"), ((t, t, t, 0.3, 0.4), "incremental")]
    row = spark.range(1).select(*[changes.verdict(*[x if not isinstance(x, float) else F.lit(x) for x in a]).alias(str(k)) for k, (a, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


def test_test_files_and_exemptions(spark):
    yes = ["tests/a.py", "a/test/b.py", "x/test_a.py", "src/foo.spec.ts", "foo.test.js", "a_spec.rb", "b_test.go", "x/conftest.py", "c.stories.tsx"]
    no = ["contest/a.py", "src/latest.py", "foo.ts", "attest.go"]
    got = {r[0]: r[1] for r in df(spark, [(p,) for p in yes + no], "p string").select("p", predicates.is_test_file(F.col("p"))).collect()}
    assert got == {p: p in yes for p in yes + no}
    names = [("__init__", "a.py", True), ("initialize", "a.rb", True), ("initialize", "a.py", False), ("TestUser", "a.py", True), ("Testing", "a.py", False), ("__x__", "a.py", True), ("main", "m.go", True), ("main", "m.py", False), ("load", "vite.config.ts", True), ("load", "a.ts", False), ("pub", "p/__init__.py", True)]
    e = predicates.is_exempt(F.col("n"), F.lit(False), F.lit(False), F.col("p"))
    assert {(r[0], r[1]): r[2] for r in df(spark, [n[:2] for n in names], "n string, p string").select("n", "p", e).collect()} == {(n, p): w for n, p, w in names}


def test_questions_and_guard(spark):
    qs = [("what breaks if I change X?", "impact"), ("who calls load_user", "context"), ("is there dead code", "dead_code"), ("path from a to b", "call_path"), ("hello", "query"), ("which tests are affected", "test_impact")]
    assert [r[0] for r in df(spark, qs, "q string, w string").select(questions.route(F.col("q"))).collect()] == [w for _, w in qs]
    names = df(spark, [("does `Foo.bar` call getUser or load_data in KPIData, USA",)], "q string").select(questions.names_in(F.col("q"))).first()[0]
    assert names == ["Foo.bar", "KPIData", "getUser", "load_data"]
    guard = [("MATCH (n) RETURN n", None), ("", "empty"), ("// x\n", "empty"), ("CREATE (n)", "first_clause"), ("MATCH (n) SET n.x=1", "write"), ("MATCH (n) WHERE n.c CONTAINS 'set it' RETURN n", None), ("CALL drop_all()", "procedure"), ("CALL show_tables() RETURN *", None), ("MATCH (n) /* x */ DETACH DELETE n", "write")]
    assert [questions.refusal(q) for q, _ in guard] == [w for _, w in guard]
    assert [r[0] for r in df(spark, guard, "q string, w string").select(questions.refused(F.col("q"))).collect()] == [w for _, w in guard]
    assert questions.is_read_only_sql(spark, "SELECT 1") and not questions.is_read_only_sql(spark, "DROP TABLE x")


def test_text_functions(spark):
    assert text.fit_lines(["a" * 40, "b" * 40, "c"], 20) == (["a" * 40, "b" * 40], 1)
    d = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:04:10' b")
    assert d.select(text.age(F.col("a"), F.col("b"))).first()[0] == "4m"
    out, n = text.redacted(F.lit('x AKIA' + 'A' * 16 + ' password = "hunter2hunter2"'))
    r = spark.range(1).select(out, n).first()
    assert r[0] == "x [redacted] [redacted]" and r[1] == 2


def test_memory(spark):
    f = memory.remember(memory.remember(memory.empty(spark), "db", "postgres main", "infra"), "api", "rest gateway")
    f = memory.remember(f, "db", "mysql main", "infra")
    assert memory.recall(f, "db").collect()[0]["value"] == "mysql main"
    assert [r["key"] for r in memory.recall(f, "which gateway").collect()] == ["api"]
    assert memory.forget(f, "db").count() == 1 and memory.listed(f, "infra").count() == 1


def test_embeddings_are_reused_by_text_and_tier(spark):
    t = df(spark, [("a", "load user"), ("b", "save file")], "id string, text string")
    first = embedding.embed(t).persist()
    assert all(len(r["vec"]) == 256 for r in first.collect())
    kept, todo = embedding.stale(t.withColumn("text", F.when(F.col("id") == "a", "load users").otherwise(F.col("text"))), first, "fast")
    assert [r["id"] for r in kept.collect()] == ["b"] and [r["id"] for r in todo.collect()] == ["a"]
    assert embedding.stale(t, first, "quality")[0].count() == 0


def test_importable_names(spark):
    got = df(spark, [("src/pkg/mod.py",), ("pkg/__init__.py",)], "p string").select(incremental.importable_names(F.col("p"))).collect()
    assert set(got[0][0]) == {"src/pkg/mod", "src.pkg.mod", "pkg/mod", "pkg.mod", "mod"} and set(got[1][0]) == {"pkg"}


def test_lookup_tiers(spark):
    n = df(spark, [("function:a.py:f", "function", "f", "a.py"), ("function:x/tests/b.py:f", "function", "f", "x/tests/b.py"), ("class:c.py:f", "class", "f", "c.py")], "id string, label string, name string, file_path string")
    assert [(r["id"], r["score"]) for r in lookup.exact_name(n, "f").collect()] == [("class:c.py:f", 2.0), ("function:a.py:f", 2.0), ("function:x/tests/b.py:f", 1.0)]
    ranked = df(spark, [("z", 9.0)], "id string, score double")
    assert lookup.resolve(n, "nope", ranked).first()["id"] == "z"


def test_risk_levels(spark):
    cases = [(0, 0, 9, 1, 0, "LOW"), (1, 1, 25, 2, 6, "MEDIUM"), (9, 9, 9, 9, 10, "HIGH")]
    s, level = lookup.risk(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert [tuple(r) for r in df(spark, [c[:4] for c in cases], "a long, b long, c long, d long").select(s, level).collect()] == [c[4:] for c in cases]


def test_fingerprint_depends_on_all_files(spark):
    base = [(f"f{i}", f"s{i}") for i in range(40)]
    one = lambda rows: changes.fingerprint(df(spark, rows, "path string, sha string")).first()[0]
    assert one(base) == one(base[::-1]) and len({one(base), one(base[1:]), one([*base[:-1], ("f39", "x")])}) == 3


def test_division_brute_force(spark):
    need = ["x", "y"]
    have = [(a, b) for a, b in product("pqr", "xyz") if (a, b) != ("q", "y")]
    d = df(spark, have, "a string, b string").groupBy("a").agg(F.collect_set("b").alias("h"))
    got = d.where(F.size(F.array_except(F.array(*map(F.lit, need)), "h")) == 0)
    assert {r["a"] for r in got.collect()} == {"p", "r"}
