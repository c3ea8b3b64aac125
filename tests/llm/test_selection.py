import math
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from plexgraph.llm import mixing, quality, ring
from plexgraph.llm.queries import op3_mixing, op6_quality_rules, op10_sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        left, weight = total - sum(capped.values()), sum(w[s] for s in names if s not in capped)
        over = {s: most * sizes[s] for s in names if s not in capped and left * w[s] / weight > most * sizes[s] + 1e-9}
        if not over:
            return {s: capped.get(s, left * w[s] / weight if weight else 0.0) for s in names}
        capped |= over


def check_mix(rows, docs):
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    want = brute_targets(dict(sizes))
    source, taken, big = {d["doc_id"]: d["source"] for d in docs}, Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        big[s] = max(big[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= big[s] / 2 + 1


def test_mix_by_brute_force(spark, sf, documents):
    check_mix(op3_mixing(spark, sf).collect(), documents.collect())


def test_mix_when_buckets_are_split(spark, sf, documents, monkeypatch):
    whole = sorted(map(tuple, op3_mixing(spark, sf).collect()))
    monkeypatch.setattr(mixing, "FEW", 1)
    monkeypatch.setattr(mixing, "STEP", 4)
    assert sorted(map(tuple, op3_mixing(spark, sf).collect())) == whole
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, op3_mixing(spark, sf).collect())) == whole


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    n = Counter(r["doc_id"] for r in out.collect())
    for r in rows:
        if r["size"]:
            assert n[r["doc_id"]] * r["size"] == r["taken"] * (2 if r["doc_id"] == 1 else 1)


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_by_brute_force(spark, sf, documents, odd):
    got = {r["doc_id"]: r for r in op6_quality_rules(spark, sf).collect()}
    for d in documents.collect():
        r, want = got[d["doc_id"]], brute_measures(d["text"])
        assert tuple(r[f] for f in FIELDS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    for r in quality.measured(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert tuple(r[f] for f in FIELDS) == brute_measures(r["text"])


def binomial_cdf(k, n, p):
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return sum(math.exp(term(i)) for i in range(k + 1))


def test_binomial_bound_is_exact(spark):
    ns = [1, 10, 100, 700, 1500]
    k = quality._most_errors(F.col("n"), 0.02, F.lit(0.01))
    for n, got in spark.createDataFrame([(n,) for n in ns], "n long").select("n", k).collect():
        want = max((i for i in range(n) if binomial_cdf(i, n, 0.02) <= 0.01), default=-1)
        assert got == want
    big = spark.range(1).select(quality._most_errors(F.lit(2_000_000).cast("long"), 0.004, F.lit(1e-4))).first()[0]
    assert 7500 < big < 8000


def test_cutoffs_spare_the_good(spark):
    import random

    rng = random.Random(1)
    text = lambda junk: " ".join((f"w{rng.randrange(10**6)}" + ("###" if junk else "")) for _ in range(60))
    rows = [(i, text(i % 10 == 0), "en", 1 if i % 10 else 0) for i in range(6000)] + [(9000 + i, text(i == 0), "fr", 1) for i in range(20)]
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(d, labels).collect()}
    good = [got[r[0]] for r in rows if r[3] and r[2] == "en"]
    assert sum(good) / len(good) >= 1 - quality.RISK and not any(got[r[0]] for r in rows if not r[3])
    assert got[9000]  # too few labels there to reject anything
    assert {r["doc_id"] for r in quality.keep_good(d, labels).collect()} == {i for i, k in got.items() if k}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (5, 0)], "doc_id long, quality int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == 10 and quality.judge(none, labels).count() == 0 and quality.judge(odd, labels.limit(0)).count() == 10
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality.keep_good(none, labels).count() == 0


def check_shards(rows, n):
    slots, load = {}, Counter()
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return load


def test_shards_are_balanced(spark, documents):
    load = check_shards(op10_sharding(spark, "/root/testdata/sf0.01").collect(), 8)
    assert max(load.values()) <= 1.002 * sum(load.values()) / 8 and min(load.values()) >= 0.99 * sum(load.values()) / 8


def test_growth_moves_few_cells():
    loads = {c: 100 + c % 7 for c in range(0, 65536, 8)}
    a, b = ring.assign(loads, 8, slack=0.05), ring.assign(loads, 9, slack=0.05)
    moved = sum(a[c] != b[c] for c in loads) / len(loads)
    assert moved < 0.35
    assert ring.assign(loads, 8) == ring.assign(dict(reversed(loads.items())), 8)


def test_a_full_shard_passes_on_clockwise():
    order = [s for _, s in ring.nodes(3)]
    first = next(p for p, _ in ring.nodes(3))
    loads = {first: 10}
    assert ring.assign(loads, 3, slack=10.0)[first] == order[0]
    held = ring.assign({c: 1 for c in range(0, 65536, 64)}, 4, slack=0.0)
    assert set(Counter(held.values()).values()) == {256}


def test_frequent_ids_and_groups_of_equal_texts_keep_the_law(spark):
    rows = [(None, f"text {k} of one without an id", k) for k in range(500)] + [(k, "a text that a third of all rows share", k) for k in range(600)] + [(k, f"plain {k} " * 3, k) for k in range(700)]
    rows += [(5000 + k, f"pair {k // 2}", k) for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, unit long")
    got = ring.shards(d, slack=0.02).collect()
    load = check_shards(got, 8)
    mean = sum(load.values()) / 8
    assert len(got) == len(rows) and max(load.values()) <= 1.03 * mean and min(load.values()) >= 0.8 * mean
    shard = {}
    for r in got:
        if (r["doc_id"] or 0) >= 5000:
            shard.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard.values())
    again = Counter((r["doc_id"], r["shard"]) for r in ring.sharded(d, slack=0.02).collect())
    assert again == Counter((r["doc_id"], r["shard"]) for r in got)


def test_shards_of_odd_rows(odd, none, tmp_path):
    rows = ring.shards(odd, n=3).collect()
    check_shards(rows, 3)
    assert len(rows) == 10 and ring.shards(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["size"] == by[3]["size"] == 1 and by[2]["text_crc32"] == 0 and by[8]["size"] == len("\U0001f600 emoji only".encode()) + 1
    out = ring.sharded(odd, n=3)
    assert sorted(out.columns) == sorted(odd.columns) and {r["doc_id"]: r["shard"] for r in out.collect()} == {r["doc_id"]: r["shard"] for r in rows}
    ring.write_shards(odd, f"file://{tmp_path}/out", n=3)
    assert odd.sparkSession.read.parquet(f"file://{tmp_path}/out").count() == 10


def test_pipeline_equals_its_steps(spark, sf, documents):
    from tests.llm.test_dedup import brute_hits, brute_similar

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r for r in documents.collect()}
    kept = {r["doc_id"] for r in op6_quality_rules(spark, sf).collect() if r["kept"]}
    root, _ = brute_similar({d: docs[d]["text"] for d in kept})
    clean = {d for d in kept if root[d] == d and not brute_hits(docs[d]["text"], items)[1]}
    n = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    assert set(n) <= clean and max(n.values()) <= 2
    left = [docs[d].asDict() for d in clean]
    sizes = _sizes(left)
    full = {s for s, t in brute_targets(sizes).items() if t >= sizes[s]}
    assert full and {d for d in clean if docs[d]["source"] in full and WORD.search(docs[d]["text"])} <= set(n)
    check_mix([{"doc_id": d["doc_id"], "size": (s := len(WORD.findall(d["text"]))), "taken": n[d["doc_id"]] * s, "source_size": sum(len(WORD.findall(x["text"])) for x in left if x["source"] == d["source"]), "target": brute_targets(_sizes(left))[d["source"]]} for d in left], left)


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    labels, items = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int"), spark.createDataFrame([(None, "one")], "item_id long, text string")
    words = " ".join(f"v{i}" for i in range(90))
    more = spark.createDataFrame([(None, f"{words} a", "en", "a"), (None, f"{words} a", "en", "a"), (40, f"{words} b", "en", "a"), (40, words[::-1], "en", "b")], "doc_id long, text string, lang string, source string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    for name, rows in (("full", docs), ("empty", none)):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/full")
    assert sorted(out.columns) == sorted(odd.columns)
    # 1 repeats itself, 2 to 4, 7, 8 and the first without an id have too few words; of what shares ``words`` 40 stays.
    assert {(r["doc_id"], r["text"][:4]) for r in out.collect()} <= {(5, "w0 w"), (40, "v0 v"), (40, words[::-1][:4])}
    assert {r["doc_id"] for r in out.collect()} == {5, 40}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0


def _sizes(docs):
    out = Counter()
    for d in docs:
        out[d["source"]] += len(WORD.findall(d["text"]))
    return dict(out)
