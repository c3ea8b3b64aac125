import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plexgraph.llm import chunks, decontam, families, simhash, similar
from plexgraph.llm.queries import op7_substring_dedup, op8_decontamination, op9_simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, distance=3):
    """doc -> smallest doc reachable, from [(doc, fp)]."""
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(b)] = find(a)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, least.get(find(f))) for d, f in fps), key=str)


def test_fingerprints_and_components_by_brute_force(spark, sf, documents):
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in documents.collect()]
    got = op9_simhash(spark, sf).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == sorted(fps)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == brute_components(fps)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_no_link_is_lost(spark, distance):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(15)} | {0, (1 << 64) - 1, 1, 3, 7, 15}
    want = {(min(simhash._signed(a), simhash._signed(b)), max(simhash._signed(a), simhash._signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= distance}
    d = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = [tuple(r) for r in simhash.links(d, distance).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    chain = [tuple(sorted(p)) for p in zip(order, order[1:])] + [(300, 301), (301, 302)]
    got = dict(tuple(r) for r in families.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{n: 0 for n in range(200)}, 300: 300, 301: 300, 302: 300}


@pytest.mark.parametrize("small, tables", [(500_000, 1), (0, 99)])
def test_few_edges_need_no_rounds_and_more_give_the_same(spark, monkeypatch, small, tables):
    rng, written, counted, settled = random.Random(4), [], families.counted, families.settled
    monkeypatch.setattr(families, "SMALL", small, raising=False)
    monkeypatch.setattr(families, "counted", lambda *a: written.append(1) or counted(*a))
    monkeypatch.setattr(families, "settled", lambda *a: written.append(1) or settled(*a))
    ids = [-(1 << 63), (1 << 63) - 1, *range(-400, 400)]
    rng.shuffle(ids)
    pairs = [*zip(ids[:200], ids[1:200]), *((ids[200], x) for x in ids[201:300]), *zip(rng.choices(ids[300:700], k=250), rng.choices(ids[300:700], k=250)), (ids[700], ids[700])]
    pairs += [(b, a) for a, b in pairs[::3]]
    node = lambda x: F.struct((F.col(x) % 7 == 0).alias("none"), F.col(x).alias("id"), (F.col(x) % 10).cast("int").alias("size"))
    got = families.components(spark.createDataFrame(pairs, "x long, y long").select(node("x").alias("a"), node("y").alias("b"))).collect()
    key = lambda i: (i % 7 == 0, i)
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        before = dict(least)
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b], key=key)
        if before == least:
            break
    assert sorted((r["node"]["id"], r["root"]["id"]) for r in got) == sorted(least.items())
    assert len(written) <= tables


def test_simhash_of_odd_rows(odd, none):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got[1, 1] == 2 and got[2, 2] == got[3, 2] == got[4, 2] == 1 and got[None, None] == 1 and sum(got.values()) == 10
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, 8, None], key=str)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, similar.keep_one])
def test_rows_that_share_an_id_or_have_none_are_judged_apart(spark, keep_one):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "some other words in a row here")
    rows = [(1, a, 1), (1, b, 2), (1, a, 3), (2, a, 4), (None, c, 5), (None, c, 6), (None, b, 7), (3, c, 8), (None, "only without an id", 9), (None, "only without an id", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = keep_one(d).collect()
    assert Counter(r["text"] for r in kept) == {a: 1, b: 1, c: 1, "only without an id": 1}
    assert {(r["doc_id"], r["text"]) for r in kept} == {(1, a), (1, b), (3, c), (None, "only without an id")}


def test_a_dense_family_is_one_component(spark):
    base, rng = 0x0F0F1234CAFE5678, random.Random(4)
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i + 1)} | {rng.getrandbits(64) for _ in range(300)}
    d = spark.createDataFrame([(k, simhash._signed(f)) for k, f in enumerate(sorted(fps))], "doc_id long, fp long")
    grouped = simhash._rooted(d, 3).select("doc_id", F.col("root.id").alias("root")).collect()
    want = dict(brute_components([(k, f) for k, f in enumerate(sorted(fps))]))
    assert {r["doc_id"]: r["root"] for r in grouped} == want


def test_what_grows_with_the_input_is_not_broadcast(spark, monkeypatch):
    plans = []

    def noted(f):
        def run(df, *a):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df, *a)

        return run

    for module in (families, simhash):
        for name in ("settled", "counted"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, noted(getattr(module, name)))
    rng = random.Random(6)
    fps = [s ^ (1 << rng.randrange(64)) for s in (rng.getrandbits(64) for _ in range(20)) for _ in range(10)]
    d = spark.createDataFrame([(k, simhash._signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["root"] for r in simhash._rooted(d, 3).select("doc_id", F.col("root.id").alias("root")).collect()}
    assert got == dict(brute_components(list(enumerate(fps))))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def brute_similar(texts):
    """id -> smallest id reachable by links of 0.8 between sets of five-word shingles, and the links."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids, parent, linked = sorted(sets), {d: d for d in sets}, []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if x == y or (n and 5 * n >= 4 * (len(x) + len(y) - n)):
                linked.append((a, b))
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in ids}, linked


def test_near_copies_of_the_stage_by_brute_force(spark, sf, documents):
    rng, rows = random.Random(3), []
    for k in range(12):  # near copies in more than 3 bits, pairs below the bound, short texts
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 100, 400]))]
        for j in range(4):
            other = list(words)
            for _ in range(j * len(words) // 60):
                other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
            rows.append((1_000_000 + 10 * k + j, " ".join(other)))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    root, linked = brute_similar(texts)
    fps = {d: simhash.fingerprint(t) for d, t in texts.items()}
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in linked) > 3
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {d for d in texts if root[d] == d}


def test_a_large_group_of_near_copies_and_odd_rows(spark, odd, none):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:100], f"x{k}", *base[101:]])) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in similar.keep_one(d).collect()] == [0]
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, 8, None], key=str)
    assert similar.groups(none).count() == 0 and similar.keep_one(none).count() == 0


def test_copies_that_differ_too_much_form_few_pairs_and_lose_no_link(spark, monkeypatch):
    rng, sizes, families_of = random.Random(8), [], similar.families

    def noted(grid, near, *a):
        def counting(pairs):
            sizes.append(pairs.count())
            return near(pairs)

        return families_of(grid, counting, *a)

    monkeypatch.setattr(similar, "families", noted)
    base, texts = [f"w{i}" for i in range(150)], {}
    for k in range(200):
        words = list(base)
        for _ in range(5):
            words[rng.randrange(150)] = f"x{rng.randrange(5000)}"
        texts[2 * k] = " ".join(words)
        if k % 20 == 0:  # a link outside of the base's component
            texts[2 * k + 1] = f"{texts[2 * k]} end"
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(d).collect()}
    root, linked = brute_similar(texts)
    assert got == root and len(linked) > 5 and len(set(root.values())) > 100
    assert sizes[1] < 300


def test_close_fingerprints_of_five_words_meet_first(spark, monkeypatch):
    rng, known, met, families_of = random.Random(12), [], [], similar.families

    def noted(grid, near, *a):
        known.extend((r["node"]["id"], r["root"]["id"]) for r in a[2].collect())

        def kept(pairs):
            met.extend((r["a"]["id"], r["b"]["id"]) for r in pairs.select("a", "b").collect())
            return near(pairs)

        return families_of(grid, kept, *a)

    monkeypatch.setattr(similar, "families", noted)
    texts = {}
    for k in range(10):  # copies at few bits, copies at more, and one that shares less than 80 %
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        for j, n in enumerate((0, 0, 0, 1, 1, 5, 30)):
            other = list(words)
            for _ in range(n):
                other[rng.randrange(300)] = f"x{rng.randrange(9000)}"
            texts[10 * k + j] = " ".join([*other, *["end"] * j])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root, linked = brute_similar(texts)
    assert {r["doc_id"]: r["component_id"] for r in similar.groups(d).collect()} == root
    fps = {d: simhash.majority(similar.shingle_set(t)) for d, t in texts.items()}
    close = [(a, b) for a, b in linked if (fps[a] ^ fps[b]).bit_count() <= 3]
    least = {x: x for pair in close for x in pair}
    for _ in least:
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(known) == least and 20 < len(least) and len(close) < len(linked)
    assert not any(a in least and b in least and least[a] == least[b] for a, b in met)


def test_parities_bound_the_similarity(spark):
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    for n in (1, 9, 10, 45, 90, 900, 5000):
        for other in {0, 1, n // 9, n // 8, n // 5, n // 2}:
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[: len(x) - other // 2], rng.integers(0, 1 << 64, other - other // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            cell = lambda z: (similar.signature(z)[similar.BANDS + similar.SKETCH :].tolist(), len(z))
            if len(y):
                rows.append((cell(x), cell(y), both / (len(x) + len(y) - both)))
    kind = "struct<odd:array<long>,size:int>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}, j double").select("j", similar.possible(F.col("a"), F.col("b"), 0.8).alias("possible")).collect()
    assert all(r["possible"] for r in got if r["j"] >= 0.8) and any(r["possible"] for r in got)
    assert any(not r["possible"] for r in got)


def brute_hits(text, items, size=10):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        for w in decontam.windows_of(decontam.words_of(t), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_by_brute_force(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in op8_decontamination(spark, sf).collect()}
    assert any(r["contaminated"] for r in got.values())
    for r in documents.collect():
        n, hit, ids = brute_hits(r["text"], items)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (n, hit, len(ids), hit > 0)


def test_blocks_of_items_give_what_one_block_gives(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    pick = lambda d: sorted((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in d.collect())
    assert pick(decontam.contamination(documents, items)) == pick(decontam.contamination(documents, items, block=300))


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "ALPHA, beta-gamma! delta alpha beta gamma delta alpha beta gamma"), (2, "one"), (3, None), (4, ""), (None, "some words here"), (10, "one")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(odd, items).collect()}
    assert got[1] == (119, ["1"]) and got[7] == (1, ["10", "2"]) and got[2] == got[3] == (0, []) and got[None] == (3, [])
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 3, 4, 5, 6, 8]
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0 and decontam.decontaminate(odd, items.limit(0)).count() == 10


def brute_cuts(raw):
    import numpy as np

    out, last = [], 0
    for i in range(len(raw)):
        h = 0
        for j in range(16):
            if i - j >= 0:
                h += int(chunks._GEAR[raw[i - j]]) << j
        end = i + 1
        inside = end < len(raw) and raw[end] & 0xC0 == 0x80
        if end - last > chunks.MOST:
            raise AssertionError("text too long for this check")
        if h % (1 << 16) < (1 << 16) // chunks.ONE_IN and not inside and end - last >= chunks.LEAST:
            out.append(end)
            last = end
    assert np is not None
    return out if out and out[-1] == len(raw) else [*out, len(raw)]


def test_cuts_by_brute_force(documents):
    for r in documents.limit(40).collect():
        raw = r["text"].encode()[:3000].decode("utf-8", "ignore").encode()
        assert chunks.cuts(raw) == brute_cuts(raw)


def test_cuts_in_pieces_and_bounds(monkeypatch):
    raw = ("The quick brown fox. Ünïcödé " * 400).encode() + b"a" * 5000
    whole = chunks.cuts(raw)
    monkeypatch.setattr(chunks, "_PIECE", 777)
    assert chunks.cuts(raw) == whole and whole[-1] == len(raw)
    sizes = [b - a for a, b in zip([0, *whole], whole)]
    assert max(sizes) <= chunks.MOST + 3 and chunks.cuts(b"") == []
    assert b"".join(raw[a:b] for a, b in zip([0, *whole], whole)) == raw


def test_cuts_resist_insertions(documents):
    raw = max((r["text"] for r in documents.collect()), key=len).encode()
    pieces = lambda b: {b[s:e] for s, e in zip([0, *chunks.cuts(b)], chunks.cuts(b))}
    before, after = pieces(raw), pieces(raw[:1000] + b" inserted " + raw[1000:])
    assert len(before - after) <= 4


def test_repeats_hold_all_long_shared_passages(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    places = defaultdict(set)
    for d, t in texts.items():
        w = t.split()
        for n in (12, 51):
            for i in range(len(w) - n + 1):
                places[n, " ".join(w[i : i + n])].add(d)
    shared = lambda n: {d for (k, _), ds in places.items() if k == n and len(ds) > 1 for d in ds}
    got = {r["doc_id"]: r["spans"] for r in op7_substring_dedup(spark, sf).collect()}
    assert shared(51) <= set(got) <= shared(12)
    for d, spans in got.items():
        for s in spans:
            part = texts[d].encode()[s["start"] : s["stop"]].decode()
            assert any(part in t for o, t in texts.items() if o != d)


def test_repeats_of_odd_rows(spark, odd, none):
    assert chunks.repeats(none).count() == 0
    assert {r["doc_id"] for r in chunks.repeats(odd).collect()} == set()  # repeats within one doc_id are none
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    rows = [(1, f"first text here. {passage}", "x"), (2, f"{passage} and a second one", "y"), (3, "quite different words stand here", "z"), (4, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string")
    assert {r["doc_id"] for r in chunks.repeats(d).collect()} == {1, 2}
    out = {r["doc_id"]: r["text"] for r in chunks.deduplicated(d).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] is None and len(out[2]) < 200 and out[2].endswith("and a second one")


def test_repeats_tell_rows_that_share_an_id_or_have_none(spark):
    passage, other = (" ".join(f"{c}{i * 7919 % 1000}" for i in range(90)) for c in ("one", "two"))
    rows = [(1, passage, 1), (None, passage, 2), (None, passage, 3), (None, passage, 3), (1, other, 4), (2, f"{passage} tail", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, cut long")
    got = sorted((r["doc_id"] or 0, r["spans"][0]["later"]) for r in chunks.repeats(d).collect())
    assert got == [(0, True), (0, True), (1, False), (2, True)]
    out = chunks.deduplicated(d)
    assert out.columns == d.columns
    texts = {r["cut"]: r["text"] for r in out.collect()}
    assert texts[1] == passage and texts[4] == other and all(len(texts[k]) < 120 for k in (2, 3, 5)) and out.count() == 6


def test_what_an_earlier_document_has_goes_beside_what_only_a_later_one_has(spark):
    one, two = (" ".join(f"{c}{i * 7919 % 1000}" for i in range(80)) for c in ("early", "late"))
    rows = [(1, f"first text here. {one}"), (2, f"{one} {two}"), (3, f"{one} {two}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in chunks.repeats(d).collect()}
    assert [s["later"] for s in spans[2]] in ([True, False], [False, True, False]) and all(s["later"] for s in spans[3])
    assert spans[2][-2]["stop"] == spans[2][-1]["start"]
    out = {r["doc_id"]: r["text"] for r in chunks.deduplicated(d).collect()}
    assert out[1] == rows[0][1] and len(out[2]) < len(two) + 150 and out[2].endswith(two[-600:]) and len(out[3]) < 150
