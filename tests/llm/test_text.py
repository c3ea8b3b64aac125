import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plexgraph.llm import attention, extract, langid, lm, urltree
from plexgraph.llm.queries import op1_language_id, op4_url_filters, op5_lm_scoring


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    n = Counter()
    s = " " + " ".join(words) + " " if words else ""
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            g = s[i : i + k]
            if g != " " and not (k == 3 and g[1] == " "):
                n[g] += 1
    return n


def decoded(code):
    out = []
    while code:
        out.append(chr(code & (1 << 21) - 1))
        code >>= 21
    return "".join(reversed(out))


def test_grams_by_brute_force(monkeypatch, documents):
    texts = ["", "123 !", "Ab", "É, ça! \U00020000 x", *[r["text"] for r in documents.limit(20).collect()]]
    for size in (1 << 20, 37):
        monkeypatch.setattr(langid, "_PIECE", size)
        for t in texts:
            codes, counts = langid.grams(t)
            assert {decoded(int(c)): int(n) for c, n in zip(codes, counts)} == brute_grams(t)


def test_distance_is_out_of_place():
    codes, ranks = np.array([1, 2, 3]), np.array([[0, -1], [1, 0], [2, 1]])
    assert langid.distances(np.array([2, 9, 1]), codes, ranks, 10).tolist() == [1 + 10 + 2, 0 + 10 + 10]


def test_languages_of_held_out_documents(spark, documents):
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, odd, none, monkeypatch):
    d = odd.withColumn("held_out", F.lit("x"))
    got = langid.identify(d, F.lit(True)).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[6]["lang_pred"] == "de"
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert sorted(map(tuple, langid.identify(d, F.lit(True)).collect()), key=str) == sorted(map(tuple, got), key=str)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, really.</p></div>
%s<aside>Side text, here.</aside><section id="comments"><p>First! A comment, long enough, to look like text.</p></section>
<form><p>Sign up, please.</p></form><footer>&copy; Somebody, 2024.</footer></body></html>"""
BODY = "<h1>A   head</h1><p>One &amp; two,\n three.</p><p>Fo<b>ur</b> five. <br>Six &lt;7&gt;.<ul><li>Item one.<li>Item two.</ul><!-- <p>gone</p> --><div class='ad'>Buy, now.</div><p>Last&nbsp;line.</p>"
TEXT = "A head\nOne & two, three.\nFour five. Six <7>.\nItem one.\nItem two.\nLast line."


def test_main_text_of_pages():
    for wrap in ("<article>%s</article>", "<main><div>%s</div></main>", "<div class='content'>%s</div>", "<div id='wrap'><div>%s</div></div>"):
        assert extract.main_text(PAGE % (wrap % BODY)) == TEXT


def test_pages_of_odd_shape(spark):
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("just text & more") == "just text & more"
    assert extract.main_text("<article><p>cut &am") == "cut &am" and extract.main_text("<article><p>cut</p><p cla") == "cut"
    assert extract.main_text("<p>a, <svg>b</p><p>c.") == "a, b\nc."
    assert extract.main_text("<div>" * 20_000 + "Deep, but here.") == "Deep, but here."
    assert len(extract.main_text("<article>" + "<p>word word.</p>" * 20_000)) == 20_000 * 11 - 1
    assert extract.main_text("<a href='x" * 2000) == ""
    d = spark.createDataFrame([(1, "u", "<p>a b.</p>", "t"), (1, "u", "<p>a b.</p>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in extract.extract(d).fillna("-").collect()) == [(1, "u", "a b.", 4), (1, "u", "a b.", 4), (2, "-", "", 0)]
    assert extract.extract(d.limit(0)).count() == 0


def random_page(rng):
    """A well-formed page: an article of some shape among furniture that no word or tag gives away."""
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n)) + "."
    para = lambda: f"<p>{sentence(rng.randint(4, 60))} <b>{sentence(rng.randint(1, 4))}</b> {sentence(rng.randint(1, 20))}</p>"
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(rng.randint(2, 7))) + "</ul>"
    body = "".join(rng.choice([para, para, para, lambda: f"<h2>{word()}</h2>", lambda: f"<ul><li>{sentence(5)}</li><li>{word()}</li></ul>", lambda: f'<div class="ad">{sentence(6)}</div>']) () for _ in range(rng.randint(3, 12)))
    body = rng.choice(["<article>%s</article>", "<main><h1>top</h1><div>%s</div></main>", '<div class="text9">%s</div>', "<div><div>%s</div></div>", '<div class="page sidebar">%s</div>'])  % body
    box = lambda: rng.choice([f'<div class="x1">{sentence(rng.randint(1, 8))}</div>', f"<div>{links()}</div>", f"<nav>{links()}</nav>", f'<div id="comments">{para()}{para()}</div>', f"<h3>{word()}</h3>", f"<article>{sentence(4)}</article>"])
    return "<html><body>" + "".join(box() for _ in range(rng.randint(0, 4))) + body + "".join(box() for _ in range(rng.randint(0, 4))) + "</body></html>"


def brute_main_text(page):
    """Tag-path ratios by plain loops over the parse of the standard library, for well-formed pages."""
    from html.parser import HTMLParser

    nodes, number = [], [0]

    class Reader(HTMLParser):
        open = []

        def handle_starttag(self, tag, attrs):
            number[0] += 1
            d = dict(attrs)
            words = set(re.split("[^a-z0-9]+", f"{d.get('class', '')} {d.get('id', '')}"))
            label = ".".join([tag, *sorted(re.sub("[0-9]", "", d.get("class", "")).split())])
            self.open = [*self.open, (number[0], tag, label, bool(words & extract._WORDS))]

        def handle_endtag(self, tag):
            self.open = self.open[:-1]
            number[0] += 1

        def handle_data(self, text):
            if text.strip() and not any(t == "nav" for _, t, _, _ in self.open):
                blocks_open = [x for x in self.open if x[1] not in ("a", "b")]
                nodes.append((number[0], blocks_open, [x[2] for x in self.open if x[1] != "a"], text, any(t == "a" for _, t, _, _ in self.open)))

    Reader.open = []
    Reader().feed(page)
    leaf = lambda n: n[1][-1][0]
    groups = []  # blocks: text nodes in a row in one block-level element, which is left only by other blocks
    for n in nodes:
        if groups and leaf(groups[-1][-1]) == leaf(n):
            groups[-1].append(n)
        else:
            groups.append([n])
    path = lambda n: "/" + "/".join(n[2])
    block_path = lambda g: "/" + "/".join(x[2] for x in g[0][1])
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    mean = lambda f: {p: sum(f(n) for n in nodes if path(n) == p) / sum(path(n) == p for n in nodes) for p in map(path, nodes)}
    text, punct = mean(lambda n: 0 if n[4] else len(n[3].strip())), mean(lambda n: 0 if n[4] else marks(n[3]))
    tenth = {p: 0.1 / sum(path(n) == p for n in nodes) for p in text}
    suspects = lambda g: sum(x[3] for x in g[0][1])
    inside = lambda g: any(x[1] in ("article", "main") for x in g[0][1])
    prior = {id(n): 0.001 ** suspects(g) * (8 if inside(g) else 1) for g in groups for n in g}
    smooth = lambda v, i: sum(w * v[i + k - 2] for k, w in enumerate((1, 2, 4, 2, 1)) if 0 <= i + k - 2 < len(v)) / sum(w for k, w in enumerate((1, 2, 4, 2, 1)) if 0 <= i + k - 2 < len(v))
    t, q = [text[path(n)] for n in nodes], [punct[path(n)] + tenth[path(n)] for n in nodes]
    value = [smooth(t, i) * smooth(q, i) * prior[id(n)] for i, n in enumerate(nodes)]
    of = {p: [v for n, v in zip(nodes, value) if path(n) == p] for p in text}
    of = {p: sum(v) / len(v) for p, v in of.items()}
    m = sum(value) / len(value)
    bound = min(math.sqrt(sum((v - m) ** 2 for v in value) / len(value)), max(of.values()))
    size = lambda n: 0 if n[4] else len(n[3].strip())
    content = [sum(map(size, g)) > 0 and sum(of[path(n)] * size(n) for n in g) / sum(map(size, g)) >= bound * (1 - 1e-9) for g in groups]
    times, regions = Counter(map(block_path, groups)), {}
    for g, c in zip(groups, content):
        if c:
            stack = list(g[0][1])
            named = [k for k, x in enumerate(stack) if x[1] == "article"] or [k for k, x in enumerate(stack) if x[1] == "main"]
            if named:
                stack = stack[: named[-1] + 1]
            else:
                stack = stack[:-1] if times[block_path(g)] > 1 else stack
                while stack and stack[-1][1] in ("p", "ul", "li", "h1", "h2", "h3"):
                    stack = stack[:-1]
            r = tuple(x[2] for x in stack)
            regions[r] = min(regions.get(r, 99), suspects(g))
    keep = []
    for g, c in zip(groups, content):
        labels = tuple(x[2] for x in g[0][1])
        around = [n for r, n in regions.items() if labels[: len(r)] == r]
        links = sum(len(n[3].strip()) for n in g if n[4])
        keep.append(c or bool(around) and suspects(g) <= min(around) and 2 * links < len(" ".join("".join(n[3] for n in g).split())))
    for k in reversed(range(len(groups) - 1)):
        h = groups[k]
        if keep[k + 1] and h[0][1][-1][1] in ("h1", "h2", "h3") and suspects(h) <= suspects(groups[k + 1]) and not h[0][4]:
            keep[k] = True
    return "\n".join(" ".join("".join(n[3] for n in g).split()) for g, k in zip(groups, keep) if k)


def test_main_text_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        page = random_page(rng)
        assert extract.main_text(page) == brute_main_text(page), page


def test_the_ratios_decide(monkeypatch):
    article = "".join(f"<p>{'Some words, and others, stand here. ' * 6}</p>" for _ in range(5))
    two = f"<html><body><article class=a>{article}</article><article class=b><p>A teaser</p></article></body></html>"
    plain = f"<html><body><div>{article}</div><section><p>Terms of use</p></section></body></html>"
    assert "teaser" not in extract.main_text(two) and "Terms" not in extract.main_text(plain) and extract.main_text(two) == extract.main_text(plain)
    monkeypatch.setattr(extract, "fused", lambda text, punctuation: np.ones(len(text)))
    assert "teaser" in extract.main_text(two) and "Terms" in extract.main_text(plain)


def test_rules_of_urls(spark):
    urls = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://www.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.com/de/1#x", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://xexample.com/de/1", "xexample.com", "/de/1", None, "allow"), ("http://z.org/fr/", "z.org", "/fr/", "org/fr/", "allow"), ("http://z.net", "z.net", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"),
        ("http://h?u=http://b.net/x", "h", "", None, "allow"), ("x://ÄB.net/p\nq", "Äb.net", "/p\nq", "net/", "block"),
    ]
    d = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltree.judge(d).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert urltree.judge(d.limit(0)).count() == 0


def brute_purity(pages, prior_of):
    """(host, path) -> purity by the tree of its fold, from [(host, segments, fold, bad, key)], by plain recursion."""
    out = {}
    for tree in (0, 1):
        prior = prior_of(tree)

        def walk(rows, depth, above, tree=tree):
            train = [r for r in rows if r[2] != tree]
            n, x = len(train), sum(r[3] for r in train)
            purity = (x + urltree.STRENGTH * above) / (n + urltree.STRENGTH)
            on = [r for r in rows if len(r[1]) > depth] if n >= urltree.SUPPORT else []
            out.update({r[4]: purity for r in rows if r[2] == tree and r not in on})
            px, pn, branches = sum(r[3] for r in on if r[2] != tree), sum(r[2] != tree for r in on), {}
            for seg in {r[1][depth] for r in on}:
                mine = [r for r in on if r[1][depth] == seg]
                cn, cx = sum(r[2] != tree for r in mine), sum(r[3] for r in mine if r[2] != tree)
                rn, rx = pn - cn, px - cx
                share = px / max(pn, 1)
                error = math.sqrt(share * (1 - share) * (1 / max(cn, 1) + 1 / max(rn, 1)))
                stays = seg == "*" or rn == 0 or min(cn, rn) >= urltree.SUPPORT and abs(cx / max(cn, 1) - rx / max(rn, 1)) > urltree.Z * error
                branches.setdefault(seg if stays else "*", []).extend(mine)
            for rows_of in branches.values():
                walk(rows_of, depth + 1, purity)

        for host in {r[0] for r in pages}:
            walk([r for r in pages if r[0] == host], 0, prior)
    return out


def test_template_tree_by_brute_force(spark):
    rng = random.Random(8)
    urls = set()
    for _ in range(900):
        host = rng.choice(["a.org", "b.org", "c.org", "b.org", "rare.org"]) if rng.random() < 0.95 else f"h{rng.randrange(30)}.org"
        deep = [rng.choice(["x", "y", "z", "news", "7", "item-1-2-3-4"]) for _ in range(rng.randrange(7))]
        if rng.random() < 0.3:
            deep[2:3] = [rng.choice(["casino", "casino-2", "poker"])] if host == "b.org" else ["casino" if rng.random() < 0.2 else "w"]
        urls.add((host, "/" + "/".join(deep)))
    seed = re.compile(rf"(^|[^a-z0-9])({'|'.join(urltree.SEEDS)})([^a-z0-9]|$)")
    segs = lambda p: ["*" if re.search(urltree.VARIABLE, x) else x for x in p.split("/") if x]
    rows = [(h, segs(p), zlib.crc32(f"{h}{p}".encode()) % 2, bool(seed.search(h + p)), (h, p)) for h, p in sorted(urls)]

    def prior(tree):
        train = [r[3] for r in rows if r[2] != tree]
        return sum(train) / len(train)

    d = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(sorted(urls))], "page_id long, url string")
    got = {(r["host"], r["path"]): r["purity"] for r in urltree.judge(d, rules=()).collect()}
    want = brute_purity(rows, prior)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    verdict = {k: v >= urltree.BLOCK_AT for k, v in got.items()}
    seeded = {r[4]: r[3] for r in rows}
    assert any(verdict[k] != seeded[k] for k in verdict) and any(verdict.values())  # the label of a URL doesn't decide on it


def test_verdicts_agree_with_labels_that_were_held_out(spark):
    hosts = {"shop.example.org": 0, "my-pills.example.org": 1, "poker.example.org": 1, "blog.example.org": 0}
    rows = [(f"http://{h}/{'abcdefgh'[i % 8]}/{i}", b) for h, b in hosts.items() for i in range(120)] + [(f"http://shop.example.org/casino/{i}.html", 1) for i in range(80)]
    d = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urltree.judge(d).collect()}
    right = sum((got[k]["verdict"] == "block") == bool(b) for k, (_, b) in enumerate(rows))
    assert right / len(rows) > 0.98
    assert {r["template"] for r in got.values() if "casino" in r["path"]} == {"shop.example.org/casino/*"}
    assert len({r["template"] for r in got.values() if r["host"] == "shop.example.org"}) == 2


def test_url_query_has_every_page(spark, sf):
    assert op4_url_filters(spark, sf).count() == 50


def test_states_for_scoring_equal_those_of_training():
    rng = np.random.default_rng(0)
    p = attention.initial(rng.integers(1, 100, attention.LEAVES).astype(float))
    texts = [np.append(rng.integers(1, attention.LEAVES, n), 0).astype(np.int16) for n in (0, 1, 7, 16, 40, 500)]
    inputs, targets, owner = attention.layout(texts)
    assert np.bincount(owner, weights=(targets >= 0).sum(1)).astype(int).tolist() == [len(t) for t in texts]  # each token once
    np.testing.assert_allclose(attention._states(attention._folded(p), inputs), attention._hidden(p, inputs)["h"], rtol=2e-3, atol=2e-4)
    got = attention.scores(p, texts, batch=3)
    h = attention._hidden(p, inputs)["h"]
    for k, t in enumerate(texts):
        total = 0.0
        for row in np.flatnonzero(owner == k):
            for j in np.flatnonzero(targets[row] >= 0):
                y, v = int(targets[row, j]), h[row, j]
                one, two = v @ p["C"] + p["c"], v @ p["L"][y // attention.FAN] + p["l"][y // attention.FAN]
                total += one[y // attention.FAN] - np.log(np.exp(one).sum()) + two[y % attention.FAN] - np.log(np.exp(two).sum())
        assert math.isclose(got[k], total, rel_tol=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in attention.initial(rng.integers(1, 100, attention.LEAVES).astype(float)).items()}
    inputs, targets, _ = attention.layout([np.append(rng.integers(1, attention.LEAVES, 30), 0).astype(np.int16)])
    g, _ = attention._gradients(p, inputs, targets)
    for name in p:
        flat = p[name].reshape(-1)
        for i in {int(np.abs(g[name]).argmax()), 0}:
            old, d = flat[i], 1e-5
            flat[i] = old + d
            up = attention._gradients(p, inputs, targets)[1]
            flat[i] = old - d
            down = attention._gradients(p, inputs, targets)[1]
            flat[i] = old
            assert abs((up - down) / (2 * d) - g[name].reshape(-1)[i]) < 2e-4, name


def test_gradients_hold_no_copy_of_the_leaves_for_each_target():
    rng = np.random.default_rng(2)
    p = attention.initial(np.ones(attention.LEAVES))
    inputs, targets, _ = attention.layout([np.append(rng.integers(1, attention.LEAVES, 40_000), 0).astype(np.int16)])
    tracemalloc.start()
    try:
        attention._gradients(p, inputs, targets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < targets.size * 4 * attention.WIDTH * attention.FAN


def test_gradients_of_large_logits_and_of_no_target():
    rng = np.random.default_rng(4)
    inputs, targets, _ = attention.layout([np.append(rng.integers(1, attention.LEAVES, 60), 0).astype(np.int16)])
    p = attention.initial(np.ones(attention.LEAVES))
    for shift in (200, -200):
        q = p | {"c": p["c"] + np.float32(shift), "l": p["l"] - np.float32(shift)}
        (got, loss), (want, least) = attention._gradients(q, inputs, targets), attention._gradients(p, inputs, targets)
        assert abs(loss - least) < 1e-3
        for k in want:
            np.testing.assert_allclose(got[k], want[k], rtol=1e-2, atol=1e-4)
    g, loss = attention._gradients(p, inputs, np.full_like(targets, -1))
    assert loss == 0 and not any(x.any() for x in g.values())


def test_the_model_ignores_what_comes_later():
    p = attention.initial(np.ones(attention.LEAVES))
    a, b = np.arange(1, 60, dtype=np.int16), np.arange(1, 60, dtype=np.int16)
    b[40:] = 7
    first = lambda t: attention._states(attention._folded(p), attention.layout([t])[0]).reshape(-1, attention.WIDTH)[:41]
    np.testing.assert_allclose(first(a), first(b), rtol=1e-5)


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [t for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in lm.words_of(t))
    c[b""] = len(train)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in op5_lm_scoring(spark, sf).collect()}
    for d, t in docs:
        tokens = [*lm.words_of(t), b""]
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model predicts unseen texts better


def brute_score(model, subwords, text):
    """log10 probability of a text, position by position, with loops over what each one attends to."""
    p = {k: v.astype(float) for k, v in model["parameters"].items()}
    ids = [i for w in lm.words_of(text) for i in subwords.ids(w)]
    targets = [int(model["leaf"][i]) for i in ids] + [attention.END]
    inputs = [attention.PAD] * attention.CELL + [attention.END] + targets[:-1]
    total = sum(float(model["inside"][i]) for i in ids)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for t, y in enumerate(targets):
        first = t // attention.SCORED * attention.SCORED  # the window's place; it ends with the input before the target
        x = np.array([p["E"][inputs[first + j]] + p["P"][j] for j in range(t + attention.CELL - first + 1)])
        q = x[-1] @ p["Q"] / math.sqrt(attention.WIDTH)
        w = softmax(np.array([q @ (k @ p["K"]) for k in x]))
        h0 = sum(a * (k @ p["V"]) for a, k in zip(w, x)) @ p["O"] + x[-1]
        h = h0 + np.maximum(h0 @ p["A"] + p["a"], 0) @ p["B"]
        c, leaf = divmod(y, attention.FAN)
        total += math.log10(softmax(h @ p["C"] + p["c"])[c]) + math.log10(softmax(h @ p["L"][c] + p["l"][c])[leaf])
    return total


def test_a_score_is_that_of_the_model_by_brute_force(monkeypatch):
    with open(lm.TOKENIZER, "rb") as f:
        sub = lm.Subwords(f.read())
    texts = ["the cat sat on the mat and the dog ran off " * 6, "", "one", "Some OTHER words, with marks; " * 4 + "zzyzx"]
    frequency = Counter(i for t in texts for w in lm.words_of(t) for i in sub.ids(w))
    frequency |= {i: 1 + i % 3 for i in range(1500)}
    few = attention.train
    monkeypatch.setattr(attention, "train", lambda t, mass, **_: few(t, mass, steps=30))
    model = lm.fit(texts, sub, dict(frequency), len(texts))
    table = lm.Leaves(sub, model["leaf"], model["inside"])
    for t in texts:
        sequence, extra = table.sequence(lm.words_of(t))
        got = attention.scores(model["parameters"], [sequence])[0] / math.log(10) + extra
        assert math.isclose(got, brute_score(model, sub, t), rel_tol=1e-3, abs_tol=1e-3)


def test_pieces_come_from_all_of_a_text(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    d = spark.createDataFrame([(1, "short text"), (2, long), (3, None), (None, "x" * 40_000)], "doc_id long, text string")
    rows = lm.pieces(d, "doc_id", "text").collect()
    assert len(rows) == 1 + -(-len(long) // lm.STRETCH) + 1 + 3
    assert sum(len(r["stretch"]) for r in rows) == len("short text") + len(long) + 40_000
    for r in rows:
        piece = lm.piece_of(r["stretch"], r["h"])
        assert piece in r["stretch"] and len(piece) <= lm.PIECE and (len(r["stretch"]) > lm.PIECE or piece == r["stretch"])
        if "w1" in piece and len(r["stretch"]) > lm.PIECE:
            assert set(piece.split()) <= set(long.split())


def test_all_training_text_teaches_the_model(spark, monkeypatch):
    seen = []

    def noted(model, drawn, ranks):
        seen.extend(lm.piece_of(r["stretch"], r["h"]) for r in drawn.collect())
        return model

    monkeypatch.setattr(lm, "refined", noted)
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate([5, 40, 400, 9000, 30, 7])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm.score(d, F.col("doc_id") != 4).count() == len(texts)
    assert Counter("".join(seen)) == Counter("".join(texts[:4] + texts[5:]))


def test_refined_models_are_the_mean_of_the_tasks(spark, monkeypatch):
    with open(lm.TOKENIZER, "rb") as f:
        raw = f.read()
    sub = lm.Subwords(raw)
    leaf, inside, mass = lm.leaves({i: 50 - i % 50 for i in range(3000)}, 5, 50_256)
    model = {"leaf": leaf, "inside": inside, "parameters": attention.initial(mass)}
    monkeypatch.setattr(lm, "ROUNDS", 1)
    texts = [" ".join(f"word{(i * 7 + k) % 90}" for i in range(60 + k)) for k in range(6)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "h long, stretch string").repartitionByRange(3, "h")
    parts = [[] for _ in range(3)]
    for r in d.selectExpr("spark_partition_id() AS p", "h", "stretch").collect():
        parts[r["p"]].append((r["h"], r["stretch"]))
    got = lm.refined(model, d, spark.sparkContext.broadcast(raw))["parameters"]
    table, total, want = lm.Leaves(sub, leaf, inside), 0, {}
    for rows in filter(None, parts):
        p, n = attention.refine(model["parameters"], [[table.sequence(lm.words_of(lm.piece_of(t, h)))[0] for h, t in rows]], lm.RATE)
        total += n
        want = {k: want.get(k, 0) + v.astype(float) * n for k, v in p.items()}
    assert all(np.allclose(got[k], want[k] / total, atol=1e-5) for k in want) and not np.allclose(got["C"], model["parameters"]["C"])
    assert lm.refined(model, d.limit(0), spark.sparkContext.broadcast(raw)) is model


def test_scores_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 3)
    monkeypatch.setattr(attention, "train", lambda texts, mass, **_: attention.initial(mass))
    d = odd.withColumn("score", F.lit("x"))
    got = lm.score(d, F.col("doc_id") != 5).collect()
    assert len(got) == 10 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[5]["n_tokens"] == 60_001 and by[5]["held_out"]
    monkeypatch.setattr(lm, "HEAD", 2)
    again = {r["doc_id"]: r for r in lm.score(d, F.col("doc_id") != 5).collect()}
    assert all(math.isclose(again[k]["base_score"], by[k]["base_score"], rel_tol=1e-9) and again[k]["n_known"] == by[k]["n_known"] for k in by)
    assert lm.score(none, F.lit(True)).count() == 0


def test_a_column_is_cut_as_its_texts_are_with_one_call_for_its_words(monkeypatch):
    with open(lm.TOKENIZER, "rb") as f:
        raw = f.read()
    sub, by_text = lm.Subwords(raw), lm.Subwords(raw)
    leaf, inside, _ = lm.leaves({i: 50 - i % 50 for i in range(3000)}, 5, 50_256)
    texts = [None, "", " \t\n ", "The cat\x0bSAT on\x0cthe\r\nMat ", "x" * 1000 + " y " + "z" * 199, " \xa0 \x1c\x85 \U0001f600", "ÀÉ à the cat the", "w" * 200 + " cat"]
    table, one_by_one = lm.Leaves(by_text, leaf, inside), []
    monkeypatch.setattr(lm.Subwords, "ids", lambda self, w, ids=lm.Subwords.ids: (self is sub and one_by_one.append(w)) or ids(self, w))
    for column in (pa.array(texts), pa.array(["before", *texts, "after"]).slice(1, len(texts)), pa.array(texts[:3])):
        got = lm.Sequences(column, sub, leaf, inside)
        words = got.words.to_pylist()
        for k, t in enumerate(column.to_pylist()):
            sequence, extra = table.sequence(lm.words_of(t))
            assert got.leaves[k].tolist() == sequence.tolist() and math.isclose(got.extra[k], extra, abs_tol=1e-9)
            assert [words[i] for i in got.at[got.first[k] :][: got.n_tokens[k]]] == [*lm.words_of(t), b""]
    assert {len(w) for w in one_by_one} == {200, 1000}  # words of fewer bytes are cut together
    counted = list(lm._count_words(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]) for _ in range(3)))
    n = Counter()
    for b in counted:
        n.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())))
    assert n == Counter(w for t in texts * 3 for w in [*lm.words_of(t), b""])
    ids = next(lm._count_subwords(iter(counted), SimpleNamespace(value=raw)))
    assert dict(zip(ids.column("id").to_pylist(), ids.column("n").to_pylist())) == Counter(i for t in texts * 3 for w in lm.words_of(t) for i in by_text.ids(w))


def test_steps_are_those_of_adam():
    rng = np.random.default_rng(6)
    p = {"a": rng.standard_normal((3, 5)).astype(np.float32), "b": rng.standard_normal(4).astype(np.float32)}
    adam, want = attention.Adam(p), {k: x.astype(float) for k, x in p.items()}
    m, v = ({k: np.zeros(x.shape) for k, x in p.items()} for _ in range(2))
    for t in range(1, 40):
        g = {k: (rng.standard_normal(x.shape) * 10.0 ** rng.integers(-6, 1, x.shape)).astype(np.float32) for k, x in p.items()}
        adam.step(g, 1e-2 / t)
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k].astype(float) ** 2
            want[k] -= 1e-2 / t * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    assert all(np.allclose(adam.p[k], want[k], atol=1e-5) and not np.allclose(adam.p[k], p[k], atol=1e-3) for k in p)


def test_rare_words_leave_the_cache(monkeypatch):
    with open(lm.TOKENIZER, "rb") as f:
        sub = lm.Subwords(f.read())
    leaf, inside, _ = lm.leaves({i: 50 - i % 50 for i in range(3000)}, 5, 50_256)
    plain, small = lm.Leaves(sub, leaf, inside), lm.Leaves(sub, leaf, inside, {b"the"})
    monkeypatch.setattr(lm, "_CACHE", 3)
    words = b"the cat sat on the mat and the zzyzx qwrtp sat".split() * 3
    a, b = plain.sequence(words), small.sequence(words)
    assert a[0].tolist() == b[0].tolist() and math.isclose(a[1], b[1]) and len(small) <= len(set(words))
    small._evict()
    assert set(small) == {b"the"}


def test_large_logits_give_finite_scores():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, attention.LEAVES, n).astype(np.int16) for n in (1, 7, 40, 300)]
    p = attention.initial(np.ones(attention.LEAVES))
    p = {k: v * np.float32(30) for k, v in p.items()}
    got = attention.scores(p, texts)
    assert np.isfinite(got).all() and (got < 0).all()
    x = rng.standard_normal((5, attention.FAN)).astype(np.float32) * 40
    exact = np.log(np.exp(x.astype(float)).sum(1))
    assert np.allclose(attention._log_total(x), exact, rtol=1e-5) and np.allclose(attention._log_total(x * 3), np.log(np.exp(3 * x.astype(float)).sum(1)), rtol=1e-5)
