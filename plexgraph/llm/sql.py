"""DuckDB SQL for the training-text queries that SQL can express. Ids are taken to be unique."""

from __future__ import annotations

from plexgraph.llm import mixing, quality, urltree

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"


def mix() -> str:
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {mixing.BITS // 4}))::BIGINT AS h, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT key, source, sum(size)::DOUBLE AS size FROM d GROUP BY key, source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {cases} END AS w, size * {mixing.MOST} AS cap FROM s),
r AS (SELECT *, ({mixing.SHARE} * sum(size) OVER () - (sum(cap) OVER (ORDER BY cap / w, key) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, key) - w)) AS level FROM w),
l AS (SELECT min(level) AS level FROM (SELECT level, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, key) AS k FROM r WHERE level <= cap / w ORDER BY k LIMIT 1)),
t AS (SELECT key, size, least(cap, w * coalesce(level, 1e300)) AS target FROM w, l),
p AS (SELECT key, size, target, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM t), q AS (SELECT *, target - whole * size AS rest FROM p),
g AS (SELECT key, h, sum(d.size) AS s FROM d GROUP BY key, h), u AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY h) AS upto FROM g),
c AS (SELECT u.key, min_by(CASE WHEN 2 * (rest - upto + s) > s THEN h + 1 ELSE h END, h) AS cut FROM u JOIN q ON u.key = q.key WHERE rest > 0 AND upto > rest GROUP BY u.key)
SELECT doc_id, d.size, q.size::BIGINT AS source_size, round(target, 6) AS target, (d.size * (whole + CASE WHEN h < coalesce(cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.key = q.key LEFT JOIN c ON c.key = d.key"""


def rules() -> str:
    measure = {
        "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
        "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)",
    }
    seen = ", ".join("count(*) FILTER (" + " OR ".join(f"{measure[r]} > {ladder[j]}" for r, (_, ladder) in quality.RULES.items()) + f") AS x_{j}" for j in range(quality.STEPS))
    cuts = ", ".join("coalesce(" + ", ".join(f"CASE WHEN x_{j} <= k THEN {c}::DOUBLE END" for j, c in enumerate(ladder)) + f") AS {r}" for r, (_, ladder) in quality.RULES.items())
    bad = " OR ".join(f"coalesce({measure[r]} > {r}, false)" for r in quality.RULES)
    rate = quality.RISK
    return f"""WITH a AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM a)),
tw AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM tw WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS ls FROM a),
m AS (SELECT a.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0b\\x0c\\r]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words FROM a JOIN ln ON a.doc_id = ln.doc_id LEFT JOIN rp ON a.doc_id = rp.doc_id),
gd AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
se AS (SELECT stratum, count(*) AS n, {seen} FROM m WHERE doc_id IN (SELECT doc_id FROM gd) AND NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY stratum),
tm AS (SELECT stratum, n, i, CASE WHEN i = 0 THEN n * ln(1 - {rate}) ELSE ln((n - i + 1) / i) + ln({rate} / (1 - {rate})) END AS step FROM (SELECT stratum, n, unnest(range(0, 1 + greatest(1, ceil(n * {rate}))::BIGINT)) AS i FROM se)),
cd AS (SELECT stratum, i, sum(exp(term)) OVER (PARTITION BY stratum ORDER BY i) AS cdf FROM (SELECT stratum, i, sum(step) OVER (PARTITION BY stratum ORDER BY i) AS term FROM tm)),
km AS (SELECT se.*, coalesce((SELECT max(i) FROM cd WHERE cd.stratum = se.stratum AND cdf <= {quality.DELTA} * se.n / (SELECT sum(n) FROM se)), -1) AS k FROM se), ct AS (SELECT stratum, {cuts} FROM km)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({bad}) AS kept FROM m LEFT JOIN ct ON m.stratum = ct.stratum"""


def leaks() -> str:
    words = f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words} AS ws FROM documents), b AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {words} AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM b)), ns AS (SELECT DISTINCT n FROM w),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, dw.n, k FROM dw JOIN w ON dw.win = w.win AND dw.n = w.n), p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""


def urls(depth: int = 3) -> str:
    """The path-template tree unrolled to ``depth`` segments, which the paths of the tables don't exceed."""
    low = _LOWER.format("host || path")
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(urltree.RULES, key=lambda r: (-len(r.text), r.text))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered) + " END"
    support, z, strength = urltree.SUPPORT, urltree.Z, urltree.STRENGTH
    steps, done = [], []
    for k in range(depth + 1):
        steps.append(
            f"""p{k} AS (SELECT n{k}.*, (sum(x) OVER v + {strength} * above) / (sum(n) OVER v + {strength}) AS purity, sum(n) OVER v >= {support} AND len(path) > {k} AS goes_on FROM n{k} WINDOW v AS (PARTITION BY node)),
c{k} AS (SELECT *, path[{k + 1}] AS seg FROM p{k} WHERE goes_on), d{k} AS (SELECT node, seg, sum(n) AS cn, sum(x) AS cx FROM c{k} GROUP BY node, seg),
f{k} AS (SELECT *, sum(cn) OVER v AS pn, sum(cx) OVER v AS px FROM d{k} WINDOW v AS (PARTITION BY node)),
g{k} AS (SELECT node, seg, CASE WHEN seg = '*' OR pn = cn OR (cn >= {support} AND pn - cn >= {support} AND abs(cx / greatest(cn, 1) - (px - cx) / greatest(pn - cn, 1)) > {z} * sqrt(px / greatest(pn, 1) * (1 - px / greatest(pn, 1)) * (1 / greatest(cn, 1) + 1 / greatest(pn - cn, 1)))) THEN seg ELSE '*' END AS s FROM f{k}),
n{k + 1} AS (SELECT tree, host, segs, path, n, x, c{k}.node || '/' || s AS node, purity AS above FROM c{k} JOIN g{k} ON c{k}.node = g{k}.node AND c{k}.seg = g{k}.seg)"""
        )
        done.append(f"SELECT tree, host, segs, purity FROM p{k} WHERE NOT goes_on")
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
crc AS (WITH RECURSIVE t(i, k, c) AS (SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8) SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
y AS (SELECT *, regexp_matches({low}, '(^|[^a-z0-9])({'|'.join(urltree.SEEDS)})([^a-z0-9]|$)') AS bad, array_to_string(list_transform(list_filter(string_split({_LOWER.format("path")}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{urltree.VARIABLE}') THEN '*' ELSE s END), '/') AS segs,
(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(host || path)) + 1), lambda i: ('0x' || substr(hex(encode(host || path)), 2 * i::INTEGER - 1, 2))::UBIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {urltree.FOLDS})::INTEGER AS fold FROM v, crc),
o AS (SELECT host, segs, tree, sum(CASE WHEN fold = tree THEN 0 ELSE 1 END) AS n, sum(CASE WHEN fold <> tree AND bad THEN 1 ELSE 0 END) AS x FROM y, range({urltree.FOLDS}) AS r(tree) GROUP BY host, segs, tree),
pr AS (SELECT tree, coalesce(sum(x) / nullif(sum(n), 0), 0) AS prior FROM o GROUP BY tree),
n0 AS (SELECT o.tree, host, segs, CASE WHEN segs = '' THEN [] ELSE string_split(segs, '/') END AS path, n, x, o.tree || '/' || host AS node, prior AS above FROM o JOIN pr ON o.tree = pr.tree),
{", ".join(steps)}, tr AS ({" UNION ALL ".join(done)})
SELECT page_id, y.host, path, {rule.replace("host", "y.host")} AS rule, coalesce({verdict.replace("host", "y.host")}, CASE WHEN purity >= {urltree.BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM y JOIN tr ON y.fold = tr.tree AND y.host = tr.host AND y.segs = tr.segs"""


ORACLES = {"op3_mixing": mix(), "op4_url_filters": urls(), "op6_quality_rules": rules(), "op8_decontamination": leaks()}
