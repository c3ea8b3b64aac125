"""Queries over the driver's tables, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.functions import text
from plexgraph.operators import changes, components, coupling, deadcode, embedding, flows, incremental, intervals, lookup, resolve, search, structure, traverse, urls
from plexgraph.plans.projections import NEXT_SQL, PATHS_SQL, TOGETHER_SQL, bought_together, day_changes, next_edges, order_changes, page_paths, part_nodes, trade_edges, trade_nodes
from plexgraph.session import settle, table
from plexgraph.streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _coupling_sql(changes_sql: str, threshold: float) -> str:
    return f"""WITH ch AS (SELECT DISTINCT commit, item FROM ({changes_sql})),
sm AS (SELECT commit FROM ch GROUP BY commit HAVING count(*) <= 50),
tot AS (SELECT item, count(*) AS n FROM ch GROUP BY item),
pr AS (SELECT x.item AS a, y.item AS b, count(*) AS co_changes FROM ch x JOIN ch y ON x.commit = y.commit AND x.item < y.item WHERE x.commit IN (SELECT commit FROM sm) GROUP BY 1, 2)
SELECT a, b, co_changes, round(co_changes / greatest(p.n, q.n), 6) AS strength FROM pr JOIN tot p ON p.item = a JOIN tot q ON q.item = b WHERE co_changes / greatest(p.n, q.n) >= {threshold}"""


_ORDERS_SQL = "SELECT l_orderkey AS commit, l_partkey AS item FROM lineitem"
_DAYS_SQL = "SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS commit, event_type AS item FROM events"


@query(_coupling_sql(_ORDERS_SQL, 0.05))
def cochange_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.coupling(order_changes(spark, sf), 0.05).withColumn("strength", F.round("strength", 6))


@query(_coupling_sql(_DAYS_SQL, 0.3))
def coupling_default_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.coupling(day_changes(spark, sf)).withColumn("strength", F.round("strength", 6))


@query(
    f"WITH {NEXT_SQL}, cp AS ("
    + _coupling_sql(_ORDERS_SQL, 0.05)
    + """), two AS (SELECT 'part:' || a AS node, 'part:' || b AS partner, strength, co_changes FROM cp UNION ALL SELECT 'part:' || b, 'part:' || a, strength, co_changes FROM cp)
SELECT node, partner, strength, co_changes, EXISTS (SELECT 1 FROM nx WHERE (src = node AND dst = partner) OR (src = partner AND dst = node)) AS linked FROM two"""
)
def coupling_lookup_undirected(spark: SparkSession, sf: str) -> DataFrame:
    c = cochange_coupling(spark, sf).withColumns({k: F.concat(F.lit("part:"), F.col(k).cast("string")) for k in "ab"})
    return coupling.partners(c, next_edges(spark, sf))


_TRADE_NODES = """SELECT 'customer' AS label FROM customer UNION ALL SELECT 'order' FROM orders UNION ALL SELECT 'part' FROM part
UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'region' FROM region"""


@query(f"SELECT label, count(*) AS n FROM ({_TRADE_NODES}) GROUP BY label")
def node_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.counts(trade_nodes(spark, sf), "label")


@query(
    """SELECT 'placed' AS rel_type, count(*) AS n FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem
UNION ALL SELECT 'supplied_by', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'located_in', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'part_of', count(*) FROM nation"""
)
def edge_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.counts(trade_edges(spark, sf), "rel_type")


@query("SELECT 'customer:' || c_custkey AS id, 'customer' AS label, c_name AS name FROM customer WHERE c_custkey = 7")
def get_node(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.get_node(trade_nodes(spark, sf), "customer:7")


def _neighbour_sql(a: str, b: str) -> str:
    return f"""WITH {NEXT_SQL} SELECT {a} AS node, {b} AS neighbour, p_name AS name, confidence, CASE WHEN confidence >= 0.9 THEN 'certain' WHEN confidence >= 0.5 THEN 'likely' ELSE 'weak' END AS tag
FROM nx JOIN part ON {b} = 'part:' || p_partkey"""


@query(_neighbour_sql("src", "dst"))
def neighbors_out(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.neighbours(part_nodes(spark, sf), next_edges(spark, sf), "out")


@query(_neighbour_sql("dst", "src"))
def neighbors_in(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.neighbours(part_nodes(spark, sf), next_edges(spark, sf), "in")


_NAME = "(SELECT min(p_name) FROM part)"


@query(f"SELECT 'part:' || p_partkey AS id, p_name AS name, 2.0::DOUBLE AS score FROM part WHERE p_name = {_NAME} ORDER BY 'part:' || p_partkey LIMIT 5")
def exact_name_search(spark: SparkSession, sf: str) -> DataFrame:
    name = table(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return lookup.exact_name(part_nodes(spark, sf), name)


@query(
    f"""WITH q AS (SELECT lower({_NAME}) || 'x' AS q), d AS (SELECT 'part:' || p_partkey AS id, p_name AS name, levenshtein(lower(p_name), q) AS d FROM part, q)
SELECT id, name, round(greatest(0.3, 1 - 0.3 * d), 6)::DOUBLE AS score FROM d WHERE d <= 2 ORDER BY score DESC, id LIMIT 20"""
)
def fuzzy_name_search(spark: SparkSession, sf: str) -> DataFrame:
    name = table(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return search.fuzzy(part_nodes(spark, sf), name + "x").withColumn("score", F.round("score", 6))


WORDS = "the reation onand"


def _bm25_sql(group: str = "''") -> str:
    terms = WORDS.split()
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    s = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    return f"""tk AS (SELECT doc_id AS id, {group} AS grp, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents),
rw AS (SELECT id, grp, len(ts) AS dl, {tf} FROM tk), st AS (SELECT grp AS g, count(*) AS n, avg(dl) AS avgdl, {df} FROM rw GROUP BY grp),
bm AS (SELECT id, grp, {s} AS score FROM rw JOIN st ON grp = g WHERE {s} > 0)"""


@query(f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = search.bm25(table(spark, sf, "documents"), WORDS, "doc_id")
    return search.top_per_group(found, 20).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_bm25_sql("coalesce(lang, '')")}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r FROM bm)
SELECT id, grp AS lang, round(score * CASE WHEN grp = 'en' THEN 1.2 ELSE 0.5 END, 6) AS score FROM rk WHERE r <= 10 ORDER BY rk.score * CASE WHEN grp = 'en' THEN 1.2 ELSE 0.5 END DESC, id LIMIT 10"""
)
def bm25_boosted_topk_per_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    found = search.bm25(docs, WORDS, "doc_id", "text", "lang")
    top = search.top_per_group(found, 10, F.when(F.col("group") == "en", 1.2).otherwise(0.5))
    return top.select("id", F.col("group").alias("lang"), F.round("score", 6).alias("score"))


_VECTOR_SQL = "SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]) AS score FROM embeddings"


@query(f"SELECT id, round(score, 6) AS score FROM ({_VECTOR_SQL}) v ORDER BY v.score DESC, id LIMIT 10")
def vector_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 7").first()["embedding"]
    return search.vectors(e, q, 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


_FUSED_SQL = f"""{_bm25_sql()}, l1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY r LIMIT 60),
l2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_VECTOR_SQL}) ORDER BY r LIMIT 60),
fu AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY id)"""


@query(f"WITH {_FUSED_SQL} SELECT id, round(score, 6)::DOUBLE AS score FROM fu ORDER BY fu.score DESC, id LIMIT 20")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    fts = search.top_per_group(search.bm25(table(spark, sf, "documents"), WORDS, "doc_id"), 60).select("id", "score")
    e = table(spark, sf, "embeddings")
    vec = search.vectors(e, e.where("vec_id = 7").first()["embedding"], 60, "vec_id", "embedding")
    return search.fuse([(fts, 1.0), (vec, 1.0)]).orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


_REACH = """rec AS (SELECT root, node, 0 AS depth FROM roots UNION SELECT rec.root, {b}, rec.depth + 1 FROM rec JOIN nx ON {a} = rec.node WHERE rec.depth < {d})
, best AS (SELECT root, node, min(depth) AS depth FROM rec GROUP BY root, node HAVING min(depth) > 0)"""


def _reach_sql(roots: str, depth: int, a: str = "src", b: str = "dst") -> str:
    return f"WITH RECURSIVE {NEXT_SQL}, roots AS ({roots}), {_REACH.format(a=a, b=b, d=depth)}"


_ROOT = "(SELECT src FROM nx GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def _root(edges: DataFrame, end: str = "src") -> str:
    return edges.groupBy(end).count().orderBy(F.desc("count"), end).first()[0]


@query(_reach_sql(f"SELECT src AS root, src AS node FROM {_ROOT} t", 6) + " SELECT node, depth::INTEGER AS depth FROM best")
def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(next_edges(spark, sf))
    roots = spark.createDataFrame([(_root(e),)], "root string")
    return traverse.reach(e, roots, 6).select("node", "depth")


_SINK = "(SELECT dst FROM nx GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


@query(
    _reach_sql(f"SELECT dst AS root, dst AS node FROM {_SINK} t", 3, "dst", "src")
    + """ SELECT node, best.depth::INTEGER AS depth, CASE best.depth WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'transitive' END AS tag, confidence
FROM best LEFT JOIN nx ON src = node AND dst = best.root"""
)
def impact_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(next_edges(spark, sf))
    return traverse.impact(e, _root(e, "dst"), 3)


@query(
    _reach_sql("SELECT DISTINCT src AS root, src AS node FROM nx WHERE src IN (SELECT src FROM nx ORDER BY src LIMIT 20)", 4)
    + " SELECT root, node, depth::INTEGER AS depth, depth <= 2 AS near FROM best"
)
def multi_root_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(next_edges(spark, sf))
    roots = e.select("src").orderBy("src").limit(20).distinct().withColumnRenamed("src", "root")
    return traverse.reach(e, roots, 4).withColumn("near", F.col("depth") <= 2)


@query(
    f"""WITH RECURSIVE {NEXT_SQL}, ends AS (SELECT (SELECT min(src) FROM nx) AS a), rec AS (SELECT a AS node, [a] AS path FROM ends UNION ALL SELECT dst, list_append(path, dst) FROM rec JOIN nx ON src = node WHERE len(path) <= 5 AND NOT list_contains(path, dst)),
tgt AS (SELECT node FROM (SELECT node, min(len(path)) AS d FROM rec GROUP BY node) ORDER BY d DESC, node LIMIT 1)
SELECT array_to_string(path, ' ') AS path, len(path) - 1 AS hops FROM rec WHERE node = (SELECT node FROM tgt) ORDER BY len(path), path LIMIT 1"""
)
def call_path(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(next_edges(spark, sf))
    a = e.agg(F.min("src")).first()[0]
    far = traverse.reach(e, spark.createDataFrame([(a,)], "root string"), 5).orderBy(F.desc("depth"), "node").first()
    return traverse.path(e, a, far["node"] if far else a, 5).select(F.array_join("path", " ").alias("path"), "hops")


@query(
    f"""WITH RECURSIVE {NEXT_SQL}, live AS (SELECT src, dst FROM nx), rec AS (SELECT src AS a, dst AS b FROM live UNION SELECT a, dst FROM rec JOIN live ON src = b),
mut AS (SELECT x.a, x.b FROM rec x JOIN rec y ON x.a = y.b AND x.b = y.a), cm AS (SELECT a AS node, min(b) AS component FROM mut GROUP BY a)
SELECT node, component FROM cm WHERE component IN (SELECT component FROM cm GROUP BY component HAVING count(*) >= 2)"""
)
def scc_groups(spark: SparkSession, sf: str) -> DataFrame:
    return components.strong_components(next_edges(spark, sf))


def _ppr_sql(rounds: int) -> str:
    steps = []
    for k in range(rounds):
        steps.append(
            f"""g{k} AS MATERIALIZED (SELECT dst AS node, sum(rank * share) AS got FROM r{k} JOIN sh ON src = node GROUP BY dst),
r{k + 1} AS MATERIALIZED (SELECT rs.node, 0.85 * (coalesce(got, 0) + (1 - (SELECT coalesce(sum(got), 0) FROM g{k})) * reset) + 0.15 * reset AS rank FROM rs LEFT JOIN g{k} ON rs.node = g{k}.node)"""
        )
    return f"""WITH {NEXT_SQL}, ot AS (SELECT src AS s, sum(n) AS o FROM nx GROUP BY src), sh AS (SELECT src, dst, n / o AS share FROM nx JOIN ot ON src = s),
nd AS (SELECT src AS node FROM nx UNION SELECT dst FROM nx), fo AS (SELECT DISTINCT src AS node FROM (SELECT src FROM nx ORDER BY src LIMIT 5)),
rs AS (SELECT nd.node, CASE WHEN fo.node IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(*) FROM fo) END AS reset FROM nd LEFT JOIN fo ON nd.node = fo.node),
r0 AS (SELECT node, reset AS rank FROM rs), {", ".join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds} WHERE rank > 0"""


@query(_ppr_sql(5))
def ppr_fixed_iterations(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(next_edges(spark, sf))
    multi = e.select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    focus = e.select("src").orderBy("src").limit(5).select(F.col("src").alias("node"))
    return components.pagerank(multi, focus, 5).withColumn("rank", F.round("rank", 9))


def _lpa_sql(rounds: int) -> str:
    steps = []
    for k in range(rounds):
        steps.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT node, community, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS r
FROM (SELECT u.src AS node, c.community, count(*) AS n FROM un u JOIN c{k} c ON u.dst = c.node GROUP BY 1, 2)) WHERE r = 1)"""
        )
    return f"""{TOGETHER_SQL}, tw AS (SELECT src, dst FROM tg UNION ALL SELECT dst, src FROM tg), un AS (SELECT src, dst FROM tw UNION ALL SELECT DISTINCT src, src FROM tw),
c0 AS (SELECT DISTINCT src AS node, src AS community FROM un), {", ".join(steps)}"""


@query(f"WITH {_lpa_sql(3)} SELECT node, community FROM c3")
def lpa_fixed_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return components.communities(bought_together(spark, sf), 3)


@query(
    f"""WITH {_lpa_sql(3)}, ed AS (SELECT a.community AS ca, b.community AS cb FROM tg JOIN c3 a ON src = a.node JOIN c3 b ON dst = b.node),
tc AS (SELECT ca AS community, (ca = cb)::INT AS i FROM ed UNION ALL SELECT cb, 0 FROM ed WHERE ca <> cb), sz AS (SELECT community, count(*) AS size FROM c3 GROUP BY 1)
SELECT sz.community, size, round(coalesce(sum(i) / count(i), 0), 6) AS cohesion FROM sz LEFT JOIN tc ON sz.community = tc.community GROUP BY 1, 2"""
)
def community_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    e = settle(bought_together(spark, sf))
    return components.cohesion(e, components.communities(e, 3)).withColumn("cohesion", F.round("cohesion", 6))


@query(
    f"""WITH {_lpa_sql(3)}, gr AS (SELECT community, p_brand AS g, count(*) AS n, min(p_partkey) AS f FROM c3 JOIN part ON node = 'part:' || p_partkey GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, f, g) AS r FROM gr)
SELECT community, string_agg(upper(g[1:1]) || lower(g[2:]), '+' ORDER BY r) AS name FROM rk WHERE r <= 2 GROUP BY community"""
)
def community_label(spark: SparkSession, sf: str) -> DataFrame:
    members = components.communities(bought_together(spark, sf), 3)
    nodes = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("group"), F.col("p_partkey").alias("ord"))
    return components.community_names(members, nodes)


_SPANS_SQL = """sp AS (SELECT 'o' || o_orderkey AS span, o_custkey % 150 AS key, floor(epoch(o_orderdate))::BIGINT AS start, floor(epoch(o_orderdate))::BIGINT + 86400 * (1 + o_orderkey % 90) AS stop, o_orderkey AS ord FROM orders),
pt AS (SELECT event_id AS point, user_id % 150 AS key, floor(epoch(ts))::BIGINT - floor(epoch(date_trunc('year', ts)))::BIGINT + floor(epoch(TIMESTAMP '1996-01-01'))::BIGINT AS pos FROM events)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("span"), (F.col("o_custkey") % 150).alias("key"), s.alias("start"), (s + 86400 * (1 + F.col("o_orderkey") % 90)).alias("stop"), F.col("o_orderkey").alias("ord"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    pos = F.unix_seconds(t) - F.unix_seconds(F.date_trunc("year", t)) + F.unix_seconds(F.lit("1996-01-01").cast("timestamp"))
    return table(spark, sf, "events").select(F.col("event_id").alias("point"), (F.col("user_id") % 150).alias("key"), pos.alias("pos"))


@query(
    f"""WITH {_SPANS_SQL}, hit AS (SELECT point, span, row_number() OVER (PARTITION BY point ORDER BY start DESC, ord DESC) AS r FROM pt JOIN sp ON pt.key = sp.key AND pos BETWEEN start AND stop)
SELECT pt.point, span FROM pt LEFT JOIN hit ON pt.point = hit.point AND r = 1"""
)
def containment_innermost(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.innermost(_points(spark, sf), _spans(spark, sf), bucket=86400 * 30)


@query(f"WITH {_SPANS_SQL}, ot AS (SELECT * FROM sp WHERE ord % 10 = 0) SELECT span, start, stop FROM sp WHERE ord % 10 <> 0 AND EXISTS (SELECT 1 FROM ot WHERE ot.key = sp.key AND sp.start <= ot.stop AND sp.stop >= ot.start)")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf)
    return intervals.overlapping(s.where("ord % 10 <> 0"), s.where("ord % 10 = 0").select("key", "start", "stop")).select("span", "start", "stop")


@query(
    f"""WITH {_SPANS_SQL}, hit AS (SELECT point, span, start - pos AS gap, row_number() OVER (PARTITION BY point ORDER BY start, span) AS r FROM pt JOIN sp ON pt.key = sp.key AND start >= pos AND start <= pos + 864000)
SELECT pt.point, span AS mark, gap FROM pt LEFT JOIN hit ON pt.point = hit.point AND r = 1"""
)
def forward_asof_bounded(spark: SparkSession, sf: str) -> DataFrame:
    marks = _spans(spark, sf).select(F.col("span").alias("mark"), "key", F.col("start").alias("pos"))
    return intervals.next_within(_points(spark, sf), marks, 864000)


_FILL_SQL = """SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events"""


@query(_FILL_SQL)
def forward_fill_headers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type")).first()[0]
    rows = e.select("event_id", F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("pos"), F.when(F.col("event_type") == first, F.col("event_id")).alias("header"))
    return intervals.filled_forward(rows, "header").select("event_id", "header")


_ROUTES_SQL = """rt AS (SELECT DISTINCT regexp_extract(url, '://[^/]*(/[a-z]*)', 1) || '/{id}' AS url FROM pages WHERE page_id % 2 = 0),
rr AS (SELECT url AS route, regexp_replace(url, '/+$', '') AS ru, regexp_replace(regexp_replace(url, '/+$', ''), '\\{[^}]+\\}', '{param}', 'g') AS rn FROM rt),
cc AS (SELECT page_id AS call, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[0-9]+(\\.html)?/*$', '/{n}') AS url FROM pages),
ca AS (SELECT call, regexp_replace(CASE WHEN strpos(b, '://') = 0 THEN b WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '/' END, '\\{[^}]*\\}', '{param}', 'g') AS cu FROM (SELECT call, regexp_replace(url, '/+$', '') AS b, split_part(regexp_replace(url, '/+$', ''), '://', 2) AS r FROM cc))"""


@query(
    f"""WITH {_ROUTES_SQL} SELECT route, call, (CASE WHEN ru = cu THEN 1.0 WHEN rn = cu THEN 1.0 ELSE 0.6 END)::DOUBLE AS confidence FROM rr, ca WHERE starts_with(cu, rn) OR starts_with(rn, cu)"""
)
def url_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    routes = p.where("page_id % 2 = 0").select(F.concat(F.regexp_extract("url", "://[^/]*(/[a-z]*)", 1), F.lit("/{id}")).alias("url")).distinct().withColumns({"route": F.col("url"), "method": F.lit("get")})
    calls = p.select(F.col("page_id").alias("call"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"/[0-9]+(\.html)?/*$", "/{n}").alias("url"), F.lit("get").alias("method"))
    return urls.links(routes, calls).withColumn("confidence", F.round("confidence", 6))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '\\{[^}]+\\}', '{param}', 'g'), ':([a-zA-Z_][a-zA-Z0-9_]*)', '{param}', 'g'), '<[^>]+>', '{param}', 'g') AS url FROM pages")
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalised(F.col("url")).alias("url"))


@query(
    f"""WITH {PATHS_SQL}, ex AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS folder, CASE WHEN k > 1 THEN array_to_string(p[1:k-1], '/') END AS parent FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS k FROM pp))
SELECT folder, parent FROM ex"""
)
def path_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return structure.folders(page_paths(spark, sf))


@query(
    f"""WITH {PATHS_SQL}, fo AS (SELECT DISTINCT regexp_extract(path, '([a-z]+/[0-9]+)', 1) AS folder FROM pp WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '/([0-9]+)$', 1) FROM pp WHERE page_id % 3 = 1),
tl AS (SELECT page_id AS ref, n, array_to_string(p[k:], '/') AS folder FROM (SELECT page_id, string_split(path, '/') AS p, len(string_split(path, '/')) - k + 1 AS n, k FROM pp, range(1, 9) t(k) WHERE k <= len(string_split(path, '/'))))
SELECT ref, folder FROM (SELECT ref, tl.folder, row_number() OVER (PARTITION BY ref ORDER BY n DESC) AS r FROM tl JOIN fo ON tl.folder = fo.folder) WHERE r = 1"""
)
def longest_suffix_match(spark: SparkSession, sf: str) -> DataFrame:
    p = page_paths(spark, sf)
    a = p.where("page_id % 3 = 0").select(F.regexp_extract("path", "([a-z]+/[0-9]+)", 1).alias("folder"))
    b = p.where("page_id % 3 = 1").select(F.regexp_extract("path", "/([0-9]+)$", 1).alias("folder"))
    return resolve.longest_suffix(p.select(F.col("page_id").alias("ref"), "path"), a.union(b))


_REFS_SQL = f"""{PATHS_SQL}, al AS (SELECT page_id, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.html$', '') AS name FROM pp),
de AS (SELECT name, page_id AS target, path, page_id AS ord FROM al WHERE page_id % 2 = 0), rf AS (SELECT page_id AS ref, name, path FROM al WHERE page_id % 2 = 1)"""
_NEAREST_SQL = """few AS (SELECT name FROM de GROUP BY name HAVING count(*) <= 5),
sc AS (SELECT ref, target, ord, de.path AS dp, (SELECT count(*) FROM range(1, 10) t(k) WHERE k < len(string_split(rf.path, '/')) AND k < len(string_split(de.path, '/')) AND string_split(rf.path, '/')[1:k] = string_split(de.path, '/')[1:k]) AS shared FROM rf JOIN de ON rf.name = de.name WHERE de.name IN (SELECT name FROM few)),
nr AS (SELECT ref, target FROM (SELECT ref, target, row_number() OVER (PARTITION BY ref ORDER BY shared DESC, length(dp), ord) AS r FROM sc) WHERE r = 1)"""


def _refs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = page_paths(spark, sf).withColumn("name", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.html$", ""))
    defs = p.where("page_id % 2 = 0").select("name", F.col("page_id").alias("target"), "path", F.col("page_id").alias("ord"))
    return p.where("page_id % 2 = 1").select(F.col("page_id").alias("ref"), "name", "path"), defs


@query(f"WITH {_REFS_SQL}, {_NEAREST_SQL} SELECT ref, target FROM nr")
def closest_prefix_pick(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.nearest(*_refs(spark, sf))


_IMPORTS_SQL = "im AS (SELECT DISTINCT a.path, b.path AS imported FROM al a JOIN al b ON (a.page_id * 7 + 3) % 250 = b.page_id OR a.page_id + 1 = b.page_id)"


@query(
    f"""WITH {_REFS_SQL}, {_NEAREST_SQL}, {_IMPORTS_SQL}, t1 AS (SELECT ref, min_by(target, ord) AS target FROM rf JOIN de ON rf.name = de.name AND rf.path = de.path GROUP BY ref),
t2 AS (SELECT ref, min_by(target, ord) AS target FROM rf JOIN im ON rf.path = im.path JOIN de ON de.path = im.imported AND de.name = rf.name GROUP BY ref),
al3 AS (SELECT ref, target, 1 AS tier FROM t1 UNION ALL SELECT ref, target, 2 FROM t2 UNION ALL SELECT ref, target, 3 FROM nr)
SELECT ref, target, (CASE WHEN tier <= 2 THEN 1.0 ELSE 0.5 END)::DOUBLE AS confidence, tier FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY tier) AS r FROM al3) WHERE r = 1"""
)
def tiered_resolution(spark: SparkSession, sf: str) -> DataFrame:
    refs, defs = _refs(spark, sf)
    p = page_paths(spark, sf)
    b = p.select(F.col("page_id").alias("bid"), F.col("path").alias("imported"))
    a = p.select("path", F.explode(F.array((F.col("page_id") * 7 + 3) % 250, F.col("page_id") + 1)).alias("bid"))
    imports = a.join(b, "bid").select("path", "imported").distinct().withColumn("symbols", F.array().cast("array<string>"))
    return resolve.tiered(refs, defs, imports)


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as methods of their brand's class, exported if small, and brands as classes that nothing uses; what ``deadcode`` reads."""
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    rest = lambda exported: [F.lit("m.go").alias("file_path"), F.lit("go").alias("language"), F.lit("").alias("content"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), F.lit(False).alias("is_entry_point"), exported.alias("is_exported"), none.alias("decorators"), none.alias("bases"), F.lit(False).alias("is_protocol")]
    parts = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("method").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), *rest(F.col("p_size") <= 2))
    brands = p.select("p_brand").distinct().select(F.concat(F.lit("class:"), "p_brand").alias("id"), F.lit("class").alias("label"), F.col("p_brand").alias("name"), F.lit("").alias("class_name"), *rest(F.lit(False)))
    return parts.union(brands)


def _symbol_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders call their parts; a brand extends the brand whose name follows it by one."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_orderkey")
    line = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    calls = line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("rel_type"))
    b = table(spark, sf, "part").select("p_brand").distinct()
    up = b.select(F.col("p_brand").alias("a")).join(b, F.substring("a", 7, 1) == F.substring("p_brand", 7, 1)).where("a < p_brand")
    return calls.union(up.select(F.concat(F.lit("class:"), "a"), F.concat(F.lit("class:"), "p_brand"), F.lit("extends")))


_DEAD_SQL = """ca AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
sd AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_size > 2 AND p_partkey NOT IN (SELECT p FROM ca))"""


@query(f"WITH {_DEAD_SQL} SELECT 'part:' || p_partkey AS id FROM sd UNION ALL SELECT DISTINCT 'class:' || p_brand FROM part")
def dead_nodes_seed(spark: SparkSession, sf: str) -> DataFrame:
    return deadcode.seed(_symbols(spark, sf), _symbol_edges(spark, sf))


_OVERRIDES_SQL = f"""{_DEAD_SQL}, al AS (SELECT p_brand, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM sd)),
br AS (SELECT DISTINCT p_brand AS b FROM part), up AS (SELECT x.b AS c, y.b AS p FROM br x JOIN br y ON substr(x.b, 7, 1) = substr(y.b, 7, 1) AND x.b < y.b),
ov AS (SELECT 'part:' || p_partkey AS id FROM sd WHERE EXISTS (SELECT 1 FROM up JOIN al ON al.p_brand = up.p AND al.p_name = sd.p_name WHERE up.c = sd.p_brand))"""


@query(f"WITH {_OVERRIDES_SQL} SELECT id FROM ov")
def dead_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Dead methods that override a living one."""
    nodes, edges = _symbols(spark, sf), _symbol_edges(spark, sf)
    marks = deadcode.seed(nodes, edges).withColumn("dead", F.lit(True))
    return deadcode.overrides(nodes.join(marks, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False))), edges).distinct()


@query(f"WITH {_OVERRIDES_SQL} SELECT 'part:' || p_partkey AS id FROM sd WHERE 'part:' || p_partkey NOT IN (SELECT id FROM ov) UNION ALL SELECT DISTINCT 'class:' || p_brand FROM part")
def dead_nodes_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """What all passes leave of the seed."""
    return deadcode.dead(_symbols(spark, sf), _symbol_edges(spark, sf))


@query(f"WITH {_DEAD_SQL}, k AS (SELECT p_partkey, p_brand FROM part WHERE p_size < 10) SELECT 'part:' || p_partkey AS id, p_partkey NOT IN (SELECT p FROM ca) AND p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 2) AS is_dead FROM k")
def dead_recount(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return deadcode.recount(_symbols(spark, sf), _symbol_edges(spark, sf), keys)


@query(
    """WITH need AS (SELECT DISTINCT c_mktsegment AS s FROM customer), have AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_acctbal > 9000)
SELECT 'method:' || n || ':' || s AS id FROM have WHERE n IN (SELECT n FROM have GROUP BY n HAVING count(*) = (SELECT count(*) FROM need))"""
)
def superset_division(spark: SparkSession, sf: str) -> DataFrame:
    """Methods of the classes (nations with rich customers) that have all methods of a protocol (the segments)."""
    c = table(spark, sf, "customer")
    row = lambda rows, label, cls, name, protocol: rows.select(F.concat_ws(":", F.lit(label), cls, name).alias("id"), F.lit(label).alias("label"), name.alias("name"), cls.alias("class_name"), F.lit(protocol).alias("is_protocol"), F.lit(True).alias("dead"))
    have = c.where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment").distinct()
    n = row(have, "method", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), False)
    n = n.union(row(c.select("c_mktsegment").distinct(), "method", F.lit("Segments"), F.col("c_mktsegment"), False)).union(row(spark.range(1), "class", F.lit(""), F.lit("Segments"), True))
    return deadcode.conforming(n, n.limit(0)).where("id NOT LIKE 'method:Segments:%'")


@query(
    """WITH ca AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT 'part:' || p_partkey AS id FROM part WHERE p_size <= 2 AND p_partkey NOT IN (SELECT p FROM ca)"""
)
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    """Exported methods that nothing calls."""
    return deadcode.entry_points(_symbols(spark, sf), _symbol_edges(spark, sf))


@query(f"WITH {NEXT_SQL} SELECT src, dst, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS r FROM nx) WHERE r <= 3")
def topk_out_edges(spark: SparkSession, sf: str) -> DataFrame:
    return flows.surest(next_edges(spark, sf), 3).select("src", "dst", "confidence")


_SNAP_SQL = """b AS (SELECT l_partkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1), w AS (SELECT l_partkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-15' AND l_shipdate < TIMESTAMP '1996-04-15' GROUP BY 1)"""


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf, "lineitem")
    of = lambda rows: rows.groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    shipped = lambda a, b: of(line.where((F.col("l_shipdate") >= _ntz(a)) & (F.col("l_shipdate") < _ntz(b))))
    return shipped("1996-01-01", "1996-04-01"), shipped("1996-01-15", "1996-04-15")


@query(
    f"""WITH {_SNAP_SQL} SELECT coalesce(b.k, w.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL JOIN w ON b.k = w.k WHERE b.k IS NULL OR w.k IS NULL OR b.q <> w.q OR b.n <> w.n"""
)
def structural_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.diff(*_snapshots(spark, sf), "k", ["q", "n"])


_MANIFESTS_SQL = """m1 AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 1), m2 AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 10 <> 2),
md AS (SELECT coalesce(m1.path, m2.path) AS path, CASE WHEN m1.path IS NULL THEN 'added' WHEN m2.path IS NULL THEN 'deleted' WHEN m1.sha <> m2.sha THEN 'changed' ELSE 'unchanged' END AS state FROM m1 FULL JOIN m2 ON m1.path = m2.path)"""


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return changes.manifest(d.where("doc_id % 10 <> 1"), "path", F.col("text")), changes.manifest(d.where("doc_id % 10 <> 2"), "path", edited)


@query(f"WITH {_MANIFESTS_SQL} SELECT path, state FROM md")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.manifest_diff(*_manifests(spark, sf))


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents")
def content_sha(spark: SparkSession, sf: str) -> DataFrame:
    return changes.manifest(table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string")), "path", F.col("text"))


@query(
    """WITH f AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents), g AS (SELECT sha256(path)[1:2] AS g, sha256(string_agg(path || chr(0) || sha || chr(0), '' ORDER BY path || chr(0) || sha || chr(0))) AS h FROM f GROUP BY 1)
SELECT sha256(string_agg(g || h, '' ORDER BY g)) AS fingerprint FROM g"""
)
def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return changes.fingerprint(content_sha(spark, sf))


_SYMBOLS_SQL = """s1 AS (SELECT p_brand AS path, p_partkey AS symbol, sha256(concat_ws(chr(0), p_name, p_type)) AS identity, sha256(p_retailprice::DECIMAL(12,2)::VARCHAR) AS body FROM part WHERE p_partkey % 11 <> 0),
s2 AS (SELECT p_brand AS path, p_partkey AS symbol, sha256(concat_ws(chr(0), CASE WHEN p_size = 1 THEN p_name || 'x' ELSE p_name END, p_type)) AS identity, sha256((CASE WHEN p_size < 5 THEN p_retailprice + 1 ELSE p_retailprice END)::DECIMAL(12,2)::VARCHAR) AS body FROM part WHERE p_partkey % 13 <> 0)"""


@query(
    f"""WITH {_SYMBOLS_SQL} SELECT * FROM (SELECT coalesce(s1.path, s2.path) AS path, coalesce(s1.symbol, s2.symbol) AS symbol, CASE WHEN s1.symbol IS NULL THEN 'added' WHEN s2.symbol IS NULL THEN 'removed' WHEN s1.identity <> s2.identity THEN 'identity_changed' WHEN s1.body <> s2.body THEN 'body_only' END AS state
FROM s1 FULL JOIN s2 ON s1.path = s2.path AND s1.symbol = s2.symbol) WHERE state IS NOT NULL"""
)
def identity_vs_body_change(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    price = lambda c: F.sha2(c.cast("decimal(12,2)").cast("string"), 256)
    a = p.where("p_partkey % 11 <> 0").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("symbol"), changes.identity(F.col("p_name"), F.col("p_type")).alias("identity"), price(F.col("p_retailprice")).alias("body"))
    name = F.when(F.col("p_size") == 1, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    cost = F.when(F.col("p_size") < 5, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    b = p.where("p_partkey % 13 <> 0").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("symbol"), changes.identity(name, F.col("p_type")).alias("identity"), price(cost).alias("body"))
    return changes.symbol_diff(a, b)


@query(
    f"""WITH {_MANIFESTS_SQL}, ed AS (SELECT doc_id::VARCHAR AS src_path, ((doc_id * 13 + 5) % 1000)::VARCHAR AS dst_path FROM documents), ch AS (SELECT path FROM md WHERE state IN ('changed', 'deleted'))
SELECT DISTINCT src_path AS path FROM ed WHERE dst_path IN (SELECT path FROM ch) AND src_path NOT IN (SELECT path FROM ch)"""
)
def dependents_depth1(spark: SparkSession, sf: str) -> DataFrame:
    changed = manifest_diff(spark, sf).where("state IN ('changed', 'deleted')").select("path")
    edges = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("src_path"), ((F.col("doc_id") * 13 + 5) % 1000).cast("string").alias("dst_path"))
    return changes.dependants(changed, edges)


@query(
    f"""WITH {_MANIFESTS_SQL}, r AS (SELECT count(*) FILTER (state <> 'unchanged') / count(*) AS ratio, count(*) FILTER (state = 'changed') / count(*) AS bodies FROM md)
SELECT round(ratio, 6) AS ratio, CASE WHEN ratio > 0.3 THEN 'file_ratio' WHEN bodies > 0.4 THEN 'symbol_ratio' ELSE 'incremental' END AS verdict FROM r"""
)
def change_ratio_verdict(spark: SparkSession, sf: str) -> DataFrame:
    r = manifest_diff(spark, sf).agg((F.count_if(F.col("state") != "unchanged") / F.count(F.lit(1))).alias("ratio"), (F.count_if(F.col("state") == "changed") / F.count(F.lit(1))).alias("bodies"))
    yes = F.lit(True)
    return r.select(F.round("ratio", 6).alias("ratio"), changes.verdict(yes, yes, yes, F.col("ratio"), F.col("bodies")).alias("verdict"))


@query(
    """WITH n AS (SELECT 'part:' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS name FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 = 0
UNION ALL SELECT 'part:new' || p_partkey, p_name FROM part WHERE p_partkey % 50 = 0) SELECT id, name FROM n"""
)
def delta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    part_id = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    nodes = p.select(part_id.alias("id"), F.col("p_name").alias("name"))
    edges = p.select(part_id.alias("src"), part_id.alias("dst"), F.lit("self").alias("rel_type"))
    changed = p.where("p_partkey % 5 = 0").select(part_id.alias("id"), F.concat("p_name", F.lit("!")).alias("name"))
    fresh = p.where("p_partkey % 50 = 0").select(F.concat(F.lit("part:new"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    gone = p.where("p_partkey % 7 = 0").select(part_id.alias("id"))
    return changes.apply_delta(nodes, edges, edges.limit(0), gone, changed.union(fresh), edges.limit(0))[0]


_DELTA_SQL = """e0 AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'contains' AS rel_type FROM lineitem),
gone AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 40 UNION ALL SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'P'),
out AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R')"""


@query(
    f"""WITH {_DELTA_SQL}, a AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'order:' || l_orderkey AS dst, 'in' AS rel_type FROM lineitem WHERE l_returnflag = 'R')
SELECT src, dst, rel_type FROM e0 WHERE NOT EXISTS (SELECT 1 FROM out WHERE out.src = e0.src AND out.dst = e0.dst) AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
UNION ALL SELECT * FROM a WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"""
)
def delta_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A delta's edges: some go by name, some with their nodes, some come, and those without both ends don't."""
    line = table(spark, sf, "lineitem")
    order, part = (F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("order", "l_orderkey"), ("part", "l_partkey")))
    edges = line.select(order.alias("src"), part.alias("dst"), F.lit("contains").alias("rel_type")).distinct()
    back = line.where("l_returnflag = 'R'").select(part.alias("src"), order.alias("dst"), F.lit("in").alias("rel_type")).distinct()
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus")
    gone = p.where("p_size > 40").select("id").union(o.where("o_orderstatus = 'P'").select("id"))
    named = line.where("l_returnflag = 'R'").select(order.alias("src"), part.alias("dst"), F.lit("contains").alias("rel_type")).distinct()
    nodes = p.select("id").union(o.select("id"))
    return changes.apply_delta(nodes, edges, named, gone, nodes.limit(0), back)[1]


@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '') || '.py' AS path FROM pages WHERE url IS NOT NULL),
b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/(__init__|index)$', ''), '/') AS ps FROM p),
t AS (SELECT page_id, unnest(list_transform(range(1, len(ps) + 1), lambda k: ps[k:len(ps)])) AS t FROM (SELECT page_id, ps, len(ps) AS n FROM b))
SELECT DISTINCT page_id, name FROM (SELECT page_id, array_to_string(t, '/') AS name FROM t UNION ALL SELECT page_id, array_to_string(t, '.') FROM t)"""
)
def importable_names(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/$", "")
    p = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.concat(bare, F.lit(".py")).alias("path"))
    return p.select("page_id", F.explode(incremental.importable_names(F.col("path"))).alias("name"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_debounce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    s = debounce.quiet_sessions(e, "6 hours")
    return s.select(F.col("key").alias("user_id"), F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"), "n")


@query(
    """WITH old AS (SELECT vec_id AS id, sha256('fast:' || label::VARCHAR) AS sha FROM embeddings WHERE vec_id % 4 <> 0), new AS (SELECT vec_id AS id, sha256('fast:' || (CASE WHEN vec_id % 9 = 0 THEN label + 1 ELSE label END)::VARCHAR) AS sha FROM embeddings)
SELECT new.id, old.id IS NOT NULL AS reused FROM new LEFT JOIN old ON new.id = old.id AND new.sha = old.sha"""
)
def embedding_reuse_partition(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    sha = F.sha2(F.concat(F.lit("fast:"), F.col("label").cast("string")), 256)
    held = e.where("id % 4 <> 0").select("id", "vec", sha.alias("sha"))
    wanted = e.select("id", F.when(F.col("id") % 9 == 0, F.col("label") + 1).otherwise(F.col("label")).cast("string").alias("text"))
    kept, todo = embedding.stale(wanted, held, "fast")
    return kept.select("id", F.lit(True).alias("reused")).union(todo.select("id", F.lit(False)))


@query(
    """WITH o AS (SELECT o_custkey AS c, count(*) FILTER (o_orderpriority = '1-URGENT') AS e, count(*) AS d, count(*) FILTER (o_orderstatus = 'F') % 3 AS m FROM orders GROUP BY 1),
s AS (SELECT c, n_regionkey, least(e + m + d // 10 + CASE WHEN n_regionkey > 1 THEN 2 ELSE 0 END, 10)::BIGINT AS score FROM o JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT c AS customer, score, CASE WHEN score <= 3 THEN 'LOW' WHEN score <= 6 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s"""
)
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("e"), F.count(F.lit(1)).alias("d"), (F.count_if(F.col("o_orderstatus") == "F") % 3).alias("m"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), "n_regionkey")
    score, level = lookup.risk(F.col("e"), F.col("m"), F.col("d"), F.col("n_regionkey"))
    return o.join(c, "customer").select("customer", score.alias("score"), level.alias("level"))


@query(
    """WITH q AS (SELECT list_distinct(list_filter(string_split_regex(lower((SELECT text FROM conversations ORDER BY conv_id, turn LIMIT 1)), '[^a-z0-9]+'), lambda x: x <> '')) AS q),
t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS score FROM t, q WHERE len(list_intersect(q, t)) > 0"""
)
def word_overlap_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = c.orderBy("conv_id", "turn").first()["text"]
    s = c.select("conv_id", "turn", search.overlap(F.lit(q), F.col("text")).alias("score"))
    return s.where("score > 0").withColumn("score", F.round("score", 6))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS owner, p_brand AS community FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT owner, count(*) AS k FROM m GROUP BY 1)
SELECT owner, k AS n_communities FROM c WHERE k > 1"""
)
def cross_community_flows(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("owner"))
    return lookup.spanning(members, table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community")))


@query(
    """SELECT 'process:' || l_orderkey || ':' AS id, count(DISTINCT l_partkey) AS step_count, CASE WHEN count(DISTINCT p_brand) FILTER (p_size > 25) = 0 THEN 'unknown' WHEN count(DISTINCT p_brand) FILTER (p_size > 25) = 1 THEN 'intra_community' ELSE 'cross_community' END AS kind
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(*) > 1"""
)
def flow_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as flows over their parts, large parts' brands as communities."""
    p, part = table(spark, sf, "part"), lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    traced = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("entry")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", part("l_partkey").alias("id")))).alias("s"))
    traced = traced.select("entry", F.transform("s", lambda x: x["id"]).alias("steps"))
    nodes = p.select(part("p_partkey").alias("id"), F.col("p_name").alias("name"))
    members = p.where("p_size > 25").select(part("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return flows.processes(traced, nodes, members)[0].select("id", "step_count", "kind")


@query("SELECT l_partkey AS node, min(l_orderkey) AS owner FROM lineitem GROUP BY 1")
def process_membership(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), F.lit("step_in_process").alias("rel_type"))
    return lookup.memberships(e)


@query("SELECT src, dst, rel_type, arg_max(confidence, k) AS confidence FROM (SELECT l_orderkey AS src, l_partkey AS dst, 'contains' AS rel_type, l_discount AS confidence, l_shipdate::VARCHAR || lpad(l_linenumber::VARCHAR, 4, '0') || lpad((l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') || lpad((l_quantity * 100)::BIGINT::VARCHAR, 8, '0') AS k FROM lineitem) GROUP BY 1, 2, 3")
def edges_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    k = F.struct("l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("contains").alias("rel_type"), F.col("l_discount").alias("confidence"), k.alias("k"))
    return changes.last_wins(rows, ["src", "dst", "rel_type"], "k").drop("k")


def _router_sql() -> str:
    from plexgraph.functions.questions import ROUTES

    cases = " ".join(f"WHEN regexp_matches(q, '(?i){p}') THEN '{name}'" for name, p in ROUTES)
    return f"SELECT conv_id, turn, CASE {cases} ELSE 'query' END AS route FROM (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 5 WHEN 0 THEN ' what breaks if it goes' WHEN 1 THEN ' who calls it' WHEN 2 THEN ' is it dead code' WHEN 3 THEN '' ELSE ' explain the cycle' END AS q FROM conversations)"


@query(_router_sql())
def question_router(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.functions.questions import route

    ends = F.when(F.col("turn") % 5 == 0, " what breaks if it goes").when(F.col("turn") % 5 == 1, " who calls it").when(F.col("turn") % 5 == 2, " is it dead code").when(F.col("turn") % 5 == 3, "").otherwise(" explain the cycle")
    return table(spark, sf, "conversations").select("conv_id", "turn", route(F.concat(F.coalesce("text", F.lit("")), ends)).alias("route"))


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN contains('/' || p_brand || '/' || p_type, '/tests/') THEN 1.0 ELSE 2.0 END::DOUBLE AS score FROM part WHERE p_name = (SELECT max(p_name) FROM part) ORDER BY 'part:' || p_partkey LIMIT 1")
def resolve_symbol(spark: SparkSession, sf: str) -> DataFrame:
    name = table(spark, sf, "part").agg(F.max("p_name")).first()[0]
    nodes = part_nodes(spark, sf)
    ranked = search.fuzzy(nodes, name, 5).select("id", "score")
    return lookup.resolve(nodes, name, ranked).join(nodes, "id").select("id", F.lit(2.0).alias("score"))


_HUNK_SQL = """h AS (SELECT doc_id, 'f' || (doc_id % 7) AS file, 1 + doc_id % 50 AS s, doc_id % 9 AS c FROM documents)"""


@query(f"WITH {_HUNK_SQL} SELECT file, s AS start, s + greatest(c, 1) - 1 AS stop FROM h")
def diff_hunks(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.sources.files import hunks

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("f"), (1 + F.col("doc_id") % 50).cast("string").alias("s"), (F.col("doc_id") % 9).cast("string").alias("c"))
    text = F.concat(F.lit("diff --git a/"), "f", F.lit(" b/"), "f", F.lit("\n--- a/x\n+++ b/x\n@@ -1,2 +"), "s", F.lit(","), "c", F.lit(" @@\n+x\n"))
    return hunks(d.select("id", text.alias("diff")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'write' WHEN doc_id % 4 = 1 THEN 'first_clause' WHEN doc_id % 4 = 2 THEN 'procedure' END AS refusal FROM documents")
def read_only_guard(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.functions.questions import refused

    k = F.col("doc_id") % 4
    q = F.when(k == 0, "MATCH (n) SET n.x = 1").when(k == 1, "DROP TABLE x").when(k == 2, "CALL wipe()").otherwise("MATCH (n) WHERE n.t = 'drop it' RETURN n // set")
    return table(spark, sf, "documents").select("doc_id", refused(q).alias("refusal"))


@query(
    """SELECT page_id, CASE WHEN name = 'Rakefile' THEN 'ruby' WHEN ext IN ('py') THEN 'python' WHEN ext = 'tsx' THEN 'tsx' WHEN ext = 'go' THEN 'go' END AS language, ign AS ignored FROM (
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.py' WHEN 1 THEN 'Rakefile' WHEN 2 THEN 'b.tsx' WHEN 3 THEN 'c.go' ELSE 'd.txt' END AS name, CASE page_id % 5 WHEN 0 THEN 'py' WHEN 2 THEN 'tsx' WHEN 3 THEN 'go' ELSE '' END AS ext, page_id % 3 = 0 AS ign FROM pages)"""
)
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.sources.files import is_ignored, language

    k = F.col("page_id") % 5
    name = F.when(k == 0, "a.py").when(k == 1, "Rakefile").when(k == 2, "b.tsx").when(k == 3, "c.go").otherwise("d.txt")
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "x/node_modules/").otherwise("x/src/"), name)
    return table(spark, sf, "pages").select("page_id", language(path).alias("language"), is_ignored(path).alias("ignored"))


_TESTS = ["tests/a.py", "src/latest.py", "web/x.spec.ts", "go/b_test.go", "lib/contest/a.rb"]


@query("SELECT page_id, page_id % 5 IN (0, 2, 3) AS is_test FROM pages")
def is_test_path(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.functions.predicates import is_test_file

    path = F.element_at(F.array(*[F.lit(t) for t in _TESTS]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", is_test_file(path).alias("is_test"))


_FLOWS_SQL = f"""WITH {NEXT_SQL}, roots AS (SELECT DISTINCT src FROM nx WHERE src NOT IN (SELECT dst FROM nx)), b AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS r FROM nx)
SELECT roots.src AS entry, b.dst AS first_step FROM roots JOIN b ON b.src = roots.src AND b.r = 1"""


@query(_FLOWS_SQL)
def flow_first_steps(spark: SparkSession, sf: str) -> DataFrame:
    from plexgraph.operators.flows import trace

    e = next_edges(spark, sf)
    entries = e.select(F.col("src").alias("entry")).distinct().join(e.select(F.col("dst").alias("entry")).distinct(), "entry", "left_anti")
    return trace(e.select("src", "dst", "confidence"), entries, depth=1).select("entry", F.get("steps", F.lit(1)).alias("first_step"))


@query()
def execution_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Traces from parts that follow none, without near copies; order-dependent budgets have no SQL form."""
    from plexgraph.operators.flows import distinct_flows, trace

    e = next_edges(spark, sf)
    entries = e.select(F.col("src").alias("entry")).distinct().join(e.select(F.col("dst").alias("entry")).distinct(), "entry", "left_anti")
    kept = distinct_flows(trace(e.select("src", "dst", "confidence"), entries).withColumn("ord", F.col("entry")))
    return kept.select("entry", F.array_join("steps", " ").alias("steps"))


@query()
def node_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of part names by the hashing encoder."""
    from plexgraph.operators.embedding import embed

    rows = part_nodes(spark, sf).select("id", F.concat_ws(" ", "label", "name").alias("text"))
    return embed(rows).select("id", F.size("vec").alias("width"), "sha")
