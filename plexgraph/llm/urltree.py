"""URL filters: rules by host and path, then a path-template tree, in DataFrame functions only.

Each URL is a host and its path segments; numbers, hashes and slugs become ``*`` at once. From the host down, a segment keeps
its name only if its share of bad labels differs significantly, by a two-sample test, from that of all its siblings together;
the others are merged into ``*``. Branches with fewer than ``SUPPORT`` labels aren't split further, so the tree is as deep as
the labels allow, whatever the depth of paths. A node's purity is its share of bad labels, smoothed towards its parent's (a
host's towards the share of all), and a URL is rejected if the purity of the last node it reaches is ``BLOCK_AT`` or more.

No URL is judged by its own label: URLs are dealt to two folds by a hash of host and path, each fold has a tree of its own, and
that tree counts the labels of the other fold only. So a word in a URL doesn't decide; what else is known of its branch does.

Counts are made on distinct (host, segments), so a hot host costs what its distinct paths cost; its children and its rows meet
their sums by broadcast (``spread_join``), as at most ``OFTEN`` branches can be that hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import counted as counted_rows
from plexgraph.llm.common import settled, spread_join

SUPPORT, Z, STRENGTH, BLOCK_AT = 10, 2.576, 2.0, 0.5
FOLDS = 2
#: Words of a host or path that label a page as bad where there are no other labels: gambling, pills, adult content, spam,
#: malware and advertising.
SEEDS = (
    "casino", "casinos", "poker", "slots", "bet", "bets", "betting", "gambling", "jackpot",
    "pills", "viagra", "cialis",
    "adult", "porn", "xxx", "escort", "escorts", "sex",
    "spam", "phishing", "malware", "warez", "torrent", "crack", "cracks",
    "ads", "adserver", "doorway",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that are values rather than names.
VARIABLE = "^[0-9]+([.][a-z0-9]+)?$|^[0-9a-f]{8,}$|[0-9].*[0-9].*[0-9].*[0-9]|^.{25,}$|([-_].*){3}"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a verdict; it fits the host and its subdomains, and paths that begin with its path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def first_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits columns host and path; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def seeded(seeds: tuple[str, ...] = SEEDS) -> Column:
    """Whether columns host and path hold one of the words."""
    low = F.translate(F.concat("host", "path"), _UPPER, _LOWER)
    return F.rlike(low, F.lit(f"(^|[^a-z0-9])({'|'.join(seeds)})([^a-z0-9]|$)"))


def _segments(path: Column) -> Column:
    """The path's segments, values as ``*``, joined by ``/``."""
    names = F.filter(F.split(F.translate(path, _UPPER, _LOWER), "/"), lambda s: s != "")
    return F.array_join(F.transform(names, lambda s: F.when(F.rlike(s, F.lit(VARIABLE)), F.lit("*")).otherwise(s)), "/")


def fold_of(host: Column, path: Column) -> Column:
    return F.pmod(F.crc32(F.concat(host, path)), F.lit(FOLDS)).cast("int")


def _apart(cn: Column, cx: Column, pn: Column, px: Column, support: int, z: float) -> Column:
    """Whether a branch's share of bad labels differs from that of its siblings, by a two-sample test; a lone one stays too."""
    rn, share = pn - cn, px / F.greatest(pn, F.lit(1))
    error = F.sqrt(share * (1 - share) * (1 / F.greatest(cn, F.lit(1)) + 1 / F.greatest(rn, F.lit(1))))
    return (rn == 0) | (cn >= support) & (rn >= support) & (F.abs(cx / F.greatest(cn, F.lit(1)) - (px - cx) / F.greatest(rn, F.lit(1))) > z * error)


def templates(pages: DataFrame, support: int = SUPPORT, z: float = Z, strength: float = STRENGTH) -> DataFrame:
    """From (host, segs, fold, bad boolean or null): (tree, host, segs, template, purity, rows) for what each tree judges.

    Tree ``f`` judges fold ``f`` and counts the labels of the other folds. ``rows`` is the number of pages.
    """
    own = pages.groupBy("host", "segs", "fold").agg(F.count("bad").alias("n"), F.count_if("bad").alias("x"), F.count(F.lit(1)).alias("rows"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda t: F.struct(t.alias("tree"), (t == F.col("fold")).alias("mine")))
    each = settled(own).withColumn("t", F.explode(trees))
    counted = lambda c: F.sum(F.when(F.col("t.mine"), 0).otherwise(F.col(c))).alias(c)
    now = each.groupBy(F.col("t.tree").alias("tree"), "host", "segs").agg(counted("n"), counted("x"), F.sum(F.when(F.col("t.mine"), F.col("rows")).otherwise(0)).alias("rows"))
    now = settled(now.withColumn("path", F.when(F.col("segs") == "", F.array().cast("array<string>")).otherwise(F.split("segs", "/"))))
    priors = {r["tree"]: r["x"] / r["n"] for r in now.groupBy("tree").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect() if r["n"]}
    prior = F.lit(0.0)
    for tree, share in priors.items():
        prior = F.when(F.col("tree") == tree, F.lit(float(share))).otherwise(prior)
    # A node is a string of the tree, the host and the template so far.
    now, done, k = now.withColumn("node", F.concat_ws("/", F.col("tree").cast("string"), "host")).withColumn("above", prior), None, 0
    while True:
        sums = settled(now.groupBy("node").agg(F.sum("n").alias("pn"), F.sum("x").alias("px"), F.count(F.lit(1)).alias("m")))
        total = sums.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        now = spread_join(now, sums, "node", "m", total).withColumn("purity", (F.col("px") + strength * F.col("above")) / (F.col("pn") + strength))
        goes_on = (F.col("pn") >= support) & (F.size("path") > k)
        now, (rows, more) = counted_rows(now.withColumn("goes_on", goes_on), F.coalesce(F.count_if(goes_on), F.lit(0)))
        ended = now.where("NOT goes_on").select("tree", "host", "segs", F.expr("substr(node, instr(node, '/') + 1)").alias("template"), "purity", "rows")
        done = ended if done is None else done.union(ended)
        if not more:
            return done
        now = now.where("goes_on").drop("pn", "px", "goes_on").withColumn("seg", F.get("path", F.lit(k)))
        child = settled(now.groupBy("node", "seg").agg(F.sum("n").alias("cn"), F.sum("x").alias("cx"), F.count(F.lit(1)).alias("cm")))
        parent = settled(child.groupBy("node").agg(F.sum("cn").alias("pn"), F.sum("cx").alias("px"), F.count(F.lit(1)).alias("m")))
        count = parent.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        named = spread_join(child, parent, "node", "m", count)
        stays = (F.col("seg") == "*") | _apart(F.col("cn"), F.col("cx"), F.col("pn"), F.col("px"), support, z)
        branch = F.concat_ws("/", "node", "seg")
        named = settled(named.select(branch.alias("branch"), F.concat_ws("/", "node", F.when(stays, F.col("seg")).otherwise(F.lit("*"))).alias("next"), "cm"))
        now = spread_join(now.withColumn("branch", branch), named, "branch", "cm", more)
        now = now.select("tree", "host", "segs", "path", "n", "x", "rows", F.col("next").alias("node"), F.col("purity").alias("above"))
        k += 1


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, bad: Column | None = None, id_col: str = "page_id", url_col: str = "url", support: int = SUPPORT, z: float = Z, strength: float = STRENGTH, block_at: float = BLOCK_AT) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, template, purity) for each row of ``pages``.

    ``bad`` is the label, over columns host and path; null is no label. By default it tells whether a seed word occurs.
    The longest rule that fits decides, else the template's purity, to which the URL's own label didn't count. A null url, or
    one without ``://``, has an empty host and path. Without pages or labels nothing is blocked but by rules. Repeated rows
    count as rows; other columns are not read.
    """
    url = pages.select(F.col(id_col).cast("long").alias("page_id"), *[c.alias(n) for c, n in zip(host_and_path(F.col(url_col)), ("host", "path"))])
    rows = url.select("*", (seeded() if bad is None else bad).alias("bad"), _segments(F.col("path")).alias("segs"), fold_of(F.col("host"), F.col("path")).alias("fold"))
    key = F.to_json(F.struct(F.col("tree"), "host", "segs"))
    tree = settled(templates(rows.select("host", "segs", "fold", "bad"), support, z, strength).where("rows > 0").select(key.alias("key"), "template", "purity", "rows"))
    total = tree.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    text, verdict = first_rule(rules)
    own = F.when(F.col("purity") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    keyed = rows.withColumn("key", F.to_json(F.struct(F.col("fold").alias("tree"), "host", "segs")))
    out = spread_join(keyed, tree, "key", "rows", total)
    return out.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
