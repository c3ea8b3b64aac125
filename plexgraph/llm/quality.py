"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one measure of a text with a cutoff from a ladder; all rules step down their ladders together. A step may
be used in a stratum (a language) only if the labelled good documents there show, by an exact binomial test, that its rules
together reject at most a share ``risk`` of the good ones. The steps are tested from the lenient end, up to the first that
fails: a fixed sequence, whose tests need no correction among themselves (stricter steps reject more, so none behind it
passes). The strata share the error ``delta`` by their numbers of trials, which don't depend on outcomes (weighted
Bonferroni). The last step that passes is used. So with probability 1 - delta the rules reject at most a share ``risk`` of the
good documents of every stratum that pass the base rule, which goes first and has no cutoff to choose. A stratum with too few
labels gets no cutoffs and rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import SPACE, free_name, row_hash, settled

RISK, DELTA = 0.02, 0.05
Get = Callable[[str], Column]


def _per(top: str, bottom: str, sign: int = 1) -> Callable[[Get], Column]:
    return lambda c: sign * c(top).cast("double") / F.greatest(c(bottom), F.lit(1))


#: rule -> (measure, ladder from strict to lenient). A text whose measure is above the cutoff goes.
RULES: dict[str, tuple[Callable[[Get], Column], tuple[float, ...]]] = {
    "symbols": (_per("n_symbols", "n_words"), (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "dup_lines": (_per("n_dup_lines", "n_lines"), (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeats": (_per("n_repeat_words", "n_words"), (0.02, 0.05, 0.1, 0.2, 0.3, 0.4)),
    "long_words": (_per("word_chars", "n_words"), (6.0, 7.0, 8.0, 10.0, 12.0, 16.0)),
    "short_words": (_per("word_chars", "n_words", -1), (-5.0, -4.5, -4.0, -3.5, -3.0, -2.0)),
}
STEPS = 6
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(text: Column) -> Column:
    return F.trim(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice; windows are compared by 64-bit hashes in one text.

    Texts without such windows end after one pass with a hash set; the others sort their windows.
    """

    def covered(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = _let(rows, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
        return _let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda t, x: t + x))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    words = _let(_bare(t), lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, " +")))
    in_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    in_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = F.length(F.translate(t, SPACE, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    return F.struct(in_words.alias("w"), in_lines.alias("l"), chars.alias("word_chars"), symbols.alias("n_symbols"))


_FLAT = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}


def base_failed(c: Get) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def _rejected(c: Get, cut: Get) -> Column:
    """Whether some rule's measure is above its cutoff; a missing cutoff rejects nothing."""
    return F.exists(F.array(*[F.coalesce(m(c) > cut(r), F.lit(False)) for r, (m, _) in RULES.items()]), lambda x: x)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, row, stratum, measures) of every row; row is its ``row_hash``, stratum "" for null and "=" before other values."""
    m = docs.select(docs[id_col].cast("long").alias("doc_id"), row_hash(docs).alias("row"), _stratum(docs[stratum_col]).alias("stratum"), measures(docs[text_col]).alias("m"))
    return m.select("doc_id", "row", "stratum", *[F.col(f"m.{at}").alias(name) for name, at in _FLAT.items()])


def _stratum(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _most_errors(n: Column, rate: float, delta: Column) -> Column:
    """The largest k with P(Bin(n, rate) <= k) <= delta; -1 if there is none. Terms are built as logarithms."""
    first = n * F.lit(math.log1p(-rate))
    odds = F.lit(math.log(rate / (1 - rate)))
    start = F.struct(first.alias("term"), F.exp(first).alias("cdf"), F.when(F.exp(first) <= delta, 0).otherwise(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        cdf = a["cdf"] + F.exp(term)
        return F.struct(term.alias("term"), cdf.alias("cdf"), F.when(cdf <= delta, i).otherwise(a["k"]).cast("long").alias("k"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(n * rate))), start, step, lambda a: a["k"])


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one double for each rule): the strictest step that is safe there, nulls if none is.

    A document is good if every label row of its id says 1; null labels are no labels. Repeated rows of a document are
    repeated trials of the same kind, so they count once. What the base rule rejects is no trial.
    """
    good = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(good_col).alias("q")).where("q = 1")
    trials = rows.where(~base_failed(F.col)).join(good, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rejects = [F.exists(F.array(*[m(F.col) > F.lit(ladder[j]) for m, ladder in RULES.values()]), lambda x: x) for j in range(STEPS)]
    seen = settled(trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(f"x_{j}") for j, x in enumerate(rejects)]))
    total = seen.agg(F.sum("n")).first()[0] or 1
    allowed = seen.withColumn("k", _most_errors(F.col("n"), risk, F.lit(delta) * F.col("n") / F.lit(total)))
    step = F.coalesce(*[F.when(F.col(f"x_{j}") <= F.col("k"), F.lit(j)) for j in range(STEPS)])
    cut = lambda ladder: F.get(F.array(*[F.lit(float(c)) for c in ladder]), F.col("step"))
    return allowed.withColumn("step", step).select("stratum", *[cut(ladder).alias(r) for r, (_, ladder) in RULES.items()])


#: Strata up to which the cutoffs are sent to every task; beyond, they are joined by shuffle.
SMALL = 10_000


def _with_cutoffs(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    cuts = settled(cuts)
    return rows.join(F.broadcast(cuts) if cuts.count() <= SMALL else cuts, "stratum", "left")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row (doc_id, row, measures, base_failed, kept) for each row of ``docs``; row is its ``row_hash``.

    Null and blank texts have no words and fail the base rule. A null stratum is a stratum of its own. Without labels,
    or with too few, the base rule alone decides. Empty tables give empty results; other columns are only hashed; repeated
    rows are judged alike.
    """
    rows = settled(measured(docs, id_col, text_col, stratum_col))
    out = _with_cutoffs(rows, cutoffs(rows, labels, id_col, good_col, risk, delta))
    failed = base_failed(F.col)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~_rejected(F.col, F.col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, whatever their names.

    Texts are measured once; the verdicts meet the rows again by id and ``row_hash``, near unique keys that spread evenly.
    """
    keep_id, keep_row, row = (free_name(docs, n) for n in ("keep_id", "keep_row", "row"))
    found = judge(docs, labels, id_col, text_col, stratum_col, good_col, risk, delta).where("kept")
    found = settled(found.select(F.col("doc_id").alias(keep_id), F.col("row").alias(keep_row)).distinct())
    keyed = docs.withColumn(row, row_hash(docs))
    here = keyed[id_col].cast("long").eqNullSafe(F.col(keep_id)) & (keyed[row] == F.col(keep_row))
    return keyed.join(found.hint("merge"), here, "left_semi").drop(row)
