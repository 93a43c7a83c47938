"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each document becomes a vector of transformed statistics. For each (language, source) a minimum covariance determinant
estimate is made: starting from the documents nearest the medians, concentration steps take the mean and covariance of
the closest `share` of the documents, which never raises the determinant. Documents whose robust Mahalanobis distance
exceeds a chi-square quantile are rejected.

Nulls, empties, ties: a null text is an empty one and fails the base rule; a null language or source is a group value
of its own; groups with fewer than `min_rows` documents that pass the base rule support no estimate and reject nothing;
at a tie at the share's edge all tied documents count; constant statistics get a floor of variance; an empty table
gives an empty result; repeated rows get equal results. Other columns of the input are not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import SPACE, WORD, text_of
from floodlens.session import materialise

#: Fixed: the 0.99999 quantile of the chi-square distribution with 5 degrees of freedom.
CUT = 30.8562
SHARE, STEPS, MIN_ROWS, FLOOR = 0.75, 4, 50, 1e-3
STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")


def let(value: Column, body) -> Column:
    """`body` over a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: equal windows are found by sorting their hashes."""
    n = F.size(words)
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(found: Column) -> Column:
        last = F.size(found) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda sum_, i: sum_ + F.when(
            i == last, 3).otherwise(F.least(F.lit(3), F.get(found, i + 1) - F.get(found, i))))

    def doubled(ordered: Column) -> Column:
        places = F.filter(F.transform(ordered, lambda x, i: F.when(
            (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
        return let(F.array_sort(places), covered)

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, doubled))
    return let(hashes, counted)


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(WORD)) > 0)
    out = docs.select("doc_id", "lang", "source", F.struct(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines")).alias("t"))
    out = out.select("doc_id", "lang", "source", let(F.col("t"), lambda t: F.struct(
        F.size(t["words"]).cast("long").alias("n_words"), t["word_chars"].alias("word_chars"), t["n_symbols"].alias("n_symbols"),
        t["n_dup_lines"].alias("n_dup_lines"), _repeated(t["words"]).alias("n_repeat_words"))).alias("s")).select(
            "doc_id", "lang", "source", "s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    words, share = F.greatest("n_words", F.lit(1)), lambda c: F.sqrt(F.col(c) / F.greatest("n_words", F.lit(1)))
    return {"log_words": F.log1p("n_words"), "word_length": F.log1p(F.col("word_chars") / words),
            "symbols": share("n_symbols"), "dup_lines": share("n_dup_lines"), "repeats": share("n_repeat_words")}


def _distance(mean: str = "m", cov: str = "c", dims: tuple[str, ...] = STATISTICS) -> tuple[list[tuple[str, Column]], Column]:
    """Column steps of a Cholesky factor, and the squared distance by forward substitution."""
    p, steps = len(dims), []
    for j in range(p):
        for i in range(j, p):
            rest = reduce(lambda a, k: a - F.col(f"__l{i}_{k}") * F.col(f"__l{j}_{k}"), range(j), F.col(f"{cov}{j}_{i}"))
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR * FLOOR))) if i == j else rest / F.col(f"__l{j}_{j}")
            steps.append((f"__l{i}_{j}", value))
    for i, d in enumerate(dims):
        rest = reduce(lambda a, k: a - F.col(f"__l{i}_{k}") * F.col(f"__z{k}"), range(i), F.col(d) - F.col(f"{mean}{i}"))
        steps.append((f"__z{i}", rest / F.col(f"__l{i}_{i}")))
    return steps, reduce(lambda a, b: a + b, [F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(p)])


def _join_groups(rows: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
    groups = groups.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), how).drop("__lang", "__source")


def _factored(groups: DataFrame) -> DataFrame:
    """Groups with the Cholesky factor of their covariance. It is written with them: a filter on a distance that still
    contained it would be pushed down through all its steps, each put in place of its name wherever that occurs."""
    return reduce(lambda df, s: df.withColumn(*s), [s for s in _distance()[0] if s[0].startswith("__l")], groups)


def _with_distance(rows: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
    """Rows with `d2` from their group's factored estimate."""
    steps, square = _distance()
    out = reduce(lambda df, s: df.withColumn(*s), [s for s in steps if s[0].startswith("__z")], _join_groups(rows, groups, how))
    return out.select(*rows.columns, square.alias("d2"))


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Location (m0..), covariance (c0_0..) and its factor (__l0_0..) of every (lang, source) with enough rows, one row for each."""
    p, keys = len(STATISTICS), ["lang", "source"]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    middle = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.percentile_approx(d, [0.25, 0.5, 0.75]).alias(f"__q{i}") for i, d in enumerate(STATISTICS)])
    middle = middle.where(F.col("__n") >= min_rows)
    spread = [F.greatest((F.get(f"__q{i}", F.lit(2)) - F.get(f"__q{i}", F.lit(0))) / 1.349, F.lit(0.01)) for i in range(p)]
    groups = middle.select(*keys, *[F.get(f"__q{i}", F.lit(1)).alias(f"m{i}") for i in range(p)],
                           *[(spread[i] * spread[i] if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs])
    for _ in range(steps):
        near = _with_distance(rows, materialise(_factored(groups), "estimate"), "inner")
        edge = near.groupBy(*keys).agg(F.percentile_approx("d2", share, 1000).alias("__edge"))
        inner = _join_groups(near, edge, "inner").where(F.col("d2") <= F.col("__edge"))
        sums = inner.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.avg(d).alias(f"m{i}") for i, d in enumerate(STATISTICS)],
                                        *[F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}_{j}") for i, j in pairs])
        # the inner share of a normal cloud is too narrow by this factor (5 dimensions, share 0.75)
        groups = sums.select(*keys, *[f"m{i}" for i in range(p)], *[
            (F.col(f"c{i}_{j}") * 1.66 + F.lit(FLOOR if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in pairs])
    return materialise(_factored(groups), "estimate")


def quality_verdicts(docs: DataFrame, cut: float = CUT, share: float = SHARE, steps: int = STEPS, min_rows: int = MIN_ROWS) -> DataFrame:
    """(doc_id, n_words, base statistics, base_failed, distance2, kept) of every document."""
    counts = base_statistics(docs)
    rows = materialise(counts.select("*", *[c.alias(n) for n, c in _vector().items()]), "statistics")
    groups = robust_estimates(rows.where(~F.col("base_failed")), share, steps, min_rows)
    out = _with_distance(rows, groups)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.col("d2").alias("distance2"), (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"))
