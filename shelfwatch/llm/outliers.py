"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Per document a vector of transformed text statistics; per language and source a robust mean and
covariance of those vectors; a document is rejected if its squared Mahalanobis distance is beyond
``CUTOFF``. Everything is DataFrame code over one narrow row per document.

The estimate is a deterministic FAST-MCD: from two starts (coordinate-wise medians and absolute
deviations; the same with the covariance of the rows' directions) concentration steps are repeated
(mean and covariance of the nearer ``HALF`` of the rows, then new distances) until no group's
determinant falls any more. Each group keeps the start with the smaller determinant, and is estimated
once more from all rows within ``INNER`` of it. Half of a group may be junk, alike or not. Each step is
two aggregations per group, combined before the shuffle, so a group of any size is no single task's
work; groups that have converged go on unchanged. Estimates are made at three levels: language and source, all rows of a language, all rows. A row is judged by the finest
level at which ``LEAST_ROWS`` rows enter the fit, or else by all rows. Covariances get a ridge
of ``FLOOR`` squared per statistic, so constant statistics are no division by zero and tiny
differences no outliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable
from .text import SPACES, grams, let, whole, words

STATS = ("size", "word_len", "symbols", "dup_lines", "repeats")
FLOOR = {"size": 0.35, "word_len": 0.06, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15}
HALF = 0.5
MOST_STEPS = 12
LEAST_ROWS = 50
# chi-square with 5 degrees of freedom exceeds this for about one in 10^6 normal rows
CUTOFF = 35.0
# chi-square with 5 degrees of freedom: half of normal rows are within 4.351, 97.5 % within 12.833
INNER = 12.833
# what makes the covariance of the rows within those distances that of all: their share over that of 7 degrees
HALF_FACTOR, INNER_FACTOR = 0.5 / 0.2615, 0.975 / 0.9237


def repeated_positions(tokens: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more."""
    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(h) == F.size(F.array_distinct(h)), 0).otherwise(let(ranked, marked))

    return let(grams(tokens, 3), count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document; a null text counts as empty."""
    text, lines = whole("text"), F.filter(F.split(whole("text"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    counted = docs.select(
        "doc_id", "lang", "source", F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), let(lines, F.size).alias("n_lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_positions(w).cast("bigint").alias("r"))).alias("x"),
    )
    return counted.select("doc_id", "lang", "source", F.col("x.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("x.r").alias("n_repeat_words"), "n_lines")


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics of rows with a word: logs and square roots of shares are close to symmetric."""
    n, lines = F.col("n_words"), F.greatest("n_lines", F.lit(1))
    share = {
        "size": F.log(n + 1.0), "word_len": F.log(F.col("word_chars") / n), "symbols": F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / lines), "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    return stats.withColumns({name: F.when(n > 0, value) for name, value in share.items()})


def _with_group(rows: DataFrame) -> DataFrame:
    """``grp``, the group whose estimate judges the row, and ``fits``, the groups whose estimates it enters.

    Of the coarser levels only groups that judge a row are estimated. Rows that failed the base rules
    are judged but enter nothing, nor are they counted.
    """
    enters = F.count(F.when(~F.col("base_failed"), 1))
    sized = rows.where("n_words > 0").groupBy("lang", "source").agg(enters.alias("n"))
    langs = sized.groupBy(F.col("lang").alias("_sl")).agg(F.sum("n").alias("of_lang"), F.min("n").alias("least"))
    groups = sized.join(langs, sized["lang"].eqNullSafe(F.col("_sl")))
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("of_lang") >= LEAST_ROWS, 1).otherwise(0)
    by_lang = (F.col("of_lang") >= LEAST_ROWS) & (F.col("least") < LEAST_ROWS)
    groups = durable(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), level.alias("level"), by_lang.alias("by_lang")))
    by_all = F.lit(not groups.where("level = 0").isEmpty())
    met = rows.join(groups, rows["lang"].eqNullSafe(groups["_l"]) & rows["source"].eqNullSafe(groups["_s"]), "left")
    fine, coarse = F.to_json(F.struct("lang", "source")), F.to_json(F.struct(F.lit("all").alias("of"), "lang"))
    name = F.when(F.col("level") == 2, fine).when(F.col("level") == 1, coarse).when(F.col("level") == 0, "")
    fits = F.array_compact(F.array(F.when(F.col("level") == 2, fine), F.when(F.col("by_lang"), coarse), F.when(F.col("level").isNotNull() & by_all, F.lit(""))))
    none = F.array().cast("array<string>")
    return met.withColumn("grp", name).withColumn("fits", F.when(~F.col("base_failed"), fits).otherwise(none)).drop("_l", "_s", "level", "by_lang")


def _distance(rows: DataFrame) -> Column:
    """The squared Mahalanobis distance from the whitening rows ``W`` and the centre ``m_*`` of the group."""
    apart = [F.col(x) - F.col(f"m_{x}") for x in STATS]
    total = None
    for i in range(len(STATS)):
        z = None
        for j in range(i + 1):
            term = F.col("inv")[i * len(STATS) + j] * apart[j]
            z = term if z is None else z + term
        total = z * z if total is None else total + z * z
    return total


def _whitened(moments: DataFrame) -> DataFrame:
    """Group means and covariances -> ``grp``, ``m_*``, ``inv``, the inverse of the covariance's Cholesky
    factor, and ``logdet``, the logarithm of its determinant."""
    p = len(STATS)
    frame, chol, inv = moments, {}, {}
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c_{j}_{i}")
            for k in range(j):
                value = value - F.col(chol[i, k]) * F.col(chol[j, k])
            value = F.sqrt(F.greatest(value, F.lit(FLOOR[STATS[i]] ** 2 * 1e-3))) if i == j else value / F.col(chol[j, j])
            chol[i, j] = f"l_{i}_{j}"
            frame = frame.withColumn(chol[i, j], value)
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(chol[i, i])
            else:
                value = None
                for k in range(j, i):
                    term = F.col(chol[i, k]) * F.col(inv[k, j])
                    value = term if value is None else value + term
                value = -value / F.col(chol[i, i])
            inv[i, j] = f"i_{i}_{j}"
            frame = frame.withColumn(inv[i, j], value)
    rows = F.array(*[F.col(inv[i, j]) if j <= i else F.lit(0.0) for i in range(p) for j in range(p)])
    logdet = 2 * sum((F.log(chol[i, i]) for i in range(1, p)), F.log(chol[0, 0]))
    return frame.select("grp", *[f"m_{x}" for x in STATS], rows.alias("inv"), logdet.alias("logdet"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and absolute deviations as a diagonal covariance."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5).alias(f"m_{x}") for x in STATS])
    off = rows.join(middle, "grp").groupBy("grp").agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in STATS], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5).alias(f"d_{x}") for x in STATS]
    )
    spread = [1 / F.sqrt(F.pow(1.4826 * F.col(f"d_{x}"), 2) + FLOOR[x] ** 2) for x in STATS]
    p = len(STATS)
    return off.select("grp", *[f"m_{x}" for x in STATS], F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inv"))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance of each group's rows, times ``factor``, with the ridge."""
    p = len(STATS)
    means = [F.avg(x).alias(f"m_{x}") for x in STATS]
    covs = [
        (F.covar_pop(STATS[i], STATS[j]) * factor + (FLOOR[STATS[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    return _whitened(rows.groupBy("grp").agg(*means, *covs))


def _directions(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The other start: the centre of ``start``, and the covariance of the rows' directions from it."""
    met = rows.join(start, "grp").withColumn("d2", _distance(rows))
    length = F.sqrt(F.greatest("d2", F.lit(1e-12)))
    apart = met.select("grp", *[f"m_{x}" for x in STATS], *[((F.col(x) - F.col(f"m_{x}")) / length).alias(x) for x in STATS])
    p = len(STATS)
    # the mean of the products times the number of statistics is the scatter of normal rows
    covs = [
        (F.avg(F.col(STATS[i]) * F.col(STATS[j])) * p + (FLOOR[STATS[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    return _whitened(apart.groupBy("grp").agg(*[F.first(f"m_{x}").alias(f"m_{x}") for x in STATS], *covs))


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Concentration steps from an estimate until no determinant falls any more."""
    before = None
    for _ in range(MOST_STEPS):
        far = rows.join(estimate, "grp").withColumn("d2", _distance(rows)).select("grp", "d2", *STATS)
        border = far.groupBy("grp").agg(F.percentile_approx("d2", HALF).alias("border"))
        estimate = durable(_moments(far.join(border, "grp").where("d2 <= border"), HALF_FACTOR))
        if before is not None:
            fell = estimate.join(before, "grp").where(F.col("logdet") < F.col("_was") - 1e-6)
            if fell.isEmpty():
                break
        before = estimate.select("grp", F.col("logdet").alias("_was"))
    return estimate


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(grp, m_*, inv, logdet) per group of ``rows`` (grp and the statistics): the reweighted MCD centre and whitening."""
    start = durable(_start(rows))
    ends = _concentrated(rows, start).unionByName(_concentrated(rows, durable(_directions(rows, start))))
    every = F.struct(*[f"m_{x}" for x in STATS], "inv", "logdet")
    best = durable(ends.groupBy("grp").agg(F.min_by(every, "logdet").alias("_e")).select("grp", "_e.*"))
    near = rows.join(best, "grp").where(_distance(rows) <= INNER).select("grp", *STATS)
    return durable(_moments(near, INNER_FACTOR))


def quality_outliers(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per document of ``doc_id, text, lang, source``: base counts, base_failed, distance, kept.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in
    repeated windows. Such rows are rejected and take no part in the estimates. Null or empty texts
    have no words. Null languages and sources are groups of their own. Equal rows count singly. A
    table too small for any estimate of ``LEAST_ROWS`` rows still gets one from all its rows; no rows
    give none. Other columns are ignored.
    """
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    stats = durable(_with_group(vectors(durable(statistics(docs))).withColumn("base_failed", failed)))
    fit = stats.where("n_words > 0").select(F.explode("fits").alias("grp"), *STATS)
    estimate = robust_estimates(fit)
    judged = stats.join(estimate, "grp", "left").withColumn("distance", _distance(stats))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
