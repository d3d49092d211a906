"""Quality rules: base rules on a text's statistics, and robust multivariate outliers.

A text's statistics become a transformed vector. For each language and source a minimum covariance
determinant estimate is made the deterministic way: a start from medians and quartiles, then
concentration steps that re-estimate mean and covariance from the half with the least distances
until no determinant falls any more, then reweighting. Documents beyond a cut-off of the Mahalanobis
distance are rejected. Groups of under ``min_group`` documents that pass the base rules use the
estimate of their language, or of all documents; where these are as few, none is rejected.

Everything is DataFrame expressions; an estimate is one row of a small table, and hot groups are
pre-aggregated. Null texts have no words, so the base rules fail them. Null languages and sources are
groups of their own. Repeated rows count each; equal statistics have equal verdicts. An empty table
gives an empty result. Input columns are kept as they are, whatever their names, in one struct column.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SPACE = r"[\x20\x09-\x0D]+"
DIMENSIONS = 4
#: Standard deviation added to each transformed statistic; keeps the matrix regular where a statistic is constant.
FLOOR = 0.05
#: Quantiles of the chi-square distribution with 4 degrees of freedom: 0.5, 0.975, and 0.999 for rejection.
CHI2_MEDIAN, CHI2_REWEIGHT, CHI2_REJECT = 3.357, 11.143, 18.467
#: Concentration steps at most, and the fall of a determinant's logarithm that counts as none.
CONCENTRATION_STEPS, CONVERGED = 12, 1e-3
#: Groups up to which their estimates are broadcast; more are joined by key, those of languages and of all apart.
BROADCAST_GROUPS = 50_000


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    n = F.size(words)
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce((x.h == F.get(s, i - 1).h) | (i + 1 < F.size(s)) & (x.h == F.get(s, i + 1).h), (x.h == F.get(s, i + 1).h), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.p))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + 3).alias("end"), (acc.n + p + 3 - F.greatest(p, acc.end)).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc.n)

    return F.when(n < 4, 0).otherwise(covered(_bound(windows, repeated)))


def measures(text: Column) -> Column:
    """The statistics of a text, as one struct; null counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    return F.struct(
        _bound(F.filter(F.split(t, SPACE), lambda w: w != ""), of_words).alias("words"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bound(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("n_dup_lines"),
        F.regexp_count(t, F.lit("[A-Z!]")).cast("long").alias("n_loud"),
    )


def measured(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """The documents with the struct column ``name`` of their statistics."""
    raw = docs.withColumn(name, measures(F.col(text_col)))
    q = raw[name]
    flat = F.struct(q.words.n_words.alias("n_words"), q.words.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"), q.n_dup_lines.alias("n_dup_lines"), q.words.n_repeat_words.alias("n_repeat_words"), q.n_loud.alias("n_loud"))
    return raw.withColumn(name, flat)


def base_failed(q: Column) -> Column:
    return (q.n_words < 50) | (q.n_repeat_words * 100 > q.n_words * 50)


def _vector(q: Column) -> list[Column]:
    n = F.greatest(q.n_words, F.lit(1)).cast("double")
    return [F.log1p(q.word_chars / n), F.log1p(q.n_symbols / n), F.log1p(10 * q.n_dup_lines / n), F.log1p(q.n_loud / n)]


def _levels(lang: Column, source: Column) -> list[Column]:
    """Keys of a document's group, its language and all documents."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return [F.concat_ws("\u0001", F.lit("source"), part(lang), part(source)), F.concat_ws("\u0001", F.lit("lang"), part(lang)), F.lit("all")]


_AXES = range(DIMENSIONS)
_PAIRS = list(combinations_with_replacement(_AXES, 2))


def _estimate(points: DataFrame, name: str) -> DataFrame:
    """Mean and the lower Cholesky factor of the covariance, a row for each key."""
    sums = points.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(f"x{i}").alias(f"m{i}") for i in _AXES),
        *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in _PAIRS),
    )
    out = sums
    for j in _AXES:
        for i in range(j, DIMENSIONS):
            rest = F.col(f"c{j}{i}") + (FLOOR**2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR**2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return written(out.select("key", "n", *(f"m{i}" for i in _AXES), *(f"l{i}{j}" for j in _AXES for i in range(j, DIMENSIONS))), name)


def _distance(values: list[Column], model: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    at = lambda c: F.col(f"{model}{c}")
    solved: list[Column] = []
    for i in _AXES:
        rest = values[i] - at(f"m{i}")
        for k in range(i):
            rest = rest - at(f"l{i}{k}") * solved[k]
        solved.append(rest / at(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for s in solved[1:]:
        total = total + s * s
    return total


def _small(table: DataFrame) -> DataFrame:
    """A written table with a row per group, to be broadcast where its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _beside(points: DataFrame, table: DataFrame) -> DataFrame:
    """The points with their group's row of a written table; where groups are many, the keys that most points share stay out of the shuffle."""
    if table.count() <= BROADCAST_GROUPS:
        return points.join(F.broadcast(table), "key")
    by_source = F.startswith("key", F.lit("source"))
    return points.where(by_source).join(table.where(by_source), "key").unionByName(points.where(~by_source).join(_small(table.where(~by_source)), "key"))


def estimates(stats: DataFrame, q: str, lang_col: str, source_col: str) -> DataFrame:
    """Robust estimates per key of a table of statistics; ``scale`` makes distances chi-square."""
    keys = F.array(*_levels(F.col(lang_col), F.col(source_col)))
    points = stats.where(~base_failed(F.col(q))).select(F.explode(keys).alias("key"), *(v.alias(f"x{i}") for i, v in enumerate(_vector(F.col(q)))))
    xs = [F.col(f"x{i}") for i in _AXES]
    quartiles = points.groupBy("key").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(xs)))
    near = F.lit(0.0)
    for i, x in enumerate(xs):
        q3 = F.col(f"q{i}")
        near = near + F.pow((x - q3[1]) / F.greatest((q3[2] - q3[0]) / 1.349, F.lit(FLOOR)), F.lit(2))
    distant = _beside(points, written(quartiles, "quartiles")).select("key", *xs, near.alias("d"))
    model = None
    for step in range(CONCENTRATION_STEPS):
        if model is not None:
            distant = _beside(points, model).select("key", *xs, _distance(xs).alias("d"))
        half = written(distant.groupBy("key").agg(F.percentile_approx("d", 0.5, 2000).alias("h")), "halves")
        before, model = model, _estimate(_beside(distant, half).where("d <= h"), f"estimates-{step}")
        if before is not None:
            size = sum((F.log(f"l{i}{i}") for i in _AXES), F.lit(0.0))
            falls = before.select("key", size.alias("was")).join(model.select("key", size.alias("now")), "key")
            if (falls.agg(F.max(F.col("was") - F.col("now"))).first()[0] or 0.0) < CONVERGED:
                break
    distant = _beside(points, model).select("key", *xs, _distance(xs).alias("d"))
    scale = written(distant.groupBy("key").agg(F.greatest(F.percentile_approx("d", 0.5, 2000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "scales")
    inner = _beside(distant, scale).where(F.col("d") <= F.col("scale") * CHI2_REWEIGHT)
    final = _estimate(inner, "estimates")
    count = points.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    return final.join(count, "key")


def judged(stats: DataFrame, q: str = "_q", lang_col: str = "lang", source_col: str = "source", min_group: int = 60, cutoff: float = CHI2_REJECT) -> DataFrame:
    """A table that holds statistics, with the columns ``_distance`` (null without an estimate) and ``_kept``."""
    models = written(estimates(stats, q, lang_col, source_col).where(F.col("members") >= min_group), "models")
    out = stats
    distances = []
    for level, key in enumerate(_levels(F.col(lang_col), F.col(source_col))):
        prefix = f"_m{level}_"
        renamed = models.where(F.startswith("key", F.lit(("source", "lang", "all")[level]))).select(*(F.col(c).alias(prefix + c) for c in models.columns))
        out = out.join(_small(renamed), key == F.col(f"{prefix}key"), "left")
        distances.append(_distance(_vector(F.col(q)), prefix))
    out = out.withColumn("_distance", F.coalesce(*distances))
    kept = ~base_failed(F.col(q)) & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= cutoff)
    return out.select(*stats.columns, "_distance", kept.alias("_kept"))


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The documents as the struct ``row``, with ``_q``, ``_distance`` and ``_kept``; the statistics are taken once and kept in the shared folder."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    given = docs.select(row, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = written(measured(given, "text", "_q").drop("text"), "measured")
    return judged(stats, **options).select("row", "_q", "_distance", "_kept")
