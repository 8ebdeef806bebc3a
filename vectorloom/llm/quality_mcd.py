"""Quality rules: base limits on words and repetition, then robust multivariate outliers.

A minimum-covariance-determinant estimate per (language, source) is found over transformed statistic
vectors of *all* documents that pass the base limits; a document is rejected if its Mahalanobis distance
from the estimate of its group exceeds the ``QUANTILE`` of chi-squared. Column expressions and aggregates only.

The search is the concentration step of the fast algorithm: each step keeps the share ``SHARE`` of a group's vectors that lie
nearest and recomputes mean and covariance from them; the determinant never grows. Every group has three starts about its medians (spreads
alone; correlations of coordinates bent by tanh; correlations of the vectors' signs), makes ``FIRST`` steps from each, and goes on from the
one of least determinant (ties: the earlier start). A last step takes all vectors within ``INNER`` of
chi-squared. Shares are taken from a histogram of log distances (``BINS`` per doubling), so a step is two aggregates
over narrow rows, whatever a group's size. Equal vectors of a group count once: a document copied many times can't
own the estimate. An estimate from n vectors is pooled with ``PRIOR`` vectors of the wider one (a group with its language, a
language with all documents), so that groups of a few documents lean on their language. A group's estimate whose own
centre is an outlier of the language has no say: a source mostly of junk can't keep it.

Defined results: null text has no words (so the base limits reject it); null language or source is a group
of its own; empty tables give empty tables; repeated rows get equal results; other columns pass through (a column of a result's
name gives way).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, clear, cut

MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words
SYMBOLS = "#*$%&|<>"
#: A share just over one half: up to nearly half of a group may be odd before its estimate breaks.
SHARE, STEPS, BINS, PRIOR = 0.51, 4, 16, 100
#: Starts of a group, steps made from each of them, and how much of their correlations gives way to none.
STARTS, FIRST, SHRINK = 3, 2, 0.25
#: Quantiles of chi-squared with P degrees: of the last step's vectors, and of the documents that stay.
INNER, QUANTILE = 0.975, 0.9999
#: Least spread of each transformed coordinate: below it a difference has no meaning for quality.
FLOOR = (0.12, 0.25, 0.15, 0.15)
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
#: Largest number of groups whose estimates are broadcast (about 400 bytes each); beyond, a salted shuffle join.
BROADCAST_GROUPS, SALTS = 20_000, 32


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words over the whole text.

    Each step is a projection of its own, so that no array is computed twice. Windows of three words are
    compared by a 64-bit hash chained over the words, within one document only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = clear(docs, *RESULTS)
    own = docs.columns
    step = docs.select(*own, F.btrim(t, F.lit(SPACES)).alias("__t"))
    step = step.select(*own, "__t", F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", r"[\x20\x09-\x0D]+", -1)).alias("__w"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    bare = F.length(F.translate("__t", SPACES, ""))
    windows = F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(1), F.size("__w") - 2), lambda i: F.xxhash64(F.get("__w", i - 1), F.get("__w", i), F.get("__w", i + 1))))
    plain = [F.size("__w").cast("long").alias("n_words"), bare.cast("long").alias("word_chars"), (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols")]
    step = step.select(*own, *plain, lines.alias("__l"), windows.alias("__x"))
    names = [*own, "n_words", "word_chars", "n_symbols"]
    dup = (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines")
    order = F.when(F.size("__x") > F.size(F.array_distinct("__x")), F.sort_array(F.transform("__x", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    step = step.select(*names, dup, order.alias("__o"))
    names = [*names, "n_dup_lines"]
    # Neighbours of equal hash: both their starts are repeated windows.
    same = F.zip_with("__o", F.slice("__o", 2, F.size("__o")), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i)))
    step = step.select(*names, F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))).alias("__r"))
    # Window i covers words i, i+1, i+2: sorted starts add three words each, less what the one before covers.
    add = F.aggregate(F.zip_with("__r", F.concat(F.array(F.lit(-3)), F.slice("__r", 1, F.size("__r") - 1)), lambda b, a: F.least(b - a, F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(*names, F.coalesce(F.when(F.size("__r") > 0, add), F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars").cast("double") / n, F.lit(0.1))),
        F.log1p(20.0 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / n),
    ]


def _distance(of: str = "") -> Column:
    """Squared Mahalanobis distance of columns x* from the estimate in m* and l*_* (named with ``of``): by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"{of}m{i}")
        for k in range(i):
            rest = rest - F.col(f"{of}l{i}_{k}") * z[k]
        z.append(rest / F.col(f"{of}l{i}_{i}"))
    return sum((c * c for c in z[1:]), z[0] * z[0])


def _estimates(rows: DataFrame, kept: Column, scale: float) -> DataFrame:
    """Mean and covariance (with floors) of each group's kept rows: one partial aggregate of sums."""
    sums = rows.where(kept).groupBy("g").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS))
    n = F.col("n").cast("double")
    means = sums.select("g", "n", *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)), *(F.col(f"s{i}_{j}") for i, j in PAIRS))
    cov = {(i, j): (F.col(f"s{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return means.select("g", *(f"m{i}" for i in range(P)), *(cov[ij].alias(f"c{ij[0]}_{ij[1]}") for ij in PAIRS))


def _factor(model: DataFrame, of: str = "") -> DataFrame:
    """``model`` with the factor l*_* of the covariance in place of it (names with ``of``)."""
    out = model
    for i in range(P):  # a row of the factor at a time, so that no expression is repeated inside another
        low = [[F.col(f"{of}l{a}_{b}") for b in range(P)] for a in range(P)]
        for j in range(i + 1):
            rest = F.col(f"{of}c{i}_{j}")
            for k in range(j):
                rest = rest - low[i][k] * low[j][k]
            out = out.withColumn(f"{of}l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / low[j][j])
    return out.drop(*(f"{of}c{i}_{j}" for i, j in PAIRS))


def _pooled(own: str, wide: str, n: Column) -> list[Column]:
    """The estimate ``own`` from n vectors, pooled with ``PRIOR`` vectors of ``wide``: m* and c*_*."""
    a = n / (n + F.lit(float(PRIOR)))
    m = [a * F.col(f"{own}m{i}") + (1 - a) * F.col(f"{wide}m{i}") for i in range(P)]
    gap = [F.col(f"{own}m{i}") - F.col(f"{wide}m{i}") for i in range(P)]
    c = [a * F.col(f"{own}c{i}_{j}") + (1 - a) * F.col(f"{wide}c{i}_{j}") + a * (1 - a) * gap[i] * gap[j] for i, j in PAIRS]
    return [*(x.alias(f"p_m{i}") for i, x in enumerate(m)), *(x.alias(f"p_c{i}_{j}") for x, (i, j) in zip(c, PAIRS, strict=True))]


def _with(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """Join group values to rows: broadcast when the number of groups is checked to be small, else salted."""
    if few:
        return rows.join(F.broadcast(small), "g")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["g", "__salt"]).drop("__salt")


def _nearest(rows: DataFrame, share: float, value: str, name: str) -> DataFrame:
    """Per group the upper edge of the histogram bin where ``share`` of the rows is reached."""
    from pyspark.sql import Window

    bins = rows.groupBy("g", F.floor(F.log2(F.col(value) + 1e-6) * BINS).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("b")
    run = bins.select("g", "b", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    return run.where(F.col("upto") >= share * F.col("all")).groupBy("g").agg(F.pow(F.lit(2.0), (F.min("b") + 1) / F.lit(float(BINS))).alias(name))


def _starts(data: DataFrame, few: bool) -> DataFrame:
    """Estimates to start from, ``g`` led by the number of the start: medians, with spreads alone and with two robust correlations."""
    centre = data.groupBy("g").agg(*(F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(P)), *(F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(f"q{i}") for i in range(P)))
    spread = [F.greatest((F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])).alias(f"s{i}") for i in range(P)]
    centre = cut(centre.select("g", *(f"m{i}" for i in range(P)), *spread), "centre")
    z = _with(data, centre, few).select("g", *(((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)))
    z = z.select("*", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))).alias("far"))
    bent = z.select("g", *(F.tanh(f"z{i}").alias(f"y1_{i}") for i in range(P)), *(F.when(F.col("far") > 0, F.col(f"z{i}") / F.col("far")).otherwise(0.0).alias(f"y2_{i}") for i in range(P)))
    moments = bent.groupBy("g").agg(*(F.avg(F.col(f"y{k}_{i}") * F.col(f"y{k}_{j}")).alias(f"r{k}_{i}_{j}") for k in (1, 2) for i, j in PAIRS))

    def correlation(k: int, i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        both = F.col(f"r{k}_{i}_{i}") * F.col(f"r{k}_{j}_{j}")
        return F.when(both > 0, (1 - SHRINK) * F.col(f"r{k}_{i}_{j}") / F.sqrt(both)).otherwise(0.0) if k else F.lit(0.0)

    one = lambda k: F.struct(F.lit(str(k)).alias("k"), *((F.col(f"s{i}") * F.col(f"s{j}") * correlation(k, i, j)).alias(f"c{i}_{j}") for i, j in PAIRS))
    each = centre.join(moments, "g").select("*", F.explode(F.array(*(one(k) for k in range(STARTS)))).alias("start"))
    return each.select(F.concat("start.k", "g").alias("g"), *(f"m{i}" for i in range(P)), *(f"start.c{i}_{j}" for i, j in PAIRS))


def _step(data: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """One concentration step: the estimates of each group's nearest share."""
    far = _with(data, _factor(model), few).select("g", "id", *(f"x{i}" for i in range(P)), _distance().alias("d"))
    limit = cut(_nearest(far, SHARE, "d", "limit"), "limit")
    return cut(_estimates(_with(far, limit, few), F.col("d") <= F.col("limit"), consistency(SHARE)), "model")


def _least(model: DataFrame) -> DataFrame:
    """Of each group's starts the estimate of least determinant."""
    size = _factor(model).select("g", F.round(sum((F.log(f"l{i}_{i}") for i in range(P)), F.lit(0.0)), 6).alias("size"))
    own = F.struct(*(c for c in model.columns if c != "g"))
    ranked = model.select("g", own.alias("own")).join(size, "g").groupBy(F.substring("g", 2, 1 << 30).alias("of")).agg(F.min_by("own", F.struct("size", "g")).alias("own"))
    return cut(ranked.select(F.col("of").alias("g"), "own.*"), "model")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry_text: bool = True) -> DataFrame:
    """``docs`` with the statistics, base_failed, distance (null where base_failed) and kept.

    Texts are read and split once: the statistics are written to the shared folder with the other columns
    (without the text if it isn't to be carried). A filter on them would otherwise be pushed below and
    repeat the whole chain of array expressions.
    """
    wide = statistics(docs, text)
    stats = cut(wide if carry_text else wide.drop(text), "statistics").withColumn("base_failed", base_failed())
    own = stats.columns
    # The estimates need narrow rows only; they are written once and read by every step.
    tag = F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("l"), F.col(lang)), F.lit("n")), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    narrow = stats.where(~F.col("base_failed")).select(tag.alias("g0"), F.coalesce(F.concat(F.lit("l"), F.col(lang)), F.lit("n")).alias("g1"), *(c.alias(f"x{i}") for i, c in enumerate(_vector())))
    rows = cut(narrow.distinct().withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = cut(rows.groupBy("g0", "g1").agg(F.count("*").alias("n0")), "groups")
    groups = sizes.count()
    few = groups <= BROADCAST_GROUPS

    # Every group's own rows, those of its language, and all rows: one estimate each.
    def level(g: Column) -> DataFrame:
        return rows.select(g.alias("g"), "id", *(f"x{i}" for i in range(P)))

    data = level(F.concat(F.lit("group "), F.col("g0"))).unionByName(level(F.concat(F.lit("lang "), F.col("g1")))).unionByName(level(F.lit("all")))
    many = data.select(F.explode(F.array(*(F.lit(str(k)) for k in range(STARTS)))).alias("k"), "*").select(F.concat("k", "g").alias("g"), "id", *(f"x{i}" for i in range(P)))
    model, all_few = cut(_starts(data, few), "start"), STARTS * groups <= BROADCAST_GROUPS
    for _ in range(FIRST):
        model = _step(many, model, all_few)
    model = _least(model)
    for _ in range(STEPS - FIRST):
        model = _step(data, model, few)
    far = _with(data, _factor(model), few).select("g", "id", *(f"x{i}" for i in range(P)), _distance().alias("d"))
    model = cut(_estimates(far, F.col("d") <= chi_squared(INNER), consistency(INNER)), "model")

    # Pooled from all documents to languages to groups: a row for each language, then for each group.
    def of(kind: str, name: str, before: str) -> DataFrame:
        return model.where(F.col("g").startswith(kind)).select(F.substring("g", len(kind) + 1, 1 << 30).alias(name), *(F.col(c).alias(f"{before}{c}") for c in model.columns if c != "g"))

    values = [*(f"m{i}" for i in range(P)), *(f"c{i}_{j}" for i, j in PAIRS)]
    langs = sizes.groupBy("g1").agg(F.sum("n0").alias("n1")).join(of("lang ", "g1", "own_"), "g1").join(of("all", "nothing", "wide_").drop("nothing"))
    langs = langs.select("g1", *_pooled("own_", "wide_", F.col("n1"))).select("g1", *(F.col(f"p_{v}").alias(f"w_{v}") for v in values))
    mine = sizes.join(of("group ", "g0", "own_"), "g0").join(langs, "g1").select("g0", *(F.col(f"own_m{i}").alias(f"x{i}") for i in range(P)), *(f"w_{v}" for v in values), *_pooled("own_", "w_", F.col("n0")))
    mine = _factor(mine.select("*", *(F.col(f"w_{v}").alias(f"v_w_{v}") for v in values)), "v_w_").withColumn("agrees", _distance("v_w_") <= limit_of())
    mine = _factor(mine.select(F.col("g0").alias("g"), *(F.when(F.col("agrees"), F.col(f"p_{v}")).otherwise(F.col(f"w_{v}")).alias(v) for v in values)))
    mine = cut(mine, "estimates")
    got = stats.select(F.struct(*own).alias("own"), tag.alias("g"), F.monotonically_increasing_id().alias("id"), *(c.alias(f"x{i}") for i, c in enumerate(_vector())))
    joined = got.join(F.broadcast(mine), "g", "left") if few else _left_salted(got, mine)
    return joined.select("own.*", F.when(~F.col("own.base_failed"), _distance()).alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit_of()))


def _left_salted(rows: DataFrame, small: DataFrame) -> DataFrame:
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["g", "__salt"], "left").drop("__salt")


def chi_squared(share: float) -> float:
    """The quantile of chi-squared with P = 4 degrees: P(X <= q) = 1 - exp(-q/2)(1 + q/2)."""
    lo, hi = 0.0, 100.0
    for _ in range(80):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    return q


def limit_of() -> float:
    """The largest squared distance of a document that stays."""
    return chi_squared(QUANTILE)


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` consistent for normal vectors: 6 degrees add (q/2)^2/2."""
    q = chi_squared(share)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2))
