"""Quality rules: per-document statistics and robust multivariate outliers.

Every document gets a vector of transformed statistics.  For each (language, source) group a
minimum-covariance-determinant estimate of centre and scatter is made by concentration steps from
several starts: medians and absolute deviations, and the moments of small subsets drawn by a hash of
the vectors.  A step keeps the half of the group with the smallest Mahalanobis distances and
re-estimates from that half.  All starts take two steps; the two of each group with the least
determinants go on until none lowers its determinant any more, and the least counts.  Documents farther out than the
cutoff are rejected.  Groups with fewer than ``min_group`` members, null languages and null sources use
the estimate over all documents.  Scatter matrices get a least variance on their diagonal, so
determinants are never zero.

Only DataFrame functions are used.  The texts are read once: the statistics are written to the
shared folder, and the concentration steps aggregate those few numbers with map-side combining,
so a group that holds a third of all rows is summed in every task.  All groups and starts take a step
together.

Defined results: null text counts as empty; empty texts fail the base rule; very long texts are
taken whole; repeated rows are judged one by one, and ties at the median distance all stay in the
half; the empty table gives an empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import discard, written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Statistics of the vector, with the least standard deviation that each is granted.
FLOOR = {"x_len": 0.5, "x_word": 0.35, "x_symbol": 0.12, "x_repeat": 0.12}
DIMS = list(FLOOR)
#: 0.9999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.513
#: Scatter of the central half of a normal vector in four dimensions, relative to the whole.
HALF_SCALE = 0.4587


#: Starts of the search besides medians, the vectors that each begins with on average, and the most
#: steps (a handful is what they take; a search that is still going on then is used as it stands).
SUBSETS, SUBSET, STEPS = 3, 12, 40
FIRST, BEST = 2, 2  # steps that all starts take, and how many of a group go on from there
#: Groups up to which their estimates (some twenty numbers each) are broadcast; more are shuffled.
SMALL = 20_000


def _side(groups: DataFrame) -> DataFrame:
    """The estimates of all groups, broadcast if they are few."""
    return F.broadcast(groups) if groups.limit(SMALL + 1).count() <= SMALL else groups


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows whose words are found twice or more in the text."""
    m = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), lambda a, b: F.xxhash64(a, b))
    keys = F.zip_with(pairs, F.slice(words, 3, m), lambda h, c: F.xxhash64(h, c))
    return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(_covered(k)))


def _covered(keys: Column) -> Column:
    at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def twins(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda p, q, k: F.coalesce(F.try_element_at(s, q + 1)["k"] == p["k"], F.lit(False))
        hit = F.transform(
            s, lambda p, k: F.when(((k > 0) & same(p, F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(p, k + 1, k)), p["i"])
        )
        return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

    return F.aggregate(
        _let(at, twins),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate("text", SPACES, "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, F.size(w)).alias("n_repeat_words")),
    )
    return base.select(
        "doc_id", "lang", "source",
        counts.alias("c"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "x_len": F.log(n),
        "x_word": F.col("word_chars") / n,
        "x_symbol": F.sqrt(F.col("n_symbols") / n),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / n),
    })


KEYS = ["group", "start"]


def _moments(df: DataFrame, scale: float) -> DataFrame:
    """Per group and start: count, means m_i and floored covariances, factored."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(DIMS)]]
    sums += [F.covar_pop(DIMS[i], DIMS[j]).alias(f"r_{i}_{j}") for i in range(len(DIMS)) for j in range(i + 1)]
    got = df.groupBy(*KEYS).agg(*sums)
    cov = [
        (F.col(f"r_{i}_{j}") / scale + (F.lit(FLOOR[DIMS[i]] ** 2) if i == j else F.lit(0.0))).alias(f"c_{i}_{j}")
        for i in range(len(DIMS))
        for j in range(i + 1)
    ]
    return _factor(got.select(*KEYS, "n", *[f"m_{i}" for i in range(len(DIMS))], *cov), KEYS)


def _factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky factor l_i_j of the covariances, column by column."""
    d = len(DIMS)
    for j in range(d):
        left = F.col(f"c_{j}_{j}")
        for k in range(j):
            left = left - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        for i in range(j + 1, d):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return df.select(*keys, "n", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _distance(df: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution through the factor."""
    total = F.lit(0.0)
    for i, x in enumerate(DIMS):
        y = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return df.withColumn(name, total)


ESTIMATE = [*[f"m_{i}" for i in range(len(DIMS))], *[f"l_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1)]]


def _log_det() -> Column:
    """Log of the determinant of the scatter, from its factor."""
    return sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(DIMS))), 2 * F.log(F.col("l_0_0")))


def _starts(members: DataFrame) -> DataFrame:
    """First estimates of every group: medians and scaled absolute deviations (start 0), and moments of
    hashed subsets of about ``SUBSET`` vectors."""
    centres = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, 10000).alias(f"m_{i}") for i, x in enumerate(DIMS)]))
    wide = members.join(_side(centres), "group")
    dev = wide.groupBy("group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(DIMS))],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10000).alias(f"a_{i}") for i, x in enumerate(DIMS)],
    )
    lower = [
        (F.sqrt(F.pow(F.col(f"a_{i}") * 1.4826, 2) + FLOOR[DIMS[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}")
        for i in range(len(DIMS))
        for j in range(i + 1)
    ]
    median = dev.select("group", F.lit(0).alias("start"), *[f"m_{i}" for i in range(len(DIMS))], *lower)
    drawn = wide.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(SUBSETS))))
    drawn = drawn.where(F.pmod(F.xxhash64("start", *DIMS), F.greatest(F.lit(1), F.expr(f"n div {SUBSET}"))) == 0)
    return median.unionByName(_moments(drawn.select(*KEYS, *DIMS), 1.0).select(*KEYS, *ESTIMATE))


def _mcd(members: DataFrame, steps: int) -> DataFrame:
    """(group, estimate): of each group the estimate with the least determinant that concentration
    steps reach from any start.  ``members``: (group, vector)."""
    fit = written(_starts(members).withColumn("det", F.lit(float("inf"))))
    side = F.broadcast if fit.count() <= SMALL else lambda df: df  # as many rows in every step
    for k in range(steps):
        if k == FIRST:
            place = F.row_number().over(Window.partitionBy("group").orderBy("det", "start"))
            fit = written(fit.withColumn("place", place).where(F.col("place") <= BEST).drop("place"))
        far = _distance(members.join(side(fit.drop("det")), "group")).select(*KEYS, *DIMS, "d2")
        half = written(far.groupBy(*KEYS).agg(F.percentile_approx("d2", 0.5, 10000).alias("half")))
        near = far.join(side(half), KEYS).where(F.col("d2") <= F.col("half"))
        new = _moments(near, HALF_SCALE).select(*KEYS, *ESTIMATE).withColumn("det", _log_det())
        old = fit.select(*KEYS, F.col("det").alias("__old"), F.struct(*ESTIMATE, "det").alias("__was"))
        # an estimate is replaced only by one with a smaller determinant
        both = new.select(*KEYS, F.struct(*ESTIMATE, "det").alias("__now")).join(old, KEYS, "right")
        less = F.coalesce(F.col("__now.det") < F.col("__old") - 1e-9, F.lit(False))
        step = both.select(*KEYS, F.when(less, F.col("__now")).otherwise(F.col("__was")).alias("x"), less.alias("less"))
        after = written(step.select(*KEYS, "x.*", "less"))
        discard(fit, half)
        fit = after.drop("less")
        if after.where("less").isEmpty():
            break
    best = fit.groupBy("group").agg(F.min(F.struct("det", "start", *ESTIMATE)).alias("x"))
    return written(best.select("group", *[F.col(f"x.{c}").alias(c) for c in ESTIMATE]))


def judge(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS, min_group: int = 40) -> DataFrame:
    """Statistics, base verdict, squared robust distance and the final ``kept`` per document."""
    stats = written(_vector(statistics(docs)).withColumn("base_failed", base_failed()))
    sound = stats.where(~F.col("base_failed"))
    keys = ["lang", "source"]
    grouped = sound.where(F.col("lang").isNotNull() & F.col("source").isNotNull())
    large = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_group)
    large = written(large.select(*keys, F.monotonically_increasing_id().alias("group")))
    own = grouped.join(_side(large), keys).select("group", *DIMS)
    members = written(own.unionAll(sound.select(F.lit(-1).cast("long").alias("group"), *DIMS)))  # group -1: all
    fit = _mcd(members, steps)
    discard(members)
    row = fit.where("group = -1").first()
    named = fit.join(_side(large), "group").select(*keys, *[F.col(c).alias(f"own_{c}") for c in ESTIMATE])
    wide = stats.join(_side(named), keys, "left")
    wide = wide.withColumns({c: F.coalesce(f"own_{c}", F.lit(None if row is None else row[c]).cast("double")) for c in ESTIMATE})
    return _distance(wide).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance2"),
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
