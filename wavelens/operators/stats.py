"""Statistics of signals: moments, percentiles, entropy, regression. Grouped aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import safe
from .temporal import by_signal


def moments(samples: DataFrame, value: str = "v") -> DataFrame:
    """Mean, variances, and skewness and kurtosis that divide by n and by powers of the sample deviation."""
    n, v = F.count(value), F.col(value)
    s = samples.groupBy("signal_id").agg(n.alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"), F.min(v).alias("low"), F.max(v).alias("high"))
    r = (F.col("n") - 1) / F.col("n")
    return s.select("signal_id", "n", "mean", "variance", F.coalesce(F.col("sk") * F.pow(r, F.lit(1.5)), F.lit(0.0)).alias("skewness"), F.coalesce((F.col("ku") + 3) * r * r - 3, F.lit(0.0)).alias("kurtosis"), (F.col("high") - F.col("low")).alias("range"))


def percentiles(samples: DataFrame, value: str = "v", points: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Interpolated percentiles, quartile range and Tukey fences."""
    s = samples.groupBy("signal_id").agg(F.percentile(value, list(points)).alias("p"))
    at = {q: F.col("p")[i] for i, q in enumerate(points)}
    iqr = at[0.75] - at[0.25]
    return s.select("signal_id", *(c.alias(f"p{round(q * 100):02d}") for q, c in at.items()), iqr.alias("iqr"), (at[0.25] - 1.5 * iqr).alias("low_fence"), (at[0.75] + 1.5 * iqr).alias("high_fence"))


def histogram(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, bin, count, bins): equal bins by the square-root rule; the last one is closed."""
    s = samples.groupBy("signal_id").agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("bins", F.ceil(F.sqrt("n")))
    at = F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("bins"))
    b = F.least(F.coalesce(at, F.lit(0)), F.col("bins") - 1).cast("long")
    return samples.join(s, "signal_id").groupBy("signal_id", b.alias("bin"), "bins").agg(F.count("*").alias("count"))


def entropies(samples: DataFrame, value: str = "v", order: float = 2.0) -> DataFrame:
    """Shannon, Renyi and Tsallis entropies (base 2, order 2) of each signal's histogram, and the evenness."""
    h = histogram(samples, value)
    n = h.groupBy("signal_id").agg(F.sum("count").alias("n"))
    p = h.join(n, "signal_id").withColumn("p", F.col("count") / F.col("n"))
    s = p.groupBy("signal_id", "bins").agg((-F.sum(F.col("p") * F.log2("p"))).alias("shannon"), F.sum(F.pow("p", F.lit(order))).alias("q"))
    return s.select("signal_id", F.col("bins").cast("long").alias("bins"), "shannon", (F.log2("q") / (1 - order)).alias("renyi"), ((1 - F.col("q")) / (order - 1)).alias("tsallis"), safe(F.col("shannon"), F.log2("bins")).alias("evenness"))


def regression(samples: DataFrame, x: str = "i", y: str = "v") -> DataFrame:
    """Least-squares line of each signal over its position, with correlation and covariance."""
    xd = F.col(x).cast("double")
    s = samples.groupBy("signal_id").agg(F.covar_samp(xd, F.col(y)).alias("covariance"), F.var_samp(xd).alias("vx"), F.var_samp(y).alias("vy"), F.avg(xd).alias("mx"), F.avg(y).alias("my"))
    k = safe(F.col("covariance"), F.col("vx"))
    r = safe(F.col("covariance"), F.sqrt(F.col("vx") * F.col("vy")))
    return s.select("signal_id", k.alias("slope"), (F.col("my") - k * F.col("mx")).alias("intercept"), r.alias("correlation"), (r * r).alias("r2"), F.coalesce("covariance", F.lit(0.0)).alias("covariance"))


def ranked(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, x, k, n): every value with its rank from 1 and its signal's size; what follows needs no arrays."""
    return samples.select("signal_id", F.col(value).alias("x"), F.row_number().over(by_signal(value)).alias("k"), F.count("*").over(by_signal()).alias("n"))


#: The rank, from 1, that each rule puts a share q of n sorted values at; ranks beyond either end count as the end.
RULES = {
    "linear": "(n - 1) * q + 1", "lower": "ceil(n * q)", "higher": "floor(n * q) + 1", "midpoint": "n * q", "weighted": "n * q",
    "median_unbiased": "(n + 1) / 3 + (n - 1) / 3 * q", "normal_unbiased": "n / 4 + 0.25 + q * (n + 0.5)",
}


def rank_sql(rule: str, q: float) -> str:
    """SQL of a rule's rank in a column n of doubles."""
    return f"greatest(1e0, least(n, {RULES[rule].replace('q', f'{q!r}e0')}))"


def percentile_rules(samples: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9), value: str = "v") -> DataFrame:
    """(signal_id, a column a rule and share): percentiles by each rule; between two ranks the value is interpolated, halfway for the midpoint."""
    r = ranked(samples, value).withColumn("n", F.col("n").cast("double"))
    at = lambda rank: F.max(F.when(F.col("k") == rank, F.col("x")))
    parts = []
    for rule in RULES:
        for q in shares:
            h = F.expr(rank_sql(rule, q))
            name = f"{rule}_{round(q * 100):02d}"
            parts += [at(F.floor(h)).alias(f"{name}_a"), at(F.ceil(h)).alias(f"{name}_b"), F.max(F.when(F.ceil(h) > F.floor(h), 0.5 if rule == "midpoint" else h - F.floor(h)).otherwise(0.0)).alias(f"{name}_f")]
    names = [f"{rule}_{round(q * 100):02d}" for rule in RULES for q in shares]
    g = r.groupBy("signal_id").agg(*parts)
    return g.select("signal_id", *((F.col(f"{c}_a") + F.col(f"{c}_f") * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c in names))


def percentile_rank(samples: DataFrame, at: float, value: str = "v") -> DataFrame:
    """(signal_id, rank): percentage of a signal's values that are at most ``at``."""
    return samples.groupBy("signal_id").agg((100 * F.avg(F.when(F.col(value) <= at, 1.0).otherwise(0.0))).alias("rank"))


def extremes(samples: DataFrame, inner: float = 1.5, outer: float = 3.0, value: str = "v") -> DataFrame:
    """(signal_id, outliers, extremes): number of values beyond the inner and beyond the outer fences."""
    q = samples.groupBy("signal_id").agg(F.percentile(value, [0.25, 0.75]).alias("p")).select("signal_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    x = F.col(value)
    far = lambda k: F.sum(F.when((x < F.col("a") - k * (F.col("b") - F.col("a"))) | (x > F.col("b") + k * (F.col("b") - F.col("a"))), 1).otherwise(0))
    return samples.join(q, "signal_id").groupBy("signal_id").agg(far(inner).alias("outliers"), far(outer).alias("extremes"))


def moment_shape(samples: DataFrame, trim: float = 0.1, value: str = "v") -> DataFrame:
    """Per signal: raw, central and absolute moments, the fourth cumulant, Pearson's and Bowley's skewness, and the trimmed mean.

    Pearson's is 3 (mean - median) over the sample deviation, Bowley's takes the values at the truncated ranks n / 4, n / 2, 3 n / 4
    (0 below four values); the trimmed mean leaves out the share ``trim`` at each end, rounded down. Standardised moments are central ones over powers of the sample deviation.
    """
    x, d = F.col("x"), F.col("x") - F.col("m")
    r = ranked(samples, value).withColumns({"m": F.avg("x").over(by_signal())})
    at = lambda q: F.max(F.when(F.col("k") == F.least(F.floor(q * F.col("n")) + 1, F.col("n")), x))
    cut = F.floor(trim * F.col("n"))
    middle = F.avg(F.when((F.col("k") == F.floor((F.col("n") + 1) / 2)) | (F.col("k") == F.floor((F.col("n") + 2) / 2)), x))
    g = r.groupBy("signal_id").agg(
        F.max("n").alias("n"), F.max("m").alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.avg(x * x).alias("raw2"), F.avg(x * x * x).alias("raw3"), F.avg(d * d).alias("central2"), F.avg(d * d * d).alias("central3"),
        F.avg(d * d * d * d).alias("central4"), F.avg(F.abs(x)).alias("absolute1"), F.avg(F.abs(x * x * x)).alias("absolute3"), middle.alias("median"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"),
        F.avg(F.when((F.col("k") > cut) & (F.col("k") <= F.col("n") - cut), x)).alias("trimmed"),
    )
    c = F.col
    bowley = F.when(c("n") < 4, 0.0).otherwise(safe(c("q3") + c("q1") - 2 * c("q2"), c("q3") - c("q1")))
    return g.select(
        "signal_id", "mean", "raw2", "raw3", "central2", "central3", "central4", "absolute1", "absolute3", (c("central4") - 3 * c("central2") * c("central2")).alias("cumulant4"), safe(c("central3"), c("sd") * c("sd") * c("sd")).alias("standard3"),
        safe(3 * (c("mean") - c("median")), c("sd")).alias("pearson_skewness"), bowley.alias("bowley_skewness"), "trimmed",
    )


def l_moments(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, l1, l2, l3, l4, ratio2, ratio3, ratio4): sums of the sorted values under signed products of binomial coefficients of the
    values below and above, over r times the number of r-subsets; orders beyond the size are 0. Ratios are to l1 (of l2) and to l2, 0 where it is 0."""
    r = ranked(samples, value).select("signal_id", "x", (F.col("k") - 1).cast("double").alias("i"), (F.col("n") - F.col("k")).cast("double").alias("j"), F.col("n").cast("double").alias("n"))
    c2 = lambda a: F.col(a) * (F.col(a) - 1) / 2
    c3 = lambda a: F.col(a) * (F.col(a) - 1) * (F.col(a) - 2) / 6
    i, j = F.col("i"), F.col("j")
    weights = {"l1": F.lit(1.0), "l2": i - j, "l3": c2("j") - i * j + c2("i"), "l4": -c3("j") + i * c2("j") - c2("i") * j + c3("i")}
    g = r.groupBy("signal_id").agg(F.max("n").alias("n"), *(F.sum(w * F.col("x")).alias(k) for k, w in weights.items()))
    n = F.col("n")
    sets = {"l1": n, "l2": 2 * c2("n"), "l3": 3 * c3("n"), "l4": 4 * (n * (n - 1) * (n - 2) * (n - 3) / 24)}
    l = g.select("signal_id", *(safe(F.col(k), s).alias(k) for k, s in sets.items()))  # noqa: E741
    return l.withColumns({"ratio2": safe(F.col("l2"), F.col("l1")), "ratio3": safe(F.col("l3"), F.col("l2")), "ratio4": safe(F.col("l4"), F.col("l2"))})


def differences(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, i, v): each value less the one before it."""
    return samples.select("signal_id", "i", (F.col(value) - F.lag(value).over(by_signal("i"))).alias("v")).where("v IS NOT NULL")


def further_entropies(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, hartley, least, rate, conditional), in bits: of the number of bins, of the fullest bin, of the first differences'
    histogram, and of a value given the one before it (both in floor(sqrt n) equal bins, at least two; 0 for a constant signal)."""
    h = histogram(samples, value)
    p = h.groupBy("signal_id").agg(F.log2(F.max("bins")).alias("hartley"), (-F.log2(F.max("count") / F.sum("count"))).alias("least"))
    d = histogram(differences(samples, value))
    total = d.groupBy("signal_id").agg(F.sum("count").alias("t"))
    share = F.col("count") / F.col("t")
    rate = d.join(total, "signal_id").groupBy("signal_id").agg((-F.sum(share * F.log2(share))).alias("rate"))
    x = F.col(value)
    s = samples.select("signal_id", x.alias("x"), F.lag(x).over(by_signal("i")).alias("b"), F.min(x).over(by_signal()).alias("lo"), F.max(x).over(by_signal()).alias("hi"), F.greatest(F.lit(2), F.floor(F.sqrt(F.count("*").over(by_signal())))).alias("bins")).where("b IS NOT NULL AND hi > lo")
    at = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1)
    joint = s.groupBy("signal_id", at("x").alias("x"), at("b").alias("b")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("signal_id", "b")
    joint = joint.withColumns({"m": F.sum("c").over(before), "t": F.sum("c").over(by_signal())})
    cond = joint.groupBy("signal_id").agg((-F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") / F.col("m")))).alias("conditional"))
    out = p.join(rate, "signal_id", "left").join(cond, "signal_id", "left")
    return out.select("signal_id", "hartley", "least", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("conditional", F.lit(0.0)).alias("conditional"))


def bin_counts(samples: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, sturges, scott, freedman, root, doane): the numbers of bins that the usual rules give; 10 where a rule's width is 0."""
    r = ranked(samples, value)
    x, n = F.col("x"), F.col("n")
    at = lambda q: F.max(F.when(F.col("k") == F.least(F.floor(q * n) + 1, n), x))
    g = r.groupBy("signal_id").agg(F.max("n").alias("n"), (F.max("x") - F.min("x")).alias("range"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), (at(0.75) - at(0.25)).alias("iqr"), F.coalesce(F.skewness("x"), F.lit(0.0)).alias("skew"))
    n = F.col("n")
    rule = lambda width: F.when(width > 0, F.ceil(F.col("range") / F.nullif(width, F.lit(0.0)))).otherwise(10)
    third = F.pow(n, F.lit(-1 / 3))
    spread = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    doane = F.when(spread > 0, F.floor(1 + F.log2(n) + F.log2(1 + F.abs("skew") / F.nullif(spread, F.lit(0.0))))).otherwise(10)
    return g.select("signal_id", (F.floor(F.log2(n)) + 1).alias("sturges"), rule(3.49 * F.col("sd") * third).alias("scott"), rule(2 * F.col("iqr") * third).alias("freedman"), F.ceil(F.sqrt(n)).alias("root"), doane.alias("doane"))
