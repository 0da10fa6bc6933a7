"""Recovery metrics. Truth and recovered values meet by a key; keys without a partner are the error of unequal lengths.

Every metric is one aggregation with map-side sums; a value that isn't finite,
before or after, gives InvalidInput instead of a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import code, finite, first_code
from .sequence import ranked
from .sweeps import running


def paired(truth: DataFrame, recovered: DataFrame, key: str = "k") -> DataFrame:
    """(key, truth, recovered); where one side lacks a key, its value is NULL, which the metrics reject."""
    t = truth.select(F.col(key), F.col("truth").cast("double").alias("truth"))
    r = recovered.select(F.col(key), F.col("recovered").cast("double").alias("recovered"))
    return t.join(r, key, "full_outer")


def _bad() -> Column:
    return F.count_if(~finite(F.col("truth")) | ~finite(F.col("recovered")))


def _checked(pairs: DataFrame, by: tuple[str, ...], value: Column, name: str, least: int = 1) -> DataFrame:
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), _bad().alias("__bad"), value.cast("double").alias("__v"))
    error = code((F.col("__n") < least) | (F.col("__bad") > 0) | ~finite(F.col("__v")), "InvalidInput")
    return g.select(*by, F.when(error.isNull(), F.col("__v")).alias(name), error.alias("error_code"))


def _d() -> Column:
    return F.col("recovered") - F.col("truth")


def absolute_residuals(pairs: DataFrame) -> DataFrame:
    r = F.abs(F.col("truth") - F.col("recovered"))
    return pairs.withColumn("residual", r).withColumn("error_code", code(~finite(F.col("truth")) | ~finite(F.col("recovered")) | ~finite(r), "InvalidInput"))


def match_count(pairs: DataFrame, tolerance: float, *by: str) -> DataFrame:
    if not 0 <= tolerance < float("inf"):
        raise ValueError("the tolerance must be finite and 0 or more")
    return _checked(pairs, by, F.count_if(F.abs(_d()) <= tolerance), "match_count")


def rmse(pairs: DataFrame, *by: str) -> DataFrame:
    return _checked(pairs, by, F.sqrt(F.avg(_d() * _d())), "rmse")


def rmse_standard_error(pairs: DataFrame, *by: str) -> DataFrame:
    """sd of the squared errors / (2 RMSE sqrt n), 0 without error; two pairs at least."""
    root = F.sqrt(F.avg(_d() * _d()))
    value = F.when(root == 0, F.lit(0).cast("double")).otherwise(F.stddev_samp(_d() * _d()) / (2 * root * F.sqrt(F.count(F.lit(1)))))
    return _checked(pairs, by, value, "rmse_standard_error", 2)


def mean_bias(pairs: DataFrame, *by: str) -> DataFrame:
    return _checked(pairs, by, F.avg(_d()), "mean_bias")


def bias_standard_error(pairs: DataFrame, *by: str) -> DataFrame:
    return _checked(pairs, by, F.stddev_samp(_d()) / F.sqrt(F.count(F.lit(1))), "bias_standard_error", 2)


def interval_coverage(rows: DataFrame, *by: str) -> DataFrame:
    """Share of rows (truth, lower, upper) with lower <= truth <= upper; reversed bounds are an error."""
    t, lo, hi = F.col("truth"), F.col("lower"), F.col("upper")
    bad = F.count_if(~finite(t) | ~finite(lo) | ~finite(hi) | (lo > hi))
    hit = F.avg(F.when((lo <= t) & (t <= hi), F.lit(1).cast("double")).otherwise(F.lit(0).cast("double")))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), hit.alias("v"))
    error = code((F.col("n") == 0) | (F.col("bad") > 0), "InvalidInput")
    return g.select(*by, F.when(error.isNull(), F.col("v")).alias("coverage"), "n", error.alias("error_code"))


def wilson_interval(coverage: DataFrame, z: float) -> DataFrame:
    """Wilson's score interval of a coverage, within [0, 1]."""
    if not 0 < z < float("inf"):
        raise ValueError("z must be finite and over 0")
    p, n, q = F.col("coverage"), F.col("n").cast("double"), F.lit(z * z)
    centre = (p + q / (2 * n)) / (1 + q / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + q / (4 * n * n)) / (1 + q / n)
    one, zero = F.lit(1).cast("double"), F.lit(0).cast("double")
    return coverage.withColumn("lower", F.greatest(zero, centre - half)).withColumn("upper", F.least(one, centre + half))


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges as sets of two ends: (low, high), each once."""
    return edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def edge_scores(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row: precision (NULL without recovered edges), recall (NULL without true ones), and error codes."""
    t, r = undirected(truth).withColumn("t", F.lit(1)), undirected(recovered).withColumn("r", F.lit(1))
    s = t.join(r, ["low", "high"], "full_outer").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(n) for x, n in ((F.col("t") * F.col("r"), "both"), (F.col("t"), "nt"), (F.col("r"), "nr"))])
    return s.select(
        F.try_divide("both", "nr").alias("precision"),
        F.try_divide("both", "nt").alias("recall"),
        code(F.col("nr") == 0, "InvalidInput").alias("precision_error"),
        code(F.col("nt") == 0, "InvalidInput").alias("recall_error"),
    )


def temporal_order_accuracy(rows: DataFrame, by: str, position: str = "i") -> DataFrame:
    """(by, accuracy, error_code): share of pairs of a key's rows whose order by `truth` and by `recovered` agree, a tie being an order of its own.

    No pairs are made: two ranks by truth differ first in one bit from the top,
    so a row goes once to each bit of its rank, and among the rows that share
    the bits above, those with a 0 and a smaller recovered value are counted
    before those with a 1: n log n rows for n, in ranges of any key. InvalidInput for fewer than two
    rows or a value that isn't finite. `position` is not looked at.
    """
    t, r = F.col("truth").cast("double"), F.col("recovered").cast("double")
    own = rows.select(by, t.alias("t"), r.alias("r"))
    size = own.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("t")) | ~finite(F.col("r"))).alias("bad"))
    met = own.groupBy(by, "t", "r").agg(F.count(F.lit(1)).alias("c"))
    levels = running(own.select(by, "t").distinct(), [by], ["t"], {"k": ("sum", F.lit(1).cast("long"))}, {"k": "levels"})
    top = met.join(levels, [by, "t"]).select(by, "r", "c", (F.col("k") - 1).alias("rank"), (F.col("levels") - 1).alias("top")).where("top > 0")
    bits = top.select(by, "r", "c", "rank", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("top").cast("double"))).cast("int"))).alias("bit"))
    one = F.expr("shiftright(rank, bit) & 1") == 1
    cells = bits.groupBy(by, "bit", F.expr("shiftright(rank, bit + 1)").alias("above"), "r").agg(F.sum(F.when(one, F.lit(0)).otherwise(F.col("c"))).alias("zeros"), F.sum(F.when(one, F.col("c")).otherwise(F.lit(0))).alias("ones"))
    below = running(cells, [by, "bit", "above"], ["r"], {"before": ("sum", F.col("zeros"))})
    ordered = below.select(by, ((F.col("before") - F.col("zeros")) * F.col("ones")).alias("pairs"))
    ties = met.select(by, (F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("pairs"))
    agreed = ordered.union(ties).groupBy(by).agg(F.sum("pairs").alias("agreed"))
    error = code((F.col("n") < 2) | (F.col("bad") > 0), "InvalidInput")
    share = F.col("agreed") / (F.col("n").cast("double") * (F.col("n") - 1) / 2)
    return size.join(agreed, by).select(by, F.when(error.isNull(), share).alias("accuracy"), error.alias("error_code"))


def summarize_replications(samples: DataFrame, low: float, high: float, by: str | None = None, value: str = "value") -> DataFrame:
    """(by, n, mean, sd, se, low, high): sd and se are 0 for one sample; the percentiles are nearest ranks max(ceil(p n), 1)."""
    if not 0 <= low <= high <= 1:
        raise ValueError("percentiles must be ordered and within [0, 1]")
    group = [by] if by else []
    x, zero = F.col(value).cast("double"), F.lit(0).cast("double")
    s = samples.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), zero).alias("sd"), F.count_if(~finite(x)).alias("bad"))
    if by:
        held = samples.select(by, x.alias("x")).groupBy(by, "x").agg(F.count(F.lit(1)).alias("c"))
        places = running(held, [by], ["x"], {"rank": ("sum", F.col("c"))}, {"rank": "size"})
    else:  # ranks over the whole table, which no task holds
        places = ranked(samples.select(x.alias("x")), "x").select("x", (F.col("k") + 1).alias("rank")).crossJoin(s.select(F.col("n").alias("size")))  # one row
    # the least value whose rows reach the rank
    pick = lambda p: F.min(F.when(F.col("rank") >= F.greatest(F.ceil(F.lit(p) * F.col("size")), F.lit(1)), F.col("x")))
    q = places.groupBy(*group).agg(pick(low).alias("low"), pick(high).alias("high"))
    both = s.join(q, by) if by else s.join(q, F.lit(True))  # one row each
    error = code((F.col("n") == 0) | (F.col("bad") > 0), "InvalidInput")
    return both.select(*group, "n", "mean", "sd", (F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("se"), "low", "high", error.alias("error_code"))


def accept_within(estimate: Column, target: Column, se: Column, k: Column) -> Column:
    """|estimate - target| <= k se, scaled so that nothing overflows; with se = 0 both must be the same number, the sign of a zero included. NULL for bad input."""
    ok = finite(estimate) & finite(target) & finite(se) & finite(k) & (se >= 0) & (k >= 0)
    half = F.lit(0.5)
    close = F.abs(estimate * half - target * half) <= k * (se * half)
    same = (estimate == target) & (estimate.cast("string") == target.cast("string"))
    return F.when(ok, F.when(se == 0, same).otherwise(close))


def report(metrics: DataFrame) -> DataFrame:
    """`metrics` (rmse, mean_bias, coverage) with its JSON, its line of text and a code where a field isn't finite."""
    names = ["rmse", "mean_bias", "coverage"]
    line = F.format_string("rmse=%.6f bias=%.6f coverage=%.6f", *names)
    bad = ~finite(F.col(names[0])) | ~finite(F.col(names[1])) | ~finite(F.col(names[2]))
    return metrics.withColumns({"json": F.to_json(F.struct(F.lit(1).alias("schema_version"), *names)), "summary": line, "error_code": first_code(code(bad, "InvalidInput"))})
