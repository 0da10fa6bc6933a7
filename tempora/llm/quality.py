"""Quality rules: fixed limits, and robust multivariate outliers by language and source.

Four statistics of a text are transformed so that clean prose is about normal:
mean word length, symbols a word, share of repeated lines, share of repeated
windows.  Each (language, source), each language, and all documents together
have a centre and a scatter by the minimum covariance determinant: from three
deterministic starts, concentration steps over *all* documents re-estimate both
from the SUBSET share that lies nearest, until no determinant falls any more (a
step that lets a group's determinant rise, as documents equally near may, is
not taken, or two subsets could follow each other without end); the start with the least determinant is taken, and its estimates are made anew
from the documents within the REWEIGHT quantile.  As most statistics of clean
prose are nearly constant, determinants are those of the scatter and FLOOR's.

A group's estimates are drawn towards its language's, as if PRIOR documents of
the language belonged to it, and a language's towards those of all: a group of
any size is judged by the same rule.  A document farther out than CUTOFF, a
squared Mahalanobis distance, is rejected.

Each step is an aggregation with map-side sums of fixed width, so a source
with a third of all documents is no larger than any other where rows meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import written
from .frames import map_texts
from .statistics import FIELDS, describe

#: Share of a group's documents from which centre and scatter come.
SUBSET = 0.75
#: Concentration steps at most, and how much a determinant's logarithm must fall for another.
STEPS, FALL = 20, 1e-3
#: Digits after the point to which logarithms of distances are told apart where the nearest documents are chosen: it bounds what is counted.
DIGITS = 3
#: Documents of the language (of a language: of all) that count as a group's own.
PRIOR = 50
#: Share of clean documents that may be rejected by chance, for each document.
FALSE_REJECTIONS = 3e-7
#: Share of normal documents that the last estimates come from.
REWEIGHT = 0.975
#: Least standard deviation of each statistic: below it a difference isn't worth a rejection.
FLOOR = (0.06, 0.05, 0.15, 0.15)
#: Groups whose estimates are broadcast: under 16 MB.
BROADCAST_GROUPS = 30_000
P = len(FLOOR)
X = [f"__x{i}" for i in range(P)]
STARTS = 3
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_U = np.triu_indices(P)


def chi2(x: float, p: int = P) -> float:
    """The distribution function of chi-square with an even number p of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(share_above: float, p: int = P) -> float:
    """Where all but `share_above` of chi-square lies below, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
        low, high = (x, high) if above > share_above else (low, x)
    return low


#: Squared distance beyond which a document is an outlier: 36 for 3e-7.
CUTOFF = chi2_quantile(FALSE_REJECTIONS)
_NEAR = chi2_quantile(1 - REWEIGHT)


def widening(share: float) -> float:
    """Makes the scatter of the nearest `share` of normal data that of all."""
    return share / chi2(chi2_quantile(1 - share), P + 2)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def transformed() -> list[Column]:
    """The vector: ratios drawn a little towards clean prose where a text is short."""
    n, c = F.col("n_words"), F.col
    length = F.log((c("word_chars") + 250) / (n + 50))
    symbols = F.log1p(c("n_symbols") / (n + 10))
    lines = F.asin(F.sqrt(F.least(F.lit(1.0), c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)))))
    windows = F.asin(F.sqrt(F.least(F.lit(1.0), c("n_repeat_words") / F.greatest(n, F.lit(1)))))
    return [v.cast("double").alias(name) for v, name in zip((length, symbols, lines, windows), X, strict=True)]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (None: all) with the statistics of FIELDS, base_failed, distance (null: base_failed) and kept.

    Null or empty texts have no words and fail.  A null language or source is
    a group of its own.  Estimates come from documents that passed the fixed
    limits.  Repeated rows count each.  Columns of these names in `docs` are
    replaced, others stay; an empty table stays empty.
    """
    new = [*FIELDS, "base_failed", "distance", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    group = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")).alias(g) for c, g in ((lang, "__lang"), (source, "__source"))]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], *group, F.col(f"`{text}`").cast("string").alias("__of"))
    stats = map_texts(plain, "__of", describe, FIELDS, keep=[*kept, "__lang", "__source"])
    stats = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("*", *transformed())
    if text not in kept:  # else the texts would be written with them
        stats = written(stats)

    sound = written(stats.where("NOT base_failed").select("__lang", "__source", *X))
    levels = F.array(F.struct(F.lit("").alias("l"), F.lit("").alias("s")), F.struct(F.col("__lang").alias("l"), F.lit("").alias("s")), F.struct(F.col("__lang").alias("l"), F.col("__source").alias("s")))
    own = sound.select(F.explode(levels).alias("__at"), *X).select(F.concat_ws("\u0001", "__at.l", "__at.s").alias("__group"), *X)
    fitted = fit(own).select("__group", "n", "centre", "scatter")
    groups = sound.select("__lang", "__source").distinct()
    of = lambda name, at: fitted.select(F.col("__group").alias(f"__{name}"), F.struct("n", "centre", "scatter").alias(name)).join(at, f"__{name}")
    named = groups.select("__lang", "__source", F.lit("\u0001").alias("__every"), F.concat_ws("\u0001", "__lang", F.lit("")).alias("__language"), F.concat_ws("\u0001", "__lang", "__source").alias("__own"))
    three = of("own", of("language", of("every", named))).select("__lang", "__source", "every", "language", "own")
    final = written(three.mapInPandas(_pooled, "__lang string, __source string, __centre array<double>, __inverse array<double>"))
    out = stats.join(_sized(final), ["__lang", "__source"], "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), distance(F.col("__centre"), F.col("__inverse"))))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).select(*[F.col(f"`{c}`") for c in kept], *new)


def _sized(estimates: DataFrame) -> DataFrame:
    """Estimates (a written table, a row a group) to be broadcast where they are few: rows of a large group then stay where they are."""
    return F.broadcast(estimates) if estimates.count() <= BROADCAST_GROUPS else estimates


def distance(centre: Column, inverse: Column) -> Column:
    """The squared Mahalanobis distance of X from the centre under the inverse scatter (its upper triangle)."""
    terms = []
    for k, (i, j) in enumerate(_PAIRS):
        d = (F.col(X[i]) - centre[i]) * (F.col(X[j]) - centre[j]) * inverse[k]
        terms.append(d if i == j else 2 * d)
    return sum(terms[1:], terms[0])


def _matrix(upper) -> np.ndarray:
    out = np.zeros((P, P))
    out[_U] = upper
    return out + np.triu(out, 1).T


def _floored(scatter: np.ndarray) -> np.ndarray:
    return scatter + np.diag(np.square(FLOOR))


def _scatter(n: float, sums, products) -> tuple[np.ndarray, np.ndarray]:
    centre = np.asarray(sums, float) / n
    return centre, _matrix(np.asarray(products, float) / n) - np.outer(centre, centre)


def _pooled(frames):
    """Each group's estimates drawn towards its language's, and these towards those of all."""
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            centre, scatter, n = None, None, 0
            for level in ("every", "language", "own"):
                e = r[level]
                c, s, m = np.asarray(e["centre"], float), _matrix(np.asarray(e["scatter"], float)), float(e["n"])
                if centre is not None:
                    w = m / (m + PRIOR)
                    c, s = w * c + (1 - w) * centre, w * s + (1 - w) * scatter
                centre, scatter = c, s
            rows.append((r["__lang"], r["__source"], centre.tolist(), np.linalg.inv(_floored(scatter))[_U].tolist()))
        yield pd.DataFrame(rows, columns=["__lang", "__source", "__centre", "__inverse"])


_ESTIMATES = "__group string, n bigint, " + ", ".join(f"centre{k} array<double>, scatter{k} array<double>, inverse{k} array<double>, det{k} double" for k in range(STARTS))


def _rows(frame: pd.DataFrame, estimates) -> pd.DataFrame:
    """estimates: of a group's row (centre, scatter) for each start."""
    rows = []
    for r in frame.to_dict("records"):
        row = [r["__group"], int(r["n"])]
        for centre, scatter in estimates(r):
            whole = _floored(scatter)
            row += [centre.tolist(), scatter[_U].tolist(), np.linalg.inv(whole)[_U].tolist(), float(np.linalg.slogdet(whole)[1])]
        rows.append(row)
    return pd.DataFrame(rows, columns=["__group", "n", *[f"{name}{k}" for k in range(STARTS) for name in ("centre", "scatter", "inverse", "det")]])


def _started(frames):
    """From medians and spreads, and sums of transformed distances from these: no correlation, that of squashed values, that of directions."""

    def estimates(r):
        centre, spread = np.asarray(r["centre"], float), np.maximum(np.asarray(r["spread"], float), FLOOR)
        yield centre, np.diag(np.square(spread))
        for name in ("squashed", "directions"):
            c = _matrix(np.asarray(r[name], float) / r["n"])
            d = np.sqrt(np.maximum(np.diag(c), 1e-12))
            yield centre, c / np.outer(d, d) * np.outer(spread, spread)

    for frame in frames:  # no documents have these determinants: the first step is taken in any case
        yield _rows(frame, estimates).assign(**{f"det{k}": np.inf for k in range(STARTS)})


def _stepped(frames):
    """Estimates from sums over the nearest documents where the determinant falls, those before where it doesn't; and how much the determinants fell."""
    for frame in frames:
        out = _rows(frame, lambda r: (_scatter(r[f"n{k}"], r[f"sums{k}"], r[f"products{k}"]) for k in range(STARTS)))
        falls = []
        for k in range(STARTS):
            fall = (frame[f"det{k}"] - out[f"det{k}"]).clip(lower=0.0)
            for name in ("centre", "scatter", "inverse", "det"):
                out[f"{name}{k}"] = out[f"{name}{k}"].where(fall > 0, frame[f"{name}{k}"])
            falls.append(fall.to_numpy())
        yield out.assign(fall=np.max(falls, axis=0) if len(out) else [])


def fit(vectors: DataFrame) -> DataFrame:
    """(__group, n, centre, scatter) by minimum covariance determinant, from (__group, X)."""
    rounded = vectors.select("__group", *X, *[F.round(F.col(x), DIGITS + 1).alias(f"{x}r") for x in X])
    nth = lambda x, share: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x})")  # noqa: E731  counted by value, of which rounding leaves few
    medians = written(rounded.groupBy("__group").agg(F.array(*[nth(f"{x}r", 0.5) for x in X]).alias("centre")))
    few = medians.count() <= BROADCAST_GROUPS
    sized = lambda estimates: F.broadcast(estimates) if few else estimates
    off = vectors.join(sized(medians), "__group").select("__group", "centre", *[(F.col(x) - F.col("centre")[i]).alias(x) for i, x in enumerate(X)])
    off = off.select("*", *[F.round(F.abs(x), DIGITS + 1).alias(f"{x}r") for x in X])
    spreads = written(off.groupBy("__group").agg(F.first("centre").alias("centre"), F.array(*[F.greatest(1.4826 * nth(f"{x}r", 0.5), F.lit(f)) for x, f in zip(X, FLOOR, strict=True)]).alias("spread")))
    z = vectors.join(sized(spreads), "__group").select("__group", "centre", "spread", *[((F.col(x) - F.col("centre")[i]) / F.col("spread")[i]).alias(x) for i, x in enumerate(X)])
    z = z.withColumn("norm", F.greatest(sum((F.col(x) * F.col(x) for x in X[1:]), F.col(X[0]) * F.col(X[0])), F.lit(1e-12)))
    product = lambda f: F.array(*[F.sum(f(X[i]) * f(X[j])) for i, j in _PAIRS])
    start = z.groupBy("__group").agg(
        F.first("centre").alias("centre"), F.first("spread").alias("spread"), F.count(F.lit(1)).alias("n"), product(F.tanh).alias("squashed"), F.array(*[F.sum(F.col(X[i]) * F.col(X[j]) / F.col("norm")) for i, j in _PAIRS]).alias("directions")
    )
    now = written(start.mapInPandas(_started, _ESTIMATES))
    for _ in range(STEPS):
        d = [distance(F.col(f"centre{k}"), F.col(f"inverse{k}")) for k in range(STARTS)]
        measured = vectors.join(sized(now.drop("n", *[f"{name}{k}" for name in ("scatter", "det") for k in range(STARTS)])), "__group").select("__group", *X, *[F.round(F.log1p(F.greatest(x, F.lit(0.0))), DIGITS).alias(f"d{k}") for k, x in enumerate(d)])
        limits = measured.groupBy("__group").agg(*[nth(f"d{k}", SUBSET).alias(f"q{k}") for k in range(STARTS)])
        near = measured.join(sized(limits), "__group")
        sums = []
        for k in range(STARTS):
            inside = lambda x, k=k: F.sum(F.when(F.col(f"d{k}") <= F.col(f"q{k}"), x))
            sums += [inside(F.lit(1)).alias(f"n{k}"), F.array(*[inside(F.col(x)) for x in X]).alias(f"sums{k}"), F.array(*[inside(F.col(X[i]) * F.col(X[j])) for i, j in _PAIRS]).alias(f"products{k}")]
        falls = Observation()
        both = near.groupBy("__group").agg(*sums).join(sized(now), "__group")
        after = written(both.mapInPandas(_stepped, f"{_ESTIMATES}, fall double").observe(falls, F.max("fall").alias("most")))
        most, now = falls.get.get("most"), after.drop("fall")
        if most is None or most < FALL:
            break
    best = F.array_min(F.array(*[F.struct(F.col(f"det{k}").alias("det"), F.lit(k).alias("k"), F.col(f"centre{k}").alias("centre"), F.col(f"scatter{k}").alias("scatter"), F.col(f"inverse{k}").alias("inverse")) for k in range(STARTS)]))
    wide = widening(SUBSET)
    chosen = written(now.select("__group", "n", best.alias("b")).mapInPandas(lambda frames: _widened(frames, wide), "__group string, n bigint, centre array<double>, scatter array<double>, inverse array<double>"))
    # once more, from the documents that lie near by the estimates so far
    measured = vectors.join(sized(chosen), "__group").withColumn("d", distance(F.col("centre"), F.col("inverse"))).where(F.col("d") <= _NEAR)
    sums = measured.groupBy("__group").agg(F.count(F.lit(1)).alias("m"), F.array(*[F.sum(x) for x in X]).alias("sums"), F.array(*[F.sum(F.col(X[i]) * F.col(X[j])) for i, j in _PAIRS]).alias("products"))
    both = chosen.join(sums, "__group", "left")
    return written(both.mapInPandas(_reweighted, "__group string, n bigint, centre array<double>, scatter array<double>"))


def _widened(frames, factor: float):
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            scatter = factor * _matrix(np.asarray(r["b"]["scatter"], float))
            rows.append((r["__group"], r["n"], list(r["b"]["centre"]), scatter[_U].tolist(), np.linalg.inv(_floored(scatter))[_U].tolist()))
        yield pd.DataFrame(rows, columns=["__group", "n", "centre", "scatter", "inverse"])


def _reweighted(frames):
    factor = widening(REWEIGHT)
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            centre, scatter = np.asarray(r["centre"], float), np.asarray(r["scatter"], float)
            if r["sums"] is not None:
                centre, whole = _scatter(r["m"], r["sums"], r["products"])
                scatter = factor * whole[_U]
            rows.append((r["__group"], r["n"], centre.tolist(), scatter.tolist()))
        yield pd.DataFrame(rows, columns=["__group", "n", "centre", "scatter"])
