"""Pan-genome profiles: presence of gene families across taxa, classes, rarefaction and fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinspark.operators.relations import taxon


def presence(grouped: DataFrame, separator: str = "|") -> DataFrame:
    """(group_id, taxon, n): genes of each taxon in each group; ``grouped`` is (group_id, gene)."""
    return grouped.groupBy("group_id", taxon(F.col("gene"), separator).alias("taxon")).agg(F.count("*").alias("n"))


def restrict(profile: DataFrame, taxa: DataFrame) -> DataFrame:
    """The profile of the taxa in a list (column ``taxon``)."""
    return profile.join(taxa.select("taxon").distinct(), "taxon", "left_semi").select(*profile.columns)


def with_singletons(grouped: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes in no group become groups of their own, named by the gene."""
    alone = genes.select("gene").distinct().join(grouped.select("gene").distinct(), "gene", "left_anti")
    return grouped.select("group_id", "gene").unionByName(alone.select(F.col("gene").alias("group_id"), "gene"))


def thresholds(n_taxa: int, low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """Numbers of taxa that bound the classes; parts below 1 are shares of the taxa."""
    return (max(low * n_taxa, 1) if low < 1 else low), (high * n_taxa if high < 1 else high)


def pan_class(n_present: Column, ts: Column | float, tc: Column | float) -> Column:
    """Specific, Share or Core, tested in this order."""
    ts, tc = (x if isinstance(x, Column) else F.lit(float(x)) for x in (ts, tc))
    return F.when(n_present <= ts, "Specific").when(n_present < tc, "Share").otherwise("Core")


def classify(profile: DataFrame, n_taxa: int | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(group_id, n_taxa, n_genes, class) of every group."""
    if n_taxa is None:
        n_taxa = profile.agg(F.countDistinct("taxon")).first()[0]
    ts, tc = thresholds(n_taxa, low, high)
    counts = profile.where("n > 0").groupBy("group_id").agg(F.count("*").alias("n_taxa"), F.sum("n").alias("n_genes"))
    return counts.withColumn("class", pan_class(F.col("n_taxa"), ts, tc))


def totals(classes: DataFrame) -> DataFrame:
    """(class, n_groups)."""
    return classes.groupBy("class").agg(F.count("*").alias("n_groups"))


def wide(profile: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """One column for each of the given taxa, for output."""
    return profile.groupBy("group_id").pivot("taxon", list(taxa)).agg(F.sum("n")).na.fill(0)


def core_representatives(grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """(group_id, gene): the smallest gene of every Core group."""
    core = classes.where("class = 'Core'").select("group_id")
    return grouped.join(core, "group_id", "left_semi").groupBy("group_id").agg(F.min("gene").alias("gene"))


def gene_classes(genes: DataFrame, grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """(gene, class) of every gene, "unknown" for those in no group."""
    known = grouped.join(classes.select("group_id", "class"), "group_id").select("gene", "class")
    return genes.select("gene").join(known, "gene", "left").select("gene", F.coalesce("class", F.lit("unknown")).alias("class"))


def shuffles(taxa: Sequence[str], times: int = 20, seed: int = 42) -> list[tuple[int, int, str]]:
    """(permutation, place, taxon): orders of the taxa, drawn with a seed."""
    rng = np.random.default_rng(seed)
    names = sorted(taxa)
    return [(p, j + 1, names[k]) for p in range(times) for j, k in enumerate(rng.permutation(len(names)))]


def rarefaction(profile: DataFrame, orders: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(perm, n, core, specific, pan) for every order of taxa and every prefix of two or more.

    ``orders``: (perm, place, taxon), one row for each taxon of a permutation.
    core: groups in at least ``high`` of the prefix; specific: groups of its last
    taxon that are in ``low`` of the prefix at most (or in that taxon only); pan:
    groups seen at all.  A group changes its count only at
    the taxa that have it, so each group gives one interval between these, and
    intervals are counted by differences: rows follow the presences, not the
    product of groups and prefixes.
    """
    n_taxa = orders.groupBy("perm").agg(F.max("place").alias("size"))
    seen = profile.where("n > 0").select("group_id", "taxon").distinct().join(orders, "taxon")
    run = Window.partitionBy("perm", "group_id").orderBy("place")
    seen = seen.withColumn("y", F.row_number().over(run)).withColumn("next", F.lead("place").over(run))
    # core while y >= high * j, that is up to j = floor(y / high), from this place to the next
    bound = high if high < 1 else None
    until = F.floor(F.col("y") / F.lit(bound) + 1e-9).cast("int") if bound else F.when(F.col("y") >= high, F.lit(1 << 30)).otherwise(0)
    stop = F.least(F.coalesce(F.col("next") - 1, F.lit(1 << 30)), until)
    first = F.col("y") == 1
    rare = F.col("y") <= F.greatest(F.lit(float(low)) * F.col("place"), F.lit(1.0))
    changes = seen.select("perm", F.explode(F.array(
        F.struct(F.col("place").alias("j"), F.when(stop >= F.col("place"), 1).otherwise(0).alias("core"), rare.cast("int").alias("specific"), first.cast("int").alias("pan")),
        F.struct(F.greatest(F.col("place"), stop + 1).alias("j"), F.when(stop >= F.col("place"), -1).otherwise(0).alias("core"), F.lit(0).alias("specific"), F.lit(0).alias("pan")),
    )).alias("c")).select("perm", "c.*")
    steps = changes.groupBy("perm", "j").agg(F.sum("core").alias("core"), F.sum("specific").alias("specific"), F.sum("pan").alias("new"))
    grid = n_taxa.select("perm", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("j"))
    order = Window.partitionBy("perm").orderBy("j")
    full = grid.join(steps, ["perm", "j"], "left").na.fill(0, ["core", "specific", "new"])
    out = full.select("perm", F.col("j").alias("n"), F.sum("core").over(order).alias("core"), "specific", F.sum("new").over(order).alias("pan"))
    return out.where("n >= 2")


def combinations_of(taxa: Sequence[str], most: int = 101, largest: int | None = None) -> list[tuple[int, int, str]]:
    """(subset, size, taxon): the first ``most`` subsets of each size up to ``largest``, in the order of their sorted taxa."""
    names = sorted(taxa)
    rows, number = [], 0
    for size in range(1, (largest or len(names)) + 1):
        for chosen in islice(combinations(names, size), most):
            rows += [(number, size, t) for t in chosen]
            number += 1
    return rows


def subset_profile(profile: DataFrame, subsets: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(subset, size, core, specific, pan) of each subset of taxa.

    ``subsets``: (subset, size, taxon).  core: groups in at least ``high`` of the
    subset; specific: groups in ``low`` of it at most (or in one taxon); pan: all.
    """
    seen = profile.where("n > 0").select("group_id", "taxon").distinct().join(subsets, "taxon")
    counted = seen.groupBy("subset", "size", "group_id").agg(F.count("*").alias("y"))
    core = F.col("y") >= (F.lit(float(high)) * F.col("size") if high < 1 else F.lit(float(high)))
    rare = F.col("y") <= (F.greatest(F.lit(float(low)) * F.col("size"), F.lit(1.0)) if low < 1 else F.lit(float(low)))
    found = counted.groupBy("subset", "size").agg(F.count_if(core).alias("core"), F.count_if(rare).alias("specific"), F.count("*").alias("pan"))
    every = subsets.select("subset", "size").distinct().join(found, ["subset", "size"], "left")
    return every.na.fill(0, ["core", "specific", "pan"])


def size_medians(samples: DataFrame, size: str = "size") -> DataFrame:
    """Median core, specific and pan count of each size."""
    return samples.groupBy(size).agg(*[F.median(c).alias(c) for c in ("core", "specific", "pan")])


#: Curves of the profile: parameters, and value at n genomes.
CURVES = {
    "core": (("k", "tau", "omega"), lambda n, k, tau, omega: k * np.exp(-n / tau) + omega),
    "specific": (("k", "tau", "theta"), lambda n, k, tau, theta: k * np.exp(-n / tau) + theta),
    "pan": (("k", "gamma"), lambda n, k, gamma: k * n**gamma),
}


def student_t(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection of the density's integral."""
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)

    def upto(t: float) -> float:
        x = np.linspace(0, t, 4001)
        y = np.exp(log_c - (df + 1) / 2 * np.log1p(x * x / df))
        return 0.5 + float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])) if t > 0 else 0.5

    lo, hi = 0.0, 1e4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upto(mid) < p else (lo, mid)
    return (lo + hi) / 2


def fit_curve(name: str, n: np.ndarray, y: np.ndarray, alpha: float = 0.05, rounds: int = 500) -> list[tuple[str, float, float]]:
    """(parameter, value, half width of its confidence interval), by Levenberg-Marquardt with values >= 0."""
    names, curve = CURVES[name]
    n, y = np.asarray(n, float), np.asarray(y, float)
    if name == "pan":
        slope, at0 = np.polyfit(np.log(n), np.log(np.maximum(y, 1e-9)), 1)
        start = np.array([math.exp(at0), max(slope, 1e-3)])
    else:
        start = np.array([max(y.max() - y.min(), 1.0), max(n.mean() / 2, 1.0), max(y.min(), 0.0)])

    def slopes(p: np.ndarray) -> np.ndarray:
        cols = []
        for k in range(len(p)):
            h = 1e-6 * max(abs(p[k]), 1e-3)
            up, down = p.copy(), p.copy()
            up[k] += h
            down[k] -= h
            cols.append((curve(n, *up) - curve(n, *down)) / (2 * h))
        return np.column_stack(cols)

    p, damp = start, 1e-2
    cost = float(((y - curve(n, *p)) ** 2).sum())
    for _ in range(rounds):
        j = slopes(p)
        a = j.T @ j
        g = j.T @ (y - curve(n, *p))
        move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        new = np.maximum(p + move, 1e-12)
        new_cost = float(((y - curve(n, *new)) ** 2).sum())
        if new_cost < cost:
            done = cost - new_cost < 1e-12 * max(cost, 1e-12)
            p, cost, damp = new, new_cost, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    df = max(len(n) - len(p), 1)
    j = slopes(p)
    cov = np.linalg.pinv(j.T @ j) * cost / df
    t = student_t(1 - alpha / 2, df)
    return [(k, float(v), float(t * math.sqrt(max(c, 0)))) for k, v, c in zip(names, p, np.diag(cov))]


def fit_profile(samples: DataFrame) -> DataFrame:
    """(curve, parameter, value, half_width) of the three curves; ``samples`` as from :func:`rarefaction`.

    The samples are permutations times taxa, a few hundred rows.
    """
    rows = samples.select("n", "core", "specific", "pan").toPandas()
    out = [(c, *r) for c in CURVES for r in (fit_curve(c, rows["n"].to_numpy(), rows[c].to_numpy()) if len(rows) else [])]
    return samples.sparkSession.createDataFrame(out, "curve string, parameter string, value double, half_width double")


def curve_points(fits: list[tuple[str, str, float, float]], most: int) -> list[tuple[str, int, float]]:
    """(curve, n, value) of fitted curves for 2 .. ``most`` genomes; ``fits`` as rows of :func:`fit_profile`."""
    values: dict[str, dict[str, float]] = {}
    for curve, parameter, value, _ in fits:
        values.setdefault(curve, {})[parameter] = value
    return [(c, n, float(CURVES[c][1](n, *[p[k] for k in CURVES[c][0]]))) for c, p in values.items() for n in range(2, most + 1)]
