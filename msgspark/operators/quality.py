"""Do synthetic rows look like the originals? Tests over long feature tables.

The long table has one row per value: (feature, is_synthetic, value) and optionally a
``weight`` (number of rows with that value, so the zeros of a sparse table are one row).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from .evaluate import _ratio
from .neighbors import as_points, matrix
from .ranking import running_sums


def to_long(df: DataFrame, *, features: str = "features", synthetic: str = "is_synthetic") -> DataFrame:
    """Dense feature arrays to (feature, is_synthetic, value, weight)."""
    return df.select(F.col(synthetic).alias("is_synthetic"), F.posexplode(features).alias("feature", "value")).select(
        "feature", "is_synthetic", F.col("value").cast("double").alias("value"), F.lit(1).cast("bigint").alias("weight"))


def with_zero_mass(long: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the rows a sparse table leaves out: one weighted zero per feature and sample.

    ``totals`` is (is_synthetic, n_rows), two rows.
    """
    present = long.groupBy("feature", "is_synthetic").agg(F.sum("weight").alias("_n"))
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("is_synthetic")
    grid = long.select("feature").distinct().select("feature", both).join(totals, "is_synthetic")
    zero = grid.join(present, ["feature", "is_synthetic"], "left").select(
        "feature", "is_synthetic", F.lit(0.0).alias("value"),
        (F.col("n_rows") - F.coalesce("_n", F.lit(0))).cast("bigint").alias("weight"))
    return long.select("feature", "is_synthetic", "value", "weight").unionByName(zero.filter("weight > 0"))


def feature_stats(long: DataFrame) -> DataFrame:
    """Count, mean, population variance, range and number of NaN / infinite values."""
    v, w = F.col("value"), F.col("weight")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    fv_ = F.when(finite, v)
    base = long.groupBy("feature", "is_synthetic").agg(
        F.sum("weight").alias("n"), F.sum(F.when(~finite, w).otherwise(0)).alias("n_bad"),
        (F.sum(w * fv_) / F.sum(F.when(finite, w))).alias("mean"),
        (F.sum(w * fv_ * fv_) / F.sum(F.when(finite, w))).alias("_m2"),
        F.min(fv_).alias("min_value"), F.max(fv_).alias("max_value"))
    return base.withColumn("variance", F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("_m2")


def _sides(stats: DataFrame, *cols: str) -> DataFrame:
    """One row per feature with s_ (synthetic) and o_ (original) columns."""
    picks = []
    for c in cols:
        picks += [F.max(F.when(F.col("is_synthetic"), F.col(c))).alias(f"s_{c}"),
                  F.max(F.when(~F.col("is_synthetic"), F.col(c))).alias(f"o_{c}")]
    return stats.groupBy("feature").agg(*picks)


def range_check(long: DataFrame, *, expansion: float) -> DataFrame:
    """Features whose synthetic range leaves the original range widened by ``expansion``."""
    s = _sides(feature_stats(long), "min_value", "max_value")
    room = (F.col("o_max_value") - F.col("o_min_value")) * F.lit(float(expansion))
    out = (F.col("s_min_value") < F.col("o_min_value") - room) | (F.col("s_max_value") > F.col("o_max_value") + room)
    return s.withColumn("out_of_range", out & (room >= 0))


def mean_std_gap(long: DataFrame) -> DataFrame:
    s = _sides(feature_stats(long).withColumn("std", F.sqrt("variance")), "mean", "std")
    return s.select("feature", F.abs(F.col("s_mean") - F.col("o_mean")).alias("mean_difference"),
                    F.abs(F.col("s_std") - F.col("o_std")).alias("std_difference"))


def ecdf(long: DataFrame) -> DataFrame:
    """(feature, value, n_s, n_o, cum_s, cum_o): both cumulative counts per distinct value.

    Equal values are combined before anything is sorted and the running counts are made by
    range partitions, so neither a frequent value nor a feature with very many values ends
    up in one task.
    """
    syn = F.col("is_synthetic")
    per_value = long.groupBy("feature", "value").agg(
        F.sum(F.when(syn, F.col("weight")).otherwise(0)).alias("n_s"),
        F.sum(F.when(syn, 0).otherwise(F.col("weight"))).alias("n_o"))
    return running_sums(per_value, order_by=["value"], partition_by=["feature"],
                        sums={"cum_s": F.col("n_s"), "cum_o": F.col("n_o")})


def ks_statistic(cdf: DataFrame) -> DataFrame:
    """(feature, n_s, n_o, statistic, p_value) of the two-sample Kolmogorov-Smirnov test."""
    totals = cdf.groupBy(F.col("feature").alias("_f")).agg(F.sum("n_s").alias("t_s"), F.sum("n_o").alias("t_o"))
    gap = F.abs(F.col("cum_s") / F.col("t_s") - F.col("cum_o") / F.col("t_o"))
    d = cdf.join(totals, F.col("feature") == F.col("_f")).groupBy("feature").agg(
        F.max("t_s").alias("n_s"), F.max("t_o").alias("n_o"), F.max(gap).alias("statistic"))
    return d.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_s"), F.col("n_o")))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value (the limiting Kolmogorov series)."""
    x2 = d * d * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x2))
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def similarity(ks: DataFrame) -> DataFrame:
    return ks.agg(F.avg(1.0 - F.least(F.col("statistic"), F.lit(1.0))).alias("overall_similarity"))


def quantiles(cdf: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of the original sample per feature."""
    rows = cdf.filter("n_o > 0")
    n = rows.groupBy(F.col("feature").alias("_f")).agg(F.sum("n_o").alias("_n"))
    rows = rows.join(n, F.col("feature") == F.col("_f"))
    at = lambda i: F.min(F.when(F.col("cum_o") >= i + 1, F.col("value")))
    pos = {k: (F.col("_n") - 1) * F.lit(float(p)) for k, p in probs.items()}
    picks = [x for k, p in pos.items() for x in (
        at(F.floor(p)).alias(f"_lo_{k}"), at(F.ceil(p)).alias(f"_hi_{k}"),
        F.max(p - F.floor(p)).alias(f"_w_{k}"))]
    out = rows.groupBy("feature").agg(*picks)
    return out.select("feature", *[
        (F.col(f"_lo_{k}") + F.col(f"_w_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k in probs])


def extreme_outliers(cdf: DataFrame, *, share: float = 0.05) -> DataFrame:
    """Features where more than ``share`` of the synthetic values exceed Q3 + 3 IQR."""
    q = quantiles(cdf, {"q25": 0.25, "q75": 0.75}).withColumnRenamed("feature", "_f")
    limit = F.col("q75") + 3 * (F.col("q75") - F.col("q25"))
    return cdf.join(q, F.col("feature") == F.col("_f")).groupBy("feature").agg(
        F.max(limit).alias("threshold"), F.sum("n_s").alias("n_s"),
        F.sum(F.when(F.col("value") > limit, F.col("n_s")).otherwise(0)).alias("n_above"),
    ).withColumn("is_extreme", F.col("n_above") > F.col("n_s") * F.lit(float(share)))


# ---- isolation forest -----------------------------------------------------------------
N_TREES = 100
TREE_ROWS = 256


def _expected_path(n):
    n = np.asarray(n, dtype=float)
    h = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, h)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path); feature -1 marks a leaf."""
    nodes, todo = [None], [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        lo, hi = x[rows].min(0), x[rows].max(0)
        splittable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes[at] = (-1, 0.0, 0, 0, depth + float(_expected_path(len(rows))))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(lo[f], hi[f]))
        right = x[rows, f] > cut
        a, b = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (f, cut, a, b, 0.0)
        todo += [(a, rows[~right], depth + 1), (b, rows[right], depth + 1)]
    return nodes


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                                             2870177450012600261))  # fixed values of the 64-bit xxHash


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash of 64-bit numbers; chained over columns it is Spark's ``xxhash64``, which starts from 42."""
    return _finished(_rotated((seed + P5 + np.uint64(8)) ^ (_rotated(value * P2, 31) * P1), 27) * P1 + P4)


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    return _finished(_rotated((seed + P5 + np.uint64(4)) ^ (np.uint64(value & 0xFFFFFFFF) * P1), 23) * P2 + P3)


def lowest_hashes(points: DataFrame, *, n_trees: int, tree_rows: int, seed: int) -> DataFrame:
    """(tree, _h, id): for each tree the rows of the lowest hashes, as a sketch of ``tree_rows`` places that each task
    fills for all trees in one pass over the ids; the sketches are merged by a rank limit."""
    def sketch(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n_trees)]
        edge = np.full(n_trees, np.iinfo(np.int64).max)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                own = hash_long(ids.view(np.uint64), np.full(len(ids), 42, np.uint64))
                for t in range(n_trees):
                    h = hash_int(seed, hash_int(t, own)).view(np.int64)
                    low = np.flatnonzero(h <= edge[t])
                    if not len(low):
                        continue
                    h, i = np.r_[held[t][0], h[low]], np.r_[held[t][1], ids[low]]
                    if len(h) > 2 * tree_rows:
                        best = np.lexsort((i, h))[:tree_rows]
                        h, i = h[best], i[best]
                        edge[t] = h[-1]
                    held[t] = (h, i)
        for t, (h, i) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), t, np.int32)), pa.array(h), pa.array(i)], ["tree", "_h", "id"])

    w = Window.partitionBy("tree").orderBy("_h", "id")
    found = points.select(F.col("id").cast("bigint").alias("id")).mapInArrow(sketch, "tree int, _h long, id long")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= tree_rows).drop("_r")


def isolation_forest(points: DataFrame, *, dim: int, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS,
                     seed: int = 42) -> list[list[tuple]]:
    """Trees grown on ``tree_rows`` hash-chosen rows each; at most n_trees * 2 * tree_rows nodes.

    A row enters a tree when its hash is among the lowest of that tree. A task sends at most about twice n_trees * tree_rows ids.
    """
    sample = lowest_hashes(points, n_trees=n_trees, tree_rows=tree_rows, seed=seed)
    rows = sample.select("id", "tree").join(points, "id")  # at most n_trees * tree_rows rows

    def grow(key, table):
        tree = key[0].as_py()
        order = np.argsort(table.column("id").to_numpy())
        x = matrix(table, dim)[order]
        nodes = _grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2)))))
        cols = list(zip(*nodes))
        return pa.table({"tree": pa.array([tree] * len(nodes), pa.int32()),
                         "node": pa.array(range(len(nodes)), pa.int32()),
                         "feature": pa.array(cols[0], pa.int32()), "cut": pa.array(cols[1], pa.float64()),
                         "lo": pa.array(cols[2], pa.int32()), "hi": pa.array(cols[3], pa.int32()),
                         "path": pa.array(cols[4], pa.float64())})

    nodes = rows.groupBy("tree").applyInArrow(
        grow, "tree int, node int, feature int, cut double, lo int, hi int, path double")
    forest: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").collect():  # bounded by the forest size
        forest.setdefault(r["tree"], []).append((r["feature"], r["cut"], r["lo"], r["hi"], r["path"]))
    return [forest[t] for t in sorted(forest)]


def isolation_scores(points: DataFrame, forest: list[list[tuple]], *, dim: int,
                     sample_size: int = TREE_ROWS) -> DataFrame:
    """(id, score) in (0, 1]; higher is more isolated."""
    trees = [tuple(np.array(c) for c in zip(*t)) for t in forest]
    norm = float(_expected_path(sample_size)) or 1.0

    def score(batches):
        for batch in batches:
            x = matrix(batch, dim)
            total = np.zeros(len(x))
            for feature, cut, lo, hi, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = np.flatnonzero(f >= 0)
                    if len(inner) == 0:
                        break
                    node = at[inner]
                    at[inner] = np.where(x[inner, f[inner]] > cut[node], hi[node], lo[node])
                total += path[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.power(2.0, -total / len(trees) / norm))], names=["id", "score"])

    return points.mapInArrow(score, "id bigint, score double")


def outlier_share(original: DataFrame, synthetic: DataFrame, *, row_id: str = "row_id", features: str | None = "features",
                  dim: int, contamination: float = 0.1, seed: int = 42, **forest_args) -> DataFrame:
    """Share of synthetic rows more isolated than the ``contamination`` tail of the originals."""
    o, s = (as_points(d, row_id=row_id, features=features) for d in (original, synthetic))
    n = o.count()
    forest = isolation_forest(o, dim=dim, seed=seed, **forest_args)
    size = min(n, forest_args.get("tree_rows", TREE_ROWS))
    scores = isolation_scores(o, forest, dim=dim, sample_size=size)
    long = scores.select(F.lit(0).alias("feature"), F.lit(False).alias("is_synthetic"), F.col("score").alias("value"),
                         F.lit(1).cast("bigint").alias("weight"))
    edge = quantiles(ecdf(long), {"edge": 1.0 - contamination}).select("edge").scalar()
    made = isolation_scores(s, forest, dim=dim, sample_size=size)
    out = made.agg(F.count(F.lit(1)).alias("n_synthetic"), F.count_if(F.col("score") > edge).alias("n_outliers"))
    pct = _ratio(F.col("n_outliers") * 100.0, F.col("n_synthetic"))
    return out.withColumn("outlier_percentage", pct).withColumn("quality_impact", impact(F.col("outlier_percentage")))


def impact(pct: Column) -> Column:
    return F.when(pct > 20, "high").when(pct > 10, "medium").otherwise("low")


def quality_score(parts: DataFrame) -> DataFrame:
    """Composite of (overall_similarity, range_violations, extreme_outliers, n_features, outlier_percentage)."""
    issues = F.col("range_violations") + F.col("extreme_outliers")
    return parts.withColumn(
        "distribution_score", F.greatest(F.lit(0.0), 1.0 - _ratio(issues, F.col("n_features")))
    ).withColumn(
        "quality_score", 0.4 * F.col("overall_similarity") + 0.4 * F.col("distribution_score")
        + 0.2 * F.greatest(F.lit(0.0), 1.0 - F.col("outlier_percentage") / 100)
    ).withColumn("validation_passed", F.col("quality_score") >= fv.MIN_SYNTHETIC_QUALITY).withColumn(
        "issues", F.array_compact(F.array(
            F.when(F.col("overall_similarity") < 0.6,
                   "Statistical distributions significantly different from original samples"),
            F.when(F.col("range_violations") > 0,
                   F.concat(F.lit("Range violations detected in "), F.col("range_violations").cast("string"), F.lit(" features"))),
            F.when(F.col("outlier_percentage") > 15,
                   F.concat(F.lit("High outlier percentage: "), F.format_string("%.1f", "outlier_percentage"), F.lit("%"))),
        ))
    ).withColumn("issues", F.when(F.col("validation_passed"), F.expr("cast(array() as array<string>)")).otherwise(F.col("issues"))
    ).withColumn("recommendations", F.transform("issues", lambda i: F.when(
        i.startswith("Statistical"), "Increase k-neighbors parameter or reduce target ratio")
        .when(i.startswith("Range"), "Add feature scaling or normalization before SMOTE")
        .otherwise("Use outlier detection preprocessing or reduce synthetic sample count")))


def quality_parts(long: DataFrame, outliers: DataFrame) -> DataFrame:
    """Everything ``quality_score`` needs, one row."""
    cdf = ecdf(long)
    one = ks_statistic(cdf).agg(F.avg(1.0 - F.least(F.col("statistic"), F.lit(1.0))).alias("overall_similarity"),
                                F.count(F.lit(1)).alias("n_features"))
    ranges = range_check(long, expansion=0.2).agg(F.count_if("out_of_range").alias("v")).scalar()
    extremes = extreme_outliers(cdf).agg(F.count_if("is_extreme").alias("v")).scalar()
    return one.withColumns({"range_violations": ranges, "extreme_outliers": extremes,
                            "outlier_percentage": outliers.select("outlier_percentage").scalar()})
