"""Catalogue of summaries, scaling, clustering and metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..operators import classify, cluster, eda, trainers
from ..schemas import FEATURES_18
from . import derived as d

#: Rows of a task in which a classifier is fitted.
ROWS_A_TASK = 5_000
BGR = ["b_bgr_mean", "g_bgr_mean", "r_bgr_mean"]


def _joined(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(d.table(spark, sf_dir, "labels"), "doc_id", "left")


def q_left_join_metadata(spark, sf_dir):
    """D1"""
    return _joined(spark, sf_dir)


def q_lookup_join(spark, sf_dir):
    """D2, I20"""
    sizes = d.csize(spark, sf_dir)
    means = d.feat18(spark, sf_dir).groupBy((F.col("vec_id") % 21).cast("int").alias("cluster_id")).agg(F.round(F.avg("b_bgr_mean"), 6).alias("b_mean"))
    return sizes.join(means, "cluster_id").select("cluster_id", "size", "b_mean", F.concat(F.lit("C"), F.col("cluster_id").cast("string"), F.lit("(cluster_"), F.col("cluster_id").cast("string"), F.lit(")")).alias("description"))


def q_value_counts(spark, sf_dir):
    """E6, G1, G2"""
    return eda.value_counts(d.table(spark, sf_dir, "documents"), "source")


def q_describe(spark, sf_dir):
    """E8, H6"""
    found = eda.describe(d.feat18(spark, sf_dir), list(FEATURES_18))
    return found.select("column", "stat", F.round("value", 6).alias("value"))


def q_null_counts(spark, sf_dir):
    """E9"""
    return eda.null_counts(_joined(spark, sf_dir))


def q_nunique(spark, sf_dir):
    """E10, E11"""
    return eda.distinct_counts(d.table(spark, sf_dir, "documents"), ["lang", "source", "text"])


def q_melt_group_median(spark, sf_dir):
    """C9, E7, H6, I19"""
    long = eda.melt(d.feat18(spark, sf_dir).select("color", *BGR), ["color"], BGR)
    return eda.group_medians(long.where("channel = 'R'"), "color").select("color", F.round("median", 6).alias("median"))


def q_boxplot_stats(spark, sf_dir):
    """E21"""
    long = eda.melt(d.feat18(spark, sf_dir).select("color", *BGR), ["color"], BGR)
    return eda.boxplot(long, ["color", "channel"]).select("color", "channel", "outliers", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")])


def q_histogram(spark, sf_dir):
    """E17"""
    return eda.histogram(d.table(spark, sf_dir, "events"), "value").select("bin", F.round("low", 6).alias("low"), "n")


def q_density(spark, sf_dir):
    """E22"""
    long = eda.melt(d.feat18(spark, sf_dir).select("color", *BGR), ["color"], BGR)
    return eda.density(long, "channel").select("channel", "i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def _predicted(spark, sf_dir):
    return d.feat18(spark, sf_dir).select(F.col("color").alias("actual"), (F.col("vec_id") % 10).cast("int").alias("predicted"))


def q_confusion_matrix(spark, sf_dir):
    """E23"""
    return eda.confusion(_predicted(spark, sf_dir), "actual", "predicted").select("actual", "predicted", "n", F.round("percent", 6).alias("percent"))


def q_weighted_prf(spark, sf_dir):
    """E24"""
    return eda.weighted_scores(_predicted(spark, sf_dir), "actual", "predicted").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_stratified_split_counts(spark, sf_dir):
    """G11"""
    return cluster.stratified(d.feat18(spark, sf_dir), "color", [F.col("vec_id")]).groupBy("color", "is_test").agg(F.count("*").alias("n"))


def q_stratified_folds(spark, sf_dir):
    """G18"""
    return cluster.folds(d.feat18(spark, sf_dir), "color", [F.col("vec_id")]).groupBy("color", "fold").agg(F.count("*").alias("n"))


def q_standard_scale(spark, sf_dir):
    """G4"""
    return cluster.standard_scale(d.feat18(spark, sf_dir), FEATURES_18).select("filename", *[F.round(c, 6).alias(c) for c in FEATURES_18])


def q_variance_cumsum(spark, sf_dir):
    """E27, F1"""
    found = cluster.variance_ratios(d.feat18(spark, sf_dir), FEATURES_18)
    return found.select(F.col("i").cast("long").alias("i"), "column", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


def q_cluster_sizes(spark, sf_dir):
    """C17, E15"""
    rows = d.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 21 * (F.col("o_custkey") % 7)).cast("int").alias("cluster_id"))
    return cluster.cluster_sizes(rows).select("cluster_id", "n", F.round("percent", 6).alias("percent"), "is_small")


def q_cluster_profile(spark, sf_dir):
    """G6, I20"""
    found = cluster.profiles(d.feat18(spark, sf_dir), FEATURES_18)
    return found.select("cluster", *[F.round(c, 6).alias(c) for c in FEATURES_18])


def q_nearest_centroid(spark, sf_dir):
    """D5, E18"""
    f = d.feat18(spark, sf_dir)
    means = f.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in FEATURES_18])
    return cluster.nearest_centroid(f, means, FEATURES_18, "filename").select("filename", "cluster_id", F.round("distance2", 6).alias("distance2"))


def q_silhouette_exact(spark, sf_dir):
    """C18, D6, E16"""
    s = cluster.silhouette(d.feat18(spark, sf_dir), FEATURES_18, "vec_id", limit=None)
    return s.groupBy("cluster_id").agg(F.round(F.avg("silhouette"), 6).alias("mean_silhouette"), F.round(F.median("silhouette"), 6).alias("median_silhouette"), (F.median("silhouette") < 0).alias("is_negative"))


def q_silhouette_bars(spark, sf_dir):
    """F7"""
    scored = cluster.silhouette(d.feat18(spark, sf_dir), FEATURES_18, "vec_id", limit=None).withColumn("silhouette", F.round("silhouette", 9))
    return cluster.silhouette_bars(scored).select("vec_id", "cluster_id", F.round("silhouette", 6).alias("silhouette"), "place")


def _inertia(spark, sf_dir):
    runs = d.table(spark, sf_dir, "events").groupBy((F.col("event_id") % 30).alias("run")).agg(F.avg("value").alias("v"))
    return runs.select("run", (F.lit(1000.0) + F.col("v") / (F.col("run") + 1)).alias("inertia"))


def q_early_stop(spark, sf_dir):
    """F2, F3"""
    return cluster.early_stop(_inertia(spark, sf_dir)).select("run", F.round("best_so_far", 6).alias("best_so_far"), "stop")


def q_knee(spark, sf_dir):
    """F5"""
    means = d.table(spark, sf_dir, "events").groupBy((F.col("event_id") % 30 + 1).alias("k")).agg(F.avg("value").alias("v"))
    series = means.select("k", ((F.lit(1000.0) + F.col("v")) / F.col("k")).alias("inertia"))
    return cluster.knee(series).select("k", F.round("difference", 6).alias("difference"), "is_knee")


def q_best_per_group(spark, sf_dir):
    """C20, F6, H2"""
    rows = d.attempts(spark, sf_dir).select("event_type", "value", "event_id")
    return eda.top_per_group(rows, "event_type", [-F.col("value"), F.col("event_id")])


def r_pca_kmeans(spark, sf_dir):
    """Scaled, reduced and clustered; each row's cluster."""
    f = cluster.assemble(cluster.standard_scale(d.feat18(spark, sf_dir), FEATURES_18), FEATURES_18)
    reduced = cluster.fit_pca(f, len(FEATURES_18)).transform(f)
    return cluster.kmeans(reduced, cluster.TARGET_K, starts=30).transform(reduced).select("filename", F.col("prediction").alias("cluster_id"))


def r_choose_k(spark, sf_dir):
    """Inertia and silhouette of each k tried, and the chosen one."""
    f = cluster.assemble(d.feat18(spark, sf_dir), FEATURES_18, "pca")
    f = f.persist()
    chosen, tried = cluster.choose_k(f, range(20, 41), starts=30)
    f.unpersist()
    return spark.createDataFrame([(k, float(i), float(s), k == chosen) for k, i, s in tried], "k int, inertia double, silhouette double, chosen boolean")


def r_classify(spark, sf_dir):
    """Scores of the five families on a stratified hold-out."""
    split = cluster.stratified(cluster.standard_scale(d.feat18(spark, sf_dir), FEATURES_18), "color", [F.xxhash64("vec_id")])
    prepared, _ = classify.prepare(split, FEATURES_18)
    prepared = prepared.persist()
    n = prepared.count()
    # an iteration is a job, so small tables go into few tasks, and the families are fitted side by side
    packed = prepared.coalesce(n // ROWS_A_TASK + 1).persist()
    train, test = packed.where(~F.col("is_test")), packed.where("is_test")

    def score(named):
        s = eda.weighted_scores(trainers.fit(named[1], train).transform(test), "label", "prediction").first()
        return named[0], *map(float, s)

    families = classify.models(FEATURES_18, 10, n)
    with ThreadPoolExecutor(len(families)) as pool:
        rows = list(pool.map(score, families.items()))
    packed.unpersist()
    prepared.unpersist()
    return spark.createDataFrame(rows, "classifier string, accuracy double, precision double, recall double, f1 double")


QUERIES = [
    q_left_join_metadata, q_lookup_join, q_value_counts, q_describe, q_null_counts, q_nunique, q_melt_group_median, q_boxplot_stats, q_histogram, q_density, q_confusion_matrix,
    q_weighted_prf, q_stratified_split_counts, q_stratified_folds, q_standard_scale, q_variance_cumsum, q_cluster_sizes, q_cluster_profile, q_nearest_centroid, q_silhouette_exact, q_silhouette_bars,
    q_early_stop, q_knee, q_best_per_group, r_pca_kmeans, r_choose_k, r_classify,
]

_MELT = f"{d.FEAT18}, melted as (select color, upper(substr(channel, 1, 1)) as channel, value from (unpivot (select color, {', '.join(BGR)} from feat18) on {', '.join(BGR)} into name channel value value))"
_STATS = (("count", "cast(count(x) as double)"), ("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("25%", "quantile_cont(x, 0.25)"), ("50%", "quantile_cont(x, 0.5)"), ("75%", "quantile_cont(x, 0.75)"), ("max", "max(x)"))
_LONG = f'unpivot (select {", ".join(FEATURES_18)} from feat18) on {", ".join(FEATURES_18)} into name "column" value x'
_JOINED = "j as (select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)"
_PRED = f"{d.FEAT18}, pred as (select color as actual, cast(vec_id % 10 as integer) as predicted from feat18)"
_NULLS = " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as n_null from j" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))
_D2 = " + ".join(f"(f.{c} - m.{c}) * (f.{c} - m.{c})" for c in FEATURES_18)
_COLS = ", ".join(f"'{c}'" for c in FEATURES_18)

SQL = {
    "q_left_join_metadata": f"with {_JOINED} select * from j",
    "q_lookup_join": f"with {d.CSIZE}, {d.FEAT18}, m as (select cast(vec_id % 21 as integer) as cluster_id, round(avg(b_bgr_mean), 6) as b_mean from feat18 group by 1) select cluster_id, size, b_mean, 'C' || cluster_id || '(cluster_' || cluster_id || ')' as description from csize join m using (cluster_id)",
    "q_value_counts": "select source, count(*) as n from documents group by 1",
    "q_describe": f"with {d.FEAT18}, long as ({_LONG}) " + " union all ".join(f"select \"column\", '{n}' as stat, round({e}, 6) as value from long group by 1" for n, e in _STATS),
    "q_null_counts": f"with {_JOINED} {_NULLS}",
    "q_nunique": "select count(*) as n_rows, count(distinct lang) as n_lang, count(distinct source) as n_source, count(distinct text) as n_text from documents",
    "q_melt_group_median": f"with {_MELT} select color, round(quantile_cont(value, 0.5), 6) as median from melted where channel = 'R' group by color",
    "q_boxplot_stats": f"""with {_MELT}, q as (select color, channel, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from melted group by 1, 2)
      select color, channel, count(*) filter (where not inside) as outliers, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(value) filter (where inside), 6) as low, round(max(value) filter (where inside), 6) as high
      from (select *, value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1) as inside from melted join q using (color, channel)) group by color, channel, q1, median, q3""",
    "q_histogram": "with e as (select min(value) as lo, max(value) as hi from events), b as (select cast(least(floor((value - lo) / ((hi - lo) / 50)), 49) as integer) as bin, lo, (hi - lo) / 50 as w from events, e) select bin, round(lo + bin * w, 6) as low, count(*) as n from b group by bin, lo, w",
    "q_confusion_matrix": f"with {_PRED} select actual, predicted, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (partition by actual), 6) as percent from pred group by 1, 2",
    "q_weighted_prf": f"""with {_PRED}, r as (select actual as c, count(*) as n, count(*) filter (where actual = predicted) as hit from pred group by 1), s as (select predicted as c, count(*) as said from pred group by 1),
      p as (select n, hit, case when coalesce(said, 0) > 0 then hit / cast(said as double) else 0 end as p, hit / cast(n as double) as r from r left join s using (c)), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from p)
      select round(sum(hit) / cast(sum(n) as double), 6) as accuracy, round(sum(p * n) / sum(n), 6) as precision, round(sum(r * n) / sum(n), 6) as recall, round(sum(f * n) / sum(n), 6) as f1 from f""",
    "q_stratified_split_counts": f"with {d.FEAT18}, x as (select color, row_number() over (partition by color order by vec_id) <= floor(count(*) over (partition by color) * 0.25::double + 0.5::double) as is_test from feat18) select color, is_test, count(*) as n from x group by 1, 2",
    "q_stratified_folds": f"with {d.FEAT18}, x as (select color, cast((row_number() over (partition by color order by vec_id) - 1) % 5 as integer) as fold from feat18) select color, fold, count(*) as n from x group by 1, 2",
    "q_standard_scale": f"with {d.FEAT18} select filename, {', '.join(f'round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}' for c in FEATURES_18)} from feat18",
    "q_variance_cumsum": f"with {d.FEAT18}, long as ({_LONG}), v as (select \"column\", list_position([{_COLS}], \"column\") as i, var_pop(x) as v from long group by 1), r as (select i, \"column\", v / sum(v) over () as ratio from v) select cast(i as bigint) as i, \"column\", round(ratio, 6) as ratio, round(sum(ratio) over (order by i), 6) as cumulative from r",
    "q_cluster_sizes": "with c as (select cast(o_custkey % 21 * (o_custkey % 7) as integer) as cluster_id, count(*) as n from orders group by 1), p as (select *, n * 100.0::double / sum(n) over () as p from c) select cluster_id, n, round(p, 6) as percent, p < 1.0 as is_small from p",
    "q_cluster_profile": f"with {d.FEAT18} select 'cluster_' || cluster_id as cluster, {', '.join(f'round(avg({c}), 6) as {c}' for c in FEATURES_18)} from feat18 group by cluster_id",
    "q_nearest_centroid": f"with {d.FEAT18}, m as (select cluster_id, {', '.join(f'avg({c}) as {c}' for c in FEATURES_18)} from feat18 group by 1) select f.filename, m.cluster_id, round({_D2}, 6) as distance2 from feat18 f, m qualify row_number() over (partition by f.filename order by {_D2}, m.cluster_id) = 1",
    "q_silhouette_exact": f"""with {d.FEAT18}, g as (select f.vec_id, f.cluster_id as own, m.cluster_id as other, sum(sqrt({_D2})) as total, count(*) as n from feat18 f, feat18 m group by 1, 2, 3),
      a as (select vec_id, own, max(case when own = other and n > 1 then total / (n - 1) end) as a, min(case when own <> other then total / n end) as b from g group by 1, 2), s as (select own as cluster_id, coalesce((b - a) / greatest(a, b), 0.0::double) as s from a)
      select cluster_id, round(avg(s), 6) as mean_silhouette, round(quantile_cont(s, 0.5), 6) as median_silhouette, quantile_cont(s, 0.5) < 0 as is_negative from s group by 1""",
    "q_silhouette_bars": f"""with {d.FEAT18}, g as (select f.vec_id, f.cluster_id as own, m.cluster_id as other, sum(sqrt({_D2})) as total, count(*) as n from feat18 f, feat18 m group by 1, 2, 3),
      a as (select vec_id, own, max(case when own = other and n > 1 then total / (n - 1) end) as a, min(case when own <> other then total / n end) as b from g group by 1, 2),
      s as (select vec_id, own as cluster_id, round(coalesce((b - a) / greatest(a, b), 0.0::double), 9) as s from a)
      select vec_id, cluster_id, round(s, 6) as silhouette, row_number() over (order by cluster_id, s, vec_id) - 1 + 10 * (dense_rank() over (order by cluster_id) - 1) as place from s""",
    "q_density": f"""with {_MELT}, g as (select channel, count(value) as n, stddev_samp(value) * pow(count(value), -0.2::double) as h, min(value) as lo, max(value) as hi from melted group by 1),
      p as (select *, lo - 3 * h + (hi - lo + 6 * h) * i / 63 as x from g, range(64) r(i))
      select channel, cast(i as integer) as i, round(x, 6) as x, round(sum(exp(-0.5::double * pow((x - value) / h, 2)) / (sqrt(2 * pi()) * h * n)), 6) as density from p join melted using (channel) group by channel, i, x""",
    "q_early_stop": """with r as (select run, 1000.0::double + v / (run + 1) as inertia from (select event_id % 30 as run, avg(value) as v from events group by 1)),
      w as (select run, min(inertia) over (order by run) as best, max(inertia) over f as hi, min(inertia) over f as lo from r window f as (order by run rows between 4 preceding and current row)) select run, round(best, 6) as best_so_far, run >= 5 and (hi - lo) / lo < 0.01 as stop from w""",
    "q_knee": """with r as (select k, (1000.0::double + v) / k as y from (select event_id % 30 + 1 as k, avg(value) as v from events group by 1)), n as (select k, (k - min(k) over ()) / cast(max(k) over () - min(k) over () as double) as x, (y - min(y) over ()) / (max(y) over () - min(y) over ()) as yn, 1.0::double / (count(*) over () - 1) as step from r),
      f as (select k, step, 1 - yn - x as difference from n), p as (select *, coalesce(difference >= lag(difference) over (order by k) and difference > lead(difference) over (order by k), false) as peak from f), g as (select *, sum(peak::int) over (order by k) as g from p),
      c as (select *, peak and min(difference) over (partition by g) < max(case when peak then difference end) over (partition by g) - step as cand from g) select k, round(difference, 6) as difference, coalesce(k = (select min(k) from c where cand), false) as is_knee from c""",
    "q_best_per_group": f"with {d.ATTEMPTS} select event_type, value, event_id from attempts qualify row_number() over (partition by event_type order by value desc, event_id) = 1",
}
