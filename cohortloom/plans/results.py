"""Queries for feature forms, audits, embedding diagnostics and decoding results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import evaluation as T
from ..operators import features as X
from ..operators import tuning as U
from ..operators.sums import in_table_order
from .derive import query, read
from .tables import EMB, FEAT, NAMES, _emb, _features, rounded

WIDE = list(NAMES.values())


@query("f01_wide", f"""WITH {FEAT} SELECT subject, count(*) FILTER (WHERE feature = '{WIDE[0]}') AS epoch_count, {', '.join(f"round({f}(value) FILTER (WHERE feature = '{n}'), 4) AS \"{s}_{n}\"" for n in WIDE for s, f in (('mean', 'avg'), ('median', 'median')))} FROM feat GROUP BY 1""")
def _(spark, d):
    return rounded(X.widened(X.aggregate(_features(spark, d), ["subject"], ("mean", "median")), ["subject"], WIDE, ("mean", "median")), 4)


@query("f02_ratios", "SELECT l_suppkey, round(CASE WHEN avg(l_tax) > 0.04 THEN avg(l_discount) / avg(l_tax) END, 6) AS ratio_discount_tax, round(CASE WHEN avg(l_discount) > 1e-12 THEN avg(l_quantity) / avg(l_discount) END, 4) AS ratio_quantity_discount FROM lineitem GROUP BY 1")
def _(spark, d):
    metrics = ("l_tax", "l_discount", "l_quantity")
    m = in_table_order(read(spark, d, "lineitem"), "l_suppkey", *metrics).groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in metrics])
    one = X.band_ratios(m, [("ratio_discount_tax", "l_discount", "l_tax")], 0.04)
    two = X.band_ratios(one, [("ratio_quantity_discount", "l_quantity", "l_discount")])
    return two.select("l_suppkey", F.round("ratio_discount_tax", 6).alias("ratio_discount_tax"), F.round("ratio_quantity_discount", 4).alias("ratio_quantity_discount"))


@query("p11_families", f"WITH {FEAT} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean FROM feat WHERE list_contains(string_split(feature, '_'), 'complexity') OR list_contains(string_split(feature, '_'), 'rel') GROUP BY 1")
def _(spark, d):
    kept = X.families(WIDE, ["complexity", "rel"])
    return rounded(_features(spark, d).filter(F.col("feature").isin(kept)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("p14_audit", f"""WITH {FEAT}, n AS (SELECT obs_id::VARCHAR AS o, feature FROM feat WHERE obs_id % 7 = 0 AND feature LIKE 'band%')
    SELECT count(*) AS bad_cells, count(DISTINCT o) AS bad_rows, count(DISTINCT feature) AS bad_features, (SELECT string_agg(feature, ',' ORDER BY feature) FROM (SELECT DISTINCT feature FROM n ORDER BY 1 LIMIT 20)) AS feature_preview,
           (SELECT string_agg(o, ',' ORDER BY o) FROM (SELECT DISTINCT o FROM n ORDER BY 1 LIMIT 20)) AS obs_id_preview FROM n""")
def _(spark, d):
    bad = (F.col("obs_id") % 7 == 0) & F.col("feature").startswith("band")
    value = F.when(bad & (F.col("obs_id") % 2 == 0), None).when(bad, float("nan")).otherwise(F.col("value"))
    return X.finite_audit(_features(spark, d).withColumn("value", value))


@query("f19_chosen", """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':0'), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, o_orderkey FROM r WHERE r <= (SELECT min(n) FROM r)""")
def _(spark, d):
    return X.balanced(read(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ["o_orderkey"])


COV = f"""{EMB}, x AS (SELECT vec_id, subject, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM emb)"""


@query("e08_participation", f"""WITH {COV}, m AS (SELECT i, avg(v) AS m FROM x GROUP BY 1), c AS (SELECT vec_id, i, v - m AS v FROM x JOIN m USING (i)),
    k AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) FROM emb) AS c FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2) SELECT round(pow(sum(c) FILTER (WHERE i = j), 2) / sum(c * c), 4) AS participation_ratio FROM k""")
def _(spark, d):
    return spark.createDataFrame([(round(E.participation_ratio(_emb(spark, d)), 4),)], "participation_ratio double")


@query("e08_null", f"""WITH {EMB}, r AS (SELECT vec_id, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(vec_id || ':' || rep || ':0'), vec_id) AS pos FROM emb, (SELECT unnest([1, 2, 3, 4, 5]) AS rep)),
    l AS (SELECT label, row_number() OVER (ORDER BY label, vec_id) AS pos FROM emb), d AS (SELECT rep, l.label, vec_id FROM r JOIN l USING (pos)),
    x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM emb),
    s AS (SELECT rep, d.label, i, count(*) AS k, sum(v) AS sv, sum(v * v) AS q FROM d JOIN x USING (vec_id) GROUP BY ALL), t AS (SELECT rep, i, sum(k) AS n, sum(sv) AS t, sum(q) AS q, sum(sv * sv / k) AS b FROM s GROUP BY 1, 2),
    e AS (SELECT rep, sum(b / n - (t / n) ** 2) / sum(q / n - (t / n) ** 2) AS eta2 FROM t GROUP BY 1) SELECT round(avg(eta2), 6) AS null_eta2 FROM e""")
def _(spark, d):
    return rounded(E.excess_eta2(_emb(spark, d), "label", ["vec_id"]).select("null_eta2"))


@query("e09_skipped", "SELECT label, count(*) AS n, 'ea_coral' AS transform, 'skipped' AS status, 'too few rows' AS reason FROM embeddings GROUP BY 1")
def _(spark, d):
    return E.skipped(_emb(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "ea_coral", "too few rows")


@query("e13_availability", "SELECT k AS size, k BETWEEN 1 AND least((SELECT count(*) FROM embeddings), (SELECT max(len(embedding)) FROM embeddings)) AS available FROM (SELECT unnest([0, 2, 50, 5000]) AS k)")
def _(spark, d):
    size = _emb(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("w")).first()
    return spark.createDataFrame([(x["size"], x["available"]) for x in E.availability(size.n, size.w or 0, [0, 2, 50, 5000])], "size int, available boolean")


@query("t04_chosen_folds", """WITH g AS (SELECT vec_id % 500 AS grp, label % 2 AS y, count(*) AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT grp, y FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, y DESC) = 1)
    , s AS (SELECT grp, y, sum(n) AS size FROM (SELECT grp, n FROM g) JOIN m USING (grp) GROUP BY 1, 2), r AS (SELECT grp, y, (row_number() OVER (PARTITION BY y ORDER BY size DESC, md5(grp || ':0'), grp) - 1) % 5 AS place FROM s)
    SELECT grp, (CASE WHEN y = 1 THEN 4 - place ELSE place END)::INT AS fold FROM r""")
def _(spark, d):
    df = _emb(spark, d).select((F.col("vec_id") % 500).alias("grp"), (F.col("label") % 2).alias("y"))
    return T.group_folds(df, 5, group="grp").select("grp", "fold").distinct()


PRED = "pr AS (SELECT l_orderkey % 5 AS fold, (l_quantity > 25)::INT AS y, (l_tax > 0.04)::INT AS prediction, l_discount * 4 + l_tax AS probability FROM lineitem)"


@query("t09_fold_metrics", f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY probability) + (count(*) OVER (PARTITION BY fold, probability) - 1) / 2.0::DOUBLE AS rk FROM pr),
    c AS (SELECT fold, count(*) FILTER (WHERE y = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND prediction = 0)::DOUBLE AS tn, sum(rk) FILTER (WHERE y = 1) AS s FROM k GROUP BY 1)
    SELECT fold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((s - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp)), 6) AS roc_auc FROM c""")
def _(spark, d):
    li = read(spark, d, "lineitem")
    p = li.select((F.col("l_orderkey") % 5).alias("fold"), (F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_tax") > 0.04).cast("int").alias("prediction"), (F.col("l_discount") * 4 + F.col("l_tax")).alias("probability"))
    return rounded(T.fold_metrics(p, []))


HITS = "h AS (SELECT o_custkey, o_custkey % 7 AS sweep, count(*)::INT AS n, count(*) FILTER (WHERE o_totalprice > 250000)::INT AS hits FROM orders GROUP BY 1, 2)"


@query("t10_chance", f"""WITH {HITS}, b AS (SELECT o_custkey, sweep, least(1.0::DOUBLE, list_sum([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5::DOUBLE)) for k in generate_series(hits, n)])) AS p FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY p) AS i, count(*) OVER (PARTITION BY sweep) AS m FROM b)
    SELECT o_custkey, sweep, round(p, 8) AS p, round(least(1.0::DOUBLE, min(p * m / i) OVER (PARTITION BY sweep ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS p_adjusted FROM r""")
def _(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey", (F.col("o_custkey") % 7).alias("sweep")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("hits"))
    return rounded(T.adjusted(T.chance_p(o, "hits", "n"), "p", ["sweep"]).select("o_custkey", "sweep", "p", "p_adjusted"), 8)


@query("t11_allowed", "SELECT o_orderkey, o_orderstatus AS eval_name, CASE WHEN o_custkey % 2 = 0 THEN 'pooled' ELSE 'EO' END AS scope FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 2 = 0")
def _(spark, d):
    scope = F.when(F.col("o_custkey") % 2 == 0, "pooled").otherwise("EO")
    spec = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "condition_separation").otherwise(F.col("o_orderstatus")).alias("eval_name"), scope.alias("scope"))
    kept = T.allowed_units(spec)
    return kept.withColumn("eval_name", F.when(F.col("eval_name") == "condition_separation", "F").otherwise(F.col("eval_name")))


def _decoding(spark, d):
    e = T.target(_emb(spark, d).withColumn("name", F.col("label") < 5), "name", positive="true").withColumn("group", F.col("vec_id") % 500)
    return e.select("vec_id", "y", "group", F.col("embedding").alias("x"))


@query("t07_tuned")
def _(spark, d):
    """For each outer fold the inner score of each setting, the chosen one and its score on the outer fold; whole vectors."""
    grid = [{"penalty": p, "l1_share": share} for p in (0.001, 0.03) for share in (0.0, 0.5)]
    return rounded(U.nested_tuning(U.nested_folds(_decoding(spark, d), 3, 3), "x", grid, inner_folds=3), 4)


@query("t08_forward")
def _(spark, d):
    """Places of the vectors in the order in which forward selection adds them, until they help no more."""
    return rounded(U.forward_selection(T.group_folds(_decoding(spark, d), 3), "x", 0.002), 4)
