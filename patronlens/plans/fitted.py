"""Queries over fitted clusters and classifiers.

SQL cannot fit a model, so most of these return facts that must hold of any right fit and that SQL can state:
who is on which side, that every row has the nearest centre, totals that shares and descriptions add up to, that a
loaded model scores as the saved one. Splits and samples go by md5 and are compared row by row.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patronlens.operators import churn, clustering, density, features, linkage, models, neighbours, scoring, sessions
from patronlens.plans import people
from patronlens.plans.learning import YEAR, clustering_table
from patronlens.plans.registry import query
from patronlens.plans.tables import centroids
from patronlens.plans.views import VIEWS, draw_sql
from patronlens.session import cut_lineage, scratch_path
from patronlens.sources import csv_tables

PERSON = "customer_unique_id"
CLUSTERS, MEANS, PROTOTYPES = 3, 10, 20

VIEWS["y_split"] = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY {draw_sql(PERSON, 0)}, {PERSON}) <= floor(count(*) OVER (PARTITION BY class) * 0.8)
 THEN 'train' ELSE 'test' END AS side FROM y_clustering"""
VIEWS["y_parts"] = f"""SELECT {PERSON}, CASE WHEN days_after_order >= 231 THEN 0 ELSE 1 END AS retention,
 CASE WHEN {draw_sql(PERSON, 1)} % 4 <> 0 THEN 'train' WHEN {draw_sql(PERSON, 2)} % 2 = 0 THEN 'valid' ELSE 'test' END AS part FROM y_prefixes WHERE orders_count = history_length"""
VIEWS["y_single"] = f"""SELECT {PERSON}, CASE WHEN days_after_order >= 231 THEN 0 ELSE 1 END AS retention,
 CASE WHEN {draw_sql(PERSON, 1)} % 1000000 < 800000 THEN 'train' ELSE 'test' END AS side FROM y_prefixes WHERE history_length = 1"""

def _counted(name):
    return F.count(F.lit(1)).alias(name)


def _never(condition):
    """How many rows break a rule, as a long."""
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


# --- splits ------------------------------------------------------------------------------------


@query("stratified_split", "SELECT class, count(*) FILTER (side = 'train') AS train, count(*) FILTER (side = 'test') AS test FROM y_split GROUP BY 1", YEAR)
def _(shop):
    train, test = models.stratified_split(clustering_table(shop), "class")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("class").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("train", "test")])


@query("random_split", "SELECT side, count(*) AS count FROM y_single GROUP BY 1", YEAR)
def _(shop):
    train, test = models.random_split(features.one_order_input(people.base(shop), people.today(shop)))
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side").agg(_counted("count"))


def _parts(shop):
    rows = features.history_dataset(people.base(shop), people.today(shop), expand=False)
    return shop.once("parts", lambda: models.group_folds(rows))


def _part(parts, name):
    return parts.where(F.col("part") == name)


@query("group_folds", f"SELECT {PERSON}, retention, part FROM y_parts", YEAR)
def _(shop):
    return _parts(shop).select(PERSON, "retention", "part")


# --- clusters ----------------------------------------------------------------------------------


def _sides(shop):
    """Training and held-out people of the clustering table."""
    table = clustering_table(shop)
    train = shop.once("train", lambda: models.stratified_split(table, "class")[0])
    return train, shop.once("test", lambda: table.join(train.select(PERSON), PERSON, "left_anti"))


def _clustered(shop):
    """Both sides with a cluster: Ward's for the people it is fitted on, their neighbours' vote for the others."""
    train, test = _sides(shop)
    train = shop.once("clustered", lambda: linkage.ward_clusters(train, CLUSTERS))
    return train, shop.once("voted", lambda: neighbours.knn_vote(test, train))


def _side(shop, one, other):
    return one.withColumn("side", F.lit("train")).unionByName(other.withColumn("side", F.lit("test")))


@query("hierarchical_clusters", "SELECT side, count(*) AS rows, 0 AS misplaced FROM y_split GROUP BY 1", YEAR)
def _(shop):
    """Everyone has one of the clusters, on both sides."""
    both = _side(shop, *_clustered(shop))
    return both.groupBy("side").agg(_counted("rows"), _never(~F.coalesce(F.col("cluster").between(1, CLUSTERS), F.lit(False))).alias("misplaced"))


@query("hierarchical_cluster_shares", f"SELECT count(*) AS rows, CAST(sum(class) AS BIGINT) AS active, CAST(least({CLUSTERS}, count(*)) AS BIGINT) AS clusters, 0 AS wrong FROM y_split WHERE side = 'train'", YEAR)
def _(shop):
    """Clusters and the people in them add up to the training side, and each share is that of its people."""
    train, _ = _clustered(shop)
    sums = train.groupBy("cluster").agg(_counted("n"), F.sum("class").alias("active"), F.avg("class").alias("mean"))
    joined = sums.join(clustering.cluster_shares(train), "cluster")
    return joined.agg(
        F.sum("n").alias("rows"), F.sum("active").cast("long").alias("active"), _counted("clusters"),
        _never(F.abs(F.col("probability") - F.col("mean")) > 0.005 + 1e-9).alias("wrong"),
    )


_GOWER = " + ".join(f"""coalesce(abs(t."{c}" / s."{c}" - p."{c}" / s."{c}"), 0)""" for c in clustering.NUMERIC)


@query("gower_knn_clusters", f"""WITH s AS (SELECT {', '.join(f'CAST(nullif(max("{c}") - min("{c}"), 0) AS DOUBLE) AS "{c}"' for c in clustering.NUMERIC)} FROM y_clustering),
 known AS (SELECT * FROM y_split WHERE side = 'train'),
 pairs AS (SELECT t.{PERSON} AS id, p.{PERSON} AS other, p.rfm_1 AS label, round(({_GOWER} + CASE WHEN t.cat IS NOT DISTINCT FROM p.cat THEN 0.0 ELSE 1.0 END) / 12, {neighbours.DIGITS}) AS distance
  FROM y_split t, known p, s WHERE t.side = 'test'),
 nearest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) <= {neighbours.NEIGHBOURS})
 SELECT id AS {PERSON}, label AS cluster FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS i FROM nearest GROUP BY 1, 2) WHERE i = 1""", YEAR)
def _(shop):
    """The vote itself, on a label that SQL knows too."""
    train, test = _sides(shop)
    voted = neighbours.knn_vote(test, train.withColumn("cluster", F.col("rfm_1")))
    return voted.select(PERSON, "cluster")


_SCALE = ", ".join(f"""coalesce((coalesce(CAST("{c}" AS DOUBLE), 0) - (SELECT min(coalesce(CAST("{c}" AS DOUBLE), 0)) FROM y_clustering))
 / (SELECT nullif(max(coalesce(CAST("{c}" AS DOUBLE), 0)) - min(coalesce(CAST("{c}" AS DOUBLE), 0)), 0) FROM y_clustering), 0) AS x{i}""" for i, c in enumerate(clustering.NUMERIC))
_APART = " + ".join(f"abs(a.x{i} - b.x{i})" for i in range(len(clustering.NUMERIC)))


@query("density_clusters", f"""WITH RECURSIVE points AS MATERIALIZED (SELECT {PERSON} AS id, coalesce(nullif(cat, ''), 'unmapped') AS cat, {_SCALE} FROM y_clustering),
 near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.cat = b.cat AND {_APART} <= {density.EPS} * 12),
 core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {density.MIN_POINTS}),
 links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 spread(id, c) USING KEY (id) AS (
  SELECT id, id FROM core UNION SELECT l.b, min(s.c) FROM spread s JOIN links l ON l.a = s.id JOIN recurring.spread r ON r.id = l.b WHERE s.c < r.c GROUP BY 1),
 reached AS (SELECT n.a AS id, min(s.c) AS cluster, bool_or(n.a = n.b) AS core FROM near n JOIN spread s ON s.id = n.b GROUP BY 1)
 SELECT p.id AS {PERSON}, cluster, coalesce(core, false) AS core FROM points p LEFT JOIN reached r ON r.id = p.id""", YEAR)
def _(shop):
    return density.density_clusters(clustering_table(shop))


@query("kmeans_clusters", "SELECT count(*) AS rows, 0 AS misplaced FROM y_clustering", YEAR)
def _(shop):
    """Nobody is nearer to another cluster's centre."""
    table = clustering_table(shop)
    model = clustering.kmeans(table, k=MEANS)
    placed = model.transform(clustering.complete(table)).select("cluster", vector_to_array("features").alias("_x"))
    centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
    literal = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    apart = lambda centre: F.aggregate(F.zip_with("_x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    costs = placed.withColumn("_costs", F.transform(literal, apart))
    return costs.agg(_counted("rows"), _never(F.get("_costs", F.col("cluster")) > F.array_min("_costs") + 1e-9).alias("misplaced"))


_ELBOW_ONE = f"""(SELECT ({' + '.join(f'CASE WHEN stddev_samp(coalesce(CAST("{c}" AS DOUBLE), 0)) > 0 THEN 1 ELSE 0 END' for c in clustering.NUMERIC)}) * (count(*) - 1) + count(*) FROM y_clustering)
 - (SELECT sum(n * n / (SELECT count(*) FROM y_clustering)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM y_clustering GROUP BY coalesce(nullif(cat, ''), 'unmapped')))"""


@query("kmeans_elbow", f"SELECT CAST(k AS INTEGER) AS k, round({_ELBOW_ONE}, 4) AS total, true AS below FROM range(1, 31) r(k)", YEAR)
def _(shop):
    """The squared distances from the mean, and that no number of clusters leaves more."""
    costs = cut_lineage(clustering.elbow(clustering_table(shop)))
    total = costs.where("k = 1").select("cost").scalar()
    return costs.select("k", F.round(total, 4).alias("total"), (F.col("cost") <= total * (1 + 1e-9)).alias("below"))


SCALED = [c for c in clustering.NUMERIC if c != "lambda"]


def _prototype_rows(shop):
    """Both sides, ten numbers scaled over all people, the rate as it is."""
    scaled = shop.once("scaled", lambda: clustering.standardize(clustering_table(shop), SCALED))
    train, _ = _sides(shop)
    return scaled, scaled.join(train.select(PERSON), PERSON, "left_semi"), scaled.join(train.select(PERSON), PERSON, "left_anti")


@query("k_prototypes", "SELECT side, count(*) AS rows, 0 AS dearer, 0 AS moved FROM y_split GROUP BY 1", YEAR)
def _(shop):
    """Nobody is cheaper in another cluster by the table of centres, and centres made of the fitted people move no one."""
    everyone, _, held = _prototype_rows(shop)
    model = clustering.fit_prototypes(everyone, PROTOTYPES)
    held = held.select(PERSON)
    placed = clustering.complete(cut_lineage(clustering.assign_prototypes(everyone, model)))
    numeric, category = clustering.NUMERIC, clustering.CATEGORY
    again = [r.asDict() for r in placed.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in numeric]).join(
        clustering.most_common(placed, ["cluster"], category, category), "cluster", "left").collect()]
    settled = list(model.centres)
    for r in again:
        settled[r["cluster"]] = r
    moved = clustering._nearest_centre(settled, numeric, category, 1.0)["cluster"] != F.col("cluster")
    centres = clustering.prototype_centres(shop.spark, model).select("cluster", F.struct(*numeric, category).alias("centre"))
    cost = sum((F.pow(F.col(c) - F.col(f"centre.{c}"), 2) for c in numeric), F.when(F.col(category).eqNullSafe(F.col(f"centre.{category}")), 0.0).otherwise(1.0))
    listed = centres.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()
    every = placed.withColumn("moved", moved).select("*", F.explode(listed).alias("_c"))
    every = every.select(PERSON, F.col("cluster").alias("own"), "moved", *numeric, category, "_c.cluster", "_c.centre").withColumn("cost", cost)
    judged = every.groupBy(PERSON, "moved").agg(F.min("cost").alias("least"), F.max(F.when(F.col("own") == F.col("cluster"), F.col("cost"))).alias("paid"))
    judged = judged.join(held.withColumn("side", F.lit("test")), PERSON, "left").fillna("train", ["side"])
    return judged.groupBy("side").agg(_counted("rows"), _never(F.col("paid") > F.col("least") + 1e-9).alias("dearer"), _never(F.col("moved")).alias("moved"))


_PROTOTYPE_ONE = f"""(SELECT {' + '.join(f'CASE WHEN stddev_pop("{c}") > 0 THEN count("{c}") ELSE 0 END' for c in SCALED)} + count(*) * var_pop(coalesce("lambda", 0)) + count(*) FROM y_clustering)
 - (SELECT max(n) FROM (SELECT count(*) AS n FROM y_clustering WHERE cat IS NOT NULL GROUP BY cat))"""


@query("k_prototypes_elbow", f"SELECT CAST(k AS INTEGER) AS k, round({_PROTOTYPE_ONE}, 4) AS total, true AS below FROM range(1, 8) r(k)", YEAR)
def _(shop):
    """The cost around one centre, and that no number of centres costs more."""
    costs = cut_lineage(clustering.prototype_elbow(_prototype_rows(shop)[0]))
    total = costs.where("k = 1").select("cost").scalar()
    return costs.select("k", F.round(total, 4).alias("total"), (F.col("cost") <= total * (1 + 1e-9)).alias("below"))


# --- classifiers -------------------------------------------------------------------------------


def _label_counts(predicted, label):
    """Rows per true label of a confusion table."""
    table = models.confusion(predicted, label, "prediction")
    return table.select("label", (F.col("predicted_0") + F.col("predicted_1")).alias("rows"))


_TEST_LABELS = "SELECT retention AS label, count(*) AS rows FROM y_parts WHERE part = 'test' GROUP BY 1"


@query("retention_forest", _TEST_LABELS, YEAR)
def _(shop):
    parts = _parts(shop)
    model = models.retention_forest(_part(parts, "train"))
    return _label_counts(models.predict(model, _part(parts, "test"), models.HISTORY), "retention")


@query("retention_boosting", f"SELECT *, true AS better FROM ({_TEST_LABELS})", YEAR)
def _(shop):
    """It sees the age that decides the label, so it must beat the commoner label."""
    parts = _parts(shop)
    model = models.retention_boosting(_part(parts, "train"))
    scored = cut_lineage(models.predict(model, _part(parts, "test"), [*models.HISTORY, "days_after_order"]))
    right = scored.agg(F.avg((F.col("retention") == F.col("prediction")).cast("double")) >= F.greatest(F.avg("retention"), 1 - F.avg("retention"))).scalar()
    return _label_counts(scored, "retention").withColumn("better", right)


def _consistent(scored, *columns):
    """Rows with whether the predicted label is the likelier one."""
    likely = F.col("probability").between(0, 1) & ((F.col("probability") > 0.5).cast("int") == F.col("prediction"))
    return scored.select(PERSON, *columns, (likely | (F.col("probability") == 0.5)).alias("consistent"))


@query("several_orders_model", f"SELECT {PERSON}, retention, true AS consistent FROM y_parts WHERE part = 'test'", YEAR)
def _(shop):
    parts = _parts(shop)
    model = models.SeveralOrdersModel.fit(_part(parts, "train"), _part(parts, "valid"))
    return _consistent(model.transform(_part(parts, "test")), "retention")


def _single_rows(shop):
    rows = features.one_order_input(people.base(shop), people.today(shop))
    return shop.once("single", lambda: rows.withColumn("retention", churn.fixed_label(F.col("days_after_order"))))


@query("one_order_model", f"SELECT {PERSON}, retention, true AS consistent FROM y_single WHERE side = 'test'", YEAR)
def _(shop):
    train, test = models.random_split(_single_rows(shop))
    model = models.one_order_regression(train)
    return _consistent(models.predict(model, test, models.ONE_ORDER), "retention")


def _order_rows(shop, clustered):
    """The last session of each clustered person with the order features and the cluster."""
    last = sessions.last_session(people.year_sessions(shop))
    rows = features.order_features(last, centroids(shop), people.today(shop))
    return rows.join(clustered.select(PERSON, "class", "cluster"), PERSON)


def _cluster_model(shop):
    train, test = _clustered(shop)
    rows = shop.once("order_rows", lambda: _order_rows(shop, train))
    return models.cluster_forest(rows, people.CATEGORIES), rows, test, clustering.cluster_shares(train)


@query("cluster_forest", "SELECT count(*) AS rows FROM y_split WHERE side = 'test'", YEAR)
def _(shop):
    model, _, test, _ = _cluster_model(shop)
    scored = models.predict_clusters(model, _order_rows(shop, test), people.CATEGORIES)
    table = models.confusion(scored, "cluster", "predicted", range(1, CLUSTERS + 1))
    return table.agg(F.sum(sum(F.col(f"predicted_{c}") for c in range(1, CLUSTERS + 1))).alias("rows"))


@query("cluster_share_model", f"SELECT {PERSON}, class, true AS consistent FROM y_split WHERE side = 'test'", YEAR)
def _(shop):
    model, rows, test, shares = _cluster_model(shop)
    stage = models.share_regression(models.predict_clusters(model, rows, people.CATEGORIES), shares)
    held = models.with_share(models.predict_clusters(model, _order_rows(shop, test), people.CATEGORIES), shares)
    return _consistent(models.predict(stage, held, ["time_delta", "rfc"]), "class")


# --- scoring -----------------------------------------------------------------------------------


def _one_order_rows(shop):
    """Order features of one-order people, from the sessions the clusters were built on."""
    rows = features.one_order_rows(people.dataset(shop), people.year_sessions(shop))
    return shop.once("one_order", lambda: features.order_features(rows, centroids(shop), people.today(shop)))


def _scorer(shop):
    """The scorer as loaded from its files; it is fitted and saved once in a query."""
    folder = f"{scratch_path(shop.spark, 'scorer')}"
    train, _ = _clustered(shop)
    rows = shop.once("order_rows", lambda: _order_rows(shop, train))
    fitted = scoring.OneOrderScorer.fit(rows, models.cluster_table(clustering.cluster_shares(train)), people.CATEGORIES)
    fitted.save(folder)
    return fitted, scoring.OneOrderScorer.load(shop.spark, folder)


@query("one_order_scores", f"SELECT {PERSON}, true AS named FROM y_one", YEAR)
def _(shop):
    """Everybody gets a cluster, and the chance and note of the cluster table for it."""
    scorer, _ = _scorer(shop)
    entries = scorer.table.select("cluster", F.col("probability").alias("listed"), F.col("note").alias("word"))
    scored = scorer.transform(_one_order_rows(shop)).join(entries, "cluster", "left")
    return scored.select(PERSON, (F.col("probability").eqNullSafe(F.col("listed")) & F.col("note").eqNullSafe(F.col("word")) & F.col("cluster").isNotNull()).alias("named"))


@query("predicted_cluster_sizes", f"SELECT count(*) AS people, true AS listed FROM y_one", YEAR)
def _(shop):
    scorer, _ = _scorer(shop)
    sizes = clustering.cluster_sizes(scorer.transform(_one_order_rows(shop)).select("cluster"), scorer.table.select("cluster", "probability"))
    return sizes.agg(F.sum("count").alias("people"), F.bool_and(F.col("cluster").between(1, CLUSTERS)).alias("listed"))


_DESCRIBED = ["distance", "payment_value", "review_score", "time_delta"]


@query("predicted_cluster_description", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(CAST(sum({c}) AS DOUBLE), 3) AS total, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, true AS ordered FROM y_features""" for c in _DESCRIBED
), YEAR)
def _(shop):
    """Every predicted cluster described in all columns; counts, sums and ends add up to those of all people."""
    rows = _one_order_rows(shop).withColumn("_row", F.monotonically_increasing_id())
    labelled = shop.once("predicted", lambda: models.predict_clusters(_cluster_model(shop)[0], rows, people.CATEGORIES))
    parts = [clustering.describe(labelled.where(F.col("predicted") == c), _DESCRIBED) for c in range(1, CLUSTERS + 1)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = (F.col("min") <= F.col("q25")) & (F.col("q25") <= F.col("q50")) & (F.col("q50") <= F.col("q75")) & (F.col("q75") <= F.col("max"))
    return every.groupBy("column").agg(
        F.sum("count").alias("count"), F.round(F.sum(F.col("count") * F.col("mean")), 3).alias("total"),
        F.round(F.min("min"), 6).alias("min"), F.round(F.max("max"), 6).alias("max"), F.bool_and(ordered).alias("ordered"),
    )


@query("predicted_older_members", f"SELECT {PERSON}, time_delta FROM y_features WHERE time_delta > 100", YEAR)
def _(shop):
    """The long-absent members of each predicted cluster, together."""
    labelled = shop.once("predicted", lambda: models.predict_clusters(_cluster_model(shop)[0], _one_order_rows(shop), people.CATEGORIES))
    older = [clustering.older_members(labelled, c, column="predicted") for c in range(1, CLUSTERS + 1)]
    return older[0].unionByName(older[1]).unionByName(older[2]).select(PERSON, "time_delta")


@query("scored_csv_files", f"SELECT {PERSON}, true AS same FROM y_one", YEAR)
def _(shop):
    """Two files that arrive one after the other, scored by the loaded pipeline and scored once, against one batch."""
    _, scorer = _scorer(shop)
    rows = _one_order_rows(shop).withColumn(PERSON, F.col(PERSON).cast("string"))
    inbox, outbox, checkpoint = (scratch_path(shop.spark, n) for n in ("inbox", "outbox", "seen"))
    later = F.pmod(F.xxhash64(PERSON), F.lit(2)) == 1
    for arrived in (~later, later):
        csv_tables.write_table(rows.where(arrived).select(*scoring.FEATURES.names), inbox, "arrived", "csv", mode="append")
        scoring.score_new_files(shop.spark, scorer, f"{inbox}/arrived.csv", outbox, checkpoint)
    streamed = scoring.score_new_files(shop.spark, scorer, f"{inbox}/arrived.csv", outbox, checkpoint)
    want = scorer.transform(rows).groupBy(*scoring.SCORES).agg(_counted("wanted"))
    got = streamed.groupBy(*scoring.SCORES).agg(_counted("n")).withColumnsRenamed({c: f"_{c}" for c in scoring.SCORES})
    both = want.join(got, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scoring.SCORES], "left")
    both = both.withColumn("same", F.col("wanted").eqNullSafe(F.col("n"))).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "wanted")))
    return both.select(F.col(PERSON).cast("long").alias(PERSON), "same")


@query("saved_models", f"""SELECT 'several orders' AS model, count(*) AS rows, 0 AS different FROM y_parts WHERE part = 'test'
 UNION ALL SELECT 'one order', count(*), 0 FROM y_single WHERE side = 'test' UNION ALL SELECT 'clusters', count(*), 0 FROM y_one""", YEAR)
def _(shop):
    """The three saved models score as they did before they were saved."""
    folder = scratch_path(shop.spark, "model")
    parts = _parts(shop)
    several = models.SeveralOrdersModel.fit(_part(parts, "train"), _part(parts, "valid"))
    several.save(f"{folder}/several")
    train, single = models.random_split(_single_rows(shop))
    one = models.one_order_regression(train)
    one.write().overwrite().save(f"{folder}/one")
    kept, loaded = _scorer(shop)
    rows = _one_order_rows(shop).withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn(PERSON, F.col("_row")))
    pairs = {
        "several orders": [m.transform(_part(parts, "test")) for m in (several, models.SeveralOrdersModel.load(f"{folder}/several"))],
        "one order": [models.predict(m, single, models.ONE_ORDER) for m in (one, models.PipelineModel.load(f"{folder}/one"))],
        "clusters": [m.transform(rows) for m in (kept, loaded)],
    }
    results = []
    for name, (before, after) in pairs.items():
        joined = before.select(PERSON, "probability").join(after.select(PERSON, F.col("probability").alias("again")), PERSON, "left")
        wrong = _never(~F.col("probability").eqNullSafe(F.col("again")))
        results.append(joined.agg(F.lit(name).alias("model"), _counted("rows"), wrong.alias("different")))
    return results[0].unionByName(results[1]).unionByName(results[2])


@query("cluster_table_csv", f"SELECT CAST(cluster AS INTEGER) AS cluster, true AS same FROM range(1, {CLUSTERS + 1}) r(cluster)", YEAR)
def _(shop):
    """The cluster table as written and read back."""
    kept, loaded = _scorer(shop)
    again = loaded.table.select("cluster", F.col("probability").alias("_p"), F.col("note").alias("_n"))
    joined = kept.table.join(again, "cluster", "left")
    return joined.select("cluster", (F.col("probability").eqNullSafe(F.col("_p")) & (F.col("note") == F.col("_n"))).alias("same"))
