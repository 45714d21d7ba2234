"""Customer table for clustering, scaling, mixed distances, clusters and what they say about churn."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronlens.functions.keys import most_common
from patronlens.functions.order_stats import exact_quantiles
from patronlens.operators.features import with_distance
from patronlens.operators.sessions import PERSON
from patronlens.session import cut_lineage, spread

# Functions that run in Python workers are sent there by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMERIC = [
    "dist", "score", "recency_days", "total_orders_count", "monetary_value", "avg_order_value",
    "success_rate_percentage", "rfm_1", "rfm_2", "rfm_3", "lambda",
]
CATEGORY = "cat"


def rfm_features(rfm: DataFrame) -> DataFrame:
    """RFM table with the three scores as numbers and money on a log scale."""
    def log(column: str) -> Column:
        return F.log10(F.when(F.col(column) > 0, F.col(column)))

    return rfm.select(
        PERSON, "recency_days", "total_orders_count",
        log("monetary_value").alias("monetary_value"), log("avg_order_value").alias("avg_order_value"),
        F.col("delivered_rate_percentage").alias("success_rate_percentage"),
        *[F.substring("rfm_cell", i, 1).cast("int").alias(f"rfm_{i}") for i in (1, 2, 3)],
    )


def clustering_table(
    repeated: DataFrame, centroids: DataFrame, rfm: DataFrame, labels: DataFrame, parity: bool = False
) -> DataFrame:
    """One row per person with several sessions: mean distance, mean score, category, RFM, rate, class.

    The category is the most frequent one; ``parity`` takes the last in the alphabet.
    """
    placed = with_distance(repeated, centroids)
    per_category = placed.groupBy(PERSON, "upper_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance").alias("dist"),
        F.sum("review_score").alias("score"), F.count("review_score").alias("scores"),
    )
    if parity:
        category = F.max("upper_category")
    else:
        category = F.min_by("upper_category", F.struct(-F.col("n"), F.col("upper_category")))
    people = per_category.groupBy(PERSON).agg(
        (F.sum("dist") / F.sum("n")).alias("dist"),
        (F.sum("score") / F.nullif(F.sum("scores"), F.lit(0))).alias("score"),
        category.alias(CATEGORY),
    )
    classes = labels.select(F.col("id").alias(PERSON), "lambda", "class")
    return people.join(rfm_features(rfm), PERSON).join(classes, PERSON, "left")


# --- scaling and distance ----------------------------------------------------------------------


def standardize(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """Columns minus mean over deviation, both exact and from one pass; a constant column gives 0."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), spread(c).alias("s")).alias(c) for c in columns])).scalar()
    scaled = {c: (F.col(c) - stats[c]["m"]) / F.when(stats[c]["s"] == 0, 1.0).otherwise(stats[c]["s"]) for c in columns}
    return df.withColumns(scaled)


def dummies(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed value, the same columns at training and at scoring time."""
    flags = {f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values}
    return df.withColumns(flags).drop(column)


def gower_ranges(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> Column:
    """Value range of every numeric column, one pass, as a scalar struct."""
    return df.agg(F.struct(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric])).scalar()


def gower(left: Column, right: Column, ranges: Column, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = (CATEGORY,)) -> Column:
    """Mean over columns of |difference| / range (0 on a constant column) and of unequal categories."""
    parts = [F.abs(left[c] - right[c]) / F.nullif(ranges[c], F.lit(0.0)) for c in numeric]
    parts += [F.when(left[c].eqNullSafe(right[c]), 0.0).otherwise(1.0) for c in categorical]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return total / len(parts)


def distance_to_profile(table: DataFrame, group: str, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY) -> DataFrame:
    """Gower distance of each person from the profile of their group (means and commonest category).

    There is one profile per group, so the distances are as many as the people.
    """
    means = table.groupBy(group).agg(*[F.avg(c).alias(c) for c in numeric])
    profile = means.join(most_common(table, [group], category, category), group, "left")
    packed = profile.select(group, F.struct(*numeric, category).alias("_profile"))
    distance = gower(F.struct(*numeric, category), F.col("_profile"), gower_ranges(table, numeric), numeric, [category])
    return table.join(packed, group).select(PERSON, group, distance.alias("distance"))


# --- clusters ----------------------------------------------------------------------------------


def encoder(numeric: Sequence[str] = NUMERIC, category: str | None = CATEGORY) -> list:
    """Stages that scale the numbers and one-hot the category into ``features``."""
    stages = [
        VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="error"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]
    inputs = ["_scaled"]
    if category:
        stages += [
            StringIndexer(inputCol=f"_{category}", outputCol="_category", handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCol="_category", outputCol="_onehot", dropLast=False, handleInvalid="keep"),
        ]
        inputs.append("_onehot")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def complete(table: DataFrame, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY) -> DataFrame:
    """Numbers as doubles with 0 for null (the mean of a standardised column) and a category that is never empty."""
    filled = table.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    return filled.withColumn(f"_{category}", F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unmapped")))


def unit_points(table: DataFrame, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY, id_col: str = PERSON) -> DataFrame:
    """``id``, ``cat`` and the completed numbers over their range as ``x0, x1, ...``; a constant column gives 0."""
    rows = complete(table, numeric, category)
    ends = rows.agg(F.struct(*[F.struct(F.min(c).alias("low"), F.nullif(F.max(c) - F.min(c), F.lit(0.0)).alias("span")).alias(c) for c in numeric])).scalar()
    scaled = [F.coalesce((F.col(c) - ends[c]["low"]) / ends[c]["span"], F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(numeric)]
    return rows.select(F.col(id_col).alias("id"), F.col(f"_{category}").alias("cat"), *scaled)


ITERATIONS, TOLERANCE = 300, 1e-4


def hierarchical(table: DataFrame, k: int = 3, seed: int = 1, iterations: int = ITERATIONS) -> PipelineModel:
    """Top-down hierarchical clusters on scaled numbers and one-hot categories; at most ``iterations`` rounds for each cut."""
    model = BisectingKMeans(k=k, seed=seed, maxIter=iterations, predictionCol="cluster")
    return Pipeline(stages=[*encoder(), model]).fit(complete(table))


def _kmeans(k: int, seed: int, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, **options) -> KMeans:
    """Rounds end when no centre moves farther than ``tolerance``, at the latest after ``iterations``."""
    return KMeans(k=k, seed=seed, maxIter=iterations, tol=tolerance, **options)


def kmeans(table: DataFrame, k: int = 10, seed: int = 1, numeric: Sequence[str] = NUMERIC, iterations: int = ITERATIONS) -> PipelineModel:
    rows = spread(complete(table, numeric).select(*numeric, f"_{CATEGORY}"))
    return Pipeline(stages=[*encoder(numeric), _kmeans(k, seed, iterations, predictionCol="cluster")]).fit(rows)


def assign(model: PipelineModel, table: DataFrame) -> DataFrame:
    """People with their cluster; also the way held-out people get one."""
    return model.transform(complete(table)).select(*table.columns, "cluster")


def elbow(table: DataFrame, ks: Sequence[int] = tuple(range(1, 31)), seed: int = 1) -> DataFrame:
    """Within-cluster sum of squares for each k; k = 1 is the total around the mean."""
    prepared = Pipeline(stages=encoder()).fit(complete(table)).transform(complete(table)).select("features")
    prepared = spread(prepared)
    costs = []
    for k in ks:
        if k == 1:
            wide = prepared.select(F.posexplode(_as_array("features")).alias("i", "x"))
            total = wide.groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("s")).agg(F.sum("s"))
            costs.append((1, float(total.first()[0])))
        else:
            costs.append((k, float(_kmeans(k, seed).fit(prepared).summary.trainingCost)))
    return table.sparkSession.createDataFrame(costs, "k int, cost double")


def _as_array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


class Prototypes(NamedTuple):
    """Centres of mixed rows, what the fitted rows cost around them, and the rounds it took until no row moved."""

    centres: list[dict]
    cost: float
    rounds: int


def _by_frequency(rows: DataFrame, k: int, numeric: Sequence[str], category: str, draw: Column) -> tuple[list, DataFrame]:
    """The ``k`` most frequent categories with their rows, and the first ``k`` different rows of each category by ``_place``."""
    frequent = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), category).limit(k).collect()
    different = rows.groupBy(*numeric, category).agg(draw.alias("_draw"))
    place = F.row_number().over(Window.partitionBy(category).orderBy("_draw", *numeric))
    return frequent, cut_lineage(different.withColumn("_place", place).where(F.col("_place") <= k))


def _frequent_start(rows: DataFrame, k: int, numeric: Sequence[str], category: str, draw: Column, listed: tuple[list, DataFrame] | None = None) -> list[dict]:
    """Centres dealt to categories by how frequent they are, each another row of its category.

    Seats go one by one to the category with the most rows per seat, so at most the ``k`` most frequent
    ones matter. A category with fewer different rows than seats leaves some unfilled. ``listed`` is what
    ``_by_frequency`` gives for ``k`` or more.
    """
    frequent, first = listed or _by_frequency(rows, k, numeric, category, draw)
    frequent = frequent[:k]
    seats = dict.fromkeys(range(len(frequent)), 0)
    for _ in range(min(k, sum(r["n"] for r in frequent))):
        most = max(seats, key=lambda i: (frequent[i]["n"] / (seats[i] + 1), -i))
        seats[most] += 1
    dealt = {frequent[i][category]: n for i, n in seats.items() if n}
    inside = F.lit(False)
    for name, n in dealt.items():
        inside = inside | (F.col(category).eqNullSafe(F.lit(name)) & (F.col("_place") <= n))
    return [r.asDict() for r in first.where(inside).orderBy("_draw", *numeric, category).select(*numeric, category).collect()]


def _drawn_start(rows: DataFrame, k: int, numeric: Sequence[str], category: str, draw: Column) -> list[dict]:
    """``k`` different rows by a hash of the person."""
    different = rows.groupBy(*numeric, category).agg(draw.alias("_draw"))
    return [r.asDict() for r in different.orderBy("_draw", *numeric, category).select(*numeric, category).limit(k).collect()]


def _nearest_centre(centres: Sequence[dict], numeric: Sequence[str], category: str, gamma: float) -> Column:
    """``cost`` and ``cluster`` of the cheapest centre, the first of several.

    Rows are compared with all centres a batch at a time: as an expression over a list of centres, which Spark does
    not compile, a round cost 160 microseconds a row.
    """
    places = [np.array([float(c[n]) for c in centres]) for n in numeric]
    kinds = [c[category] for c in centres]

    @F.pandas_udf("cost double, cluster int")
    def nearest(*columns: pd.Series) -> pd.DataFrame:
        cost = np.zeros((len(columns[0]), len(kinds)))
        for values, place in zip(columns, places):
            cost += (values.to_numpy(np.float64)[:, None] - place) ** 2
        own = columns[-1]
        cost += gamma * ~np.stack([own.isna() if kind is None else own.eq(kind) for kind in kinds], axis=1).astype(bool)
        best = np.where(np.isnan(cost), np.inf, cost).argmin(axis=1)
        return pd.DataFrame({"cost": cost[np.arange(len(best)), best], "cluster": best.astype(np.int32)})

    return nearest(*numeric, category)


def _new_centres(placed: DataFrame, numeric: Sequence[str], category: str) -> DataFrame:
    """Per ``cluster``: the summed ``_cost``, the means and the commonest category, from one pass over the rows."""
    parts = placed.groupBy("cluster", category).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_cost"), *[F.sum(c).alias(c) for c in numeric]
    )
    named = F.when(F.col(category).isNotNull(), F.struct(-F.col("_n"), F.col(category)))
    return parts.groupBy("cluster").agg(
        F.sum("_cost").alias("_cost"), *[(F.sum(c) / F.sum("_n")).alias(c) for c in numeric], F.min(named)[category].alias(category)
    )


class _Fit:
    """Centres on their way: numbers (centres x columns) and codes of categories, with those of the round before and its cost."""

    def __init__(self, centres: np.ndarray, codes: np.ndarray):
        self.centres, self.codes, self.before, self.previous, self.result = centres, codes, None, None, None


def _costs(columns: list[np.ndarray], own: np.ndarray, centres: np.ndarray, codes: np.ndarray, gamma: float) -> np.ndarray:
    """Costs of rows (a column each, and category codes) at all centres, as in ``_nearest_centre``."""
    cost = np.zeros((len(own), len(codes)))
    for values, place in zip(columns, centres.T):
        apart = values[:, None] - place
        apart *= apart
        cost += apart
    cost += gamma * (own[:, None] != codes)
    return cost


def _cheapest(cost: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(cost), np.inf, cost).argmin(axis=1)


#: Rows that meet the centres of all fits at a time, and categories whose rows a task counts before it passes the counts on.
_AT_ONCE, _CATEGORIES = 2048, 4096


def _gathered(coded: DataFrame, fits: list[_Fit], numeric: Sequence[str], gamma: float) -> list:
    """Per centre of all fits: ``centre``, rows ``n``, summed ``cost`` and numbers, and the code of the commonest category, from one pass over the rows."""
    centres, codes = np.concatenate([f.centres for f in fits]), np.concatenate([f.codes for f in fits])
    ends = np.cumsum([0, *[len(f.codes) for f in fits]]).tolist()
    names = [f"s{i}" for i in range(len(numeric))]
    schema = pa.schema([("centre", pa.int32()), ("code", pa.int64()), ("n", pa.int64()), ("cost", pa.float64()), *[(c, pa.float64()) for c in names]])

    def gather(batches):
        k, known = len(codes), {}
        sums, paid, counts = np.zeros((k, len(names))), np.zeros(k), np.zeros((k, 0), dtype=np.int64)

        def counted():
            row, col = np.nonzero(counts)
            nothing = pa.array(np.zeros(len(row)))
            listed = np.array(list(known), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(listed[col] if len(row) else listed[:0]), pa.array(counts[row, col]), *[nothing] * (1 + len(names))], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(names))]
            every = batch.column(len(names)).to_numpy(zero_copy_only=False)
            distinct, place = np.unique(every, return_inverse=True)
            if len(known) and len(known) + len(distinct) > _CATEGORIES:
                yield counted()
                known, counts = {}, np.zeros((k, 0), dtype=np.int64)
            at_code = np.array([known.setdefault(c, len(known)) for c in distinct.tolist()], dtype=np.int64)[place]
            counts = np.pad(counts, ((0, 0), (0, len(known) - counts.shape[1])))
            for at in range(0, len(every), _AT_ONCE):
                part = slice(at, at + _AT_ONCE)
                some = [c[part] for c in columns]
                cost = _costs(some, every[part], centres, codes, gamma)
                taken, lines = np.zeros_like(cost), np.arange(len(cost))
                for first, end in zip(ends, ends[1:]):
                    best = _cheapest(cost[:, first:end]) + first
                    taken[lines, best] = 1
                    paid += np.bincount(best, cost[lines, best], k)
                    counts += np.bincount(best * len(known) + at_code[part], minlength=k * len(known)).reshape(k, -1)
                sums += taken.T @ np.stack(some, axis=1)
        yield counted()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array([None] * k, pa.int64()), pa.array(np.zeros(k, dtype=np.int64)), pa.array(paid), *[pa.array(s) for s in sums.T]], schema=schema
        )

    parts = coded.mapInArrow(gather, ", ".join(["centre int, code long, n long, cost double", *[f"{c} double" for c in names]]))
    # One shuffle for both sums; the tasks have combined their rows already.
    parts = parts.repartition("centre").groupBy("centre", "code").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)])
    named = F.when(F.col("code") >= 0, F.struct(-F.col("n"), F.col("code")))
    return parts.groupBy("centre").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)], F.min(named)["code"].alias("code")).where("n > 0").collect()


def _moved(coded: DataFrame, fits: list[_Fit], gamma: float) -> set[int]:
    """Places of the fits in which a row is in another cluster than the round before."""
    sent = [(f.centres, f.codes, *f.before) for f in fits]

    def compare(batches):
        moved = set()
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            for at in range(0, len(batch), _AT_ONCE):
                some = [c[at: at + _AT_ONCE] for c in columns]
                for i, (centres, codes, old, old_codes) in enumerate(sent):
                    if i not in moved:
                        labels = [_cheapest(_costs(some[:-1], some[-1], *c, gamma)) for c in ((centres, codes), (old, old_codes))]
                        if (labels[0] != labels[1]).any():
                            moved.add(i)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(moved), pa.int32())], names=["fit"])

    return {r["fit"] for r in coded.mapInArrow(compare, "fit int").distinct().collect()}


def _all_settled(rows: DataFrame, starts: list[list[dict]], numeric: Sequence[str], category: str, gamma: float, max_rounds: int) -> list[Prototypes]:
    """Rounds of assignment and new centres until no row changes its cluster, for several starts at once.

    A round of all fits that go on is one pass over the rows. Whether rows moved is asked only when a cost stays: it falls
    whenever centres still follow their rows.
    """
    # Numbers in the order of the names stand for categories, -1 for none.
    names = rows.where(F.col(category).isNotNull()).select(F.col(category).alias("_name")).distinct().orderBy("_name")
    names = cut_lineage(names.withColumn("_code", F.monotonically_increasing_id()))
    coded = rows.join(names, F.col(category) == F.col("_name"), "left")
    coded = cut_lineage(coded.select(*[F.col(c).cast("double").alias(c) for c in numeric], F.coalesce("_code", F.lit(-1)).alias("_code")))
    used = sorted({c[category] for start in starts for c in start if c[category] is not None})
    code_of = {None: -1, **{r["_name"]: r["_code"] for r in names.where(F.col("_name").isin(used)).collect()}}
    fits = [_Fit(np.array([[float(c[n]) for n in numeric] for c in start]).reshape(len(start), len(numeric)), np.array([code_of[c[category]] for c in start], dtype=np.int64)) for start in starts]
    for number in range(1, max_rounds + 1):
        going = [f for f in fits if f.result is None]
        found = {r["centre"]: r for r in _gathered(coded, going, numeric, gamma)}
        first, stays = 0, []
        for fit in going:
            mine = {i: found[first + i] for i in range(len(fit.codes)) if first + i in found}
            first += len(fit.codes)
            fit.total, fit.new = sum(r["cost"] for r in mine.values()), mine
            if fit.previous is not None and fit.total >= fit.previous * (1 - 1e-9):
                stays.append(fit)
        moved = _moved(coded, stays, gamma) if stays else set()
        for i, fit in enumerate(stays):
            if i not in moved:
                fit.result = (fit.total, number)
        for fit in going:
            if fit.result is None:
                fit.before, fit.previous = (fit.centres.copy(), fit.codes.copy()), fit.total
                for i, r in fit.new.items():
                    fit.centres[i] = [r[f"s{j}"] / r["n"] for j in range(len(numeric))]
                    fit.codes[i] = -1 if r["code"] is None else r["code"]
        if all(f.result is not None for f in fits):
            break
    else:
        raise RuntimeError(f"rows still change their cluster after {max_rounds} rounds")
    used = sorted({int(c) for f in fits for c in f.codes})
    name_of = {-1: None, **{r["_code"]: r["_name"] for r in names.where(F.col("_code").isin(used)).collect()}}
    return [Prototypes([{**dict(zip(numeric, map(float, x))), category: name_of[int(c)]} for x, c in zip(f.centres, f.codes)], *f.result) for f in fits]


def _settled(rows: DataFrame, centres: list[dict], numeric: Sequence[str], category: str, gamma: float, max_rounds: int) -> Prototypes:
    """``_all_settled`` from one start."""
    return _all_settled(rows, [centres], numeric, category, gamma, max_rounds)[0]


def fit_all_prototypes(
    table: DataFrame, ks: Sequence[int], gamma: float = 1.0, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY, max_rounds: int = 300, seed: int = 1,
) -> list[Prototypes]:
    """For every number of centres the cheaper of two fits: from centres dealt by category frequency, and from rows drawn at random.

    ``numeric`` should be scaled. Each round assigns rows against the centres, which go to every task, and takes means and
    modes of what the tasks add up; labels are not kept, and only the centres
    come to the driver. Without rows there are no centres.
    """
    rows = spread(complete(table, numeric, category).select(PERSON, *numeric, category))
    draw, most = F.min(F.xxhash64(F.col(PERSON), F.lit(seed))), max(ks, default=0)
    drawn = _drawn_start(rows, most, numeric, category, draw)
    if not drawn:
        return [Prototypes([], 0.0, 0) for _ in ks]
    listed, starts = _by_frequency(rows, most, numeric, category, draw), []
    for k in ks:
        dealt = _frequent_start(rows, k, numeric, category, draw, listed)
        dealt += [c for c in drawn[:k] if c not in dealt][: len(drawn[:k]) - len(dealt)]
        starts += [dealt, drawn[:k]]
    fits = _all_settled(rows, starts, numeric, category, gamma, max_rounds)
    return [min(fits[2 * i: 2 * i + 2], key=lambda f: f.cost) for i in range(len(ks))]


def fit_prototypes(
    table: DataFrame, k: int = 20, gamma: float = 1.0, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY, max_rounds: int = 300, seed: int = 1,
) -> Prototypes:
    """``fit_all_prototypes`` for one number of centres."""
    return fit_all_prototypes(table, [k], gamma, numeric, category, max_rounds, seed)[0]


def assign_prototypes(table: DataFrame, model: Prototypes, gamma: float = 1.0, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY) -> DataFrame:
    """``table`` with the ``cluster`` of its cheapest centre; also the way held-out rows get one. Null without centres."""
    if not model.centres:
        return table.withColumn("cluster", F.lit(None).cast("int"))
    placed = complete(table, numeric, category).withColumn("cluster", _nearest_centre(model.centres, numeric, category, gamma)["cluster"])
    kept = placed.select(F.struct(*[F.col(c) for c in table.columns if c not in numeric]).alias("_row"), "cluster", *numeric)
    return kept.select(*[F.col(c) if c in numeric else F.col(f"_row.{c}").alias(c) for c in table.columns], "cluster")


def prototype_centres(spark: SparkSession, model: Prototypes, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY) -> DataFrame:
    """``cluster``, the numbers and the category of every centre."""
    data = [(i, *[float(c[n]) for n in numeric], c[category]) for i, c in enumerate(model.centres)]
    return spark.createDataFrame(data, ", ".join(["cluster int", *[f"`{n}` double" for n in numeric], f"`{category}` string"]))


def k_prototypes(table: DataFrame, k: int = 20, gamma: float = 1.0, numeric: Sequence[str] = NUMERIC, category: str = CATEGORY, max_rounds: int = 300, seed: int = 1) -> tuple[DataFrame, float]:
    """Clusters of mixed rows and their cost: squared distance plus ``gamma`` per unequal category."""
    model = fit_prototypes(table, k, gamma, numeric, category, max_rounds, seed)
    return assign_prototypes(table, model, gamma, numeric, category), model.cost


def prototype_elbow(table: DataFrame, ks: Sequence[int] = tuple(range(1, 8)), **options) -> DataFrame:
    """The cost for each number of centres; the rounds of all fits go over the rows together."""
    costs = [(k, float(model.cost)) for k, model in zip(ks, fit_all_prototypes(table, ks, **options))]
    return table.sparkSession.createDataFrame(costs, "k int, cost double")


# --- reports -----------------------------------------------------------------------------------


def cluster_shares(clustered: DataFrame, cluster: str = "cluster", label: str = "class") -> DataFrame:
    """Share of active people per cluster, two decimals: the name a cluster goes by."""
    return clustered.groupBy(cluster).agg(F.round(F.avg(label), 2).alias("probability"))


def cluster_sizes(predicted: DataFrame, shares: DataFrame, cluster: str = "cluster") -> DataFrame:
    counts = predicted.groupBy(cluster).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(shares, cluster, "left").orderBy(F.col(cluster).desc())


def describe(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column, exact."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = table.select(F.inline(entries)).where(F.col("value").isNotNull())
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"]).drop("n")
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return stats.join(quartiles, "column").select(
        "column", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("q25", "q50", "q75"))], "max",
    )


def older_members(predicted: DataFrame, cluster: int, age: int = 100, column: str = "cluster") -> DataFrame:
    return predicted.where((F.col(column) == cluster) & (F.col("time_delta") > age))
