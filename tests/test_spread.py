"""Steps that many rounds go over are dealt over all cores."""

from conftest import rows

from patronlens.operators import clustering, linkage
from patronlens.session import spread


def one_task(spark, data, schema):
    return spark.createDataFrame(data, schema).coalesce(1)


def test_spread_deals_a_small_table_over_the_cores(spark):
    dealt = spread(spark.range(1000).coalesce(1))
    assert dealt.rdd.getNumPartitions() > 1 and dealt.count() == 1000


def test_new_centres_are_means_and_commonest_categories(spark):
    data = [(0, 1.0, 2.0, "b"), (0, 1.0, 4.0, "a"), (0, 2.0, 6.0, None), (0, 0.0, 0.0, None), (1, 3.0, 5.0, None)]
    placed = one_task(spark, data, "cluster int, _cost double, x double, cat string")
    got = clustering._new_centres(placed, ["x"], "cat")
    assert rows(got, "cluster", "_cost", "x", "cat") == [(0, 4.0, 3.0, "a"), (1, 3.0, 5.0, None)]


def test_micro_clusters_keep_every_row(spark):
    """Rows that repeat an id were multiplied by the join that brought the micro-clusters back."""
    data = [(i // 2, float(i % 7), "ab"[i % 2]) for i in range(60)]
    points = one_task(spark, data, "id long, x0 double, cat string")
    got = linkage._into_micro(points, 1, 5, 1)
    assert rows(got, "id", "x0", "cat") == sorted(data) and got.select("micro").distinct().count() <= 5
