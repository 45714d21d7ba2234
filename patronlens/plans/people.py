"""Queries over order features, sessions, histories and churn labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.operators import churn, cleaning, features, sessions
from patronlens.plans.registry import query
from patronlens.plans.tables import centroids
from patronlens.plans.views import VIEWS, draw_sql

CATEGORIES = [f"group_{i}" for i in range(9)] + ["miss"]
_ORDERED = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
EVENT_KINDS = ["view", "click", "purchase", "signup", "error"]
_EVENT_ORDERED = "[" + ", ".join(f"'{c}'" for c in EVENT_KINDS) + "]"

# --- order dataset -----------------------------------------------------------------------------

VIEWS["v_profile"] = """SELECT order_id, max(CASE WHEN best = 1 THEN upper_category END) AS upper_category,
 arg_min(zip, _row) AS seller_zip_code_prefix, CAST(sum(n) AS BIGINT) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price DESC, upper_category) AS best
      FROM (SELECT order_id, coalesce(upper_category, 'miss') AS upper_category, sum(price) AS price, count(*) AS n,
                   min(i._row) AS _row, arg_min(coalesce(seller_zip_code_prefix, 0), i._row) AS zip
            FROM v_items i LEFT JOIN v_upper USING (product_id) LEFT JOIN v_sellers USING (seller_id) GROUP BY 1, 2)) GROUP BY 1"""
VIEWS["v_first_reviews"] = """SELECT order_id, review_score FROM (SELECT *, row_number() OVER (
 PARTITION BY order_id ORDER BY _row, review_score NULLS FIRST) AS i FROM v_reviews) WHERE i = 1"""
VIEWS["v_first_payments"] = """SELECT order_id, payment_value FROM (SELECT *, row_number() OVER (
 PARTITION BY order_id ORDER BY _row, payment_value) AS i FROM v_payments) WHERE i = 1"""
VIEWS["v_scored"] = """SELECT * REPLACE (coalesce(review_score, avg(review_score) OVER ()) AS review_score)
FROM v_profile JOIN v_first_reviews USING (order_id)"""
VIEWS["y_kept"] = """SELECT order_id, order_purchase_timestamp, customer_unique_id, customer_zip_code_prefix
FROM y_orders JOIN y_customers USING (customer_id) WHERE order_status IS NULL OR order_status NOT IN ('unavailable', 'canceled')"""
VIEWS["y_dataset"] = """SELECT order_id, upper_category, CAST(seller_zip_code_prefix AS INTEGER) AS seller_zip_code_prefix, review_score, payment_value,
 order_purchase_timestamp, customer_unique_id, customer_zip_code_prefix
FROM v_scored JOIN v_first_payments USING (order_id) JOIN y_kept USING (order_id)"""
VIEWS["y_several"] = "SELECT * EXCLUDE (people) FROM (SELECT *, count(*) OVER (PARTITION BY customer_unique_id) AS people FROM y_dataset) WHERE people > 1"


def product_upper(shop):
    return cleaning.product_categories(shop.products(), shop.translation(), shop.category_tree())


def dataset(shop):
    return shop.once("dataset", lambda: features.order_dataset(
        shop.items(), product_upper(shop), shop.sellers(), shop.reviews(), shop.payments(), shop.orders(), shop.customers()
    ))


def today(shop):
    return features.reference_date(shop.orders())


def _scores(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("reference_date", "SELECT max(order_purchase_timestamp) AS today FROM v_orders")
def _(shop):
    return shop.orders().agg(F.max("order_purchase_timestamp").alias("today"))


@query("order_category", "SELECT order_id, upper_category FROM v_profile")
def _(shop):
    return features.order_profile(shop.items(), product_upper(shop), shop.sellers()).select("order_id", "upper_category")


@query("order_first_seller", "SELECT order_id, CAST(seller_zip_code_prefix AS INTEGER) AS seller_zip_code_prefix FROM v_profile")
def _(shop):
    return features.order_profile(shop.items(), product_upper(shop), shop.sellers()).select("order_id", "seller_zip_code_prefix")


@query("order_item_counts", "SELECT order_id, items FROM v_profile")
def _(shop):
    return features.order_profile(shop.items(), product_upper(shop), shop.sellers()).select("order_id", "items")


@query("order_scores", "SELECT order_id, round(review_score, 6) AS review_score FROM v_scored")
def _(shop):
    profile = features.order_profile(shop.items(), product_upper(shop), shop.sellers())
    return _scores(features.scored_orders(profile, shop.items(), shop.reviews()).select("order_id", "review_score"), "review_score")


@query("order_first_payment", "SELECT * FROM v_first_payments")
def _(shop):
    return features.first_payments(shop.payments())


@query("kept_orders", "SELECT * FROM y_kept", person="customer_year")
def _(shop):
    return features.kept_orders(shop.orders(), shop.customers())


@query("order_dataset", "SELECT * REPLACE (round(review_score, 6) AS review_score) FROM y_dataset", person="customer_year")
def _(shop):
    return _scores(dataset(shop), "review_score")


@query("one_order_people", """SELECT order_id, customer_unique_id FROM (SELECT *, count(*) OVER (PARTITION BY customer_unique_id) AS n FROM y_dataset) WHERE n = 1""", person="customer_year")
def _(shop):
    return features.split_people(dataset(shop))[0].select("order_id", "customer_unique_id")


@query("several_order_people", "SELECT order_id, customer_unique_id FROM y_several", person="customer_year")
def _(shop):
    return features.split_people(dataset(shop))[1].select("order_id", "customer_unique_id")


# --- sessions ----------------------------------------------------------------------------------


def _walk(source: str) -> str:
    return f"""WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS rn FROM {source}),
 walk(customer_unique_id, rn, anchor) AS (
  SELECT customer_unique_id, rn, order_purchase_timestamp FROM seq WHERE rn = 1 UNION ALL
  SELECT s.customer_unique_id, s.rn, CASE WHEN s.order_purchase_timestamp >= w.anchor + INTERVAL 24 HOUR THEN s.order_purchase_timestamp ELSE w.anchor END
  FROM walk w JOIN seq s ON s.customer_unique_id = w.customer_unique_id AND s.rn = w.rn + 1)
 SELECT seq.*, anchor FROM seq JOIN walk USING (customer_unique_id, rn)"""


def _collapse(source: str, order: str) -> str:
    return f"""SELECT s.customer_unique_id, s.anchor AS order_purchase_timestamp, upper_category, payment_value, review_score,
 CAST(seller AS INTEGER) AS seller_zip_code_prefix, CAST(buyer AS INTEGER) AS customer_zip_code_prefix, orders
FROM (SELECT customer_unique_id, anchor, sum(payment_value) AS payment_value, avg(review_score) AS review_score, count(*) AS orders,
             arg_min(seller_zip_code_prefix, rn) AS seller, arg_min(customer_zip_code_prefix, rn) AS buyer FROM {source} GROUP BY 1, 2) s
JOIN (SELECT customer_unique_id, anchor, upper_category, row_number() OVER (PARTITION BY customer_unique_id, anchor
        ORDER BY sum(payment_value) DESC, coalesce(list_position({order}, upper_category), 99), upper_category) AS best
      FROM {source} GROUP BY 1, 2, 3) c ON c.customer_unique_id = s.customer_unique_id AND c.anchor = s.anchor AND best = 1"""


def _trailing(source: str) -> str:
    return f"""SELECT * EXCLUDE (last_rn, first_rn) FROM (SELECT *, max(rn) OVER (PARTITION BY customer_unique_id) AS last_rn,
 min(rn) OVER (PARTITION BY customer_unique_id, anchor) AS first_rn FROM {source}) WHERE rn < last_rn OR rn = first_rn"""


VIEWS["v_event_walk"] = _walk("v_event_orders")
VIEWS["v_event_sessions"] = _collapse("v_event_walk", _EVENT_ORDERED)
VIEWS["v_event_parity"] = _collapse(f"({_trailing('v_event_walk')})", _EVENT_ORDERED)
VIEWS["y_walk"] = _walk("y_several")
VIEWS["y_sessions"] = _collapse("y_walk", _ORDERED)
VIEWS["y_one"] = """SELECT * FROM y_dataset WHERE customer_unique_id NOT IN (
 SELECT customer_unique_id FROM y_sessions GROUP BY 1 HAVING count(*) > 1)"""
for _g, _s in (("v_event", "v_event_sessions"), ("y", "y_sessions")):
    VIEWS[f"{_g}_repeated"] = f"""SELECT s.*, count, same FROM {_s} s JOIN (
 SELECT customer_unique_id, CAST(sum(n) AS BIGINT) AS count, max(n) AS same FROM (
  SELECT customer_unique_id, upper_category, count(*) AS n FROM {_s} GROUP BY 1, 2) GROUP BY 1 HAVING count > 1) USING (customer_unique_id)"""

_SESSION = "* REPLACE (round(payment_value, 4) AS payment_value, round(review_score, 6) AS review_score)"


def _event_sessions(shop, **options):
    return sessions.anchored_sessions(shop.event_orders(), category_order=EVENT_KINDS, **options)


def _rounded_sessions(df):
    return df.withColumns({"payment_value": F.round("payment_value", 4), "review_score": F.round("review_score", 6)})


def year_sessions(shop):
    return shop.once("sessions", lambda: sessions.anchored_sessions(
        features.split_people(dataset(shop))[1], category_order=CATEGORIES
    ))


def repeated(shop):
    return shop.once("repeated", lambda: sessions.repeated_sessions(year_sessions(shop)))


@query("session_anchors", "SELECT order_id, anchor FROM v_event_walk")
def _(shop):
    return sessions.with_anchors(shop.event_orders()).select("order_id", "anchor")


@query("anchored_sessions", f"SELECT {_SESSION} FROM v_event_sessions")
def _(shop):
    return _rounded_sessions(_event_sessions(shop))


@query("anchored_sessions_parity", f"SELECT {_SESSION} FROM v_event_parity")
def _(shop):
    return _rounded_sessions(_event_sessions(shop, parity=True))


@query("anchored_sessions_long_runs", f"SELECT {_SESSION} FROM v_event_sessions")
def _(shop):
    """The same sessions with every run taking the way of the long ones."""
    return _rounded_sessions(_event_sessions(shop, fold_limit=0))


@query("year_sessions", f"SELECT {_SESSION} FROM y_sessions", person="customer_year")
def _(shop):
    return _rounded_sessions(year_sessions(shop))


@query("one_order_rows", "SELECT order_id, customer_unique_id FROM y_one", person="customer_year")
def _(shop):
    return features.one_order_rows(dataset(shop), year_sessions(shop)).select("order_id", "customer_unique_id")


@query("repeated_sessions", f"SELECT {_SESSION} FROM v_event_repeated")
def _(shop):
    return _rounded_sessions(sessions.repeated_sessions(_event_sessions(shop)))


@query("last_sessions", f"""SELECT {_SESSION} FROM (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (
 PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp DESC) AS i FROM v_event_sessions) WHERE i = 1)""")
def _(shop):
    return _rounded_sessions(sessions.last_session(_event_sessions(shop)))


# --- one-order features ------------------------------------------------------------------------

VIEWS["y_features"] = """SELECT order_id, customer_unique_id, coalesce(sqrt(pow(s.lat_d_mean - c.lat_d_mean, 2) + pow(s.lng_d_mean - c.lng_d_mean, 2)), 0) AS distance,
 log10(payment_value) AS payment_value, review_score, CAST(date_sub('day', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM y_orders)) AS INTEGER) AS time_delta, upper_category
FROM y_one LEFT JOIN v_centroids s ON s.geolocation_zip_code_prefix = seller_zip_code_prefix
LEFT JOIN v_centroids c ON c.geolocation_zip_code_prefix = customer_zip_code_prefix"""


@query("order_distances", """SELECT order_id, round(coalesce(sqrt(pow(s.lat_d_mean - c.lat_d_mean, 2) + pow(s.lng_d_mean - c.lng_d_mean, 2)), 0), 8) AS distance
 FROM y_dataset LEFT JOIN v_centroids s ON s.geolocation_zip_code_prefix = seller_zip_code_prefix
 LEFT JOIN v_centroids c ON c.geolocation_zip_code_prefix = customer_zip_code_prefix""", person="customer_year")
def _(shop):
    placed = features.with_distance(dataset(shop), centroids(shop))
    return placed.select("order_id", F.round("distance", 8).alias("distance"))


@query("order_ages", """SELECT order_id, CAST(date_sub('day', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM v_event_orders)) AS INTEGER) AS time_delta,
 round(log10(CASE WHEN payment_value > 0 THEN payment_value END), 8) AS payment_value FROM v_event_orders""")
def _(shop):
    events = shop.event_orders()
    aged = features.order_features(events.withColumn("customer_unique_id", F.col("order_id")), centroids(shop), features.reference_date(events))
    return aged.select(F.col("customer_unique_id").alias("order_id"), "time_delta", F.round("payment_value", 8).alias("payment_value"))


@query("one_order_features", """SELECT customer_unique_id, round(distance, 6) AS distance, round(payment_value, 6) AS payment_value,
 round(review_score, 6) AS review_score, time_delta, upper_category FROM y_features""", person="customer_year")
def _(shop):
    table = features.one_order_features(dataset(shop), centroids(shop), today(shop), category_order=CATEGORIES)
    return _scores(table, "distance", "payment_value", "review_score")


# --- histories ---------------------------------------------------------------------------------

VIEWS["y_base"] = """SELECT order_id, order_purchase_timestamp, customer_unique_id, review_score, payment_value FROM (
 SELECT order_id, order_purchase_timestamp, customer_unique_id, coalesce(r.review_score, avg(r.review_score) OVER ()) AS review_score
 FROM y_kept LEFT JOIN v_reviews r USING (order_id)) JOIN v_first_payments USING (order_id)"""
VIEWS["y_prefixes"] = """SELECT customer_unique_id, order_id, order_purchase_timestamp, rn AS orders_count, n AS history_length,
 review_score AS last_score, payment_value AS last_payment, CAST(date_sub('day', prev, order_purchase_timestamp) AS INTEGER) AS last_days_between_orders,
 mean_score, mean_payment, CASE WHEN rn > 2 THEN date_sub('day', first, prev) / CAST(rn - 2 AS DOUBLE) END AS mean_days_between_orders,
 CAST(date_sub('day', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM y_orders)) AS INTEGER) AS days_after_order
FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY customer_unique_id) AS n, lag(order_purchase_timestamp) OVER w AS prev,
        first_value(order_purchase_timestamp) OVER w AS first,
        avg(review_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_score,
        avg(payment_value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_payment
      FROM y_base WINDOW w AS (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id, review_score))"""
_PREFIX = """* REPLACE (round(last_score, 6) AS last_score, round(mean_score, 6) AS mean_score, round(mean_payment, 6) AS mean_payment,
 round(mean_days_between_orders, 6) AS mean_days_between_orders)"""
_LABEL = "CASE WHEN orders_count = history_length AND days_after_order >= 231 THEN 0 ELSE 1 END AS retention"


def base(shop):
    return features.order_base(shop.orders(), shop.customers(), shop.reviews(), shop.payments())


def _rounded_prefixes(df):
    return df.withColumns({
        "last_score": F.round("last_score", 6), "mean_score": F.round("mean_score", 6),
        "mean_payment": F.round("mean_payment", 6), "mean_days_between_orders": F.round("mean_days_between_orders", 6),
    })


@query("order_base", "SELECT * REPLACE (round(review_score, 6) AS review_score) FROM y_base", person="customer_year")
def _(shop):
    return _scores(base(shop), "review_score")


@query("history_prefixes", f"SELECT {_PREFIX} FROM y_prefixes", person="customer_year")
def _(shop):
    return _rounded_prefixes(features.prefixes(base(shop), today(shop)))


@query("history_prefixes_split", f"SELECT {_PREFIX} FROM y_prefixes", person="customer_year")
def _(shop):
    """The same features; kept under its name."""
    return _rounded_prefixes(features.prefixes(base(shop), today(shop)))


@query("history_labels", f"SELECT {_PREFIX}, {_LABEL} FROM y_prefixes", person="customer_year")
def _(shop):
    return _rounded_prefixes(features.history_dataset(base(shop), today(shop)))


@query("whole_histories", f"SELECT {_PREFIX}, {_LABEL} FROM y_prefixes WHERE orders_count = history_length", person="customer_year")
def _(shop):
    return _rounded_prefixes(features.history_dataset(base(shop), today(shop), expand=False))


@query("sampled_histories", f"""SELECT {_PREFIX}, {_LABEL} FROM y_prefixes WHERE orders_count = history_length AND (history_length > 1 OR customer_unique_id IN (
 SELECT customer_unique_id FROM y_prefixes WHERE history_length = 1 ORDER BY {draw_sql("customer_unique_id", 1)}, customer_unique_id LIMIT 100))""", person="customer_year")
def _(shop):
    return _rounded_prefixes(features.history_dataset(base(shop), today(shop), expand=False, keep_one_order=100))


@query("several_order_input", f"SELECT {_PREFIX} FROM y_prefixes WHERE orders_count = history_length AND orders_count > 1", person="customer_year")
def _(shop):
    return _rounded_prefixes(features.several_order_input(base(shop), today(shop)))


@query("one_order_input", """SELECT customer_unique_id, round(last_score, 6) AS review_score, last_payment AS payment_value, days_after_order
 FROM y_prefixes WHERE history_length = 1""", person="customer_year")
def _(shop):
    return _scores(features.one_order_input(base(shop), today(shop)), "review_score")


@query("retention_counts", f"SELECT retention, count(*) AS count FROM (SELECT {_LABEL} FROM y_prefixes WHERE orders_count = history_length) GROUP BY 1", person="customer_year")
def _(shop):
    return churn.class_counts(features.history_dataset(base(shop), today(shop), expand=False), "retention")


@query("fixed_labels", """SELECT customer_unique_id, CASE WHEN days_after_order >= 231 THEN 0 ELSE 1 END AS retention
 FROM y_prefixes WHERE history_length = 1""", person="customer_year")
def _(shop):
    rows = features.one_order_input(base(shop), today(shop))
    return rows.select("customer_unique_id", churn.fixed_label(F.col("days_after_order")).alias("retention"))


def _shares(source: str) -> str:
    return f"SELECT upper_category, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM {source} GROUP BY 1"


@query("category_shares", _shares("y_dataset"), person="customer_year")
def _(shop):
    return features.category_shares(dataset(shop)).withColumn("share", F.round("share", 8))


@query("category_shares_several", _shares("y_repeated"), person="customer_year")
def _(shop):
    return features.category_shares(repeated(shop)).withColumn("share", F.round("share", 8))


@query("category_shares_one", _shares("y_one"), person="customer_year")
def _(shop):
    return features.category_shares(features.one_order_rows(dataset(shop), year_sessions(shop))).withColumn("share", F.round("share", 8))


# --- churn -------------------------------------------------------------------------------------


def _churn_views(g: str, orders: str) -> None:
    VIEWS[f"{g}_spans"] = f"""SELECT customer_unique_id, upper_category, count(*) AS n, min(order_purchase_timestamp) AS low,
 max(order_purchase_timestamp) AS high, any_value(count) AS count FROM {g}_repeated GROUP BY 1, 2"""
    VIEWS[f"{g}_gaps"] = f"""SELECT upper_category, date_sub('second', low, high) / 86400.0 / (n - 1) AS gap FROM {g}_spans
WHERE count < 4 AND n > 1 AND date_sub('second', low, high) / 86400.0 > 0.333"""
    VIEWS[f"{g}_lambdas"] = f"SELECT upper_category, count(*) / sum(gap) AS rate FROM {g}_gaps GROUP BY 1"
    VIEWS[f"{g}_labels"] = f"""SELECT id, rate AS "lambda", exp(-rate * days) AS val, CASE WHEN exp(-rate * days) < 0.1 THEN 0 WHEN rate * days IS NOT NULL THEN 1 END AS class FROM (
 SELECT t.customer_unique_id AS id,
  CASE WHEN t.n > 3 THEN (t.n - 1) / CAST(nullif(date_sub('day', t.low, t.high), 0) AS DOUBLE)
       WHEN t.n > 1 THEN coalesce(l.rate, (SELECT count(*) / sum(gap) FROM {g}_gaps))
       ELSE coalesce(m.rate, (SELECT count(*) / sum(gap) FROM {g}_gaps)) END AS rate,
  date_sub('day', m.last, (SELECT max(order_purchase_timestamp) FROM {orders})) AS days
 FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, upper_category) AS i FROM {g}_spans) t
 LEFT JOIN {g}_lambdas l USING (upper_category)
 JOIN (SELECT customer_unique_id, avg(rate) AS rate, max(high) AS last FROM {g}_spans LEFT JOIN {g}_lambdas USING (upper_category) GROUP BY 1) m
   ON m.customer_unique_id = t.customer_unique_id WHERE t.i = 1)"""


_churn_views("v_event", "v_event_orders")
_churn_views("y", "y_orders")
_LABELS = 'SELECT id, round("lambda", 8) AS "lambda", round(val, 6) AS val, class FROM '


def _rounded_labels(df):
    return df.withColumns({"lambda": F.round("lambda", 8), "val": F.round("val", 6)})


@query("category_rates", "SELECT upper_category, round(rate, 8) AS rate FROM y_lambdas", person="customer_year")
def _(shop):
    return churn.category_rates(repeated(shop)).withColumn("rate", F.round("rate", 8))


@query("thrice_same_category", "SELECT count(DISTINCT customer_unique_id) AS people FROM y_repeated WHERE same = 3", person="customer_year")
def _(shop):
    return churn.thrice_same(repeated(shop))


@query("poisson_churn", _LABELS + "y_labels", person="customer_year")
def _(shop):
    return _rounded_labels(churn.poisson_labels(repeated(shop), today(shop)))


@query("poisson_churn_events", _LABELS + "v_event_labels")
def _(shop):
    events = shop.event_orders()
    return _rounded_labels(churn.poisson_labels(sessions.repeated_sessions(_event_sessions(shop)), features.reference_date(events)))


@query("churn_class_counts", "SELECT class, count(*) AS count FROM y_labels GROUP BY 1", person="customer_year")
def _(shop):
    return churn.class_counts(churn.poisson_labels(repeated(shop), today(shop)))
