"""SQL counterparts of the registered queries, on the given tables.

Numbers are rounded by ``floor(x * 10^n + 0.5) / 10^n`` on both sides: engines settle decimal ties of
their ``round`` differently.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# The mappings of shelfcast.plans.tables.
SALES = """sales AS (
  SELECT l_shipdate AS date, l_partkey AS product_id, l_suppkey AS store_id, l_quantity AS quantity,
         l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_extendedprice
  FROM lineitem)"""
DAILY = """daily AS (
  SELECT l_partkey AS product_id, l_shipdate AS date, sum(l_quantity) AS quantity,
         sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem GROUP BY l_partkey, l_shipdate)"""
REQUESTS = """requests AS (
  SELECT event_id, ts, user_id AS client, 'POST' AS method, event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 1000 AS latency_s
  FROM events)"""
LABEL_ORDER = "date, product_id, store_id, l_orderkey, l_linenumber, l_extendedprice, quantity"
STORE_ORDER = "date, product_id, l_orderkey, l_linenumber, l_extendedprice, quantity"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def holiday_days(column: str, holidays: tuple[str, ...]) -> str:
    """Whole days to the nearest holiday, from microseconds."""
    terms = [f"abs(epoch_us({column}) - epoch_us(TIMESTAMP '{h}')) // 86400000000" for h in holidays]
    return f"least({', '.join(terms)})"


def calendar(d: str, holidays: tuple[str, ...]) -> str:
    distance = holiday_days(d, holidays)
    last = f"({d}::DATE = last_day({d}))"
    columns = {
        "day_of_week": f"isodow({d}) - 1",
        "day_of_month": f"day({d})",
        "day_of_year": f"dayofyear({d})",
        "week_of_year": f"week({d})",
        "month": f"month({d})",
        "quarter": f"quarter({d})",
        "year": f"year({d})",
        "is_weekend": f"(isodow({d}) >= 6)",
        "is_month_start": f"(day({d}) = 1)",
        "is_month_end": last,
        "is_quarter_start": f"(day({d}) = 1 AND month({d}) IN (1, 4, 7, 10))",
        "is_quarter_end": f"({last} AND month({d}) IN (3, 6, 9, 12))",
        "days_until_holiday": distance,
        "weeks_until_holiday": f"({distance}) // 7",
    }
    return ",\n  ".join(f"CAST({e} AS INTEGER) AS {name}" for name, e in columns.items())


def seasonal_columns(d: str, places: int = 4) -> str:
    month, week = f"2 * pi() * month({d}) / 12", f"2 * pi() * (isodow({d}) - 1) / 7"
    parts = [("month_sin", f"sin({month})"), ("month_cos", f"cos({month})"),
             ("day_of_week_sin", f"sin({week})"), ("day_of_week_cos", f"cos({week})")]
    return ", ".join(f"floor(({e}) * 1e{places} + 0.5) / 1e{places} AS {n}" for n, e in parts)


def rolling(column: str, size: int, statistic: str, name: str | None = None, places: int = 4, needed: int | None = None,
            frame: str | None = None) -> str:
    f = frame or f"f{size}"
    functions = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return (f"floor((CASE WHEN count({column}) OVER {f} >= {size if needed is None else needed} "
            f"THEN {functions[statistic]}({column}) OVER {f} END) * 1e{places} + 0.5) / 1e{places} AS "
            f"{name or f'{column}_roll_{statistic}_{size}'}")


def frames(partition: str, order: str, sizes: tuple[int, ...]) -> str:
    parts = [f"w AS (PARTITION BY {partition} ORDER BY {order})"]
    parts += [f"f{n} AS (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
              for n in sizes]
    return "WINDOW " + ",\n  ".join(parts)


def lag(column: str, k: int, places: int = 4) -> str:
    return f"floor((lag({column}, {k}) OVER w) * 1e{places} + 0.5) / 1e{places} AS {column}_lag_{k}"


def daily(columns: list[str], sizes: tuple[int, ...] = (), with_price: bool = False) -> str:
    price = "floor((price) * 1e4 + 0.5) / 1e4 AS price, " if with_price else ""
    return f"""WITH {DAILY}
SELECT product_id, {stamp('date')} AS date, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, {price}
  {", ".join(columns)}
FROM daily {frames('product_id', 'date', sizes)}"""


SALES_HOLIDAYS = ("1996-12-25", "1998-07-04", "2000-01-01", "2001-11-22")
EVENT_HOLIDAYS = ("2024-01-01", "2024-07-04", "2024-11-28", "2024-12-25")

ORACLES["time_features"] = f"SELECT o_orderkey, {calendar('o_orderdate', SALES_HOLIDAYS)} FROM orders"
ORACLES["holiday_distance"] = f"""SELECT event_id,
  CAST({holiday_days('ts', EVENT_HOLIDAYS)} AS INTEGER) AS days_until_holiday,
  CAST(({holiday_days('ts', EVENT_HOLIDAYS)}) // 7 AS INTEGER) AS weeks_until_holiday
FROM events"""
ORACLES["seasonal"] = f"SELECT o_orderkey, {seasonal_columns('o_orderdate')} FROM orders"

ORACLES["lag_features"] = daily([lag("quantity", k) for k in (1, 7, 14, 30)])
ORACLES["price_lags"] = daily(
    [lag("quantity", k) for k in (1, 7, 14, 30)] + [lag("price", k) for k in (1, 7, 14)], with_price=True)
ORACLES["price_lags_all"] = f"""WITH {DAILY}
SELECT product_id, {stamp('date')} AS date, {", ".join(lag("price", k) for k in (1, 7, 14, 30))}
FROM daily {frames('product_id', 'date', ())}"""
ORACLES["rolling_mean"] = daily([rolling("quantity", n, "mean") for n in (7, 14, 30)], (7, 14, 30))
ORACLES["rolling_std"] = daily([rolling("quantity", n, "std") for n in (7, 14, 30)], (7, 14, 30))
ORACLES["rolling_min_max"] = daily(
    [rolling("quantity", n, s) for n in (7, 14, 30) for s in ("min", "max")], (7, 14, 30))
ORACLES["rolling_price"] = daily([rolling("price", n, "mean") for n in (7, 14, 30)], (7, 14, 30), with_price=True)
ORACLES["rolling_min_periods"] = daily(
    [rolling("quantity", n, s, needed=1) for n in (7, 14) for s in ("mean", "std", "min", "max")], (7, 14))

ORACLES["store_rows_history"] = ORACLES["store_rows_history_chunked"] = f"""WITH {SALES}
SELECT {stamp('date')} AS date, product_id, store_id, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, l_orderkey, l_linenumber,
  {lag("quantity", 1)}, {lag("quantity", 30)},
  {", ".join(rolling("quantity", 90, s) for s in ("mean", "std", "min", "max"))}
FROM sales {frames('store_id', STORE_ORDER, (90,))}"""
ORACLES["product_store_history"] = f"""WITH {SALES}
SELECT {stamp('date')} AS date, product_id, store_id, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, l_orderkey, l_linenumber,
  {lag("quantity", 1)}, {rolling("quantity", 2, "mean")}
FROM sales {frames('product_id, store_id', STORE_ORDER, (2,))}"""

ORACLES["group_aggregates"] = f"""WITH {SALES}, stats AS (
  SELECT product_id, avg(quantity) AS quantity_mean, stddev_samp(quantity) AS quantity_std,
    min(quantity) AS quantity_min, max(quantity) AS quantity_max, coalesce(sum(quantity), 0) AS quantity_sum,
    count(quantity) AS quantity_count, avg(price) AS price_mean, stddev_samp(price) AS price_std,
    min(price) AS price_min, max(price) AS price_max
  FROM sales WHERE product_id IS NOT NULL GROUP BY product_id)
SELECT product_id, {stamp('date')} AS date, floor((quantity) * 1e3 + 0.5) / 1e3 AS quantity, floor((price) * 1e3 + 0.5) / 1e3 AS price,
  floor((quantity_mean) * 1e3 + 0.5) / 1e3 AS quantity_mean, floor((quantity_std) * 1e3 + 0.5) / 1e3 AS quantity_std,
  floor((quantity_min) * 1e3 + 0.5) / 1e3 AS quantity_min, floor((quantity_max) * 1e3 + 0.5) / 1e3 AS quantity_max,
  floor((quantity_sum) * 1e3 + 0.5) / 1e3 AS quantity_sum, quantity_count, floor((price_mean) * 1e3 + 0.5) / 1e3 AS price_mean,
  floor((price_std) * 1e3 + 0.5) / 1e3 AS price_std, floor((price_min) * 1e3 + 0.5) / 1e3 AS price_min, floor((price_max) * 1e3 + 0.5) / 1e3 AS price_max
FROM sales LEFT JOIN stats USING (product_id)"""
ORACLES["store_nunique"] = """SELECT l_partkey AS product_id, floor((sum(l_quantity)) * 1e4 + 0.5) / 1e4 AS quantity_sum,
  count(l_quantity) AS quantity_count, count(DISTINCT l_suppkey) AS store_id_nunique
FROM lineitem GROUP BY l_partkey"""
ORACLES["past_aggregates"] = ORACLES["past_aggregates_chunked"] = f"""WITH {SALES}
SELECT {stamp('date')} AS date, product_id, store_id, floor((quantity) * 1e3 + 0.5) / 1e3 AS quantity, l_orderkey, l_linenumber,
  floor((avg(quantity) OVER p) * 1e3 + 0.5) / 1e3 AS quantity_mean, floor((stddev_samp(quantity) OVER p) * 1e3 + 0.5) / 1e3 AS quantity_std,
  floor((min(quantity) OVER p) * 1e3 + 0.5) / 1e3 AS quantity_min, floor((max(quantity) OVER p) * 1e3 + 0.5) / 1e3 AS quantity_max,
  floor((coalesce(sum(quantity) OVER p, 0)) * 1e3 + 0.5) / 1e3 AS quantity_sum, count(quantity) OVER p AS quantity_count
FROM sales WINDOW p AS (PARTITION BY store_id ORDER BY {STORE_ORDER}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ORACLES["interactions"] = f"""WITH {SALES}
SELECT l_orderkey, l_linenumber, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, floor((price) * 1e4 + 0.5) / 1e4 AS price,
  floor((quantity * price) * 1e4 + 0.5) / 1e4 AS revenue, floor((ln(1 + quantity)) * 1e4 + 0.5) / 1e4 AS log_quantity,
  floor((ln(1 + price)) * 1e4 + 0.5) / 1e4 AS log_price, floor((ln(1 + quantity * price)) * 1e4 + 0.5) / 1e4 AS log_revenue
FROM sales"""
ORACLES["quantity_change"] = f"""WITH {DAILY}, lagged AS (
  SELECT *, lag(quantity) OVER (PARTITION BY product_id ORDER BY date) AS before FROM daily)
SELECT product_id, {stamp('date')} AS date, floor((quantity - before) * 1e4 + 0.5) / 1e4 AS quantity_change,
  floor(((quantity - before) / (before + 1) * 100) * 1e4 + 0.5) / 1e4 AS quantity_change_pct
FROM lagged"""

STATS_3 = ", ".join(
    f"floor(({e}) * 1e3 + 0.5) / 1e3 AS {n}" for c in ("quantity", "price") for n, e in (
        (f"{c}_mean", f"avg({c}) OVER g"), (f"{c}_std", f"stddev_samp({c}) OVER g"),
        (f"{c}_min", f"min({c}) OVER g"), (f"{c}_max", f"max({c}) OVER g")))
ORACLES["daily_features"] = f"""WITH {DAILY}, lagged AS (
  SELECT *, lag(quantity, 1) OVER (PARTITION BY product_id ORDER BY date) AS before FROM daily)
SELECT product_id, {stamp('date')} AS date, floor((quantity) * 1e3 + 0.5) / 1e3 AS quantity, floor((price) * 1e3 + 0.5) / 1e3 AS price,
  {calendar('date', SALES_HOLIDAYS)},
  {", ".join(lag("quantity", k, 3) for k in (1, 7, 14))}, {", ".join(lag("price", k, 3) for k in (1, 7, 14))},
  {", ".join(rolling("quantity", n, s, places=3) for n in (7, 14) for s in ("mean", "std", "min", "max"))},
  {", ".join(rolling("price", n, "mean", places=3) for n in (7, 14))},
  {STATS_3}, floor((sum(quantity) OVER g) * 1e3 + 0.5) / 1e3 AS quantity_sum, count(quantity) OVER g AS quantity_count,
  floor((quantity * price) * 1e3 + 0.5) / 1e3 AS revenue, floor((ln(1 + quantity)) * 1e3 + 0.5) / 1e3 AS log_quantity,
  floor((ln(1 + price)) * 1e3 + 0.5) / 1e3 AS log_price, floor((ln(1 + quantity * price)) * 1e3 + 0.5) / 1e3 AS log_revenue,
  floor((quantity - before) * 1e3 + 0.5) / 1e3 AS quantity_change,
  floor(((quantity - before) / (before + 1) * 100) * 1e3 + 0.5) / 1e3 AS quantity_change_pct,
  {seasonal_columns('date', 3)}
FROM lagged {frames('product_id', 'date', (7, 14))}, g AS (PARTITION BY product_id)"""


def scaled(expression: str, name: str) -> str:
    return (f"floor((({expression} - avg({expression}) OVER ()) / "
            f"coalesce(nullif(stddev_pop({expression}) OVER (), 0), 1)) * 1e3 + 0.5) / 1e3 AS {name}")


ORACLES["scaled_features"] = f"""WITH {DAILY}, features AS (
  SELECT *, lag(quantity, 1) OVER w AS before,
    CASE WHEN count(quantity) OVER f7 >= 7 THEN avg(quantity) OVER f7 END AS rolled,
    avg(quantity) OVER (PARTITION BY product_id) AS whole,
    CAST(isodow(date) >= 6 AS DOUBLE) AS weekend, CAST(quantity > 25 AS DOUBLE) AS is_large,
    CAST(quantity <= 25 AS DOUBLE) AS is_small
  FROM daily {frames('product_id', 'date', (7,))})
SELECT product_id, {stamp('date')} AS date, {scaled('quantity', 'quantity')}, {scaled('price', 'price')},
  {scaled('before', 'quantity_lag_1')}, {scaled('rolled', 'quantity_roll_mean_7')},
  {scaled('whole', 'quantity_mean')}, {scaled('weekend', 'is_weekend')}, {scaled('is_large', 'size_large')},
  {scaled('is_small', 'size_small')}, {scaled('ln(1 + quantity)', 'log_quantity')},
  {scaled('(quantity - before)', 'quantity_change')}, floor((sin(2 * pi() * month(date) / 12)) * 1e3 + 0.5) / 1e3 AS month_sin
FROM features"""

STATUSES = ("F", "O", "P")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORACLES["one_hot"] = "SELECT o_orderkey, " + ", ".join(
    f"""CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS "{c}_{v}" """
    for c, values in (("o_orderstatus", STATUSES), ("o_orderpriority", PRIORITIES)) for v in values) + " FROM orders"
ORACLES["standard_scale"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"floor((({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) * 1e4 + 0.5) / 1e4 AS {c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount")) + ", CAST(0 AS DOUBLE) AS constant FROM lineitem"
ORACLES["label_encode"] = """SELECT p_partkey,
  CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
  CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type
FROM part"""
ORACLES["label_encode_unseen"] = """WITH codes AS (
  SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)),
names AS (SELECT c_custkey, lower(c_mktsegment) AS name FROM customer
  UNION ALL SELECT -1 - p_partkey, p_name FROM part)
SELECT c_custkey, CAST(coalesce(code, 0) AS INTEGER) AS name FROM names LEFT JOIN codes USING (name)"""
ORACLES["align"] = """SELECT floor((coalesce(l_tax, 0)) * 1e4 + 0.5) / 1e4 AS l_tax, floor((coalesce(l_quantity, 0)) * 1e4 + 0.5) / 1e4 AS l_quantity,
  CAST(0 AS INTEGER) AS not_there, coalesce(l_orderkey, 0) AS l_orderkey FROM lineitem"""

ORACLES["correlation_select"] = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, l_quantity)) AS abs_corr FROM lineitem"
    for c in ("l_extendedprice", "l_discount", "l_tax", "l_linenumber")) + """
  UNION ALL SELECT 'constant', NULL)
SELECT feature, floor((abs_corr) * 1e4 + 0.5) / 1e4 AS abs_corr, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS rank FROM c) WHERE rank <= 4"""

SPLIT_LABEL = """CASE WHEN pos < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
    WHEN pos < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT) THEN 'val'
    ELSE 'test' END AS split"""
ORACLES["time_split_rows"] = f"""WITH {SALES}, placed AS (
  SELECT *, row_number() OVER (ORDER BY {LABEL_ORDER}) - 1 AS pos, count(*) OVER () AS n FROM sales)
SELECT l_orderkey, l_linenumber, product_id, {stamp('date')} AS date, {SPLIT_LABEL} FROM placed"""
NAIVE = f"""{DAILY}, naive AS (
  SELECT product_id, date, quantity, lag(quantity, 7) OVER (PARTITION BY product_id ORDER BY date) AS forecast
  FROM daily)"""
ORACLES["split_metrics"] = f"""WITH {NAIVE}, placed AS (
  SELECT *, row_number() OVER (ORDER BY date, product_id) - 1 AS pos, count(*) OVER () AS n FROM naive),
labelled AS (SELECT quantity, forecast, {SPLIT_LABEL} FROM placed)
SELECT split, count(*) AS n, floor((avg((quantity - forecast) ** 2)) * 1e4 + 0.5) / 1e4 AS mse,
  floor((avg(abs(quantity - forecast))) * 1e4 + 0.5) / 1e4 AS mae,
  floor((1 - avg((quantity - forecast) ** 2) / var_pop(quantity)) * 1e4 + 0.5) / 1e4 AS r2
FROM labelled WHERE forecast IS NOT NULL GROUP BY split"""
ORACLES["naive_forecast_kpis"] = f"""WITH {DAILY}, long AS (
  {" UNION ALL ".join(
      f"SELECT {k} AS horizon, quantity, lag(quantity, {k}) OVER (PARTITION BY product_id ORDER BY date) AS forecast FROM daily"
      for k in (1, 7, 14, 30))}),
kpis AS (SELECT horizon, count(*) AS n, sqrt(avg((quantity - forecast) ** 2)) / 50.0 AS rmse,
  avg(abs((quantity - forecast) / nullif(quantity, 0))) * 100 AS mape FROM long
  WHERE forecast IS NOT NULL GROUP BY horizon)
SELECT CAST(horizon AS INTEGER) AS horizon, n, floor((rmse) * 1e4 + 0.5) / 1e4 AS rmse, floor((mape) * 1e4 + 0.5) / 1e4 AS mape,
  floor((greatest(0, 100 - mape)) * 1e4 + 0.5) / 1e4 AS accuracy, CAST(rmse < 0.15 AS INTEGER) AS rmse_ok,
  CAST(mape < 10 AS INTEGER) AS mape_ok,
  CASE WHEN horizon = 7 THEN CAST(greatest(0, 100 - mape) > 90 AS INTEGER) END AS accuracy_ok
FROM kpis"""
ORACLES["drift_psi"] = """WITH base AS (SELECT l_quantity AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
edges AS (SELECT DISTINCT unnest(quantile_disc(q, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM base),
ids AS (SELECT unnest(range((SELECT count(*) + 1 FROM edges))) AS bucket),
base_share AS (
  SELECT bucket, count(*) / (SELECT count(*) FROM base) AS share FROM (
    SELECT q, (SELECT count(*) FROM edges WHERE q > e) AS bucket FROM base) GROUP BY bucket),
now AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_quantity AS q FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
counts AS (SELECT day, bucket, count(*) AS n FROM (
    SELECT day, q, (SELECT count(*) FROM edges WHERE q > e) AS bucket FROM now) GROUP BY day, bucket),
totals AS (SELECT day, sum(n) AS rows FROM counts GROUP BY day),
shares AS (
  SELECT day, rows, greatest(coalesce(n, 0) / rows, 0.0001) AS a, greatest(coalesce(share, 0), 0.0001) AS b
  FROM totals CROSS JOIN ids LEFT JOIN counts USING (day, bucket) LEFT JOIN base_share USING (bucket))
SELECT day, CAST(max(rows) AS BIGINT) AS rows, floor((sum((a - b) * ln(a / b))) * 1e4 + 0.5) / 1e4 AS psi FROM shares GROUP BY day"""
ORACLES["weekly_degradation"] = f"""WITH {NAIVE}, baseline AS (
  SELECT avg(abs(quantity - forecast)) AS mae FROM naive WHERE date < TIMESTAMP '1998-01-01'),
weekly AS (SELECT date_trunc('week', date) AS week, count(*) AS n, avg(abs(quantity - forecast)) AS mae FROM naive
  WHERE date >= TIMESTAMP '1998-01-01' AND forecast IS NOT NULL GROUP BY 1)
SELECT {day('week')} AS week, n, floor((weekly.mae) * 1e4 + 0.5) / 1e4 AS mae,
  floor(((weekly.mae - baseline.mae) / baseline.mae) * 1e4 + 0.5) / 1e4 AS degradation,
  CAST((weekly.mae - baseline.mae) / baseline.mae > 0.05 AS INTEGER) AS retrain
FROM weekly, baseline"""
LAST = """last AS (SELECT {key}, max(date) AS last_date, arg_max(quantity, date) AS last_quantity,
  arg_max(price, date) AS last_price FROM daily GROUP BY {key}),
steps AS (SELECT unnest(range(1, 31)) AS horizon), final AS (SELECT max(date)::DATE AS d FROM daily)"""
ORACLES["horizon"] = f"""WITH {DAILY}, {LAST.format(key='product_id')}
SELECT product_id, CAST(horizon AS INTEGER) AS horizon, {day('d + CAST(horizon AS INTEGER)')} AS date,
  floor((last_quantity) * 1e4 + 0.5) / 1e4 AS last_quantity, floor((last_price) * 1e4 + 0.5) / 1e4 AS last_price,
  CAST(d + CAST(horizon AS INTEGER) - last_date::DATE AS INTEGER) AS days_since_last
FROM last, steps, final"""
STORE_DAILY = DAILY.replace("l_partkey", "l_suppkey").replace("product_id", "store_id")
ORACLES["horizon_scores"] = f"""WITH {STORE_DAILY}, {LAST.format(key='store_id')},
scored AS (SELECT store_id, horizon, d + CAST(horizon AS INTEGER) AS date,
  0.5 * last_quantity + 0.01 * last_price AS prediction FROM last, steps, final)
SELECT store_id, CAST(horizon AS INTEGER) AS horizon, {day('date')} AS date, floor((prediction) * 1e4 + 0.5) / 1e4 AS prediction,
  floor((prediction * 0.85) * 1e4 + 0.5) / 1e4 AS confidence_lower, floor((prediction * 1.15) * 1e4 + 0.5) / 1e4 AS confidence_upper FROM scored"""

ORACLES["quality_counts"] = """WITH n AS (SELECT count(*) AS rows, count_if(c_acctbal < 0) AS negative,
  count_if(c_acctbal > 5000) AS high, count_if(c_mktsegment IS NULL) AS no_segment,
  count_if(c_mktsegment IS NOT NULL AND try_cast(c_mktsegment AS DOUBLE) IS NULL) AS bad_segment FROM customer)
SELECT 'columns' AS rule, 'date' AS "column", CAST(NULL AS BIGINT) AS offending, rows FROM n
UNION ALL SELECT 'negative', 'sales', CAST(negative AS BIGINT), rows FROM n
UNION ALL SELECT 'range_min', 'sales', CAST(negative AS BIGINT), rows FROM n
UNION ALL SELECT 'range_max', 'sales', CAST(high AS BIGINT), rows FROM n
UNION ALL SELECT 'required', 'segment', CAST(no_segment AS BIGINT), rows FROM n
UNION ALL SELECT 'required', 'email', NULL, rows FROM n
UNION ALL SELECT 'schema', 'segment', CAST(bad_segment AS BIGINT), rows FROM n"""
ORACLES["quality_result"] = """WITH n AS (SELECT count(*) AS rows, count_if(c_acctbal < 0) AS negative,
  count_if(c_acctbal > 5000) AS high FROM customer),
errors AS (
  SELECT 'Missing required column: date' AS error FROM n
  UNION ALL SELECT 'Found ' || negative || ' negative sales values' FROM n WHERE negative > 0
  UNION ALL SELECT negative || ' values of sales are less than minimum 0' FROM n WHERE negative > 0
  UNION ALL SELECT high || ' values of sales are greater than maximum 5000' FROM n WHERE high > 0
  UNION ALL SELECT 'Missing required field: email' FROM n
  UNION ALL SELECT 'Expected type float in segment, got ' || rows || ' other values' FROM n)
SELECT 'load' AS stage, CAST(0 AS INTEGER) AS is_valid, error, CAST(rows AS VARCHAR) AS row_count FROM errors, n"""
ORACLES["quality_history"] = """SELECT 'lineitem' AS stage, CAST(count(*) AS VARCHAR) AS row_count FROM lineitem
UNION ALL SELECT 'customer', CAST(count(*) AS VARCHAR) FROM customer"""
ORACLES["tagged_rows"] = """SELECT c_custkey AS product_id,
  CASE WHEN c_acctbal < 0 THEN 'negative:sales,range_min:sales' WHEN c_acctbal > 5000 THEN 'range_max:sales'
    ELSE '' END AS broken FROM customer"""
ORACLES["forecast_quality"] = """SELECT 'columns' AS rule, 'forecast_date' AS "column", CAST(NULL AS BIGINT) AS offending,
  count(*) AS rows FROM customer
UNION ALL SELECT 'negative', 'predicted_demand', CAST(count_if(c_acctbal < 0) AS BIGINT), count(*) FROM customer
UNION ALL SELECT 'null', 'predicted_demand', CAST(count_if(c_acctbal IS NULL) AS BIGINT), count(*) FROM customer"""
ORACLES["null_profile"] = f"""WITH {DAILY}, lagged AS (
  SELECT product_id, quantity, lag(quantity, 1) OVER w AS quantity_lag_1, lag(quantity, 7) OVER w AS quantity_lag_7
  FROM daily {frames('product_id', 'date', ())}),
profile AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls FROM lagged"
    for c in ("product_id", "quantity", "quantity_lag_1", "quantity_lag_7"))})
SELECT name AS "column", rows, nulls, floor((nulls / rows) * 1e4 + 0.5) / 1e4 AS null_ratio,
  CAST(nulls / rows <= 0.05 AS INTEGER) AS within_threshold FROM profile"""

ORACLES["incremental_antijoin"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, floor((o_totalprice) * 1e4 + 0.5) / 1e4 AS o_totalprice,
  {stamp('o_orderdate')} AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
ORACLES["incremental_dedupe"] = f"""WITH {SALES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY date DESC, product_id DESC, store_id DESC,
    quantity DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
  FROM sales WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
SELECT {stamp('date')} AS date, product_id, store_id, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, l_orderkey, l_linenumber,
  floor((l_extendedprice) * 1e4 + 0.5) / 1e4 AS l_extendedprice FROM ranked WHERE rn = 1"""
ORACLES["high_water_mark"] = f"""SELECT l_suppkey AS store_id, {stamp('max(l_shipdate)')} AS last_processed
FROM lineitem GROUP BY l_suppkey"""
ORACLES["high_water_mark_merge"] = f"""SELECT l_orderkey, {stamp('max(date)')} AS last_processed FROM (
  SELECT l_orderkey, l_shipdate AS date FROM lineitem UNION ALL SELECT o_orderkey, o_orderdate FROM orders)
GROUP BY l_orderkey"""
ORACLES["default_window"] = f"""WITH {SALES}
SELECT {stamp('date')} AS date, product_id, store_id, floor((quantity) * 1e4 + 0.5) / 1e4 AS quantity, l_orderkey, l_linenumber,
  floor((l_extendedprice) * 1e4 + 0.5) / 1e4 AS l_extendedprice FROM sales
WHERE date >= TIMESTAMP '2000-06-23' AND date <= TIMESTAMP '2000-06-30'"""
ORACLES["ledger_trim"] = """SELECT event_id FROM (
  SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM events)
WHERE n <= 5000 OR rn <= 2500"""
ORACLES["ledger_update"] = """SELECT id, min(seq) AS seq FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(0 AS BIGINT) AS seq FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_orderkey + 1 FROM lineitem) GROUP BY id"""

ORACLES["online_lookup"] = f"""WITH {DAILY}, last AS (
  SELECT product_id, arg_max(quantity, date) AS quantity, arg_max(price, date) AS price FROM daily GROUP BY product_id)
SELECT p_partkey AS product_id, p_brand, floor((coalesce(quantity, 0)) * 1e4 + 0.5) / 1e4 AS quantity,
  floor((coalesce(price, 0)) * 1e4 + 0.5) / 1e4 AS price, CAST(0 AS DOUBLE) AS stock
FROM part LEFT JOIN last ON p_partkey = product_id"""
ORACLES["point_in_time_lookup"] = ORACLES["point_in_time_lookup_chunked"] = f"""WITH {DAILY}, entities AS (
  SELECT l_partkey AS product_id, l_orderkey, l_linenumber, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entities.product_id, l_orderkey, l_linenumber, {stamp('o_orderdate')} AS o_orderdate,
  floor((coalesce(quantity, 0)) * 1e4 + 0.5) / 1e4 AS quantity, floor((coalesce(price, 0)) * 1e4 + 0.5) / 1e4 AS price
FROM entities ASOF LEFT JOIN daily ON entities.product_id = daily.product_id AND o_orderdate >= daily.date"""
ORACLES["confidence_band"] = """SELECT c_custkey, floor((c_acctbal) * 1e4 + 0.5) / 1e4 AS prediction,
  floor((c_acctbal * 0.85::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence_lower, floor((c_acctbal * 1.15::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence_upper
FROM customer"""
ORACLES["registry_latest"] = """SELECT p_type AS model_name, max(p_partkey) AS version, 'Production' AS stage,
  'models/' || max(p_partkey) AS path FROM part WHERE p_size > 25 GROUP BY p_type"""


def responses(price: str) -> str:
    return f"""WITH daily AS (
  SELECT l_partkey AS product_id, l_suppkey AS store_id, l_shipdate AS date, sum(l_quantity) AS quantity,
    sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS price FROM lineitem GROUP BY ALL),
last AS (SELECT product_id, store_id, arg_max(quantity, date) AS quantity, arg_max(price, date) AS price
  FROM daily GROUP BY product_id, store_id),
scored AS (SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber,
    0.0::DOUBLE + coalesce(quantity, 0) * 0.5::DOUBLE + {price} * 0.01::DOUBLE AS p
  FROM lineitem LEFT JOIN last ON l_partkey = product_id AND l_suppkey = store_id)
SELECT CAST(l_partkey AS VARCHAR) AS product_id, floor((p) * 1e4 + 0.5) / 1e4 AS predicted_quantity,
  floor((p * 0.85::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence_lower, floor((p * 1.15::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence_upper,
  '1.0.0' AS model_version, CAST(l_suppkey AS VARCHAR) AS store_id, {day('l_shipdate')} AS date,
  l_orderkey, l_linenumber FROM scored"""


ORACLES["request_scoring"] = ORACLES["stream_scoring"] = responses("coalesce(price, 0)")
ORACLES["request_scoring_overrides"] = responses("l_tax * 100")
ORACLES["request_stamps"] = """SELECT '1.0.0' AS model_version, count(*) AS responses, count(*) AS ids,
  count(*) AS stamped FROM lineitem"""
ORACLES["request_parsing"] = f"""WITH judged AS (SELECT *, CASE
    WHEN l_returnflag = 'R' THEN 'product_id is missing or not text'
    WHEN l_linestatus = 'O' THEN 'features must be numbers' END AS reason FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN reason IS NULL THEN CAST(l_partkey AS VARCHAR) END AS product_id,
  CASE WHEN reason IS NULL THEN CAST(l_suppkey AS VARCHAR) END AS store_id,
  CASE WHEN reason IS NULL THEN {day('l_shipdate')} END AS date,
  CASE WHEN reason IS NULL THEN floor((l_tax) * 1e4 + 0.5) / 1e4 END AS tax, reason FROM judged"""

ORACLES["request_counts"] = f"""WITH {REQUESTS}
SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY method, endpoint, status"""
ORACLES["request_counts_hourly"] = f"""WITH {REQUESTS}
SELECT method, endpoint, status, count(*) AS requests, {stamp("date_trunc('hour', ts)")} AS hour
FROM requests GROUP BY method, endpoint, status, date_trunc('hour', ts)"""
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
ORACLES["latency_histogram"] = f"""WITH {REQUESTS}
SELECT method, endpoint, {", ".join(
    f"CAST(count_if(latency_s <= {b}::DOUBLE) AS BIGINT) AS le_{f'{b:g}'.replace('.', '_')}" for b in BUCKETS)},
  floor((sum(latency_s)) * 1e4 + 0.5) / 1e4 AS latency_sum, count(latency_s) AS latency_count,
  floor((quantile_disc(latency_s, 0.95)) * 1e4 + 0.5) / 1e4 AS latency_p95
FROM requests WHERE status = '200' GROUP BY method, endpoint"""
ORACLES["active_requests"] = f"""WITH {REQUESTS}, edges AS (
  SELECT date_trunc('second', ts) AS moment, 1 AS change FROM requests
  UNION ALL SELECT date_trunc('second', ts + to_microseconds(CAST(round(latency_s * 10000 * 1000000) AS BIGINT))), -1
  FROM requests),
changes AS (SELECT moment, sum(change) AS change FROM edges GROUP BY moment)
SELECT {stamp('moment')} AS at, CAST(change AS BIGINT) AS change,
  CAST(sum(change) OVER (ORDER BY moment) AS BIGINT) AS active FROM changes"""
ORACLES["quota_tumbling"] = f"""WITH {REQUESTS}
SELECT client, {stamp("date_trunc('day', ts)")} AS window_start, count(*) AS requests,
  greatest(0, 3 - count(*)) AS remaining, greatest(0, count(*) - 3) AS rejected
FROM requests GROUP BY client, date_trunc('day', ts)"""
ORACLES["quota_aligned"] = f"""WITH {REQUESTS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY client, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM requests)
SELECT event_id, client, {stamp("date_trunc('day', ts)")} AS window_start, CAST(n AS INTEGER) AS n,
  CAST(greatest(0, 3 - n) AS INTEGER) AS remaining, CAST(n > 3 AS INTEGER) AS over_limit FROM numbered"""


def anchored(seconds: int) -> str:
    """Walk each client's requests in order, opening a window whenever the last one has ended."""
    return f"""WITH RECURSIVE {REQUESTS}, placed AS (
  SELECT event_id, client, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS pos FROM requests),
walk AS (
  SELECT event_id, client, pos, us, us AS start, CAST(1 AS BIGINT) AS n FROM placed WHERE pos = 1
  UNION ALL
  SELECT p.event_id, p.client, p.pos, p.us,
    CASE WHEN p.us >= w.start + {seconds}::BIGINT * 1000000 THEN p.us ELSE w.start END,
    CASE WHEN p.us >= w.start + {seconds}::BIGINT * 1000000 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN placed p ON p.client = w.client AND p.pos = w.pos + 1)"""


def anchored_rows(seconds: int, limit: int) -> str:
    return f"""{anchored(seconds)}
SELECT event_id, client, {stamp('make_timestamp(start)')} AS window_start, CAST(n AS INTEGER) AS n,
  CAST(greatest(0, {limit} - n) AS INTEGER) AS remaining, CAST(n > {limit} AS INTEGER) AS over_limit FROM walk"""


ORACLES["quota_anchored"] = anchored_rows(86_400, 3)
ORACLES["quota_anchored_chunked"] = anchored_rows(6 * 3600, 2)
ORACLES["stream_quota_anchored"] = f"""{anchored(86_400)}
SELECT CAST(client AS VARCHAR) AS client, event_id, us AS ts_us, start AS window_start_us, n,
  CAST(n > 3 AS INTEGER) AS over_limit FROM walk"""
ORACLES["quota_remaining"] = f"""{anchored(86_400)},
live AS (SELECT client, count(*) AS used, max(start) + 86400::BIGINT * 1000000 AS ends FROM walk
  WHERE us <= epoch_us(TIMESTAMP '2024-01-15 12:00:00')
    AND start + 86400::BIGINT * 1000000 > epoch_us(TIMESTAMP '2024-01-15 12:00:00') GROUP BY client)
SELECT client, greatest(0, 3 - coalesce(used, 0)) AS remaining,
  {stamp("make_timestamp(coalesce(ends, epoch_us(TIMESTAMP '2024-01-16 12:00:00')))")} AS reset_at
FROM (SELECT DISTINCT client FROM requests) LEFT JOIN live USING (client)"""
ORACLES["service_kpis"] = f"""WITH {REQUESTS}, seconds AS (
  SELECT endpoint, count(*) AS n FROM requests GROUP BY endpoint, date_trunc('second', ts)),
peaks AS (SELECT endpoint, max(n) AS peak_per_second FROM seconds GROUP BY endpoint),
p AS (SELECT endpoint, count(*) AS requests, quantile_disc(latency_s, 0.95) AS p95 FROM requests GROUP BY endpoint)
SELECT endpoint, requests, floor((p95) * 1e4 + 0.5) / 1e4 AS p95, peak_per_second, CAST(p95 < 0.1 AS INTEGER) AS latency_ok,
  CAST(peak_per_second > 500 AS INTEGER) AS throughput_ok FROM p JOIN peaks USING (endpoint)"""

ORACLES["source_union"] = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  'customer.parquet' AS _source_file, 'prefix' AS _source, CAST(NULL AS BIGINT) AS s_suppkey,
  CAST(NULL AS VARCHAR) AS s_name, CAST(NULL AS INTEGER) AS s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'shards', s_suppkey, s_name, s_nationkey, s_acctbal
FROM supplier"""
ORACLES["message_decode"] = """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(user_id % 8 AS INTEGER) AS _partition, event_id AS _offset
FROM events WHERE event_type NOT IN ('error', 'view')"""
ORACLES["date_parsing"] = f"""SELECT o_orderkey, {stamp("date_trunc('day', o_orderdate)")} AS date,
  CAST(NULL AS VARCHAR) AS created_at FROM orders"""
ORACLES["csv_source"] = ORACLES["json_source"] = "SELECT * FROM customer"
ORACLES["new_files"] = """SELECT unnest(['region', 'nation', 'customer', 'supplier', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS path"""
ORACLES["feature_view"] = """SELECT l_partkey AS product_id, floor((avg(l_quantity)) * 1e4 + 0.5) / 1e4 AS quantity_mean,
  floor((stddev_samp(l_quantity)) * 1e4 + 0.5) / 1e4 AS quantity_std, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max,
  sum(l_quantity) AS quantity_sum, count(l_quantity) AS quantity_count FROM lineitem GROUP BY l_partkey"""

ORACLES["stream_file_ingest"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, floor((o_totalprice) * 1e4 + 0.5) / 1e4 AS o_totalprice,
  {stamp('o_orderdate')} AS o_orderdate, o_orderpriority, 'orders.parquet' AS _source_file FROM orders"""
ORACLES["stream_dedup"] = "SELECT DISTINCT l_orderkey FROM lineitem"
ORACLES["stream_request_counts"] = f"""WITH {REQUESTS}, counts AS (
  SELECT method, endpoint, status, count(*) AS requests, date_trunc('hour', ts) AS hour
  FROM requests GROUP BY method, endpoint, status, date_trunc('hour', ts))
SELECT method, endpoint, status, requests, {stamp('hour')} AS hour FROM counts"""
ORACLES["stream_quota"] = f"""WITH {REQUESTS}, usage AS (
  SELECT client, date_trunc('day', ts) AS window_start, count(*) AS requests FROM requests
  GROUP BY client, date_trunc('day', ts))
SELECT client, {stamp('window_start')} AS window_start, requests, greatest(0, 3 - requests) AS remaining,
  greatest(0, requests - 3) AS rejected FROM usage"""

# Models: what the data determine whatever the trees are.
TRAINING_ROWS = "SELECT DISTINCT l_partkey AS product_id, l_shipdate AS date FROM lineitem"
ORACLES["train_gbt"] = ORACLES["train_rf"] = f"""WITH n AS (SELECT count(*) AS n FROM ({TRAINING_ROWS}))
SELECT 'train' AS split, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS rows, 1 AS explains, CAST(3 AS BIGINT) AS logged FROM n
UNION ALL SELECT 'val', CAST(floor(n * 0.15::DOUBLE) AS BIGINT), NULL, 3 FROM n
UNION ALL SELECT 'test', CAST(n - floor(n * 0.7::DOUBLE) - floor(n * 0.15::DOUBLE) AS BIGINT), NULL, 3 FROM n"""
ORACLES["feature_importance"] = """SELECT unnest(['product_id', 'quantity_lag_1', 'quantity_lag_7',
  'quantity_roll_mean_7', 'price']) AS feature, 1 AS valid, 1.0::DOUBLE AS total"""
# Which features an amount depends on, without trees: the one whose bins leave the least variance of the
# amount, then the one that leaves the least within the bins of the first.
AMOUNT_RANKS = """WITH binned AS (
  SELECT row_number() OVER () AS id, l_extendedprice AS y, [ntile(20) OVER (ORDER BY l_discount),
    ntile(20) OVER (ORDER BY l_quantity), ntile(20) OVER (ORDER BY l_tax), ntile(20) OVER (ORDER BY l_extendedprice / l_quantity),
    ntile(20) OVER (ORDER BY l_linenumber), ntile(20) OVER (ORDER BY l_partkey), ntile(20) OVER (ORDER BY l_suppkey)] AS bins
  FROM lineitem),
long AS (
  SELECT id, y, unnest(bins) AS bin, unnest(range(1, 8)) AS spot,
    unnest(['l_discount', 'l_quantity', 'l_tax', 'price', 'l_linenumber', 'l_partkey', 'l_suppkey']) AS feature FROM binned),
alone AS (
  SELECT feature, spot, sum(n * v) AS left_over
  FROM (SELECT feature, spot, bin, count(*) AS n, var_pop(y) AS v FROM long GROUP BY ALL) GROUP BY ALL),
head AS (SELECT feature, spot FROM alone ORDER BY left_over LIMIT 1),
joint AS (
  SELECT feature, spot, sum(n * v) AS left_over
  FROM (SELECT l.feature, l.spot, l.bin, f.bin AS own, count(*) AS n, var_pop(l.y) AS v
        FROM long l JOIN long f ON f.id = l.id JOIN head h ON h.feature = f.feature WHERE l.feature <> h.feature GROUP BY ALL)
  GROUP BY ALL),
best AS (SELECT 1 AS rank, feature, spot FROM head
  UNION ALL SELECT * FROM (SELECT 2, feature, spot FROM joint ORDER BY left_over LIMIT 1))"""
ORACLES["importance_select"] = f"{AMOUNT_RANKS} SELECT rank, feature FROM best"
ORACLES["rfe_select"] = f"""{AMOUNT_RANKS}
SELECT CAST(row_number() OVER (ORDER BY spot) AS INTEGER) AS place, feature FROM best"""
ORACLES["batch_scoring"] = f"""SELECT product_id, {stamp('date')} AS date, 1 AS prediction, 1 AS confidence_lower,
  1 AS confidence_upper, 1 AS better_than_mean FROM ({TRAINING_ROWS})"""

ORACLES["one_hot_sparse"] = """WITH rows AS (
  SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
names AS (SELECT c_name, row_number() OVER (ORDER BY c_name NULLS LAST) - 1 AS at FROM (SELECT DISTINCT c_name FROM rows)),
segments AS (
  SELECT c_mktsegment, (SELECT count(*) FROM names) + row_number() OVER (ORDER BY c_mktsegment NULLS LAST) - 1 AS at
  FROM (SELECT DISTINCT c_mktsegment FROM rows))
SELECT c_custkey, n.at || ',' || s.at AS indices, '1.0,1.0' AS values
FROM rows JOIN names n ON n.c_name IS NOT DISTINCT FROM rows.c_name
JOIN segments s ON s.c_mktsegment IS NOT DISTINCT FROM rows.c_mktsegment"""
# The last part that holds a customer wins; within it the newest order.
ORACLES["feature_view_upsert"] = f"""SELECT o_custkey, o_orderkey, {stamp('o_orderdate')} AS o_orderdate,
  floor((o_totalprice) * 1e4 + 0.5) / 1e4 AS o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate >= TIMESTAMP '1996-01-01' DESC, o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1"""
ORACLES["isolated_files"] = "SELECT *, 1 AS left_out FROM customer"
ORACLES["stream_quota_expiring"] = ORACLES["stream_quota_anchored"]
ORACLES["stream_once_per_id"] = "SELECT DISTINCT l_orderkey, 1 AS in_ledger FROM lineitem"
ORACLES["quality_counts_at_load"] = ORACLES["quality_counts"]
ORACLES["daily_latency_quantiles"] = f"""WITH {REQUESTS}
SELECT endpoint, {day("ts::DATE")} AS day, count(*) AS n, floor((min(latency_s)) * 1e6 + 0.5) / 1e6 AS least,
  floor((max(latency_s)) * 1e6 + 0.5) / 1e6 AS most, 1 AS p50_in_bound, 1 AS p95_in_bound
FROM requests GROUP BY endpoint, ts::DATE"""
ORACLES["rolling_distinct_exact"] = f"""WITH days AS (
  SELECT DISTINCT l_partkey AS product_id, l_shipdate::DATE AS date, l_suppkey AS store_id FROM lineitem)
SELECT a.product_id, {day('a.date')} AS date, count(DISTINCT b.store_id) AS "distinct"
FROM (SELECT DISTINCT product_id, date FROM days) a
JOIN days b ON b.product_id = a.product_id AND b.date BETWEEN a.date - 6 AND a.date GROUP BY a.product_id, a.date"""
ORACLES["rolling_distinct_sketch"] = f"""WITH days AS (
  SELECT DISTINCT l_linestatus, l_shipdate::DATE AS date, l_partkey FROM lineitem),
spread AS (SELECT DISTINCT l_linestatus, date + CAST(i AS INTEGER) AS date, l_partkey FROM days, range(0, 7) t(i))
SELECT l_linestatus, {day('date')} AS date, count(*) AS products, 1 AS in_bound
FROM spread SEMI JOIN (SELECT DISTINCT l_linestatus, date FROM days) d USING (l_linestatus, date)
GROUP BY l_linestatus, date"""
ORACLES["stream_active_requests"] = ORACLES["active_requests"]
ORACLES["bucketed_lookup"] = ORACLES["online_lookup"]
ORACLES["horizon_labels"] = f"""WITH {STORE_DAILY}
SELECT CAST(h AS INTEGER) AS horizon, count(*) AS rows, floor((sum(b.quantity)) * 1e2 + 0.5) / 1e2 AS labels,
  floor((sum(a.quantity)) * 1e2 + 0.5) / 1e2 AS last
FROM daily a, range(1, 31) t(h) JOIN daily b ON b.store_id = a.store_id AND b.date = a.date + to_days(CAST(h AS INTEGER))
GROUP BY h"""
ORACLES["horizon_model"] = f"""WITH {STORE_DAILY}, {LAST.format(key='store_id')}
SELECT store_id, CAST(horizon AS INTEGER) AS horizon, {day('d + CAST(horizon AS INTEGER)')} AS date, 1 AS same
FROM last, steps, final"""
