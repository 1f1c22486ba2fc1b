"""Time-series queries: stations are event types or users, readings their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import geo, parse
from rivulet.operators import metrics, routing, series, units
from rivulet.plans.common import query, r
from rivulet.sources import sinks
from rivulet.sources.tables import parse_wide, table

DAY = 86400
BUCKET = "time_bucket(INTERVAL '{}', ts, TIMESTAMP '1970-01-01')"
DAILY = f"(SELECT event_type AS station, {BUCKET.format('1 day')} AS ts, sum(value) AS value FROM events GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str, how: str = "sum", key: str = "event_type") -> DataFrame:
    return series.resample(table(spark, sf_dir, "events"), DAY, how, key).withColumnRenamed(key, "station")


@query(f"SELECT event_type, {BUCKET.format('6 hours')} AS ts, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY ALL")
def ts_resample_sum(spark, sf_dir):
    return series.resample(table(spark, sf_dir, "events"), 6 * 3600, "sum", "event_type").withColumn("value", r("value"))


@query(f"SELECT user_id, {BUCKET.format('1 day')} AS ts, round(avg(value), 8) AS value, count(*) AS n FROM events GROUP BY ALL")
def ts_resample_mean(spark, sf_dir):
    return series.resample(table(spark, sf_dir, "events"), DAY, "mean", "user_id").withColumn("value", r("value", 8))  # means of cents tie at fewer places


@query("""
WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events),
s AS (SELECT user_id, ts, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS step FROM h),
c AS (SELECT user_id, step, count(*) AS n, min(ts) AS first FROM s WHERE step > 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c)
SELECT u.user_id, coalesce(step, 86400)::BIGINT AS interval_s,
  CASE coalesce(step, 86400) WHEN 3600 THEN '1h' WHEN 7200 THEN '2h' WHEN 10800 THEN '3h' WHEN 21600 THEN '6h' WHEN 43200 THEN '12h' WHEN 86400 THEN '24h' WHEN 604800 THEN '7d' WHEN 2592000 THEN '1mon'
  ELSE (coalesce(step, 86400) // 3600)::VARCHAR || 'h' END AS label
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.user_id = u.user_id AND b.k = 1""")
def ts_detect_interval(spark, sf_dir):
    hours = series.resample(table(spark, sf_dir, "events"), 3600, "sum", "user_id")
    found = series.detect_interval(hours, "user_id")
    return found.withColumn("label", parse.interval_label(F.col("interval_s")))


QC = """
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS ts FROM events),
q AS (SELECT user_id, count(*) AS n, 0::BIGINT AS duplicates, min(ts) AS start_ts, max(ts) AS end_ts, date_diff('day', min(ts), max(ts)) + 1 AS expected FROM d GROUP BY user_id)
SELECT user_id, n, duplicates, start_ts, end_ts, expected, expected - n AS missing, round((expected - n) / expected, 4) AS missing_rate,
  CASE WHEN (expected - n) / expected <= 0.05 THEN 'ok' WHEN (expected - n) / expected <= 0.2 THEN 'warn' ELSE 'bad' END AS status FROM q"""


@query(QC)
def ts_qc_summary(spark, sf_dir):
    return series.quality(series.resample(table(spark, sf_dir, "events"), DAY, "sum", "user_id"), DAY, "user_id").withColumn("missing_rate", r("missing_rate"))


@query(f"SELECT status, count(*) AS n_series, sum(missing)::BIGINT AS missing FROM ({QC}) GROUP BY status")
def ts_qc_status(spark, sf_dir):
    rated = series.quality(series.resample(table(spark, sf_dir, "events"), DAY, "sum", "user_id"), DAY, "user_id")
    return rated.groupBy("status").agg(F.count("*").alias("n_series"), F.sum("missing").alias("missing"))


@query("""
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS ts FROM events),
g AS (SELECT user_id, ts AS gap_start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap_end FROM d),
k AS (SELECT *, date_diff('day', gap_start, gap_end) - 1 AS steps FROM g WHERE date_diff('day', gap_start, gap_end) > 1)
SELECT * FROM (SELECT user_id, gap_start, gap_end, steps, row_number() OVER (PARTITION BY user_id ORDER BY gap_start)::INT AS gap_no FROM k) WHERE gap_no <= 20""")
def ts_qc_gaps(spark, sf_dir):
    return series.gaps(series.resample(table(spark, sf_dir, "events"), DAY, "sum", "user_id"), DAY, "user_id")


@query("SELECT event_type, count(DISTINCT user_id) AS n_series, count(*) AS n_points, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY event_type")
def ts_summary_by_kind(spark, sf_dir):
    return series.summary_by_kind(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("""
WITH t AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, ts FROM t WHERE i % greatest(n // 10, 1) = 0""")
def ts_thin_stride(spark, sf_dir):
    timed = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.struct("ts", "event_id").alias("at"))
    return series.thin(timed, 10, "user_id", "at").drop("at")


@query("""
WITH x AS (SELECT o_orderkey, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 4 THEN date_trunc('month', d)::TIMESTAMP WHEN o_orderkey % 7 = 3 THEN date_trunc('day', d)::TIMESTAMP + INTERVAL 6 HOUR + INTERVAL 30 MINUTE ELSE date_trunc('day', d)::TIMESTAMP END AS ts FROM x""")
def parse_time_formats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"), (F.col("o_orderkey") % 7).alias("k"))
    days = F.timestamp_diff("DAY", F.lit("1899-12-30").cast("timestamp_ntz"), F.date_trunc("day", "d").cast("timestamp_ntz")).cast("string")
    dated = lambda pattern: F.date_format("d", pattern)
    written = F.when(F.col("k") == 0, dated("yyyy-MM-dd")).when(F.col("k") == 1, dated("yyyy/M/d")).when(F.col("k") == 2, dated("yyyyMMdd"))
    written = written.when(F.col("k") == 3, F.concat(dated("yyyy-MM-dd"), F.lit("T06:30:00"))).when(F.col("k") == 4, dated("yyyy年M月")).when(F.col("k") == 5, days).otherwise("no date")
    return orders.select("o_orderkey", parse.parse_time(written).alias("ts"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 IN (0, 3) THEN NULL ELSE round(l_extendedprice, 2) END AS value FROM lineitem""")
def parse_value_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), (F.col("l_linenumber") % 4).alias("k"))
    text = F.when(F.col("k") == 0, "缺测").when(F.col("k") == 3, "-9999").otherwise(F.concat(F.lit(" "), F.format_number("v", 2)))
    return rows.select("l_orderkey", "l_linenumber", parse.parse_value(text).alias("value"))


@query("""
SELECT station, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS start_ts FROM (UNPIVOT (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME station VALUE value) GROUP BY station""")
def unpivot_wide_series(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy/M/d").alias("day"), "l_quantity", "l_discount", "l_tax")
    long = parse_wide(wide, "day", ["l_quantity", "l_discount", "l_tax"])
    return long.groupBy("station").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"), F.min("ts").alias("start_ts"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


@query("""
WITH l AS (SELECT 10000 + n_nationkey AS left_id, CASE WHEN n_nationkey % 5 = 4 THEN lower(n_name) || ' upper' ELSE lower(n_name) END AS name, n_nationkey % 3 = 0 AS same FROM nation),
r AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 10000 + n_nationkey ELSE n_nationkey END AS right_id, lower(n_name) AS name FROM nation),
m AS (SELECT left_id, right_id, CASE WHEN left_id = right_id THEN 1 WHEN replace(l.name, ' ', '') = replace(r.name, ' ', '') THEN 2 ELSE 3 END AS tier FROM l, r
  WHERE left_id = right_id OR replace(l.name, ' ', '') = replace(r.name, ' ', '') OR contains(replace(l.name, ' ', ''), replace(r.name, ' ', '')) OR contains(replace(r.name, ' ', ''), replace(l.name, ' ', '')))
SELECT left_id::BIGINT AS left_id, right_id::BIGINT AS right_id, tier::INT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY tier, right_id) AS k FROM m) WHERE k = 1""")
def name_match_priority(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    written = F.when(F.col("k") % 5 == 4, F.concat("n_name", F.lit(" upper"))).otherwise(F.concat("n_name", F.lit("水文站")))
    left = nation.select((F.col("k") + 10000).alias("id"), parse.norm_name(written).alias("name"))
    right = nation.select(F.when(F.col("k") % 3 == 0, F.col("k") + 10000).otherwise(F.col("k")).alias("id"), parse.norm_name(F.concat("n_name", F.lit("雨量站"))).alias("name"))
    return series.match_names(left, right, "id", "name", "id", "name")


@query("""
WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997),
s AS (SELECT c_nationkey AS unit, abs(c_acctbal) AS w, p.o_custkey IS NOT NULL AS has FROM customer LEFT JOIN p ON p.o_custkey = c_custkey)
SELECT unit, count(*) AS n_stations, count(*) FILTER (has) AS n_present, round(sum(CASE WHEN has THEN w ELSE 0 END) / sum(w), 4) AS coverage,
  CASE WHEN count(*) FILTER (has) = 0 THEN 'none' WHEN count(*) FILTER (has) = count(*) THEN 'ok' ELSE 'partial' END AS status FROM s GROUP BY unit""")
def coverage_report(spark, sf_dir):
    stations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), "c_custkey", F.abs("c_acctbal").alias("weight"))
    present = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("c_custkey"))
    return series.coverage(stations, present, "unit", "c_custkey", "weight").withColumn("coverage", r("coverage"))


#: All stations of ``daily``, and units with the weights of theirs.
KINDS = ["click", "error", "purchase", "signup", "view"]
WEIGHTS = [("upper", "view", 0.5), ("upper", "click", 0.3), ("upper", "signup", 0.2), ("lower", "purchase", 0.6), ("lower", "error", 0.4)]
WEIGHT_ROWS = ", ".join(f"('{u}', '{s}', {w})" for u, s, w in WEIGHTS)
AREAL = f"SELECT unit, ts, sum(weight * value) / sum(weight) AS value FROM {DAILY} d JOIN (VALUES {WEIGHT_ROWS}) w(unit, station, weight) USING (station) GROUP BY unit, ts"


def areal(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(WEIGHTS, "unit string, station string, weight double")
    return series.areal_mean(daily(spark, sf_dir), weights)


@query(f"SELECT unit, ts, round(value, 4) AS value FROM ({AREAL})")
def areal_mean_weighted(spark, sf_dir):
    return areal(spark, sf_dir).withColumn("value", r("value"))


@query(f"""
WITH d AS (SELECT user_id, {BUCKET.format('1 day')} AS ts, sum(value) AS value FROM events GROUP BY ALL),
a AS (SELECT user_id, x.ts FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS ts) x)
SELECT user_id, ts, round(coalesce(value, avg(value) OVER (PARTITION BY user_id)), 8) AS value FROM a LEFT JOIN d USING (user_id, ts)""")
def spine_left_join_fill(spark, sf_dir):
    days = series.resample(table(spark, sf_dir, "events"), DAY, "sum", "user_id")
    return series.spine_fill(days, days, "2024-01-01", "2024-01-30", DAY, key="user_id").withColumn("value", r("value", 8))


FIT = """SELECT {by}, count(*) AS n, round(1 - sum((s - o) ** 2) / (var_pop(o) * count(*)), 4) AS nse, round(corr(s, o) ** 2, 4) AS r2,
  round(1 - sqrt((corr(s, o) - 1) ** 2 + (stddev_pop(s) / stddev_pop(o) - 1) ** 2 + (avg(s) / avg(o) - 1) ** 2), 4) AS kge, round(sqrt(avg((s - o) ** 2)), 4) AS rmse, round((sum(s) - sum(o)) / sum(o) * 100, 4) AS pbias,
  round(sum((s - o) ** 2) / (var_pop(o) * count(*)) + 0.3 * abs((sum(s) - sum(o)) / sum(o)) + 0.1 * sqrt(avg((s - o) ** 2)) / stddev_pop(o), 4) AS objective FROM {rows} GROUP BY {by}"""


def rounded_fit(fit: DataFrame) -> DataFrame:
    return fit.select("*").withColumns({c: r(c) for c in ("nse", "r2", "kge", "rmse", "pbias", "objective")})


@query(FIT.format(by="obs_station, sim_station, week", rows=f"(SELECT a.station AS obs_station, b.station AS sim_station, extract(week FROM a.ts)::INT AS week, a.value AS o, b.value AS s FROM {DAILY} a JOIN {DAILY} b ON a.ts = b.ts AND a.station < b.station)") + " HAVING count(*) >= 3")
def metrics_pairwise(spark, sf_dir):
    """Every two stations, week by week."""
    days = daily(spark, sf_dir)
    side = lambda station, name: days.select("ts", F.col("station").alias(station), F.col("value").alias(name))
    paired = metrics.pairs(side("obs_station", "obs"), side("sim_station", "sim"), ["ts"]).where("obs_station < sim_station").withColumn("week", F.weekofyear("ts"))
    return rounded_fit(metrics.fit_metrics(paired, ["obs_station", "sim_station", "week"])).where(F.col("n") >= metrics.LEAST_PAIRS)


def _fir(n: int, x: float, rows: str, key: str) -> str:
    """n nested two-tap filters, each beginning with its first inflow."""
    c0, c1 = (1 - x) / 2, (1 + x) / 2
    for _ in range(n):
        rows = f"(SELECT {key}, ts, value, {c0} * q + {c1} * coalesce(lag(q) OVER (PARTITION BY {key} ORDER BY ts), q) AS q FROM {rows})"
    return rows


@query(f"SELECT station, ts, round(value, 4) AS value, round(q, 4) AS routed FROM {_fir(3, 0.2, f'(SELECT *, value AS q FROM {DAILY})', 'station')}")
def muskingum_fir(spark, sf_dir):
    return routing.route(daily(spark, sf_dir).drop("n"), 36.0, 0.2, 24.0).select("station", "ts", r("value").alias("value"), r("routed").alias("routed"))


@query(f"""
WITH RECURSIVE s AS (SELECT station, ts, value, row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM {DAILY}),
m AS (SELECT station, i, ts, value, 0.0::DOUBLE AS out, value AS store FROM s WHERE i = 1
  UNION ALL SELECT s.station, s.i, s.ts, s.value, (1 - 0.6931472) * m.store, 0.6931472 * m.store + s.value FROM m JOIN s ON s.station = m.station AND s.i = m.i + 1)
SELECT station, ts, round(value, 4) AS inflow, round(out, 4) AS out, round(store, 4) AS store FROM m""")
def linear_reservoir(spark, sf_dir):
    return routing.reservoir(daily(spark, sf_dir), 0.6931472).withColumns({c: r(c) for c in ("inflow", "out", "store")})


_S = [routing.s_curve(k, 3.0) for k in range(4)]


@query(f"""SELECT station, ts, round(value, 4) AS value, round({' + '.join(f'coalesce(lag(value, {k}) OVER w, 0) * {_S[k] - _S[k - 1]!r}' for k in (1, 2, 3))}, 4) AS routed FROM {DAILY} WINDOW w AS (PARTITION BY station ORDER BY ts)""")
def unit_hydrograph(spark, sf_dir):
    return routing.unit_hydrograph(daily(spark, sf_dir), 3.0).select("station", "ts", r("value").alias("value"), r("routed").alias("routed"))


@query(FIT.format(by="unit", rows=f"(SELECT unit, value AS o, q AS s FROM {_fir(3, 0.2, f'(SELECT *, value AS q FROM ({AREAL}))', 'unit')})"))
def routed_fit(spark, sf_dir):
    flow = routing.route(areal(spark, sf_dir), 36.0, 0.2, 24.0, key="unit")
    return rounded_fit(metrics.fit_metrics(flow, ["unit"], "value", "routed"))


@query(f"""WITH RECURSIVE d AS (SELECT station, date_diff('day', TIMESTAMP '2024-01-01', ts) AS pos, value FROM {DAILY}),
cand AS (SELECT station, pos, value FROM (SELECT *, avg(value) OVER (PARTITION BY station) AS mean, max(value) OVER (PARTITION BY station) AS top FROM d) WHERE value >= mean OR value = top),
rec AS (SELECT DISTINCT station, 0 AS rank, []::BIGINT[] AS taken, NULL::BIGINT AS pos, NULL::DOUBLE AS value FROM cand
UNION ALL SELECT station, rank + 1, list_append(taken, p), p, v FROM (SELECT r.station, r.rank, r.taken, arg_max(c.pos, (c.value, -c.pos)) AS p, max(c.value) AS v FROM rec r JOIN cand c ON c.station = r.station AND len([t FOR t IN r.taken IF abs(t - c.pos) < 3]) = 0 WHERE r.rank < 3 GROUP BY r.station, r.rank, r.taken)),
sim AS (SELECT station, pos AS near, coalesce(lag(value) OVER (PARTITION BY station ORDER BY pos), value) AS sim FROM d)
SELECT station, rank, pos, round(any_value(value), 4) AS value, arg_max(near, (sim, -near)) - pos AS late, round((max(sim) - any_value(value)) / any_value(value), 4) AS relative_error FROM rec JOIN sim USING (station) WHERE rank > 0 AND near BETWEEN pos - 2 AND pos + 2 GROUP BY station, rank, pos""")
def peak_events(spark, sf_dir):
    days = daily(spark, sf_dir)
    epoch = F.lit("2024-01-01").cast("timestamp_ntz")
    timed = days.select("station", F.timestamp_diff("DAY", epoch, F.col("ts")).alias("pos"), "value")
    lagged = series.lags(timed, "value", 1, ts="pos").select("station", "pos", F.coalesce("value_lag1", "value").alias("sim"))
    found = metrics.peaks(timed, most=3, apart=3, factor=1.0)
    return metrics.peak_errors(found, lagged, reach=2).withColumns({"value": r("value"), "relative_error": r("relative_error")})


@query(f"SELECT month(ts)::INT AS month, day(ts)::INT AS day, round(avg(o_totalprice), 8) AS value FROM (SELECT o_orderdate AS ts, o_totalprice FROM orders) GROUP BY 1, 2")
def climatology_month_day(spark, sf_dir):
    return series.climatology(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").withColumn("value", r("value", 8))


@query("""
WITH w AS (SELECT p_partkey, p_retailprice AS total, i, greatest(0.05, CASE WHEN i <= 2.4 THEN i / 2.4 ELSE (6 - i) / 3.6 END) AS w FROM part, (SELECT unnest(range(7)) AS i))
SELECT p_partkey, i::INT AS step, round(w * total / sum(w) OVER (PARTITION BY p_partkey), 4) AS rain FROM w""")
def design_rain(spark, sf_dir):
    storm = series.design_rain(F.col("p_retailprice"), F.lit(7))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(storm).alias("step", "rain")).withColumn("rain", r("rain"))


@query(f"""
SELECT station, ts, round(value, 8) AS value, false AS is_forecast FROM {DAILY} UNION ALL
SELECT station, x.ts, round(m, 8), true FROM (SELECT station, avg(value) AS m FROM {DAILY} GROUP BY station), (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-07', INTERVAL 1 DAY)) AS ts) x""")
def forecast_extend(spark, sf_dir):
    days = daily(spark, sf_dir).select("station", "ts", "value")
    means = days.groupBy("station").agg(F.avg("value").alias("value"))
    axis = F.sequence(F.lit("2024-02-01").cast("timestamp_ntz"), F.lit("2024-02-07").cast("timestamp_ntz"), F.make_dt_interval(days=F.lit(1)))
    return series.extend(days, means.select("station", F.explode(axis).alias("ts"), "value")).withColumn("value", r("value", 8))


@query(f"SELECT station, ts, round(value, 4) AS value, round(lag(value, 1) OVER w, 4) AS value_lag1, round(lag(value, 2) OVER w, 4) AS value_lag2 FROM {DAILY} WINDOW w AS (PARTITION BY station ORDER BY ts)")
def lag_features(spark, sf_dir):
    days = series.lags(daily(spark, sf_dir).select("station", "ts", "value"), "value", 2)
    return days.withColumns({c: r(c) for c in ("value", "value_lag1", "value_lag2")})


@query(f"""
WITH f AS (SELECT value AS y, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM {DAILY} WINDOW w AS (PARTITION BY station ORDER BY ts))
SELECT count(*) AS n, round(sum(a * a), 2) AS xx_0_0, round(sum(a * b), 2) AS xx_0_1, round(sum(b * b), 2) AS xx_1_1, round(sum(a * y), 2) AS xy_0, round(sum(b * y), 2) AS xy_1 FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL""")
def ridge_normal_equations(spark, sf_dir):
    days = series.lags(daily(spark, sf_dir), "value", 2)
    sums = series.normal_equations(days, ["value_lag1", "value_lag2"], "value")
    return sums.select("n", *[r(c, 2).alias(c) for c in sums.columns if c != "n"])


@query(f"SELECT ts, {', '.join(f'''round(sum(value) FILTER (station = '{k}'), 4) AS {k}''' for k in KINDS)} FROM {DAILY} GROUP BY ts")
def pivot_flow_export(spark, sf_dir):
    wide = sinks.pivot_flows(daily(spark, sf_dir), KINDS)
    return wide.select("ts", *[r(c).alias(c) for c in KINDS])


@query("SELECT p_partkey, param, value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) ON size, price INTO NAME param VALUE value)")
def unpivot_params(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return sinks.unpivot_params(parts, "p_partkey", ["size", "price"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing_series(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_partkey, l_suppkey, round(max(l_extendedprice), 2) AS price, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -l_orderkey, -l_linenumber))::BIGINT AS line FROM lineitem GROUP BY ALL")
def dedup_keep_max(spark, sf_dir):
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), line.alias("line"))
    return units.keep_largest(rows, ["l_partkey", "l_suppkey"], "price", "line").withColumn("price", r("price", 2))


_PT = "(100 + embedding[{}]::DOUBLE * 10)"
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2))))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(at(i) + (100 if i % 2 == 0 else 30)).alias(f"c{i}") for i in range(6)])


def _sql_points() -> str:
    return f"(SELECT vec_id, label, {', '.join(f'embedding[{i + 1}]::DOUBLE * 10 + {100 if i % 2 == 0 else 30} AS c{i}' for i in range(6))} FROM embeddings)"


@query(f"""SELECT vec_id, round({_HAV.format(x1='c0', y1='c1', x2='c2', y2='c3')}, 2) AS metres, round({_HAV.format(x1='c0', y1='c1', x2='c2', y2='c3')} + {_HAV.format(x1='c2', y1='c3', x2='c4', y2='c5')}, 2) AS along,
round(abs((c0 * c3 - c2 * c1) + (c2 * c5 - c4 * c3) + (c4 * c1 - c0 * c5)) / 2 * 111.32 * 111.32 * cos(radians((c1 + c3 + c5 + c1) / 4)), 4) AS km2 FROM {_sql_points()}""")
def polyline_length(spark, sf_dir):
    p = _points(spark, sf_dir)
    point = lambda i: F.struct(F.col(f"c{i}").alias("x"), F.col(f"c{i + 1}").alias("y"))
    return p.select(
        "vec_id", r(geo.haversine(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3")), 2).alias("metres"), r(geo.polyline_length(F.array(point(0), point(2), point(4))), 2).alias("along"),
        r(geo.polygon_area_km2(F.array(point(0), point(2), point(4), point(0)))).alias("km2"),
    )


def _sql_shift(x: str, y: str) -> tuple[str, str]:
    """GCJ-02 place of a point that may lie outside the shift's box, as two expressions."""
    a, b = f"({x} - 105.0::DOUBLE)", f"({y} - 35.0::DOUBLE)"
    wave = lambda v, of: "(" + " + ".join(f"{n}::DOUBLE * sin({v} * {k}::DOUBLE * pi() / {d}::DOUBLE)" for n, k, d in of) + ") * 2 / 3"
    common = wave(a, [(20, 6, 1), (20, 2, 1)])
    dy = f"(-100 + 2 * {a} + 3 * {b} + 0.2::DOUBLE * {b} * {b} + 0.1::DOUBLE * {a} * {b} + 0.2::DOUBLE * sqrt(abs({a})) + {common} + {wave(b, [(20, 1, 1), (40, 1, 3)])} + {wave(b, [(160, 1, 12), (320, 1, 30)])})"
    dx = f"(300 + {a} + 2 * {b} + 0.1::DOUBLE * {a} * {a} + 0.1::DOUBLE * {a} * {b} + 0.1::DOUBLE * sqrt(abs({a})) + {common} + {wave(a, [(20, 1, 1), (40, 1, 3)])} + {wave(a, [(150, 1, 12), (300, 1, 30)])})"
    magic, axis = f"(1 - {geo.GCJ_EE}::DOUBLE * sin(radians({y})) ** 2)", f"{geo.GCJ_A}::DOUBLE"
    inside = f"{x} BETWEEN 72.004 AND 137.8347 AND {y} BETWEEN 0.8293 AND 55.8271"
    return (
        f"CASE WHEN {inside} THEN {x} + degrees({dx} * sqrt({magic}) / ({axis} * cos(radians({y})))) ELSE {x} END",
        f"CASE WHEN {inside} THEN {y} + degrees({dy} * {magic} * sqrt({magic}) / ({axis} * (1 - {geo.GCJ_EE}::DOUBLE))) ELSE {y} END",
    )


def _sql_there_and_back() -> str:
    gx, gy = _sql_shift("c0", "c1")
    steps = [f"WITH s0 AS (SELECT *, gx AS x, gy AS y FROM (SELECT vec_id, c0, c1, {gx} AS gx, {gy} AS gy FROM {_sql_points()}))"]
    gx, gy = _sql_shift("x", "y")
    steps += [f"s{k + 1} AS (SELECT vec_id, c0, c1, gx, gy, x + gx - ({gx}) AS x, y + gy - ({gy}) AS y FROM s{k})" for k in range(4)]
    metres = "round(sqrt((({x} - c0) * 111320 * cos(radians(({y} + c1) / 2))) ** 2 + (({y} - c1) * 110540) ** 2), 3)"
    return f"{', '.join(steps)} SELECT vec_id, {metres.format(x='gx', y='gy')} AS shift_m, {metres.format(x='x', y='y')} AS error_m FROM s4"


@query(_sql_there_and_back())
def coordinate_shift(spark, sf_dir):
    """There and back again: the error in metres of undoing the GCJ-02 shift."""
    p = _points(spark, sf_dir)
    gx, gy = geo.to_gcj(F.col("c0"), F.col("c1"))
    shifted = p.select("vec_id", "c0", "c1", gx.alias("gx"), gy.alias("gy"))
    bx, by = geo.from_gcj(F.col("gx"), F.col("gy"))
    moved = shifted.select("vec_id", "c0", "c1", "gx", "gy", bx.alias("bx"), by.alias("by"))
    d = lambda a, b: geo.planar_distance(F.col("c0"), F.col("c1"), F.col(a), F.col(b))
    return moved.select("vec_id", r(d("gx", "gy"), 3).alias("shift_m"), r(d("bx", "by"), 3).alias("error_m"))
