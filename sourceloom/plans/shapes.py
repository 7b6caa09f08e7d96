"""The analytic shapes found in legacy embedded SQL, runnable on Spark.

Each shape is one text with ``{table}`` names. Where the engines spell something
differently, a second text for the checking engine stands beside it. Constructs
that Spark lacks (hierarchical queries, distinct counts over windows, model
cells, row limits by other names) are rewritten as the comments say.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import graphs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name: Spark text, or (Spark text, checking text)
SHAPES: dict[str, str | tuple[str, str]] = {
    # A tree over part keys, walked from its roots with a depth limit
    "r1_recursive_hierarchy": """
WITH RECURSIVE tree(k, lvl, path) AS (
  SELECT p_partkey, 1, CAST(p_partkey AS {string}) FROM {part} WHERE p_partkey < 10
  UNION ALL
  SELECT p.p_partkey, t.lvl + 1, concat(t.path, '/', CAST(p.p_partkey AS {string}))
  FROM {part} p JOIN tree t ON CAST(floor(p.p_partkey / 10) AS BIGINT) = t.k WHERE p.p_partkey >= 10 AND t.lvl < 10)
SELECT k AS node, CAST(lvl AS BIGINT) AS depth, path FROM tree""",
    # R2: steps that build on each other
    "r2_multi_cte": """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey),
seg AS (SELECT c_mktsegment, c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM {customer} LEFT JOIN o ON o_custkey = c_custkey),
top AS (SELECT c_mktsegment, max(total) AS best FROM seg GROUP BY c_mktsegment)
SELECT seg.c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS customers, CAST(sum(n) AS BIGINT) AS n_orders, round(max(best), 2) AS best_total
FROM seg JOIN top ON seg.c_mktsegment = top.c_mktsegment GROUP BY seg.c_mktsegment""",
    # The latest earlier row, by one window over both kinds of rows instead of a correlated maximum
    "r3_asof_rate": (
        """
WITH u AS (SELECT o_custkey AS k, o_orderdate AS d, 0 AS kind, o_orderkey AS id, CAST(NULL AS DOUBLE) AS bal FROM {orders}
  UNION ALL SELECT c_custkey, make_timestamp(1995 + CAST(c_custkey % 3 AS INT), 1, 1, 0, 0, 0), -1, 0, c_acctbal FROM {customer}),
w AS (SELECT *, last_value(bal) IGNORE NULLS OVER (PARTITION BY k ORDER BY d, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM u)
SELECT id AS order_key, round(rate, 2) AS rate FROM w WHERE kind = 0""",
        """
SELECT o_orderkey AS order_key, round((SELECT c_acctbal FROM customer WHERE c_custkey = o_custkey
  AND make_timestamp(1995 + CAST(c_custkey % 3 AS INT), 1, 1, 0, 0, 0) <= o_orderdate), 2) AS rate FROM orders""",
    ),
    # Existence in the select list and in the filter
    "r4_exists_flags": """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 150000) THEN 'big' ELSE 'small' END AS kind
FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""",
    "r5_in_lists": """
SELECT o_orderkey, o_orderstatus FROM {orders}
WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') AND o_orderstatus NOT IN ('X', 'Y')""",
    # Several joins, a range on dates as the remainder of an equality join
    "r6_multiway_join": """
SELECT n_name, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey LEFT JOIN {nation} ON n_nationkey = c_nationkey
WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY n_name, o_orderpriority""",
    # Pairs close in time and price; the band joins on weeks, each row also meeting the next two
    "r7_band_self_join": (
        """
WITH x AS (SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice, CAST(floor(unix_seconds(CAST(l_shipdate AS TIMESTAMP)) / 604800) AS BIGINT) AS wk FROM {lineitem}),
y AS (SELECT *, explode(array(wk, wk - 1)) AS near FROM x)
SELECT a.l_partkey AS part_key, a.l_orderkey AS ok1, a.l_linenumber AS ln1, b.l_orderkey AS ok2, b.l_linenumber AS ln2 FROM x a JOIN y b
ON a.l_partkey = b.l_partkey AND a.wk = b.near AND (a.wk < b.wk OR a.l_shipdate <= b.l_shipdate) WHERE a.l_shipdate < b.l_shipdate AND b.l_shipdate <= a.l_shipdate + INTERVAL 7 DAY
AND b.l_extendedprice BETWEEN a.l_extendedprice * 0.95 AND a.l_extendedprice * 1.05""",
        """
SELECT a.l_partkey AS part_key, a.l_orderkey AS ok1, a.l_linenumber AS ln1, b.l_orderkey AS ok2, b.l_linenumber AS ln2 FROM lineitem a JOIN lineitem b
ON a.l_partkey = b.l_partkey AND a.l_shipdate < b.l_shipdate AND b.l_shipdate <= a.l_shipdate + INTERVAL 7 DAY
AND b.l_extendedprice BETWEEN a.l_extendedprice * 0.95 AND a.l_extendedprice * 1.05""",
    ),
    "r8_group_having": """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 7) AS mean,
  round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, round(stddev_samp(o_totalprice), 2) AS dev
FROM {orders} GROUP BY o_custkey HAVING count(*) > 5""",
    # Aggregates inside windows
    "r9_moving_avg": """
SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS revenue,
  round(CAST(sum(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) OVER (PARTITION BY l_suppkey ORDER BY date_trunc('month', l_shipdate)) AS DOUBLE), 2) AS running,
  round(CAST(sum(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) OVER (PARTITION BY l_suppkey ORDER BY date_trunc('month', l_shipdate) ROWS 2 PRECEDING) AS DOUBLE)
    / count(*) OVER (PARTITION BY l_suppkey ORDER BY date_trunc('month', l_shipdate) ROWS 2 PRECEDING), 6) AS mean3
FROM {lineitem} GROUP BY l_suppkey, date_trunc('month', l_shipdate)""",
    "r10_rankings": """
SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, CAST(rank() OVER w AS BIGINT) AS rnk, CAST(dense_rank() OVER w AS BIGINT) AS dense,
  round(percent_rank() OVER w, 6) AS pct, CAST(row_number() OVER w AS BIGINT) AS rn, coalesce(lag(o_orderkey) OVER w, -1) AS before
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    "r11_range_interval": """
SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n_hour, round(sum(value) OVER w, 4) AS value_hour
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)""",
    "r12_named_window": """
SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 2) AS running, round(max(l_quantity) OVER w, 2) AS top
FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # Distinct counts over a window, by aggregation and an equality join on the window's key
    "r13_distinct_over_window": (
        """
SELECT l.l_orderkey, l.l_linenumber, d.parts FROM {lineitem} l JOIN
  (SELECT l_orderkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM {lineitem} GROUP BY l_orderkey) d ON l.l_orderkey = d.l_orderkey""",
        "SELECT l_orderkey, l_linenumber, CAST(count(DISTINCT l_partkey) OVER (PARTITION BY l_orderkey) AS BIGINT) AS parts FROM lineitem",
    ),
    # A median of distances to a median, in two steps
    "r14_mad_zscore": (
        """
WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS mid FROM {lineitem} GROUP BY l_suppkey),
d AS (SELECT l_suppkey, median(abs(l_extendedprice - mid)) AS mad FROM {lineitem} JOIN m USING (l_suppkey) GROUP BY l_suppkey)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - mid) / nullif(mad, 0), 4) + 0.0 AS z FROM {lineitem} JOIN m USING (l_suppkey) JOIN d USING (l_suppkey)""",
        """
WITH m AS (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_suppkey) AS mid FROM lineitem),
d AS (SELECT *, median(abs(l_extendedprice - mid)) OVER (PARTITION BY l_suppkey) AS mad FROM m)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - mid) / nullif(mad, 0), 4) + 0.0 AS z FROM d""",
    ),
    "r15_percentiles_iqr": (
        """
SELECT l_suppkey, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q2,
  round(percentile_cont(0.75) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q3 FROM {lineitem} GROUP BY l_suppkey""",
        "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY l_suppkey",
    ),
    "r16_regr_trend": """
WITH m AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS t, sum(l_extendedprice) AS y FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate) * 12 + month(l_shipdate))
SELECT l_suppkey, round(regr_slope(y, CAST(t AS DOUBLE)), 2) AS slope, round(regr_r2(y, CAST(t AS DOUBLE)), 4) AS r2, CAST(count(*) AS BIGINT) AS months FROM m GROUP BY l_suppkey""",
    "r17_pivot": (
        """
SELECT CAST(day AS STRING) AS day, coalesce(click_n, 0) AS click_n, round(coalesce(click_v, 0), 4) AS click_v, coalesce(purchase_n, 0) AS purchase_n, round(coalesce(purchase_v, 0), 4) AS purchase_v
FROM (SELECT CAST(ts AS DATE) AS day, event_type, value FROM {events}) PIVOT (count(*) AS n, sum(value) AS v FOR event_type IN ('click' AS click, 'purchase' AS purchase))""",
        """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS click_n, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click_v,
  count(*) FILTER (event_type = 'purchase') AS purchase_n, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS purchase_v FROM events GROUP BY 1""",
    ),
    # Forecast cells, each from the mean of the last three months
    "r18_forecast_cells": """
WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) * 12 + month(o_orderdate) AS t, sum(o_totalprice) AS y FROM {orders} GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate)),
r AS (SELECT p, t, y, row_number() OVER (PARTITION BY p ORDER BY t DESC) AS rn FROM m),
l AS (SELECT p, max(t) AS t, sum(CASE WHEN rn = 1 THEN y END) AS a, sum(CASE WHEN rn = 2 THEN y END) AS b, sum(CASE WHEN rn = 3 THEN y END) AS c FROM r WHERE rn <= 3 GROUP BY p),
f AS (SELECT p, t, a, b, (a + b + c) / 3 AS f1 FROM l), g AS (SELECT p, t, a, f1, (f1 + a + b) / 3 AS f2 FROM f)
SELECT p AS priority, CAST(t + 1 AS BIGINT) AS month_no, round(f1, 2) AS forecast FROM g UNION ALL SELECT p, CAST(t + 2 AS BIGINT), round(f2, 2) FROM g
UNION ALL SELECT p, CAST(t + 3 AS BIGINT), round((f2 + f1 + a) / 3, 2) FROM g""",
    # A hierarchical query with level, path and leaf flag; the path test ends cycles
    "r19_hierarchical_chain": """
WITH RECURSIVE e AS (SELECT CAST(p_partkey AS BIGINT) AS child, CAST(floor(p_partkey / 7) AS BIGINT) AS parent FROM {part}),
h(node, lvl, path) AS (SELECT child, 1, concat('/', CAST(child AS {string})) FROM e WHERE child BETWEEN 1 AND 6
  UNION ALL SELECT e.child, h.lvl + 1, concat(h.path, '/', CAST(e.child AS {string})) FROM e JOIN h ON e.parent = h.node
  WHERE concat(h.path, '/') NOT LIKE concat('%/', CAST(e.child AS {string}), '/%'))
SELECT node, CAST(lvl AS BIGINT) AS lvl, path, p.parent IS NULL AS is_leaf FROM h LEFT JOIN (SELECT DISTINCT parent FROM e) p ON p.parent = h.node""",
    "r20_regexp_parse": (
        r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#?0*([0-9]+)', 2) AS num, regexp_like(c_name, '(?i)customer') AS named FROM {customer}",
        r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#?0*([0-9]+)', 2) AS num, regexp_matches(c_name, '(?i)customer') AS named FROM customer",
    ),
    "r21_listagg": (
        "SELECT l_suppkey, listagg(DISTINCT p_brand, ',') WITHIN GROUP (ORDER BY p_brand) AS brands FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_suppkey",
        "SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey",
    ),
    "r22_scalar_functions": (
        """
SELECT c_custkey, nvl(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, decode(c_nationkey % 3, 0, 'a', 1, 'b', 'c') AS grp, greatest(c_acctbal, 0) AS pos, least(c_acctbal, 100) AS low,
  round(power(c_nationkey, 2), 0) AS sq, round(ln(abs(c_acctbal) + 1), 4) AS lg, lpad(CAST(c_custkey AS STRING), 9, '0') AS padded, substr(c_name, 1, 4) || '!' AS cut FROM {customer}""",
        """
SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS grp, greatest(c_acctbal, 0) AS pos, least(c_acctbal, 100) AS low,
  round(power(c_nationkey, 2), 0) AS sq, round(ln(abs(c_acctbal) + 1), 4) AS lg, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS padded, substr(c_name, 1, 4) || '!' AS cut FROM customer""",
    ),
    "r23_date_functions": (
        """
SELECT o_orderkey, date_format(o_orderdate, 'yyyyMMdd') AS ymd, CAST(CAST(trunc(o_orderdate, 'MM') AS DATE) AS STRING) AS month, CAST(add_months(CAST(o_orderdate AS DATE), 3) AS STRING) AS later,
  CAST(extract(DOW FROM o_orderdate) - 1 AS BIGINT) AS dow, CAST(hour(o_orderdate) AS BIGINT) AS hr FROM {orders}""",
        """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS later,
  CAST(extract(DOW FROM o_orderdate) AS BIGINT) AS dow, CAST(hour(o_orderdate) AS BIGINT) AS hr FROM orders""",
    ),
    "r24_date_arithmetic": """
SELECT o_orderkey, CAST(count(*) AS BIGINT) AS near FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE l_shipdate BETWEEN o_orderdate - INTERVAL 7 DAY AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey""",
    # An ordered report's first rows; the order is total, so the rows are fixed
    "r25_order_by_case_limit": """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders}
ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50""",
    "r27_first_row_per_group": """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1""",
    "r28_union_all": """
SELECT 'c' AS kind, c_nationkey AS nation_key, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY c_nationkey
UNION ALL SELECT 's', s_nationkey, round(sum(s_acctbal), 2) FROM {supplier} GROUP BY s_nationkey""",
    "r29_duplicate_counts": "SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_partkey, l_suppkey) d WHERE n > 1",
    # An update, a delete and an insert as one new relation
    "r30_dml_as_relation": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'C' ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderstatus <> 'P'
UNION ALL SELECT -c_custkey, 'N' FROM {customer} WHERE c_acctbal < 0""",
    "a15_rollup_totals": """
SELECT coalesce(o_orderstatus, 'ALL') AS status, coalesce(o_orderpriority, 'ALL') AS priority, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS high
FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    # Suppliers that every part of a size has in common, as counts of matches
    "a13_common_members": """
SELECT l_suppkey FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_size <= 5 GROUP BY l_suppkey
HAVING count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM {part} WHERE p_size <= 5)""",
    "w2_latest_n": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) t WHERE rn <= 3",
    "w4_top_k": "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    # Islands of events at most ten minutes apart
    "w6_islands": (
        """
WITH g AS (SELECT *, CASE WHEN unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 600000000 THEN 0 ELSE 1 END AS gap FROM {events}),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, island""",
        """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 600000000 THEN 0 ELSE 1 END AS gap FROM events),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, island""",
    ),
    "x4_keep_first_by_key": "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM {lineitem}) t WHERE rn = 1",
    "a20_success_rate": "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS rate FROM {events} GROUP BY user_id",
}

#: recursive shapes level by level on Spark, whose recursive queries end at a number of rows: the first rows, those that a level leads to, the result
LEVELS: dict[str, tuple[str, str, str]] = {
    "r1_recursive_hierarchy": (
        "SELECT p_partkey AS k, 1 AS lvl, CAST(p_partkey AS STRING) AS path FROM {part} WHERE p_partkey < 10",
        """
SELECT p.p_partkey AS k, t.lvl + 1 AS lvl, concat(t.path, '/', CAST(p.p_partkey AS STRING)) AS path
FROM {part} p JOIN {level} t ON CAST(floor(p.p_partkey / 10) AS BIGINT) = t.k WHERE p.p_partkey >= 10 AND t.lvl < 10""",
        "SELECT k AS node, CAST(lvl AS BIGINT) AS depth, path FROM {rows}",
    ),
    "r19_hierarchical_chain": (
        "SELECT CAST(p_partkey AS BIGINT) AS node, 1 AS lvl, concat('/', CAST(p_partkey AS STRING)) AS path FROM {part} WHERE p_partkey BETWEEN 1 AND 6",
        """
SELECT e.child AS node, h.lvl + 1 AS lvl, concat(h.path, '/', CAST(e.child AS STRING)) AS path
FROM (SELECT CAST(p_partkey AS BIGINT) AS child, CAST(floor(p_partkey / 7) AS BIGINT) AS parent FROM {part}) e JOIN {level} h ON e.parent = h.node
WHERE concat(h.path, '/') NOT LIKE concat('%/', CAST(e.child AS STRING), '/%')""",
        "SELECT node, CAST(lvl AS BIGINT) AS lvl, path, p.parent IS NULL AS is_leaf FROM {rows} LEFT JOIN (SELECT DISTINCT CAST(floor(p_partkey / 7) AS BIGINT) AS parent FROM {part}) p ON p.parent = node",
    ),
}


def _spark_text(text: str) -> str:
    return text.replace("{string}", "STRING")


def check_text(name: str) -> str:
    """The shape for the checking engine, with plain table names."""
    shape = SHAPES[name]
    text = shape[1] if isinstance(shape, tuple) else shape
    return re.sub(r"\{(\w+)\}", lambda m: "VARCHAR" if m[1] == "string" else m[1], text)


def run_shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shape = SHAPES[name]
    text = _spark_text(shape[0] if isinstance(shape, tuple) else shape)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if name not in LEVELS:
        return spark.sql(text, **used)
    given = lambda step, **more: spark.sql(step, **{t: df for t, df in (used | more).items() if "{" + t + "}" in step})
    first, following, result = LEVELS[name]
    return given(result, rows=graphs.walked(given(first), lambda level: given(following, level=level)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: run_shape(spark, sf_dir, name) for name in SHAPES}


def oracles() -> dict[str, str]:
    return {name: check_text(name) for name in SHAPES}
