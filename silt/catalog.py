"""Queries over the driver's tables, each with the SQL that gives the same rows in DuckDB.

`events` stands for the log rows: SQL is written over `logs` and goes through the dialect and the runner, as a user's
would. Every query reads its whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silt.plans.runner import run_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: name: (SQL over logs, the oracle's SQL or None where the same text serves). Oracles name `events` for `logs`.
SQL: dict[str, tuple[str, str | None]] = {
    # Projections and filters.
    "select_star": ("SELECT * FROM logs", None),
    "select_qualified_star": (
        "SELECT logs.*, n.n_name FROM logs JOIN nation n ON n.n_nationkey = logs.user_id % 25", None),
    "project_cols": ("SELECT event_id, event_type AS level, value FROM logs", None),
    "select_except": ("SELECT * EXCEPT (props, ts) FROM logs", "SELECT * EXCLUDE (props, ts) FROM events"),
    "rename_except": (
        "SELECT * EXCEPT (props, ts, value), value AS duration_ms FROM logs",
        "SELECT * EXCLUDE (props, ts, value), value AS duration_ms FROM events"),
    "literal_col": ("SELECT event_id, 'prod' AS env, event_id * 2 + 1 AS odd FROM logs", None),
    "quoted_identifiers": ('SELECT "event_id" AS "Id", "event_type" AS "log.level" FROM logs', None),
    "where_eq": ("SELECT event_id, value FROM logs WHERE event_type = 'click'", None),
    "where_compound": (
        "SELECT event_id, user_id FROM logs WHERE (value > 50 AND event_type <> 'view') OR NOT user_id >= 10", None),
    "where_in": ("SELECT event_id FROM logs WHERE event_type IN ('click', 'purchase')", None),
    "where_not_in": ("SELECT event_id FROM logs WHERE event_type NOT IN ('click', 'purchase')", None),
    "where_like_prefix": ("SELECT doc_id, source FROM documents WHERE text LIKE 'The%'", None),
    "where_like_contains": ("SELECT doc_id FROM documents WHERE text LIKE '%License%'", None),
    "where_ilike": ("SELECT doc_id FROM documents WHERE text ILIKE '%license%'", None),
    "where_like_escape": ("SELECT doc_id FROM documents WHERE text LIKE '%!%!%%' ESCAPE '!'", None),
    "where_between": ("SELECT event_id, value FROM logs WHERE value BETWEEN 10 AND 20", None),
    "where_is_null": (
        "SELECT event_id, NULLIF(event_type, 'click') IS NULL AS was_click FROM logs WHERE value IS NOT NULL", None),
    "where_is_true": (
        "SELECT event_id FROM logs WHERE (value > 50) IS TRUE OR (user_id < 5) IS NOT FALSE",
        "SELECT event_id FROM events WHERE coalesce(value > 50, false) OR coalesce(user_id < 5, true)"),
    "where_is_distinct": ("SELECT event_id FROM logs WHERE event_type IS DISTINCT FROM 'click'", None),
    "where_is_not_distinct": ("SELECT event_id FROM logs WHERE NULLIF(event_type, 'view') IS NOT DISTINCT FROM NULL", None),
    "where_similar_to": (
        "SELECT event_id, event_type FROM logs WHERE event_type SIMILAR TO '(click|p%)'",
        "SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, '(click|p.*)')"),
    "where_in_unnest": (
        "SELECT event_id FROM logs WHERE event_type IN UNNEST(array('click', 'view'))",
        "SELECT event_id FROM events WHERE list_contains(['click', 'view'], event_type)"),
    "case_searched": (
        "SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band FROM logs", None),
    "case_simple": (
        "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code FROM logs", None),
    "cast_types": (
        "SELECT event_id, CAST(user_id AS STRING) AS user_text, CAST(value AS BIGINT) AS whole FROM logs WHERE value = floor(value)",
        "SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, CAST(value AS BIGINT) AS whole FROM events WHERE value = floor(value)"),
    "coalesce_nullif": (
        "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none') AS kind FROM logs", None),
    # Aggregates.
    "group_count": ("SELECT event_type, COUNT(*) AS n FROM logs GROUP BY event_type", None),
    "group_sum": ("SELECT event_type, ROUND(SUM(value), 2) AS total FROM logs GROUP BY event_type", None),
    "group_avg": ("SELECT event_type, ROUND(AVG(value), 4) AS mean FROM logs GROUP BY event_type", None),
    "having_max": (
        "SELECT user_id, MAX(value) AS most FROM logs GROUP BY user_id HAVING MAX(value) > 90", None),
    "min_max": ("SELECT event_type, MIN(value) AS least, MAX(value) AS most FROM logs GROUP BY event_type", None),
    "count_distinct": ("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM logs GROUP BY event_type", None),
    "group_not_selected": ("SELECT COUNT(*) AS n FROM logs GROUP BY user_id, event_type", None),
    "stddev_var": (
        "SELECT event_type, ROUND(STDDEV(value), 4) AS sd, ROUND(VAR_POP(value), 3) AS vp FROM logs GROUP BY event_type", None),
    "median": ("SELECT event_type, ROUND(MEDIAN(value), 4) AS mid FROM logs GROUP BY event_type", None),
    "string_agg": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_filter": (
        "SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) AS n FROM logs GROUP BY event_type", None),
    "grouping_sets": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "distinct": ("SELECT DISTINCT event_type, user_id % 10 AS bucket FROM logs", None),
    # Joins.
    "join_inner": (
        "SELECT e.event_id, c.c_name FROM logs e JOIN customer c ON e.user_id = c.c_custkey", None),
    "join_left": (
        "SELECT e.event_id, s.s_name FROM logs e LEFT JOIN supplier s ON e.user_id = s.s_suppkey", None),
    "join_right": (
        "SELECT e.event_id, s.s_suppkey FROM logs e RIGHT JOIN supplier s ON e.user_id = s.s_suppkey", None),
    "join_full": (
        "SELECT n.n_name, s.s_name FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_suppkey", None),
    "join_semi": (
        "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey",
        "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": (
        "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey",
        "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_right_semi": (
        "SELECT o_orderkey FROM customer c RIGHT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 WHERE o_totalprice > 1000",
        "SELECT o_orderkey FROM orders o SEMI JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 WHERE o_totalprice > 1000"),
    "join_right_anti": (
        "SELECT o_orderkey FROM customer c RIGHT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0",
        "SELECT o_orderkey FROM orders o ANTI JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0"),
    "join_using_self": (
        "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b USING (n_regionkey)", None),
    "join_natural": ("SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r", None),
    "join_theta": (
        "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None),
    "join_straight": (
        "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_cross_one_row": (
        "SELECT event_id, env.name AS env FROM logs CROSS JOIN (SELECT 'prod' AS name) env", None),
    "cross_apply": (
        "SELECT n_name, big.c_custkey FROM nation CROSS APPLY (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) big",
        "SELECT n_name, big.c_custkey FROM nation CROSS JOIN LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) big"),
    "outer_apply": (
        "SELECT n_name, big.least FROM nation OUTER APPLY (SELECT MIN(s_suppkey) AS least FROM supplier WHERE s_nationkey = n_nationkey) AS big",
        "SELECT n_name, big.least FROM nation LEFT JOIN LATERAL (SELECT MIN(s_suppkey) AS least FROM supplier WHERE s_nationkey = n_nationkey) AS big ON true"),
    "asof_sql": (
        "SELECT o.o_orderkey, p.ts AS seen FROM orders o ASOF JOIN logs p MATCH_CONDITION (o.o_orderdate >= p.ts) ON o.o_custkey = p.user_id WHERE o.o_totalprice > 500",
        "SELECT o_orderkey, (SELECT MAX(ts) FROM events WHERE user_id = o_custkey AND ts <= o_orderdate) AS seen FROM orders WHERE o_totalprice > 500"),
    "join_three": (
        "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    # Windows.
    "row_number": (
        "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM logs", None),
    "rank_dense_rank": (
        "SELECT l_orderkey, l_linenumber, CAST(RANK() OVER w AS BIGINT) AS r, CAST(DENSE_RANK() OVER w AS BIGINT) AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)", None),
    "lag_lead": (
        "SELECT event_id, LAG(event_type) OVER w AS prev, LEAD(event_type) OVER w AS next FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "running_sum": (
        "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS running FROM logs", None),
    "moving_avg_rows": (
        "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM logs", None),
    "range_frame": (
        "SELECT l_orderkey, l_linenumber, CAST(COUNT(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM lineitem", None),
    "ntile_dist": (
        "SELECT o_orderkey, CAST(NTILE(4) OVER w AS BIGINT) AS q, ROUND(PERCENT_RANK() OVER w, 6) AS p, ROUND(CUME_DIST() OVER w, 6) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", None),
    "first_last_nth": (
        "SELECT event_id, FIRST_VALUE(event_type) OVER w AS f, LAST_VALUE(event_type) OVER w AS l, NTH_VALUE(event_type, 2) OVER w AS n FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    # Order, limits, sets, CTEs and factors.
    "order_by_multi": ("SELECT event_id, event_type, value FROM logs ORDER BY event_type ASC NULLS LAST, value DESC NULLS LAST, event_id", None),
    "order_by_not_projected": ("SELECT event_id FROM logs ORDER BY value DESC, event_id", None),
    "top_k": ("SELECT event_id, value FROM logs ORDER BY value DESC NULLS LAST, event_id LIMIT 100", None),
    "limit_offset": ("SELECT event_id FROM logs ORDER BY event_id LIMIT 20 OFFSET 10", None),
    "union_all": ("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT user_id % 7 AS k FROM logs UNION SELECT user_id % 5 FROM logs", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "except_": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "cte": ("WITH big AS (SELECT * FROM logs WHERE value > 50) SELECT event_type, COUNT(*) AS n FROM big GROUP BY event_type", None),
    "cte_nested": ("WITH a AS (SELECT user_id, value FROM logs), b AS (SELECT user_id, COUNT(*) AS n FROM a GROUP BY user_id) SELECT n, COUNT(*) AS users FROM b GROUP BY n", None),
    "cte_shadows_logs": ("WITH recent AS (SELECT * FROM logs), logs2 AS (SELECT event_type FROM recent) SELECT event_type, COUNT(*) AS n FROM logs2 GROUP BY event_type", None),
    "derived_table": ("SELECT t.k, COUNT(*) AS n FROM (SELECT user_id % 10 AS k FROM logs WHERE value > 10) t GROUP BY t.k", None),
    "scalar_subquery": ("SELECT event_id FROM logs WHERE value > (SELECT AVG(value) FROM logs)", None),
    "exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 1000)", None),
    "not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", None),
    "correlated_scalar": (
        "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer", None),
    "unnest": (
        "SELECT event_id, word FROM logs LATERAL VIEW explode(split(event_type, '')) t AS word",
        "SELECT event_id, unnest(string_split(event_type, '')) AS word FROM events"),
    "pivot": (
        "SELECT * FROM (SELECT user_id, event_type, value FROM logs) PIVOT (COUNT(value) FOR event_type IN ('click' AS click, 'view' AS view))",
        "SELECT user_id, COUNT(value) FILTER (WHERE event_type = 'click') AS click, COUNT(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id"),
    "pivot_any": (
        "SELECT * FROM (SELECT user_id % 10 AS k, event_type, value FROM logs) PIVOT (COUNT(value) FOR event_type IN (ANY))",
        "PIVOT (SELECT user_id % 10 AS k, event_type, value FROM events) ON event_type USING COUNT(value) GROUP BY k"),
    "pivot_subquery": (
        "SELECT * FROM (SELECT user_id % 10 AS k, event_type, value FROM logs) PIVOT (COUNT(value) FOR event_type IN (SELECT event_type FROM logs WHERE event_type LIKE 'c%' GROUP BY event_type))",
        "SELECT user_id % 10 AS k, COUNT(value) FILTER (WHERE event_type = 'click') AS click FROM events GROUP BY k"),
    "unpivot": (
        "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR what IN (size, price))",
        "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part"),
    "json_table": (
        "SELECT event_id, k FROM logs, LATERAL explode(json_object_keys(props)) AS t(k)",
        "SELECT event_id, unnest(json_keys(props)) AS k FROM events"),
    "json_table_columns": (
        """SELECT event_id, t.k, t.n, t.label, t.place FROM logs, JSON_TABLE(concat('{"rows":[', props, ',{"label":"', event_type, '"}]}'), '$.rows[*]'
            COLUMNS (k BIGINT PATH '$.k', n INT PATH '$.none', label VARCHAR(20), place FOR ORDINALITY)) AS t WHERE event_id < 500""",
        """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS label, 1 AS place FROM events
            WHERE event_id < 500 UNION ALL SELECT event_id, NULL, NULL, event_type, 2 FROM events WHERE event_id < 500"""),
    # Functions.
    "int_cast": (
        "SELECT event_id, int(regexp_extract(props, '([0-9]+)', 1)) AS k, int(event_type) AS none FROM logs",
        "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none FROM events"),
    "float_cast": (
        "SELECT event_id, float(CAST(value AS STRING)) AS v, float(event_type) AS none FROM logs",
        "SELECT event_id, value AS v, CAST(NULL AS DOUBLE) AS none FROM events"),
    "regexp_group": (
        "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 0) AS start FROM pages",
        "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 0) AS start FROM pages"),
    "regexp_nomatch_null": (
        "SELECT page_id, regexp_extract(url, '[?]page=([0-9]+)', 1) AS page, regexp_extract(url, 'x', 3) AS no_group FROM pages",
        "SELECT page_id, CASE WHEN regexp_matches(url, '[?]page=([0-9]+)') THEN regexp_extract(url, '[?]page=([0-9]+)', 1) END AS page, CAST(NULL AS VARCHAR) AS no_group FROM pages"),
    "regexp_optional_group": (
        "SELECT page_id, regexp_extract(url, '^(https?)://(www[.])?', 2) AS www FROM pages",
        "SELECT page_id, NULLIF(regexp_extract(url, '^(https?)://(www[.])?', 2), '') AS www FROM pages"),
    "regexp_pack": (
        "SELECT page_id, regexp_like(url, '^https') AS safe, regexp_replace(url, '[0-9]+', '#') AS masked, CAST(regexp_count(url, '/') AS BIGINT) AS slashes FROM pages",
        "SELECT page_id, regexp_matches(url, '^https') AS safe, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, length(url) - length(replace(url, '/', '')) AS slashes FROM pages"),
    "grok_url": (
        "SELECT page_id, g.scheme, g.host, g.number FROM (SELECT page_id, grok(url, '%{WORD:scheme}://%{HOSTNAME:host}/%{WORD}/%{INT:number}') AS g FROM pages)",
        "SELECT page_id, NULLIF(regexp_extract(url, '^([a-z]+)://([0-9A-Za-z.-]+)/[a-z]+/([0-9]+)', 1), '') AS scheme, NULLIF(regexp_extract(url, '^([a-z]+)://([0-9A-Za-z.-]+)/[a-z]+/([0-9]+)', 2), '') AS host, NULLIF(regexp_extract(url, '^([a-z]+)://([0-9A-Za-z.-]+)/[a-z]+/([0-9]+)', 3), '') AS number FROM pages"),
    "get_field": (
        "SELECT page_id, get_field(grok(url, '%{WORD:scheme}://'), 'scheme') AS scheme FROM pages",
        "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages"),
    "json_str": (
        "SELECT event_id, json(props, 'k') AS k, json(props, 'none') AS none FROM logs",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM events"),
    "json_int": (
        "SELECT event_id, json_int(props, 'k') AS k FROM logs",
        "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"),
    "json_float": (
        "SELECT event_id, json_float(props, 'k') AS k FROM logs",
        "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"),
    "string_fns": (
        "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS BIGINT) AS n, substring(n_name, 2, 3) AS s, trim(BOTH 'A' FROM n_name) AS t, replace(n_name, 'A', '-') AS r, reverse(n_name) AS b, concat(n_name, '!') AS c, lpad(n_name, 12, '*') AS lp, left(n_name, 2) AS lf, starts_with(n_name, 'A') AS sw, CAST(strpos(n_name, 'A') AS BIGINT) AS p FROM nation",
        "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n, substring(n_name, 2, 3) AS s, trim(n_name, 'A') AS t, replace(n_name, 'A', '-') AS r, reverse(n_name) AS b, concat(n_name, '!') AS c, lpad(n_name, 12, '*') AS lp, left(n_name, 2) AS lf, starts_with(n_name, 'A') AS sw, strpos(n_name, 'A') AS p FROM nation"),
    "string_fns_2": (
        "SELECT n_nationkey, CAST(position('A' IN n_name) AS BIGINT) AS p, overlay(n_name PLACING '__' FROM 1 FOR 1) AS o, split_part(n_name, 'A', 1) AS sp, repeat(substring(n_name, 1, 1), 3) AS rp, CAST(ascii(n_name) AS BIGINT) AS a, CAST(octet_length(n_name) AS BIGINT) AS ol, translate(n_name, 'AE', '43') AS tr, CAST(levenshtein(n_name, 'CHINA') AS BIGINT) AS lv FROM nation",
        "SELECT n_nationkey, position('A' IN n_name) AS p, '__' || substring(n_name, 2) AS o, split_part(n_name, 'A', 1) AS sp, repeat(substring(n_name, 1, 1), 3) AS rp, ascii(n_name) AS a, octet_length(encode(n_name)) AS ol, translate(n_name, 'AE', '43') AS tr, levenshtein(n_name, 'CHINA') AS lv FROM nation"),
    "math_fns": (
        "SELECT event_id, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, ROUND(abs(value - 50), 4) AS a, ROUND(sqrt(value), 4) AS s FROM logs", None),
    "extract_parts": (
        "SELECT event_id, CAST(EXTRACT(YEAR FROM ts) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM ts) AS BIGINT) AS m, CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS h FROM logs", None),
    "at_time_zone": (
        "SELECT event_id, CAST(EXTRACT(HOUR FROM ts AT TIME ZONE 'Asia/Tokyo') AS BIGINT) AS h FROM logs",
        "SELECT event_id, (EXTRACT(HOUR FROM ts) + 9) % 24 AS h FROM events"),
    "interval_filter": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL '90' DAY", None),
    # TPC-H shapes.
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "revenue_by_nation": (
        "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "large_orders": (
        "SELECT o_orderkey, ROUND(SUM(l_quantity), 2) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING SUM(l_quantity) > 150 ORDER BY qty DESC, o_orderkey LIMIT 100", None),
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
        return run_sql(sql, table(spark, sf_dir, "events"), used)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_type AS level, COUNT(*) AS n, MAX(json_int(props, 'k')) AS most FROM logs WHERE value > 50 GROUP BY event_type"
    return sql_query(sql)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from silt import frames, frames_io  # noqa: F401

    return {n: sql_query(s) for n, (s, _) in SQL.items()} | {n: f for n, (f, _) in frames.FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    from silt import frames, frames_io  # noqa: F401

    out = {n: o or re.sub(r"\blogs\b", "events", s) for n, (s, o) in SQL.items()}
    return out | {n: o for n, (_, o) in frames.FRAMES.items() if o}
