"""Queries that use operators through the DataFrame API, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from silt.functions import geo, scalar
from silt.operators import enrich, joins, processors, star
from silt.plans.runner import run_sql
from silt.schema import normalize_conflicts
from silt.sinks import encode
from silt.sources import generator, otlp, text

Query = Callable[[SparkSession, str], DataFrame]
FRAMES: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FRAMES[f.__name__] = (f, oracle)
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("""SELECT e.event_id, v.value AS view_value FROM events e ASOF LEFT JOIN
    (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
    ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_prev_view(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), views, "ts", ["user_id"], "view_").select("event_id", "view_value")


@query("""SELECT e.event_id, v.value AS view_value FROM events e ASOF JOIN
    (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
    ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_inner(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), views, "ts", ["user_id"], "view_", "inner").select("event_id", "view_value")


@query("""SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON p_size BETWEEN 6 * s_suppkey AND 6 * s_suppkey + 3""")
def range_lookup(spark, sf_dir):
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    ranges = supplier.select("s_suppkey", (F.col("s_suppkey") * 6).alias("low"), (F.col("s_suppkey") * 6 + 3).alias("high"))
    return joins.range_join(part, F.col("p_size"), ranges, "low", "high", 4).select("p_partkey", "s_suppkey")


GEO = """ip_range_start,ip_range_end,country_code,country_name,city,stateprov,latitude,longitude,asn,org
10.0.0.0,10.0.63.255,AU,Australia,Sydney,NSW,-33.9,151.2,AS1,One
10.0.64.0,10.0.127.255,US,United States,Ashburn,VA,39.0,-77.5,AS2,Two
"""


@query("""SELECT event_id, CASE WHEN user_id % 256 < 64 THEN 'AU' WHEN user_id % 256 < 128 THEN 'US' END AS country,
    CASE WHEN user_id % 256 < 64 THEN 1 WHEN user_id % 256 < 128 THEN 2 END AS asn FROM events""")
def geo_csv_range(spark, sf_dir):
    geo.register(spark, geo.read_ranges(GEO.splitlines()))
    sql = """SELECT event_id, get_field(g, 'country_code') AS country, get_field(g, 'asn') AS asn FROM
        (SELECT event_id, geo_lookup(concat('10.0.', CAST(user_id % 256 AS STRING), '.7')) AS g FROM logs) t"""
    return run_sql(sql, events(spark, sf_dir))


_FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({0}) + 1),
    lambda i: ascii(substring({0}, i, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""


@query(f"SELECT p_partkey, CAST({_FNV.format('p_name')} AS DOUBLE) AS h, CAST({_FNV.format('p_name')} % 10 AS BIGINT) AS bucket FROM part")
def fnv_hash(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return run_sql("SELECT p_partkey, CAST(hash(p_name) AS DOUBLE) AS h, CAST(hash(p_name) % 10 AS BIGINT) AS bucket FROM logs", part)


@query(f"SELECT p_partkey FROM part WHERE {_FNV.format('p_name')} % 10 = 0")
def hash_sample(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return run_sql("SELECT p_partkey FROM logs WHERE hash(p_name) % 10 = 0", part)


@query("""SELECT event_id, event_type IN ('click', 'view') AS bl_match, CASE event_type WHEN 'click' THEN 'noise' END AS bl_category FROM events""")
def blocklist(spark, sf_dir):
    entries = processors.read_blocklist(spark, "key,category\nclick,noise\nview\n\nnone,x\n")
    return processors.blocklist(events(spark, sf_dir), "event_type", entries, "bl").select("event_id", "bl_match", "bl_category")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '{"team":"ui"}' END AS web_json,
    CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'error: status 503' ELSE 'miss' END AS web_status FROM events""")
def http_enrich(spark, sf_dir):
    def fetch(key: str) -> tuple[int, str]:
        return {"click": (200, '{"team":"ui"}'), "view": (503, "")}.get(key, (404, ""))

    return processors.http_enrich(events(spark, sf_dir), "event_type", fetch, "web").select("event_id", "web_json", "web_status")


@query("""SELECT 'event_id' AS key, 1 AS type, COUNT(event_id) AS n, CAST(SUM(event_id) AS DOUBLE) AS total FROM events UNION ALL
    SELECT 'value', 2, COUNT(value), ROUND(SUM(value), 2) FROM events UNION ALL
    SELECT 'user_id', 1, COUNT(user_id), CAST(SUM(user_id) AS DOUBLE) FROM events""")
def star_log_attrs(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "value", "user_id", F.col("event_type").alias("level"), F.col("props").alias("body"))
    attrs = star.flat_to_star(df).log_attrs
    total = F.round(F.coalesce(F.sum("int").cast("double"), F.sum("double")), 2)
    return attrs.groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'ERROR' AS level, props AS message, event_type AS service, CAST(event_id % 3 AS VARCHAR) AS pod FROM events""")
def star_roundtrip(spark, sf_dir):
    df = events(spark, sf_dir).select(
        "event_id", F.lit("ERROR").alias("level"), F.col("props").alias("body"), F.col("event_type").alias("resource.attributes.service"),
        (F.col("event_id") % 3).alias("resource.attributes.pod"))
    flat = star.star_to_flat(star.flat_to_star(df), ["event_id"], ["service", "pod"])
    return flat.select(
        "event_id", "level", "message", F.col("`resource.attributes.service`").alias("service"), F.col("`resource.attributes.pod`").alias("pod"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN event_type END AS status,
    event_id % 4 = 0 AS numeric FROM events""")
def conflict_normalize(spark, sf_dir):
    k = F.col("event_id") % 4
    status = F.struct(
        F.when(k == 0, F.col("user_id")).alias("int"), F.when(k == 1, F.lit(True)).alias("bool"), F.when(k == 2, F.col("event_type")).alias("str"))
    df = normalize_conflicts(events(spark, sf_dir).select("event_id", status.alias("status")))
    return run_sql("SELECT event_id, status, int(status) IS NOT NULL AS numeric FROM logs", df)


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","none":null,"half":' || (event_id % 8) || '.5}' AS value FROM events""")
def row_json(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "event_type", F.lit(None).cast("string").alias("none"), (F.col("event_id") % 8 + F.lit(0.5).cast("double")).alias("half"))
    return df.select("event_id", encode.row_json(df).alias("value"))


@query("""SELECT strftime(ts, '%H:%M:%S') || '  ' || rpad(event_type, CAST(greatest(5, length(event_type)) AS INTEGER), ' ') || '  ' || props || '  event_id=' || event_id AS value FROM events""")
def console_lines(spark, sf_dir):
    df = events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("level"), F.col("props").alias("message"), "event_id")
    return encode.console_lines(df)


@query("""SELECT '{"index":{"_index":"logs"}}' || chr(10) || '{"event_id":' || event_id || ',"level":"' || event_type ||
    '","@timestamp":"1970-01-01T00:00:00.000000000Z"}' || chr(10) AS value FROM events""")
def bulk_lines(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.nullif(F.lit("a"), F.lit("a")).alias("gone"), F.col("event_type").alias("level"))
    return encode.bulk_lines(df, "logs")


@query("""SELECT event_type AS type, 'prod' AS env, 1000000000000000000 + event_id AS ns, '{"event_type":"' || event_type || '","_timestamp":"' || (1000000000000000000 + event_id) || '"}' AS line FROM events""")
def label_streams(spark, sf_dir):
    stamp = (F.lit(10**18) + F.col("event_id")).cast("string").alias("_timestamp")
    rows = encode.streams(events(spark, sf_dir).select("event_type", stamp), {"event_type": "type"}, {"env": "prod"})
    return rows.select(F.col("labels")["type"].alias("type"), F.col("labels")["env"].alias("env"), "ns", "line")


@query("""WITH l AS (SELECT *, 'f' || (user_id % 10) AS path, CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
        CASE WHEN event_id % 5 < 2 THEN 'F' ELSE 'P' END AS flag FROM events),
    g AS (SELECT *, COUNT(*) FILTER (WHERE flag = 'F') OVER (PARTITION BY path, stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM l)
    SELECT path, stream, MAX(event_id) AS line_no, string_agg(event_type || ' ' || event_id, '' ORDER BY event_id) AS message
    FROM g GROUP BY path, stream, coalesce(grp, 0) HAVING COUNT(*) FILTER (WHERE flag = 'F') > 0""")
def cri_reassemble(spark, sf_dir):
    e = events(spark, sf_dir)
    stream = F.when(F.col("event_id") % 2 == 0, "stdout").otherwise("stderr")
    flag = F.when(F.col("event_id") % 5 < 2, "F").otherwise("P")
    value = F.concat_ws(" ", F.lit("2024-01-01T00:00:00Z"), stream, flag, F.concat_ws(" ", "event_type", "event_id"))
    lines = e.select(value.alias("value"), F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")).alias("path"), F.col("event_id").alias("line_no"))
    return text.reassemble(lines).select("path", "stream", "line_no", "message")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_rows(spark, sf_dir):
    lines = events(spark, sf_dir).select("event_id", F.col("props").alias("value"))
    return text.json_rows(lines, StructType([StructField("k", LongType())]), ("event_id",))


@query("SELECT 'k' AS name, 'bigint' AS type")
def ndjson_discover(spark, sf_dir):
    schema = text.discover(events(spark, sf_dir).select(F.col("props").alias("value")))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, type string")


@query("""SELECT CAST(i AS BIGINT) AS i, ['INFO', 'DEBUG', 'WARN', 'ERROR'][i % 4 + 1] AS level,
    ['GET', 'POST', 'PUT', 'DELETE'][i % 4 + 1] || ' ' || ['/api/v1/users', '/api/v1/orders', '/api/v2/products', '/health', '/api/v1/auth'][i % 5 + 1] || '/' ||
    (10000 + 7 * i % 90000) || ' ' || (CASE WHEN i % 20 = 0 THEN 500 WHEN i % 20 IN (1, 2) THEN 404 WHEN i % 20 = 3 THEN 429 ELSE 200 END) AS message,
    CAST(1 + 13 * i % 500 AS BIGINT) AS duration_ms, ['myapp', 'gateway', 'auth-svc'][i % 3 + 1] AS service,
    lpad(lower(to_hex(CAST(CAST(i AS UHUGEINT) * 5871781006564002453::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT))), 16, '0') AS request_id
    FROM range(100000) t(i)""")
def generator_logs(spark, sf_dir):
    rows = generator.logs_of(spark.range(100000).withColumnRenamed("id", "i"))
    i = F.expr("(unix_millis(to_timestamp(timestamp)) - 1705276800000)").alias("i")
    return rows.select(i, "level", "message", "duration_ms", "service", "request_id")


@query("""SELECT (CAST(1000000000000000000 AS BIGINT) + event_id) AS timestamp, event_type AS level, props AS body, CAST(user_id AS VARCHAR) AS uid FROM events""")
def otlp_roundtrip(spark, sf_dir):
    # Spread first: requests are made and read partition by partition, and the table is one file.
    stamp = (F.lit(10**18) + F.col("event_id")).cast("string").alias("timestamp")
    flat = events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).select(stamp, F.col("event_type").alias("level"), F.col("props").alias("body"), F.col("user_id").alias("uid"), F.lit("x").alias("resource.attributes.host"))
    return otlp.read_requests(encode.otlp_requests(flat), ["uid"], ["host"]).select("timestamp", "level", "body", "uid")


@query("""SELECT e.event_id, t.team FROM events e LEFT JOIN (VALUES ('click', 'ui'), ('view', 'web'), ('purchase', '')) t(kind, team) ON e.event_type = t.kind""")
def enrich_csv(spark, sf_dir):
    teams = enrich.csv_table(spark, "kind,team\nclick,ui\nview,web\npurchase,\n")
    return run_sql("SELECT e.event_id, t.team FROM logs e LEFT JOIN teams t ON e.event_type = t.kind", events(spark, sf_dir), {"teams": teams})


@query("""SELECT e.event_id, t.owner, t.n FROM events e JOIN (VALUES ('click', 'a', NULL), ('view', NULL, '8')) t(kind, owner, n) ON e.event_type = t.kind""")
def enrich_jsonl(spark, sf_dir):
    owners = enrich.jsonl_table(spark, '{"kind":"click","owner":"a"}\n\n{"kind":"view","n":8}\n')
    return run_sql("SELECT e.event_id, t.owner, t.n FROM logs e JOIN owners t ON e.event_type = t.kind", events(spark, sf_dir), {"owners": owners})


@query("SELECT event_id, 'prod' AS environment, 'eu' AS region FROM events")
def enrich_static(spark, sf_dir):
    env = enrich.static(spark, {"environment": "prod", "region": "eu"})
    return run_sql("SELECT logs.event_id, env.* FROM logs CROSS JOIN env", events(spark, sf_dir), {"env": env})


@query("""SELECT event_id, 'ns' || (user_id % 3) AS namespace, 'my-pod_' || (user_id % 5) AS pod_name, 'app' AS container_name FROM events""")
def enrich_pod_path(spark, sf_dir):
    n = F.col("user_id")
    path = F.concat(F.lit("/var/log/pods/ns"), (n % 3).cast("string"), F.lit("_my-pod_"), (n % 5).cast("string"), F.lit("_12345678-1234-1234-1234-123456789abc/app/0.log"))
    logs = events(spark, sf_dir).select("event_id", path.alias("path")).withColumn("prefix", enrich.pod_prefix(F.col("path")))
    sql = "SELECT l.event_id, p.namespace, p.pod_name, p.container_name FROM logs l JOIN pods p ON l.prefix = p.log_path_prefix"
    return run_sql(sql, logs, {"pods": enrich.k8s_path(logs)})


@query("""SELECT event_id, CAST(epoch_ns(ts) AS BIGINT) // 1000000000 * 1000000000 + 123456789 AS ns FROM events""")
def epoch_nanos(spark, sf_dir):
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789Z"))
    return events(spark, sf_dir).select("event_id", scalar.epoch_nanos(t).alias("ns"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 13 WHEN 2 THEN 17 ELSE 0 END AS n FROM events""")
def severity_numbers(spark, sf_dir):
    level = F.get(F.array(*map(F.lit, ("info", "Warning", "ERROR", "odd"))), (F.col("event_id") % 4).cast("int"))
    return events(spark, sf_dir).select("event_id", scalar.severity_number(level).alias("n"))
