"""Queries over sources, formats, lookup tables, payloads and refusals, with their oracles."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from silt.frames import events, query
from silt.operators import enrich, processors, star
from silt.plans import config
from silt.plans.runner import run_sql
from silt.sinks import deliver, encode
from silt.sources import arrow_ipc, chunk, generator, net, otlp, otlp_wire, schemas, segment, text
from silt.store import fresh_path
from silt.streaming import runner

# Lines and formats.


@query("SELECT event_id, event_type, value FROM events")
def file_round_trip(spark, sf_dir):
    path = fresh_path(spark, "lines")
    deliver.to_file(events(spark, sf_dir).select("event_id", "event_type", "value"), path)
    lines = text.read_lines(spark, path)
    rows = text.json_rows(lines, text.discover(lines))
    return run_sql("SELECT event_id, event_type, float(value) AS value FROM logs", rows)


@query("SELECT COUNT(*) AS n, COUNT(*) AS places, 1 AS paths FROM events")
def packed_files(spark, sf_dir):
    path = fresh_path(spark, "packed")
    encode.json_lines(events(spark, sf_dir).select("event_id")).coalesce(1).write.option("compression", "gzip").text(path)
    lines = text.read_packed(spark, f"{path}/*.gz")
    return lines.agg(F.count("value").alias("n"), F.count_distinct("line_no").alias("places"), F.count_distinct("path").cast("int").alias("paths"))


@query("SELECT event_id, event_type AS value FROM events WHERE event_id % 3 <> 1")
def crlf_lines(spark, sf_dir):
    """Carriage returns go, lines without text too."""
    path = fresh_path(spark, "crlf")
    line = F.when(F.col("event_id") % 3 != 1, F.concat_ws(" ", "event_id", "event_type")).otherwise("")
    events(spark, sf_dir).select(F.concat(line, F.lit("\r")).alias("value")).write.text(path)
    part = lambda k: F.split_part("value", F.lit(" "), F.lit(k))
    return text.read_lines(spark, path).select(part(1).cast("bigint").alias("event_id"), part(2).alias("value"))


@query("SELECT event_id, props AS body FROM events")
def raw_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    return text.raw(e.select("event_id", F.col("event_type").alias("body"), F.col("props").alias("value")))


def _mixed(spark, sf_dir):
    e, k = events(spark, sf_dir), F.col("event_id") % 4
    head = F.lit("2024-01-01T00:00:00Z stderr F ")
    value = (
        F.when(k == 0, F.concat(head, F.col("props"))).when(k == 1, F.concat(head, F.col("event_type")))
        .when(k == 2, F.col("props")).otherwise(F.col("event_type"))
    )
    return e.select(value.alias("value"), F.lit("f").alias("path"), F.col("event_id").alias("line_no"))


@query("""SELECT event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN props END AS value, CASE WHEN event_id % 2 = 1 THEN event_type END AS body,
    CASE WHEN event_id % 4 < 2 THEN '2024-01-01T00:00:00Z' END AS _timestamp, CASE WHEN event_id % 4 < 2 THEN 'stderr' END AS _stream FROM events""")
def auto_lines(spark, sf_dir):
    return text.auto(_mixed(spark, sf_dir)).drop("path")


@query("SELECT event_id AS line_no, CASE WHEN event_id % 4 = 0 THEN props END AS value, CASE WHEN event_id % 4 = 1 THEN event_type END AS body FROM events WHERE event_id % 4 < 2")
def cri_lines(spark, sf_dir):
    return text.cri(_mixed(spark, sf_dir).where("line_no % 4 < 2")).select("line_no", "value", "body")


@query("SELECT COUNT(*) FILTER (WHERE event_id % 4 <> 2) AS errors FROM events")
def json_parse_errors(spark, sf_dir):
    return _mixed(spark, sf_dir).agg(text.parse_errors(_mixed(spark, sf_dir)).alias("errors"))


@query("SELECT COUNT(*) FILTER (WHERE event_id % 5 <> 0) AS n FROM events")
def utf8_lines(spark, sf_dir):
    broken = F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("C328"))).otherwise(F.col("event_type").cast("binary"))
    return text.valid_utf8(events(spark, sf_dir).select(broken.cast("string").alias("value"))).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'A' || chr(233) WHEN 1 THEN chr(128512) ELSE 'q"\\/' END AS v, event_id AS first FROM events""")
def json_escapes(spark, sf_dir):
    """Escapes in keys and values, and the first of equal keys."""
    k = F.col("event_id") % 3
    shown = F.when(k == 0, r'"Aé"').when(k == 1, r'"😀"').otherwise(r'"q\"\\\/"')
    line = F.concat(F.lit(r'{"key":'), shown, F.lit(',"n":"'), F.col("event_id"), F.lit('","n":"0"}'))
    rows = text.json_rows(events(spark, sf_dir).select("event_id", line.alias("value")), _strings("key", "n"), ("event_id",))
    return rows.select("event_id", F.col("key").alias("v"), F.col("n").cast("bigint").alias("first"))


def _strings(*names):
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([StructField(n, StringType()) for n in names])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id END AS i, CASE event_id % 4 WHEN 1 THEN event_id + 0.5 END AS f,
    CASE event_id % 4 WHEN 2 THEN true END AS b, CASE event_id % 4 WHEN 3 THEN event_type END AS s, '[1,{"a":2}]' AS nested FROM events""")
def ndjson_conflicts(spark, sf_dir):
    """A field of four types, found by discovery, and a nested value as its text."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    shown = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".5"))).when(k == 2, "true").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    lines = events(spark, sf_dir).select("event_id", F.concat(F.lit('{"x":'), shown, F.lit(',"nested":[1,{"a":2}]}')).alias("value"))
    rows = text.json_rows(lines, text.discover(lines), ("event_id",))
    return rows.select("event_id", F.col("x.int").alias("i"), F.col("x.float").alias("f"), F.col("x.bool").alias("b"), F.col("x.str").alias("s"), "nested")


@query("""SELECT 'f' || event_id % 3 AS "log.file.path", COUNT(*) AS n, 1 AS ids FROM events GROUP BY 1""")
def source_metadata(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("path"))
    rows = text.attach_source(rows, "otel")
    return rows.groupBy("`log.file.path`").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__source_id").cast("int").alias("ids"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 't' ELSE event_type END AS _timestamp, CASE WHEN event_id % 2 = 0 THEN 'stdout' END AS _stream FROM events")
def cri_sidecar(spark, sf_dir):
    rows, even = events(spark, sf_dir).select("event_id", F.col("event_type").alias("_timestamp")), F.col("event_id") % 2 == 0
    return text.attach_cri(rows, F.when(even, F.lit("t")), F.when(even, F.lit("stdout")))


# Inputs.


@query("SELECT * FROM (VALUES ('a b'), ('c'), ('{\"x\":1}')) t(value)")
def stdin_lines(spark, sf_dir):
    return net.lines_of(spark, b'a b\r\n\n\r\nc\n{"x":1}')


@query("SELECT * FROM (VALUES (1, 'a b'), (2, 'hello' || chr(10) || 'x'), (3, 'last')) t(k, line)")
def tcp_frames(spark, sf_dir):
    """Newlines and counted octets in one stream; what is left has no end yet."""
    got, left = net.frames(b"a b\n7 hello\nxlast\r\nopen")
    if left != b"open":
        raise ValueError(left)
    return spark.createDataFrame([(k, x.decode()) for k, x in enumerate(got, 1)], "k int, line string")


@query("""SELECT event_id * 1000 AS timestamp, CAST(event_id % 8 AS INTEGER) AS priority, event_type || '.service' AS unit, event_type AS body
    FROM events WHERE event_type IN ('click', 'view') AND event_id % 8 <= 3""")
def journal_rows(spark, sf_dir):
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("__REALTIME_TIMESTAMP"), (F.col("event_id") % 8).cast("string").alias("PRIORITY"),
        F.concat("event_type", F.lit(".service")).alias("_SYSTEMD_UNIT"), F.col("event_type").alias("MESSAGE")))
    rows = net.journal(events(spark, sf_dir).select(line.alias("value")), ["click.service", "view.service"], priority=3)
    return rows.select("timestamp", "priority", "unit", "body")


@query("SELECT event_id AS process_pid, event_type AS process_name, CAST(18446744073709551615::HUGEINT AS VARCHAR) AS process_memory_bytes, 0 AS message_set FROM events")
def host_metric_rows(spark, sf_dir):
    line = F.to_json(F.struct(
        F.col("event_id").alias("process_pid"), F.col("event_type").alias("process_name"), F.lit("18446744073709551615").cast("decimal(20,0)").alias("process_memory_bytes")))
    rows = schemas.typed_rows(events(spark, sf_dir).select(line.alias("value")), schemas.HOST_METRICS)
    return rows.select("process_pid", "process_name", F.col("process_memory_bytes").cast("string").alias("process_memory_bytes"), F.col("message").isNotNull().cast("int").alias("message_set"))


@query("SELECT event_id AS pid, event_type AS comm FROM events WHERE event_type LIKE 'c%' OR event_type LIKE '_iew'")
def sensor_rows(spark, sf_dir):
    line = F.to_json(F.struct(F.col("event_id").alias("pid"), F.col("event_type").alias("comm")))
    rows = schemas.typed_rows(events(spark, sf_dir).select(line.alias("value")), schemas.PLATFORM_SENSOR)
    return schemas.matching(rows, "comm", ["c*", "?iew"], ["none*"]).select("pid", "comm")


@query("""SELECT event_id AS pid, event_type AS process, CASE event_id % 3 WHEN 0 THEN 'Default' WHEN 1 THEN 'Info' END AS level FROM events
    WHERE event_id % 3 < 2 AND event_type = 'click'""")
def system_log_rows(spark, sf_dir):
    level = F.get(F.array(*map(F.lit, ("Default", "Info", "Debug"))), (F.col("event_id") % 3).cast("int"))
    line = F.to_json(F.struct(
        level.alias("messageType"), F.concat(F.lit("/usr/bin/"), "event_type").alias("processImagePath"), F.col("event_id").alias("processID")))
    return net.system_log(events(spark, sf_dir).select(line.alias("value")), "info", processes=["click"]).select("pid", "process", "level")


@query("SELECT event_id, props FROM events")
def chunk_round_trip(spark, sf_dir):
    payloads = encode.batches(encode.json_lines(events(spark, sf_dir).select("event_id", "props")).select(F.concat("value", F.lit("\n")).alias("value")), 4000)
    raw = chunk.unpacked(chunk.packed(payloads, "payload"))
    lines = raw.select(F.explode(F.split(F.col("value").cast("string"), "\n")).alias("value")).where("value <> ''")
    row = text.json_rows(lines, _strings("event_id", "props"))
    return row.select(F.col("event_id").cast("bigint").alias("event_id"), "props")


@query("SELECT event_id, event_type, value FROM events")
def segment_round_trip(spark, sf_dir):
    rows, sql = events(spark, sf_dir).select("event_id", "event_type", "value"), "SELECT 1"
    return segment.rows_of(segment.packed(rows, rows_each=100, sql=sql), "event_id bigint, event_type string, value double", sql)


@query("SELECT event_id, event_type, value, props FROM events")
def arrow_streams(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "value", "props")
    return arrow_ipc.rows_of(arrow_ipc.streams(rows, 300), "event_id bigint, event_type string, value double, props string")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS level, props AS message FROM events")
def star_arrow_round_trip(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("level"), F.col("props").alias("body"))
    return star.star_to_flat(star.from_arrow(spark, star.to_arrow(star.flat_to_star(rows))), ["event_id"], []).select("event_id", "level", "message")


def _otlp_json(spark, sf_dir):
    """Requests written out here, not by the library's encoder: one for each 100 events."""
    record = F.format_string(
        '{"timeUnixNano":"%d","observedTimeUnixNano":"5","severityNumber":9,"severityText":"%s","body":{"intValue":"%d"},'
        '"attributes":[{"key":"ok","value":{"boolValue":%s}},{"key":"half","value":{"doubleValue":%s}}],"traceId":"00112233445566778899aabbccddeeff"}',
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.lit(0)), "event_type", "user_id",
        F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), (F.col("event_id") % 8 + F.lit(0.5)).cast("string"))
    part = F.floor(F.col("event_id") / 100)
    grouped = events(spark, sf_dir).groupBy(part.alias("part")).agg(F.concat_ws(",", F.collect_list(record)).alias("records"))
    whole = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"h'), F.col("part").cast("string"),
        F.lit('"}}]},"scopeLogs":[{"scope":{"name":"lib"},"logRecords":['), "records", F.lit("]}]}]}"))
    return grouped.select(whole.alias("value"))


_OTLP = """SELECT CASE WHEN event_id % 2 = 0 AND event_id > 0 THEN event_id ELSE 5 END AS timestamp, event_type AS level, CAST(user_id AS VARCHAR) AS body,
    CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS ok, (event_id % 8) || '.5' AS half, 'h' || (event_id // 100) AS "resource.attributes.host",
    'lib' AS "scope.name" FROM events"""
_OTLP_COLUMNS = ("timestamp", "level", "body", "ok", "half", "`resource.attributes.host`", "`scope.name`")


@query(_OTLP)
def otlp_json_rows(spark, sf_dir):
    return otlp.read_requests(_otlp_json(spark, sf_dir), ["ok", "half"], ["host"]).select(*_OTLP_COLUMNS)


@query(_OTLP)
def otlp_protobuf_rows(spark, sf_dir):
    wire = otlp_wire.from_json(_otlp_json(spark, sf_dir))
    return otlp.read_requests(otlp_wire.to_json(wire), ["ok", "half"], ["host"]).select(*_OTLP_COLUMNS)


@query("""SELECT CAST(i AS BIGINT) AS i, CAST(128 + i * 17 % 8192 AS BIGINT) AS bytes_in, CAST(64 + i * 31 % 4096 AS BIGINT) AS bytes_out,
    CASE WHEN i % 5 = 0 THEN '["web","' || ['myapp', 'gateway', 'auth-svc'][i % 3 + 1] || '","' || ['INFO', 'DEBUG', 'WARN', 'ERROR'][i % 4 + 1] || '"]' END AS tags,
    CASE WHEN i % 5 <> 0 AND i % 7 = 0 THEN '[{"host":"10.0.0.1","latency_ms":' || (1 + i * 19 % 200) || '},{"host":"10.0.0.2","latency_ms":' || (1 + i * 13 % 500) || '}]' END AS upstream
    FROM range(2000) t(i)""")
def generator_complex(spark, sf_dir):
    rows = generator.logs(spark, 2000, complexity="complex")
    return rows.select(F.expr("unix_millis(to_timestamp(timestamp)) - 1705276800000").alias("i"), "bytes_in", "bytes_out", "tags", "upstream")


@query("SELECT 'prod' AS env, CAST(2 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS gone, CAST(i + 7 AS BIGINT) AS seq FROM range(500) t(i)")
def generator_records(spark, sf_dir):
    return generator.records(spark.range(500).withColumnRenamed("id", "i"), {"env": "prod", "n": 2, "gone": None}, ("seq", 7))


# Lookup tables from fixed inputs.


@query("SELECT event_id, 'b c' AS one, 'x=1' AS two, 'z' AS three FROM events")
def enrich_kv_file(spark, sf_dir):
    kv = enrich.kv_file(spark, "# comment\n\nTWO=\"x=1\"\nOne = 'b c'\nthree=z\nno pair\n")
    return run_sql("SELECT logs.event_id, kv.* FROM logs CROSS JOIN kv", events(spark, sf_dir), {"kv": kv})


@query("SELECT event_id, 'eu' AS region, '1' AS zone FROM events")
def enrich_env_vars(spark, sf_dir):
    env = enrich.env_vars(spark, "APP_", {"APP_ZONE": "1", "APP_REGION": "eu", "OTHER": "x"})
    return run_sql("SELECT logs.event_id, env.* FROM logs CROSS JOIN env", events(spark, sf_dir), {"env": env})


@query("SELECT repeat('ab', 32) AS container_id, 'docker' AS container_runtime")
def enrich_container_info(spark, sf_dir):
    return enrich.container_info(spark, f"12:cpu:/\n0::/system.slice/docker-{'ab' * 32}.scope\n")


@query("SELECT 'ns' AS namespace, 'p-1' AS pod_name, '' AS node_name, 'sa' AS service_account, '' AS cluster_name")
def enrich_k8s_cluster_info(spark, sf_dir):
    return enrich.k8s_cluster_info(spark, {"POD_NAMESPACE": "ns", "K8S_POD_NAME": "p-1", "SERVICE_ACCOUNT": "sa"})


@query("SELECT 1 AS rows, 'linux' AS os_type, true AS named, 9 AS columns")
def enrich_host_info(spark, sf_dir):
    host = enrich.host_info(spark)
    named = F.bool_and((F.col("hostname") != "") & (F.col("os_kernel") != "")).alias("named")
    return host.agg(F.count(F.lit(1)).cast("int").alias("rows"), F.max("os_type").alias("os_type"), named, F.lit(len(host.columns)).alias("columns"))


@query("SELECT true AS pid, true AS version, true AS start_time, true AS host")
def enrich_process_and_network_info(spark, sf_dir):
    sql = "SELECT int(p.pid) > 0 AS pid, p.agent_version LIKE '%.%.%' AS version, p.start_time LIKE '20__-__-__T%Z' AS start_time, length(n.hostname) > 0 AS host FROM logs CROSS JOIN p CROSS JOIN n"
    return run_sql(sql, spark.range(1), {"p": enrich.process_info(spark), "n": enrich.network_info(spark)})


@query("SELECT event_id, event_type = 'click' AS bl_match, CASE event_type WHEN 'click' THEN 'noise' END AS bl_category, CASE event_type WHEN 'click' THEN 'hit' ELSE 'miss' END AS web_status FROM events")
def processor_chain(spark, sf_dir):
    entries = processors.read_blocklist(spark, "key,category\nclick,noise\n")
    fetch = lambda key: (200, "{}") if key == "click" else (404, "")
    rows = events(spark, sf_dir).transform(lambda d: processors.blocklist(d, "event_type", entries, "bl"))
    return rows.transform(lambda d: processors.http_enrich(d, "event_type", fetch, "web")).select("event_id", "bl_match", "bl_category", "web_status")


# Payloads.


@query("""SELECT event_type AS type, 'prod' AS env, 1000000000000000000 + event_id AS ns,
    '{"event_type":"' || event_type || '","_timestamp":"' || (1000000000000000000 + event_id) || '"}' AS line FROM events""")
def loki_pushes(spark, sf_dir):
    """Push bodies, read back."""
    stamp = (F.lit(10**18) + F.col("event_id")).cast("string").alias("_timestamp")
    bodies = encode.pushes(encode.streams(events(spark, sf_dir).select("event_type", stamp), {"event_type": "type"}, {"env": "prod"}), 20_000)
    push = F.from_json("value", "streams array<struct<stream: map<string,string>, values: array<array<string>>>>")
    s = bodies.select(F.explode(push["streams"]).alias("s")).select("s.stream", F.explode("s.values").alias("v"))
    return s.select(s["stream"]["type"].alias("type"), s["stream"]["env"].alias("env"), s["v"][0].cast("bigint").alias("ns"), s["v"][1].alias("line"))


@query("SELECT COUNT(*) AS lines, SUM(length('{\"event_id\":' || event_id || '}') + 1) AS bytes, true AS small FROM events")
def http_payloads(spark, sf_dir):
    lines = encode.json_lines(events(spark, sf_dir).select("event_id")).select(F.concat("value", F.lit("\n")).alias("value"))
    sizes = encode.batches(lines, 1000).select("lines", F.octet_length("payload").alias("n"))
    return sizes.agg(F.sum("lines").alias("lines"), F.sum("n").alias("bytes"), (F.max("n") <= 1000).alias("small"))


@query("SELECT * FROM (VALUES (0, 'aa,bb'), (1, 'ccccccccccccccc'), (2, 'dd')) t(k, lines)")
def udp_datagrams(spark, sf_dir):
    packed = deliver.datagrams(["aa", "bb", "c" * 15, "dd"], 8)
    return spark.createDataFrame([(k, d.decode().strip().replace("\n", ",")) for k, d in enumerate(packed)], "k int, lines string")


@query("SELECT * FROM (VALUES ('bad', 'error: no', 3), ('good', 'ok', 1), ('late', 'ok', 2)) t(sink, status, calls)")
def fan_out_status(spark, sf_dir):
    """Sinks that fail are tried again, the others not."""
    calls = dict.fromkeys(("good", "late", "bad"), 0)

    def sink(name, failures):
        def put(df):
            calls[name] += 1
            if calls[name] <= failures:
                raise OSError("no")
            deliver.to_null(df)

        return put

    status = deliver.fan_out(events(spark, sf_dir).limit(10), {"good": sink("good", 0), "late": sink("late", 1), "bad": sink("bad", 9)})
    return spark.createDataFrame([(n, s, calls[n]) for n, s in status.items()], "sink string, status string, calls int")


@query("""SELECT * FROM (VALUES (200, 'ok', 0.0), (204, 'ok', 0.0), (301, 'reject', 0.0), (400, 'reject', 0.0), (408, 'retry', 5.0), (429, 'retry', 7.0),
    (500, 'retry', 0.0), (503, 'retry', 0.0)) t(status, kind, after)""")
def delivery_outcomes(spark, sf_dir):
    told = {429: "7"}
    rows = [(s, (o := deliver.classify(s, told.get(s))).kind, float(o.after)) for s in (200, 204, 301, 400, 408, 429, 500, 503)]
    return spark.createDataFrame(rows, "status int, kind string, after double")


# Event time, approximations, empty results, refusals.


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, COUNT(*) AS n FROM events GROUP BY ALL")
def event_time_windows(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = runner.windowed_counts(rows, "ts", "1 hour", "10 minutes", "event_type")
    return counted.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH w AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' AS apart FROM events),
    s AS (SELECT user_id, ts, SUM(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM w)
    SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def event_time_sessions(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = runner.sessions(rows, "ts", "6 hours", "10 minutes", "user_id")
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, true AS users, true AS mid FROM events GROUP BY event_type")
def approximate_aggregates(spark, sf_dir):
    """Within a tenth of the exact figures."""
    sql = """SELECT event_type, abs(approx_distinct(user_id) - COUNT(DISTINCT user_id)) <= 0.1 * COUNT(DISTINCT user_id) + 1 AS users,
        abs(percentile_approx(value, 0.5) - MEDIAN(value)) <= 0.1 * MEDIAN(value) + 1 AS mid FROM logs GROUP BY event_type"""
    return run_sql(sql, events(spark, sf_dir))


@query("SELECT event_id, event_type, CAST(value AS BIGINT) AS whole FROM events WHERE false")
def empty_result(spark, sf_dir):
    return run_sql("SELECT event_id, event_type, CAST(value AS BIGINT) AS whole FROM logs WHERE event_type = 'none such'", events(spark, sf_dir))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS t, CAST(value AS BIGINT) AS w, event_type = 'CLICK' COLLATE NOCASE AS same FROM events WHERE value = floor(value) OR event_id < 100 AND value < 1e6 AND floor(value) = value")
def convert_and_collate(spark, sf_dir):
    sql = "SELECT event_id, CONVERT(VARCHAR(20), event_id) AS t, CONVERT(BIGINT, value) AS w, event_type COLLATE UTF8_LCASE = 'CLICK' AS same FROM logs WHERE value = floor(value)"
    return run_sql(sql, events(spark, sf_dir))


REFUSED = {
    "two_aliases": "SELECT event_id AS a, event_type AS a FROM logs", "two_statements": "SELECT 1 AS a; SELECT 2 AS b",
    "insert": "INSERT INTO logs SELECT 1", "create": "CREATE TABLE t (a INT)", "drop": "DROP TABLE logs",
    "match_recognize": "SELECT * FROM logs MATCH_RECOGNIZE (PATTERN (a))", "xmltable": "SELECT * FROM XMLTABLE('x')", "openjson": "SELECT * FROM OPENJSON('{}')",
    "unknown_column": "SELECT none_such FROM logs", "unknown_grok": "SELECT grok(props, '%{NONE:x}') AS g FROM logs", "bad_pattern": "SELECT regexp_extract(props, '(', 1) AS x FROM logs",
    "pattern_from_a_column": "SELECT regexp_extract(props, event_type, 1) AS x FROM logs",
}
REFUSED_CONFIGS = {
    "logfmt": "input: {type: file, path: x, format: logfmt}\noutput: {type: 'null'}", "syslog": "input: {type: file, path: x, format: syslog}\noutput: {type: 'null'}",
    "file_rotation": "input: {type: generator}\noutput: {type: file, path: x, rotation: daily}", "no_output": "input: {type: generator}",
    "unknown_input": "input: {type: odd}\noutput: {type: 'null'}", "two_tables": "input: {type: generator}\noutput: {type: 'null'}\nenrichment: [{type: process_info, table_name: logs}]",
    "unset_variable": "input: {type: file, path: '${SILT_NONE_SUCH}'}\noutput: {type: 'null'}",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', true)" for k in [*REFUSED, *REFUSED_CONFIGS]) + ") t(what, refused)")
def refusals(spark, sf_dir):
    def refused(run) -> bool:
        try:
            run()
        except (ValueError, PySparkException):
            return True
        return False

    rows = [(k, refused(lambda s=s: run_sql(s, events(spark, sf_dir)))) for k, s in REFUSED.items()]
    rows += [(k, refused(lambda t=t: config.load(t, {}))) for k, t in REFUSED_CONFIGS.items()]
    return spark.createDataFrame(rows, "what string, refused boolean")


@query("SELECT * FROM (VALUES ('env', 'prod'), ('n', '2')) t(k, v)")
def configured_pipeline(spark, sf_dir):
    """A pipeline of YAML text from its input to a file, read back."""
    path = fresh_path(spark, "out")
    (p,) = config.load(json.dumps({
        "input": {"type": "generator", "profile": "record", "total_events": 1, "attributes": {"env": "${SILT_ENV}", "n": 2}},
        "output": {"type": "file", "path": path}, "transform": "SELECT env, n FROM logs",
    }), {"SILT_ENV": "prod"}).values()
    config.run(spark, p)
    row = text.json_rows(text.read_lines(spark, path), _strings("env", "n"))
    return row.selectExpr("stack(2, 'env', env, 'n', n) AS (k, v)")
