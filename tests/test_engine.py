import gzip
import ipaddress
import json
import random
import socket
import struct
import threading
import time
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt.functions import mmdb
from silt.operators import enrich, joins, processors, star
from silt.plans import config
from silt.plans.runner import run_sql
from silt.sinks import deliver, encode
from silt.sources import arrow_ipc, generator, net, otlp, otlp_wire, text
from silt.streaming import runner


def lines(spark, values, path="f"):
    return spark.createDataFrame([(v, path, i) for i, v in enumerate(values)], "value string, path string, line_no bigint")


# Sources.


def test_cri(spark):
    t = "2024-01-01T00:00:0{}Z "
    rows = [
        t.format(0) + "stdout P out-", t.format(1) + "stderr F err", t.format(2) + "stdout F done", t.format(3) + "stdout P lost", "broken line",
        t.format(4) + 'stdout F {"a": 1}', t.format(5) + "stdout F", t.format(6) + "stdin F no", t.format(7) + "stdout P open",
    ]
    out = text.reassemble(lines(spark, rows)).orderBy("line_no").collect()
    assert [(r["stream"], r["message"], r["time"][18]) for r in out] == [
        ("stderr", "err", "1"), ("stdout", "out-done", "2"), ("stdout", '{"a": 1}', "4"), ("stdout", "", "5")]
    both = {r["line_no"]: r for r in text.auto(lines(spark, rows[:3] + ['{"b": 2}', "plain é"])).collect()}
    assert both[2]["body"] == "out-done" and both[2]["_stream"] == "stdout" and both[3]["value"] == '{"b": 2}' and both[3]["_stream"] is None
    assert both[4]["body"] == "plain é" and both[4]["value"] is None


def test_ndjson(spark):
    rows = ['{"a": 1, "b": "x", "n": {"k": [1]}, "m": 1}', '{"a": 2.5, "b": "y", "m": "t"}', "bad", '{"b": null, "t": true, "b": 1}']
    df = lines(spark, rows)
    schema = text.discover(df.limit(3))
    assert {f.name: f.dataType.simpleString() for f in schema} == {
        "a": "struct<int:bigint,float:double>", "b": "string", "m": "struct<int:bigint,str:string>", "n": "string"}
    out = text.json_rows(df, schema).collect()
    assert out[0]["n"] == '{"k":[1]}' and out[2] == (None,) * 4 and out[0]["m"]["int"] == 1 and out[1]["m"]["str"] == "t"
    assert df.agg(text.parse_errors(df)).first()[0] == 1


def test_read_lines_and_metadata(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"three\n"))
    df = text.read_lines(spark, str(tmp_path))
    assert sorted(r["value"] for r in df.collect()) == ["one", "three", "two"]
    out = text.attach_source(text.raw(df), "ecs")
    assert {"body", "__source_id", "file.path"} <= set(out.columns) and out.select("__source_id").distinct().count() == 2
    with pytest.raises(ValueError):
        text.attach_source(df, "nope")


def test_generator(spark):
    r = generator.logs(spark, 21).collect()
    assert r[0]["message"] == "GET /api/v1/users/10000 500" and r[3]["status"] == 429 and r[1]["request_id"] == "517cc1b727220a95"
    assert r[7]["duration_ms"] == 92 and r[2]["level"] == "WARN" and r[20]["status"] == 500
    assert r[5]["request_id"] == format(5 * 0x517CC1B727220A95 % (1 << 64), "016x")


def test_framing():
    assert net.frames(b"5 hello3 abcrest") == ([b"hello", b"abc"], b"rest")
    assert net.frames(b"a\r\nb\nc") == ([b"a", b"b"], b"c")
    assert net.frames(b"9 short") == ([], b"9 short")


def test_spool_and_journal(spark, tmp_path):
    net.spool(str(tmp_path / "in"), b'{"a":1}\n')
    assert spark.read.text(str(tmp_path / "in")).count() == 1
    entry = json.dumps({"__REALTIME_TIMESTAMP": "1700000000000000", "PRIORITY": "3", "_SYSTEMD_UNIT": "a.service", "MESSAGE": "m"})
    rows = net.journal(net.lines_of(spark, entry + "\n" + entry.replace('"3"', '"6"')), units=["a.service"], priority=4).collect()
    assert len(rows) == 1 and rows[0]["timestamp"] == 1700000000000000000


def test_arrow_ipc(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x bigint, y string")
    for codec in (None, "zstd"):
        assert arrow_ipc.read(spark, arrow_ipc.write(df, codec), codec).collect() == df.collect()


# Lookup tables and processors.


def test_csv_table(spark):
    df = enrich.csv_table(spark, 'a,b,c\n1,"x, y",\n2,z\n')
    assert [tuple(r) for r in df.collect()] == [("1", "x, y", ""), ("2", "z", None)]
    for bad in ("", "a,,c\n", "a,A\n", "a\n1,2\n"):
        with pytest.raises(enrich.EnrichmentError):
            enrich.csv_table(spark, bad)


def test_other_tables(spark):
    df = enrich.jsonl_table(spark, '{"a":1,"b":true}\n\n{"b":null,"c":"x"}')
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [("1", "true", None), (None, None, "x")]
    assert enrich.env_vars(spark, "P_", {"P_B": "2", "P_A": "1", "X": "0"}).first().asDict() == {"a": "1", "b": "2"}
    assert enrich.kv_file(spark, "# c\nB='q'\nA=1\n").first().asDict() == {"a": "1", "b": "q"}
    for bad in (lambda: enrich.env_vars(spark, "NO_", {}), lambda: enrich.kv_file(spark, "a=1\nA=2"), lambda: enrich.jsonl_table(spark, ""), lambda: enrich.static(spark, {})):
        with pytest.raises(enrich.EnrichmentError):
            bad()
    for style, column in (("raw", "hostname"), ("beats", "host.hostname"), ("otel", "host.name")):
        assert column in enrich.host_info(spark, style).columns
    assert enrich.process_info(spark).columns == ["agent_name", "agent_version", "pid", "start_time"]
    assert len(enrich.network_info(spark).columns) == 5 and enrich.k8s_cluster_info(spark, {"POD_NAME": "p"}).first()["pod_name"] == "p"
    found = enrich.container_info(spark, "0::/system.slice/docker-" + "a" * 64 + ".scope").first()
    assert tuple(found) == ("a" * 64, "docker")


def test_pod_paths(spark):
    uid = "12345678-1234-1234-1234-123456789abc"
    paths = [f"/var/log/pods/my-ns_pod_x-1_{uid}/app/0.log", f"/var/log/pods/my-ns_pod_x-1_{uid}/app/1.log", "/var/log/other.log", "/var/log/pods/bad/app/0.log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [tuple(r) for r in enrich.k8s_path(df).collect()] == [(f"/var/log/pods/my-ns_pod_x-1_{uid}/app/", "my-ns", "pod_x-1", uid, "app")]


def test_reloading_keeps_the_table_before(spark):
    calls = []

    def build():
        calls.append(1)
        if len(calls) > 1:
            raise OSError
        return enrich.static(spark, {"a": "1"})

    table = enrich.Reloading(build, 0)
    assert table.snapshot() is table.snapshot() and len(calls) == 2


def test_blocklist(spark):
    df = spark.createDataFrame([("a",), ("b",), ("A",), (None,)], "k string")
    entries = processors.read_blocklist(spark, "key,category\na,bad\nb\n ,x\n")
    assert [tuple(r) for r in processors.blocklist(df, "k", entries).collect()] == [("a", True, "bad"), ("b", True, None), ("A", False, None), (None, False, None)]
    for bad in (lambda: processors.blocklist(df, "nope", entries), lambda: processors.blocklist(df.withColumn("blocklist_match", F.lit(1)), "k", entries),
                lambda: processors.blocklist(df.select(F.lit(1).alias("k")), "k", entries)):
        with pytest.raises(processors.ProcessorError):
            bad()


def test_http_enrich(spark):
    replies = {"a": (200, '{"x":1}'), "b": (404, ""), "c": (500, ""), "d": (200, "no json"), "e": (204, "")}
    df = spark.createDataFrame([(k,) for k in [*replies, None, "a"]], "k string")
    out = {r["k"]: (r["http_json"], r["http_status"].split(":")[0]) for r in processors.http_enrich(df, "k", lambda k: replies[k]).collect()}
    assert out == {"a": ('{"x":1}', "hit"), "b": (None, "miss"), "c": (None, "error"), "d": (None, "error"), "e": (None, "miss"), None: (None, "miss")}
    assert processors.http_enrich(df, "gone", None).first()["http_status"] == "miss"


# Joins and reshaping.


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, t int, v string")
    out = {r["id"]: r["right_v"] for r in joins.asof_join(left, right, "t", ["k"]).collect()}
    assert out == {1: "y", 2: None, 3: None, 4: None}
    assert joins.asof_join(left, right, "t", ["k"], how="inner").count() == 1
    ranges = spark.createDataFrame([(0, 2, "low"), (5, 25, "mid")], "low int, high int, name string")
    got = joins.range_join(spark.range(0, 30, 4), F.col("id"), ranges, "low", "high", 10).select("id", "name").collect()
    assert {r["id"]: r["name"] for r in got} == {0: "low", 4: None, 8: "mid", 12: "mid", 16: "mid", 20: "mid", 24: "mid", 28: None}


def test_star_round_trip(spark):
    rows = [
        ("2024-01-15T10:30:00.123456789Z", "warn", "m1", "0" * 31 + "1", 1.5, True, 7, "svc"), (None, None, None, None, None, None, None, None),
        ("1705314600", "INFO", "m2", "bad", None, False, 8, "svc"),
    ]
    df = spark.createDataFrame(rows, "timestamp string, level string, body string, trace_id string, d double, b boolean, i int, `resource.attributes.s` string")
    s = star.flat_to_star(df)
    assert s.log_attrs.count() == 5 and s.resource_attrs.count() == 1 and s.scope_attrs.count() == 1
    assert {r["severity_number"] for r in s.logs.collect()} == {13, 0, 9}
    out = {r["message"]: r for r in star.star_to_flat(s).collect()}
    assert out["m1"]["_timestamp"] == "2024-01-15T10:30:00.123456789Z" and out["m1"]["d"] == "1.5" and out["m1"]["trace_id"] == "0" * 31 + "1"
    assert out["m2"]["resource.attributes.s"] == "svc" and out["m2"]["b"] == "false" and out[None]["level"] is None


# Sinks.


def test_row_json(spark):
    df = spark.createDataFrame([(1, float("nan"), 'q"\\\n\x01', True, None, bytearray(b"\x01\xff"), (None, "OK"), "7")],
                               "a bigint, b double, c string, d boolean, e string, f binary, g struct<int: bigint, str: string>, __source_id string")
    line = encode.json_lines(df).first()["value"]
    assert json.loads(line) == {"a": 1, "b": None, "c": 'q"\\\n\x01', "d": True, "e": None, "f": "0x01ff", "g": "OK"}
    assert encode.json_lines(spark.createDataFrame([(87.0, 1e300)], "x double, y double")).first()["value"] == '{"x":87.0,"y":1e300}'


@pytest.mark.parametrize(
    "schema, rows, want",
    [
        ("level string, status bigint, duration_ms double", [("ERROR", 500, 125.5)], '{"level":"ERROR","status":500,"duration_ms":125.5,"@timestamp":"1970-01-01T00:00:00.000000000Z"}'),
        ("msg string, code bigint", [(None, 2)], '{"code":2,"@timestamp":"1970-01-01T00:00:00.000000000Z"}'),
        ("a string", [(None,)], '{"@timestamp":"1970-01-01T00:00:00.000000000Z"}'), ("ts string", [("x",)], '{"ts":"x"}'),
        ("msg string", [("a\u0000b\t",)], '{"msg":"a\\u0000b\\t","@timestamp":"1970-01-01T00:00:00.000000000Z"}'),
    ],
)
def test_bulk(spark, schema, rows, want):
    got = encode.bulk_lines(spark.createDataFrame(rows, schema), "test-index").first()["value"]
    assert got == '{"index":{"_index":"test-index"}}\n' + want + "\n"


def test_text_and_console(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:00Z", "INFO", "hello", 5, None), (None, "CRITICAL", None, None, "x")], "timestamp string, level string, message string, n int, s string")
    assert [r[0] for r in encode.console_lines(df).collect()] == ["10:30:00Z  INFO   hello  n=5", "CRITICAL    s=x"]
    assert [r[0] for r in encode.text_lines(df).collect()] == ["hello"]
    assert encode.text_lines(df.select("n")).first()[0] == '{"n":5}'


def test_streams_grow(spark):
    df = spark.createDataFrame([("a", "5"), ("a", "5"), ("a", "6"), ("b", "5"), ("", "-3")], "app string, time string")
    rows = encode.streams(df.coalesce(1), {"app": "my-app"}, {"0e": "p"}, observed_ns=7).collect()
    got = sorted((r["labels"].get("my_app"), r["ns"]) for r in rows if r["labels"].get("my_app"))
    s = 10**9
    assert got == [("a", 5 * s), ("a", 5 * s + 1), ("a", 6 * s), ("b", 5 * s)]
    assert [(r["labels"], r["ns"]) for r in rows if "my_app" not in r["labels"]] == [({"_0e": "p"}, 7)]


def test_otlp(spark):
    df = spark.createDataFrame([("1705314600", "ERROR", 'b"', 5, 1.5, True, "h"), (None, "x", None, None, None, None, "h")], "time string, level string, body string, i int, d double, t boolean, `_resource_host` string")
    requests = encode.otlp_requests(df)
    body = json.loads(requests.first()["value"])
    record = body["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert record["severityNumber"] == 17 and {"key": "i", "value": {"intValue": "5"}} in record["attributes"]
    assert {"key": "t", "value": {"boolValue": True}} in record["attributes"]
    out = sorted(otlp.read_requests(requests, ["d"], ["host"]).collect(), key=lambda r: r["level"])
    assert out[0]["timestamp"] == 1705314600 * 10**9 and out[0]["d"] == "1.5" and out[1]["resource.attributes.host"] == "h" and out[1]["timestamp"] == 0


def test_delivery(spark, tmp_path):
    got, codes = [], [503, 200, 200, 200, 200]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            code = codes.pop(0) if codes else 200
            if code == 200:
                got.append(gzip.decompress(body) if self.headers.get("Content-Encoding") == "gzip" else body)
            self.send_response(code)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.range(100).select(F.concat(F.lit("line "), F.col("id").cast("string"), F.lit("\n")).alias("value")).coalesce(1)
    deliver.post(df, deliver.http_send(f"http://127.0.0.1:{server.server_port}/"), "gzip", limit=300)
    server.shutdown()
    assert b"".join(got).decode().split("\n")[:-1] == [f"line {i}" for i in range(100)] and all(len(x) <= 300 for x in got)
    assert [deliver.classify(c, "9").kind for c in (200, 302, 400, 408, 429, 500)] == ["ok", "reject", "reject", "retry", "retry", "retry"]
    assert deliver.classify(429, "9").after == 9 and deliver.classify(429).after == 5
    deliver.to_file(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert deliver.datagrams(["a" * 10, "b" * 10, "c" * 50], 25) == [b"a" * 10 + b"\n" + b"b" * 10 + b"\n", b"c" * 50 + b"\n"]
    seen = []
    tries = []

    def flaky(df):
        tries.append(1)
        if len(tries) < 2:
            raise OSError("down")
        seen.append(df.count())

    def dead(df):
        raise OSError("gone")

    assert deliver.fan_out(spark.range(4), {"a": flaky, "b": deliver.to_null, "c": dead}) == {"a": "ok", "b": "ok", "c": "error: gone"}
    out = []
    assert deliver.to_stdout(spark.range(2), "json", out.append) == 2 and out == ['{"id":0}', '{"id":1}']


def test_tcp(spark):
    server = socket.create_server(("127.0.0.1", 0))
    data = []

    def serve():
        conn, _ = server.accept()
        while x := conn.recv(65536):
            data.append(x)

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    deliver.to_tcp(spark.range(5).coalesce(1), "127.0.0.1", server.getsockname()[1])
    t.join(5)
    assert net.frames(b"".join(data))[0] == [b'{"id":%d}' % i for i in range(5)]


# Streams and pipelines.


def test_stream_resumes(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    net.spool(str(folder), b'{"level":"ERROR"}\n{"level":"INFO"}\n')
    schema = text.discover(lines(spark, ['{"level":"x"}']))
    source = lambda: text.stream_lines(spark, str(folder))
    go = lambda: runner.run_stream(
        source(), "SELECT level, COUNT(*) AS n FROM logs GROUP BY level", lambda df, i: seen.append(sorted(map(tuple, df.collect()))),
        str(tmp_path / "cp"), once=True, prepare=lambda df: text.json_rows(df, schema)).awaitTermination()
    go()
    go()
    assert seen == [[("ERROR", 1), ("INFO", 1)]]
    net.spool(str(folder), b'{"level":"ERROR"}\n')
    go()
    assert seen[1:] == [[("ERROR", 1)]]


def test_stream_reassembly_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = []
    for i, part in enumerate(["2024-01-01T00:00:00Z stdout P a-\n", "2024-01-01T00:00:01Z stdout F b\n2024-01-01T00:00:02Z stderr F e\n"]):
        (folder / "x.log").write_text(part) if not i else None
        source = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select("value", F.lit("f").alias("path"))
        if i:
            (folder / "y.log").write_text(part)
        q = runner.reassemble_stream(source).writeStream.foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect())))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r[2], r[3]) for r in rows) == [("stderr", "e"), ("stdout", "a-b")]


YAML = """
pipelines:
  main:
    inputs: [{type: file, path: "${IN}", format: auto}]
    transform: "SELECT int(status) AS status, body, env.name AS env FROM logs CROSS JOIN env WHERE int(status) >= 400 OR body IS NOT NULL"
    enrichment: [{type: static, table_name: env, labels: {name: prod}}]
    outputs: [{type: file, path: "${OUT}"}, {type: "null"}]
"""


def test_yaml_pipeline(spark, tmp_path):
    (tmp_path / "in.log").write_text('{"status": 200}\n{"status": "500"}\nplain text\n2024-01-01T00:00:00Z stdout F {"status": 404}\n')
    p = config.load(YAML, {"IN": str(tmp_path / "in.log"), "OUT": str(tmp_path / "out")})["main"]
    out = config.run(spark, p)
    assert sorted(((r["status"] or 0), r["body"], r["env"]) for r in out.collect()) == [(0, "plain text", "prod"), (404, None, "prod"), (500, None, "prod")]
    assert spark.read.json(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize(
    "bad",
    ["{}", "input: {type: nope}\noutput: {type: 'null'}", "input: {type: file, path: x, format: syslog}\noutput: {type: 'null'}",
     "input: {type: generator}\noutput: {type: file, path: x, rotation: y}", "input: {type: generator}\noutput: {type: 'null'}\ntransform: DROP TABLE x",
     "input: {type: file, path: '${NOT_SET}'}\noutput: {type: 'null'}"],
)
def test_bad_configurations(bad):
    with pytest.raises(config.ConfigError):
        config.load(bad, {})


def test_queries_side_by_side_see_their_own_rows(spark):
    def one(k):
        logs = spark.createDataFrame([(k, i) for i in range(20)], "k int, i int")
        names = spark.createDataFrame([(k, f"n{k}")], "k int, name string")
        sql = "WITH some AS (SELECT * FROM logs WHERE i < 7) SELECT s.k, n.name, COUNT(*) AS n FROM some s JOIN names n ON s.k = n.k GROUP BY ALL"
        return k, [tuple(r) for r in run_sql(sql, logs, {"names": names}).collect()]

    with ThreadPoolExecutor(6) as pool:
        for k, rows in pool.map(one, range(24)):
            assert rows == [(k, f"n{k}", 7)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("silt_")]


def test_tables_may_be_hidden_by_a_query_of_its_own(spark):
    logs, names = spark.range(5).withColumnRenamed("id", "i"), spark.range(3).withColumnRenamed("id", "n")
    assert run_sql("WITH names AS (SELECT n + 10 AS n FROM names) SELECT n FROM names ORDER BY n", logs, {"names": names}).collect()[0]["n"] == 10
    assert run_sql("SELECT logs.i FROM logs ORDER BY i DESC LIMIT 2", logs).collect()[0]["i"] == 4
    assert run_sql("(SELECT i FROM logs) UNION ALL SELECT n FROM names", logs, {"names": names}).count() == 8


def test_asof_joins_in_sql(spark):
    logs = spark.createDataFrame([(1, 5), (1, 9), (2, 1), (3, 4), (1, 5), (1, None)], "k int, ts int")
    seen = spark.createDataFrame([(1, 4, "a"), (1, 6, "b"), (2, 3, "c"), (1, 9, "d")], "key int, at int, v string")
    for on in ("MATCH_CONDITION (logs.ts >= s.at) ON logs.k = s.key", "MATCH_CONDITION (s.at <= logs.ts) ON s.key = logs.k"):
        out = run_sql(f"SELECT *, upper(s.v) AS u FROM logs ASOF JOIN seen AS s {on} WHERE logs.k < 9", logs, {"seen": seen})
        assert out.columns == ["k", "ts", "key", "at", "v", "u"]
        want = {(1, 5, "a"), (1, 9, "d"), (2, 1, None), (3, 4, None), (1, None, None)}
        assert out.count() == 6 and {(r["k"], r["ts"], r["v"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    for bad in ("ASOF JOIN seen s ON logs.k = s.key", "ASOF JOIN (SELECT 1) s MATCH_CONDITION (logs.ts >= s.at) ON logs.k = s.key", "ASOF JOIN seen s MATCH_CONDITION (ts >= at) ON logs.k = s.key"):
        with pytest.raises(ValueError):
            run_sql(f"SELECT logs.k FROM logs {bad}", logs, {"seen": seen})


def test_long_messages_are_cut_at_a_character(spark, monkeypatch):
    monkeypatch.setattr(text, "MESSAGE_BYTES", 10)
    rows = [("t stdout P ", "ää"), ("t stdout F ", "ääää"), ("t stderr F ", "12345678€"), ("t stderr F ", "1234567890")]
    lines = spark.createDataFrame([(a + b, "f", k) for k, (a, b) in enumerate(rows)], "value string, path string, line_no long")
    out = [(r["message"], r["truncated"]) for r in text.reassemble(lines).orderBy("line_no").collect()]
    assert out == [("äääää", True), ("12345678", True), ("1234567890", False)]


def test_chunks_across_stretches_of_a_file(spark, monkeypatch):
    rng = random.Random(2)
    rows = ["broken" if rng.random() < 0.05 else f"t {rng.choice(['stdout', 'stderr'])} {rng.choice('FPP')} {k}," for k in range(400)]
    open_, want = {"stdout": "", "stderr": ""}, []
    for k, row in enumerate(rows):
        if row == "broken":
            open_ = dict.fromkeys(open_, "")
            continue
        _, stream, flag, message = row.split(" ")
        open_[stream] += message
        if flag == "F":
            want.append((k, stream, open_[stream]))
            open_[stream] = ""
    for stretch in (1 << 20, 64, 7, 1):
        monkeypatch.setattr(text, "STRETCH", stretch)
        out = text.reassemble(lines(spark, rows)).orderBy("line_no").collect()
        assert [(r["line_no"], r["stream"], r["message"]) for r in out] == want


def test_star_of_shuffled_rows(spark):
    df = spark.range(3000).selectExpr("id AS event_id", "'m' || id AS message", "id % 7 AS `resource.attributes.pod`")
    df = df.repartition(11).groupBy("event_id", "message", "`resource.attributes.pod`").agg(F.count(F.lit(1)).alias("n"))
    made = star.flat_to_star(df)
    own = made.log_attrs.where("key = 'event_id'").select("parent_id", "int")
    met = made.logs.join(own, made.logs["id"] == own["parent_id"]).join(made.resource_attrs.selectExpr("parent_id AS resource_id", "int AS pod"), "resource_id")
    assert met.count() == 3000 and met.where("body_str <> 'm' || int OR pod <> int % 7").count() == 0


# Configurations of pushed inputs and of every output.


def _post(port, path, body, **headers):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, headers)
    with urllib.request.urlopen(request, timeout=10) as r:
        return r.status


class _Sink:
    """A server that keeps what is posted to it."""

    def __init__(self):
        self.got = []
        got = self.got

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                got.append((self.path, self.headers.get("Content-Type"), self.rfile.read(int(self.headers["Content-Length"]))))
                self.send_response(200)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def _arrow():
    table = pa.table({"level": ["INFO", "ERROR"], "n": [1, 2]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _otlp(kind):
    request = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"scope": {}, "logRecords": [
        {"timeUnixNano": str(k), "severityText": t, "body": {"stringValue": "b"}} for k, t in ((1, "INFO"), (2, "ERROR"))]}]}]}
    return json.dumps(request).encode() if kind == "json" else otlp_wire.encode(request)


@pytest.mark.parametrize(
    "kind, extra",
    [("http", "format: json"), ("tcp", "format: json"), ("udp", "format: json"), ("otlp", ""), ("arrow_ipc", 'schema: "level string, n bigint"')],
)
def test_served_inputs(spark, tmp_path, kind, extra):
    out = tmp_path / "out"
    (p,) = config.load(f"""
input: {{type: {kind}, listen: "127.0.0.1:0", {extra}}}
output: {{type: file, path: "{out}"}}
transform: "SELECT level FROM logs WHERE level = 'ERROR'"
""").values()
    served = config.serve(spark, p, str(tmp_path / "spool"), "0 seconds")
    try:
        port, lines = served.receivers[0].port, b'{"level":"INFO"}\n{"level":"ERROR"}\n'
        if kind == "http":
            assert _post(port, "/", lines) == 200
        elif kind == "tcp":
            with socket.create_connection(("127.0.0.1", port)) as s:
                s.sendall(lines)
        elif kind == "udp":
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                for line in lines.splitlines():
                    s.sendto(line, ("127.0.0.1", port))
        elif kind == "otlp":
            for form in ("json", "protobuf"):
                assert _post(port, "/v1/logs", _otlp(form)) == 200
        else:
            assert _post(port, "/v1/arrow", _arrow()) == 200
        for _ in range(100):
            time.sleep(0.2)
            rows = [x for f in out.glob("part-*") for x in f.read_text().splitlines()] if out.exists() else []
            if len(rows) >= (2 if kind == "otlp" else 1):
                break
        assert rows == ['{"level":"ERROR"}'] * (2 if kind == "otlp" else 1)
    finally:
        served.close()


def test_posted_outputs(spark):
    sink = _Sink()
    rows = spark.range(3).selectExpr("'INFO' AS level", "'m' || id AS message", "CAST(1000 + id AS STRING) AS _timestamp", "CAST(id % 2 AS STRING) AS app")
    for out in (
        {"type": "loki", "endpoint": sink.url, "label_columns": ["app"], "static_labels": {"env": "prod"}},
        {"type": "otlp", "endpoint": sink.url + "/v1/logs"}, {"type": "otlp", "endpoint": sink.url + "/v1/logs", "encoding": "json"},
        {"type": "arrow_ipc", "endpoint": sink.url + "/v1/arrow"}, {"type": "http", "endpoint": sink.url}, {"type": "elasticsearch", "endpoint": sink.url},
    ):
        config.write_output(rows.coalesce(1), out)
    sink.server.shutdown()
    by = {}
    for path, mime, body in sink.got:
        by.setdefault((path, mime), []).append(body)
    pushed = {json.dumps(s["stream"], sort_keys=True): s["values"] for b in by["/loki/api/v1/push", "application/json"] for s in json.loads(b)["streams"]}
    assert [[int(t) for t, _ in pushed[f'{{"app": "{k}", "env": "prod"}}']] for k in "01"] == [[1000 * 10**9, 1002 * 10**9], [1001 * 10**9]]
    forms = [json.loads(by["/v1/logs", "application/json"][0]), otlp_wire.decode(by["/v1/logs", "application/x-protobuf"][0])]
    for request in forms:
        records = request["resourceLogs"][0]["scopeLogs"][0]["logRecords"]
        assert [r["body"]["stringValue"] for r in records] == ["m0", "m1", "m2"]
    with pa.ipc.open_stream(by["/v1/arrow", "application/vnd.apache.arrow.stream"][0]) as r:
        assert r.read_all().column("message").to_pylist() == ["m0", "m1", "m2"]
    assert len(by["/", "application/x-ndjson"][0].splitlines()) == 3 and len(by["/_bulk", "application/x-ndjson"][0].splitlines()) == 6


def test_times_of_a_stream_grow_across_batches(spark, tmp_path):
    sink = _Sink()
    for batch in ([(5, "a"), (7, "a"), (1, "b")], [(6, "a"), (9, "a"), (3, "b"), (2, "c")], [(8, "a")]):
        rows = spark.createDataFrame([(str(t * 10**18), app) for t, app in batch], "_timestamp string, app string")
        deliver.to_loki(rows, deliver.http_send(sink.url), {"app": "app"}, state=str(tmp_path / "state"))
    sink.server.shutdown()
    times = {}
    for _, _, body in sink.got:
        for s in json.loads(body)["streams"]:
            times.setdefault(s["stream"]["app"], []).extend(int(t) for t, _ in s["values"])
    e = 10**18
    assert times == {"a": [5 * e, 7 * e, 7 * e + 1, 9 * e, 9 * e + 1], "b": [e, 3 * e], "c": [2 * e]}
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 1


def test_pushes_are_cut_by_size(spark):
    rows = spark.range(500).selectExpr("CAST(id AS STRING) AS _timestamp", "CAST(id % 3 AS STRING) AS app", "repeat('x', 90) AS message")
    bodies = [json.loads(r["value"]) for r in encode.pushes(encode.streams(rows, {"app": "app"}), 5000).collect()]
    assert len(bodies) > 10 and all(len(json.dumps(b)) < 7000 for b in bodies)
    values = {}
    for b in bodies:
        for s in b["streams"]:
            values.setdefault(s["stream"]["app"], []).extend(int(t) for t, _ in s["values"])
    assert sum(map(len, values.values())) == 500 and all(v == sorted(v) for v in values.values())


@pytest.mark.parametrize(
    "text_",
    [
        "input: {type: file}\noutput: {type: 'null'}", "input: {type: http}\noutput: {type: loki}", "input: {type: arrow_ipc}\noutput: {type: 'null'}",
        "inputs: [{type: http}, {type: generator}]\noutput: {type: 'null'}", "input: {type: generator}\noutput: {type: tcp, host: h}",
        "input: {type: generator}\noutput: {type: 'null'}\nenrichment: [{type: odd}]",
    ],
)
def test_configurations_that_cannot_run(text_):
    with pytest.raises(config.ConfigError):
        config.load(text_)


def test_validate_plans_the_sql(spark, tmp_path):
    good = "input: {type: %s}\noutput: {type: 'null'}\ntransform: %s"
    for kind, sql in (
        ("generator", "SELECT level, int(status) AS s FROM logs WHERE duration_ms > 5"), ("http", "SELECT l.level, COUNT(*) AS n FROM logs l GROUP BY l.level"),
        ("http", 'SELECT level, "odd name" AS x, upper(message) FROM logs WHERE status LIKE 5'), ("otlp", "SELECT body FROM logs"),
        ("'journald', path: '/tmp'", "SELECT unit FROM logs"), ("'linux_ebpf_sensor', path: '/tmp'", "SELECT comm FROM logs"),
    ):
        (p,) = config.load(good % (kind, json.dumps(sql))).values()
        p.inputs[0]["path"] = str(tmp_path)
        assert config.validate(spark, p)
    for sql in ("SELECT none_such FROM logs", "SELECT level AS a, status AS a FROM logs", "SELECT level FROM logs JOIN teams ON a = b"):
        (p,) = config.load(good % ("generator", json.dumps(sql))).values()
        with pytest.raises(config.ConfigError):
            config.validate(spark, p)


def test_generator_profiles(spark):
    (p,) = config.load("input: {type: generator, profile: record, total_events: 3, attributes: {env: prod, n: 2, ok: true, x: 1.5, none: null}, sequence: {field: seq, start: 7}}\noutput: {type: 'null'}").values()
    rows = config.read_input(spark, p.inputs[0]).collect()
    assert [r.asDict() for r in rows] == [{"env": "prod", "n": 2, "ok": True, "x": 1.5, "none": None, "seq": 7 + k} for k in range(3)]
    wide = generator.logs(spark, 36, complexity="complex", message="fixed").collect()
    assert json.loads(wide[5]["headers"])["x-request-id"] == wide[5]["request_id"] and json.loads(wide[5]["tags"]) == ["web", wide[5]["service"], wide[5]["level"]]
    assert [u["latency_ms"] for u in json.loads(wide[7]["upstream"])] == [1 + 7 * 19 % 200, wide[7]["duration_ms"]]
    assert wide[35]["upstream"] is None and wide[35]["headers"] and wide[1]["headers"] is None and {r["message"] for r in wide} == {"fixed"}


def _mmdb(networks, bits):
    """A small database: networks {cidr: record}, IPv4 below 96 zeros."""

    def value(x):
        if isinstance(x, bool):
            return bytes([0x00 | x, 7])
        if isinstance(x, float):
            return b"\x68" + struct.pack(">d", x)
        if isinstance(x, int):
            raw = x.to_bytes(4, "big").lstrip(b"\0")
            return bytes([0xC0 | len(raw)]) + raw
        if isinstance(x, str):
            raw = x.encode()
            return (bytes([0x40 | len(raw)]) if len(raw) < 29 else bytes([0x5D, len(raw) - 29])) + raw
        if isinstance(x, list):
            return bytes([len(x), 4]) + b"".join(map(value, x))
        return bytes([0xE0 | len(x)]) + b"".join(value(k) + value(v) for k, v in x.items())

    nodes, data = [[None, None]], b""
    for cidr, record in networks.items():
        net, node = ipaddress.ip_network(cidr), 0
        shift = 96 if net.version == 4 else 0
        path = [0] * shift + [int(net.network_address) >> (net.max_prefixlen - 1 - k) & 1 for k in range(net.prefixlen)]
        for bit in path[:-1]:
            if nodes[node][bit] is None:
                nodes.append([None, None])
                nodes[node][bit] = len(nodes) - 1
            node = nodes[node][bit]
        nodes[node][path[-1]] = ("data", len(data))
        data += value(record)
    n, tree = len(nodes), b""
    for pair in nodes:
        a, b = (n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    return tree + b"\0" * 16 + data + b"\xab\xcd\xefMaxMind.com" + value({"node_count": n, "record_size": bits, "ip_version": 6})


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_binary_geo_database(spark, tmp_path, bits):
    au = {"country": {"iso_code": "AU", "names": {"en": "Australia", "de": "Australien"}}, "city": {"names": {"en": "Sydney"}},
          "subdivisions": [{"names": {"en": "A state with quite a long name indeed"}}], "location": {"latitude": -33.5, "longitude": 151.25, "radius": 1000}}
    (tmp_path / "g.mmdb").write_bytes(_mmdb({"10.1.0.0/16": au, "10.2.3.0/24": {"country": {"iso_code": "NZ"}, "odd": True}, "2001:db8::/32": au}, bits))
    text_ = f"input: {{type: generator}}\noutput: {{type: 'null'}}\nenrichment: [{{type: geo_database, path: '{tmp_path}/g.mmdb', format: mmdb}}]"
    (p,) = config.load(text_).values()
    config.read_tables(spark, p)
    ips = ["10.1.200.3", "10.2.3.4", "10.2.4.4", "2001:db8::1", "::ffff:10.1.0.1", "no", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ips)], "k int, ip string")
    out = run_sql("SELECT k, g.country_code, g.city, g.region, g.latitude, g.asn FROM (SELECT k, geo_lookup(ip) AS g FROM logs) t ORDER BY k", df)
    full = ("AU", "Sydney", "A state with quite a long name indeed", -33.5, None)
    assert [tuple(r)[1:] for r in out.collect()] == [full, ("NZ", None, None, None, None), (None,) * 5, full, full, (None,) * 5, (None,) * 5]
    with pytest.raises(ValueError):
        mmdb.Mmdb(b"nothing")
