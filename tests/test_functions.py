import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silt.functions import geo, grok, scalar
from silt.plans.dialect import DialectError, similar_to_regex, translate
from silt.plans.runner import PlanError, run_sql, validate_plan
from silt.schema import double_text, is_conflict, normalize_conflicts


@pytest.fixture(scope="module")
def logs(spark):
    rows = [("INFO", "started", "200"), ("ERROR", "disk full", "500"), ("DEBUG", "heartbeat", "not_a_number"), ("ERROR", "oom killed", "503")]
    return spark.createDataFrame(rows, "level string, msg string, status string")


def one(df):
    return [r[0] for r in df.collect()]


def test_int_and_float(logs):
    assert one(run_sql("SELECT int(status) AS s FROM logs", logs)) == [200, 500, None, 503]
    assert one(run_sql("SELECT float(status) AS s FROM logs", logs)) == [200.0, 500.0, None, 503.0]
    assert len(run_sql("SELECT * FROM logs WHERE int(status) IN (200, 503)", logs).collect()) == 2
    assert one(run_sql("SELECT int(1.9) AS s FROM logs LIMIT 1", logs)) == [1]


@pytest.mark.parametrize(
    "pattern, group, want",
    [
        (r"(\w+) (\S+) (\d+) (\d+)ms", 2, ["/api/users", "/api/orders", None, None]),
        (r"(\w+) (\S+) (\d+) (\d+)ms", 0, ["GET /api/users 200 15ms", "POST /api/orders 500 230ms", None, None]),
        (r"(GET)?.*api", 1, ["GET", None, None, None]), (r"(x*)GET", 1, ["", None, None, None]), (r"(x*)?GET|no", 1, ["", None, None, None]),
        (r"api", 3, [None] * 4), (r"(\p{L}+) (\S+)", 1, ["GET", "POST", None, None]), (r"([a-z&&[^n]]+)$", 1, ["ms", "ms", "g", None]),
        (r"(?P<the_verb>[A-Z]+) (?<path>\S+)", 2, ["/api/users", "/api/orders", None, None]), (r"o|(z?)GET|(t)h", 1, ["", None, None, None]),
        (r"(?i)get()|(post)", 1, ["", None, None, None]), (r"(?i)get()|(post)", 2, [None, "POST", None, None]),
    ],
)
def test_regexp_extract(spark, pattern, group, want):
    rows = [("GET /api/users 200 15ms",), ("POST /api/orders 500 230ms",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "msg string")
    assert one(run_sql(f"SELECT regexp_extract(msg, '{pattern}', {group}) AS x FROM logs", df)) == want


def test_regexp_errors(logs):
    with pytest.raises(ValueError):
        run_sql("SELECT regexp_extract(msg, '(', 1) AS x FROM logs", logs)
    with pytest.raises(DialectError):
        run_sql("SELECT regexp_extract(msg, level, 1) AS x FROM logs", logs)
    with pytest.raises(DialectError):
        run_sql("SELECT int(msg, 1) AS x FROM logs", logs)


def test_grok(spark):
    rows = [("GET /api/users 200 15ms",), ("POST /api/orders 500 230ms",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "message string")
    out = run_sql("SELECT grok(message, '%{WORD:method} %{URIPATH:path} %{NUMBER:status} %{NUMBER}ms') AS g FROM logs", df)
    assert [f.name for f in out.schema["g"].dataType] == ["method", "path", "status"]
    assert [tuple(r["g"]) for r in out.collect()][:2] == [("GET", "/api/users", "200"), ("POST", "/api/orders", "500")]
    assert [tuple(r["g"]) for r in out.collect()][2:] == [(None,) * 3] * 2
    with pytest.raises(ValueError):
        grok.grok_sql("x", "%{NOPE:a}")


@pytest.mark.parametrize(
    "name, text",
    [
        ("IP", "10.0.0.1"), ("IPV6", "2001:db8::1"), ("UUID", "123e4567-e89b-12d3-a456-426614174000"), ("MAC", "00:1b:44:11:3a:b7"),
        ("TIMESTAMP_ISO8601", "2024-01-15T10:30:00.123Z"), ("LOGLEVEL", "WARN"), ("EMAILADDRESS", "a.b@example.com"), ("HOSTNAME", "a-1.example.com"),
        ("QUOTEDSTRING", '"a \\" b"'), ("URI", "https://example.com:80/a/b?c=d"), ("DATE", "2024-01-15"), ("TIME", "10:30:59"), ("INT", "-5"), ("NUMBER", "1.5"),
    ],
)
def test_grok_patterns(spark, name, text):
    df = spark.createDataFrame([(f"<{text}>",)], "s string")
    assert df.select(grok.grok("s", f"<%{{{name}:x}}>")["x"]).first()[0] == text


def test_json_functions(spark):
    rows = [
        '{"a": 1, "b": 1.5, "c": "9", "d": true, "e": null, "f": {"x": 1}, "g": [1,2], "h.i": 5, "ü": "é"}',
        '{"a": "200", "b": 7}', '{"a": 9223372036854775807, "b": -2e3}', "not json", None, "{}",
    ]
    df = spark.createDataFrame([(x,) for x in rows], "body string")
    get = lambda f, k: one(run_sql(f"SELECT {f}(body, '{k}') AS x FROM logs", df))
    assert get("json", "a") == ["1", "200", "9223372036854775807", None, None, None]
    assert get("json", "d")[0] == "true" and get("json", "e")[0] is None and get("json", "g")[0] == "[1,2]"
    assert get("json", "h.i")[0] == "5" and get("json", "ü")[0] == "é" and get("json", "f")[0] == '{"x":1}'
    assert get("json_int", "a") == [1, None, 9223372036854775807, None, None, None]
    assert get("json_int", "b") == [None, 7, None, None, None, None] and get("json_int", "d")[0] is None
    assert get("json_float", "b") == [1.5, 7.0, -2000.0, None, None, None] and get("json_float", "c")[0] is None


@pytest.mark.parametrize(
    "text, want",
    [("", 14695981039346656037), ("a", 12638187200555641996), ("foobar", 9625390261332436968), ("test-trace-id-12345", 10607781026064820607)],
)
def test_hash_vectors(spark, text, want):
    df = spark.createDataFrame([(text,), (None,)], "s string")
    assert one(run_sql("SELECT hash(s) AS h FROM logs", df)) == [want, None]


@given(st.lists(st.one_of(st.none(), st.binary(max_size=20)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_fnv_in_batches(texts):
    def plain(b):
        h = scalar.FNV_OFFSET
        for x in b or b"":
            h = (h ^ x) * scalar.FNV_PRIME % (1 << 64)
        return h

    assert [int(x) % (1 << 64) for x in scalar.fnv1a_64(texts)] == [plain(t) for t in texts]


def test_geo(spark):
    ranges = geo.read_ranges(
        "start_ip,end_ip,country_code,city,latitude,asn\n1.0.0.0,1.0.0.255,AU,,-27.5,AS13335\n8.8.8.0,8.8.8.255,US,X,,15169\n"
        "2001:db8::,2001:db8::ff,DE,Y,1.0,\n9.9.9.9,9.9.9.1,ZZ,,,\n".splitlines()
    )
    geo.register(spark, ranges)
    ips = ["1.0.0.0", "1.0.0.255", "8.8.8.8", "2001:db8::1", "10.0.0.1", "x", None, "1.0.1.0"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    out = run_sql("SELECT get_field(geo_lookup(ip), 'country_code') AS c, get_field(geo_lookup(ip), 'asn') AS a FROM logs", df).collect()
    assert [r["c"] for r in out] == ["AU", "AU", "US", "DE", None, None, None, None]
    assert [r["a"] for r in out][:4] == [13335, 13335, 15169, None]
    with pytest.raises(ValueError):
        geo.read_ranges(["start_ip,end_ip", "1.0.0.0,1.0.0.9", "1.0.0.9,1.0.0.20"])


def test_conflicts(spark):
    df = spark.createDataFrame([((200, None),), ((None, "OK"),), (None,)], "status struct<int: bigint, str: string>")
    assert is_conflict(df.schema["status"].dataType)
    assert one(normalize_conflicts(df)) == ["200", "OK", None]
    other = spark.createDataFrame([((1, 2),)], "s struct<a: int, int: int>")
    assert normalize_conflicts(other).schema == other.schema


@pytest.mark.parametrize(
    "x, want",
    [(1e20, "1e20"), (0.1, "0.1"), (1.0, "1.0"), (125.5, "125.5"), (12345678.25, "12345678.25"), (-2.5e10, "-25000000000.0"), (1e-7, "1e-7"), (None, None)],
)
def test_double_text(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(double_text(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-15T10:30:00.123456789Z", 1705314600123456789), ("2024-01-15T10:30:00+02:00", 1705307400000000000), ("1705314600", 1705314600 * 10**9),
        ("1705314600123", 1705314600123 * 10**6), ("1705314600123456", 1705314600123456 * 10**3), ("1705314600123456789", 1705314600123456789), ("x", None), (None, None),
    ],
)
def test_epoch_nanos(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalar.epoch_nanos(F.col("t"))).first()[0] == want


def test_dialect_leaves_text_alone():
    sql = "SELECT 'int(x)' AS a, \"int\" AS b -- int(y)\nFROM logs /* hash(z) */"
    assert translate(sql) == sql
    assert translate("SELECT int(hash(a)) FROM logs").count("try_cast") == 1
    assert similar_to_regex("a%_(b|c)") == "(?s)^(?:a.*.(b|c))$"


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE logs", "SELECT 1; SELECT 2", "INSERT INTO logs VALUES (1)", "SELECT * FROM logs MATCH_RECOGNIZE (x)", "SELECT * FROM OPENJSON(x)",
        "SELECT * FROM a ASOF JOIN b ON a.t >= b.t", "SELECT * FROM a JOIN c ON a.x = c.x RIGHT SEMI JOIN b ON a.x = b.x", "",
    ],
)
def test_rejected_sql(sql):
    with pytest.raises(DialectError):
        translate(sql)


def test_runner_checks(logs):
    with pytest.raises(PlanError):
        run_sql("SELECT level, msg AS LEVEL FROM logs", logs)
    with pytest.raises(PlanError):
        run_sql("SELECT 1 AS x FROM logs", logs, {"logs": logs})
    assert run_sql("SELECT level FROM logs WHERE false", logs).columns == ["level"]
    assert validate_plan(logs.sparkSession, "SELECT int(status) AS s FROM logs", logs.schema)["s"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="nope"):
        validate_plan(logs.sparkSession, "SELECT nope FROM logs", logs.schema)
