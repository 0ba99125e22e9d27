import gzip
import json
import socket
import time
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
import zstandard

from silt import __main__ as cli
from silt.operators import star
from silt.sinks import encode
from silt.sources import chunk, otlp, otlp_wire, receive, schemas, segment, text


def post(port, body, path="/in", **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, headers)) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


def test_http_receiver(spark, tmp_path):
    r = receive.HttpReceiver(str(tmp_path / "spool"), "/in", status=202, most=1000)
    try:
        assert post(r.port, b'{"a":1}') == 202 and post(r.port, b"x", "/other") == 404 and post(r.port, b"x" * 2000) == 413
        assert post(r.port, gzip.compress(b'{"a":2}\n'), **{"Content-Encoding": "gzip"}) == 202
        assert post(r.port, zstandard.compress(b'{"a":3}\n'), **{"Content-Encoding": "zstd"}) == 202
        assert post(r.port, b"x", **{"Content-Encoding": "odd"}) == 415
    finally:
        r.close()
    assert sorted(x["value"] for x in text.read_lines(spark, str(tmp_path / "spool")).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_tcp_receiver(spark, tmp_path):
    r = receive.TcpReceiver(str(tmp_path / "spool"))
    with socket.create_connection(("127.0.0.1", r.port)) as s:
        s.sendall(b"one\n5 two t")
        s.sendall(b"last")
    for _ in range(50):
        if (tmp_path / "spool").exists() and list((tmp_path / "spool").iterdir()):
            break
        time.sleep(0.1)
    r.close()
    assert sorted(x["value"] for x in text.read_lines(spark, str(tmp_path / "spool")).collect()) == ["last", "one", "two t"]


def test_packed_files(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"a\n\nb\r\n"))
    (tmp_path / "b.zst").write_bytes(zstandard.compress(b"c\n"))
    packed = pa.compress(b"d\n" * 200, "snappy", asbytes=True)
    (tmp_path / "c.snappy").write_bytes(packed if packed[0] == 0x90 else b"\x90\x03" + packed)
    assert sorted({r["value"] for r in text.read_packed(spark, str(tmp_path)).collect()}) == ["a", "b", "c", "d"]


def test_otlp_protobuf(spark):
    rows = [("1705314600", "ERROR", "é", -5, 1.5, True, "h", "0" * 31 + "1")]
    df = spark.createDataFrame(rows, "time string, level string, body string, i int, d double, t boolean, `_resource_host` string, trace_id string")
    requests = encode.otlp_requests(df)
    wire = otlp_wire.from_json(requests)
    assert otlp_wire.decode(bytes(wire.first()["content"])) == json.loads(requests.first()["value"]) | {}
    a = otlp.read_requests(otlp_wire.to_json(wire), ["i", "d"], ["host"]).first()
    assert a == otlp.read_requests(requests, ["i", "d"], ["host"]).first() and a["i"] == "-5" and a["trace_id"] == "0" * 31 + "1"
    assert otlp_wire.to_json(spark.createDataFrame([(bytearray(b"\x0a\xff"),)], "content binary")).first()["value"] is None


def test_schemas(spark):
    assert len(schemas.schema(schemas.HOST_METRICS)) == 61 and len(schemas.schema(schemas.PLATFORM_SENSOR)) == 26
    lines = spark.createDataFrame([('{"timestamp_unix_nano": 18446744073709551615, "comm": "bash", "pid": 7}',), ('{"comm": "zsh"}',)], "value string")
    rows = schemas.typed_rows(lines, schemas.PLATFORM_SENSOR)
    assert int(rows.first()["timestamp_unix_nano"]) == (1 << 64) - 1
    assert [r["comm"] for r in schemas.matching(rows, "comm", ["b*", "z??"], ["*sh"]).collect()] == []
    assert [r["comm"] for r in schemas.matching(rows, "comm", ["b*"]).collect()] == ["bash"]


def test_star_as_arrow(spark):
    df = spark.createDataFrame([("INFO", "m", 1)], "level string, body string, n int")
    s = star.from_arrow(spark, star.to_arrow(star.flat_to_star(df)))
    assert star.star_to_flat(s).first()["n"] == "1"


def test_command_line(tmp_path, capsys):
    (tmp_path / "ok.yaml").write_text("input: {type: generator}\noutput: {type: 'null'}\n")
    (tmp_path / "bad.yaml").write_text("input: {type: x}\n")
    assert cli.main(["validate", str(tmp_path / "ok.yaml")]) == 0 and cli.main(["validate", str(tmp_path / "bad.yaml")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["nope"])
    assert "ok: default" in capsys.readouterr().out


def test_chunks():
    parts = [b"", b"a" * 10_000, bytes(range(256))]
    data = b"".join(map(chunk.pack, parts))
    assert list(chunk.unpack(data)) == parts and data[:4] == b"FL\x01\x01"
    for broken in (data[:-1], data[:20] + b"x" + data[21:], b"XX" + data[2:], data + b"FL"):
        with pytest.raises(chunk.ChunkError):
            list(chunk.unpack(broken))


def test_segments(spark, tmp_path):
    batches = [pa.record_batch({"a": [k, k + 1], "b": ["x", None]}) for k in range(3)]
    data = segment.pack(batches, 7, "SELECT 1", 99)
    s = segment.unpack(data)
    assert (s.segment_id, s.created_ms, s.rows, s.sql_hash) == (7, 99, 6, segment.sql_hash("SELECT 1")) and s.batches == batches
    assert len(data) > 64 and data[:4] == data[-8:-4] == b"LCHK"
    files = {7: data, 8: data[:-5], 9: data[:70] + bytes([data[70] ^ 1]) + data[71:], 10: data[:4] + b"\x02" + data[5:], 11: segment.pack([], 11)}
    for k, x in files.items():
        (tmp_path / segment.NAME.format(k)).write_bytes(x)
    (tmp_path / "other.txt").write_bytes(b"x")
    found = segment.read(spark, str(tmp_path))
    kinds = {r["name"]: r["status"] for r in segment.status(found).collect()}
    assert [kinds[segment.NAME.format(k)] for k in files] == ["ok", "incomplete", "corrupt", "unsupported", "ok"] and len(kinds) == 5
    sound = found.where("name < 'seg-0000000010'")
    assert segment.rows_of(sound, "a bigint, b string", "SELECT 1").count() == 6
    for df, sql in ((sound, "SELECT 2"), (found, None)):
        with pytest.raises(Exception, match="another SQL|unsupported"):
            segment.rows_of(df, "a bigint, b string", sql).count()


def test_packed_files_by_their_first_bytes(spark, tmp_path):
    files = {"a": gzip.compress(b"1\n2\n"), "b.gz": b"3\r\n", "c.zst": zstandard.ZstdCompressor().compress(b"4\n\n5"), "d": zstandard.ZstdCompressor().compress(b"6")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    assert sorted(r["value"] for r in text.read_packed(spark, str(tmp_path)).collect()) == list("123456")
