"""Lines to rows: raw text, NDJSON, container-runtime (CRI) lines, and a mix of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from silt.schema import CRI_STREAM, CRI_TIMESTAMP, SOURCE_ID, SOURCE_PATHS

#: Longest message, in bytes, that chunks are joined to.
MESSAGE_BYTES = 2 << 20
#: Places of a file, line numbers as read_lines gives them, that are counted by one task.
STRETCH = 1 << 20
CRI = r"^(\S+) (stdout|stderr) ([FP])(?: (.*))?$"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, path and line_no of each non-empty line; codecs go by the file's extension.

    line_no grows along a file, with gaps, also where the file is read in several splits: it is the split's offset plus
    the line's number in the task, which is below the bytes of a split.
    """
    text = spark.read.text(paths)
    start = F.col("_metadata.file_block_start")
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = text.select(
        F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"), (start + in_task).alias("line_no")
    )
    return lines.where("value <> ''")


#: First bytes of compressed files; snappy here is the framing format, a bare block has none.
_SIGNS = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"))
_ENDINGS = {".gz": "gzip", ".zst": "zstd", ".zstd": "zstd", ".sz": "snappy", ".snappy": "snappy"}


def codec_of(path: str, content: bytes) -> str | None:
    """The codec of a file: by its extension, else by its first bytes, whatever it is called."""
    named = next((c for e, c in _ENDINGS.items() if path.endswith(e)), None)
    signed = next((c for sign, c in _SIGNS if content.startswith(sign)), None)
    return signed if named in (None, "gzip", "zstd") else named


def read_packed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, path and line_no of gzip, zstd and snappy files, and of plain ones among them; each is unpacked by one task."""
    from collections.abc import Iterator

    import pandas as pd

    from silt.sources.receive import decompressed

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                data = bytes(content)
                rows = decompressed(data, codec_of(path, data[:8])).decode("utf-8", "replace").split("\n")
                rows = [(r.removesuffix("\r"), path, n) for n, r in enumerate(rows) if r.strip("\r")]
                yield pd.DataFrame(rows, columns=["value", "path", "line_no"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(unpack, "value string, path string, line_no bigint")


def valid_utf8(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are valid UTF-8."""
    return lines.where(F.is_valid_utf8(column))


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same of new files in a folder, as a stream (without line numbers)."""
    text = spark.readStream.options(**options).text(path)
    return text.select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("path")).where("value <> ''")


def raw(lines: DataFrame) -> DataFrame:
    """Whole lines in `body`; another column of that name gives way."""
    return lines.drop("body").withColumnRenamed("value", "body")


def parse_errors(lines: DataFrame) -> Column:
    """How many lines are no JSON objects, as an aggregate."""
    return F.count_if(~F.ltrim("value").startswith("{"))


# NDJSON.


def discover(lines: DataFrame) -> StructType:
    """The fields of JSON lines in order of name, each with its type; mixed types make a conflict struct.

    One pass; the result is as large as the set of field names.
    """
    value = F.try_parse_json("value")
    keys = lines.select(value.alias("v")).where("v is not null").select(
        F.explode(F.json_object_keys(F.col("v").cast("string"))).alias("key"), "v")
    kind = F.expr("schema_of_variant(try_variant_get(parse_json(to_json(v)), concat('$[\"', key, '\"]'), 'variant'))")
    types = keys.select("key", kind.alias("kind")).groupBy("key").agg(F.collect_set("kind").alias("kinds")).collect()
    return StructType([StructField(r["key"], _type(r["kinds"])) for r in sorted(types, key=lambda r: r["key"])])


def _type(kinds: list[str]) -> DataType:
    seen = {k for k in map(_kind, kinds) if k}
    simple = {"int": LongType(), "float": DoubleType(), "bool": BooleanType(), "str": StringType()}
    if len(seen) <= 1:
        return simple[seen.pop()] if seen else StringType()
    return StructType([StructField(k, simple[k]) for k in ("int", "float", "bool", "str") if k in seen])


def _kind(kind: str) -> str | None:
    if kind == "VOID":
        return None
    if kind == "BIGINT":
        return "int"
    if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
        return "float"
    return "bool" if kind == "BOOLEAN" else "str"


def json_rows(lines: DataFrame, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each line, with the fields of schema; a line that is no JSON object gives nulls.

    Nested values are raw JSON text; the first of duplicate keys wins; names match without case where the schema's own
    spelling isn't there. A conflict struct has the child of the value's own type. A line is parsed once; only text
    that isn't a JSON string (numbers as they are written, nested values, lines with duplicate keys) is cut from it again.
    """
    out = [F.col(f"`{c}`") for c in keep]
    parsed = lines.withColumn("silt_json", F.try_parse_json("value"))
    for f in schema:
        key = f.name.replace("\\", "\\\\").replace("'", "\\'")
        path = f"'$[\\'{key}\\']'"
        text, kind = F.expr(f"get_json_object(value, {path})"), F.expr(f"schema_of_variant(try_variant_get(silt_json, {path}, 'variant'))")
        value = lambda to, path=path: F.expr(f"try_variant_get(silt_json, {path}, '{to}')")
        if isinstance(f.dataType, StringType):
            shown = F.when(kind == "STRING", value("string")).when(F.col("silt_json").isNull() | (kind.isNotNull() & (kind != "VOID")), text)
            out.append(shown.alias(f.name))
            continue
        number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        typed = {
            "int": F.when(kind == "BIGINT", value("bigint")), "float": F.when(number, text.try_cast("double")),
            "bool": F.when(kind == "BOOLEAN", value("boolean")),
            "str": F.when(kind == "STRING", value("string")).when(~number & ~kind.isin("BIGINT", "BOOLEAN", "VOID"), text),
        }
        if isinstance(f.dataType, StructType):
            both = F.struct(*[typed[c.name].alias(c.name) for c in f.dataType])
            some = F.coalesce(*[typed[c.name].cast("string") for c in f.dataType]).isNotNull()
            out.append(F.when(some, both).alias(f.name))
        elif isinstance(f.dataType, DoubleType):
            out.append(F.when(number, text.try_cast("double")).when(kind == "BIGINT", value("double")).alias(f.name))
        else:
            out.append(typed["int" if isinstance(f.dataType, LongType) else "bool"].alias(f.name))
    return parsed.select(*out)


# CRI.


def cri_fields(value: Column) -> list[Column]:
    """ok, time, stream, flag and message of a CRI line; nulls if it is none."""
    ok = value.rlike(CRI)
    part = lambda g: F.when(ok, F.regexp_extract(value, CRI, g))
    return [ok.alias("ok"), part(1).alias("time"), part(2).alias("stream"), part(3).alias("flag"), part(4).alias("message")]


def reassemble(lines: DataFrame) -> DataFrame:
    """Whole messages of CRI lines (value, path, line_no): path, line_no, time and stream of the closing chunk, message.

    Chunks of one file and stream are joined up to a closing one; a line that is no CRI line drops what is open in its
    file; a message stops at MESSAGE_BYTES, and `truncated` says so. Lines are counted in stretches of a file, STRETCH
    places each, and the counts before a stretch come from the stretches' totals, so a large file is many tasks' work.
    """
    parsed = lines.select("path", "line_no", *cri_fields(F.col("value")))
    parsed = parsed.withColumn("stretch", F.floor(F.col("line_no") / STRETCH))
    closing = lambda of: F.count_if((F.col("flag") == "F") & (F.col("stream") == of))
    totals = parsed.groupBy("path", "stretch").agg(F.count_if(~F.col("ok")).alias("bad"), closing("stdout").alias("out"), closing("stderr").alias("err"))
    before = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bad", "out", "err")]
    parsed = parsed.join(totals.select("path", "stretch", *sums), ["path", "stretch"])
    here = Window.partitionBy("path", "stretch").orderBy("line_no")
    parsed = parsed.withColumn("epoch", F.col("bad_before") + F.count_if(~F.col("ok")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    of_stream = Window.partitionBy("path", "stretch", "stream").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.count_if(F.col("flag") == "F").over(of_stream), F.lit(0))
    parsed = parsed.where("ok").withColumn("grp", closed + F.when(F.col("stream") == "stdout", F.col("out_before")).otherwise(F.col("err_before")))
    chunk = F.struct("line_no", "message", "flag", "time")
    joined = parsed.groupBy("path", "stream", "epoch", "grp").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    last = F.element_at("chunks", -1)
    joined = joined.where(last["flag"] == "F").withColumn("message", F.array_join("chunks.message", ""))
    cut = F.octet_length("message") > MESSAGE_BYTES
    return joined.select(
        "path", last["line_no"].alias("line_no"), last["time"].alias("time"), "stream",
        F.when(cut, first_bytes(F.col("message"), MESSAGE_BYTES)).otherwise(F.col("message")).alias("message"), cut.alias("truncated"),
    )


def first_bytes(x: Column, n: int) -> Column:
    """The whole characters within the first n bytes of a text."""
    cuts = [F.substring(x.cast("binary"), 1, n - k).cast("string") for k in range(4)]
    return F.coalesce(*[F.try_validate_utf8(c) for c in cuts])


def cri(lines: DataFrame) -> DataFrame:
    """CRI lines as value (JSON text or null), body (plain text or null), _timestamp and _stream, with path and line_no."""
    return _split_message(reassemble(lines))


def _split_message(messages: DataFrame) -> DataFrame:
    is_json = F.ltrim("message").startswith("{")
    return messages.select(
        "path", "line_no", F.when(is_json, F.col("message")).alias("value"), F.when(~is_json, F.col("message")).alias("body"),
        F.col("time").alias(CRI_TIMESTAMP), F.col("stream").alias(CRI_STREAM),
    )


def auto(lines: DataFrame) -> DataFrame:
    """CRI lines, JSON objects and plain text together: as cri(), with null CRI columns for the others."""
    is_cri = F.col("value").rlike(CRI)
    others = lines.where(~is_cri).select(
        "path", "line_no", F.col("value").alias("message"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("stream"))
    return cri(lines.where(is_cri)).unionByName(_split_message(others))


def attach_source(df: DataFrame, style: str) -> DataFrame:
    """The file's path under the style's name and a stable 64-bit id of it; df has the path in `path`."""
    if style == "none":
        return df
    if style not in SOURCE_PATHS:
        raise ValueError(f"unknown source metadata style {style!r}")
    unsigned = F.conv(F.hex(F.xxhash64("path")), 16, 10).cast("decimal(20,0)")
    out = df.drop(SOURCE_ID, SOURCE_PATHS[style]).withColumn(SOURCE_ID, unsigned)
    return out.withColumn(SOURCE_PATHS[style], F.col("path"))


def attach_cri(df: DataFrame, time: Column, stream: Column) -> DataFrame:
    """_timestamp and _stream: CRI's where it has them, else the payload's own."""
    for name, col in ((CRI_TIMESTAMP, time), (CRI_STREAM, stream)):
        own = F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(col, own))
    return df
