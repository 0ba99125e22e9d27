"""IP geolocation from ranges: a small sorted table, looked up by bisection in Arrow batches."""

from __future__ import annotations

import csv
import ipaddress
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from silt.functions import mmdb

FIELDS = (
    "country_code string, country_name string, city string, region string, latitude double, longitude double, asn bigint, org string"
)
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
# Header names accepted for each column.
ALIASES = {
    "start": ("ip_range_start", "start_ip", "range_start"),
    "end": ("ip_range_end", "end_ip", "range_end"),
    "region": ("region", "stateprov", "state", "subdivision"),
    "org": ("org", "organization", "as_org"),
}


def ip_number(text: str | None) -> int | None:
    """A 128-bit number, IPv4 mapped into IPv6; None if text is no address."""
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


@dataclass
class Ranges:
    """Ranges that don't overlap, by start; rows are tuples in the order of FIELDS."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def find(self, ip: str | None) -> tuple | None:
        n = ip_number(ip)
        if n is None:
            return None
        k = bisect_right(self.starts, n) - 1
        return self.rows[k] if k >= 0 and n <= self.ends[k] else None


def read_ranges(lines) -> Ranges:
    """Ranges of a CSV; rows whose end is before their start are skipped, overlaps are an error."""
    out = []
    for row in csv.DictReader(lines):
        row = {k.strip().lower(): (v or "").strip() for k, v in row.items() if k}

        def get(name: str, row=row) -> str | None:
            return next((row[n] for n in ALIASES.get(name, (name,)) if row.get(n)), None)

        start, end = ip_number(get("start")), ip_number(get("end"))
        if start is None or end is None or end < start:
            continue
        asn = (get("asn") or "").upper().removeprefix("AS")
        number = lambda x: float(x) if x else None
        values = (get("country_code"), get("country_name"), get("city"), get("region"), number(get("latitude")))
        out.append((start, end, (*values, number(get("longitude")), int(asn) if asn.isdigit() else None, get("org"))))
    out.sort(key=lambda x: x[:2])
    for a, b in zip(out, out[1:]):
        if b[0] <= a[1]:
            raise ValueError("geo ranges overlap")
    return Ranges([x[0] for x in out], [x[1] for x in out], [x[2] for x in out])


def read_database(path: str, format: str = "csv_range") -> Ranges:
    """A geo database from a file: ranges in CSV, or a MaxMind database."""
    if format == "csv_range":
        with open(path, encoding="utf-8", newline="") as f:
            return read_ranges(f)
    if format != "mmdb":
        raise ValueError(f"unknown geo database format {format!r}")
    return mmdb.read(path)


def geo_lookup(ranges: Ranges):
    """A pandas UDF: the range's fields for an IP text, all null where there is none."""

    @pandas_udf(FIELDS)
    def lookup(ip: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        rows = []
        for x in ip:
            if x not in memo:
                memo[x] = ranges.find(x) or (None,) * len(_NAMES)
            rows.append(memo[x])
        out = pd.DataFrame(rows, columns=_NAMES, dtype=object)
        out["asn"] = out["asn"].astype("Int64")
        for c in ("latitude", "longitude"):
            out[c] = out[c].astype("float64")
        return out

    return lookup


def register(spark: SparkSession, ranges: Ranges, name: str = "geo_lookup") -> None:
    spark.udf.register(name, geo_lookup(ranges))
