"""MaxMind DB files: the public binary format, read from its bytes."""

from __future__ import annotations

import ipaddress
import struct

MARK = b"\xab\xcd\xefMaxMind.com"
#: Bytes between the search tree and the data.
GAP = 16


def _value(data: bytes, at: int, base: int) -> tuple[object, int]:
    """The value at a place, and the place after it; pointers count from base."""
    control = data[at]
    kind, size, at = control >> 5, control & 31, at + 1
    if kind == 1:
        n, low = (size >> 3) + 1, size & 7
        raw = int.from_bytes(data[at : at + n], "big")
        to = raw if n == 4 else (low << 8 * n | raw) + (0, 2048, 526336)[n - 1]
        return _value(data, base + to, base)[0], at + n
    if not kind:
        kind, at = data[at] + 7, at + 1
    if size > 28:
        n = size - 28
        size = (29, 285, 65821)[n - 1] + int.from_bytes(data[at : at + n], "big")
        at += n
    if kind == 7:
        out = {}
        for _ in range(size):
            key, at = _value(data, at, base)
            out[key], at = _value(data, at, base)
        return out, at
    if kind == 11:
        items = []
        for _ in range(size):
            item, at = _value(data, at, base)
            items.append(item)
        return items, at
    if kind == 14:
        return bool(size), at
    raw = data[at : at + size]
    if kind == 2:
        value: object = raw.decode("utf-8", "replace")
    elif kind in (3, 15):
        value = struct.unpack(">d" if kind == 3 else ">f", raw)[0]
    elif kind == 8:
        value = int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True) if len(raw) == 4 else int.from_bytes(raw, "big")
    elif kind in (5, 6, 9, 10):
        value = int.from_bytes(raw, "big")
    elif kind == 4:
        value = bytes(raw)
    else:
        raise ValueError(f"a value of unknown kind {kind} in a geo database")
    return value, at + size


class Mmdb:
    """A database by address; find() gives a row in the order of geo.FIELDS, of a city or country database."""

    def __init__(self, data: bytes) -> None:
        at = data.rfind(MARK)
        if at < 0:
            raise ValueError("not a MaxMind database")
        self.about, _ = _value(data, at + len(MARK), at + len(MARK))
        self.data, self.nodes, self.bits = data, self.about["node_count"], self.about["record_size"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits in a geo database")
        self.base = self.nodes * self.bits // 4 + GAP
        self.first = 0
        if self.about["ip_version"] == 6:  # IPv4 lies below 96 zeros
            for _ in range(96):
                if self.first < self.nodes:
                    self.first = self._side(self.first, 0)

    def _side(self, node: int, bit: int) -> int:
        n = self.bits // 4
        raw = self.data[node * n : node * n + n]
        if self.bits == 28:
            return (raw[3] & 15) << 24 | int.from_bytes(raw[4:7], "big") if bit else (raw[3] >> 4) << 24 | int.from_bytes(raw[:3], "big")
        return int.from_bytes(raw[n // 2 :] if bit else raw[: n // 2], "big")

    def record(self, ip: str | None) -> dict | None:
        try:
            address = ipaddress.ip_address((ip or "").strip())
        except ValueError:
            return None
        if address.version == 6 and address.ipv4_mapped:
            address = address.ipv4_mapped
        if address.version == 6 and self.about["ip_version"] == 4:
            return None
        node = self.first if address.version == 4 else 0
        for k in range(address.max_prefixlen - 1, -1, -1):
            if node >= self.nodes:
                break
            node = self._side(node, int(address) >> k & 1)
        if node <= self.nodes:
            return None
        return _value(self.data, node - self.nodes - GAP + self.base, self.base)[0]

    def find(self, ip: str | None) -> tuple | None:
        found = self.record(ip)
        if not isinstance(found, dict):
            return None
        name = lambda x: ((x or {}).get("names") or {}).get("en")
        where, parts = found.get("location") or {}, found.get("subdivisions") or [None]
        country = found.get("country") or {}
        return (
            country.get("iso_code"), name(country), name(found.get("city")), name(parts[0]),
            where.get("latitude"), where.get("longitude"), None, None,
        )


def read(path: str) -> Mmdb:
    with open(path, "rb") as f:
        return Mmdb(f.read())
