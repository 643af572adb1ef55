"""Places and networks of addresses from a table of ranges that the user gives.

`load` takes rows (cidr, country, country_name, city, subdivision, postal_code, latitude,
longitude, timezone, continent, asn, org) and registers the geoip_* functions over them.  The
ranges go to every worker, so their number has a bound; larger tables are joined with
`tables.cidr_join`, which broadcasts nothing.
"""

from __future__ import annotations

import bisect
import ipaddress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "country": "string", "country_name": "string", "city": "string", "subdivision": "string", "postal_code": "string", "latitude": "double", "longitude": "double",
    "timezone": "string", "continent": "string", "asn": "bigint", "org": "string",
}
MOST_RANGES = 1_000_000


class Ranges:
    """Networks by their first address; an address belongs to the narrowest that holds it."""

    def __init__(self, rows: list[tuple]) -> None:
        self.tables: dict[tuple[int, int], tuple[list[int], list[tuple]]] = {}
        for cidr, *values in rows:
            net = ipaddress.ip_network(cidr, strict=False)
            held = self.tables.setdefault((net.version, net.prefixlen), ([], []))
            at = bisect.bisect_left(held[0], int(net.network_address))
            held[0].insert(at, int(net.network_address))
            held[1].insert(at, tuple(values))
        self.order = sorted(self.tables, key=lambda k: -k[1])

    def find(self, text: str | None) -> tuple | None:
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        for version, length in self.order:
            if version != address.version:
                continue
            firsts, values = self.tables[version, length]
            shift = address.max_prefixlen - length
            first = int(address) >> shift << shift
            at = bisect.bisect_left(firsts, first)
            if at < len(firsts) and firsts[at] == first:
                return values[at]
        return None


def load(spark: SparkSession, ranges: DataFrame) -> None:
    """Register geoip_country(ip) and so on; null where no range holds the address."""
    rows = [tuple(r) for r in ranges.select("cidr", *COLUMNS).limit(MOST_RANGES + 1).collect()]
    if len(rows) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges: join them with tables.cidr_join")
    held = Ranges(rows)
    for k, (name, kind) in enumerate(COLUMNS.items()):
        spark.udf.register(f"geoip_{name}", F.pandas_udf(_lookup(held, k), kind))


def _lookup(held: Ranges, k: int):
    def run(ips: pd.Series) -> pd.Series:
        found = {ip: held.find(ip) for ip in ips.unique() if ip is not None}
        return pd.Series([None if ip is None or found[ip] is None else found[ip][k] for ip in ips], dtype=object)

    return run
