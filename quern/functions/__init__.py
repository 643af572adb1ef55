"""Scalar functions beyond Spark's own, registered in a session.

Most are SQL macros that Catalyst inlines; byte parsers are Arrow UDFs.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from quern.functions import arrow, general, network, payload

_LINE = re.compile(r"^(\w+)\(([^)]*)\) (\w+(?:<.*?>)?) = (.*)$")


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, expression) of every macro."""
    out = {}
    for text in (general.MACROS, network.MACROS, payload.MACROS):
        for line in text.strip().splitlines():
            if line and not line.startswith("--"):
                name, params, kind, body = _LINE.match(line).groups()
                out[name] = params, kind, body
    return out


def register(spark: SparkSession) -> list[str]:
    """Register macros and UDFs; the names registered."""
    arrow.register(spark)
    names = list(arrow.UDFS)
    for name, (params, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        names.append(name)
    return names
