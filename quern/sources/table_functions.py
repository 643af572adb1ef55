"""Table functions in SQL: FROM read_parquet(..), read_csv(..), generate_series(..), unnest(..), and database scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.sources import files
from quern.tokens import arguments, blank, close, following, skip

_NAMES = {"read_parquet", "read_csv", "read_csv_auto", "read_json", "read_json_auto", "postgres_scan", "postgres_query", "mysql_scan", "mysql_query", "generate_series", "unnest"}


def expand(spark: SparkSession, tokens: list[str]) -> list[str]:
    """Replace calls that stand after FROM, JOIN or a comma by views or by table functions of Spark's."""
    out, i, before = [], 0, ""
    while i < len(tokens):
        t = tokens[i]
        if t.lower() in _NAMES and before in ("FROM", "JOIN", ",") and following(tokens, i) == "(":
            at = skip(tokens, i + 1)
            end = close(tokens, at)
            args = ["".join(a).strip() for a in arguments(tokens[at + 1 : end])]
            if t.lower() == "unnest":
                made, end = _unnest(tokens, end, args)
            else:
                made = _view(_source(spark, t.lower(), args))
            out.append(made)
            i = end + 1
        else:
            out.append(t)
            i += 1
        if not blank(t):
            before = t.upper()
    return out


def _text(arg: str) -> str:
    if len(arg) < 2 or arg[0] != "'" or arg[-1] != "'":
        raise ValueError(f"a text literal is expected, not {arg}")
    return arg[1:-1].replace("''", "'")


def _view(df: DataFrame) -> str:
    name = f"q_source_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _source(spark: SparkSession, name: str, args: list[str]) -> DataFrame:
    plain = [a for a in args if "=" not in a or a.startswith("'")]
    named = {k.strip().lower(): v.strip() for k, _, v in (a.partition("=") for a in args if a not in plain)}
    if name == "generate_series":
        return files.generate_series(spark, *[spark.sql(f"SELECT CAST({a} AS BIGINT)").first()[0] for a in args])
    if name == "read_parquet":
        return files.read_parquet(spark, _text(plain[0]))
    if name in ("read_csv", "read_csv_auto"):
        mark = next((named[k] for k in ("delimiter", "delim", "sep") if k in named), plain[1] if len(plain) > 1 else "','")
        return files.read_csv(spark, _text(plain[0]), _text(mark), named.get("header", "true").lower().strip("'") == "true")
    if name in ("read_json", "read_json_auto"):
        return files.read_json(spark, _text(plain[0]))
    what = {"query" if name.endswith("query") else "table": _text(plain[1])}
    return files.scan_jdbc(spark, _text(plain[0]), **what)


def _unnest(tokens: list[str], end: int, args: list[str]) -> tuple[str, int]:
    """unnest(list or array) [WITH ORDINALITY]; a list of values is an array of them."""
    array = args[0] if len(args) == 1 and not args[0].lstrip("-").replace(".", "").isdigit() and not args[0].startswith("'") else f"array({', '.join(args)})"
    if following(tokens, end) == "WITH":
        at = skip(tokens, end + 1)
        if following(tokens, at) == "ORDINALITY":
            return f"LATERAL (SELECT q_v, q_p + 1 FROM LATERAL posexplode({array}) AS q_u(q_p, q_v))", skip(tokens, at + 1)
    return f"LATERAL explode({array})", end
