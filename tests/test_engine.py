import re

import pytest

from quern import functions
from quern.dialect import _HELPERS, Engine
from quern.operators import alerts, tables
from quern.plans import catalogue, values
from quern.sources import files
from quern.streaming import ingest


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def one(engine, expression):
    return engine.sql(f"SELECT {expression} AS x").first()[0]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("ip_to_int('10.0.0.1')", 167772161), ("ip_to_int('10.0.0.256')", None), ("int_to_ip(167772161)", "10.0.0.1"), ("broadcast_address('10.1.2.3/24')", "10.1.2.255"),
        ("hosts_in_cidr('10.0.0.0/30')", 2), ("cidr_overlap('10.0.0.0/8', '10.2.0.0/16')", True), ("ip_add('255.255.255.255', 1)", "0.0.0.0"), ("is_private_ip('fd00::1')", True),
        ("reverse_dns('1.2.3.4')", "4.3.2.1.in-addr.arpa"), ("ipv6_to_eui64('00:11:22:33:44:55')", "0211:22ff:fe33:4455"), ("mac_vendor_oui('aa-bb-cc-dd-ee-ff')", "AA:BB:CC"),
        ("tcp_flags_from_string('SYN,ACK')", 18), ("tcp_flags_to_string(18)", "SYN,ACK"), ("ipv6_expand('::1')", "0000:0000:0000:0000:0000:0000:0000:0001"), ("teredo_server('2001:0:4136:e378:8000:63bf:3fff:fdd2')", "65.54.227.120"),
        ("murmur3('hello')", "cbd8a7b341bd9b025b1e906a48ae1d19"), ("q_xxhash64('a')", "d24ec4f1a98c6e5b"), ("to_base32('hello')", "NBSWY3DP"), ("entropy('aabb')", 1.0), ("round_half_even(2.5, 0)", 2.0),
        ("truncate(-1.567, 1)", -1.5), ("to_base(-255, 16)", "-ff"), ("from_base('zz', 36)", 1295), ("human_readable_seconds(90061)", "1 day, 1 hour, 1 minute, 1 second"), ("registered_domain('a.b.co.uk')", "b.co.uk"),
        ("http_host('GET / HTTP/1.1\\r\\nHost: x.org\\r\\n\\r\\n')", "x.org"), ("http_version('GET /a HTTP/1.1\\r\\n')", "HTTP/1.1"), ("hamming_distance('abc', 'abd')", 1), ("parse_bytes('1.5 KiB')", 1536), ("split_part('a.b', '.', 5)", ""),
        ("dns_query_name(unhex('000101000001000000000000037777770161000001000100'))", "www.a"), ("dns_query_type(unhex('0001010000010000000000000377777701610000010001'))", "A"), ("ether_type(unhex('0000000000000000000000000800'))", "IPv4"),
        ("trim(BOTH 'x' FROM 'xax')", "a"), ("ARRAY[1, 2, 3][2]", 2), ("3 = ANY (1, 2)", False), ("'a' SIMILAR TO 'b|a'", True), ("7 // 2", 3),
    ],
)
def test_function(engine, expression, value):
    assert one(engine, expression) == value


def test_every_macro_resolves(spark, engine):
    names = {f.name for f in spark.catalog.listFunctions()}
    assert set(functions.definitions()) <= names and set(functions.arrow.UDFS) <= names


def test_user_macros(engine):
    engine.sql("CREATE OR REPLACE FUNCTION twice(a) AS a * 2")
    engine.sql("CREATE OR REPLACE FUNCTION fourfold(a) AS twice(twice(a))")
    assert one(engine, "fourfold(1 + 2)") == 12
    with pytest.raises(ValueError):
        engine.sql("CREATE FUNCTION upper(a) AS a")
    with pytest.raises(ValueError):
        engine.sql("CREATE OR REPLACE FUNCTION twice(a) AS fourfold(a)")


def test_rewrites(engine):
    assert "NULLS LAST" in engine.rewrite("SELECT a FROM t ORDER BY a")
    assert "NULLS FIRST" in engine.rewrite("SELECT a FROM t ORDER BY a DESC")
    assert engine.rewrite("SELECT 'ORDER BY x' FROM t") == "SELECT 'ORDER BY x' FROM t"


def test_merge_and_policy(spark):
    t, s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, tables.merged(t, s, ["k"], update={"v": "s.v"}).collect())) == [(1, "a"), (2, "z"), (3, "c")]
    with pytest.raises(ValueError):
        tables.merged(t, s.union(s), ["k"])
    assert tables.secured(t, row_filter="k > 1", masks={"v": "'*'"}).collect() == [(2, "*")]


def test_change_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.insert(spark, path, spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    tables.update(spark, path, {"v": "'n'"}, "v IS NULL")
    tables.delete(spark, path, "k = 1")
    assert spark.read.parquet(path).collect() == [(2, "n")]
    (tmp_path / "a.json").write_text('[{"ip": "1.2.3.4"}, {"ip": "10.0.0.1"}]')
    df = files.tag_logical_types(files.read_json(spark, str(tmp_path / "a.json")))
    assert df.schema["ip"].metadata == {"logical": "ipv4"}


def test_alert(spark, engine):
    told = []
    s = alerts.Scheduler(spark, engine.sql, lambda a, rows: told.append(rows))
    a = s.create("CREATE ALERT hot AS SELECT 1 AS x EVERY 1 MINUTES WEBHOOK 'http://h'")
    assert a.every == 60 and s.fire(a) and told[0][0].x == 1 and s.history[0]["rows"] == 1
    with pytest.raises(ValueError):
        s.create("CREATE ALERT fast AS SELECT 1 EVERY 2 SECONDS")


def test_alert_statements(spark, engine, tmp_path):
    engine.sql("CREATE ALERT busy AS SELECT 1 AS x EVERY 30 SECONDS")
    engine.sql("ALTER ALERT busy SET EVERY 2 MINUTES")
    engine.sql("ALTER ALERT busy DISABLE")
    assert [(r.name, r.seconds, r.enabled) for r in engine.sql("SHOW ALERTS").collect()] == [("busy", 120, False)]
    assert not engine.alerts.fire(engine.alerts.alerts["busy"])
    engine.sql("DROP ALERT busy")
    engine.sql("DROP ALERT IF EXISTS busy")
    with pytest.raises(ValueError):
        engine.sql("DROP ALERT busy")


def test_statements(spark, engine, tmp_path):
    spark.sql("DROP TABLE IF EXISTS q_test")
    spark.sql(f"CREATE TABLE q_test USING parquet LOCATION '{tmp_path}/t' AS SELECT id AS k, CAST(id AS STRING) AS v FROM range(100)")
    assert engine.sql("UPDATE q_test SET v = concat(v, '!') WHERE k < 3").first().rows == 3
    assert engine.sql("DELETE FROM q_test WHERE k = 99").first().rows == 1
    assert engine.sql("DELETE FROM q_test WHERE k = 99").first().rows == 0
    assert engine.sql("MERGE INTO q_test t USING (SELECT 1 AS k, 'a' AS v UNION ALL SELECT 500, 'b') s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)").first().rows == 2
    (tmp_path / "rows.tsv").write_text("700\t\\N\n")
    engine.sql(f"COPY q_test (k, v) FROM '{tmp_path}/rows.tsv'")
    assert [tuple(r) for r in engine.sql("SELECT k, v FROM q_test WHERE k < 3 OR k > 98 ORDER BY k").collect()] == [(0, "0!"), (1, "a"), (2, "2!"), (500, "b"), (700, None)]
    assert engine.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'q_test'").count() == 0  # names beginning with q_ are the engine's own
    engine.sql("ALTER TABLE q_test DROP COLUMN v")
    assert engine.sql("SELECT * FROM q_test").columns == ["k"]
    spark.sql("DROP TABLE q_test")


def test_create_analyze_explain(spark, engine):
    spark.sql("DROP TABLE IF EXISTS made_here")
    engine.sql("CREATE TABLE made_here (k BIGINT, v VARCHAR, day DATE) PARTITION BY (day)")
    engine.sql("INSERT INTO made_here VALUES (1, 'a', DATE '2024-01-01'), (2, 'b', DATE '2024-01-02')")
    engine.sql("ANALYZE TABLE made_here")
    said = [r[0] for r in engine.sql("EXPLAIN ANALYZE SELECT * FROM made_here WHERE day = DATE '2024-01-02'").collect()]
    assert said[0].startswith("rows: 1,") and any("PartitionFilters: [isnotnull(day" in x for x in said)
    spark.sql("DROP TABLE made_here")


def test_information_schema(spark, engine):
    spark.range(1).createOrReplaceTempView("held")
    assert engine.sql("SELECT table_type FROM information_schema.tables WHERE table_name = 'held'").first()[0] == "VIEW"
    assert engine.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'held'").first()[:] == ("id", "bigint")


def test_recovery(spark, tmp_path):
    """A change that was cut off after its journal is finished by the next."""
    path = str(tmp_path / "t")
    tables.insert(spark, path, spark.range(10).coalesce(1))
    change = tables._Change(spark, path)
    old = change.files(path, "part-")
    change.write(spark.range(5).coalesce(1))
    finish, change.finish = change.finish, lambda *a: None
    change.commit(old)
    assert spark.read.parquet(path).count() == 10
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 5 and [f.rpartition("/")[2] for f in change.files(path, "_")] == ["_SUCCESS"]
    for k in range(4):
        tables.insert(spark, path, spark.range(k).coalesce(1))
    assert tables.compact(spark, path) >= 4 and spark.read.parquet(path).count() == 11


def test_types(engine):
    assert one(engine, "7 / 2") == 3 and one(engine, "CAST(7 AS DOUBLE) / 2") == 3.5 and one(engine, "CAST(5 / 2.0D AS INT)") == 3
    assert one(engine, "(SELECT max(id) / 2 FROM range(6))") == 2
    assert engine.sql("SELECT (id + 1) / 2 / 2 AS x, CAST(id / 2.0D AS INT) AS y FROM range(8) ORDER BY x DESC, y DESC FETCH FIRST 1 + 0 ROWS ONLY").collect() == [(2, 4)]


def test_table_functions(spark, engine, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;y\n")
    (tmp_path / "a.json").write_text('{"k": 2, "w": 5}\n')
    assert engine.sql(f"SELECT a.v, b.w FROM read_csv('{tmp_path}/a.csv', delimiter=';') a JOIN read_json('{tmp_path}/a.json') b ON a.k = b.k").collect() == [("y", 5)]
    assert [r[0] for r in engine.sql("SELECT * FROM generate_series(5, 1, 2)").collect()] == [5, 3, 1]
    assert [r[0] for r in engine.sql("SELECT c FROM unnest(3, 4) AS u(c)").collect()] == [3, 4]


def test_newest_iceberg_metadata(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    for n in (9, 10):
        (tmp_path / "metadata" / f"v{n}.metadata.json").write_text('{"snapshots": [], "current-snapshot-id": %d}' % n)
    with pytest.raises(ValueError, match="no current snapshot"):
        files.iceberg_files(spark, str(tmp_path))


def test_ingest(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_files(spark, str(tmp_path / "in"), "id long")
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), every=None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize("family", list(values.CASES))
def test_values(engine, family):
    """Every function gives the values that its calls are listed with."""
    assert {(r.call, r.value) for r in engine.sql(values.query(family)).collect()} == set(values.cases(family))


def test_every_function_is_called():
    """No macro that users may call is without a listed value."""
    calls = " ".join(c for f in values.CASES for c, _ in values.cases(f))
    plain = {n.removeprefix("q_") for n in [*functions.definitions(), *functions.arrow.UDFS]} - _HELPERS
    assert not {n for n in plain if not re.search(rf"\b{n}\(", calls)} - {"from_iso8601_date"}


def test_cidr_join_of_many_users(spark, tmp_path):
    """Users have addresses of their own, beyond 65,536 of them too."""
    users = [0, 31, 32, 255, 256, 65535, 65536, 65791, 90000, 1 << 24, (1 << 24) + 255, 1 << 32]
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["cidr_join"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, f"10.0.0.{u // 32 * 32}/27") for i, u in enumerate(users) if u < 256]


def test_each_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
