"""Queries of a security desk over network tables that are derived from `events`.

Each table is a WITH clause of arithmetic over an event's number and user, written for both
engines: our functions on one side, plain arithmetic on the other.
"""

from __future__ import annotations


def _ip(number: str, ours: bool) -> str:
    parts = ", '.', ".join(f"(({number}) >> {k}) & 255" for k in (24, 16, 8, 0))
    return f"int_to_ip({number})" if ours else f"concat({parts})"


def _tables(ours: bool) -> dict[str, str]:
    e = "CAST(event_id AS BIGINT)"
    client, server = _ip("167772160 + user_id", ours), _ip(f"3232235520 + {e} % 251", ours)
    outside = _ip(f"134744072 + {e} % 97", ours)
    return {
        "netflow": f"""SELECT event_id AS id, ts, {client} AS src_ip, CASE WHEN event_id % 3 = 0 THEN {outside} ELSE {server} END AS dst_ip, CAST(1024 + {e} * 13 % 50000 AS INT) AS src_port,
            CAST(CASE event_id % 6 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 53 WHEN 3 THEN 8080 WHEN 4 THEN 3389 ELSE 40000 + event_id % 100 END AS INT) AS dst_port,
            CASE WHEN event_id % 4 = 0 THEN 17 ELSE 6 END AS protocol, {e} * 37 % 9973 AS bytes_sent, {e} * 53 % 19997 AS bytes_recv, {e} * 7919 % 600000 AS duration_ms, CAST({e} * 11 % 64 AS INT) AS flags FROM events""",
        "firewall": f"""SELECT event_id AS id, ts, {client} AS src_ip, {server} AS dst_ip, CAST(event_id * 7 % 1000 AS INT) AS dst_port, CASE event_id % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'drop' ELSE 'allow' END AS action,
            concat('R', event_id % 40) AS rule_id, CASE event_id % 3 WHEN 0 THEN 'dmz' WHEN 1 THEN 'lan' ELSE 'wan' END AS zone_src, CASE event_id % 2 WHEN 0 THEN 'lan' ELSE 'wan' END AS zone_dst FROM events""",
        "dns": f"""SELECT event_id AS id, ts, {client} AS client_ip, {server} AS server_ip, concat(CASE event_id % 7 WHEN 0 THEN 'login-update.' ELSE 'www.' END, 'host', event_id % 50, CASE event_id % 3 WHEN 0 THEN '.example.co.uk' ELSE '.example.org' END) AS query_name,
            CASE event_id % 4 WHEN 0 THEN 'AAAA' ELSE 'A' END AS query_type, CASE event_id % 9 WHEN 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code, {e} * 31 % 4001 AS latency FROM events""",
        "auth": f"""SELECT event_id AS id, ts, {client} AS src_ip, concat('user', user_id % 60) AS username, CASE event_id % 4 WHEN 0 THEN 'login_failure' WHEN 1 THEN 'privilege_escalation' ELSE 'login_success' END AS action,
            CASE event_id % 2 WHEN 0 THEN 'ssh' ELSE 'web' END AS service, CAST({e} * 17 % 101 AS INT) AS risk_score FROM events""",
        "alerts": f"""SELECT event_id AS id, ts, {client} AS src_ip, {server} AS dst_ip, CASE event_id % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity, CASE event_id % 3 WHEN 0 THEN 'malware' ELSE 'scan' END AS category FROM events WHERE event_id % 5 < 2""",
    }


#: name -> (tables, query, and for each {k} in it our expression and the other engine's).
QUERIES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "talkers": ("netflow", "SELECT src_ip, sum(bytes_sent + bytes_recv) AS total, count(*) AS flows FROM netflow GROUP BY src_ip ORDER BY total DESC, src_ip LIMIT 20", []),
    "protocols": ("netflow", "SELECT {0} AS protocol, count(*) AS flows, sum(bytes_sent) AS sent FROM netflow GROUP BY {0}", [("protocol_name(protocol)", "CASE protocol WHEN 17 THEN 'udp' ELSE 'tcp' END")]),
    "odd_ports": (
        "netflow", "SELECT dst_ip, dst_port, {0} AS class, count(*) AS n FROM netflow WHERE {1} AND NOT {2} AND dst_port NOT IN (22, 53, 443) GROUP BY dst_ip, dst_port, {0}",
        [("port_class(dst_port)", "CASE WHEN dst_port < 1024 THEN 'well-known' WHEN dst_port < 49152 THEN 'registered' ELSE 'ephemeral' END"), ("is_private_ip(src_ip)", "src_ip LIKE '10.%'"), ("is_private_ip(dst_ip)", "dst_ip LIKE '192.168.%'")],
    ),
    "hourly": ("netflow", "SELECT CAST(extract(hour FROM ts) AS INT) AS hour, count(*) AS flows, sum(bytes_recv) AS received FROM netflow GROUP BY 1", []),
    "long_flows": ("netflow", "SELECT id, src_ip, dst_ip, {0} AS service, duration_ms FROM netflow WHERE duration_ms > 590000", [("port_name(dst_port)", "CASE dst_port WHEN 443 THEN 'https' WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' WHEN 8080 THEN 'http-alt' WHEN 3389 THEN 'rdp' END")]),
    "denied": ("firewall", "SELECT src_ip, count(*) AS n FROM firewall WHERE action IN ('deny', 'drop') GROUP BY src_ip", []),
    "zones": ("firewall", "SELECT zone_src, zone_dst, action, count(*) AS n FROM firewall GROUP BY zone_src, zone_dst, action", []),
    "hot_rules": ("firewall", "SELECT rule_id, action, count(*) AS n FROM firewall GROUP BY rule_id, action HAVING count(*) > 10", []),
    "nxdomain": ("dns", "SELECT client_ip, count(*) AS n FROM dns WHERE response_code = 'NXDOMAIN' GROUP BY client_ip", []),
    "bad_names": ("dns", "SELECT client_ip, query_name, {0} AS domain, query_type, count(*) AS n FROM dns WHERE query_name LIKE '%login-%' OR query_name ILIKE '%UPDATE%' GROUP BY client_ip, query_name, {0}, query_type", [("registered_domain(query_name)", "CASE WHEN query_name LIKE '%.co.uk' THEN 'example.co.uk' ELSE 'example.org' END")]),
    "latency": ("dns", "SELECT server_ip, round(avg(latency), 4) AS mean, max(latency) AS worst, {0} AS p95 FROM dns GROUP BY server_ip", [("round(percentile_cont(0.95, latency), 4)", "round(quantile_cont(latency, 0.95), 4)")]),
    "brute_force": ("auth", "SELECT username, service, count(*) AS failures, count(DISTINCT src_ip) AS sources FROM auth WHERE action = 'login_failure' GROUP BY username, service HAVING count(*) > 5", []),
    "escalations": ("auth", "SELECT id, username, src_ip FROM auth WHERE action = 'privilege_escalation' AND service = 'ssh' OR action = 'privilege_escalation' AND risk_score > 95", []),
    "risky": ("auth", "SELECT id, username, risk_score FROM auth WHERE risk_score >= 90", []),
    "severities": ("alerts", "SELECT severity, category, count(*) AS n FROM alerts GROUP BY severity, category", []),
    "critical": ("alerts", "SELECT id, ts, src_ip, dst_ip FROM alerts WHERE severity = 'critical' ORDER BY ts DESC, id", []),
    "targets": ("alerts", "SELECT dst_ip, {0} AS net, count(*) AS n FROM alerts WHERE {1} GROUP BY dst_ip, {0}", [("mask_ip(dst_ip, 1)", "'192.168.0.0'"), ("cidr_contains('192.168.0.128/25', dst_ip)", "CAST(split_part(dst_ip, '.', 4) AS INT) >= 128")]),
    "denied_alerted": ("firewall alerts", "SELECT f.src_ip, count(DISTINCT f.id) AS denied, count(DISTINCT a.id) AS alerted FROM (SELECT * FROM firewall WHERE action = 'deny') f JOIN alerts a ON f.src_ip = a.src_ip AND f.dst_ip = a.dst_ip GROUP BY f.src_ip", []),
    "failed_then_asked": ("dns auth", "SELECT d.client_ip, count(*) AS n FROM dns d WHERE d.client_ip IN (SELECT src_ip FROM auth WHERE action = 'login_failure' AND risk_score > 80) AND d.response_code = 'NXDOMAIN' GROUP BY d.client_ip", []),
    "alerted_traffic": ("firewall alerts", "SELECT f.src_ip, f.action, count(*) AS n FROM firewall f WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.src_ip = f.src_ip AND a.severity IN ('critical', 'high')) GROUP BY f.src_ip, f.action", []),
    "handshakes": ("netflow", "SELECT {0} AS flags, count(*) AS n, count_if({1}) AS opened, count_if({2}) AS reset FROM netflow GROUP BY {0}", [
        ("tcp_flags_to_string(flags)", "array_to_string([x FOR x IN [CASE WHEN flags & 1 > 0 THEN 'FIN' END, CASE WHEN flags & 2 > 0 THEN 'SYN' END, CASE WHEN flags & 4 > 0 THEN 'RST' END, CASE WHEN flags & 8 > 0 THEN 'PSH' END, CASE WHEN flags & 16 > 0 THEN 'ACK' END, CASE WHEN flags & 32 > 0 THEN 'URG' END] IF x IS NOT NULL], ',')"),
        ("is_tcp_handshake(flags)", "(flags & 2) > 0 AND (flags & 16) = 0"), ("has_tcp_flag(flags, 'RST')", "(flags & 4) > 0"),
    ]),
}


def text(name: str, ours: bool) -> str:
    tables, query, pairs = QUERIES[name]
    made = _tables(ours)
    with_ = ", ".join(f"{t} AS ({made[t]})" for t in tables.split())
    for k, (own, other) in enumerate(pairs):
        query = query.replace(f"{{{k}}}", own if ours else other)
    return f"WITH {with_} {query}"
