"""The analog views of ``analogs.py`` as DuckDB SQL (for the oracle only).

``sql_with(["U", "INC"], body)`` prefixes ``body`` with the CTEs it needs
(dependencies included, in order).
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "E": ((), """
SELECT event_id, user_id AS server_id, CAST(ts AS DATE) AS date, ts, event_type, value,
       TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events"""),
    "U": (("E",), """
SELECT event_id, server_id, date, ts, event_type,
       value % 100.0::DOUBLE AS cpu_util_pct,
       CAST(k AS DOUBLE) AS ram_util_pct,
       (value * 3.0::DOUBLE) % 100.0::DOUBLE AS disk_util_pct,
       20.0::DOUBLE + value % 60.0::DOUBLE AS temperature_c,
       value / 10.0::DOUBLE AS net_in_gb,
       CAST(k AS DOUBLE) / 10.0::DOUBLE AS net_out_gb,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS backup_success,
       (value * 7.0::DOUBLE) % 100.0::DOUBLE AS capacity_used_pct
FROM E"""),
    "INC": (("E",), """
SELECT event_id AS incident_id, server_id, date, value AS duration_minutes,
       CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'medium'
            WHEN value < 150 THEN 'high' ELSE 'critical' END AS severity,
       CASE k % 3 WHEN 0 THEN 'disk' WHEN 1 THEN 'network' ELSE 'hypervisor' END AS component,
       k % 2 AS customer_visible,
       CASE WHEN value >= 100 THEN 1 ELSE 0 END AS sla_breach,
       CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS root_cause_known
FROM E WHERE event_type = 'error'"""),
    "SRV": ((), """
SELECT c.c_custkey AS server_id, c.c_custkey AS customer_id, r.r_name AS region,
       n.n_name AS country, c.c_mktsegment AS segment,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Basic' WHEN 'BUILDING' THEN 'standard'
            WHEN 'FURNITURE' THEN 'PREMIUM' WHEN 'HOUSEHOLD' THEN 'critical'
            ELSE 'enterprise' END AS support_plan,
       c.c_acctbal AS monthly_spend_eur,
       c.c_nationkey % 2 AS has_gpu,
       CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_managed,
       c.c_acctbal / 50.0::DOUBLE AS capacity_used_pct
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "ED": (("E",), """
SELECT server_id, date, COUNT(*) AS n_obs, SUM(value) AS value_sum, MAX(value) AS value_max,
       AVG(value) AS value_avg,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error
FROM E GROUP BY server_id, date"""),
    "GP": (("E",), """
SELECT event_type AS region, date, COUNT(*) AS support_tickets,
       AVG(value) AS network_latency_ms, MAX(value) / 5.0::DOUBLE AS capacity_used_pct,
       SUM(value) / 1000.0::DOUBLE AS power_usage_mw, AVG(k) AS avg_rack_temperature_c,
       CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS scheduled_maintenance
FROM E GROUP BY event_type, date"""),
    "RDL": ((), """
SELECT n.n_regionkey AS region, CAST(l.l_shipdate AS DATE) AS date, l.l_suppkey AS server_id,
       l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
    "SC": ((), """
SELECT l.doc_id AS key, l.doc_id % 16 AS day, l.toxic AS y,
       d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql_with(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH <needed analog views>, <extra ctes> <body>."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names)]
    ctes += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    body = body.strip()
    if not ctes:
        return "WITH " + body[1:].lstrip() if body.startswith(",") else body
    return "WITH " + ",\n".join(ctes) + "\n" + body
