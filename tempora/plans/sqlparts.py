"""SQL text fragments for the DuckDB oracle (the tables are pre-registered
views there).  They restate each operator relationally so the Spark plans
can be compared with an independent engine."""

from __future__ import annotations

from tempora.sources.tables import EVENT_TYPES

EV = ", ".join(EVENT_TYPES)


def hourly_sql(multi: bool = True) -> str:
    sid = "user_id % 8" if multi else "CAST(0 AS BIGINT)"
    cols = ",\n  ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in EVENT_TYPES)
    return (f"SELECT {sid} AS series_id, date_trunc('hour', ts) AS ts,\n  {cols}\n"
            f"FROM events GROUP BY 1, 2")


def daily_sql() -> str:
    return ("SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,\n"
            "  avg(l_quantity) AS qty, avg(l_discount) * 1000 AS disc,\n"
            "  avg(l_tax) * 1000 AS tax, avg(l_extendedprice) AS price\n"
            "FROM lineitem GROUP BY 1, 2")


def grid_sql(src: str, cols, step: str = "INTERVAL 1 HOUR") -> str:
    """Calendar min..max per series LEFT JOIN data (exact-match reindex)."""
    sel = ", ".join(f"d.{c}" for c in cols)
    return (f"SELECT g.series_id, g.ts, {sel} FROM (\n"
            f"  SELECT series_id, unnest(generate_series(min(ts), max(ts), {step})) AS ts\n"
            f"  FROM {src} GROUP BY series_id) g\n"
            f"LEFT JOIN {src} d ON d.series_id = g.series_id AND d.ts = g.ts")


def interp_sql(src: str, cols, both: bool = True, pos: str = "row_number() OVER (PARTITION BY series_id ORDER BY ts)",
               keep=()) -> str:
    """Position-weighted linear interpolation between neighbours."""
    parts = []
    for c in cols:
        parts.append(
            f"last_value({c} IGNORE NULLS) OVER wf AS pv_{c}, "
            f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wf AS pp_{c}, "
            f"first_value({c} IGNORE NULLS) OVER wb AS nv_{c}, "
            f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wb AS np_{c}")
    fills = []
    for c in cols:
        inner = f"pv_{c} + (nv_{c} - pv_{c}) * (pos - pp_{c}) / (np_{c} - pp_{c})"
        tail = f", pv_{c}, nv_{c}" if both else f", pv_{c}"
        fills.append(f"coalesce({c}, {inner}{tail}) AS {c}")
    kept = "".join(f"{k}, " for k in keep)
    return (f"SELECT series_id, ts, {kept}{', '.join(fills)} FROM (\n"
            f"  SELECT *, {', '.join(parts)} FROM (SELECT *, {pos} AS pos FROM ({src}))\n"
            f"  WINDOW wf AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),\n"
            f"         wb AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def with_ctes(ctes: dict[str, str], final: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"
