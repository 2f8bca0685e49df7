"""The bindings of ``bindings.py`` written as DuckDB SQL (for the oracle check).

``with_views(body, *names)`` prefixes a query with the CTEs it needs.
Integer sums are cast to BIGINT and weeks to INTEGER so both engines agree on
types; doubles are rounded to 6 places on both sides by the queries.
"""

from __future__ import annotations

from ..functions.exact import BASE, PLACES


def scaled_mean(x: str, decimals: int = 2) -> str:
    """The mean of values with so many decimals from one sum of whole numbers (``functions.exact``)."""
    return f"(CAST(SUM(CAST(round_even({x} * 1e{decimals}, 0) AS BIGINT)) AS DOUBLE) / 1e{decimals} / CAST(COUNT({x}) AS DOUBLE))"


def exact_mean(x: str) -> str:
    """The mean from digits to the base 2**24, whose sums are exact (``functions.exact``)."""
    total = "CAST(0.0 AS DOUBLE)"
    for place in PLACES:
        digit = (f"round_even({x} * power(2.0, {-BASE * place}), 0)"
                 f" - power(2.0, {BASE}) * round_even({x} * power(2.0, {-BASE * (place + 1)}), 0)")
        total = f"({total} + CAST(SUM(CAST({digit} AS BIGINT)) AS DOUBLE) * power(2.0, {BASE * place}))"
    return f"({total} / CAST(COUNT({x}) AS DOUBLE))"


def swept(src: str, k: int, by: str = "") -> dict[str, str]:
    """CTEs ``swept1`` to ``swept<k>``: Gauss-Jordan steps on the matrix ``src`` (i, j, v), one matrix for each ``by``:
    places under k become the inverse's, the columns behind them coefficients and residual products."""
    keep, same = (f"a.{by}, ", f" AND p.{by} = a.{by}") if by else ("", "")
    out, last = {}, src
    for n in range(k):
        at = lambda x, i, j: f"JOIN {last} {x} ON {x}.i = {i} AND {x}.j = {j}{same.replace('p.', x + '.')}"  # noqa: E731, B023
        out[f"swept{n + 1}"] = f"""SELECT {keep}a.i, a.j, CASE WHEN a.i = {n} AND a.j = {n} THEN 1 / p.v WHEN a.i = {n} THEN a.v / p.v
            WHEN a.j = {n} THEN -a.v / p.v ELSE a.v - l.v * r.v / p.v END AS v
            FROM {last} a {at("p", n, n)} {at("l", "a.i", n)} {at("r", n, "a.j")}"""
        last = f"swept{n + 1}"
    return out


def products(src: str, columns: list[str], by: str = "") -> str:
    """The matrix (i, j, v) of sums of products of the columns."""
    keep, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(f"SELECT {keep}{i} AS i, {j} AS j, CAST(sum({a} * {b}) AS DOUBLE) AS v FROM {src}{group}"
                              for i, a in enumerate(columns) for j, b in enumerate(columns))


def student_p(src: str, key: str) -> dict[str, str]:
    """CTEs whose last, ``p_values`` (key, p), has the two-sided p value of Student's t from ``src`` (key, t, dof),
    by the finite series for whole degrees of freedom."""
    return {
        "angles": f"SELECT {key}, dof, atan(abs(t) / sqrt(dof)) AS a FROM {src}",
        f"series({key}, dof, a, j, part, total)": f"""
            SELECT {key}, dof, a, 1, CASE WHEN dof % 2 = 1 THEN cos(a) ELSE 1.0 END, CASE WHEN dof = 1 THEN 0.0 WHEN dof % 2 = 1 THEN cos(a) ELSE 1.0 END FROM angles
            UNION ALL
            SELECT {key}, dof, a, j + 1, part * f, total + part * f FROM (
              SELECT *, cos(a) * cos(a) * CASE WHEN dof % 2 = 1 THEN 2.0 * j / (2 * j + 1) ELSE (2.0 * j - 1) / (2 * j) END AS f FROM series)
            WHERE j < CASE WHEN dof % 2 = 1 THEN (dof - 1) // 2 ELSE dof // 2 END""",
        "p_values": f"""SELECT {key}, 1 - CASE WHEN any_value(dof) % 2 = 1 THEN 2 / pi() * (any_value(a) + sin(any_value(a)) * arg_max(total, j))
                               ELSE sin(any_value(a)) * arg_max(total, j) END AS p FROM series GROUP BY {key}""",
    }


VIEWS = {
    "risk_panel": f"""
        SELECT l_suppkey AS grid, CAST(l_shipdate AS DATE) AS date,
               SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS exposure,
               CAST(COUNT(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 END) AS BIGINT) AS accident,
               {scaled_mean('l_discount')} AS f_discount, {scaled_mean('l_tax')} AS f_tax, {scaled_mean('l_extendedprice')} AS f_price
        FROM lineitem GROUP BY 1, 2""",
    "count_panel": """
        SELECT c.c_nationkey AS site, CAST(o.o_orderdate AS DATE) AS date,
               CAST(COUNT(*) AS BIGINT) AS daily_count, SUM(o.o_totalprice) AS price
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    "gappy_panel": """
        SELECT site, date, daily_count,
               CASE WHEN day(date) % 5 = 0 THEN NULL ELSE price END AS price
        FROM count_panel""",
    "dirty_parts": """
        SELECT p_partkey, p_brand, p_type, p_size, p_retailprice,
               CASE WHEN p_type = 'SMALL' THEN 'none' ELSE p_type END AS p_kind,
               CAST(p_size AS VARCHAR) AS p_size_text
        FROM part""",
    "order_levels": """
        SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders""",
    "points": """
        SELECT c_custkey AS station_id, c_name AS name, c_mktsegment AS segment,
               CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon,
               CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat
        FROM customer""",
    "event_days": """
        SELECT user_id, CAST(ts AS DATE) AS date, CAST(COUNT(*) AS BIGINT) AS n_events,
               SUM(value) AS value_sum,
               CAST(COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS n_errors
        FROM events GROUP BY 1, 2""",
}

# views that read other views
_DEPENDS = {"gappy_panel": ("count_panel",)}


def with_views(body: str, *names: str, extra: dict | None = None) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v})")
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
