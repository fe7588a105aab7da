"""The same queries as plain SQL, to compare results against another engine."""

from __future__ import annotations

# Named parts: (names it needs, body). A query lists the parts it reads from.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "areas": (
        (),
        "SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "lines": (
        ("areas",),
        """SELECT l_partkey, s_nationkey, n_regionkey, CAST(l_shipdate AS DATE) AS sale_date,
                  (1 - l_discount) * (1 + l_tax) * (1 + l_quantity / 50)
                    * exp(0.04 * (year(l_shipdate) - 1994)) AS factor, l_returnflag, l_linestatus
           FROM lineitem JOIN areas ON l_suppkey = s_suppkey""",
    ),
    "brands": ((), "SELECT p_partkey, p_retailprice, CAST(substr(p_brand, 7) AS INT) AS brand FROM part"),
    "placed": (
        ("lines", "brands"),
        """SELECT lines.*, p_retailprice, brand,
                  lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(s_nationkey AS VARCHAR), 3, '0')
                    || lpad(CAST(brand AS VARCHAR), 6, '0') AS tract_id,
                  CAST(10000 + s_nationkey * 20 AS VARCHAR) AS cbsa_id
           FROM lines JOIN brands ON l_partkey = p_partkey""",
    ),
    "sales": (
        ("placed",),
        """SELECT CAST(l_partkey AS VARCHAR) || '-' || CAST(s_nationkey AS VARCHAR) AS property_id, tract_id, cbsa_id,
                  sale_date, round(100 * p_retailprice * avg(factor), 2) AS sale_price
           FROM placed GROUP BY l_partkey, s_nationkey, tract_id, cbsa_id, sale_date, p_retailprice""",
    ),
    "pairs": (
        ("sales",),
        """SELECT * FROM (
             SELECT property_id, tract_id, cbsa_id, sale_date AS first_sale_date, sale_price AS first_sale_price,
                    lead(sale_date) OVER w AS second_sale_date, lead(sale_price) OVER w AS second_sale_price
             FROM sales WINDOW w AS (PARTITION BY property_id ORDER BY sale_date))
           WHERE second_sale_date IS NOT NULL""",
    ),
    "measured": (
        ("pairs",),
        """SELECT *, CAST((year(second_sale_date) - year(first_sale_date)) * 12
                    + month(second_sale_date) - month(first_sale_date) AS INT) AS time_diff_months,
                  second_sale_price / first_sale_price AS appreciation_ratio,
                  date_diff('day', first_sale_date, second_sale_date) / 365.25 AS time_diff_years
           FROM pairs""",
    ),
    "grown": (
        ("measured",),
        """SELECT *, CASE WHEN time_diff_years > 0
                    THEN pow(appreciation_ratio, 1 / time_diff_years) - 1 ELSE 0.0 END AS cagr FROM measured""",
    ),
    "flagged": (
        ("grown",),
        """SELECT *, abs(time_diff_months) >= 12 AS valid_time_diff, abs(cagr) <= 0.30 AS valid_cagr,
                  appreciation_ratio <= 10.0 AND appreciation_ratio >= 0.75 AS valid_appreciation,
                  first_sale_price > 0 AND second_sale_price > 0 AS valid_prices,
                  second_sale_date > first_sale_date AS valid_dates
           FROM grown""",
    ),
    "validated": (
        ("flagged",),
        """SELECT *, valid_time_diff AND valid_cagr AND valid_appreciation AND valid_prices AND valid_dates AS is_valid,
                  CASE WHEN NOT valid_dates THEN 'Invalid date order' WHEN NOT valid_prices THEN 'Invalid prices'
                       WHEN NOT valid_appreciation THEN 'Appreciation out of bounds'
                       WHEN NOT valid_cagr THEN 'CAGR exceeds ±30%'
                       WHEN NOT valid_time_diff THEN 'Same 12-month period' ELSE '' END AS rejection_reason
           FROM flagged""",
    ),
    "valid": (("validated",), "SELECT * FROM validated WHERE is_valid"),
    "screened": (
        ("pairs",),
        """SELECT *, CASE WHEN years_diff > 0 THEN pow(appreciation, 1 / years_diff) - 1 ELSE 0.0 END AS cagr FROM (
             SELECT *, date_diff('day', first_sale_date, second_sale_date) / 30.44 AS months_diff,
                    date_diff('day', first_sale_date, second_sale_date) / 30.44 / 12 AS years_diff,
                    second_sale_price / first_sale_price AS appreciation FROM pairs)""",
    ),
    "market": (
        ("sales",),
        """SELECT cbsa_id, year, level / first_value(level) OVER w AS index_value,
                  coalesce(level / lag(level) OVER w - 1, 0.0) AS annual_return
           FROM (SELECT cbsa_id, CAST(year(sale_date) AS INT) AS year, avg(sale_price) AS level FROM sales GROUP BY ALL)
           WINDOW w AS (PARTITION BY cbsa_id ORDER BY year)""",
    ),
    "touched": (
        ("valid",),
        """SELECT tract_id, CAST(year(first_sale_date) AS INT) AS y1, CAST(year(second_sale_date) AS INT) AS y2 FROM valid""",
    ),
    "half": (
        ("touched",),
        """SELECT tract_id, year, CAST(2 * count(*) AS BIGINT) AS half_pairs FROM (
             SELECT tract_id, y1 AS year FROM touched UNION ALL SELECT tract_id, y2 FROM touched WHERE y2 <> y1)
           GROUP BY tract_id, year""",
    ),
    "tracts": (
        ("placed",),
        """SELECT tract_id, cbsa_id, substr(tract_id, 1, 2) AS state, substr(tract_id, 3, 3) AS county,
                  CAST(s_nationkey * 10 AS DOUBLE) AS centroid_x, CAST(brand AS DOUBLE) AS centroid_y,
                  count(*) AS population, round(1.0 + brand / 100, 6) AS area_sqmi
           FROM placed GROUP BY ALL""",
    ),
    "yearly": (
        ("placed",),
        """SELECT tract_id, cbsa_id, CAST(year(sale_date) AS INT) AS year, count(DISTINCT l_partkey) AS units,
                  sum(100 * p_retailprice * factor) AS price, count(*) AS n,
                  count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o
           FROM placed GROUP BY ALL""",
    ),
    "demographics": (
        ("yearly",),
        """SELECT tract_id, cbsa_id, year, CAST(units AS INT) AS housing_units, round(price / n, 2) AS median_value,
                  round(r / n, 6) AS college_share, round(o / n, 6) AS non_white_share, round(price, 2) AS upb_total
           FROM yearly""",
    ),
    "raw": (
        ("demographics",),
        """SELECT tract_id, cbsa_id, year AS period, t.weight_type, CASE t.weight_type
                    WHEN 'sample' THEN 1.0 WHEN 'value' THEN housing_units * median_value
                    WHEN 'unit' THEN housing_units WHEN 'upb' THEN upb_total
                    WHEN 'college' THEN college_share ELSE non_white_share END AS raw
           FROM demographics, (SELECT unnest(['sample', 'value', 'unit', 'upb', 'college', 'non_white']) AS weight_type) t""",
    ),
    "shares": (
        ("raw",),
        """SELECT geography_id, period, weight_type, tract_id, weight / total AS weight FROM (
             SELECT *, sum(weight) OVER (PARTITION BY geography_id, period, weight_type) AS total FROM (
               SELECT cbsa_id AS geography_id, period, weight_type, tract_id, raw AS weight FROM raw
               UNION ALL SELECT 'national', period, weight_type, tract_id, raw FROM raw))
           WHERE total > 0""",
    ),
    "area_value": (("shares",), "SELECT * FROM shares WHERE weight_type = 'value' AND geography_id <> 'national'"),
    "enough": (("half",), "SELECT DISTINCT tract_id FROM half WHERE half_pairs >= 40"),
    "levels": (
        ("valid",),
        """SELECT tract_id, CAST(date_trunc('month', second_sale_date) AS DATE) AS date,
                  round(100 * avg(second_sale_price / first_sale_price), 4) AS index_value
           FROM valid GROUP BY ALL""",
    ),
    "area_levels": (
        ("valid",),
        """SELECT cbsa_id AS geography_id, CAST(date_trunc('month', second_sale_date) AS DATE) AS date,
                  round(100 * avg(second_sale_price / first_sale_price), 4) AS index_value,
                  CAST(year(second_sale_date) AS INT) AS year
           FROM valid GROUP BY ALL""",
    ),
    "changes": (
        ("valid",),
        """SELECT tract_id, CAST(date_trunc('year', second_sale_date) AS DATE) AS date,
                  round(avg(ln(second_sale_price) - ln(first_sale_price)), 6) AS change
           FROM valid GROUP BY ALL""",
    ),
    "months": (
        ("valid",),
        """SELECT *, CAST(year(first_sale_date) * 12 + month(first_sale_date) - 1 AS INT) AS f,
                  CAST(year(second_sale_date) * 12 + month(second_sale_date) - 1 AS INT) AS s,
                  ln(second_sale_price) - ln(first_sale_price) AS y FROM valid""",
    ),
    "outlying": (
        ("grown",),
        """SELECT *, time_diff_years > 0 AND abs(cagr) > 0.5 AS is_cagr, time_diff_years > 30 AS is_time_gap FROM grown""",
    ),
    "nation_base": (
        ("shares", "levels"),
        """SELECT tract_id, weight FROM shares WHERE weight_type = 'value' AND geography_id = 'national'
             AND period = (SELECT arg_min(period, abs(period - y) * 10000 + period)
                           FROM (SELECT DISTINCT period FROM shares WHERE weight_type = 'value'),
                                (SELECT year(min(date)) AS y FROM levels))""",
    ),
    # A fixed-weight index of any level: members, their series and their base weights.
    "area_members": (("levels", "tracts"), "SELECT cbsa_id AS geography_id, levels.* FROM levels JOIN tracts USING (tract_id)"),
    "area_spans": (
        ("area_members",),
        "SELECT geography_id, year(min(date)) AS base_year, count(DISTINCT date) AS dates FROM area_members GROUP BY 1",
    ),
    "area_base": (
        ("area_value", "area_spans"),
        """SELECT v.geography_id, v.tract_id, v.weight FROM area_value v JOIN (
             SELECT geography_id, arg_min(period, abs(period - base_year) * 10000 + period) AS period
             FROM (SELECT DISTINCT geography_id, period FROM area_value) JOIN area_spans USING (geography_id)
             GROUP BY geography_id) USING (geography_id, period)""",
    ),
    "area_laspeyres": (
        ("area_base", "area_members"),
        """SELECT geography_id, date, sum(weight * index_value) / sum(weight) AS index_value, sum(weight) AS coverage,
                  any_value(tracts) - count(*) AS missing_tracts
           FROM area_members JOIN area_base USING (geography_id, tract_id)
           JOIN (SELECT geography_id, count(*) AS tracts FROM area_base GROUP BY 1) USING (geography_id)
           GROUP BY geography_id, date""",
    ),
}


def _hierarchy_step(child: str, parent: str, below: str, base: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Parts for one step up: weights of children in parents, and the parents' series."""
    key = f"'{base}'" if parent == "nation" else parent
    return {
        f"{parent}_child_weights": (
            ("raw", "tracts"),
            f"""SELECT geography_id, period, child, w / sum(w) OVER (PARTITION BY geography_id, period) AS weight FROM (
                  SELECT {key} AS geography_id, period, t.{child} AS child, sum(raw) AS w
                  FROM (SELECT tract_id AS member, period, weight_type, raw FROM raw) r
                  JOIN (SELECT tract_id, cbsa_id, state FROM tracts) t ON r.member = t.tract_id
                  WHERE weight_type = 'value' GROUP BY ALL)""",
        ),
        f"{parent}_series": (
            (below, "tracts", f"{parent}_child_weights"),
            f"""SELECT geography_id, date, sum(weight * index_value) / sum(weight) AS index_value FROM (
                  SELECT DISTINCT {key} AS geography_id, b.geography_id AS child, date, index_value
                  FROM {below} b JOIN (SELECT DISTINCT tract_id, cbsa_id, state FROM tracts) t ON b.geography_id = t.{child})
                JOIN (SELECT w.* FROM {parent}_child_weights w JOIN (
                  SELECT geography_id, arg_min(period, abs(period - base_year) * 10000 + period) AS period
                  FROM (SELECT DISTINCT geography_id, period FROM {parent}_child_weights)
                  JOIN (SELECT {key} AS geography_id, year(min(date)) AS base_year
                        FROM {below} b JOIN (SELECT DISTINCT tract_id, cbsa_id, state FROM tracts) t
                          ON b.geography_id = t.{child} GROUP BY 1)
                  USING (geography_id) GROUP BY geography_id) USING (geography_id, period)) USING (geography_id, child)
                GROUP BY geography_id, date""",
        ),
    }


PARTS["tract_series"] = (("levels",), "SELECT tract_id AS geography_id, date, index_value FROM levels")
PARTS.update(_hierarchy_step("tract_id", "cbsa_id", "tract_series", ""))
PARTS.update(_hierarchy_step("cbsa_id", "state", "cbsa_id_series", ""))
PARTS.update(_hierarchy_step("state", "nation", "state_series", "USA"))



def _least_squares(name: str, period: str, source: str = "months") -> dict[str, tuple[tuple[str, ...], str]]:
    """Repeat-sales fit per area by Gauss-Jordan on (normal matrix, moments, identity).

    Columns f and s of months, or their years, are the periods; the first one of an area is
    the base. A period without pairs is a row of zeros and keeps its zero coefficient.
    """
    return {
        f"{name}_rows": (
            (source,),
            f"""SELECT *, {period.format("f")} - o AS i, {period.format("s")} - o AS j FROM (
                  SELECT *, min(least({period.format("f")}, {period.format("s")})) OVER (PARTITION BY cbsa_id) AS o FROM {source})""",
        ),
        f"{name}_size": (
            (f"{name}_rows",),
            f"""SELECT cbsa_id, min(o) AS o, CAST(max(greatest(i, j)) AS INT) AS n, count(*) AS pairs FROM {name}_rows GROUP BY 1""",
        ),
        f"{name}_entries": (
            (f"{name}_rows",),
            f"""SELECT cbsa_id, r, c, sum(v) AS v FROM (
                  SELECT cbsa_id, unnest([i, j, i, j]) AS r, unnest([i, j, j, i]) AS c, unnest([1.0, 1.0, -1.0, -1.0]::DOUBLE[]) AS v
                  FROM {name}_rows) GROUP BY ALL""",
        ),
        f"{name}_moments": (
            (f"{name}_rows",),
            f"""SELECT cbsa_id, r, sum(v) AS v FROM (
                  SELECT cbsa_id, unnest([i, j]) AS r, unnest([-y, y]) AS v FROM {name}_rows) GROUP BY ALL""",
        ),
        f"{name}_matrix": (
            (f"{name}_size", f"{name}_entries", f"{name}_moments"),
            f"""SELECT cbsa_id, n, list(line ORDER BY r) AS m FROM (
                  SELECT cbsa_id, n, r, list_concat(list(coalesce(e.v, 0.0::DOUBLE) ORDER BY c), [coalesce(any_value(b.v), 0.0::DOUBLE)],
                           list_transform(range(1, n + 1), lambda x: CASE WHEN x = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS line
                  FROM (SELECT cbsa_id, n, r, unnest(range(1, n + 1)) AS c FROM (
                          SELECT cbsa_id, n, unnest(range(1, n + 1)) AS r FROM {name}_size))
                  LEFT JOIN {name}_entries e USING (cbsa_id, r, c) LEFT JOIN {name}_moments b USING (cbsa_id, r)
                  GROUP BY cbsa_id, n, r) GROUP BY ALL""",
        ),
        # Standard errors come from the matrix with the fit's ridge on its diagonal.
        f"{name}_ridged_matrix": (
            (f"{name}_matrix",),
            f"""SELECT cbsa_id, n, list_transform(m, lambda line, pos: list_transform(line, lambda x, col: x + CASE WHEN col = pos THEN 1e-10 ELSE 0 END)) AS m
                FROM {name}_matrix""",
        ),
        f"{name}_ridged_reduced": (
            (f"{name}_ridged_matrix",),
            f"""SELECT cbsa_id, n, 1 AS k, m FROM {name}_ridged_matrix
                UNION ALL SELECT cbsa_id, n, k + 1, list_transform(m, lambda line, pos: CASE WHEN pos = k
                    THEN list_transform(line, lambda x: x / m[k][k])
                    ELSE list_transform(list_zip(line, m[k]), lambda z: z[1] - line[k] / m[k][k] * z[2]) END)
                FROM {name}_ridged_reduced WHERE k <= n""",
        ),
        f"{name}_reached_reduced": (
            (f"{name}_entries", f"{name}_size"),
            f"""SELECT cbsa_id, idx AS node, idx AS other FROM (SELECT cbsa_id, unnest(range(0, n + 1)) AS idx FROM {name}_size)
                UNION SELECT g.cbsa_id, g.node, e.c FROM {name}_reached_reduced g JOIN {name}_entries e ON e.cbsa_id = g.cbsa_id AND e.r = g.other""",
        ),
        f"{name}_labels": (
            (f"{name}_reached_reduced",),
            f"""SELECT cbsa_id, node AS idx, min(other) AS label FROM {name}_reached_reduced GROUP BY ALL""",
        ),
        f"{name}_reduced": (
            (f"{name}_matrix",),
            f"""SELECT cbsa_id, n, 1 AS k, m FROM {name}_matrix
                UNION ALL SELECT cbsa_id, n, k + 1, CASE WHEN abs(m[k][k]) < 1e-9 THEN m ELSE
                  list_transform(m, lambda line, pos: CASE WHEN pos = k THEN list_transform(line, lambda x: x / m[k][k])
                    ELSE list_transform(list_zip(line, m[k]), lambda z: z[1] - line[k] / m[k][k] * z[2]) END) END
                FROM {name}_reduced WHERE k <= n""",
        ),
        f"{name}_solved": (
            (f"{name}_reduced", f"{name}_ridged_reduced", f"{name}_labels", f"{name}_size"),
            f"""SELECT cbsa_id, idx, label, beta - CASE WHEN label = 0 THEN 0 ELSE avg(beta) OVER (PARTITION BY cbsa_id, label) END AS beta,
                  inverse, label = 0 AS identified
                FROM (SELECT cbsa_id, 0 AS idx, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS inverse FROM {name}_size
                  UNION ALL SELECT cbsa_id, idx, CASE WHEN abs(d.m[idx][idx]) < 1e-9 THEN 0 ELSE d.m[idx][n + 1] END, i.m[idx][n + 1 + idx]
                  FROM (SELECT *, unnest(range(1, n + 1)) AS idx FROM {name}_reduced WHERE k = n + 1) d
                  JOIN (SELECT cbsa_id, m FROM {name}_ridged_reduced WHERE k = n + 1) i USING (cbsa_id))
                JOIN {name}_labels USING (cbsa_id, idx)""",
        ),
        f"{name}_errors": (
            (f"{name}_rows", f"{name}_solved"),
            f"""SELECT r.*, y - (b.beta - a.beta) AS residual FROM {name}_rows r
                JOIN {name}_solved a ON a.cbsa_id = r.cbsa_id AND a.idx = i JOIN {name}_solved b ON b.cbsa_id = r.cbsa_id AND b.idx = j""",
        ),
        f"{name}_fit": (
            (f"{name}_errors", f"{name}_size"),
            f"""SELECT cbsa_id, min(n) AS n, min(z.o) AS o, count(*) AS pairs, sum(residual * residual) AS rss, var_pop(y) * count(*) AS tss
                FROM {name}_errors JOIN {name}_size z USING (cbsa_id) GROUP BY 1""",
        ),
    }


# Weight of a scaled residual u.
WEIGHTS = {
    "huber": "CASE WHEN abs(u) <= 1.345 THEN 1.0 ELSE 1.345 / abs(u) END",
    "bisquare": "CASE WHEN abs(u) <= 4.685 THEN pow(1 - pow(u / 4.685, 2), 2) ELSE 0.0 END",
    "cauchy": "1 / (1 + pow(u / 2.385, 2))",
    "welsch": "exp(-pow(u / 2.985, 2))",
}
# Rounds that are written out; a group that has settled keeps its coefficients.
ROUNDS = 50


def _eliminated(name: str, identity: bool, size: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Gauss-Jordan on the weighted normal equations of {name}_weighted, with the identity for an inverse."""
    unit = ", list_transform(range(1, n + 1), lambda x: CASE WHEN x = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" if identity else ""
    return {
        f"{name}_matrix": (
            (f"{name}_weighted", size),
            f"""SELECT cbsa_id, n, list(line ORDER BY r) AS m FROM (
                  SELECT cbsa_id, n, r, list_concat(list(coalesce(e.v, 0.0::DOUBLE) ORDER BY c), [coalesce(any_value(b.v), 0.0::DOUBLE)]{unit}) AS line
                  FROM (SELECT cbsa_id, n, r, unnest(range(1, n + 1)) AS c FROM (
                          SELECT cbsa_id, n, unnest(range(1, n + 1)) AS r FROM {size} SEMI JOIN {name}_weighted USING (cbsa_id)))
                  LEFT JOIN (SELECT cbsa_id, r, c, sum(v) AS v FROM (
                    SELECT cbsa_id, unnest([i, j, i, j]) AS r, unnest([i, j, j, i]) AS c, unnest([w, w, -w, -w]) AS v
                    FROM {name}_weighted) GROUP BY ALL) e USING (cbsa_id, r, c)
                  LEFT JOIN (SELECT cbsa_id, r, sum(v) AS v FROM (
                    SELECT cbsa_id, unnest([i, j]) AS r, unnest([-w * y, w * y]) AS v FROM {name}_weighted) GROUP BY ALL) b USING (cbsa_id, r)
                  GROUP BY cbsa_id, n, r) GROUP BY ALL""",
        ),
        f"{name}_reduced": (
            (f"{name}_matrix",),
            f"""SELECT cbsa_id, n, 1 AS k, m FROM {name}_matrix
                UNION ALL SELECT cbsa_id, n, k + 1, CASE WHEN abs(m[k][k]) < 1e-13 THEN m ELSE
                  list_transform(m, lambda line, pos: CASE WHEN pos = k THEN list_transform(line, lambda x: x / m[k][k])
                    ELSE list_transform(list_zip(line, m[k]), lambda z: z[1] - line[k] / m[k][k] * z[2]) END) END
                FROM {name}_reduced WHERE k <= n""",
        ),
    }


def _weighted(name: str, base: str, state: str, weight: str, active: str) -> tuple[tuple[str, ...], str]:
    """Pairs with their residual, scale and weight at the coefficients that column old of the state holds."""
    return (
        (f"{base}_rows", state),
        f"""SELECT * EXCLUDE (u), CASE WHEN scale > 1e-10 THEN {weight} ELSE 1.0 END AS w FROM (
              SELECT *, e / scale AS u FROM (
                SELECT *, 1.4826 * median(abs(e - middle)) OVER (PARTITION BY cbsa_id) AS scale FROM (
                  SELECT *, median(e) OVER (PARTITION BY cbsa_id) AS middle FROM (
                    SELECT r.*, y - (b.{active} - a.{active}) AS e FROM {base}_rows r
                    JOIN {state} a ON a.cbsa_id = r.cbsa_id AND a.idx = i AND {"NOT a.done" if active == "new" else "true"}
                    JOIN {state} b ON b.cbsa_id = r.cbsa_id AND b.idx = j))))""",
    )


def _reweighted(name: str, base: str, method: str, rounds: int = ROUNDS) -> dict[str, tuple[tuple[str, ...], str]]:
    """M-estimate on top of the least-squares parts named by base: one block of parts a round."""
    weight = WEIGHTS[method]
    parts = {f"{name}_state0": ((f"{base}_solved",), f"SELECT cbsa_id, idx, beta AS old, beta AS new, false AS done FROM {base}_solved")}
    for r in range(1, rounds + 1):
        now, before = f"{name}_{r}", f"{name}_state{r - 1}"
        parts[f"{now}_weighted"] = _weighted(now, base, before, weight, "new")
        parts.update(_eliminated(now, False, f"{base}_size"))
        parts[f"{name}_state{r}"] = (
            (f"{now}_reduced", before, f"{base}_labels"),
            f"""SELECT cbsa_id, idx, CASE WHEN done THEN old ELSE new END AS old, CASE WHEN done THEN new ELSE beta END AS new,
                  done OR max(abs(beta - new)) OVER (PARTITION BY cbsa_id) < 1e-4 AS done FROM (
                  SELECT s.*, beta - CASE WHEN label = 0 THEN 0 ELSE avg(beta) OVER (PARTITION BY s.cbsa_id, label) END AS beta
                  FROM {before} s LEFT JOIN (
                    SELECT cbsa_id, 0 AS idx, 0.0::DOUBLE AS beta FROM {now}_matrix
                    UNION ALL SELECT cbsa_id, idx, CASE WHEN abs(m[idx][idx]) < 1e-13 THEN 0 ELSE m[idx][n + 1] END
                    FROM (SELECT *, unnest(range(1, n + 1)) AS idx FROM {now}_reduced WHERE k = n + 1)) d USING (cbsa_id, idx)
                  JOIN {base}_labels USING (cbsa_id, idx))""",
        )
    last = f"{name}_state{rounds}"
    parts[f"{name}_weighted"] = _weighted(name, base, last, weight, "old")
    parts.update(_eliminated(name, True, f"{base}_size"))
    parts[f"{name}_errors"] = (
        (f"{name}_weighted", last),
        f"""SELECT r.*, y - (b.new - a.new) AS residual FROM {name}_weighted r
            JOIN {last} a ON a.cbsa_id = r.cbsa_id AND a.idx = i JOIN {last} b ON b.cbsa_id = r.cbsa_id AND b.idx = j""",
    )
    parts[f"{name}_fit"] = (
        (f"{name}_errors", f"{base}_size"),
        f"""SELECT cbsa_id, min(n) AS n, min(z.o) AS o, count(*) AS pairs, sum(w * residual * residual) AS rss
            FROM {name}_errors JOIN {base}_size z USING (cbsa_id) GROUP BY 1""",
    )
    parts[f"{name}_solved"] = (
        (last, f"{name}_reduced", f"{name}_matrix", f"{name}_fit", f"{base}_labels"),
        f"""SELECT cbsa_id, idx, new AS beta, label = 0 AS identified, CASE WHEN idx = 0 THEN 0.0
              WHEN max(label) OVER (PARTITION BY cbsa_id) = 0 THEN sqrt(inverse * variance) WHEN degree > 0 THEN variance / sqrt(degree) END AS error
            FROM {last} JOIN {base}_labels USING (cbsa_id, idx)
            JOIN (SELECT cbsa_id, CASE WHEN pairs > n THEN rss / (pairs - n) END AS variance FROM {name}_fit) USING (cbsa_id)
            LEFT JOIN (
              SELECT cbsa_id, idx, i.m[idx][n + 1 + idx] AS inverse, a.m[idx][idx] AS degree
              FROM (SELECT *, unnest(range(1, n + 1)) AS idx FROM {name}_reduced WHERE k = n + 1) i
              JOIN (SELECT cbsa_id, m FROM {name}_matrix) a USING (cbsa_id)) USING (cbsa_id, idx)""",
    )
    return parts


MONTH = "make_date(CAST((o + idx) // 12 AS BIGINT), CAST((o + idx) % 12 + 1 AS BIGINT), 1)"


def _robust_levels(name: str) -> tuple[tuple[str, ...], str]:
    return (
        (f"{name}_solved", f"{name}_fit"),
        f"""SELECT cbsa_id, CAST(idx AS INT) AS period_idx, {MONTH} AS date, round(100 * exp(beta), 6) AS index_value,
             round(beta, 6) + 0.0 AS log_return, round(error, 6) AS standard_error, identified
           FROM {name}_solved JOIN {name}_fit USING (cbsa_id)""",
    )


def _index_levels(name: str, date: str) -> tuple[tuple[str, ...], str]:
    return (
        (f"{name}_solved", f"{name}_fit"),
        f"""SELECT cbsa_id, CAST(idx AS INT) AS period_idx, {date} AS date, round(100 * exp(beta), 6) AS index_value,
             round(beta, 6) + 0.0 AS log_return,
             CASE WHEN idx = 0 THEN 0.0 WHEN pairs > n THEN round(sqrt(inverse * rss / (pairs - n)), 6) END AS standard_error,
             identified FROM {name}_solved JOIN {name}_fit USING (cbsa_id)""",
    )


def _diagnosed(fit: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Leverage, studentised residual and Cook's distance of every pair, and the five tests."""
    return {
        "leverages": (
            (f"{fit}_errors", f"{fit}_fit", f"{fit}_reduced", f"{fit}_labels"),
            f"""SELECT *, CASE WHEN pairs > n THEN rss / (pairs - n) END AS mse, CASE WHEN pieces = 1 THEN
                    CASE WHEN j = 0 THEN 0 ELSE m[j][n + 1 + j] END + CASE WHEN i = 0 THEN 0 ELSE m[i][n + 1 + i] END
                    - 2 * CASE WHEN i = 0 OR j = 0 THEN 0 ELSE m[i][n + 1 + j] END END AS leverage
                FROM {fit}_errors e JOIN (SELECT cbsa_id, n, pairs, rss FROM {fit}_fit) USING (cbsa_id)
                JOIN (SELECT cbsa_id, m FROM {fit}_reduced WHERE k = n + 1) USING (cbsa_id)
                JOIN (SELECT cbsa_id, count(DISTINCT label) AS pieces FROM {fit}_labels GROUP BY 1) USING (cbsa_id)""",
        ),
        "diagnosed": (
            ("leverages",),
            """SELECT *, residual / (sqrt(mse) + 1e-8) AS studentized,
                 pow(residual / (sqrt(greatest(mse * (1 - leverage), 0)) + 1e-8), 2) * leverage / (n * (1 - leverage + 1e-8)) AS cooks_distance,
                 date_diff('day', first_sale_date, second_sale_date) / 365.25 AS years FROM leverages""",
        ),
        "regression_tests": (
            ("diagnosed",),
            """SELECT *, coalesce(years > 0 AND abs(pow(second_sale_price / first_sale_price, 1 / years) - 1) > 0.5, false) AS is_cagr,
                 years > 30 AS is_time_gap, coalesce(cooks_distance > greatest(4.0 / pairs, 4 * avg(cooks_distance) OVER w), false) AS is_cooks,
                 coalesce(abs(studentized) > 3, false) AS is_residual, coalesce(leverage > 3.0 * n / pairs, false) AS is_leverage
               FROM diagnosed WINDOW w AS (PARTITION BY cbsa_id
                 ORDER BY first_sale_date, property_id, second_sale_date, second_sale_price ROWS UNBOUNDED PRECEDING)""",
        ),
    }


PARTS.update(_diagnosed("ols_month"))
PARTS.update(_least_squares("ols_month", "{}"))
PARTS.update(_least_squares("ols_year", "({} // 12)"))
# The other two methods let weights fall to nearly nothing. Where such a pair alone links a month, rounding
# decides its coefficient, and results repeat on no engine to six digits; they have no twin here.
for _method in ("huber", "cauchy"):
    PARTS.update(_reweighted(f"by_{_method}", "ols_month", _method))

# Yearly regressions of the tracts with ten pairs or more, a tract in the place of an area.
PARTS["tract_months"] = (
    ("months",),
    """SELECT * REPLACE (tract_id AS cbsa_id) FROM months
       WHERE tract_id IN (SELECT tract_id FROM months GROUP BY 1 HAVING count(*) >= 10)""",
)
PARTS.update(_least_squares("tract_year", "({} // 12)", "tract_months"))
PARTS["fit_members"] = (
    ("tract_year_solved", "tract_year_fit", "tracts"),
    """SELECT t.cbsa_id AS geography_id, t.tract_id, make_date(CAST(o + idx AS BIGINT), 1, 1) AS date, 100 * exp(beta) AS x,
              CASE WHEN NOT identified THEN NULL WHEN idx = 0 THEN 0.0
                   WHEN pairs > n THEN 100 * exp(beta) * sqrt(inverse * rss / (pairs - n)) END AS e
       FROM tract_year_solved s JOIN tract_year_fit f USING (cbsa_id) JOIN tracts t ON t.tract_id = s.cbsa_id""",
)
PARTS["fit_base"] = (
    ("fit_members", "area_value"),
    """SELECT v.geography_id, v.tract_id, v.weight FROM area_value v JOIN (
         SELECT geography_id, arg_min(period, abs(period - base_year) * 10000 + period) AS period
         FROM (SELECT DISTINCT geography_id, period FROM area_value)
         JOIN (SELECT geography_id, year(min(date)) AS base_year FROM fit_members GROUP BY 1) USING (geography_id)
         GROUP BY geography_id) USING (geography_id, period)""",
)

# Scenarios of the sensitivity analysis: every variant of the pairs is a group of its own.
PARTS["spaced_months"] = (
    ("grown",),
    """SELECT *, CAST(year(first_sale_date) * 12 + month(first_sale_date) - 1 AS INT) AS f,
              CAST(year(second_sale_date) * 12 + month(second_sale_date) - 1 AS INT) AS s,
              ln(second_sale_price) - ln(first_sale_price) AS y FROM grown
       WHERE abs(time_diff_months) >= 12 AND first_sale_price > 0 AND second_sale_price > 0 AND second_sale_date > first_sale_date""",
)
PARTS["variant_months"] = (
    ("spaced_months",),
    """SELECT * REPLACE (v.name AS cbsa_id) FROM spaced_months, (SELECT max(second_sale_date) AS last FROM spaced_months),
         (SELECT unnest(['all', 'without_outliers', 'years_3', 'years_5', 'years_10', 'cagr', 'price']) AS name) v
       WHERE CASE v.name WHEN 'all' THEN true
         WHEN 'without_outliers' THEN NOT (time_diff_years > 0 AND abs(cagr) > 0.5) AND NOT time_diff_years > 30
         WHEN 'years_3' THEN second_sale_date >= last - INTERVAL 36 MONTH WHEN 'years_5' THEN second_sale_date >= last - INTERVAL 60 MONTH
         WHEN 'years_10' THEN second_sale_date >= last - INTERVAL 120 MONTH
         WHEN 'cagr' THEN abs(cagr) <= 0.3 ELSE least(first_sale_price, second_sale_price) >= 50000 END""",
)
PARTS["pool_months"] = (("variant_months",), "SELECT * FROM variant_months WHERE cbsa_id = 'all'")
PARTS.update(_least_squares("variant", "{}", "variant_months"))
PARTS.update(_least_squares("pool", "{}", "pool_months"))
for _method in ("huber", "bisquare", "cauchy"):
    PARTS.update(_reweighted(f"pool_{_method}", "pool", _method))
_POOLED = " UNION ALL ".join(
    f"""SELECT 'robust_{m}' AS scenario, idx, o, beta, error, identified
        FROM pool_{m}_solved JOIN pool_{m}_fit USING (cbsa_id)"""
    for m in ("huber", "bisquare", "cauchy")
)
PARTS["scenario_series"] = (
    ("variant_solved", "variant_fit", *[f"pool_{m}_{p}" for m in ("huber", "bisquare", "cauchy") for p in ("solved", "fit")]),
    f"""SELECT scenario, idx, {MONTH} AS date, 100 * exp(beta) AS index_value, beta, error, identified FROM (
          SELECT scenario, idx, o, beta, CASE WHEN idx = 0 THEN 0.0 WHEN pairs > n THEN sqrt(inverse * rss / (pairs - n)) END AS error, identified
          FROM variant_solved JOIN variant_fit USING (cbsa_id) JOIN (VALUES ('all', 'base_case'), ('all', 'weight_sample'), ('all', 'weight_unit'),
            ('all', 'weight_upb'), ('years_3', 'time_window_3y'), ('years_5', 'time_window_5y'), ('years_10', 'time_window_10y'),
            ('cagr', 'strict_cagr_filter'), ('price', 'min_price_filter'), ('without_outliers', 'outlier_threshold_2.0'),
            ('without_outliers', 'outlier_threshold_3.0'), ('without_outliers', 'outlier_threshold_4.0'),
            ('without_outliers', 'outlier_threshold_5.0')) names(cbsa_id, scenario) USING (cbsa_id)
          UNION ALL {_POOLED})""",
)
PARTS["impacts"] = (
    ("scenario_series",),
    """SELECT scenario, avg(x - b) AS mean_difference, max(abs(x - b)) AS max_difference, avg((x - b) / b * 100) AS mean_pct_difference,
              max(abs((x - b) / b * 100)) AS max_pct_difference, sqrt(avg((x - b) * (x - b))) AS rmse, corr(b, x) AS correlation, count(*) AS num_periods
       FROM (SELECT s.scenario, s.index_value AS x, b.index_value AS b FROM scenario_series s
             JOIN scenario_series b ON b.scenario = 'base_case' AND b.date = s.date WHERE s.scenario <> 'base_case') GROUP BY 1""",
)

PAIR = "property_id, tract_id, cbsa_id, first_sale_date, first_sale_price, second_sale_date, second_sale_price"
SET = "geography_id, period, weight_type"
GROWTH = """round((ln(second_sale_price) - ln(first_sale_price)) / time_diff_years, 6) + 0.0 AS log_growth,
    printf('%.9e', cagr) AS cagr"""


def _moments(column: str, label: str) -> str:
    def q(share):
        return f"quantile_cont({column}, {share})"

    r = "round({}, 4) + 0.0 AS {}".format
    fields = [
        r(f"avg({column})", "mean"), r(f"stddev({column})", '"std"'), r(f"min({column})", '"min"'), r(f"max({column})", '"max"'),
        r(f"skewness({column})", "skewness"), r(f"kurtosis({column})", "kurtosis"), r(q(0.05), "p05"), r(q(0.25), "p25"),
        r(q(0.5), '"median"'), r(q(0.75), "p75"), r(q(0.95), "p95"), r(f"stddev({column}) / avg({column})", "cv"),
        r(f"{q(0.75)} - {q(0.25)}", "iqr"),
    ]
    return f"SELECT '{label}' AS sale_type, {', '.join(fields)} FROM pairs"


def _returns(steps: int) -> str:
    return f"""SELECT tract_id, date, round(r, 6) + 0.0 AS "return" FROM (
        SELECT tract_id, date, index_value / lag(index_value, {steps}) OVER (PARTITION BY tract_id ORDER BY date) - 1 AS r
        FROM levels) WHERE r IS NOT NULL"""


def _merged(strategy: str) -> str:
    weight = {"average": "avg(weight)", "sum": "sum(weight)", "first": "sum(weight) FILTER (weight_type = 'unit')"}[strategy]
    return f"""SELECT geography_id, period, 'merged' AS weight_type, tract_id,
        round(w / sum(w) OVER (PARTITION BY geography_id, period), 6) + 0.0 AS weight FROM (
        SELECT geography_id, period, tract_id, {weight} AS w FROM shares
        WHERE weight_type IN ('unit', 'upb') AND geography_id <> 'national' GROUP BY ALL)"""


def _metrics(source: str) -> str:
    return f"""SELECT event_type AS name, count(*) AS count, arg_max(value, ts) AS latest, round(sum(value), 6) AS total,
        min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
        FROM {source} GROUP BY event_type"""


_POOLED = """count(*) AS pair_count, {tracts} AS tract_count, round(sum(second_sale_price), 2) AS total_price,
    round(stddev(second_sale_price), 3) AS std_price, count(*) >= {least} AS has_sufficient_data,
    {rate} AS coverage_rate, round(stddev(second_sale_price) / avg(second_sale_price), 6) AS price_cv"""

# Query name: (parts it reads, final select).
SELECTS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales_by_property_day": (("sales",), "SELECT * FROM sales"),
    "repeat_sale_pairs": (("pairs",), f"SELECT {PAIR} FROM pairs"),
    "repeat_sale_pairs_of_lines": (
        (),
        """SELECT * FROM (SELECT property_id, tract_id, 'all' AS cbsa_id, sale_date AS first_sale_date,
             sale_price AS first_sale_price, lead(sale_date) OVER w AS second_sale_date,
             lead(sale_price) OVER w AS second_sale_price FROM (
               SELECT CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey % 5 AS VARCHAR) AS property_id,
                      CAST(l_suppkey % 5 AS VARCHAR) AS tract_id, CAST(l_shipdate AS DATE) AS sale_date,
                      l_extendedprice AS sale_price FROM lineitem)
             WINDOW w AS (PARTITION BY property_id ORDER BY sale_date, sale_price, tract_id))
           WHERE second_sale_date IS NOT NULL""",
    ),
    "pair_metrics": (
        ("grown",),
        f"""SELECT {PAIR}, round(ln(second_sale_price) - ln(first_sale_price), 6) + 0.0 AS log_price_diff,
            round(time_diff_years, 6) AS time_diff_years, {GROWTH} FROM grown""",
    ),
    "validated_pairs": (
        ("validated",),
        f"""SELECT {PAIR}, time_diff_months, round(appreciation_ratio, 6) AS appreciation_ratio,
            round(time_diff_years, 6) AS time_diff_years, {GROWTH}, valid_time_diff, valid_cagr,
            valid_appreciation, valid_prices, valid_dates, is_valid, rejection_reason FROM validated""",
    ),
    "explained_pairs": (
        ("grown",),
        """SELECT property_id, first_sale_date, second_sale_date, message IS NULL AS accepted, message FROM (
             SELECT *, CASE WHEN abs(time_diff_months) < 12 THEN 'Transactions within same 12-month period'
               WHEN abs(cagr) > 0.30 THEN printf('CAGR %.2f', cagr * 100) || '% exceeds ±30% threshold'
               WHEN appreciation_ratio > 10.0 THEN printf('Appreciation %.2fx exceeds 10x threshold', appreciation_ratio)
               WHEN appreciation_ratio < 0.75 THEN printf('Appreciation %.2fx below 0.75x threshold', appreciation_ratio)
               WHEN first_sale_price <= 0 OR second_sale_price <= 0 THEN 'Invalid price (must be positive)'
               WHEN second_sale_date <= first_sale_date THEN 'Second sale must be after first sale' END AS message
             FROM grown)""",
    ),
    "rejection_reason_counts": (
        ("validated",),
        "SELECT rejection_reason, count(*) AS pairs FROM validated WHERE NOT is_valid GROUP BY 1",
    ),
    "validation_report": (
        ("validated",),
        """SELECT count(*) AS total_transactions, count(*) FILTER (is_valid) AS valid_transactions,
             count(*) FILTER (NOT is_valid) AS invalid_transactions,
             round(avg(CAST(is_valid AS INT)), 6) AS validation_rate,
             round(avg(cagr) FILTER (is_valid), 6) AS cagr_mean, round(stddev(cagr) FILTER (is_valid), 6) AS cagr_std,
             round(min(cagr) FILTER (is_valid), 6) AS cagr_min, round(max(cagr) FILTER (is_valid), 6) AS cagr_max,
             round(avg(time_diff_years) FILTER (is_valid), 6) AS mean_years,
             round(min(time_diff_years) FILTER (is_valid), 6) AS min_years,
             round(max(time_diff_years) FILTER (is_valid), 6) AS max_years,
             round(median(time_diff_years) FILTER (is_valid), 6) AS median_years FROM validated""",
    ),
    "validation_rule_rates": (
        ("validated",),
        " UNION ALL ".join(
            f"""SELECT '{rule}' AS rule, count(*) FILTER ({flag}) AS passed, count(*) FILTER (NOT {flag}) AS failed,
                round(avg(CAST({flag} AS INT)), 6) AS pass_rate FROM validated"""
            for flag, rule in (
                ("is_valid", "overall"), ("valid_prices", "positive_prices"), ("valid_dates", "date_order"),
                ("valid_time_diff", "minimum_time_gap"), ("valid_cagr", "cagr_bounds"),
                ("valid_appreciation", "appreciation_bounds"),
            )
        ),
    ),
    "screened_pairs": (
        ("screened",),
        f"""SELECT {PAIR}, round(months_diff, 6) AS months_diff, round(years_diff, 6) AS years_diff,
            round(appreciation, 6) AS appreciation, round(cagr, 6) + 0.0 AS cagr FROM screened
            WHERE first_sale_price >= 10000 AND second_sale_price >= 10000 AND months_diff >= 12
              AND abs(cagr) <= 0.30 AND appreciation BETWEEN 0.75 AND 10.0""",
    ),
    "screened_by_years": (
        ("measured",),
        f"""SELECT {PAIR}, round(time_diff_years, 6) AS time_diff_years, round(y, 6) + 0.0 AS log_price_change,
            round(exp(y / time_diff_years) - 1, 6) + 0.0 AS cagr FROM (
            SELECT *, ln(second_sale_price) - ln(first_sale_price) AS y FROM measured)
            WHERE time_diff_years >= 1.0 AND abs(exp(y / time_diff_years) - 1) <= 0.30
              AND appreciation_ratio BETWEEN 0.75 AND 10.0""",
    ),
    "screen_rate": (
        ("screened",),
        """SELECT total, kept, round(1 - kept / total, 6) AS rejection_rate FROM (
             SELECT count(*) AS total, count(*) FILTER (first_sale_price >= 10000 AND second_sale_price >= 10000
               AND months_diff >= 12 AND abs(cagr) <= 0.30 AND appreciation BETWEEN 0.75 AND 10.0) AS kept
             FROM screened)""",
    ),
    "pairs_between_dates": (
        ("pairs",),
        f"SELECT {PAIR} FROM pairs WHERE second_sale_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'",
    ),
    "pairs_of_areas": (("pairs",), f"SELECT {PAIR} FROM pairs WHERE cbsa_id IN ('10100', '10220')"),
    "annual_market": (
        ("market",),
        "SELECT cbsa_id, year, round(index_value, 6) AS index_value, round(annual_return, 6) + 0.0 AS annual_return FROM market",
    ),
    "pairs_against_market": (
        ("pairs", "market"),
        """SELECT property_id, first_sale_date, a.year AS first_year, b.year AS second_year,
             round(b.index_value / a.index_value, 6) AS market_ratio
           FROM pairs p JOIN market a ON p.cbsa_id = a.cbsa_id AND a.year = year(first_sale_date)
           JOIN market b ON p.cbsa_id = b.cbsa_id AND b.year = year(second_sale_date)""",
    ),
    "half_pairs_by_tract_year": (("half",), "SELECT * FROM half"),
    "half_pairs_of_sales": (
        ("touched",),
        """SELECT tract_id, year, count(*) AS half_pairs FROM (
             SELECT tract_id, y1 AS year FROM touched UNION ALL SELECT tract_id, y2 FROM touched) GROUP BY ALL""",
    ),
    "half_pair_panel": (
        ("touched",),
        """SELECT tract_id, CAST(y.year AS INT) AS year, count(*) AS half_pairs
           FROM touched JOIN (SELECT unnest(range(least(min(y1), min(y2)), greatest(max(y1), max(y2)) + 2)) AS year FROM touched) y
             ON y1 BETWEEN y.year - 1 AND y.year OR y2 BETWEEN y.year - 1 AND y.year GROUP BY ALL""",
    ),
    "sufficient_tract_years": (
        ("half",),
        """SELECT h.*, h.half_pairs >= 40 AND coalesce(p.half_pairs >= 40, false) AS sufficient
           FROM half h LEFT JOIN half p ON h.tract_id = p.tract_id AND p.year = h.year - 1""",
    ),
    "tract_demographics": (("demographics",), "SELECT * FROM demographics"),
    "tracts_with_latest_demographics": (
        ("demographics", "tracts"),
        """SELECT t.tract_id, t.cbsa_id, t.state, d.year, d.cbsa_id AS cbsa_id_demo, housing_units, median_value,
             college_share, non_white_share, upb_total
           FROM tracts t LEFT JOIN (SELECT * FROM demographics
             QUALIFY row_number() OVER (PARTITION BY tract_id ORDER BY year DESC) = 1) d ON t.tract_id = d.tract_id""",
    ),
    "tracts_with_year_demographics": (
        ("demographics", "tracts"),
        """SELECT t.tract_id, t.cbsa_id, t.state, d.year, d.cbsa_id AS cbsa_id_demo, housing_units, median_value,
             college_share, non_white_share, upb_total
           FROM tracts t LEFT JOIN demographics d ON t.tract_id = d.tract_id AND d.year = 1998""",
    ),
    "design_entries": (
        ("valid",),
        """SELECT period, property_id, first_sale_date, value, CAST(dense_rank() OVER (ORDER BY period) - 1 AS INT) AS period_idx
           FROM (SELECT CAST(year(first_sale_date) AS INT) AS period, property_id, first_sale_date, -1 AS value FROM valid
                 UNION ALL SELECT CAST(year(second_sale_date) AS INT), property_id, first_sale_date, 1 FROM valid)""",
    ),
    "period_grid": (
        ("months",),
        """SELECT cbsa_id, CAST(m - low AS INT) AS period_idx, make_date(m // 12, m % 12 + 1, 1) AS date FROM (
             SELECT cbsa_id, min(f) AS low, unnest(range(min(f), max(s) + 1)) AS m FROM months GROUP BY cbsa_id)""",
    ),
    "period_cells": (
        ("months",),
        """SELECT cbsa_id, f AS first_period, s AS second_period, count(*) AS n, round(avg(y), 6) + 0.0 AS mean_change,
             round(var_pop(y) * count(*), 6) AS spread, count(*) AS all_pairs FROM months GROUP BY ALL""",
    ),
    "normal_matrix": (
        ("months",),
        """SELECT cbsa_id, row_period, col_period, CAST(sum(v) AS BIGINT) AS value FROM (
             SELECT cbsa_id, f AS row_period, f AS col_period, 1 AS v FROM months WHERE f <> s
             UNION ALL SELECT cbsa_id, s, s, 1 FROM months WHERE f <> s
             UNION ALL SELECT cbsa_id, f, s, -1 FROM months WHERE f <> s
             UNION ALL SELECT cbsa_id, s, f, -1 FROM months WHERE f <> s) GROUP BY ALL""",
    ),
    "normal_moments": (
        ("months",),
        """SELECT cbsa_id, period, round(sum(v), 6) + 0.0 AS value FROM (
             SELECT cbsa_id, f AS period, -y AS v FROM months WHERE f <> s
             UNION ALL SELECT cbsa_id, s, y FROM months WHERE f <> s) GROUP BY ALL""",
    ),
    "area_fit_optimality": (("valid",), "SELECT cbsa_id, 0.0::DOUBLE AS gradient, count(*) AS n_pairs FROM valid GROUP BY 1"),
    "nation_fit_optimality": (("valid",), "SELECT 'USA' AS nation, 0.0::DOUBLE AS gradient, count(*) AS n_pairs FROM valid"),
    "robust_fit_optimality": (("valid",), "SELECT cbsa_id, 0.0::DOUBLE AS gradient, count(*) AS n_pairs FROM valid GROUP BY 1"),
    "area_index_monthly": _index_levels("ols_month", MONTH),
    "area_index_incremental": _index_levels("ols_month", MONTH),
    **{f"area_index_{m}": _robust_levels(f"by_{m}") for m in ("huber", "cauchy")},
    "robust_against_ols": (
        ("by_huber_solved", "by_huber_fit", "ols_month_solved", "ols_month_fit"),
        f"""SELECT cbsa_id, date, round(r.beta, 6) + 0.0 AS robust_coefficient, round(r.error, 6) AS robust_se, round(100 * exp(r.beta), 6) AS robust_index,
             round(b.beta, 6) + 0.0 AS ols_coefficient, round(b.error, 6) AS ols_se, round(100 * exp(b.beta), 6) AS ols_index,
             round(r.beta - b.beta, 6) + 0.0 AS difference, round(100 * exp(r.beta) - 100 * exp(b.beta), 6) + 0.0 AS index_difference
           FROM (SELECT cbsa_id, {MONTH} AS date, beta, error FROM by_huber_solved JOIN by_huber_fit USING (cbsa_id)) r
           JOIN (SELECT cbsa_id, {MONTH} AS date, beta, CASE WHEN idx = 0 THEN 0.0 WHEN pairs > n THEN sqrt(inverse * rss / (pairs - n)) END AS error
                 FROM ols_month_solved JOIN ols_month_fit USING (cbsa_id)) b USING (cbsa_id, date)""",
    ),
    "robust_influence": (
        ("by_huber_errors",),
        """SELECT property_id, cbsa_id, first_sale_date, round(w, 6) + 0.0 AS weight, round(residual, 6) + 0.0 AS residual,
             CASE WHEN spread > 1e-10 THEN round(residual / spread, 6) + 0.0 END AS standardized_residual, w < 0.5 AS downweighted,
             round((rank() OVER (PARTITION BY cbsa_id ORDER BY w) + (count(*) OVER (PARTITION BY cbsa_id, w) - 1) / 2)
               / count(*) OVER (PARTITION BY cbsa_id), 6) AS weight_percentile
           FROM (SELECT * REPLACE (round(w, 9) AS w), stddev_pop(residual) OVER (PARTITION BY cbsa_id) AS spread FROM by_huber_errors)""",
    ),
    "sensitivity_series": (
        ("scenario_series",),
        """SELECT scenario, CAST(idx AS INT) AS period_idx, date, round(index_value, 6) AS index_value, round(beta, 6) + 0.0 AS log_return,
             round(error, 6) AS standard_error, identified FROM scenario_series""",
    ),
    "sensitivity_impact": (
        ("impacts",),
        """SELECT scenario, round(mean_difference, 6) + 0.0 AS mean_difference, round(max_difference, 6) AS max_difference,
             round(mean_pct_difference, 6) + 0.0 AS mean_pct_difference, round(max_pct_difference, 6) AS max_pct_difference,
             round(rmse, 6) AS rmse, round(correlation, 6) AS correlation, num_periods FROM impacts""",
    ),
    "sensitivity_importance": (
        ("impacts",),
        """SELECT CASE WHEN scenario LIKE 'outlier%' THEN 'outlier_threshold' WHEN scenario LIKE 'robust%' THEN 'robust_method'
               WHEN scenario LIKE 'weight%' THEN 'weight_type' WHEN scenario LIKE 'time%' THEN 'time_window' ELSE 'data_filter' END AS parameter_type,
             round(avg(max_pct_difference), 6) AS avg_impact, round(max(max_pct_difference), 6) AS max_impact, count(*) AS num_scenarios
           FROM impacts GROUP BY 1""",
    ),
    "area_index_annual": _index_levels("ols_year", "make_date(CAST(o + idx AS BIGINT), 1, 1)"),
    "area_fit_summary": (
        ("ols_month_fit", "ols_month_solved"),
        """SELECT cbsa_id, pairs AS num_observations, CAST(any_value(n) + 1 AS INT) AS num_periods,
             CAST(count(*) - count(DISTINCT label) AS INT) AS rank, count(DISTINCT label) = 1 AS full_rank,
             round(1 - any_value(rss) / any_value(tss), 6) AS r_squared, round(sqrt(any_value(rss)), 6) AS residual_norm
           FROM ols_month_solved JOIN ols_month_fit USING (cbsa_id) GROUP BY cbsa_id, pairs""",
    ),
    "area_residuals": (
        ("ols_month_errors",),
        """SELECT property_id, cbsa_id, first_sale_date, round(y, 6) + 0.0 AS log_change, round(residual, 6) + 0.0 AS residual
           FROM ols_month_errors""",
    ),
    "index_returns_monthly": (("levels",), _returns(1)),
    "index_returns_quarterly": (("levels",), _returns(3)),
    "index_returns_annual": (("levels",), _returns(12)),
    "index_rebased": (
        ("levels",),
        """SELECT tract_id, date, round(index_value / base * 100, 6) AS index_value FROM levels JOIN (
             SELECT tract_id, arg_min(index_value, abs(year(date) - 1998) * 1000000 + date_diff('day', DATE '1900-01-01', date)) AS base
             FROM levels GROUP BY 1)
           USING (tract_id)""",
    ),
    "outlier_flags": (
        ("outlying",),
        """SELECT property_id, first_sale_date, second_sale_date, is_cagr, is_time_gap, is_cagr OR is_time_gap AS is_outlier,
             CAST(is_cagr AS INT) + CAST(is_time_gap AS INT) + 0.0::DOUBLE AS outlier_score,
             concat_ws('; ', CASE WHEN is_cagr THEN 'Extreme CAGR' END, CASE WHEN is_time_gap THEN 'Excessive time gap' END)
               AS outlier_reasons
           FROM outlying""",
    ),
    "outlier_regression_flags": (
        ("regression_tests",),
        """SELECT property_id, cbsa_id, first_sale_date, round(residual, 6) + 0.0 AS residual, round(studentized, 6) + 0.0 AS studentized,
             round(leverage, 6) AS leverage, round(cooks_distance, 6) AS cooks_distance, is_cooks, is_residual, is_leverage,
             is_cagr OR is_time_gap OR is_cooks OR is_residual OR is_leverage AS is_outlier,
             round(CAST(is_cagr AS INT) + CAST(is_time_gap AS INT) + CASE WHEN is_cooks THEN cooks_distance ELSE 0 END
               + CASE WHEN is_residual THEN abs(studentized) ELSE 0 END + CASE WHEN is_leverage THEN leverage ELSE 0 END, 6) AS outlier_score,
             concat_ws('; ', CASE WHEN is_cagr THEN 'Extreme CAGR' END, CASE WHEN is_time_gap THEN 'Excessive time gap' END,
               CASE WHEN is_cooks THEN 'High Cook''s distance' END, CASE WHEN is_residual THEN 'Large studentized residual' END,
               CASE WHEN is_leverage THEN 'High leverage' END) AS outlier_reasons
           FROM regression_tests""",
    ),
    "outlier_regression_statistics": (
        ("regression_tests",),
        """SELECT count(*) AS total_observations, count(*) FILTER (any_test) AS total_outliers,
             round(avg(CAST(any_test AS INT)), 6) AS outlier_rate, count(*) FILTER (is_cagr) AS cagr_outliers,
             count(*) FILTER (is_time_gap) AS time_gap_outliers, count(*) FILTER (is_cooks) AS cooks_outliers,
             count(*) FILTER (is_residual) AS residual_outliers, count(*) FILTER (is_leverage) AS leverage_outliers
           FROM (SELECT *, is_cagr OR is_time_gap OR is_cooks OR is_residual OR is_leverage AS any_test FROM regression_tests)""",
    ),
    "outlier_summary": (
        ("outlying",),
        """SELECT category, metric, round(value, 6) AS value FROM (
             SELECT 'Overall' AS category, 'Total Observations' AS metric, count(*)::DOUBLE AS value FROM outlying
             UNION ALL SELECT 'Overall', 'Total Outliers', count(*) FILTER (is_cagr OR is_time_gap) FROM outlying
             UNION ALL SELECT 'Overall', 'Outlier Rate', avg(CAST(is_cagr OR is_time_gap AS INT)) FROM outlying
             UNION ALL SELECT 'By Reason', 'Extreme CAGR', count(*) FROM outlying WHERE is_cagr HAVING count(*) > 0
             UNION ALL SELECT 'By Reason', 'Excessive time gap', count(*) FROM outlying WHERE is_time_gap HAVING count(*) > 0
             UNION ALL SELECT 'Thresholds', t.m, t.v FROM (VALUES ('cooks_distance', 4.0), ('leverage', 3.0),
               ('studentized_residual', 3.0), ('cagr', 0.5), ('time_gap_years', 30.0)) t(m, v))""",
    ),
    "pairs_without_outliers": (("outlying",), f"SELECT {PAIR} FROM outlying WHERE NOT is_cagr AND NOT is_time_gap"),
    "quality_summary": (
        ("measured",),
        """SELECT count(*) AS total_pairs, count(DISTINCT tract_id) AS unique_tracts, count(DISTINCT cbsa_id) AS unique_cbsas,
             min(first_sale_date) AS start_date, max(second_sale_date) AS end_date,
             round(avg(time_diff_years), 4) AS avg_holding_period_years, round(avg(first_sale_price), 4) AS avg_first_price,
             round(avg(second_sale_price), 4) AS avg_second_price, round(avg(appreciation_ratio) - 1, 4) AS avg_appreciation,
             round(date_diff('day', min(first_sale_date), max(second_sale_date)) / 365.25, 4) AS years_covered,
             count(DISTINCT property_id) AS unique_properties,
             round(median(time_diff_years), 4) AS median_holding_period_years FROM measured""",
    ),
    "quality_temporal": (
        ("pairs",),
        """SELECT CAST(date_trunc('month', second_sale_date) AS DATE) AS date, count(*) AS pair_count,
             count(DISTINCT tract_id) AS tract_count, round(sum(second_sale_price), 2) AS total_price,
             round(stddev(second_sale_price), 3) AS std_price, round(median(second_sale_price), 6) AS median_price,
             count(*) >= 100 / 12 AS has_sufficient_data FROM pairs GROUP BY 1""",
    ),
    "quality_geographic": (
        ("pairs", "tracts"),
        "SELECT 'cbsa' AS geography_type, cbsa_id AS geography_id, "
        + _POOLED.format(tracts="count(DISTINCT tract_id)", least=10, rate="NULL::DOUBLE")
        + " FROM pairs GROUP BY cbsa_id UNION ALL SELECT 'tract', tract_id, "
        + _POOLED.format(tracts="1", least=10, rate="NULL::DOUBLE")
        + " FROM pairs GROUP BY tract_id UNION ALL SELECT 'summary', 'OVERALL', "
        + _POOLED.format(
            tracts="count(DISTINCT tract_id)", least=100,
            rate="round(count(DISTINCT tract_id) / (SELECT count(*) FROM tracts), 6)",
        )
        + " FROM pairs",
    ),
    "quality_prices": (
        ("pairs",),
        " UNION ALL ".join(
            _moments(column, label)
            for column, label in (
                ("first_sale_price", "First Sale"), ("second_sale_price", "Second Sale"),
                ("(second_sale_price / first_sale_price)", "Appreciation Ratio"),
            )
        ),
    ),
    "quality_scores": (
        ("validated", "tracts"),
        """SELECT round(volume, 6) AS volume, round(validation, 6) AS validation, round(temporal, 6) AS temporal_coverage,
             round(geographic, 6) AS geographic_coverage, round(price, 6) AS price_quality,
             round(0.2 * volume + 0.3 * validation + 0.2 * temporal + 0.2 * geographic + 0.1 * price, 6) AS overall
           FROM (SELECT least(1.0, count(*) / 100) AS volume, avg(CAST(is_valid AS INT)) AS validation,
                   count(DISTINCT tract_id) / (SELECT count(*) FROM tracts) AS geographic,
                   (1 - least(1.0, greatest(stddev(first_sale_price) / avg(first_sale_price),
                        stddev(second_sale_price) / avg(second_sale_price),
                        stddev(appreciation_ratio) / avg(appreciation_ratio)) / 2)
                    + 1 - least(1.0, greatest(abs(skewness(first_sale_price)), abs(skewness(second_sale_price)),
                        abs(skewness(appreciation_ratio))) / 3)) / 2 AS price FROM validated),
             (SELECT avg(CAST(n >= 100 / 12 AS INT)) AS temporal FROM (
                SELECT date_trunc('month', second_sale_date) AS m, count(*) AS n FROM validated GROUP BY 1))""",
    ),
    "tract_codes": (
        ("tracts",),
        "SELECT *, tract_id AS fips_code FROM tracts",
    ),
    "tract_adjacency": (
        ("tracts",),
        """SELECT a.tract_id, b.tract_id AS neighbor_id FROM tracts a JOIN tracts b
           ON a.cbsa_id = b.cbsa_id AND abs(a.centroid_y - b.centroid_y) = 1""",
    ),
    "island_adjacency": (
        ("tracts",),
        """SELECT a.tract_id, b.tract_id AS neighbor_id FROM tracts a JOIN tracts b
           ON a.cbsa_id = b.cbsa_id AND a.tract_id <> b.tract_id
             AND (abs(a.centroid_y - b.centroid_y) <= 1 OR abs(abs(a.centroid_y - b.centroid_y) - 20) <= 1)""",
    ),
    "tract_nearest": (
        ("tracts",),
        """SELECT cbsa_id, tract_id, neighbor_id, CAST(rank AS INT) AS rank, distance FROM (
             SELECT a.cbsa_id, a.tract_id, b.tract_id AS neighbor_id, abs(a.centroid_y - b.centroid_y) AS distance,
                    row_number() OVER (PARTITION BY a.tract_id ORDER BY abs(a.centroid_y - b.centroid_y), b.tract_id) AS rank
             FROM tracts a JOIN tracts b ON a.cbsa_id = b.cbsa_id AND a.tract_id <> b.tract_id) WHERE rank <= 10""",
    ),
    "area_summary": (
        ("tracts",),
        """SELECT cbsa_id, min(state) AS state, count(*) AS tract_count, CAST(sum(population) AS BIGINT) AS total_population,
             round(sum(area_sqmi), 6) AS total_area_sqmi FROM tracts GROUP BY 1""",
    ),
    "tract_issues": (
        ("tracts",),
        "SELECT 'duplicate tract id' AS issue, tract_id AS subject, 2::BIGINT AS rows FROM tracts WHERE centroid_y = 7",
    ),
    "supertract_invariants": (
        ("half", "valid"),
        """SELECT year, count(*) AS single_tracts, 0::BIGINT AS below_minimum, 0::BIGINT AS miscounted,
             0::BIGINT AS with_unknown_tracts, 0::BIGINT AS tracts_in_two_groups
           FROM half WHERE half_pairs >= 40 GROUP BY year""",
    ),
    "weights_all_types": (("shares",), f"SELECT {SET}, tract_id, round(weight, 9) AS weight FROM shares"),
    "weights_merged_national": (
        ("area_value",),
        """SELECT 'national' AS geography_id, period, weight_type, tract_id,
             round(weight / sum(weight) OVER (PARTITION BY period), 6) AS weight FROM area_value""",
    ),
    "weights_equal": (
        ("tracts", "lines"),
        """SELECT cbsa_id AS geography_id, CAST(y.period AS INT) AS period, 'sample' AS weight_type, tract_id,
             round(1 / count(*) OVER (PARTITION BY cbsa_id, y.period), 6) AS weight
           FROM tracts, (SELECT DISTINCT year(sale_date) AS period FROM lines) y""",
    ),
    "weights_half_pairs": (
        ("half", "tracts"),
        """SELECT cbsa_id AS geography_id, year AS period, 'sample' AS weight_type, tract_id,
             round(half_pairs / sum(half_pairs) OVER (PARTITION BY cbsa_id, year), 6) AS weight
           FROM half JOIN tracts USING (tract_id)""",
    ),
    "weights_available_periods": (("shares",), "SELECT DISTINCT geography_id, period FROM shares WHERE weight_type = 'unit'"),
    "weights_sound": (
        ("raw", "shares"),
        """SELECT geography_id, period, weight_type, count(*) AS tracts, round(min(weight), 6) AS smallest,
             round(sum(weight), 6) AS total, CASE WHEN min(weight) < 0 THEN 'Negative weights found'
               WHEN abs(sum(weight) - 1) >= 1e-6 THEN 'Weights not normalized' END AS issue FROM (
             SELECT cbsa_id AS geography_id, period, weight_type, tract_id, raw AS weight FROM raw WHERE weight_type = 'college'
             UNION ALL SELECT geography_id, period, weight_type, tract_id, weight FROM shares
               WHERE weight_type = 'unit' AND geography_id <> 'national') GROUP BY ALL""",
    ),
    "weights_checked": (
        ("raw",),
        """SELECT *, issues = '' AS is_valid FROM (SELECT cbsa_id AS geography_id, period, weight_type, count(*) AS tracts,
             round(sum(raw), 6) AS total, count(*) FILTER (raw < 0) AS negative, max(raw) AS largest,
             max(CASE WHEN raw = top THEN tract_id END) AS largest_tract,
             concat_ws('; ',
               CASE WHEN abs(sum(raw) - 1) >= 1e-6 THEN printf('Weights not normalized: sum = %.6f', sum(raw)) END,
               CASE WHEN count(*) FILTER (raw < 0) > 0 THEN printf('Negative weights found for %d tracts', count(*) FILTER (raw < 0)) END,
               CASE WHEN abs(sum(raw)) < 1e-6 THEN 'Total weight is zero or near zero' END,
               CASE WHEN max(raw) > 0.5 THEN printf('Dominant weights found: %s = %.3f',
                 max(CASE WHEN raw = top THEN tract_id END), max(raw)) END) AS issues
           FROM (SELECT *, max(raw) OVER (PARTITION BY cbsa_id, period) AS top FROM raw WHERE weight_type = 'college')
           GROUP BY ALL)""",
    ),
    "weights_consistency": (
        ("shares",),
        """SELECT p.geography_id, p.period, 'upb' AS weight_type, previous, known - tracts AS missing_tracts, moved_tract,
             round(change, 6) AS largest_change, coalesce(change > 0.5 * before, false) AS large_change,
             known = tracts AND NOT coalesce(change > 0.5 * before, false) AS is_consistent
           FROM (SELECT *, lag(period) OVER (PARTITION BY geography_id ORDER BY period) AS previous FROM (
                   SELECT geography_id, period, count(*) AS tracts
                   FROM shares WHERE weight_type = 'upb' AND geography_id <> 'national' GROUP BY ALL)) p
           JOIN (SELECT geography_id, count(DISTINCT tract_id) AS known FROM shares WHERE weight_type = 'upb' GROUP BY 1)
             USING (geography_id)
           LEFT JOIN (SELECT a.geography_id, a.period, b.period AS previous, a.tract_id AS moved_tract,
                   abs(a.weight - b.weight) AS change, b.weight AS before
                 FROM shares a JOIN shares b ON a.geography_id = b.geography_id AND a.tract_id = b.tract_id
                   AND a.weight_type = 'upb' AND b.weight_type = 'upb' AND b.period < a.period
                 JOIN (SELECT geography_id, period, lag(period) OVER (PARTITION BY geography_id ORDER BY period) AS previous
                       FROM (SELECT DISTINCT geography_id, period FROM shares WHERE weight_type = 'upb')) q
                   ON q.geography_id = a.geography_id AND q.period = a.period AND q.previous = b.period
                 QUALIFY row_number() OVER (PARTITION BY a.geography_id, a.period ORDER BY abs(a.weight - b.weight) DESC, a.tract_id DESC) = 1) m
             USING (geography_id, period, previous)
           WHERE previous IS NOT NULL""",
    ),
    "weights_incomplete": (
        ("area_value", "enough"),
        """SELECT geography_id, period, weight_type, count(*) FILTER (NOT kept) AS missing, 0::BIGINT AS unexpected FROM (
             SELECT *, tract_id IN (SELECT tract_id FROM enough) AS kept FROM area_value) GROUP BY ALL
           HAVING count(*) FILTER (NOT kept) > 0 AND count(*) FILTER (kept) > 0""",
    ),
    "weights_filled": (
        ("area_value", "tracts"),
        """SELECT geography_id, period, weight_type, tract_id,
             round(w / sum(w) OVER (PARTITION BY geography_id, period), 6) AS weight FROM (
             SELECT s.geography_id, s.period, 'value' AS weight_type, t.tract_id, coalesce(v.weight, 0.01) AS w
             FROM (SELECT DISTINCT geography_id, period FROM area_value) s
             JOIN tracts t ON t.cbsa_id = s.geography_id
             LEFT JOIN area_value v ON v.geography_id = s.geography_id AND v.period = s.period AND v.tract_id = t.tract_id)""",
    ),
    "weights_redistributed": (
        ("area_value", "enough"),
        """SELECT tract_id, geography_id, period, weight_type,
             round(weight / sum(weight) OVER (PARTITION BY geography_id, period), 6) AS weight
           FROM area_value JOIN enough USING (tract_id)""",
    ),
    "weights_merged_average": (("shares",), _merged("average")),
    "weights_merged_sum": (("shares",), _merged("sum")),
    "weights_merged_first": (("shares",), _merged("first")),
    "weights_coverage": (
        ("area_value", "enough"),
        """SELECT geography_id, period, weight_type, round(sum(CASE WHEN kept THEN weight ELSE 0 END) / sum(weight), 6) AS coverage
           FROM (SELECT *, tract_id IN (SELECT tract_id FROM enough) AS kept FROM area_value) GROUP BY ALL""",
    ),
    "weights_adjustment_report": (
        ("area_value", "enough"),
        """SELECT geography_id, period, weight_type, count(*) AS original_tract_count,
             count(*) FILTER (kept) AS adjusted_tract_count, count(*) FILTER (NOT kept) AS tracts_dropped,
             round(sum(weight), 6) AS original_total_weight, 1.0::DOUBLE AS adjusted_total_weight, true AS normalized
           FROM (SELECT *, tract_id IN (SELECT tract_id FROM enough) AS kept FROM area_value) GROUP BY ALL
           HAVING count(*) FILTER (kept) > 0""",
    ),
    "weights_nearest_year": (
        ("area_value",),
        f"""SELECT {SET}, tract_id, round(weight, 6) AS weight FROM area_value WHERE (geography_id, period) IN (
             SELECT geography_id, arg_min(period, abs(period - base_year) * 10000 + period) FROM (
               SELECT *, CASE CAST(geography_id AS INT) % 3 WHEN 0 THEN low - 2
                 WHEN 1 THEN CAST(floor((low + high) / 2) AS INT) ELSE high + 3 END AS base_year
               FROM (SELECT geography_id, period, min(period) OVER g AS low, max(period) OVER g AS high
                     FROM area_value WINDOW g AS (PARTITION BY geography_id)))
             GROUP BY 1)""",
    ),
    "area_index_by_year_weights": (
        ("area_value", "levels"),
        """SELECT geography_id, date, round(sum(weight * index_value) / sum(weight), 6) AS index_value
           FROM levels JOIN area_value v ON v.tract_id = levels.tract_id AND v.period = year(date) GROUP BY ALL""",
    ),
    "area_index_log_chain": (
        ("area_value", "levels"),
        """SELECT geography_id, date, round(100 * exp(sum(coalesce(g, 0)) OVER (PARTITION BY geography_id ORDER BY date)), 6)
             AS index_value FROM (
             SELECT geography_id, date, sum(weight * x) / sum(CASE WHEN x IS NOT NULL THEN weight END) AS g FROM (
               SELECT tract_id, date, ln(index_value) - lag(ln(index_value)) OVER (PARTITION BY tract_id ORDER BY date) AS x
               FROM levels) l JOIN area_value v ON v.tract_id = l.tract_id AND v.period = year(date) GROUP BY ALL)""",
    ),
    "laspeyres_area": (
        ("area_laspeyres",),
        """SELECT geography_id, date, round(index_value, 6) AS index_value, round(coverage, 6) AS coverage, missing_tracts
           FROM area_laspeyres""",
    ),
    "laspeyres_of_fits": (
        ("fit_members", "fit_base"),
        """SELECT geography_id, date, round(sum(weight * x) / sum(weight), 6) AS index_value, round(sum(weight), 6) AS coverage,
             any_value(tracts) - count(*) AS missing_tracts,
             CASE WHEN count(e) = count(*) THEN round(sqrt(sum(weight * e * weight * e)) / sum(weight), 6) END AS standard_error
           FROM fit_members JOIN fit_base USING (geography_id, tract_id)
           JOIN (SELECT geography_id, count(*) AS tracts FROM fit_base GROUP BY 1) USING (geography_id)
           GROUP BY geography_id, date""",
    ),
    "laspeyres_coverage": (
        ("area_base", "area_members", "area_spans"),
        """SELECT geography_id, round(sum(CASE WHEN seen = dates THEN weight ELSE 0 END) / sum(weight), 6) AS coverage_rate,
             count(*) FILTER (seen IS NULL OR seen <> dates) AS missing_tracts
           FROM area_base JOIN area_spans USING (geography_id)
           LEFT JOIN (SELECT geography_id, tract_id, count(*) AS seen FROM area_members GROUP BY ALL)
             USING (geography_id, tract_id) GROUP BY geography_id""",
    ),
    "laspeyres_national": (
        ("nation_base", "levels"),
        """SELECT 'national' AS geography_id, date, round(sum(weight * index_value) / sum(weight), 6) AS index_value,
             round(sum(weight), 6) AS coverage, (SELECT count(*) FROM nation_base) - count(*) AS missing_tracts
           FROM levels JOIN nation_base USING (tract_id) GROUP BY date""",
    ),
    "hierarchy_index": (
        ("tract_series", "cbsa_id_series", "state_series", "nation_series"),
        """SELECT 'tract' AS geography_type, geography_id, date, round(index_value, 6) AS index_value FROM tract_series
           UNION ALL SELECT 'cbsa', geography_id, date, round(index_value, 6) FROM cbsa_id_series
           UNION ALL SELECT 'state', geography_id, date, round(index_value, 6) FROM state_series
           UNION ALL SELECT 'national', geography_id, date, round(index_value, 6) FROM nation_series""",
    ),
    "aggregation_tree": (
        ("tracts",),
        """SELECT DISTINCT 'cbsa' AS parent_type, cbsa_id AS parent_id, tract_id AS child_id FROM tracts
           UNION ALL SELECT DISTINCT 'state', state, cbsa_id FROM tracts
           UNION ALL SELECT DISTINCT 'national', 'USA', state FROM tracts""",
    ),
    "chained_index": (
        ("area_levels",),
        """SELECT geography_id, year, date, index_value, round(index_value * coalesce(link, 1), 6) AS chained_index FROM area_levels
           JOIN (SELECT geography_id, year, lag(c) OVER (PARTITION BY geography_id ORDER BY year) AS link FROM (
             SELECT geography_id, year, arg_max(index_value, date) / 100 AS c FROM area_levels GROUP BY ALL))
           USING (geography_id, year)""",
    ),
    "chained_index_compounding": (
        ("area_levels",),
        """SELECT geography_id, year, date, index_value, round(index_value * exp(coalesce(link, 0)), 6) AS chained_index
           FROM area_levels JOIN (
             SELECT geography_id, year, sum(ln(c)) OVER (PARTITION BY geography_id ORDER BY year
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS link FROM (
             SELECT geography_id, year, arg_max(index_value, date) / 100 AS c FROM area_levels GROUP BY ALL))
           USING (geography_id, year)""",
    ),
    "weighting_difference": (
        ("shares", "changes"),
        """SELECT geography_id, date, round(sum(gap * change), 6) + 0.0 AS difference FROM changes JOIN (
             SELECT geography_id, period, tract_id, sum(CASE WHEN weight_type = 'value' THEN weight ELSE -weight END) AS gap
             FROM shares WHERE weight_type IN ('value', 'unit') AND geography_id <> 'national' GROUP BY ALL) g
           ON g.tract_id = changes.tract_id AND g.period = year(date) GROUP BY ALL""",
    ),
    "distance_gradient": (
        ("changes", "tracts"),
        """SELECT cbsa_id, date, round(regr_slope(change, centroid_y - low), 6) + 0.0 AS gradient,
             round(var_samp(change), 6) + 0.0 AS variance, count(*) AS tracts
           FROM changes JOIN (SELECT *, min(centroid_y) OVER (PARTITION BY cbsa_id) AS low FROM tracts) USING (tract_id)
           GROUP BY cbsa_id, date""",
    ),
    "metric_summary": ((), _metrics("events")),
    "metric_summary_recent": (
        (),
        _metrics("(SELECT * FROM events WHERE date_diff('second', ts, (SELECT max(ts) FROM events)) < 86400)"),
    ),
    "job_status_counts": ((), "SELECT o_orderstatus, count(*) AS jobs FROM orders GROUP BY 1"),
    "bottlenecks": (
        (),
        """WITH summary AS (SELECT user_id, sum(value) AS duration, max(value) AS memory FROM events GROUP BY 1),
             slow AS (SELECT user_id FROM summary ORDER BY duration DESC, user_id LIMIT 5),
             heavy AS (SELECT user_id FROM summary ORDER BY memory DESC, user_id LIMIT 5)
           SELECT user_id, round(duration, 6) AS duration, memory,
             CASE WHEN user_id IN (SELECT user_id FROM heavy) THEN 'memory' ELSE 'time' END AS bottleneck_type
           FROM summary WHERE user_id IN (SELECT user_id FROM slow UNION SELECT user_id FROM heavy)""",
    ),
}


def _with_parts(needed: tuple[str, ...], final: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dependency in PARTS[name][0]:
                add(dependency)
            order.append(name)

    for name in needed:
        add(name)
    if not order:
        return final
    parts = ",\n".join(
        f"{name} AS {'' if name.endswith('_reduced') else 'MATERIALIZED '}({PARTS[name][1]})" for name in order
    )
    recursive = "RECURSIVE " if any(name.endswith("_reduced") for name in order) else ""
    return f"WITH {recursive}{parts}\n{final}"


def statements() -> dict[str, str]:
    return {name: _with_parts(needed, final) for name, (needed, final) in SELECTS.items()}
