"""One SQL statement per registered report, written independently of the Spark code.

Fixed values, which results must carry exactly, stand in the statements as plain text: the labels of sites, areas and
buckets, the month labels, the goal mark and verdicts, the divergence types, the first-word pattern, and the cuts of the
reports.
"""

from __future__ import annotations

def _nd(column: str) -> str:
    return f"(count(DISTINCT {column}) + coalesce(max(CAST({column} IS NULL AS INTEGER)), 0))"


# Units of a group, unknown as soon as those of one line are.
UNITS = "CASE WHEN count(units) = count(*) THEN CAST(sum(units) AS BIGINT) END"

# --- input tables -------------------------------------------------------------------------

TABLES = {
    "lines": """
        SELECT *,
          CASE WHEN l_orderkey % 12 < 4 THEN 'BR01' WHEN l_orderkey % 12 = 4 THEN 'BR02' WHEN l_orderkey % 12 = 5 THEN 'BR03'
            WHEN l_orderkey % 12 = 6 THEN 'BRTR1' WHEN l_orderkey % 12 = 7 THEN 'MX01' WHEN l_orderkey % 12 = 8 THEN 'MX02'
            WHEN l_orderkey % 12 = 9 THEN 'AR01' WHEN l_orderkey % 12 = 10 THEN 'CL01' END AS site_id,
          CASE WHEN (l_orderkey + l_linenumber) % 101 <> 0 THEN l_partkey END AS sku,
          CASE (l_orderkey // 8) % 6 WHEN 0 THEN 'MZ' WHEN 1 THEN 'MZ' WHEN 2 THEN 'MZ' WHEN 3 THEN 'PW'
            WHEN 4 THEN 'MU' ELSE 'RK' END AS area,
          CAST((l_orderkey // 48) % 9 + 1 AS INTEGER) AS level,
          (l_partkey * 7 + l_linenumber * 13 + l_suppkey) % 20 AS h
        FROM lineitem""",
    "placed": """
        SELECT *, area || '-' || CAST(l_orderkey % 3 AS VARCHAR)
          || '-' || lpad(CAST((l_orderkey // 1000) % 1000 AS VARCHAR), 3, '0')
          || '-' || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0')
          || '-' || CASE WHEN area = 'RK' OR l_orderkey % 97 = 0 THEN 'XX'
            ELSE lpad(CAST((l_orderkey // 48) % 13 AS VARCHAR), 2, '0') END AS address_id
        FROM lines""",
    "count_detail": """
        SELECT site_id, area, level, address_id,
          sku AS sku_id, CAST(l_quantity AS INTEGER) AS qty_system,
          CASE WHEN h <> 4 THEN CAST(l_quantity AS INTEGER)
            + CASE h WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -2 ELSE 0 END END AS qty_counted,
          CASE WHEN (l_orderkey + l_suppkey) % 31 = 0 THEN 0 WHEN h = 4 AND l_linenumber = 1 THEN -1 WHEN h = 0 THEN 1
            WHEN h = 1 THEN 2 WHEN h = 2 THEN -1 WHEN h = 3 THEN -2 WHEN h <> 4 THEN 0 END AS divergence_stored,
          CASE WHEN (l_orderkey * 3 + l_linenumber) % 173 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS counted_on,
          CASE WHEN l_partkey % 50 <> 0 THEN p_type END AS category
        FROM placed LEFT JOIN part ON l_partkey = p_partkey""",
    "detail": """
        SELECT *,
          CASE WHEN site_id LIKE 'BR%' THEN 'BR' WHEN site_id LIKE 'MX%' THEN 'MX' ELSE 'OTHER' END AS market,
          qty_counted - qty_system AS divergence,
          CASE WHEN qty_counted - qty_system = 0 THEN 'ok' WHEN qty_counted - qty_system > 0 THEN 'Found'
            WHEN qty_counted - qty_system < 0 THEN 'Lost' END AS divergence_type,
          TRY_CAST(counted_on AS DATE) AS count_date, CAST(month(TRY_CAST(counted_on AS DATE)) AS INTEGER) AS month
        FROM count_detail""",
    "cycle_summary": """
        SELECT concat_ws('-', site_id, area, CAST(level AS VARCHAR), lpad(CAST(coalesce(month, 0) AS VARCHAR), 2, '0'))
            AS cycle_count_id,
          site_id, area, level,
          CASE WHEN level = 9 THEN NULL WHEN market IN ('BR', 'MX') THEN market WHEN site_id = 'CL01' THEN 'CL'
            ELSE 'OTHER' END AS region,
          '2024 | ' || lpad(CAST(coalesce(month, 0) AS VARCHAR), 2, '0') AS period,
          CASE WHEN count(*) % 3 = 0 THEN 'working' ELSE 'closed' END AS status,
          count(*) AS population_size,
          CASE WHEN count(*) % 11 <> 0 THEN
            CAST(count(*) FILTER (divergence <> 0) AS DOUBLE) / count(*) END AS p_hat,
          count(*) FILTER (divergence = 0) AS accurate_tuples,
          count(*) FILTER (divergence <> 0) AS error_tuples,
          CAST(CASE market WHEN 'BR' THEN 0.82 WHEN 'MX' THEN 0.79 ELSE 0.77 END AS DOUBLE) AS target_site,
          CAST(CASE market WHEN 'BR' THEN 0.80 WHEN 'MX' THEN 0.78 ELSE 0.76 END AS DOUBLE) AS target_region
        FROM detail GROUP BY site_id, area, level, market, month""",
    "address_stock": """
        SELECT site_id, area, address_id, sku AS sku_id,
          CASE WHEN area <> 'MZ' OR l_orderkey % 3 <> 2 OR substr(address_id, 14, 2) <> '12' OR l_linenumber <> 1
            THEN CAST(l_quantity AS INTEGER) END AS units,
          CASE WHEN (l_orderkey + l_linenumber) % 211 = 0 THEN 'n/a' ELSE
            strftime(l_shipdate, '%d/%m/%Y ') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0')
            || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0')
            || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') END AS updated_text,
          l_suppkey AS seller_id,
          CASE WHEN l_partkey % 40 <> 0 THEN l_extendedprice END AS insured_value,
          substr(address_id, 4, 1) AS zone, substr(address_id, 6, 3) AS aisle,
          substr(address_id, 10, 3) AS module, substr(address_id, 14, 2) AS floor
        FROM placed""",
    "onhand": """
        SELECT address_id, site_id,
          CASE WHEN site_id = 'CL01' AND l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS units,
          substr(address_id, 1, 2) AS area, substr(address_id, 4, 1) AS zone,
          TRY_CAST(substr(address_id, 14, 2) AS DOUBLE) AS floor
        FROM placed""",
    "address_density": """
        SELECT site_id, address_id, count(DISTINCT sku_id) AS sku_count
        FROM count_detail GROUP BY site_id, address_id""",
    "movements": """
        SELECT CASE event_type WHEN 'click' THEN 'Put away' WHEN 'purchase' THEN 'Picking'
            WHEN 'view' THEN 'Cycle count' WHEN 'signup' THEN 'Stow transfer' WHEN 'error' THEN ' adjustment' END
            AS process,
          CAST(floor(value) AS BIGINT) + 1 AS units, event_id % 500 AS item_id,
          CASE event_id % 6 WHEN 0 THEN 'MZ' WHEN 1 THEN 'MZ' WHEN 2 THEN 'MZ' WHEN 3 THEN 'PW' WHEN 4 THEN 'MU'
            ELSE 'RK' END || '-' || CAST(event_id % 3 AS VARCHAR)
            || '-' || lpad(CAST((event_id // 50) % 20 AS VARCHAR), 3, '0')
            || '-' || lpad(CAST(event_id % 50 AS VARCHAR), 3, '0')
            || '-' || lpad(CAST((event_id // 12) % 9 + 1 AS VARCHAR), 2, '0') AS origin,
          CASE WHEN (event_id // 6) % 7 = 6 THEN '' ELSE
            CASE (event_id // 6) % 7 WHEN 0 THEN 'MZ' WHEN 1 THEN 'MZ' WHEN 2 THEN 'MZ' WHEN 3 THEN 'PW'
              WHEN 4 THEN 'MU' ELSE 'RK' END || '-' || CAST(event_id % 3 AS VARCHAR)
            || '-' || lpad(CAST((event_id // 60) % 20 AS VARCHAR), 3, '0')
            || '-' || lpad(CAST(event_id % 40 AS VARCHAR), 3, '0')
            || '-' || lpad(CAST((event_id // 18) % 9 + 1 AS VARCHAR), 2, '0') END AS destination,
          strftime(date_trunc('second', ts), '%d/%m/%Y %H:%M:%S') AS moved_text,
          user_id AS worker_id,
          CAST(ts AS DATE) AS day
        FROM events""",
    # Distinct SKUs counted wrong and right per address of area MZ.
    "address_errors": """
        SELECT market, site_id, address_id,
          count(DISTINCT sku_id) FILTER (divergence_stored <> 0)
            + coalesce(max(CAST(sku_id IS NULL AS INTEGER)) FILTER (divergence_stored <> 0), 0) AS error_skus,
          count(DISTINCT sku_id) FILTER (divergence_stored = 0)
            + coalesce(max(CAST(sku_id IS NULL AS INTEGER)) FILTER (divergence_stored = 0), 0) AS ok_skus
        FROM detail GROUP BY market, site_id, address_id""",
    "mz": """
        SELECT *, error_skus + ok_skus AS density, CASE WHEN error_skus <> 0 THEN 'error' ELSE 'ok' END AS outcome
        FROM address_errors WHERE address_id LIKE 'MZ%'""",
    "ge_share": """
        SELECT site_id, CAST(sum(CASE WHEN sku_count >= 5 THEN sku_count ELSE 0 END) AS DOUBLE)
          / nullif(sum(sku_count), 0) AS share_ge
        FROM address_density WHERE address_id LIKE 'MZ%' GROUP BY site_id""",
    "address_units": f"""
        SELECT site_id, address_id, {_nd('sku_id')} AS skus, {UNITS} AS units
        FROM address_stock WHERE area = 'MZ' GROUP BY site_id, address_id""",
    "sku_units": f"""
        SELECT site_id, sku_id, {UNITS} AS units, count(DISTINCT address_id) AS addresses
        FROM address_stock WHERE area = 'MZ' GROUP BY site_id, sku_id""",
    "spread": """
        SELECT sku_id, count(DISTINCT address_id) AS addresses FROM address_stock
        WHERE area IN (SELECT area FROM cycle_summary) GROUP BY sku_id""",
    "day_origin": """
        SELECT origin, process, CAST(sum(units) AS BIGINT) AS units, count(DISTINCT item_id) AS items,
          count(*) AS moves, substr(origin, 1, 2) AS origin_area, substr(origin, 4, 1) AS zone,
          substr(origin, 14, 2) AS floor
        FROM movements WHERE day = DATE '2024-01-15' AND origin LIKE 'MZ%' GROUP BY origin, process""",
    "putaway": """
        SELECT destination, process, CAST(sum(units) AS BIGINT) AS units, count(DISTINCT item_id) AS items,
          count(*) AS moves, substr(destination, 1, 2) AS destination_area, substr(destination, 4, 1) AS zone,
          substr(destination, 14, 2) AS floor
        FROM movements WHERE origin LIKE 'MU%' AND process = 'Put away' GROUP BY destination, process""",
    "touch": """
        SELECT nullif(regexp_extract(process, '^[^\\s]+'), '') AS process, place,
          substr(place, 14, 2) AS floor, substr(place, 1, 2) AS area
        FROM (SELECT process, origin AS place FROM movements
              UNION ALL SELECT process, destination FROM movements)""",
}

NEEDS = {
    "placed": ["lines"],
    "count_detail": ["placed"],
    "detail": ["count_detail"],
    "cycle_summary": ["detail"],
    "address_stock": ["placed"],
    "onhand": ["placed"],
    "address_density": ["count_detail"],
    "address_errors": ["detail"],
    "mz": ["address_errors"],
    "ge_share": ["address_density"],
    "address_units": ["address_stock"],
    "sku_units": ["address_stock"],
    "spread": ["address_stock", "cycle_summary"],
    "day_origin": ["movements"],
    "putaway": ["movements"],
    "touch": ["movements"],
}


def _order(name: str, done: list[str]) -> list[str]:
    for need in NEEDS.get(name, []):
        _order(need, done)
    if name not in done:
        done.append(name)
    return done


def _sql(tables: str, body: str, **steps: str) -> str:
    """The body preceded by the input tables it names and its own steps."""
    names: list[str] = []
    for table in tables.split():
        _order(table, names)
    parts = [f"{name} AS ({TABLES[name]})" for name in names]
    parts += [f"{name} AS ({step})" for name, step in steps.items()]
    return f"WITH {', '.join(parts)} {body}"


def _pct(value: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', round_even(({value}) * 100, {digits}))"


def _top2(by: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {by} ORDER BY errors DESC)"
        f" + (count(*) OVER (PARTITION BY {by}, errors) - 1) / 2.0 <= 2"
    )


def _shares(column: str, order: str, by: str = "") -> tuple[str, str]:
    partition = f"PARTITION BY {by}" if by else ""
    # Unknown as soon as one value is; where a measure is never null, the same as a plain sum.
    total = f"CASE WHEN count({column}) OVER ({partition}) = count(*) OVER ({partition}) THEN sum({column}) OVER ({partition}) END"
    running = f"sum({column}) OVER ({partition} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return (
        f"round(CAST({column} AS DOUBLE) / nullif({total}, 0), 6)",
        f"round(CAST({running} AS DOUBLE) / nullif({total}, 0), 6)",
    )


ORACLE: dict[str, str] = {}

# --- cycle-count accuracy -----------------------------------------------------------------

ORACLE["acc_areas"] = _sql("cycle_summary", "SELECT DISTINCT area FROM cycle_summary")
ORACLE["acc_levels"] = _sql("cycle_summary", "SELECT level, count(*) AS n FROM cycle_summary GROUP BY level")
ORACLE["acc_status"] = _sql(
    "cycle_summary",
    "SELECT DISTINCT cycle_count_id, site_id, region, status FROM cycle_summary WHERE status = 'working'",
)
ORACLE["acc_site_table"] = _sql(
    "cycle_summary",
    """SELECT site_id, population, round(accurate, 6) AS accurate, target, round(accurate / population, 6) AS accuracy,
         CASE WHEN target <= accurate / population THEN 'OK' ELSE 'NotOK' END AS goal,
         round(CAST(population AS DOUBLE) / sum(population) OVER (), 6) AS site_weight FROM sites
       UNION ALL
       SELECT 'TOTAL', CAST(sum(population) AS BIGINT), round(sum(accurate), 6),
         (SELECT max(target_region) FROM cycle_summary), round(sum(accurate) / sum(population), 6), NULL, NULL
       FROM sites""",
    sites="""SELECT site_id, CAST(sum(population_size) AS BIGINT) AS population,
               sum((1 - p_hat) * population_size) AS accurate, max(target_site) AS target
             FROM cycle_summary WHERE region = 'BR' AND period = '2024 | 02' AND area = 'MZ' AND p_hat IS NOT NULL
             GROUP BY site_id""",
)
ORACLE["acc_impact"] = _sql(
    "cycle_summary",
    f"""SELECT cycle_count_id, site_id, area, level, region, period, status, population_size,
          round(p_hat, 6) AS p_hat, accurate_tuples, error_tuples, target_site, target_region,
          round(projected_errors, 6) AS projected_errors,
          CAST(site_accurate AS BIGINT) AS site_accurate, CAST(site_population AS BIGINT) AS site_population,
          round(site_errors, 6) AS site_errors, CAST(region_accurate AS BIGINT) AS region_accurate,
          CAST(region_population AS BIGINT) AS region_population, round(total_errors, 6) AS total_errors,
          round(site_accuracy, 6) AS site_accuracy, round(site_error_share, 6) AS site_error_share,
          {_pct('region_accurate / region_population', 1)} AS region_accuracy_label,
          site_accuracy >= target_site AS meets_target,
          CASE WHEN site_accuracy >= target_site THEN '*****' ELSE '' END AS goal_mark, site_label,
          CAST(dense_rank() OVER (ORDER BY round(site_error_share, 9), site_label) AS INTEGER) AS site_order,
          round(area_errors, 6) AS area_errors, round(area_error_share, 6) AS area_error_share, area_label,
          CAST(dense_rank() OVER (ORDER BY round(area_errors * area_strata, 6) DESC, area_label) AS INTEGER)
            AS area_order,
          round(CAST(accurate_tuples AS DOUBLE) / nullif(site_accurate, 0), 6) AS site_part,
          {_pct('CAST(accurate_tuples AS DOUBLE) / nullif(site_accurate, 0)', 1)} AS site_part_label,
          {_pct('target_region', 1)} AS target_region_label
        FROM labeled""",
    strata="""SELECT *, p_hat * population_size AS projected_errors FROM cycle_summary
              WHERE region = 'BR' AND period = '2024 | 02'""",
    totals="""SELECT *,
                sum(accurate_tuples) OVER (PARTITION BY site_id) AS site_accurate,
                sum(population_size) OVER (PARTITION BY site_id) AS site_population,
                sum(projected_errors) OVER (PARTITION BY site_id) AS site_errors,
                sum(projected_errors) OVER (PARTITION BY area) AS area_errors,
                count(*) OVER (PARTITION BY area) AS area_strata,
                sum(accurate_tuples) OVER () AS region_accurate,
                sum(population_size) OVER () AS region_population,
                sum(projected_errors) OVER () AS total_errors FROM strata""",
    shares="""SELECT *, CAST(site_accurate AS DOUBLE) / site_population AS site_accuracy,
                site_errors / total_errors AS site_error_share, area_errors / total_errors AS area_error_share
              FROM totals""",
    labeled=f"""SELECT *, site_id || '    (' || {_pct('site_error_share', 1)} || ')' || chr(10) || 'Target '
                  || {_pct('target_site', 2)} || chr(10) || CASE WHEN site_accuracy >= target_site THEN '*****' ELSE '' END
                  || ' INAC ' || {_pct('site_accuracy', 2)} AS site_label,
                  area || '(' || {_pct('area_error_share', 1)} || ')' AS area_label FROM shares""",
)
ORACLE["err_area_by_region"] = _sql(
    "cycle_summary",
    """SELECT area, br, mx, other, other_region, total_errors, round(CAST(total_errors AS DOUBLE) / sum(total_errors) OVER (), 6)
         AS share FROM areas
       UNION ALL SELECT 'Total', CAST(sum(br) AS BIGINT), CAST(sum(mx) AS BIGINT), CAST(sum(other) AS BIGINT),
         CAST(sum(other_region) AS BIGINT),
         CAST(sum(total_errors) AS BIGINT), 1.0 FROM areas""",
    areas="""SELECT area, CAST(coalesce(sum(error_tuples) FILTER (region = 'BR'), 0) AS BIGINT) AS br,
               CAST(coalesce(sum(error_tuples) FILTER (region = 'MX'), 0) AS BIGINT) AS mx,
               CAST(coalesce(sum(error_tuples) FILTER (region = 'OTHER'), 0) AS BIGINT) AS other,
               CAST(coalesce(sum(error_tuples) FILTER (coalesce(region NOT IN ('BR', 'MX', 'OTHER'), true)), 0) AS BIGINT)
                 AS other_region,
               CAST(sum(error_tuples) AS BIGINT) AS total_errors
             FROM cycle_summary WHERE period = '2024 | 02' AND area <> 'MZ' GROUP BY area""",
)

# --- count divergence ---------------------------------------------------------------------

# Month labels, January to December.
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
MONTH_CASES = " ".join(f"WHEN {number} THEN '{label}'" for number, label in enumerate(MONTHS, start=1))

ORACLE["count_base"] = _sql(
    "detail",
    f"""SELECT market, site_id, area, level, address_id, sku_id, qty_system, qty_counted, divergence_stored, counted_on, category,
          divergence, divergence_type, CAST(count_date AS VARCHAR) AS count_date, month, CASE month {MONTH_CASES} END AS month_label
        FROM detail""",
)
ORACLE["div_area_month"] = _sql(
    "detail",
    "SELECT area, "
    + ", ".join(f'nullif(count(*) FILTER (month = {n}), 0) AS "{m}"' for n, m in enumerate(MONTHS, start=1))
    + ", nullif(count(*) FILTER (month IS NULL), 0) AS month_none FROM detail GROUP BY area",
)
ORACLE["div_level_type_share"] = _sql(
    "detail",
    """SELECT site_id, level, divergence_type, n,
         round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY site_id, level), 6) AS share
       FROM (SELECT site_id, level, divergence_type, count(*) AS n FROM detail
             WHERE market = 'BR' AND month = 2 AND divergence_type <> 'ok' GROUP BY ALL)""",
)
ORACLE["div_site_level_type"] = _sql(
    "detail",
    """SELECT site_id, level, divergence_type, n, CAST(sum(n) OVER () AS BIGINT) AS site_errors,
         site_id || ' (Tuplas error ' || CAST(sum(n) OVER () AS VARCHAR) || ')' AS site_label, 1 AS site_order,
         CASE divergence_type WHEN 'Lost' THEN 1 WHEN 'Found' THEN 2 END AS type_order
       FROM (SELECT site_id, level, divergence_type, count(*) AS n FROM detail
             WHERE market = 'MX' AND area = 'MZ' AND site_id = 'MX01' AND month = 2 AND divergence_type <> 'ok'
             GROUP BY ALL)""",
)
ORACLE["div_market_totals"] = _sql(
    "detail",
    f"""SELECT market, addresses, skus, round(CAST(skus AS DOUBLE) / sum(skus) OVER () * 100, 6) AS skus_pct
        FROM (SELECT market, {_nd('address_id')} AS addresses, {_nd('sku_id')} AS skus
              FROM detail WHERE divergence_stored <> 0 GROUP BY market)""",
)
ORACLE["density_freq"] = _sql(
    "mz",
    f"""SELECT market, site_id, density, errors, round(share, 6) AS share, site_errors,
          CAST(density AS VARCHAR) AS density_label, site_label, {_top2('market, site_id')} AS is_top,
          CAST(dense_rank() OVER (ORDER BY site_errors DESC, site_label) AS INTEGER) AS site_order
        FROM labeled""",
    counts="""SELECT market, site_id, density, CAST(sum(error_skus) AS BIGINT) AS errors FROM mz GROUP BY ALL""",
    kept="""SELECT * FROM counts
            QUALIFY row_number() OVER (PARTITION BY market, site_id ORDER BY density) <= 7""",
    totals="""SELECT *, CAST(errors AS DOUBLE) / nullif(sum(errors) OVER (PARTITION BY market, site_id), 0) AS share,
                CAST(sum(errors) OVER (PARTITION BY market, site_id) AS BIGINT) AS site_errors FROM kept""",
    labeled="""SELECT *, site_id || ' (Tuplas error ' || CAST(site_errors AS VARCHAR) || ')' AS site_label
               FROM totals""",
)
ORACLE["density_bucket_totals"] = _sql(
    "mz",
    """SELECT *, round(CAST(tuples_ge AS DOUBLE) / nullif(tuples_ge + tuples_lt, 0), 6) AS share_ge
       FROM (SELECT market, site_id, CAST(sum(CASE WHEN density >= 5 THEN density ELSE 0 END) AS BIGINT) AS tuples_ge,
               CAST(sum(CASE WHEN density < 5 THEN density ELSE 0 END) AS BIGINT) AS tuples_lt
             FROM mz GROUP BY market, site_id)""",
)
ORACLE["density_bucket_errors"] = _sql(
    "mz ge_share",
    f"""SELECT market, site_id, bucket, errors, round(share, 6) AS share, site_errors,
          round(stock_share_ge, 6) AS stock_share_ge, site_label,
          CAST(errors AS VARCHAR) || chr(10) || ' ' || {_pct('share', 0)} AS bucket_label,
          CAST(dense_rank() OVER (ORDER BY site_errors DESC, site_label) AS INTEGER) AS site_order
        FROM labeled""",
    counts="""SELECT market, site_id, CASE WHEN density >= 5 THEN 'ge' ELSE 'lt' END AS bucket,
                CAST(sum(error_skus) AS BIGINT) AS errors FROM mz GROUP BY ALL""",
    totals="""SELECT *, CAST(errors AS DOUBLE) / nullif(sum(errors) OVER (PARTITION BY market, site_id), 0) AS share,
                CAST(sum(errors) OVER (PARTITION BY site_id) AS BIGINT) AS site_errors FROM counts""",
    joined="""SELECT totals.*, share_ge AS stock_share_ge FROM totals LEFT JOIN ge_share ON totals.site_id IS NOT DISTINCT FROM ge_share.site_id""",
    labeled=f"""SELECT *, site_id || ' (Tuplas error ' || CAST(site_errors AS VARCHAR) || ')' || chr(10)
                  || 'Address stock >= 5 tuplas ' || {_pct('stock_share_ge', 0)} AS site_label FROM joined""",
)
LEVELS = """SELECT market, site_id, level, CAST(sum(skus) AS BIGINT) AS errors
            FROM (SELECT market, site_id, address_id, level,
                    count(DISTINCT sku_id) + max(CAST(sku_id IS NULL AS INTEGER)) AS skus
                  FROM detail WHERE divergence_stored <> 0 AND level <= 7 AND area = 'MZ' GROUP BY ALL)
            GROUP BY market, site_id, level"""
ORACLE["div_level_share"] = _sql(
    "detail",
    """SELECT market, site_id, level, errors, round(CAST(errors AS DOUBLE) / sum(errors) OVER (PARTITION BY site_id), 6)
         AS share, CAST(dense_rank() OVER (ORDER BY round(mean, 9), site_id) AS INTEGER) AS site_order
       FROM (SELECT *, avg(errors) OVER (PARTITION BY site_id) AS mean FROM levels WHERE market = 'BR')""",
    levels=LEVELS,
)
ORACLE["div_level_top2"] = _sql(
    "detail",
    f"""SELECT market, site_id, level, errors, round(CAST(errors AS DOUBLE) / site_errors, 6) AS share, site_errors,
          CAST(level AS VARCHAR) AS level_label, site_label, {_top2('market, site_id')} AS is_top,
          CAST(dense_rank() OVER (ORDER BY site_errors DESC, site_label) AS INTEGER) AS site_order
        FROM (SELECT *, site_id || ' (Tuplas error ' || CAST(site_errors AS VARCHAR) || ')' AS site_label
              FROM (SELECT *, CAST(sum(errors) OVER (PARTITION BY market, site_id) AS BIGINT) AS site_errors
                    FROM levels))""",
    levels=LEVELS,
)
ORACLE["address_error_pivot"] = _sql(
    "address_errors",
    """SELECT market, site_id, address_id, error_skus, ok_skus, error_skus + ok_skus AS density FROM address_errors""",
)
INAC = """SELECT market, site_id, density, error_tuples, ok_tuples,
            1 - CAST(error_tuples AS DOUBLE) / nullif(error_tuples + ok_tuples, 0) AS accuracy
          FROM (SELECT market, site_id, density,
                  CAST(sum(CASE WHEN outcome = 'error' THEN density ELSE 0 END) AS BIGINT) AS error_tuples,
                  CAST(sum(CASE WHEN outcome = 'ok' THEN density ELSE 0 END) AS BIGINT) AS ok_tuples
                FROM mz WHERE market = 'MX' GROUP BY market, site_id, density)
          QUALIFY row_number() OVER (PARTITION BY market, site_id
            ORDER BY CASE WHEN error_tuples > 0 THEN 0 ELSE 1 END, density) <= 7"""
ORACLE["density_inac"] = _sql(
    "mz",
    "SELECT market, site_id, density, error_tuples, ok_tuples, round(accuracy, 6) AS accuracy FROM inac",
    inac=INAC,
)
ORACLE["density_error_share"] = _sql(
    "mz",
    """SELECT market, site_id, density AS sku_per_address, error_tuples, ok_tuples, round(accuracy, 6) AS accuracy,
         round(CAST(error_tuples AS DOUBLE) / nullif(sum(error_tuples) OVER (), 0), 6) AS error_share
       FROM inac WHERE site_id = 'MX01'""",
    inac=INAC,
)
ORACLE["level_type_tuples"] = _sql(
    "detail",
    """SELECT site_id, level, divergence_type, tuples,
         CAST(dense_rank() OVER (ORDER BY total DESC, site_id) AS INTEGER) AS site_order
       FROM (SELECT *, sum(tuples) OVER (PARTITION BY site_id) AS total
             FROM (SELECT site_id, level, divergence_type, CAST(sum(skus) AS BIGINT) AS tuples FROM cells
                   GROUP BY site_id, level, divergence_type))""",
    cells=f"""SELECT site_id, level, address_id, divergence_type, {_nd('sku_id')} AS skus FROM detail
              WHERE market = 'MX' AND area = 'MZ' GROUP BY ALL""",
)
DENSITY_TUPLES = """SELECT market, site_id, density,
    CAST(sum(density) FILTER (outcome = 'error') AS BIGINT) AS tuples_error,
    CAST(sum(density) FILTER (outcome = 'ok') AS BIGINT) AS tuples_ok,
    nullif(count(DISTINCT address_id) FILTER (outcome = 'error'), 0) AS addresses_error,
    nullif(count(DISTINCT address_id) FILTER (outcome = 'ok'), 0) AS addresses_ok
    FROM mz WHERE density <= 7 GROUP BY market, site_id, density"""
ORACLE["density_tuples"] = _sql("mz", DENSITY_TUPLES)
ORACLE["density_error_corr"] = _sql(
    "mz",
    """SELECT site_id, round(r, 6) AS correlation, round(CASE
         WHEN n < 3 OR r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0
         WHEN n = 3 THEN 1 - 2 / pi() * asin(abs(r))
         WHEN n = 4 THEN 1 - abs(r)
         WHEN n = 5 THEN 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r))
         WHEN n = 6 THEN 1 - abs(r) * (1 + (1 - r * r) / 2)
         WHEN n = 7 THEN 1 - 2 / pi() * (asin(abs(r)) + abs(r) * (sqrt(1 - r * r) + sqrt(1 - r * r) ^ 3 * 2 / 3))
         END, 6) AS p_value
       FROM (SELECT site_id, count(*) AS n, CASE WHEN count(*) < 3 OR stddev_pop(tuples_error) = 0
               OR stddev_pop(density) = 0 THEN NULL ELSE corr(tuples_error, density) END AS r
             FROM tuples WHERE tuples_error IS NOT NULL GROUP BY site_id
             UNION ALL SELECT site_id, 0, NULL FROM tuples GROUP BY site_id HAVING count(tuples_error) = 0)""",
    tuples=DENSITY_TUPLES,
)
ORACLE["density_flag_counts"] = _sql(
    "mz",
    """SELECT market, site_id, outcome, density, CAST(sum(density) AS BIGINT) AS tuples
       FROM mz WHERE market = 'BR' AND density <= 7 GROUP BY ALL""",
)
_share, _running = _shares("n", "n DESC, category NULLS LAST")
ORACLE["category_pareto"] = _sql(
    "detail",
    f"""SELECT category, site_id, n, {_share} AS share, {_running} AS running_share
        FROM (SELECT category, site_id, count(*) AS n FROM detail
              WHERE divergence_stored <> 0 AND area = 'MZ' AND site_id = 'MX01' GROUP BY ALL)""",
)

# --- stock layout -------------------------------------------------------------------------

ORACLE["stock_parsed"] = _sql("address_stock", "SELECT * FROM address_stock")
ORACLE["stock_site_units"] = _sql(
    "address_stock", "SELECT site_id, CAST(sum(units) AS BIGINT) AS units FROM address_stock GROUP BY site_id"
)
ORACLE["address_summary"] = _sql("address_units", "SELECT * FROM address_units")
ORACLE["stock_address_rollup"] = _sql(
    "address_units",
    """SELECT *, substr(address_id, 1, 2) AS area, substr(address_id, 4, 1) AS zone, substr(address_id, 6, 3) AS aisle,
         substr(address_id, 10, 3) AS module, TRY_CAST(substr(address_id, 14, 2) AS DOUBLE) AS floor
       FROM address_units""",
)
ORACLE["stock_sku_rollup"] = _sql("sku_units", "SELECT * FROM sku_units")
ORACLE["floor_share_wide"] = _sql(
    "address_units",
    "SELECT site_id, "
    + ", ".join(f"round(max(share) FILTER (floor = {n}), 6) AS floor_{n}" for n in range(1, 10))
    + ", round(max(share) FILTER (floor IS NULL), 6) AS floor_none,"
    + " round(sum(share) FILTER (floor NOT BETWEEN 1 AND 9 OR floor <> round(floor)), 6) AS floor_other FROM shares GROUP BY site_id",
    shares="""SELECT site_id, floor, CAST(units AS DOUBLE) / sum(units) OVER (PARTITION BY site_id) AS share
              FROM (SELECT site_id, TRY_CAST(substr(address_id, 14, 2) AS DOUBLE) AS floor, sum(units) AS units
                    FROM address_units GROUP BY ALL)""",
)


def _box(table: str, column: str, upper: int | None) -> str:
    kept = f"SELECT site_id, {column} AS value FROM {table}" + (f" WHERE {column} <= {upper}" if upper else "")
    return _sql(
        table,
        """SELECT site_id, round(least(min(value) FILTER (inside), q1), 6) AS whisker_low, round(q1, 6) AS q1, round(median, 6) AS median,
             round(q3, 6) AS q3, round(greatest(max(value) FILTER (inside), q3), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
             count(*) AS rows
           FROM (SELECT kept.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                 FROM kept JOIN quartiles q ON kept.site_id IS NOT DISTINCT FROM q.site_id) GROUP BY site_id, q1, median, q3""",
        kept=kept,
        quartiles="""SELECT site_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                       quantile_cont(value, 0.75) AS q3 FROM kept GROUP BY site_id""",
    )


ORACLE["box_sku_per_address"] = _box("address_units", "skus", None)
ORACLE["box_units_per_address"] = _box("address_units", "units", 20)
ORACLE["box_units_per_sku"] = _box("sku_units", "units", 20)
ORACLE["box_addresses_per_sku"] = _box("sku_units", "addresses", 20)

_share, _running = _shares("skus", "aisle", "site_id")
ORACLE["aisle_top10"] = _sql(
    "address_units",
    f"SELECT site_id, aisle, skus, {_share} AS share, {_running} AS running_share FROM aisles",
    counts="""SELECT site_id, substr(address_id, 6, 3) AS aisle, CAST(sum(skus) AS BIGINT) AS skus
              FROM address_units GROUP BY ALL""",
    aisles="SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY aisle) <= 10",
)
ORACLE["stock_overview"] = _sql(
    "address_stock cycle_summary",
    f"""SELECT {UNITS} AS units, {_nd('sku_id')} AS skus, count(DISTINCT address_id) AS addresses
       FROM address_stock WHERE area IN (SELECT area FROM cycle_summary)""",
)
ORACLE["sku_spread"] = _sql("spread", "SELECT * FROM spread")
TOP_SPREAD = "SELECT * FROM spread QUALIFY rank() OVER (ORDER BY addresses DESC) <= 123"
ORACLE["sku_spread_top"] = _sql("spread", TOP_SPREAD)
ORACLE["spread_area_counts"] = _sql(
    "spread",
    """SELECT area, count(*) AS lines FROM address_stock s
       WHERE EXISTS (SELECT 1 FROM top WHERE top.sku_id IS NOT DISTINCT FROM s.sku_id) GROUP BY area""",
    top=TOP_SPREAD,
)
_share, _running = _shares("skus", "addresses")
ORACLE["spread_tail"] = _sql(
    "spread",
    f"""SELECT addresses, skus, share, running_share
        FROM (SELECT addresses, skus, {_share} AS share, {_running} AS running_share,
                row_number() OVER (ORDER BY addresses) AS position
              FROM (SELECT addresses, count(*) AS skus FROM spread GROUP BY addresses)) WHERE position > 10""",
)
TUPLE_BASE = f"""SELECT area, address_id, {_nd('sku_id')} AS skus,
    CASE WHEN count(*) = count(updated) THEN strftime(max(updated), '%Y-%m-%d %H:%M:%S') END AS last_update
    FROM (SELECT *, try_strptime(updated_text, '%d/%m/%Y %H:%M:%S') AS updated FROM address_stock)
    GROUP BY area, address_id"""
ORACLE["tuple_base"] = _sql("address_stock", TUPLE_BASE)
ORACLE["tuple_top50"] = _sql(
    "address_stock", "SELECT * FROM base QUALIFY rank() OVER (ORDER BY skus DESC) <= 50", base=TUPLE_BASE
)
ORACLE["floor_top5"] = _sql(
    "address_stock cycle_summary",
    "SELECT floor, units, round(CAST(units AS DOUBLE) / sum(units) OVER (), 6) AS share FROM top",
    top="""SELECT floor, CAST(sum(units) AS BIGINT) AS units FROM address_stock
           WHERE area IN (SELECT area FROM cycle_summary) GROUP BY floor ORDER BY 2 DESC, 1 LIMIT 5""",
)
ORACLE["insured_mean"] = _sql(
    "address_stock", "SELECT round(avg(insured_value), 6) AS insured_mean FROM address_stock"
)
ORACLE["insured_top_frac"] = _sql(
    "address_stock",
    """SELECT seller_id, insured_value, sku_id, units FROM
         (SELECT *, rank() OVER (ORDER BY insured_value DESC NULLS LAST) AS position, count(*) OVER () AS total
          FROM address_stock)
       WHERE insured_value IS NOT NULL AND position <= CAST(0.01 AS DOUBLE) * total""",
)


def _totals(by: str, where: str) -> str:
    return f"""SELECT {by}, {UNITS} AS units,
                 count(DISTINCT sku_id) + max(CAST(sku_id IS NULL AS INT)) AS skus,
                 count(DISTINCT address_id) + max(CAST(address_id IS NULL AS INT)) AS addresses FROM address_stock WHERE {where} GROUP BY {by}"""


ORACLE["stock_zone_summary"] = _sql("address_stock", _totals("zone", "area = 'MZ'"))
ORACLE["stock_area_summary"] = _sql("address_stock", _totals("area", "true"))
_units, _units_run = _shares("units", "units DESC, floor")
_skus, _skus_run = _shares("skus", "units DESC, floor")
for _name, _without in (("stock_floor_cumulative", "MU"), ("rest_floor_cumulative", "MZ")):
    ORACLE[_name] = _sql(
        "address_stock",
        f"""SELECT *, {_units} AS units_share, {_units_run} AS units_running, {_skus} AS skus_share,
              {_skus_run} AS skus_running FROM floors""",
        floors=_totals("floor", f"area <> '{_without}'"),
    )
_units, _units_run = _shares("units", "floor")
_skus, _skus_run = _shares("skus", "floor")
for _name, _area in (("mz_floor_cumulative", "MZ"), ("mu_floor_cumulative", "MU")):
    ORACLE[_name] = _sql(
        "address_stock",
        f"""SELECT floor, skus, units, {_units} AS units_share, {_units_run} AS units_running, {_skus} AS skus_share,
              {_skus_run} AS skus_running FROM floors""",
        floors=_totals("floor", f"area = '{_area}'"),
    )


def _numbers(tables: str, source: str, measures: list[str], by: str = "") -> str:
    prefix = f"{by}, " if by else ""
    long = " UNION ALL ".join(
        f"SELECT {prefix}'{measure}' AS measure, {measure} AS value FROM source" for measure in measures
    )
    return _sql(
        tables,
        f"""SELECT {prefix}measure, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
              round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean,
              round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max,
              count(*) FILTER (value IS NULL) AS nulls
            FROM long GROUP BY {prefix}measure""",
        source=source,
        long=long,
    )


SKU_SUMMARY = f"""SELECT sku_id, count(DISTINCT address_id) AS addresses, {UNITS} AS units
                 FROM address_stock WHERE area = 'MZ' GROUP BY sku_id"""
ORACLE["address_summary_stats"] = _numbers(
    "address_units", "SELECT * FROM address_units", ["skus", "units"], by="site_id"
)
ORACLE["address_site_counts"] = _sql(
    "address_units", "SELECT site_id, count(*) AS addresses FROM address_units GROUP BY site_id"
)
ORACLE["sku_summary"] = _sql("address_stock", SKU_SUMMARY)
ORACLE["sku_summary_stats"] = _numbers("address_stock", SKU_SUMMARY, ["addresses", "units"])
_share, _running = _shares("skus", "addresses")
ORACLE["sku_hist20"] = _sql(
    "address_stock",
    f"SELECT addresses, skus, {_share} AS share, {_running} AS running_share FROM counts",
    skus=SKU_SUMMARY,
    counts="SELECT addresses, count(*) AS skus FROM skus GROUP BY addresses ORDER BY addresses LIMIT 20",
)
ORACLE["mu_summary_stats"] = _numbers(
    "address_stock",
    f"""SELECT address_id, {_nd('sku_id')} AS skus, {UNITS} AS units
       FROM address_stock WHERE area = 'MU' GROUP BY address_id""",
    ["skus", "units"],
)
ORACLE["onhand_parsed"] = _sql("onhand", "SELECT * FROM onhand")
ORACLE["onhand_site_stats"] = _sql(
    "onhand",
    """SELECT site_id, CASE WHEN whole THEN round(mean, 6) END AS mean_units, lines,
         CASE WHEN whole THEN total END AS units, CASE WHEN whole THEN low END AS min_units,
         CASE WHEN whole THEN high END AS max_units
       FROM (SELECT site_id, count(*) = count(units) AS whole, avg(units) AS mean, count(*) AS lines,
               CAST(sum(units) AS BIGINT) AS total, min(units) AS low, max(units) AS high
             FROM onhand GROUP BY site_id)""",
)
ORACLE["onhand_top6"] = _sql(
    "onhand",
    """SELECT * FROM onhand WHERE units IS NOT NULL QUALIFY rank() OVER (ORDER BY units DESC) <= 6""",
)
ORACLE["site_tuples"] = _sql(
    "address_units", "SELECT site_id, CAST(sum(skus) AS BIGINT) AS tuples FROM address_units GROUP BY site_id"
)

# --- SKU density extract ------------------------------------------------------------------

ORACLE["density_ge5_share"] = _sql("ge_share", "SELECT site_id, round(share_ge, 6) AS share_ge FROM ge_share")
ORACLE["density_hist"] = _sql(
    "address_density",
    """SELECT sku_count, count(*) AS addresses FROM address_density WHERE site_id = 'MX01' GROUP BY sku_count""",
)
ORACLE["density_share_hist"] = _sql(
    "address_density",
    """SELECT site_id, sku_count, addresses, round(share, 6) AS share, density_order
       FROM (SELECT *, CAST(addresses AS DOUBLE) / sum(addresses) OVER (PARTITION BY site_id) AS share,
               CAST(dense_rank() OVER (ORDER BY sku_count) AS INTEGER) AS density_order
             FROM (SELECT site_id, sku_count, count(*) AS addresses FROM address_density
                   WHERE site_id IN ('BR01', 'BR02', 'BRTR1') AND site_id LIKE 'BR%' AND site_id NOT LIKE '%TR%'
                   GROUP BY ALL))
       WHERE sku_count <= 7""",
)
ORACLE["density_market_counts"] = _sql(
    "address_density",
    """SELECT sku_count, site_id, count(*) AS addresses FROM address_density
       WHERE site_id LIKE 'MX%' AND address_id LIKE 'MZ%' GROUP BY ALL""",
)

# --- movement log -------------------------------------------------------------------------

ORACLE["mov_process_totals"] = _sql(
    "movements",
    """SELECT process, CAST(sum(units) AS BIGINT) AS units, count(DISTINCT item_id) AS items
       FROM movements GROUP BY process""",
)
ORACLE["mov_parsed"] = _sql(
    "movements",
    """SELECT process, units, item_id, origin, destination, moved_text, worker_id, substr(origin, 1, 2) AS origin_area,
         substr(destination, 1, 2) AS destination_area, units AS quantity,
         strftime(try_strptime(moved_text, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS moved_at,
         strftime(try_strptime(moved_text, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d') AS moved_on
       FROM movements""",
)
ORACLE["mov_unassigned_origin"] = _sql(
    "movements",
    """SELECT origin, CAST(sum(units) AS BIGINT) AS units, count(DISTINCT day) AS days
       FROM movements WHERE destination = '' AND origin LIKE 'PW%' GROUP BY origin""",
)
ORACLE["mov_touch"] = _sql("touch", "SELECT * FROM touch")
ORACLE["mov_touch_levels"] = _sql(
    "touch",
    """SELECT floor, touches, round(CAST(touches AS DOUBLE) / sum(touches) OVER (), 6) AS share
       FROM (SELECT floor, count(*) AS touches FROM touch WHERE area = 'MZ' GROUP BY floor)""",
)
ORACLE["mov_day_origin"] = _sql("day_origin", "SELECT * FROM day_origin")
ORACLE["mov_level_process"] = _sql(
    "day_origin",
    "SELECT floor, process, CAST(sum(moves) AS BIGINT) AS moves FROM day_origin GROUP BY floor, process",
)
ORACLE["mov_count_daily"] = _sql(
    "movements",
    """SELECT strftime(day, '%Y-%m-%d') AS moved_on, count(DISTINCT item_id) AS items,
         count(DISTINCT worker_id) AS people
       FROM movements WHERE process = 'Cycle count' GROUP BY day""",
)
ORACLE["mov_count_lines"] = _sql("movements", "SELECT * EXCLUDE (day) FROM movements WHERE process = 'Cycle count'")
ORACLE["mov_putaway"] = _sql("putaway", "SELECT * FROM putaway")
ORACLE["mov_putaway_level"] = _sql(
    "putaway",
    "SELECT floor, CAST(sum(items) AS BIGINT) AS items FROM putaway WHERE destination_area <> '' GROUP BY floor",
)
