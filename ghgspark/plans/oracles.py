"""ANSI SQL for the named queries, written against the base tables."""

from __future__ import annotations

_LABEL = """CASE p_type WHEN 'ECONOMY' THEN 'Strom - Produktion' WHEN 'LARGE' THEN 'Electricity'
  WHEN 'STANDARD' THEN 'Erdgas Kessel' WHEN 'PROMO' THEN 'Diesel - Internal logistics'
  WHEN 'SMALL' THEN 'Fernwaerme' ELSE 'Dampf' END"""
_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'electricity' WHEN 'LARGE' THEN 'electricity'
  WHEN 'STANDARD' THEN 'natural_gas' WHEN 'PROMO' THEN 'diesel'
  WHEN 'SMALL' THEN 'Fernwaerme' ELSE 'Dampf' END"""


def _factor(energy_type: str) -> str:
    return (f"CASE {energy_type} WHEN 'electricity' THEN 0.00038 WHEN 'natural_gas' THEN 0.000202 "
            f"WHEN 'diesel' THEN 0.00268 END")


def _source(energy_type: str) -> str:
    return (f"CASE {energy_type} WHEN 'electricity' THEN 'UBA Emissionsfaktoren' "
            f"WHEN 'natural_gas' THEN 'Synthetic ESG Report (demo data)' "
            f"WHEN 'diesel' THEN 'Synthetic ESG Report (demo data)' END")


_LINES = f"""lines AS (
  SELECT l.*, o_orderdate, n_name AS site, strftime(o_orderdate, '%Y-%m') AS month, {_TYPE} AS energy_type,
    CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_SPAN = """CASE WHEN months > 12 THEN 'Data spans ' || months || ' months (' || lo || ' to ' || hi
  || '). VSME is annual reporting. Consider filtering input.' ELSE '' END"""


def _b3(source: str, by: str, turnover: str | None = None, qty: str = "qty", emitted: str | None = None,
        months: tuple[str, str] = ("month", "month")) -> str:
    """Report over a CTE ``source``; ``emitted`` is a DECIMAL expression."""
    emitted = emitted or f"{qty} * {_factor('energy_type')}"

    def total(value: str, *types: str) -> str:
        listed = ", ".join(f"'{t}'" for t in types)
        return f"coalesce(sum(CASE WHEN energy_type IN ({listed}) THEN {value} END), 0)"

    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    lo, hi = months
    extra = f", CAST({turnover} AS DOUBLE) AS turnover_eur" if turnover else ""
    return f"""sums AS (
  SELECT {keys}count(*) AS records_count, min({lo}) AS lo, max({hi}) AS hi,
    {total(qty, 'electricity')} AS e, {total(qty, 'natural_gas')} AS g, {total(qty, 'diesel')} AS d,
    {total(emitted, 'natural_gas', 'diesel')} AS s1, {total(emitted, 'electricity')} AS s2
  FROM {source} {group}),
kinds AS (
  SELECT {keys}energy_type, 'Unknown energy type ''' || energy_type || ''' with '
    || printf('%.1f', CAST(sum({qty}) AS DOUBLE)) || ' consumption excluded from MWh total' AS text
  FROM {source} WHERE energy_type NOT IN ('electricity', 'natural_gas', 'diesel') GROUP BY {keys}energy_type),
outside AS (SELECT {keys}string_agg(text, '; ' ORDER BY energy_type) AS unknown FROM kinds {group}),
spans AS (SELECT *, (CAST(substr(hi, 1, 4) AS INT) - CAST(substr(lo, 1, 4) AS INT)) * 12
    + CAST(substr(hi, 6, 2) AS INT) - CAST(substr(lo, 6, 2) AS INT) AS months FROM sums)
SELECT {keys}records_count, lo AS period_start, hi AS period_end,
  CAST(round(e * 0.001, 2) AS DOUBLE) AS electricity_mwh, CAST(round(g * 0.001, 2) AS DOUBLE) AS gas_mwh,
  CAST(round(d * 0.010033, 2) AS DOUBLE) AS diesel_mwh,
  CAST(round(e * 0.001 + g * 0.001 + d * 0.010033, 2) AS DOUBLE) AS total_energy_mwh,
  CAST(round(s1, 2) AS DOUBLE) AS scope1_tco2eq, CAST(round(s2, 2) AS DOUBLE) AS scope2_tco2eq,
  concat_ws('; ', unknown, nullif({_SPAN}, '')) AS warnings{extra}
FROM spans {f"LEFT JOIN outside USING ({by})" if by else ", outside"}"""


_ORDER = "{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_shipdate, 'e': l_extendedprice}"

# One row per order: Q7's first type with total consumption; zero or untyped gives null emissions.
_RECORDS = f"""typed AS (
  SELECT l.*, {_TYPE} AS t FROM lineitem l JOIN part ON l_partkey = p_partkey),
totals AS (
  SELECT l_orderkey, sum(l_quantity) AS c, arg_min(t, {_ORDER}) AS t,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM typed GROUP BY l_orderkey),
records AS (
  SELECT 'INV-' || o_orderkey || '.pdf' AS filename, sha256('INV-' || o_orderkey || '.pdf') AS pdf_hash,
    'Grid Supply AG' AS vendor_name, c_name AS customer_name, n_name AS site,
    'R-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
    strftime(o_orderdate, '%Y-%m') AS billing_period_from, strftime(o_orderdate, '%Y-%m') AS billing_period_to,
    t AS energy_type, coalesce(c, 0.0) AS consumption_kwh,
    CASE WHEN t = 'diesel' THEN 'litres' ELSE 'kWh' END AS consumption_unit,
    CAST(amount AS DOUBLE) AS total_eur, 'EUR' AS currency,
    CASE WHEN coalesce(c, 0) <> 0 THEN coalesce(c, 0.0) * CAST({_factor('t')} AS DOUBLE) END AS emissions_tco2,
    CAST({_factor('t')} AS DOUBLE) AS emission_factor_value, {_source('t')} AS emission_factor_source
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN totals ON l_orderkey = o_orderkey)"""


def _float(value: str) -> str:
    """Text of a double below 1e7, as the summary prints it."""
    return f"CAST(CAST({value} AS DOUBLE) AS VARCHAR)"


_CONTENT = f"""'Invoice ' || filename || ' for site ' || site || ' covers period ' || billing_period_from || ' to '
  || billing_period_to || ' for ' || coalesce(energy_type, 'unknown') || ' energy. Energy amount is '
  || {_float('consumption_kwh')} || ' ' || consumption_unit || '. Total cost is '
  || CASE WHEN coalesce(total_eur, 0) = 0 THEN 'unknown' ELSE {_float('total_eur')} END || ' EUR.'"""

# --- exports -----------------------------------------------------------------------------

_EXPORTS = f"""typed AS (
  SELECT l.*, p_type FROM lineitem l JOIN part ON l_partkey = p_partkey),
totals AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount,
    sum(CAST(l_quantity AS DECIMAL(18,2))) AS cost, arg_min(p_type, {_ORDER}) AS p_type
  FROM typed GROUP BY l_orderkey),
laid AS (
  SELECT *, 'export_' || lower(n_name) || '.csv' AS file, n_nationkey % 5 <> 4 AS has_header,
    n_nationkey % 3 = 1 OR n_nationkey % 2 = 1 AS english,
    row_number() OVER (PARTITION BY n_nationkey ORDER BY o_orderkey) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN totals ON l_orderkey = o_orderkey),
valued AS (
  SELECT *, has_header AND o_orderkey % 17 = 0 AS short,
    CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'electricity' WHEN p_type = 'STANDARD' THEN 'natural_gas'
      WHEN p_type = 'PROMO' THEN 'diesel' WHEN p_type = 'SMALL' OR NOT has_header THEN 'district_heating'
      ELSE 'unknown' END AS energy_type,
    CASE WHEN p_type IN ('ECONOMY', 'LARGE') AND o_orderkey % 3 = 0 THEN 'MWh'
      WHEN p_type = 'STANDARD' AND o_orderkey % 3 = 1 THEN 'm3' WHEN p_type = 'PROMO' THEN 'Liter'
      ELSE 'kWh' END AS unit,
    CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m') END AS period
  FROM laid),
good AS (
  SELECT *, amount * CASE unit WHEN 'MWh' THEN 1000.00 WHEN 'm3' THEN 10.55 ELSE 1.00 END AS kwh
  FROM valued WHERE NOT short)"""

# --- invoices --------------------------------------------------------------------------------

_FACTS = f"""facts AS (
  SELECT o_orderkey, l_suppkey, l_partkey, o_custkey, c_name, n_name, o_orderdate,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS doc_id,
    o_orderkey % 2 = 0 AS english, o_orderkey % 3 = 0 AS has_table, {_LABEL} AS label, {_TYPE} AS energy_type,
    CAST(l_quantity AS BIGINT) * 100 AS consumption, p_size AS heat,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(p_size * 0.5 AS DECIMAL(18,2)) AS heat_amount,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS levies,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.19, 2) AS DECIMAL(18,2)) AS vat,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day,
    strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_ITEMS = f"""WITH {_FACTS}
SELECT doc_id AS invoice_number, 1 AS line_no, 'M-' || l_partkey || '-A' AS meter_id, energy_type,
  first_day AS period_from, last_day AS period_to, CAST(consumption AS DOUBLE) AS consumption_kwh,
  0.181::DOUBLE AS unit_price, CAST(amount AS DOUBLE) AS amount_eur,
  CASE WHEN energy_type = 'diesel' THEN 'litres' ELSE 'kWh' END AS consumption_unit FROM facts
UNION ALL
SELECT doc_id, 2, 'H-' || l_partkey || '-B', 'Fernwaerme Umlage', first_day, last_day, CAST(heat AS DOUBLE),
  0.5::DOUBLE, CAST(heat_amount AS DOUBLE), 'kWh' FROM facts"""

_NO_NUMBER = "No invoice number found - file may not be an invoice"

# --- retrieval ---------------------------------------------------------------------------------


def _embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in ``name(key, v DOUBLE[64])``: the hashed term vectors of a text column."""
    return f"""{name}_terms AS (
  SELECT {key}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {source}),
{name}_counts AS (
  SELECT {key}, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64 AS b, count(*) AS c
  FROM {name}_terms WHERE term <> '' GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(CAST(sum(c * c) AS DOUBLE)) AS norm FROM {name}_counts GROUP BY {key}),
{name}_maps AS (
  SELECT {key}, map(list(b), list(CAST(CAST(c / norm AS FLOAT) AS DOUBLE))) AS m
  FROM {name}_counts JOIN {name}_norms USING ({key}) GROUP BY {key}),
{name} AS (
  SELECT s.{key}, list_transform(range(64), lambda d: coalesce(m[CAST(d AS INT)], 0.0)) AS v
  FROM {source} s LEFT JOIN {name}_maps USING ({key}))"""


def _hits(where: str = "true") -> str:
    return f"""{_RECORDS},
documents_of AS (SELECT *, {_CONTENT} AS content FROM records WHERE {where}),
{_embedded('documents_of', 'pdf_hash', 'content', 'stored')},
questions AS (SELECT conv_id || '-' || turn AS query_id, text AS question FROM conversations WHERE role = 'user'),
{_embedded('questions', 'query_id', 'question', 'asked')},
pairs AS (
  SELECT query_id, pdf_hash, list_distance(asked.v, stored.v) AS d FROM asked, stored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, pdf_hash) AS rank FROM pairs
  QUALIFY rank <= 4),
hits AS (SELECT ranked.*, documents_of.* EXCLUDE (pdf_hash) FROM ranked JOIN documents_of USING (pdf_hash)),
metas AS (
  SELECT query_id, rank, d, filename, site, coalesce(energy_type, '') AS energy_type, content,
    billing_period_from AS period, coalesce(total_eur, 0.0) AS total_eur, consumption_kwh,
    coalesce(emissions_tco2, 0.0) AS emissions_tco2
  FROM hits)"""


def _knn(where: str, k: int = 4, cosine: bool = False) -> str:
    distance = (
        "1 - list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])" if cosine
        else "pow(list_distance(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 2)"
    )
    return f"""WITH pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS id, {distance} AS d
  FROM embeddings q, embeddings x WHERE {where})
SELECT query_id, id, round(d, 4) AS distance,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank
FROM pairs QUALIFY rank <= {k}"""


_BLOCK = """'=== DOCUMENT ' || rank || ' ===' || chr(10) || 'Source: ' || filename || chr(10) || 'Site: ' || site
  || chr(10) || 'Period: ' || period || ' to ' || period || chr(10) || 'Energy type: ' || energy_type || chr(10)
  || '---' || chr(10) || content || chr(10) || '=================='"""

_METRICS = (("Total cost", "total_eur", "EUR"), ("Consumption", "consumption_kwh", "kWh"),
            ("Emissions", "emissions_tco2", "tCO2"))

_ENDS = """ends AS (
  SELECT {keys}energy_type, count(*) AS invoices,
    arg_min(struct_pack(period, total_eur, consumption_kwh, emissions_tco2), {{'p': period, 'r': {tie}}}) AS f,
    arg_max(struct_pack(period, total_eur, consumption_kwh, emissions_tco2), {{'p': period, 'r': {tie}}}) AS l
  FROM {source} WHERE coalesce(energy_type, '') <> '' GROUP BY {keys}energy_type HAVING count(*) >= 2)"""


def _change_rows(keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}energy_type, invoices, f.period AS first_period, l.period AS last_period, "
        f"'{label}' AS metric, '{unit}' AS unit, f.{field} AS a, l.{field} AS b FROM ends"
        for label, field, unit in _METRICS
    )


def _section() -> str:
    """Section text of a group with its hits listed in order as ``h``."""

    def change(field: str, unit: str) -> str:
        a, b = f"h[1].{field}", f"h[-1].{field}"
        return (
            f"' (diff: ' || printf('%+.2f', {b} - {a}) || ' {unit}' || CASE WHEN {a} <> 0 THEN ', ' || "
            f"printf('%+.2f', ({b} - {a}) / {a} * 100) || '%' ELSE '' END || ')'"
        )

    def value(expression: str) -> str:
        return f"printf('%.2f', {expression})"

    pair = " || ".join(
        f"chr(10) || '  {label}: ' || {value(f'h[1].{field}')} || ' {unit} -> ' || {value(f'h[-1].{field}')} "
        f"|| ' {unit}' || {change(field, unit)}" for label, field, unit in _METRICS
    )
    lists = " || ".join(
        f"chr(10) || '  {label}: ' || list_aggregate(list_transform(h, lambda x: {value(f'x.{field}')}), "
        f"'string_agg', ' -> ') || ' {unit}'" for label, field, unit in _METRICS
    )
    ends = " || ".join(
        f"chr(10) || '  First vs Last -- {label}: ' || {value(f'h[1].{field}')} || ' -> ' || "
        f"{value(f'h[-1].{field}')} || ' {unit}' || {change(field, unit)}" for label, field, unit in _METRICS
    )
    return f"""CASE WHEN len(h) = 2 THEN '[' || energy_type || '] ' || h[1].period || ' -> ' || h[-1].period
    || ' (2 invoices)' || {pair}
  ELSE '[' || energy_type || '] ' || len(h) || ' invoices: '
    || list_aggregate(list_transform(h, lambda x: x.period), 'string_agg', ', ') || {lists} || {ends} END"""


_GROUPS = """groups AS (
  SELECT query_id, energy_type, list(struct_pack(period, total_eur, consumption_kwh, emissions_tco2)
    ORDER BY period, rank) AS h
  FROM metas WHERE energy_type <> '' GROUP BY query_id, energy_type HAVING count(*) >= 2)"""
_ANALYTICS = f"""{_GROUPS},
sections AS (SELECT query_id, energy_type, {_section()} AS section FROM groups),
analytics AS (
  SELECT query_id, '=== COMPUTED ANALYTICS ===' || chr(10) || chr(10)
    || string_agg(section, chr(10) || chr(10) ORDER BY energy_type) AS analytics
  FROM sections GROUP BY query_id)"""

_LATEST = """numbered AS (SELECT *, sha256(text) AS id, printf('doc-%010d', doc_id) AS filename FROM documents),
latest AS (
  SELECT id, max(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN filename END) AS relabelled,
    max(filename) AS filename, max(length(text)) AS chars
  FROM numbered GROUP BY id)"""

_LONG = (
    ("TotalEnergyConsumption", "total_energy_mwh", "NULL"),
    ("EnergyConsumptionFromElectricity_NonRenewableEnergyMember", "electricity_mwh", "NULL"),
    ("EnergyConsumptionFromElectricity_RenewableEnergyMember", "0.0", "NULL"),
    ("EnergyConsumptionFromSelfGeneratedElectricity_RenewableEnergyMember", "0.0", "NULL"),
    ("EnergyConsumptionFromSelfGeneratedElectricity_NonRenewableEnergyMember", "0.0", "NULL"),
    ("GrossScope1GreenhouseGasEmissions", "scope1_tco2eq", "NULL"),
    ("GrossLocationBasedScope2GreenhouseGasEmissions", "scope2_tco2eq", "NULL"),
    ("Environmental Disclosures!G10", "NULL", "true"),
    ("Environmental Disclosures!G29", "NULL", "false"),
    ("Fuel Converter!D23", "NULL", "false"),
)


def _folded(column: str) -> str:
    for old, new in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("é", "e")):
        column = f"replace({column}, '{old}', '{new}')"
    return column


_EXACT_RECORD_EMISSIONS = f"""CASE WHEN consumption_kwh <> 0 THEN
  CAST(consumption_kwh AS DECIMAL(18,2)) * {_factor('energy_type')} END"""

ORACLES: dict[str, str] = {
    "b3_totals": f"WITH {_LINES}, {_b3('lines', '')}",
    "b3_by_site": f"WITH {_LINES}, {_b3('lines', 'site')}",
    "b3_from_invoices": f"WITH {_RECORDS}, " + _b3(
        "records", "site", "1000000", "CAST(consumption_kwh AS DECIMAL(18,2))", _EXACT_RECORD_EMISSIONS,
        ("billing_period_from", "billing_period_to"),
    ),
    "b3_long": f"WITH {_LINES}, report AS (WITH {_b3('lines', 'site')}) " + " UNION ALL ".join(
        f"SELECT site, '{name}' AS named_range, CAST({value} AS DOUBLE) AS value_double, "
        f"CAST({flag} AS BOOLEAN) AS value_bool FROM report" for name, value, flag in _LONG
    ),
    "b3_totals_by_type": f"""WITH {_LINES}
SELECT site, energy_type, CAST(sum(qty) AS DOUBLE) AS consumption_kwh,
  CAST(coalesce(sum(qty * {_factor('energy_type')}), 0) AS DOUBLE) AS emissions_tco2
FROM lines GROUP BY site, energy_type""",
    "b3_unknown_types": f"""WITH {_LINES}
SELECT site, energy_type, CAST(sum(qty) AS DOUBLE) AS consumption_kwh, 'Unknown energy type ''' || energy_type
  || ''' with ' || printf('%.1f', CAST(sum(qty) AS DOUBLE)) || ' consumption excluded from MWh total' AS warning
FROM lines WHERE energy_type IN ('Fernwaerme', 'Dampf') GROUP BY site, energy_type""",
    "b3_period_range": f"""WITH {_LINES}, r AS (SELECT site, min(month) AS lo, max(month) AS hi FROM lines GROUP BY site)
SELECT site, lo AS period_start, hi AS period_end,
  date_diff('month', CAST(lo || '-01' AS DATE), CAST(hi || '-01' AS DATE)) AS months FROM r""",
    "b3_span_warning": f"WITH {_LINES}, report AS (WITH {_b3('lines', 'site')}) "
                       "SELECT site, 'Data spans' || split_part(warnings, 'Data spans', 2) AS warning FROM report "
                       "WHERE contains(warnings, 'Data spans')",
    "invoice_records": f"WITH {_RECORDS} SELECT * REPLACE (round(emissions_tco2, 6) AS emissions_tco2) FROM records",
    "invoice_records_per_line": f"""WITH {_LINES}
SELECT l_orderkey AS invoice_id, sum(l_quantity) AS consumption_kwh, arg_min(energy_type, {_ORDER}) AS energy_type,
  CASE WHEN arg_min(energy_type, {_ORDER}) = 'diesel' THEN 'litres' ELSE 'kWh' END AS consumption_unit,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_eur,
  round(CAST(sum(CASE WHEN qty <> 0 THEN qty * {_factor('energy_type')} END) AS DOUBLE), 6) AS emissions_tco2
FROM lines GROUP BY l_orderkey""",
    "factor_usage": f"""WITH {_LINES}
SELECT energy_type, CAST({_factor('energy_type')} AS DOUBLE) AS emission_factor_value,
  {_source('energy_type')} AS emission_factor_source, count(*) AS lines, sum(l_quantity) AS consumption_kwh
FROM lines GROUP BY energy_type""",
    "record_content": f"WITH {_RECORDS} SELECT filename, {_CONTENT} AS content FROM records",
    "record_summary": f"""WITH {_RECORDS}
SELECT filename, coalesce(energy_type, '?') AS energy_type, consumption_kwh,
  format('{{:,}}', CAST(round_even(consumption_kwh, 0) AS BIGINT)) AS consumption_text, consumption_unit,
  CASE WHEN coalesce(total_eur, 0) = 0 THEN '?' ELSE {_float('total_eur')} END AS total_text,
  CASE WHEN coalesce(consumption_kwh, 0) = 0 OR emission_factor_value IS NULL THEN 'n/a'
    ELSE printf('%.3f', coalesce(emissions_tco2, 0)) || ' tCO2e' END AS emissions_text
FROM records""",
    "metadata_defaults": f"""WITH {_RECORDS}
SELECT pdf_hash AS id, filename, site, coalesce(energy_type, '') AS energy_type, billing_period_from,
  billing_period_to, consumption_kwh, coalesce(total_eur, 0.0) AS total_eur,
  round(coalesce(emissions_tco2, 0.0), 6) AS emissions_tco2, currency, invoice_number, vendor_name, consumption_unit
FROM records""",
    "record_union": f"""WITH {_EXPORTS}, exported AS (SELECT * FROM good), {_RECORDS.replace('typed AS', 'typed2 AS')
    .replace('FROM typed ', 'FROM typed2 ').replace('totals AS', 'totals2 AS').replace('JOIN totals ', 'JOIN totals2 ')},
both_kinds AS (
  SELECT vendor_name, energy_type, CAST(consumption_kwh AS DECIMAL(28,8)) AS c,
    CAST({_EXACT_RECORD_EMISSIONS} AS DECIMAL(28,8)) AS e FROM records
  UNION ALL
  SELECT 'SAP Export', energy_type, CAST(kwh AS DECIMAL(28,8)), CAST(kwh * {_factor('energy_type')} AS DECIMAL(28,8))
  FROM exported)
SELECT vendor_name, energy_type, count(*) AS records, CAST(round(sum(c), 2) AS DOUBLE) AS consumption_kwh,
  CAST(round(sum(e), 2) AS DOUBLE) AS emissions_tco2 FROM both_kinds GROUP BY vendor_name, energy_type""",
    "run_counters": """SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  + (SELECT count(*) FROM documents) AS total_files,
  (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) + (SELECT count(*) FROM documents) AS pdf_files,
  (SELECT count(DISTINCT c_nationkey) FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey) AS csv_files,
  (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS successful,
  (SELECT count(*) FROM documents) AS failed""",
    "energy_type_invoice": f"""SELECT {_LABEL} AS raw_label, {_TYPE} AS energy_type, count(*) AS lines
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "energy_type_sap": """SELECT CASE p_type WHEN 'ECONOMY' THEN ' STROM ' WHEN 'LARGE' THEN ' ELECTRICITY '
  WHEN 'STANDARD' THEN ' ERDGAS ' WHEN 'PROMO' THEN ' DIESEL ' WHEN 'SMALL' THEN ' FERNWAERME ' ELSE ' DAMPF ' END AS label,
  CASE p_type WHEN 'ECONOMY' THEN 'electricity' WHEN 'LARGE' THEN 'electricity' WHEN 'STANDARD' THEN 'natural_gas'
  WHEN 'PROMO' THEN 'diesel' WHEN 'SMALL' THEN 'district_heating' ELSE 'unknown' END AS energy_type, count(*) AS lines
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "period_normalize": """SELECT o_orderkey,
  CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2030 THEN strftime(o_orderdate, '%Y-%m') END AS period FROM orders""",
    # A trailing 'x' spoils every shape.
    "period_rejects": """SELECT o_orderkey % 8 AS shape, count(*) AS texts,
  count(*) FILTER (WHERE o_orderkey % 5 = 0 OR year(o_orderdate) < 2000) AS rejected FROM orders GROUP BY ALL""",
    "number_german": """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
  count(*) AS parsed FROM lineitem GROUP BY l_returnflag""",
    "unit_convert": """WITH u AS (
  SELECT CASE l_linenumber % 7 WHEN 0 THEN 'kWh' WHEN 1 THEN 'MWh' WHEN 2 THEN 'm3' WHEN 3 THEN 'Liter'
    WHEN 4 THEN 'm3' WHEN 5 THEN 'kWh' ELSE 'GJ' END AS unit, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)
SELECT unit, count(*) AS lines,
  CAST(sum(q * CASE unit WHEN 'MWh' THEN 1000.00 WHEN 'm3' THEN 10.55 ELSE 1.00 END) AS DOUBLE) AS amount
FROM u GROUP BY unit""",
    "umlaut_fold": f"SELECT doc_id, length({_folded('text')}) AS chars, md5({_folded('text')}) AS digest FROM documents",
    "date_de_to_iso": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "first_line_vendor": r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')[1] AS vendor FROM documents""",
    "fixed_decimals": """SELECT printf('%.4f', l_quantity * 0.00038::DOUBLE - 0.005::DOUBLE) AS four,
  printf('%+.2f', l_quantity * 0.00038::DOUBLE - 0.005::DOUBLE) AS two, count(*) AS lines FROM lineitem GROUP BY ALL""",
    "encoding_profile": r"""SELECT 'doc-' || doc_id || '.csv' AS file,
  CASE WHEN doc_id % 2 = 1 AND regexp_matches(text, '[^\x00-\x7f]') AND NOT regexp_matches(text, '[^\x00-\x{ff}]')
    THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding FROM documents""",
    "delimiter_profile": f"""WITH {_EXPORTS}
SELECT DISTINCT file, CASE WHEN n_nationkey % 4 = 1 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding,
  CASE n_nationkey % 3 WHEN 0 THEN ';' WHEN 1 THEN ',' ELSE chr(9) END AS delimiter FROM laid""",
    "number_format_profile": f"""WITH {_EXPORTS}
SELECT DISTINCT file, has_header, CASE WHEN english THEN 'english' ELSE 'german' END AS number_format FROM laid""",
    "column_profile": f"""WITH {_EXPORTS}
SELECT DISTINCT file, CASE WHEN has_header THEN 9 ELSE 6 END AS min_cells, 0 AS site_column, 1 AS period_column,
  2 AS energy_type_column, 3 AS energy_amount_column, 4 AS unit_column, 5 AS total_eur_column,
  CASE WHEN has_header THEN 6 END AS currency_column, CASE WHEN has_header THEN 7 END AS meter_id_column,
  CAST(NULL AS INT) AS cost_center_column, CASE WHEN has_header THEN 8 END AS remarks_column FROM laid""",
    "sap_ingest": f"""WITH {_EXPORTS}
SELECT 'SAP-export_' || lower(n_name) || '-R' || n AS invoice_number, n_name AS site, period, energy_type,
  round(CAST(kwh AS DOUBLE), 4) AS consumption_kwh, unit, CAST(cost AS DOUBLE) AS total_eur, 'EUR' AS currency,
  CASE WHEN has_header THEN 'M-' || o_orderkey END AS meter_id FROM good""",
    "sap_raw_text": f"""WITH {_EXPORTS}, cells AS (
  SELECT *, CASE CASE WHEN has_header THEN o_orderkey % 8 ELSE o_orderkey % 4 END
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%m.%Y')
      WHEN 2 THEN strftime(o_orderdate, '%Y%m') WHEN 3 THEN 'P' || strftime(o_orderdate, '%m/%Y')
      WHEN 4 THEN strftime(o_orderdate, '%m/%Y')
      WHEN 5 THEN ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober',
        'November', 'Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate)
      WHEN 6 THEN strftime(o_orderdate, '%B %Y') ELSE ' ' || strftime(o_orderdate, '%Y-%m') || ' ' END AS period_cell,
    CASE p_type WHEN 'ECONOMY' THEN 'Strom' WHEN 'LARGE' THEN 'Electricity' WHEN 'STANDARD' THEN 'Erdgas'
      WHEN 'PROMO' THEN 'Diesel' WHEN 'SMALL' THEN 'Fernwaerme'
      ELSE CASE WHEN has_header THEN 'Dampf' ELSE 'Fernwaerme' END END AS label,
    CASE WHEN english THEN CAST(amount AS VARCHAR) ELSE replace(CAST(amount AS VARCHAR), '.', ',') END AS amount_cell,
    CASE WHEN english THEN CAST(cost AS VARCHAR) ELSE replace(CAST(cost AS VARCHAR), '.', ',') END AS cost_cell,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Hauptzähler' || CASE n_nationkey % 3 WHEN 0 THEN ';' WHEN 1 THEN ',' ELSE chr(9) END
      || ' "Nord"' ELSE 'Hauptzähler Süd' END AS remark FROM good)
SELECT file || ':row_' || n AS blob_name, md5(concat_ws(';', n_name, period_cell, label, amount_cell, unit, cost_cell,
  'EUR', 'M-' || o_orderkey, remark)) AS raw_digest FROM cells""",
    "sap_row_ids": f"""WITH {_EXPORTS}
SELECT file AS filename, file || ':row_' || n AS blob_name, sha256(file || ':row_' || n) AS row_hash,
  'SAP-export_' || lower(n_name) || '-R' || n AS invoice_number FROM good""",
    "sap_short_rows": f"WITH {_EXPORTS} SELECT file, count(*) FILTER (WHERE short) AS skipped_rows FROM valued GROUP BY file",
    "sap_warnings": f"""WITH {_EXPORTS}
SELECT file AS filename, count(*) FILTER (WHERE period IS NULL) AS warnings,
  count(DISTINCT CASE WHEN period IS NULL THEN CASE WHEN has_header THEN
    CASE WHEN o_orderkey % 8 = 7 THEN 0 WHEN o_orderkey % 8 = 6 AND month(o_orderdate) IN (4, 8, 9, 11) THEN 5
      ELSE o_orderkey % 8 END ELSE o_orderkey % 4 END
    || strftime(o_orderdate, '%Y-%m') END) AS kinds
FROM good GROUP BY file HAVING count(*) FILTER (WHERE period IS NULL) > 0""",
    "sap_b3": f"WITH {_EXPORTS}, named AS (SELECT *, n_name AS site FROM good), " + _b3(
        "named", "site", qty="kwh", months=("period", "period")
    ),
    "invoice_headers": f"""WITH {_FACTS}
SELECT doc_id AS invoice_number,
  CASE WHEN english THEN 'Supplier ' || l_suppkey || ' Energy GmbH' ELSE 'Stadtwerk ' || l_suppkey || ' AG' END AS vendor_name,
  c_name AS customer_name, n_name AS site_address, 'Street ' || o_custkey || ', ' || n_name AS address,
  CASE WHEN english THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS invoice_date,
  CASE WHEN english THEN 'USD' ELSE 'CHF' END AS currency, first_day AS billing_period_from,
  last_day AS billing_period_to, true AS success FROM facts""",
    "invoice_totals": f"""WITH {_FACTS}
SELECT doc_id AS invoice_number, CAST(amount + heat_amount AS DOUBLE) AS subtotal, CAST(levies AS DOUBLE) AS network_levies,
  CAST(vat AS DOUBLE) AS vat_amount, CAST(amount + heat_amount + levies + vat AS DOUBLE) AS total_amount FROM facts""",
    "invoice_rejects": f"""SELECT 'doc-' || doc_id || '.pdf' AS filename, 'parse_error' AS error_type,
  '{_NO_NUMBER}' AS message FROM documents""",
    "invoice_lines_text": _ITEMS,
    "invoice_lines_table": _ITEMS,
    "invoice_lines_fallback": f"""WITH {_FACTS}
SELECT 'Falling back to text-based line item extraction' AS warning, count(*) AS documents,
  2 * count(*) AS items FROM facts WHERE NOT has_table""",
    "invoice_document_records": f"""WITH {_FACTS}
SELECT doc_id || '.pdf' AS filename, sha256(doc_id) AS pdf_hash, energy_type,
  CAST(consumption + heat AS DOUBLE) AS consumption_kwh,
  CASE WHEN energy_type = 'diesel' THEN 'litres' ELSE 'kWh' END AS consumption_unit,
  CAST(amount + heat_amount + levies + vat AS DOUBLE) AS total_eur,
  CASE WHEN english THEN 'USD' ELSE 'CHF' END AS currency,
  round(CAST((consumption + heat) * {_factor('energy_type')} AS DOUBLE), 6) AS emissions_tco2 FROM facts""",
    "admission": """WITH stored AS (
  SELECT 'doc-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.csv' END AS file,
    CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'csv' END AS kind, CAST(strlen(text) AS BIGINT) * 1000 AS length
  FROM documents),
checked AS (
  SELECT *, CASE WHEN kind = 'pdf' AND length = 0 THEN 'Empty file: ' || file
    WHEN kind = 'pdf' AND length > 10000000 THEN 'File too large (>10 MB): ' || file END AS error FROM stored)
SELECT file, kind, length, error IS NULL AND length > 0 AS admitted, error FROM checked
UNION ALL
SELECT 'page-' || page_id || '.pdf', 'pdf', NULL, false, 'File not found: page-' || page_id || '.pdf' FROM pages""",
    "records_csv_roundtrip": f"""WITH {_RECORDS}
SELECT * EXCLUDE (pdf_hash, vendor_name) REPLACE (
  CAST(printf('%.4f', emissions_tco2) AS DOUBLE) AS emissions_tco2,
  CAST(printf('%.4f', emission_factor_value) AS DOUBLE) AS emission_factor_value) FROM records""",
    "index_upsert": f"""WITH {_LATEST}
SELECT id, coalesce(relabelled, filename) AS filename, CASE WHEN relabelled IS NULL THEN '' ELSE 'relabelled' END AS site,
  chars FROM latest""",
    "index_status": "SELECT 'ok' AS status, 'energy_records' AS collection, count(DISTINCT text) AS count FROM documents",
    "index_reset": "SELECT 'ok' AS status, 'energy_records' AS collection, CAST(0 AS BIGINT) AS count, "
                   "count(DISTINCT text) AS given FROM documents",
    "embed_default": f"""WITH turns AS (SELECT conv_id || '-' || turn AS k, conv_id, turn, text FROM conversations),
{_embedded('turns', 'k', 'text', 'vectors')}
SELECT conv_id, turn, CAST(d AS INT) AS dimension, round(v[d + 1], 5) AS weight
FROM turns JOIN vectors USING (k), range(64) AS r(d) WHERE v[d + 1] <> 0""",
    "knn_topk": _knn("true"),
    "knn_filtered": _knn("x.label = 3"),
    "knn_cosine": _knn("true", 3, cosine=True),
    "record_hits": f"WITH {_hits()} SELECT query_id, CAST(rank AS INT) AS rank, filename, round(d * d, 4) AS distance FROM metas",
    "context_blocks": f"WITH {_hits()} SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context "
                      "FROM metas GROUP BY query_id",
    "prompts": f"""WITH {_hits()}, {_ANALYTICS},
contexts AS (SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context FROM metas GROUP BY query_id)
SELECT query_id, 'CONTEXT:' || chr(10) || context || coalesce(chr(10) || chr(10) || analytics, '') || chr(10) || chr(10)
  || 'QUESTION: ' || question AS user
FROM questions JOIN contexts USING (query_id) LEFT JOIN analytics USING (query_id)""",
    "sources_distinct": f"""WITH {_hits()}
SELECT query_id, filename, CAST(min(rank) AS INT) AS first_rank FROM metas WHERE filename <> '' GROUP BY query_id, filename""",
    "ask_status": f"""WITH {_RECORDS}, n AS (SELECT count(*) FILTER (WHERE energy_type = 'diesel') AS diesel, count(*) AS all_ids FROM records)
SELECT conv_id || '-' || turn AS query_id, least(4, diesel) AS hits,
  CASE WHEN all_ids = 0 THEN 'No documents indexed.' WHEN diesel = 0 THEN 'No relevant documents found for your question.'
  ELSE 'ok' END AS status FROM conversations, n WHERE role = 'user'""",
    "compare_first_last": f"""WITH {_RECORDS}, keyed AS (SELECT *, billing_period_from AS period FROM records),
{_ENDS.format(keys='site, ', tie='invoice_number', source='keyed')}, changes AS ({_change_rows('site, ')})
SELECT site, energy_type, invoices, first_period, last_period, metric, unit, round(a, 4) AS first_value,
  round(b, 4) AS last_value, round(b - a, 4) AS difference, CASE WHEN a <> 0 THEN round((b - a) / a * 100, 4) END AS percent
FROM changes WHERE a IS NOT NULL AND b IS NOT NULL""",
    "compare_hits": f"""WITH {_hits()}, {_ENDS.format(keys='query_id, ', tie='rank', source='metas')},
changes AS ({_change_rows('query_id, ')})
SELECT query_id, energy_type, invoices, first_period, last_period, metric, round(b - a, 4) AS difference,
  CASE WHEN a <> 0 THEN round((b - a) / a * 100, 4) END AS percent FROM changes""",
    "compare_series": f"""WITH {_hits()}, {_GROUPS}
SELECT query_id, energy_type, CAST(len(h) AS INT) AS invoices,
  list_aggregate(list_transform(h, lambda x: x.period), 'string_agg', ',') AS periods,
  list_aggregate(list_transform(h, lambda x: CAST(CAST(x.consumption_kwh AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS consumption
FROM groups WHERE len(h) >= 3""",
    "compare_text": f"WITH {_hits()}, {_ANALYTICS} SELECT query_id, analytics FROM analytics",
}
ORACLES["number_english"] = ORACLES["number_german"]
ORACLES["clean_number"] = """SELECT l_returnflag, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN
  CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total,
  count(*) FILTER (WHERE l_returnflag <> 'A') AS parsed FROM lineitem GROUP BY l_returnflag"""
ORACLES["errors_csv"] = ORACLES["invoice_rejects"]
ORACLES["records_copy"] = ORACLES["records_csv_roundtrip"]
ORACLES["factor_file"] = f"""WITH {_LINES}
SELECT energy_type, CASE energy_type WHEN 'electricity' THEN 0.00038::DOUBLE WHEN 'Fernwaerme' THEN 0.00028::DOUBLE END
  AS emission_factor_value, count(*) AS lines FROM lines GROUP BY energy_type"""
ORACLES["index_stream_replay"] = ORACLES["index_upsert"]
ORACLES["index_reopen"] = "SELECT sha256(text) AS id, max(length(text)) AS chars FROM documents GROUP BY text"
ORACLES["knn_with_bad_vectors"] = _knn("q.vec_id % 10 NOT IN (3, 7) AND x.vec_id % 10 NOT IN (3, 7)")
ORACLES["knn_empty"] = "SELECT count(*) AS hits FROM embeddings WHERE label = -1"
ORACLES["sources"] = f"""WITH {_hits()}
SELECT query_id, CAST(rank AS INT) AS rank, filename, site, energy_type, round(d * d, 4) AS distance FROM metas"""
ORACLES["parse_accounting"] = """WITH listed AS (
  SELECT 'doc-' || doc_id || '.pdf' AS file, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE strlen(text) END AS BIGINT) AS length,
    doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND trim(text) <> '' AS told
  FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'page-' || page_id || '.pdf', CAST(strlen(html) AS BIGINT), false FROM pages)
SELECT file, 'pdf' AS kind, length, length > 0 AND told AS admitted,
  CASE WHEN length = 0 THEN 'Empty file: ' || file WHEN NOT told THEN 'No text extracted from PDF' END AS error
FROM listed
UNION ALL
SELECT 'doc-' || doc_id || '.pdf', 'pdf', NULL, false, 'File not found: doc-' || doc_id || '.pdf'
FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0"""
