"""The same results in SQL, for an independent engine over the same tables."""

from __future__ import annotations

DIGITS = 4

# The columns are written out here and not taken from the library, so that a wrong role there shows.
TYPES = {
    "Provider_ID": "bigint",
    "Provider_Last_Name": "string",
    "Provider_First_Name": "string",
    "Provider_Credentials": "string",
    "Provider_Type": "string",
    "Provider_State": "string",
    "Provider_RUCA_Code": "double",
    "Provider_RUCA_Description": "string",
    "Medicare_Participation": "string",
    "Procedure_Code": "string",
    "Procedure_Description": "string",
    "Total_Beneficiaries": "double",
    "Total_Services": "double",
    "Total_Beneficiary_Days": "double",
    "Average_Submitted_Charge": "double",
    "Average_Medicare_Allowed": "double",
    "Average_Medicare_Payment": "double",
    "Average_Standardized_Payment": "double",
}
ALL = list(TYPES)
TEXT = [c for c, kind in TYPES.items() if kind == "string"]
CRITICAL = ["Provider_ID", "Procedure_Code"]
KEYS = ["Provider_ID", "Procedure_Code", "Total_Services"]
MEASURES = [
    "Total_Beneficiaries",
    "Total_Services",
    "Total_Beneficiary_Days",
    "Average_Submitted_Charge",
    "Average_Medicare_Allowed",
    "Average_Medicare_Payment",
    "Average_Standardized_Payment",
]
PROFILED_MEASURES = [
    "Total_Beneficiaries",
    "Total_Services",
    "Total_Beneficiary_Days",
    "Average_Submitted_Charge",
    "Average_Medicare_Allowed",
    "Average_Medicare_Payment",
]
FILLED_CATEGORICALS = [
    "Provider_Last_Name",
    "Provider_First_Name",
    "Provider_Credentials",
    "Provider_Type",
    "Provider_State",
    "Provider_RUCA_Description",
]
NORMALISED_TEXT = ["Provider_Last_Name", "Provider_First_Name", "Provider_Credentials", "Provider_Type"]
ENCODED_CATEGORICALS = ["Provider_Credentials", "Provider_Type", "Provider_State", "Medicare_Participation"]
SUBMITTED, ALLOWED = "Average_Submitted_Charge", "Average_Medicare_Allowed"
RATIO, LABEL, UNKNOWN = "Valid_Charge_Ratio", "is_fraud", "Unknown"
Z_PREFIX, IQR_PREFIX, MIXED_PREFIX = "Z_Outlier_Flag_", "IQR_Outlier_Flag_", "Mixed_Outlier_Flag_"
FLAGS = [prefix + m for prefix in (Z_PREFIX, IQR_PREFIX, MIXED_PREFIX) for m in MEASURES]
MIXED = [MIXED_PREFIX + m for m in MEASURES]
CLEANED = [*ALL, *FLAGS, RATIO]
LABELLED = [*CLEANED, LABEL]

_SCALE = "CASE WHEN l_orderkey % 89 = 0 THEN 6 ELSE 1 END"


def _list(items) -> str:
    return ", ".join(items)


def _each(columns, change, table_columns=ALL) -> str:
    """All columns of a table, some of them changed."""
    return _list(f"{change(c)} AS {c}" if c in columns else c for c in table_columns)


def _flag(column: str) -> str:
    x = f"p.{column}"
    z = f"{x} > mean_{column} + 3 * sd_{column} OR {x} < mean_{column} - 3 * sd_{column}"
    spread = f"1.5 * (q3_{column} - q1_{column})"
    iqr = f"{x} < q1_{column} - {spread} OR {x} > q3_{column} + {spread}"
    return _list(
        f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {prefix}{column}"
        for prefix, condition in ((Z_PREFIX, z), (IQR_PREFIX, iqr), (MIXED_PREFIX, f"{z} OR {iqr}"))
    )


_RATIO = f"CASE WHEN {ALLOWED} = 0 THEN NULL ELSE {SUBMITTED} / {ALLOWED} END AS {RATIO}"
_RULE = " OR ".join(
    [f"{MIXED_PREFIX}{m} = 1" for m in (SUBMITTED, ALLOWED, "Average_Medicare_Payment")] + [f"{RATIO} > 10"]
)
_STATS = _list(
    f"avg({m}) AS mean_{m}, stddev_samp({m}) AS sd_{m},"
    f" quantile_disc({m}, 0.25) AS q1_{m}, quantile_disc({m}, 0.75) AS q3_{m}"
    for m in MEASURES
)


def _indices(table: str) -> str:
    """Labels of every column of a table with their frequency and index."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS label, count(*) AS \"count\" FROM {table}"
        f" WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ENCODED_CATEGORICALS
    )
    return (
        'SELECT "column", label, "count", CAST(row_number() OVER (PARTITION BY "column"'
        f' ORDER BY "count" DESC, label) - 1 AS INTEGER) AS index FROM ({parts})'
    )


CHAIN = f"""
WITH joined AS (
  SELECT * FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey
), lines AS (
  SELECT l_partkey,
    CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_suppkey END AS Provider_ID,
    CASE WHEN l_linenumber = 1 THEN concat('  ', upper(s_name), ' ') ELSE s_name END AS Provider_Last_Name,
    CASE WHEN l_linenumber = 2 THEN NULL ELSE p_name END AS Provider_First_Name,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE p_brand END AS Provider_Credentials,
    p_type AS Provider_Type,
    CASE WHEN l_linenumber = 4 THEN NULL ELSE n_name END AS Provider_State,
    CAST(p_size AS DOUBLE) AS Provider_RUCA_Code,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE o_orderpriority END AS Provider_RUCA_Description,
    l_linestatus AS Medicare_Participation,
    CASE WHEN l_partkey % 307 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS Procedure_Code,
    p_name AS Procedure_Description,
    CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS Total_Beneficiaries,
    l_quantity AS Total_Services,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * l_linenumber END AS Total_Beneficiary_Days,
    l_extendedprice * {_SCALE} AS Average_Submitted_Charge,
    CASE WHEN l_orderkey % 997 = 0 THEN CAST(0 AS DOUBLE)
      ELSE p_retailprice * l_quantity * {_SCALE} END AS Average_Medicare_Allowed,
    CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice * l_tax END AS Average_Medicare_Payment,
    l_extendedprice * l_discount AS Average_Standardized_Payment
  FROM joined
), claims AS (
  SELECT {_list(ALL)} FROM lines
  UNION ALL SELECT {_list(ALL)} FROM lines WHERE l_partkey % 50 = 0
  UNION ALL SELECT {_each(["Provider_Last_Name"], lambda c: f"upper({c})")} FROM lines WHERE l_partkey % 50 = 25
), complete AS (
  SELECT {_each(MEASURES, lambda c: f"CAST({c} AS DOUBLE)")} FROM claims
  WHERE Provider_ID IS NOT NULL AND Procedure_Code IS NOT NULL
), medians AS MATERIALIZED (
  SELECT {_list(f"quantile_disc({m}, 0.5) AS median_{m}" for m in MEASURES)} FROM complete
), measured AS (
  SELECT {_each(MEASURES, lambda c: f"coalesce({c}, median_{c})")} FROM complete, medians
), filled AS (
  SELECT {_each(FILLED_CATEGORICALS, lambda c: f"coalesce({c}, '{UNKNOWN}')")} FROM measured
), population AS MATERIALIZED (
  SELECT {_each(NORMALISED_TEXT, lambda c: f"trim(lower({c}))")} FROM (SELECT DISTINCT * FROM filled)
), stats AS MATERIALIZED (
  SELECT {_STATS} FROM population
), flagged AS (
  SELECT p.*, {_list(_flag(m) for m in MEASURES)}, {_RATIO} FROM population p, stats
), cleaned AS (
  SELECT {_list(CLEANED)} FROM flagged
  WHERE {RATIO} <= 10 AND {SUBMITTED} >= {ALLOWED} AND {SUBMITTED} <= 10 * {ALLOWED}
), labelled AS MATERIALIZED (
  SELECT *, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS {LABEL} FROM cleaned
), indices AS (
  {_indices("labelled")}
), slots AS MATERIALIZED (
  {{slots}}
)
"""


def _measure_slots(columns, first: int, condition: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT {first + i} AS slot, '{c}' AS name, count(*) AS n, avg({c}) AS mean, min({c}) AS min,"
        f" max({c}) AS max, count(*) FILTER (WHERE {c} <> 0) AS nonzero, stddev_samp({c}) AS sd"
        f" FROM labelled WHERE {condition}"
        for i, c in enumerate(columns)
    )


def _category_slots(first: int) -> str:
    """One slot per label; the blocks follow each other in the order of the columns."""
    width = "(SELECT count(*) FROM indices b WHERE "
    place = _case(
        ENCODED_CATEGORICALS,
        lambda c: " + ".join(
            [str(first)]
            + [f"{width} b.\"column\" = '{d}')" for d in ENCODED_CATEGORICALS[: ENCODED_CATEGORICALS.index(c)]]
        ),
    )
    share = 'CAST("count" AS DOUBLE) / n'
    return (
        f"SELECT CAST(({place}) + index AS INTEGER) AS slot, \"column\" || '_OHE_' || label AS name, n,"
        f' {share} AS mean, CAST(CASE WHEN "count" = n THEN 1 ELSE 0 END AS DOUBLE) AS min,'
        f' CAST(1 AS DOUBLE) AS max, "count" AS nonzero,'
        f" sqrt({share} * (1 - {share}) * n / (n - 1)) AS sd"
        " FROM indices, (SELECT count(*) AS n FROM labelled)"
    )


def _case(columns, value) -> str:
    return 'CASE "column" ' + " ".join(f"WHEN '{c}' THEN {value(c)}" for c in columns) + " END"


def _slots(numeric) -> str:
    return f"{_measure_slots(numeric, 0)} UNION ALL {_category_slots(len(numeric))}"


CHAIN_ALL = CHAIN.format(slots=_slots([*MEASURES, *MIXED]))
CHAIN_WITHOUT_FLAGS = CHAIN.format(slots=_slots(MEASURES))


def _round(expression: str, name: str | None = None, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) AS {name or expression}"


def _entries(numeric) -> str:
    """The slots of a labelled row: number, name, value and deviation."""
    measures = [f"{{'i': {i}, 'n': '{c}', 'x': CAST({c} AS DOUBLE), 'sd': (SELECT sd FROM slots WHERE name = '{c}')}}" for i, c in enumerate(numeric)]
    blocks = [f"{{'i': b{i}.slot, 'n': b{i}.name, 'x': CASE WHEN b{i}.slot IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 'sd': b{i}.sd}}" for i in range(len(ENCODED_CATEGORICALS))]
    return "[" + ", ".join([*measures, *blocks]) + "]"


_BLOCKS = " ".join(f"LEFT JOIN slots b{i} ON b{i}.name = '{c}_OHE_' || labelled.{c}" for i, c in enumerate(ENCODED_CATEGORICALS))


def _vectors(numeric, scaled: bool = True, named: bool = False, beside: str = "") -> str:
    """Each labelled row's keys and the slots of its vector that are not zero."""
    value = "CASE WHEN v.sd = 0 THEN 0 ELSE v.x / v.sd END" if scaled else "v.x"
    text = f"CAST({'v.n' if named else 'v.i'} AS VARCHAR) || ':' || CAST(CAST(round({value}, {DIGITS}) AS DECIMAL(18, 4)) AS VARCHAR)"
    some = f"list_filter({_entries(numeric)}, lambda v: v.x <> 0 AND {'v.sd <> 0' if scaled else 'true'})"
    keys = _list(f"labelled.{c}" for c in KEYS)
    return f"SELECT {keys}, {beside} array_to_string(list_transform({some}, lambda v: {text}), ' ') AS slots FROM labelled {_BLOCKS}"


_LABEL_BESIDE = f"CAST({LABEL} AS DOUBLE) AS label,"


def _describe(table: str, columns, nulls: bool = False) -> str:
    def row(c: str) -> str:
        if c in TEXT:
            number, ends = f"try_cast({c} AS DOUBLE)", f"NULL, NULL, min({c}), max({c})"
        else:
            number = f"CAST({c} AS DOUBLE)"
            ends = f"min({number}), max({number}), NULL, NULL"
        return (
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {_round(f'avg({number})', 'mean')},"
            f" {_round(f'stddev_samp({number})', 'stddev')}, {ends}, count(*) - count({c}) FROM {table}"
        )

    body = " UNION ALL ".join(row(c) for c in columns)
    names = '("column", "count", mean, stddev, min, max, min_text, max_text, nulls)'
    return (
        'SELECT "column", "count", mean, stddev, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max,'
        f" CAST(min_text AS VARCHAR) AS min_text, CAST(max_text AS VARCHAR) AS max_text{', nulls' if nulls else ''}"
        f" FROM ({body}) AS d{names}"
    )


def _long(source: str, output: str, item: str, statistics) -> str:
    return " UNION ALL ".join(
        f"SELECT '{output}' AS output, CAST({item} AS VARCHAR) AS item, '{s}' AS statistic,"
        f' round(CAST("{s}" AS DOUBLE), {DIGITS}) AS value, CAST(NULL AS VARCHAR) AS text FROM ({source})'
        for s in statistics
    )


_NUMBERS = ["count", "mean", "stddev", "min", "max"]
_PROFILE = " UNION ALL ".join(
    [
        _long('SELECT count(*) AS "count", \'all\' AS item FROM cleaned', "rows", "item", ["count"]),
        _long(_describe("cleaned", CLEANED), "columns", '"column"', _NUMBERS),
        _long(_describe("cleaned", PROFILED_MEASURES), "measures", '"column"', _NUMBERS),
        _long(_describe("cleaned", CLEANED, nulls=True), "nulls", '"column"', ["nulls"]),
        _long(
            f"SELECT Provider_Type, avg({SUBMITTED}) AS avg_{SUBMITTED} FROM cleaned GROUP BY Provider_Type",
            "charge_by_type",
            "Provider_Type",
            [f"avg_{SUBMITTED}"],
        ),
        _long(
            'SELECT Provider_State, count(*) AS "count" FROM cleaned GROUP BY Provider_State',
            "rows_by_state",
            "Provider_State",
            ["count"],
        ),
        _long(
            f"SELECT count(*) AS \"count\", 'all' AS item FROM cleaned WHERE {SUBMITTED} > 1000",
            "high_charges",
            "item",
            ["count"],
        ),
        _long(
            f"SELECT *, row_number() OVER (ORDER BY {_list(f'{c} NULLS FIRST' for c in CLEANED)}) AS place FROM"
            f" (SELECT * FROM cleaned ORDER BY {_list(f'{c} NULLS FIRST' for c in CLEANED)} LIMIT 20)",
            "first_rows",
            "place",
            ["Provider_ID", *MEASURES],
        ),
        "SELECT 'schema', name, 'type', CAST(NULL AS DOUBLE), type FROM (VALUES "
        + _list(f"('{c}', '{TYPES.get(c, 'double' if c == RATIO else 'int')}')" for c in CLEANED)
        + ") AS t(name, type)",
    ]
)


def _auc(score: str, model: str) -> str:
    """Area under the ROC curve from the sum of the positives' mid-ranks."""
    return f"""SELECT '{model}' AS model, 'areaUnderROC' AS metric,
      round((sum(CASE WHEN y THEN place END) - p * (p + 1) / 2) / (p * (count(*) - p)), 9) AS value,
      'run' AS run_id
    FROM (SELECT y, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) OVER () AS DOUBLE) AS p,
            rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS place
          FROM (SELECT {score} AS x, l_returnflag = 'R' AS y FROM lineitem)) GROUP BY p"""


_LINE_METRICS = f"{_auc('l_extendedprice', 'price')} UNION ALL {_auc('l_quantity', 'quantity')}"
_METRIC_FILES = (
    "SELECT model, metric, value, CASE model WHEN 'price' THEN run_id END AS run_id, model || '_metrics.csv' AS Source"
    f" FROM ({_LINE_METRICS})"
)
_ACCURACY = """SELECT 'price', 'accuracy',
  round(avg(CASE WHEN (l_extendedprice > 50000) = (l_returnflag = 'R') THEN 1.0 ELSE 0.0 END), 9), 'run'
  FROM lineitem"""

_TRAIN = (
    "CAST('0x' || substr(md5(concat_ws('|', CAST(Provider_ID AS VARCHAR), Procedure_Code)), 1, 8) AS BIGINT)"
    " % 10000 < 7000"
)


def _in_order(table: str, columns, n: int) -> str:
    return f"SELECT {_list(columns)} FROM {table} ORDER BY {_list(f'{c} NULLS FIRST' for c in columns)} LIMIT {n}"


def _label_rows(table: str) -> str:
    """Every label's index and rows, and the shared index of nulls."""
    nulls = " UNION ALL ".join(
        f"SELECT '{c}', CAST(NULL AS VARCHAR), CAST((SELECT count(DISTINCT {c}) FROM {table}) AS DOUBLE), count(*)"
        f" FROM {table} WHERE {c} IS NULL HAVING count(*) > 0"
        for c in ENCODED_CATEGORICALS
    )
    return f'SELECT "column", label, CAST(index AS DOUBLE) AS index, "count" FROM ({_indices(table)}) UNION ALL {nulls}'


def _flatten() -> str:
    def scaled(x: str) -> str:
        return f"CASE WHEN stddev_samp({x}) OVER () = 0 THEN 0 ELSE {x} / stddev_samp({x}) OVER () END"

    columns = [_round(scaled(c), c) for c in [*MEASURES, *MIXED]]
    for value in "FO":
        indicator = f"(CASE WHEN Medicare_Participation = '{value}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        columns.append(_round(scaled(indicator), f"Medicare_Participation_OHE_{value}"))
    for i, c in enumerate(ENCODED_CATEGORICALS[:3]):
        columns.append(f"CASE WHEN b{i}.sd <> 0 THEN b{i}.name END AS {c}_slot")
        columns.append(f"round(CASE WHEN b{i}.sd <> 0 THEN 1.0::DOUBLE / b{i}.sd ELSE 0 END, {DIGITS}) AS {c}_value")
    return f"SELECT {_list([*CRITICAL, *columns])} FROM labelled {_BLOCKS}"


def _schema_rows(columns, more: str = "") -> str:
    types = {**TYPES, **{f: "int" for f in FLAGS}, RATIO: "double", LABEL: "int"}
    rows = _list(f"('{c}', '{types[c]}', true)" for c in columns)
    return f"SELECT name, type, nullable FROM (VALUES {rows}) AS t(name, type, nullable)"


_EVENT_FLAGS = f"""
WITH p AS (SELECT event_id, event_type, value FROM events), stats AS (
  SELECT avg(value) AS mean_value, stddev_samp(value) AS sd_value,
    quantile_disc(value, 0.25) AS q1_value, quantile_disc(value, 0.75) AS q3_value FROM p)
SELECT p.*, {_flag("value")} FROM p, stats
"""

_TYPED = _each(MEASURES, lambda c: f"CAST({c} AS DOUBLE)")

#: What stays of a file whose keys and charges are spoilt by rule, and what is refused.
_MISFITS = f"""SELECT key, code, charge, rejected FROM (
  SELECT CASE WHEN bad_key THEN Provider_ID || 'x' ELSE CAST(Provider_ID AS VARCHAR) END AS key, Procedure_Code AS code,
    CASE WHEN bad_charge THEN '1,200.50' END AS charge,
    concat_ws(',', CASE WHEN bad_key THEN 'Rndrng_NPI' END, CASE WHEN bad_charge THEN 'Avg_Sbmtd_Chrg' END) AS rejected
  FROM (SELECT *, coalesce(Provider_ID % 97 = 0, false) AS bad_key, Total_Services = 7 AS bad_charge FROM claims))"""



def _records(multi_line: bool) -> str:
    """What a reader keeps and rejects of the lines that `_broken_records` writes."""
    fits = "key AS Rndrng_NPI, code AS HCPCS_Cd, kind AS Rndrng_Prvdr_Type, services AS Tot_Benes, NULL::VARCHAR AS record, '' AS rejected"
    lost = "NULL::VARCHAR AS Rndrng_NPI, NULL::VARCHAR AS HCPCS_Cd, NULL::VARCHAR AS Rndrng_Prvdr_Type, NULL::VARCHAR AS Tot_Benes"
    raw = "coalesce(key, '') || ',' || coalesce(code, '')"
    parts = [
        f"SELECT {fits} FROM r WHERE broken NOT IN ({'1, 2, 3, 5' if multi_line else '1, 2, 3, 4, 5'})",
        f"SELECT {lost}, {raw}, '' FROM r WHERE broken = 1",
        f"SELECT {lost}, {raw} || ',' || kind || ',' || services || ',extra', '' FROM r WHERE broken = 2",
        "SELECT key, code, kind, services || 'x', NULL, 'Tot_Benes' FROM r WHERE broken = 5",
    ]
    if multi_line:
        parts.append("SELECT key, code, kind || chr(10) || 'and more', services, NULL, '' FROM r WHERE broken = 3")
    else:
        parts.append(f"SELECT {lost}, {raw} || ',\"' || kind, '' FROM r WHERE broken = 3")
        parts.append(f"SELECT {lost}, 'and more\",' || services, '' FROM r WHERE broken = 3")
        parts.append(f"SELECT {lost}, {raw} || ',' || kind || ',\"' || services, '' FROM r WHERE broken = 4")
    return f"""SELECT * FROM (WITH r AS (SELECT CAST(Provider_ID AS VARCHAR) AS key, Procedure_Code AS code, Provider_Type AS kind,
  CAST(CAST(Total_Services AS BIGINT) AS VARCHAR) AS services, coalesce(Provider_ID % 20, 0) AS broken FROM claims)
  {' UNION ALL '.join(parts)})"""


#: All claims, copies included, labelled by the statistics of the first batch.
_LATER = f"""SELECT {_list([*KEYS, RATIO, LABEL, *MIXED])}, true AS scored FROM (
  SELECT *, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS {LABEL} FROM (
    SELECT p.*, {_list(_flag(m) for m in MEASURES)}, {_RATIO} FROM filled p, stats)
  WHERE {RATIO} <= 10 AND {SUBMITTED} >= {ALLOWED} AND {SUBMITTED} <= 10 * {ALLOWED})"""

def _drift(measure: str) -> str:
    """Stability index of a measure of odd providers over eighths of the others'."""
    later = {SUBMITTED: f"{SUBMITTED} * 2", "Total_Beneficiary_Days": "CASE WHEN Total_Services <= 35 THEN Total_Beneficiary_Days END"}.get(measure, measure)
    eighths = _list(f"quantile_disc(x, {k / 8})" for k in range(1, 8))
    return f"""SELECT '{measure}' AS "column", CAST(sum(new) AS BIGINT) AS rows, CAST(coalesce(sum(new) FILTER (bin = -1), 0) AS BIGINT) AS missing,
      round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS shifted
    FROM (SELECT bin, old, new, greatest(old / sum(old) OVER (), 1e-4) AS p, greatest(new / sum(new) OVER (), 1e-4) AS q
      FROM (SELECT bin, CAST(count(*) FILTER (first) AS DOUBLE) AS old, CAST(count(*) FILTER (NOT first) AS DOUBLE) AS new
        FROM (SELECT first, CASE WHEN x IS NULL THEN -1 ELSE len([c for c in cuts if c <= x]) END AS bin
          FROM (SELECT Provider_ID % 2 = 0 AS first, CASE WHEN Provider_ID % 2 = 0 THEN {measure} ELSE {later} END AS x FROM complete),
            (SELECT list_distinct([{eighths}]) AS cuts FROM (SELECT {measure} AS x FROM complete WHERE Provider_ID % 2 = 0)))
        GROUP BY bin))"""


_DESCRIBED = len(CLEANED)
_END_TO_END = f"""
SELECT stage, '' AS item, CAST(n AS BIGINT) AS rows FROM (
  SELECT unnest(['labelled', 'processed']) AS stage, count(*) AS n FROM labelled
  UNION ALL VALUES ('schema', {_DESCRIBED}), ('columns', {_DESCRIBED}), ('measures', 6), ('nulls', {_DESCRIBED}), ('first_rows', 20)
  UNION ALL SELECT 'mean_charge_by_type', count(DISTINCT Provider_Type) FROM labelled
  UNION ALL SELECT 'rows_by_state', count(DISTINCT Provider_State) FROM labelled
  UNION ALL SELECT 'high_charges', count(*) FROM labelled WHERE {SUBMITTED} > 1000)
UNION ALL SELECT 'scored', 'beyond each test row once by each model', 0
UNION ALL SELECT 'label', CAST({LABEL} AS VARCHAR), count(*) FROM labelled GROUP BY {LABEL}
UNION ALL SELECT 'metric', unnest(['lr_metrics.csv areaUnderROC', 'lr_metrics.csv accuracy', 'rf_metrics.csv areaUnderROC', 'rf_metrics.csv accuracy']), 1
"""

_MODEL_METRICS = """SELECT unnest(['logistic', 'logistic', 'forest', 'forest']) AS model,
  unnest(['areaUnderROC', 'accuracy', 'areaUnderROC', 'accuracy']) AS metric, true AS as_recomputed"""

# Bodies that read the chain of stages.
_BODIES = {
    "s1_csv_scan": f"SELECT {_TYPED} FROM claims",
    "s2_csv_strings": f"SELECT CAST(Provider_ID AS VARCHAR) AS Provider_ID, * EXCLUDE (Provider_ID)"
    f" FROM (SELECT {_TYPED} FROM claims)",
    "s4_parquet_roundtrip": "SELECT * FROM claims",
    "s5_csv_roundtrip": "SELECT * FROM complete",
    "s8_vector_roundtrip": _vectors([*MEASURES, *MIXED]),
    "s9_preview": _in_order("cleaned", CLEANED, 20),
    "s10_schema": _schema_rows(LABELLED),
    "p1_rename": "SELECT * FROM claims",
    "p2_drop_critical": "SELECT * FROM claims WHERE Provider_ID IS NOT NULL AND Procedure_Code IS NOT NULL",
    "p3_fill_unknown": f"SELECT {_each(FILLED_CATEGORICALS, lambda c: f"coalesce({c}, '{UNKNOWN}')")} FROM claims",
    "p4_median_fill": "SELECT * FROM measured",
    "p5_normalise": f"SELECT {_each(NORMALISED_TEXT, lambda c: f'trim(lower({c}))')} FROM claims",
    "p6_charge_ratio": f"SELECT {_list(KEYS)}, {_RATIO} FROM claims",
    "p7_ratio_cap": f"SELECT * FROM (SELECT {_list(KEYS)}, {_RATIO} FROM claims) WHERE {RATIO} <= 10",
    "p8_range_check": f"SELECT {_list(KEYS)}, {SUBMITTED}, {ALLOWED} FROM claims"
    f" WHERE {SUBMITTED} >= {ALLOWED} AND {SUBMITTED} <= 10 * {ALLOWED}",
    "p9_high_charge": f"SELECT {_list(KEYS)}, {SUBMITTED} FROM claims WHERE {SUBMITTED} > 1000",
    "p10_flag_view": f"SELECT {_list([*MEASURES, *FLAGS, RATIO])} FROM flagged WHERE {RATIO} <= 10",
    "p11_rule": f"SELECT {_list(KEYS)}, {RATIO}, ({_RULE}) AS suspicious FROM flagged",
    "p12_label": f"SELECT {_list(KEYS)}, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS {LABEL} FROM flagged",
    "p13_label_cast": f"SELECT {_list(KEYS)}, CAST({LABEL} AS DOUBLE) AS label FROM labelled",
    "p14_source_column": f"SELECT {_list(KEYS)}, 'claims' AS Source FROM claims",
    "p15_prefix_columns": f"SELECT {_list([*KEYS, *MIXED])} FROM cleaned",
    "p16_select_features": _vectors([*MEASURES, *MIXED], beside=_LABEL_BESIDE),
    "p17_vector_flatten": _flatten(),
    "a1_median": " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", median_{m} AS median FROM medians" for m in MEASURES
    ),
    "a2_quartiles": " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", quantile_disc({m}, 0.25) AS q1, quantile_disc({m}, 0.75) AS q3 FROM complete"
        for m in MEASURES
    ),
    "a2_sketched_quartiles": " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", CAST({p} AS DOUBLE) AS prob, count({m}) AS n, true AS within FROM complete"
        for m in MEASURES
        for p in (0.25, 0.5, 0.75)
    ),
    "a3_mean_stddev": "SELECT "
    + _list(_round(f"{f}({m})", f"{m}_{n}") for m in MEASURES for f, n in (("avg", "mean"), ("stddev_samp", "stddev")))
    + " FROM complete",
    "a4_dedupe": "SELECT DISTINCT * FROM claims",
    "a4_dedupe_normalised": f"SELECT DISTINCT {_each(NORMALISED_TEXT, lambda c: f'trim(lower({c}))')} FROM claims",
    "a5_count": 'SELECT count(*) AS "count" FROM cleaned',
    "a6_describe_all": _describe("labelled", LABELLED),
    "a6_text_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", true AS distinct_within, true AS right_counts, true AS none_missed, true AS all_exist FROM claims"
        for c in TEXT
    ),
    "a6_frequent_texts": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(sum(count(*)) OVER () AS BIGINT) AS \"count\", count(*) OVER () AS \"distinct\","
        f" CAST(0 AS BIGINT) AS top_error, {c} AS item, count(*) AS n FROM claims WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, item LIMIT 10)"
        for c in ("Provider_State", "Medicare_Participation", "Provider_RUCA_Description", "Provider_Credentials")
    ),
    "a7_describe_measures": _describe("cleaned", PROFILED_MEASURES),
    "a8_null_counts": f"SELECT {_list(f'count(*) - count({c}) AS {c}' for c in ALL)} FROM claims",
    "a8_null_counts_long": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM claims" for c in ALL
    ),
    "a9_avg_by_type": f"SELECT Provider_Type, {_round(f'avg({SUBMITTED})', f'avg_{SUBMITTED}')}"
    " FROM cleaned GROUP BY Provider_Type",
    "a10_count_by_state": 'SELECT Provider_State, count(*) AS "count" FROM cleaned GROUP BY Provider_State',
    "a11_label_distribution": f'SELECT {LABEL}, count(*) AS "count" FROM labelled GROUP BY {LABEL}',
    "o1_z_flag": f"SELECT {_list([*CRITICAL, *MEASURES, *FLAGS[:7]])} FROM flagged",
    "o2_iqr_flag": f"SELECT {_list([*CRITICAL, *MEASURES, *FLAGS[7:14]])} FROM flagged",
    "o3_mixed_flag": f"SELECT {_list([*CRITICAL, *MEASURES, *MIXED])} FROM flagged",
    "o4_all_flags": f"SELECT {_list([*CRITICAL, *MEASURES, *FLAGS])} FROM flagged",
    "o4_stored_stats": f"SELECT {_list([*KEYS, *MIXED])} FROM (SELECT p.*, {_list(_flag(m) for m in MEASURES)}"
    f" FROM (SELECT {_TYPED} FROM claims) p, stats)",
    "l1_limit": _in_order("labelled", LABELLED, 50),
    "u1_union": f"SELECT {_list(KEYS)}, {LABEL}, 'high' AS Source FROM labelled WHERE {SUBMITTED} > 100000"
    f" UNION ALL SELECT {_list(KEYS)}, {LABEL}, 'suspicious' FROM labelled WHERE {LABEL} = 1",
    "m1_string_index": _label_rows("claims"),
    "m1_index_by_join": _label_rows("claims"),
    "m2_one_hot": "SELECT "
    + _list([*(f"labelled.{c}" for c in KEYS), *(f"coalesce(i{n}.index || ':1.0000', '') AS {c}" for n, c in enumerate(ENCODED_CATEGORICALS))])
    + " FROM labelled "
    + " ".join(f"LEFT JOIN indices i{n} ON i{n}.\"column\" = '{c}' AND i{n}.label = labelled.{c}" for n, c in enumerate(ENCODED_CATEGORICALS)),
    "m6_random_split": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS in_both_or_neither, true AS near_share FROM labelled",
    "m9_score": f"SELECT count(*) AS rows, count(*) AS matching FROM labelled WHERE NOT ({_TRAIN})",
    "j9_later_batch": _LATER,
    "j9_batch_drift": " UNION ALL ".join(map(_drift, MEASURES)),
    "s1_rejected_rows": _MISFITS,
    "s1_rejected_records": _records(False),
    "s1_records_of_several_lines": _records(True),
    "m3_assemble": _vectors([*MEASURES, *MIXED], scaled=False, named=True),
    "m4_scale": _vectors([*MEASURES, *MIXED], named=True),
    "m5_pipeline": _vectors([*MEASURES, *MIXED]),
    "m5_pipeline_many_labels": _vectors([*MEASURES, *MIXED]),
    "m6_hash_split": f"SELECT {_list(KEYS)}, CASE WHEN {_TRAIN} THEN 'train' ELSE 'test' END AS Source FROM labelled",
    "m6_group_split": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS \"groups\", CAST(0 AS BIGINT) AS in_both, true AS near_share, CAST(0 AS BIGINT) AS cut FROM (SELECT count(*) AS n FROM claims"
    f" GROUP BY {_list(f'trim(lower({c}))' if c in TEXT else c for c in ALL)})",
    "m6_stored_split": f"SELECT {_list([*KEYS, LABEL])} FROM labelled",
    "j1_prepare": "SELECT * FROM cleaned",
    "j2_profile": _PROFILE,
    "j3_label": "SELECT * FROM labelled",
    "j4_encode": _vectors([*MEASURES, *MIXED], beside=_LABEL_BESIDE),
    "j7_sample": _in_order("labelled", LABELLED, 50),
    "j8_end_to_end": _END_TO_END,
}


def oracle_sql() -> dict[str, str]:
    return {
        **{name: f"{CHAIN_ALL} {body}" for name, body in _BODIES.items()},
        "j4_encode_without_flags": f"{CHAIN_WITHOUT_FLAGS} {_vectors(MEASURES, beside=_LABEL_BESIDE)}",
        "m7_logistic": f"{CHAIN_WITHOUT_FLAGS} SELECT slot, name, true AS vanishes FROM slots",
        "m8_forest": "SELECT 100 AS trees, 5 AS depth, true AS same, true AS tells_apart",
        "j5_train": _MODEL_METRICS,
        "s3_parquet_scan": "SELECT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem",
        "s6_metric_append": f"WITH m AS ({_LINE_METRICS}) SELECT * FROM m UNION ALL SELECT * REPLACE ('2024' AS run_id) FROM m WHERE model = 'quantity'",
        "s7_skip_missing": _METRIC_FILES,
        "j6_consolidate": _METRIC_FILES,
        "m10_auc": f"{_auc('l_extendedprice', 'price')} UNION ALL {_ACCURACY}",
        "m10_sketched_auc": " UNION ALL ".join(
            f"SELECT model, value, true AS within, true AS small FROM ({_auc(score, name)})" for name, score in (("price", "l_extendedprice"), ("quantity", "l_quantity"))
        ),
        "o4_event_flags": _EVENT_FLAGS,
    }
