"""Independent SQL for every query that SQL can express, for DuckDB.

Written from the definitions, not from the Spark code: statistics come from
DuckDB's own functions, over the same views.
"""

from __future__ import annotations

from itertools import combinations

from catalog.fixtures import VIEWS

COLUMNS = {
    "fx_quality": {"id": "n", "price": "n", "priority": "s", "status": "s", "spiky": "n", "cust_text": "s", "day_text": "s"},
    "fx_dups": {"l_returnflag": "s", "l_linestatus": "s", "l_linenumber": "n", "l_tax": "n"},
    "fx_outlier": {"id": "n", "value": "n", "rare_flag": "n", "event_type": "s"},
    "fx_corr": {c: "n" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "net", "neg_qty", "mixed", "gappy", "flat")},
    "fx_rules": {"id": "n", "name": "s", "seg": "s", "market": "s", "nation": "s", "bal": "n", "nearly_flat": "n", "skewed": "n", "const_text": "s", "all_null": "n"},
    "fx_code": {"id": "n", "num_text": "s", "code_text": "s"},
    "lineitem": {c: "n" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    | {c: "s" for c in ("l_returnflag", "l_linestatus", "l_shipdate")},
}
TYPES = {
    "fx_quality": dict(id="bigint", price="double", spiky="double"),
    "fx_outlier": dict(id="bigint", value="double", rare_flag="int"),
    "fx_corr": dict(l_orderkey="bigint", l_linenumber="int"),
    "fx_rules": dict(id="bigint", bal="double", nearly_flat="double", skewed="double", all_null="double"),
}


def nums(view: str) -> list[str]:
    return [c for c, t in COLUMNS[view].items() if t == "n"]


def cats(view: str) -> list[str]:
    return [c for c, t in COLUMNS[view].items() if t == "s"]


def dtype(view: str, c: str) -> str:
    return TYPES.get(view, {}).get(c, "double" if COLUMNS[view][c] == "n" else "string")


def query(view: str, body: str, *ctes: str) -> str:
    """``body`` over the view as ``fx``, after the named CTEs."""
    base = VIEWS.get(view, f"SELECT * FROM {view}")
    return f"WITH fx AS MATERIALIZED ({base})" + "".join(f",\n{c}" for c in ctes) + f"\n{body}"


def each(columns, template: str) -> str:
    return "\nUNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


def r(x: str, digits: int = 4) -> str:
    """Round as the reports do."""
    x = f"({x})"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL ELSE round({x}, {digits}) + 0.0 END"


def rs(x: str, digits: int = 4) -> str:
    """A result of sums, which differ by the order of summation: 12 significant digits from 1e8 on, as the query shows it."""
    x = f"({x})"
    step = f"pow(10.0, floor(log10(abs({x}))) - 11)"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL WHEN abs({x}) < 1e8 THEN round({x}, {digits}) + 0.0 "
        f"WHEN {step} > 1 THEN round({x} / {step}) * {step} ELSE round({x}, 3) END"
    )


def pct(part: str, whole: str) -> str:
    return f"round(coalesce({part}::DOUBLE / nullif({whole}, 0)::DOUBLE, 0) * 100, 2)"


def left_pct(part: str, whole: str) -> str:
    return f"round((1 - coalesce({part}::DOUBLE / nullif({whole}, 0)::DOUBLE, 0)) * 100, 2)"


def st(view: str) -> str:
    """Statistics per numeric column."""
    return "st AS MATERIALIZED (" + each(nums(view), """SELECT '{c}' AS col, {i} AS pos, count(*) AS n_rows, count({c}) AS n, avg({c}::DOUBLE) AS mean,
  stddev_samp({c}::DOUBLE) AS std, var_samp({c}::DOUBLE) AS variance, min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx,
  CASE WHEN stddev_samp({c}::DOUBLE) = 0 THEN 0 ELSE skewness({c}::DOUBLE) END AS skew,
  CASE WHEN stddev_samp({c}::DOUBLE) = 0 THEN 0 ELSE kurtosis({c}::DOUBLE) END AS kurt,
  quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2, quantile_cont({c}::DOUBLE, 0.75) AS q3,
  count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negs, count(DISTINCT {c}) AS uniq FROM fx""") + ")"


def fence(view: str) -> str:
    """Outliers per numeric column, with and without the guard."""
    out = "({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    return "fence AS MATERIALIZED (" + each(nums(view), f"""SELECT '{{c}}' AS col, any_value(q1 - 1.5 * (q3 - q1)) AS lo, any_value(q3 + 1.5 * (q3 - q1)) AS hi,
  count(*) FILTER (WHERE {out}) AS raw_out,
  CASE WHEN any_value(n) < 4 OR any_value(q3 - q1) = 0 THEN 0 ELSE count(*) FILTER (WHERE {out}) END AS outl,
  min({{c}}) FILTER (WHERE {out})::DOUBLE AS omin, max({{c}}) FILTER (WHERE {out})::DOUBLE AS omax,
  min({{c}}) FILTER (WHERE NOT {out})::DOUBLE AS imin, max({{c}}) FILTER (WHERE NOT {out})::DOUBLE AS imax
  FROM fx, st WHERE st.col = '{{c}}'""") + ")"


def miss(view: str) -> str:
    rows = ((c, dtype(view, c)) for c in COLUMNS[view])
    return "miss AS MATERIALIZED (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS col, {i} AS pos, '{t}' AS dt, count(*) AS n_rows, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq FROM fx"
        for i, (c, t) in enumerate(rows)
    ) + ")"


def vc(view: str, columns=None) -> str:
    """Counts per (column, value) of text columns."""
    return "vc AS MATERIALIZED (" + each(
        columns or cats(view), "SELECT '{c}' AS col, {c}::VARCHAR AS v, count(*) AS cnt FROM fx WHERE {c} IS NOT NULL GROUP BY ALL"
    ) + ")"


def corr(view: str, columns=None) -> str:
    """Correlation per column pair."""
    names = columns or nums(view)
    place = {c: i for i, c in enumerate(names)}
    parts = [
        f"SELECT '{a}' AS a, '{b}' AS b, {place[a]} AS i, {place[b]} AS j, corr({a}::DOUBLE, {b}::DOUBLE) AS r0 FROM fx"
        for a, b in combinations(names, 2)
    ]
    return "pairs AS MATERIALIZED (SELECT a, b, i, j, CASE WHEN isnan(r0) THEN NULL ELSE r0 END AS r FROM (" + "\nUNION ALL ".join(parts) + "))"


TEXT_NUMBER = r"(?i)[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity)[ \t]*"


def text_share(view: str) -> str:
    return "txt AS (" + each(
        cats(view), f"SELECT '{{c}}' AS col, avg(regexp_full_match({{c}}, '{TEXT_NUMBER}')::INT) AS share FROM fx WHERE {{c}} IS NOT NULL".replace("{{c}}", "{c}")
    ) + ")"


def score(view: str) -> str:
    width = len(COLUMNS[view])
    names = ", ".join(COLUMNS[view])
    return f"""score AS MATERIALIZED (SELECT *, round(completeness * 0.35 + uniqueness * 0.25 + outlier_score * 0.25 + validity * 0.15, 2) AS overall_score FROM (
  SELECT n_rows AS rows, {width} AS columns, missing, dups AS duplicates, outl AS outliers,
    {left_pct('missing', f'n_rows * {width}')} AS completeness, {left_pct('dups', 'n_rows')} AS uniqueness,
    {left_pct('outl', 'greatest(cells, 1)')} AS outlier_score,
    greatest(0.0, {left_pct('issues', str(width))}) AS validity
  FROM (SELECT sum(missing)::BIGINT AS missing, max(n_rows) AS n_rows FROM miss),
    (SELECT (SELECT count(*) FROM fx) - count(*) AS dups FROM (SELECT DISTINCT {names} FROM fx)),
    (SELECT sum(outl)::BIGINT AS outl FROM fence), (SELECT sum(n)::BIGINT AS cells FROM st),
    (SELECT 0.5 * count(*) FILTER (WHERE share > 0.5) AS issues FROM txt)))"""


def one(x: str) -> str:
    return f"format('{{:.1f}}', round({x}, 1))"


def insight(view: str) -> str:
    """Every rule on one view, with its number."""
    width, n_num, n_cat = len(COLUMNS[view]), len(nums(view)), len(cats(view))
    has_cats = bool(cats(view))
    parts = [f"""SELECT 1 AS rule_no, 'skewness' AS "type", CASE WHEN abs(skew) > 3 THEN 'high' WHEN abs(skew) > 2 THEN 'medium' ELSE 'low' END AS severity,
  col AS "column", round(skew, 4) AS "value", CASE WHEN abs(skew) > 2 THEN 'High' ELSE 'Moderate' END || ' skew: ' || col AS title,
  'Long ' || CASE WHEN skew > 0 THEN 'right' ELSE 'left' END || ' tail; a log or root transform may help a model' AS description
  FROM st WHERE n >= 5 AND abs(skew) > 1""",
        f"""SELECT 2, 'correlation', CASE WHEN abs(r) > 0.9 THEN 'high' ELSE 'medium' END, a || ' & ' || b, round(r, 4), 'Strong correlation: ' || a || ' & ' || b,
  'Strong ' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' correlation; the pair is largely redundant' FROM pairs WHERE abs(r) > 0.8""",
        """SELECT 4, 'low_variance', 'low', col, round(std, 6), 'Near-constant: ' || col, 'The values hardly vary, so they say little to a model'
  FROM st WHERE n >= 5 AND coalesce(std / nullif(abs(mean), 0), 0) < 0.01 AND std < 0.001""",
        """SELECT 6, 'constant_column', 'medium', col, uniq::DOUBLE, 'Constant: ' || col, uniq || ' distinct value(s); drop the column before training' FROM miss WHERE uniq <= 1""",
        f"""SELECT 7, 'summary', 'info', NULL, NULL, 'Table overview', format('{{:,}}', max(n_rows)) || ' rows, {width} columns ({n_num} numeric, {n_cat} categorical), ' || sum(missing)::BIGINT || ' missing cells' FROM miss""",
    ]
    if has_cats:
        parts += [f"""SELECT 3, 'imbalance', 'high', col, round(share * 100, 2), 'Class imbalance: ' || col,
  '''' || top || ''' holds ' || {one('share * 100')} || '% of the values; resample before training'
  FROM (SELECT col, count(*) AS k, max(cnt)::DOUBLE / sum(cnt)::DOUBLE AS share, arg_max(v, cnt) AS top FROM vc GROUP BY col) WHERE k BETWEEN 2 AND 20 AND share > 0.8""",
            f"""SELECT 5, 'high_cardinality', 'medium', col, uniq::DOUBLE, 'Many values: ' || col, uniq || ' distinct values (' || {one('uniq::DOUBLE / n_rows * 100')} || '% of rows); target or hash encoding suits it'
  FROM miss WHERE n_rows > 50 AND uniq > 0.5 * n_rows AND col IN ({', '.join(repr(c) for c in cats(view))})"""]
    return "ins AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def insights(view: str, body: str) -> str:
    ctes = [st(view), corr(view), miss(view)] + ([vc(view)] if cats(view) else []) + [insight(view)]
    return query(view, body, *ctes)


FIELDS = '"type", severity, "column", "value", title, description'

FLAGS = {"value": "value", "rare_flag": "rare_flag"}


def suggestions(view: str) -> str:
    """Feature suggestions of a view (date columns are added by hand)."""
    names = nums(view)

    def rule(kind, priority, title, text, suffix, where):
        return f"SELECT '{kind}' AS \"type\", col AS \"column\", '{priority}' AS priority, '{title} ' || col AS title, {text} AS description, col || '{suffix}' AS feature FROM st WHERE n >= 5 AND {where}"

    parts = [
        rule("log_transform", "high", "Log of", "printf('skewness %.2f, all values positive', abs(skew))", "_log", "abs(skew) > 2 AND negs = 0 AND zeros = 0"),
        rule("sqrt_transform", "medium", "Square root of", "printf('skewness %.2f, no negatives', abs(skew))", "_sqrt", "abs(skew) > 1 AND negs = 0"),
        rule("binning", "low", "Quartile bins of", "uniq || ' distinct values'", "_bin", "uniq > 20"),
        rule("normalize", "medium", "Standardise", "'distance-based models need one scale'", "_z", "true"),
        "SELECT 'interaction', a || ' × ' || b, 'medium', 'Interaction ' || a || ' × ' || b, printf('correlation %.2f', r), a || '_x_' || b FROM (SELECT * FROM pairs WHERE abs(r) > 0.5 ORDER BY i, j LIMIT 3)",
    ]
    for a, b in [(names[0], names[1]), (names[1], names[2 % len(names)])]:
        parts.append(f"SELECT 'ratio', '{a}/{b}', 'low', 'Ratio {a}/{b}', 'relative size, free of scale', '{a}_per_{b}'")
    if cats(view):
        kinds = [("= 2", "binary_encode", "high", "_enc"), ("<= 10 AND uniq <> 2", "onehot", "high", "_*"), ("BETWEEN 11 AND 50", "target_encode", "medium", "_target"), ("> 50", "hash_encode", "low", "_hash")]
        some = ", ".join(f"'{c}'" for c in cats(view))
        for test, kind, priority, suffix in kinds:
            parts.append(f"SELECT '{kind}', col, '{priority}', 'Encode ' || col, uniq::VARCHAR || ' categories', col || '{suffix}' FROM miss WHERE col IN ({some}) AND uniq {test}")
    return "sug AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def prepared(target: str = "y_txt") -> list[str]:
    """fx_ml after encoding, filling and splitting."""
    label = "CASE WHEN y_txt = 'hi' THEN 0 ELSE 1 END" if target == "y_txt" else "y_num"
    return [f"""prep AS MATERIALIZED (SELECT k, q, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM fx)) AS d,
  (CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::DOUBLE AS flag, {label} AS label,
  ('0x' || substr(md5(k), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM fx)"""]


def linear(body: str) -> str:
    """Ridge and lasso on one feature in closed form."""
    return query("fx_ml", body, *prepared("y_num"),
        """fit AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(q) AS mx, avg(label) AS my, regr_sxx(label, q) AS sxx, regr_sxy(label, q) AS sxy FROM prep WHERE NOT is_test)""",
        """w AS (SELECT 'Ridge' AS model, sxy / (sxx + 1) AS b, mx, my FROM fit
UNION ALL SELECT 'Lasso', sign(sxy) * greatest(abs(sxy) / n - 1, 0) / (sxx / n), mx, my FROM fit)""")


BOARD_SQL = """SELECT row_number() OVER (ORDER BY score DESC, model) AS "rank", * EXCLUDE (score), score,
  row_number() OVER (ORDER BY score DESC, model) = 1 AS is_best FROM (
  SELECT model, 'success' AS status, round(1 - avg(e * e) / var_pop(label), 4) AS score, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
    round(1 - avg(e * e) / var_pop(label), 4) AS r2_score
  FROM (SELECT model, label, label - (my + b * (q - mx)) AS e FROM prep, w WHERE is_test) GROUP BY model
  UNION ALL SELECT 'Unknown', 'failed', -999.0, NULL, NULL, NULL)"""


def shap(body: str) -> str:
    return query("fx_ml", body, *prepared("y_num"),
        "bg AS (SELECT avg(q) AS q, avg(d) AS d, avg(flag) AS flag FROM (SELECT * FROM prep WHERE NOT is_test ORDER BY k LIMIT 100))",
        """phi AS MATERIALIZED (SELECT t.k, f.feature, round(f.v, 4) AS "value", round(f.p, 6) + 0.0 AS contribution
  FROM (SELECT * FROM prep WHERE is_test ORDER BY k LIMIT 200) t, bg,
  LATERAL (SELECT unnest(['q', 'd', 'flag']) AS feature, unnest([t.q, t.d, t.flag]) AS v, unnest([2.0 * (t.q - bg.q), 100.0 * (t.d - bg.d), -3.0 * (t.flag - bg.flag)]) AS p) f)""",
        "imp AS (SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM phi GROUP BY feature)")


def build() -> dict[str, str]:
    Q, C, R, O, M = "fx_quality", "fx_corr", "fx_rules", "fx_outlier", "fx_ml"
    order = ", ".join(COLUMNS[Q])
    sql: dict[str, str] = {}

    # sources
    sql["csv_roundtrip"] = query(Q, "SELECT * FROM fx")
    sql["row_cap"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10000"
    types = """CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"""
    sql["schema_roles"] = query("lineitem", f"""SELECT column_name AS "column", {types} AS dtype,
  CASE WHEN column_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS role, n AS non_null
FROM (DESCRIBE lineitem) JOIN miss ON col = column_name""", miss("lineitem"))
    sql["dtype_counts"] = query("lineitem", f"""SELECT {types} AS dtype, count(*) AS columns, sum(n)::BIGINT AS "values"
FROM (DESCRIBE lineitem) JOIN miss ON col = column_name GROUP BY 1""", miss("lineitem"))
    sql["preview"] = """SELECT coalesce(o_orderkey::VARCHAR, '') AS o_orderkey, coalesce(o_custkey::VARCHAR, '') AS o_custkey,
  coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)"""
    sql["dataset_summary"] = "SELECT count(*) AS rows, 6 AS columns, (SELECT string_agg(column_name, ',') FROM (DESCRIBE orders)) AS column_names FROM orders"
    nothing = "NULL::VARCHAR"
    numeric = [("mean", rs("mean")), ("std", rs("std")), ("min", r("mn")), ("max", r("mx")), ("q25", r("q1")), ("median", r("q2")), ("q75", r("q3")), ("skewness", r("skew")), ("kurtosis", r("kurt")),
               ("outlier_count", "outl"), ("missing_count", "missing"), ("unique_count", "st.uniq")]
    names = ", ".join(f"'{n}'" for n, _ in numeric)
    values = ", ".join(f"({x})::DOUBLE" for _, x in numeric)
    limits = [("count", "outl"), ("pct", pct("outl", "n_rows")), ("lower_bound", r("lo")), ("upper_bound", r("hi")), ("min_anomaly", r("omin")), ("max_anomaly", r("omax"))]
    common = "top AS (SELECT col, arg_min(v, (-cnt, v)) AS v, max(cnt) AS cnt, sum(cnt) AS total, count(*) AS k FROM vc GROUP BY col)"

    def report_parts(view: str, cleaned: bool) -> str:
        parts = [f"""SELECT 'original_shape' AS section, NULL AS subject, 'rows' AS metric, rows::DOUBLE AS "value", {nothing} AS text FROM score""",
            f"SELECT 'original_shape', NULL, 'columns', columns, {nothing} FROM score",
            f"SELECT 'quality', NULL, unnest(['overall_score', 'completeness', 'uniqueness', 'outlier_score', 'validity']), unnest([overall_score, completeness, uniqueness, outlier_score, validity]), {nothing} FROM score",
            f"SELECT 'totals', NULL, 'missing', sum(missing), {nothing} FROM miss",
            f"SELECT 'totals', NULL, 'duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)), {nothing} FROM fx",
            f"SELECT 'totals', NULL, 'outliers', sum(outl), {nothing} FROM fence",
            f"SELECT 'missing', col, 'missing', missing, {nothing} FROM miss",
            f"SELECT 'missing', col, 'missing_pct', {pct('missing', 'n_rows')}, {nothing} FROM miss",
            """SELECT 'insight', "column", "type", "value", severity || ': ' || title || '. ' || description FROM ins""",
            f"SELECT 'column', col, unnest([{names}]), unnest([{values}]), {nothing} FROM st JOIN fence USING (col) JOIN (SELECT col, missing FROM miss) USING (col)",
            "SELECT 'column', col, 'dtype', NULL, dt FROM miss WHERE col IN (SELECT col FROM st) OR col IN (SELECT col FROM top)",
            f"SELECT 'column', col, unnest(['missing_count', 'unique_count']), unnest([missing::DOUBLE, uniq::DOUBLE]), {nothing} FROM miss JOIN top USING (col)",
            "SELECT 'column', col, 'top_value', NULL, v FROM top",
            f"SELECT 'anomaly', NULL, unnest(['total_rows', 'iqr_rows', 'iqr_pct', 'zscore_rows', 'zscore_pct']), unnest([n::DOUBLE, iq::DOUBLE, {pct('iq', 'n')}, z::DOUBLE, {pct('z', 'n')}]), {nothing} FROM anom",
            "SELECT 'anomaly_column', col, unnest([" + ", ".join(f"'{n}'" for n, _ in limits) + "]), unnest([" + ", ".join(f"({x})::DOUBLE" for _, x in limits) + f"]), {nothing} FROM st JOIN fence USING (col) WHERE outl > 0"]
        if cleaned:
            parts += [f"SELECT 'cleaned_shape', NULL, 'rows', count(*), {nothing} FROM (SELECT DISTINCT * FROM fx)", f"SELECT 'cleaned_shape', NULL, 'columns', 10, {nothing}"]
        return query(view, "\nUNION ALL ".join(parts), st(view), fence(view), miss(view), vc(view), corr(view), text_share(view), score(view), insight(view), anom(view), common)

    def anom(view: str) -> str:
        iq = " OR ".join(f"coalesce({c} < (SELECT lo FROM fence WHERE col = '{c}' AND outl > 0) OR {c} > (SELECT hi FROM fence WHERE col = '{c}' AND outl > 0), false)" for c in nums(view))
        z = " OR ".join(f"coalesce(abs({c} - (SELECT mean FROM st WHERE col = '{c}')) / (SELECT std FROM st WHERE col = '{c}' AND n >= 5 AND std > 0) > 3, false)" for c in nums(view))
        return f"anom AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (WHERE {iq}) AS iq, count(*) FILTER (WHERE {z}) AS z FROM fx)"
    sql["report_json"] = report_parts(Q, False)
    sql["report_long"] = report_parts(R, True)
    sql["version_select"] = query("fx_dups", """SELECT 'cleaned' AS choice, count(*) AS rows FROM (SELECT DISTINCT * FROM fx)
UNION ALL SELECT 'original', count(*) FROM fx UNION ALL SELECT 'fallback', count(*) FROM fx""")
    sql["na_normalise"] = query("fx_nonfinite", "SELECT id, CASE WHEN raw_text IN ('NA', '', 'null') THEN NULL ELSE raw_text END AS raw_text, v IS NULL OR isnan(v) AS v_missing FROM fx")
    sql["sanitize_nonfinite"] = query("fx_nonfinite", "SELECT id, CASE WHEN isfinite(v) THEN v END AS v FROM fx")

    # quality
    sql["missing_by_column"] = query(Q, f'SELECT col AS "column", missing, {pct("missing", "n_rows")} AS missing_pct FROM miss', miss(Q))
    parts = (st(Q), fence(Q), miss(Q), text_share(Q), score(Q))
    sql["quality_score"] = query(Q, "SELECT * FROM score", *parts)
    sql["duplicate_count"] = query("fx_dups", f"SELECT rows, rows - d AS duplicates, {left_pct('(rows - d)', 'rows')} AS uniqueness FROM (SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)) AS d FROM fx)")
    sql["iqr_outliers"] = query(Q, f'SELECT st.col AS "column", {r("q1")} AS q1, {r("q3")} AS q3, n AS non_null, outl AS outliers FROM st JOIN fence USING (col)', st(Q), fence(Q))
    sql["validity"] = query("fx_code", "SELECT col AS \"column\", round(share, 4) AS numeric_share, CASE WHEN share > 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS issue FROM txt", text_share("fx_code"))
    sql["column_stats_numeric"] = query(O, f"""SELECT st.col AS "column", dt AS dtype, missing AS missing_count, {pct('missing', 'st.n_rows')} AS missing_pct, st.uniq AS unique_count,
  {rs('mean')} AS mean, {rs('std')} AS std, {r('mn')} AS min, {r('mx')} AS max, {r('q1')} AS q25, {r('q2')} AS median, {r('q3')} AS q75,
  {r('skew')} AS skewness, {r('kurt')} AS kurtosis, outl AS outlier_count FROM st JOIN fence USING (col) JOIN miss USING (col)""", st(O), fence(O), miss(O))
    wide = """SELECT '{c}' AS "column", CASE '{c}' WHEN 'dear' THEN 'double' ELSE 'bigint' END AS dtype, count(*) - count({c}) AS missing_count, 0.0::DOUBLE AS missing_pct,
  count(DISTINCT {c}) AS unique_count, MEAN AS mean, STD AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, 0::BIGINT AS outlier_count FROM fx"""
    sql["column_stats_wide"] = query("fx_wide", "\nUNION ALL ".join(
        wide.replace("MEAN", rs(f"avg({c}::DOUBLE)")).replace("STD", f"round(stddev_samp({c}::DOUBLE), 1)").replace("{c}", c) for c in ("id", "big", "dear")))
    top = "top AS (SELECT col, arg_min(v, (-cnt, v)) AS v, max(cnt) AS cnt, sum(cnt) AS total, count(*) AS k FROM vc GROUP BY col)"
    sql["column_stats_categorical"] = query(R, f"""SELECT col AS "column", dt AS dtype, missing AS missing_count, {pct('missing', 'n_rows')} AS missing_pct, uniq AS unique_count, v AS top_value
FROM miss JOIN top USING (col)""", miss(R), vc(R), top)
    sql["quality_grade"] = query(Q, "SELECT overall_score, CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Fair' ELSE 'Poor' END AS grade FROM score", *parts)
    p = "missing::DOUBLE / n_rows * 100"
    fill_rule = f"""SELECT 'missing_values' AS "type", col AS "column", CASE WHEN {p} > 30 THEN 'high' WHEN {p} > 10 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN skew IS NULL THEN 'mode' WHEN abs(skew) > 1 THEN 'median' ELSE 'mean' END AS strategy, {one(p)} || '% of ''' || col || ''' is missing' AS description
FROM miss LEFT JOIN (SELECT col, skew FROM st) USING (col) WHERE missing > 0"""
    sql["suggest_missing"] = query(Q, fill_rule, miss(Q), st(Q))
    copies_rule = f"""SELECT 'duplicates' AS "type", NULL::VARCHAR AS "column", 'medium' AS severity, 'drop_duplicates' AS strategy,
  d || ' duplicate rows (' || {one('d::DOUBLE / n * 100')} || '%)' AS description FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)) AS d FROM fx) WHERE d > 0"""
    sql["suggest_duplicates"] = query(Q, copies_rule)
    p = "outl::DOUBLE / n * 100"
    clip_rule = f"""SELECT 'outliers' AS "type", col AS "column", CASE WHEN {p} > 10 THEN 'high' ELSE 'medium' END AS severity, 'iqr_clip' AS strategy,
  outl || ' outliers in ''' || col || ''' (' || {one(p)} || '%)' AS description FROM st JOIN fence USING (col) WHERE n > 0 AND {p} > 1"""
    sql["suggest_outliers"] = query(Q, clip_rule, st(Q), fence(Q))
    sql["attention_columns"] = query(Q, f"""SELECT col AS "column", 'missing' AS reason, {pct('missing', 'n_rows')} AS "value" FROM miss WHERE missing > 0
UNION ALL SELECT col, 'mostly_missing', {pct('missing', 'n_rows')} FROM miss WHERE {pct('missing', 'n_rows')} > 10
UNION ALL SELECT col, 'outliers', outl::DOUBLE FROM fence WHERE outl > 0
UNION ALL SELECT col, 'skewed', {r('skew')} FROM st WHERE abs(round(skew, 4)) > 2""", miss(Q), st(Q), fence(Q))

    # cleaning
    sql["fill_mean"] = query(Q, "SELECT * REPLACE (round(coalesce(price, (SELECT avg(price) FROM fx)), 4) AS price) FROM fx")
    sql["fill_median"] = query(O, "SELECT * REPLACE (coalesce(value, (SELECT median(value) FROM fx)) AS value) FROM fx")
    mode = "(SELECT {c} FROM fx WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    filled = ", ".join(f"coalesce({c}, {mode.format(c=c)}) AS {c}" for c in ("price", "priority", "status"))
    sql["fill_mode"] = query(Q, f"SELECT * REPLACE ({filled}) FROM fx")
    sql["fill_auto"] = query(O, "SELECT * REPLACE (coalesce(value, (SELECT CASE WHEN abs(skewness(value)) > 1 THEN median(value) ELSE avg(value) END FROM fx)) AS value) FROM fx")
    sql["drop_missing"] = query(Q, "SELECT * FROM fx WHERE price IS NOT NULL AND priority IS NOT NULL AND status IS NOT NULL")
    sql["fill_custom"] = query(Q, "SELECT * REPLACE (round(coalesce(price, (SELECT avg(price) FROM fx)), 4) AS price) FROM fx WHERE status IS NOT NULL")
    sql["drop_duplicates"] = query("fx_dups", "SELECT DISTINCT * FROM fx")

    def clip(c: str, lo: str, hi: str) -> str:
        return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c}::DOUBLE END"

    sql["clip_iqr"] = query(O, f"SELECT id::DOUBLE AS id, round({clip('value', '(SELECT lo FROM fence WHERE col = $$value$$)', '(SELECT hi FROM fence WHERE col = $$value$$)')}, 4) AS value, rare_flag::DOUBLE AS rare_flag, event_type FROM fx".replace("$$", "'"), st(O), fence(O))
    zlo, zhi = "(SELECT mean - 3 * std FROM st WHERE col = '{c}')", "(SELECT mean + 3 * std FROM st WHERE col = '{c}')"
    zclip = {c: clip(c, zlo.format(c=c), zhi.format(c=c)) for c in nums(O)}
    sql["clip_zscore"] = query(O, f"SELECT {zclip['id']} AS id, round({zclip['value']}, 4) AS value, round({zclip['rare_flag']}, 4) AS rare_flag, event_type FROM fx", st(O))
    sql["cleaning_log"] = query(Q, """SELECT row_number() OVER (ORDER BY step) AS step, "column", action, "value", affected FROM (
  SELECT 1 AS step, 'price' AS "column", 'drop_rows' AS action, NULL::VARCHAR AS "value", (SELECT count(*) FROM fx WHERE price IS NULL) AS affected
  UNION ALL SELECT 2, 'priority', 'fill_mode', (SELECT priority FROM kept WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT count(*) FROM kept WHERE priority IS NULL)
  UNION ALL SELECT 3, 'status', 'fill_mode', (SELECT status FROM kept WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT count(*) FROM kept WHERE status IS NULL)
  UNION ALL SELECT 4, NULL, 'drop_duplicates', NULL, (SELECT count(*) FROM kept) - (SELECT count(*) FROM uniq)
  UNION ALL SELECT 5, 'spiky', 'clip_iqr', '[' || format('{:.4f}', lo) || ', ' || format('{:.4f}', hi) || ']', (SELECT count(*) FROM uniq WHERE spiky < lo OR spiky > hi) FROM b) WHERE affected > 0""",
        "kept AS MATERIALIZED (SELECT * FROM fx WHERE price IS NOT NULL)",
        """uniq AS MATERIALIZED (SELECT DISTINCT * REPLACE (coalesce(priority, (SELECT priority FROM kept WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
  coalesce(status, (SELECT status FROM kept WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status) FROM kept)""",
        "b AS (SELECT quantile_cont(spiky, 0.25) - 1.5 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) AS lo, quantile_cont(spiky, 0.75) + 1.5 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) AS hi FROM uniq)")
    text_mode = ", ".join(f"coalesce({c}, {mode.format(c=c)}) AS {c}" for c in ("priority", "status"))
    bound = "b_{c} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM uniq))"
    sql["clean_pipeline"] = query(Q, "SELECT id::DOUBLE AS id, " + ", ".join(
        f"round({clip(c, f'(SELECT lo FROM b_{c})', f'(SELECT hi FROM b_{c})')}, 4) AS {c}" for c in ("price", "spiky")) + ", priority, status, cust_text, day_text FROM uniq",
        f"uniq AS MATERIALIZED (SELECT DISTINCT * REPLACE (coalesce(price, (SELECT avg(price) FROM fx)) AS price, {text_mode}) FROM fx)", bound.format(c="price"), bound.format(c="spiky"))

    sql["cleaning_suggestions"] = query(Q, "\nUNION ALL ".join((fill_rule, copies_rule, clip_rule)), miss(Q), st(Q), fence(Q))
    sql["cleaning_summary"] = query(Q, "SELECT a AS rows_before, b AS rows_after, a - b AS rows_removed FROM (SELECT count(*) AS a, (SELECT count(*) FROM uniq) AS b FROM fx)",
        f"uniq AS MATERIALIZED (SELECT DISTINCT * REPLACE (coalesce(price, (SELECT avg(price) FROM fx)) AS price, {text_mode}) FROM fx)")

    # profile
    sql["profile_overview"] = query(Q, f"""SELECT max(n_rows) AS rows, 7 AS columns, 3 AS numeric_cols, 4 AS categorical_cols, sum(n_rows)::BIGINT AS total_cells, sum(missing)::BIGINT AS missing_cells,
  max(n_rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx)) AS duplicate_rows, {pct('sum(missing)', 'sum(n_rows)')} AS missing_pct FROM miss""", miss(Q))
    sql["data_bytes"] = query(Q, each(nums(Q), "SELECT '{c}' AS \"column\", 8 * count({c}) AS bytes FROM fx") + "\nUNION ALL " + each(cats(Q), "SELECT '{c}', coalesce(sum(strlen({c})), 0)::BIGINT FROM fx"))
    sql["profile_columns"] = query(R, f'SELECT col AS "column", dt AS dtype, n AS count, missing, {pct("missing", "n_rows")} AS missing_pct, uniq AS "unique", {pct("uniq", "n_rows")} AS unique_pct FROM miss', miss(R))
    names = [("mean", "mean"), ("std", "std"), ("variance", "variance"), ("mn", "min"), ("mx", "max"), ("mx - mn", "range"), ("q1", "q1"), ("q2", "median"), ("q3", "q3"), ("q3 - q1", "iqr"), ("skew", "skewness"), ("kurt", "kurtosis"), ("std / nullif(mean, 0)", "cv")]
    sql["profile_numeric"] = query(O, 'SELECT col AS "column", ' + ", ".join(f"{rs(x) if n in ('mean', 'std', 'variance') else r(x)} AS {n}" for x, n in names) + " FROM st WHERE n > 0", st(O))
    sql["profile_outliers"] = query(O, f'SELECT col AS "column", raw_out AS outliers, {pct("raw_out", "n")} AS outlier_pct FROM st JOIN fence USING (col) WHERE n > 0', st(O), fence(O))
    sql["profile_signs"] = query(C, 'SELECT col AS "column", zeros, negs AS negatives FROM st WHERE n > 0', st(C))
    jb = "(n / 6.0 * (pow(skew * (n - 2) / sqrt(n::DOUBLE * (n - 1)), 2) + pow((kurt * (n - 2) * (n - 3) / (n - 1)::DOUBLE - 6) / (n + 1), 2) / 4))"
    sql["normality_jb"] = query(O, f'SELECT col AS "column", n, {rs(jb)} AS jb, round(exp(-{jb} / 2), 6) AS p_value, exp(-{jb} / 2) > 0.05 AS is_normal FROM st WHERE n > 4', st(O))
    sql["numeric_sample"] = query(O, each(nums(O), "SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY id) AS \"rank\", {c}::DOUBLE AS \"value\" FROM fx WHERE {c} IS NOT NULL) WHERE \"rank\" <= 2000"))
    ranked = 'SELECT col AS "column", "rank", v AS "value", cnt AS count FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, v) AS "rank" FROM vc) WHERE "rank" <= '
    sql["category_top_k"] = query(R, ranked + "20", vc(R))
    sql["category_summary"] = query(R, f'SELECT col AS "column", v AS top_value, cnt AS top_freq, {pct("cnt", "total")} AS top_freq_pct, k = 2 AS is_binary FROM top', vc(R), top)
    sql["category_entropy"] = query(R, each(cats(R), "SELECT '{c}' AS \"column\", round(abs(entropy({c}) * ln(2)), 4) AS entropy FROM fx"))
    sql["correlation_matrix"] = query(C, """SELECT a AS col1, b AS col2, round(r, 4) + 0.0 AS r FROM pairs UNION ALL SELECT b, a, round(r, 4) + 0.0 FROM pairs
UNION ALL SELECT col, col, CASE WHEN std > 0 THEN 1.0 END FROM st""", corr(C), st(C))
    sql["high_correlation"] = query(C, "SELECT a AS col1, b AS col2, round(r, 4) AS correlation, CASE WHEN abs(r) > 0.9 THEN 'very strong' ELSE 'strong' END AS strength FROM pairs WHERE abs(r) > 0.7", corr(C))
    sql["skewness_bands"] = query(R, "SELECT col AS \"column\", round(skew, 3) + 0.0 AS skewness, CASE WHEN abs(skew) > 2 THEN 'high' WHEN abs(skew) > 1 THEN 'moderate' ELSE 'low' END AS band FROM st", st(R))
    asc = ", ".join(f"{c} NULLS FIRST" for c in COLUMNS[Q])
    sql["missing_pattern"] = query(Q, each(COLUMNS[Q], "SELECT rn AS row, '{c}' AS \"column\", ({c} IS NULL)::INT AS missing FROM f100"), f"f100 AS (SELECT *, row_number() OVER (ORDER BY {asc}) AS rn FROM fx QUALIFY rn <= 100)")
    sql["column_search"] = query(C, "SELECT col AS \"column\", dt AS dtype, n AS count, missing FROM miss WHERE col ILIKE '%quant%'", miss(C))

    # explore
    sql["histogram"] = query(O, each(nums(O), f"""SELECT '{{c}}' AS "column", b::INT AS bin, {r('any_value(mn) + b * any_value(w)')} AS lower, {r('any_value(mn) + (b + 1) * any_value(w)')} AS upper, count(*) AS count
FROM (SELECT mn, (mx - mn) / k AS w, least(floor(({{c}} - mn) / ((mx - mn) / k)), k - 1) AS b FROM fx, (SELECT mn, mx, least(30, greatest(10, n // 20)) AS k FROM st WHERE col = '{{c}}') WHERE {{c}} IS NOT NULL) GROUP BY b"""), st(O))
    sql["box_stats"] = query(O, f'SELECT col AS "column", {r("q1")} AS q1, {r("q2")} AS median, {r("q3")} AS q3, {r("imin")} AS whisker_low, {r("imax")} AS whisker_high, raw_out AS outliers FROM st JOIN fence USING (col)', st(O), fence(O))
    sql["top_correlated_pair"] = query("lineitem", "SELECT a AS col1, b AS col2, round(r, 4) AS r FROM pairs ORDER BY abs(coalesce(r, 0)) DESC, i, j LIMIT 1", corr("lineitem"))
    sql["scatter_pair"] = query(C, "SELECT l_extendedprice AS x, net AS y FROM fx WHERE l_extendedprice IS NOT NULL AND net IS NOT NULL ORDER BY l_orderkey, l_linenumber, net LIMIT 2000")
    sql["missing_bar"] = query(Q, 'SELECT col AS "column", missing FROM miss WHERE missing > 0', miss(Q))
    sql["category_bars"] = query(R, ranked + "15", vc(R, cats(R)[:3]))

    # insights
    for name, number, view in (("skewness", 1, R), ("correlation", 2, C), ("imbalance", 3, R), ("low_variance", 4, R), ("cardinality", 5, R), ("constant", 6, R), ("summary", 7, R)):
        sql[f"insight_{name}"] = insights(view, f"SELECT {FIELDS} FROM ins WHERE rule_no = {number}")
    sql["insights_all"] = insights(R, f"SELECT rule_no, {FIELDS} FROM ins")
    sql["insights_report"] = insights(C, f"SELECT rule_no, {FIELDS} FROM ins WHERE rule_no < 7")

    # anomaly
    fill = "coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM fx))"
    sql["impute_scale"] = query(O, "SELECT id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 6) + 0.0 AS {c}" for c in FLAGS) + " FROM f",
        "f AS MATERIALIZED (SELECT id, " + ", ".join(f"{fill.format(c=c)} AS {c}" for c in FLAGS) + " FROM fx)")
    lo, hi = "(SELECT lo FROM fence WHERE col = '{c}' AND outl > 0)", "(SELECT hi FROM fence WHERE col = '{c}' AND outl > 0)"
    flag = {c: f"coalesce({c} < {lo.format(c=c)} OR {c} > {hi.format(c=c)}, false)" for c in FLAGS}
    sql["iqr_row_flags"] = query(O, "SELECT id, " + ", ".join(f"{f} AS {c}_outlier" for c, f in flag.items()) + ", " + " OR ".join(flag.values()) + " AS row_outlier FROM fx", st(O), fence(O))
    sql["iqr_column_summary"] = query(O, f'SELECT col AS "column", outl AS count, {pct("outl", "n_rows")} AS pct, {r("lo")} AS lower_bound, {r("hi")} AS upper_bound, {r("omin")} AS min_anomaly, {r("omax")} AS max_anomaly FROM st JOIN fence USING (col) WHERE outl > 0', st(O), fence(O))
    zflag = {c: f"coalesce(abs(({c} - (SELECT mean FROM st WHERE col = '{c}')) / (SELECT std FROM st WHERE col = '{c}')) > 3, false)" for c in FLAGS}
    sql["zscore_flags"] = query(O, "SELECT id, " + ", ".join(f"{f} AS {c}_outlier" for c, f in zflag.items()) + ", " + " OR ".join(zflag.values()) + " AS row_outlier FROM fx", st(O))
    sql["anomaly_summary"] = query(O, f"SELECT n AS total_rows, iq AS iqr_rows, z AS zscore_rows, {pct('iq', 'n')} AS iqr_pct, {pct('z', 'n')} AS zscore_pct FROM anom", st(O), fence(O), anom(O))

    # features
    sql["feat_log"] = query(R, "SELECT id, round(ln(1 + skewed), 6) AS skewed_log FROM fx")
    sql["feat_sqrt"] = query(R, "SELECT id, round(sqrt(greatest(skewed, 0)), 6) AS skewed_sqrt FROM fx")
    bins = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (SELECT count(DISTINCT e) FROM (SELECT unnest([q1, q2, q3]) AS e, mn, mx FROM st WHERE col = '{c}') WHERE e > mn AND e < mx AND e < {c})::INT END AS {c}_bin" for c in ("id", "bal", "skewed"))
    sql["feat_quartile_bin"] = query(R, f"SELECT id, {bins} FROM fx", st(R))
    sql["feat_zscore"] = query(R, "SELECT id, " + ", ".join(f"round(({c} - (SELECT mean FROM st WHERE col = '{c}')) / (SELECT std FROM st WHERE col = '{c}'), 4) + 0.0 AS {c}_z" for c in ("bal", "nearly_flat", "skewed")) + " FROM fx", st(R))
    branches = "\nUNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{a}_x_{b}' AS feature, {a}::DOUBLE * {b}::DOUBLE AS \"value\" FROM fx WHERE '{a}_x_{b}' IN (SELECT name FROM chosen)" for a, b in combinations(nums(C), 2))
    sql["feat_interaction"] = query(C, branches, corr(C), "chosen AS MATERIALIZED (SELECT a || '_x_' || b AS name FROM pairs WHERE abs(r) > 0.5 ORDER BY i, j LIMIT 3)")
    sql["feat_ratio"] = query(C, "SELECT l_orderkey, l_linenumber, round(l_orderkey / (l_linenumber + 1e-9::DOUBLE), 4) AS l_orderkey_per_l_linenumber, round(l_linenumber / (l_quantity + 1e-9::DOUBLE), 4) AS l_linenumber_per_l_quantity FROM fx")
    sql["feat_binary"] = query(R, "SELECT id, coalesce(seg = (SELECT seg FROM fx GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1), false)::INT AS seg_enc FROM fx")
    hot = ", ".join(f"(market = '{m}')::INT AS market_{m}" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    sql["feat_onehot"] = query(R, f"SELECT id, {hot}, (const_text = 'K')::INT AS \"const_text_K\" FROM fx")
    sql["feat_target_encode"] = query(R, "SELECT id, round((coalesce(sum(bal) OVER w, 0) + 10 * (SELECT avg(bal) FROM fx)) / (count(bal) OVER w + 10), 4) AS nation_target FROM fx WINDOW w AS (PARTITION BY nation)")
    sql["feat_hash"] = query(R, "SELECT id, ('0x' || substr(md5(name), 1, 8))::BIGINT % 1000 AS name_hash FROM fx")
    sql["feat_datetime"] = query(Q, "SELECT id, year(day_text::DATE) AS day_text_year, month(day_text::DATE) AS day_text_month, isodow(day_text::DATE) - 1 AS day_text_weekday FROM fx")
    whole, first = ("us", "dots", "long_name", "short_year", "weekday", "slashes", "dashes", "half_day", "iso"), {"months": "month", "named": "month", "timed_year": "year"}
    spelled = [(c, "day") for c in whole] + [(c, f"date_trunc('{u}', day)::DATE") for c, u in first.items()]
    sql["feat_datetime_spellings"] = query("fx_dates", "\nUNION ALL ".join(f"SELECT id, '{c}' AS \"column\", year({d}) AS year, month({d}) AS month, isodow({d}) - 1 AS weekday FROM fx" for c, d in spelled))
    shapes = {"us": "number-number-year", "dots": "number-number-year", "months": "year-month", "named": "name-year", "long_name": "name-day-year", "short_year": "number-number-year",
              "weekday": "name-day-year", "slashes": "year-month-day", "dashes": "day-name-year", "half_day": "year-month-day", "timed_year": "year", "iso": "year-month-day"}
    late = "count(*) FILTER (day(day) > 12)"
    sql["date_shapes"] = query("fx_dates", "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS shape, count(*) AS \"rows\", {late if c == 'dots' else 0} AS day_first, {late if c in ('us', 'short_year') else 0} AS month_first FROM fx" for c, s in shapes.items()))
    sql["feature_suggestions"] = query(R, "SELECT * FROM sug", st(R), miss(R), corr(R), suggestions(R))
    sql["suggestion_totals"] = query(R, "SELECT count(*) AS total_suggestions, count(*) FILTER (WHERE priority = 'high') AS high_priority FROM sug", st(R), miss(R), corr(R), suggestions(R))
    sql["auto_features"] = query(C, "SELECT feature AS name, \"type\" FROM sug WHERE \"type\" IN ('log_transform', 'interaction')", st(C), miss(C), corr(C), suggestions(C))
    sql["suggestion_filter"] = query(R, "SELECT * FROM sug WHERE priority = 'high' AND (title ILIKE '%sk%' OR \"column\" ILIKE '%sk%')", st(R), miss(R), corr(R), suggestions(R))

    # models
    targets = ("q", "d", "y_num", "y_txt")
    sql["task_single"] = query(M, each(targets, "SELECT '{c}' AS \"column\", CASE WHEN typeof(any_value({c})) = 'VARCHAR' OR count(DISTINCT {c}) < 10 OR (typeof(any_value({c})) IN ('INTEGER', 'BIGINT') AND count(DISTINCT {c}) < 15) THEN 'classification' ELSE 'regression' END AS task FROM fx"))
    sql["task_automl"] = query(M, each(targets, "SELECT '{c}' AS \"column\", CASE WHEN typeof(any_value({c})) = 'VARCHAR' OR count(DISTINCT {c}) < 15 THEN 'classification' ELSE 'regression' END AS task FROM fx"))
    share = "(1 - count({c})::DOUBLE / count(*))"
    sql["ml_keep_columns"] = query(M, each(("q", "d", "flag", "const_text", "sparse", "y_num", "y_txt"), f"SELECT '{{c}}' AS \"column\", round({share}, 4) AS null_share, count(DISTINCT {{c}}) <= 1 AS is_constant, {share} < 0.5 AND (count(DISTINCT {{c}}) > 1 OR '{{c}}' = 'y_txt') AS keep FROM fx"))
    sql["label_encode"] = query(Q, "SELECT id, " + ", ".join(f"dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS {c}" for c in ("priority", "status")) + " FROM fx")
    sql["ml_impute"] = query(M, "SELECT k, q, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM fx)) AS d FROM fx")
    sql["target_prepare"] = query(Q, "SELECT id, (dense_rank() OVER (ORDER BY priority) - 1)::INT AS label, priority AS class_name FROM fx WHERE priority IS NOT NULL")
    sql["min_rows_guard"] = query(M, "SELECT count(*) AS rows, count(*) >= 10 AS enough FROM fx")
    sql["hash_split"] = query(M, "SELECT k, ('0x' || substr(md5(k), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM fx")
    sql["model_knn"] = query(M, """SELECT k, label, prediction FROM prep JOIN answer USING (q, d, flag) WHERE is_test""", *prepared(),
        "few AS MATERIALIZED (SELECT * FROM prep WHERE NOT is_test QUALIFY row_number() OVER (PARTITION BY q, d, flag ORDER BY k) <= 5)",
        "ask AS MATERIALIZED (SELECT DISTINCT q, d, flag FROM prep WHERE is_test)",
        """near AS (SELECT a.q, a.d, a.flag, f.label FROM ask a, few f QUALIFY row_number() OVER (PARTITION BY a.q, a.d, a.flag
  ORDER BY sqrt((a.q - f.q) * (a.q - f.q) + (a.d - f.d) * (a.d - f.d) + (a.flag - f.flag) * (a.flag - f.flag)), f.k) <= 5)""",
        "answer AS (SELECT q, d, flag, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS prediction FROM near GROUP BY ALL)")
    rule = ["cm AS MATERIALIZED (SELECT y_txt AS label, CASE WHEN q > 25 THEN 'hi' ELSE 'lo' END AS prediction, count(*) AS n FROM fx GROUP BY ALL)",
        """cls AS MATERIALIZED (SELECT c AS class, coalesce(hit / nullif(pred, 0), 0) AS p, coalesce(hit / nullif(sup, 0), 0) AS rc, coalesce(2 * hit / nullif(sup + pred, 0), 0) AS f, sup, hit FROM (
  SELECT c, (SELECT coalesce(sum(n), 0)::DOUBLE FROM cm WHERE label = c) AS sup, (SELECT coalesce(sum(n), 0)::DOUBLE FROM cm WHERE prediction = c) AS pred,
    (SELECT coalesce(sum(n), 0)::DOUBLE FROM cm WHERE label = c AND prediction = c) AS hit FROM (SELECT label AS c FROM cm UNION SELECT prediction FROM cm)))"""]
    sql["metrics_classification"] = query(M, "SELECT round(sum(hit) / sum(sup), 4) AS accuracy, round(sum(f * sup) / sum(sup), 4) AS f1_score FROM cls", *rule)
    sql["classification_report"] = query(M, """SELECT class, round(p, 4) AS precision, round(rc, 4) AS recall, round(f, 4) AS f1, sup::BIGINT AS support FROM cls
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(sup), 4), round(sum(hit) / sum(sup), 4), round(sum(hit) / sum(sup), 4), sum(sup)::BIGINT FROM cls
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(rc), 4), round(avg(f), 4), sum(sup)::BIGINT FROM cls
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 4), round(sum(rc * sup) / sum(sup), 4), round(sum(f * sup) / sum(sup), 4), sum(sup)::BIGINT FROM cls""", *rule)
    sql["metrics_regression"] = query(M, "SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(y), 4) AS r2_score FROM (SELECT y_num AS y, y_num - (2 * q + 4) AS e FROM fx)")
    for name in ("Ridge", "Lasso"):
        sql[f"model_{name.lower()}"] = linear(f"SELECT 'q' AS term, round(b, 6) AS weight FROM w WHERE model = '{name}' UNION ALL SELECT '(intercept)', round(my - b * mx, 6) FROM w WHERE model = '{name}'")
    sql["leaderboard_rank"] = linear(BOARD_SQL)
    sql["leaderboard_roundtrip"] = linear(BOARD_SQL)
    sql["leaderboard_predict"] = linear(f"SELECT k, round(my + b * (q - mx), 3) AS prediction FROM fx, w WHERE model = (SELECT model FROM ({BOARD_SQL}) WHERE is_best)")

    sql["leaderboard_summary"] = linear(f"""SELECT 'regression' AS task, (SELECT model FROM ({BOARD_SQL}) WHERE is_best) AS best_model, 2 AS n_models_trained, 1 AS n_models_failed,
  count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test FROM prep""")

    # explanation of a linear score: weight times distance from the background mean
    sql["shapley_values"] = shap("SELECT * FROM phi")
    sql["shapley_global"] = shap("SELECT * FROM imp")
    sql["shapley_points"] = shap('SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY k) AS point, "value", contribution, importance FROM phi JOIN imp USING (feature) QUALIFY point <= 50')
    sql["shapley_row"] = shap("SELECT feature, contribution, CASE WHEN contribution >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM phi WHERE k = (SELECT min(k) FROM phi)")
    sql["feat_apply"] = query(R, """SELECT id, round((bal - m) / s, 4) AS bal_z, CASE WHEN seg = (SELECT seg FROM tr GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) THEN 1 ELSE 0 END AS seg_enc,
  round((coalesce(total, 0) + 10 * m) / (coalesce(n, 0) + 10), 4) AS nation_target
FROM t LEFT JOIN (SELECT nation, sum(bal) AS total, count(bal) AS n FROM tr GROUP BY nation) USING (nation), (SELECT avg(bal) AS m, stddev_samp(bal) AS s FROM tr) WHERE is_test""",
        "t AS (SELECT *, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM fx)", "tr AS (SELECT * FROM t WHERE NOT is_test)")

    # the rows of each tree of the forest, by a mixed hash
    mix = lambda m, shift, by: f"((xor({m}, {m} >> {shift})::HUGEINT * {by}) % 4294967296)::BIGINT"
    sql["iforest_draws"] = query(O, """SELECT tree::INTEGER AS tree, id, xor(c, c >> 16) AS draw FROM d3, size
QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, id::VARCHAR) <= least(256, n)""",
        "size AS (SELECT count(*) AS n, least(100, greatest(10, count(*) // 10)) AS trees FROM fx)",
        "d1 AS (SELECT id, t.tree, (('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT + t.tree * 2654435769) % 4294967296 AS a FROM fx, (SELECT unnest(range(0, trees)) AS tree FROM size) t)",
        f"d2 AS (SELECT id, tree, {mix('a', 16, 2246822507)} AS b FROM d1)", f"d3 AS (SELECT id, tree, {mix('b', 13, 3266489909)} AS c FROM d2)")

    for kind in ("parquet", "json", "csv"):
        sql[f"{kind}_folder"] = query("orders", """SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END::DOUBLE AS o_totalprice,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM fx""")

    # inputs whose results are known
    S = "fx_step"
    cls = ["Decision Tree", "Extra Trees", "Gradient Boosting", "KNN", "Logistic Regression", "Random Forest"]
    num = [m for m in cls if m != "Logistic Regression"]
    right = "(SELECT avg(CASE WHEN (v = 1) = (y_txt = 'hi') AND 10 * v = y_num THEN 1.0 ELSE 0.0 END) FROM fx)::DOUBLE"
    sql["step_leaderboard"] = query(S, "\nUNION ALL ".join(
        [f"SELECT 'y_txt' AS target, {i} AS \"rank\", '{m}' AS model, 'success' AS status, {right} AS score, {right} AS accuracy, {right} AS f1_score, NULL::DOUBLE AS rmse, NULL::DOUBLE AS mae, NULL::DOUBLE AS r2_score, {i} = 1 AS is_best" for i, m in enumerate(cls, 1)]
        + [f"SELECT 'y_num', {i}, '{m}', 'success', {right}, NULL, NULL, 0.0::DOUBLE, 0.0::DOUBLE, {right}, {i} = 1" for i, m in enumerate(num, 1)]))
    sql["step_importance"] = query(S, f"SELECT 'v' AS feature, {right} AS importance")
    test = "test AS (SELECT * FROM fx WHERE ('0x' || substr(md5(k), 1, 8))::BIGINT % 10000 < 2000)"
    sql["step_report"] = query(S, """SELECT y_txt AS class, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, count(*) AS support FROM test GROUP BY y_txt
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), 1.0, 1.0, 1.0, (SELECT count(*) FROM test)""", test)
    sql["step_classes"] = query("fx_step3", """SELECT model, class, count(*) AS support, count(*) AS hits, true AS sure, 0.0::DOUBLE AS rest
FROM (SELECT CASE WHEN v < 3 THEN 0 WHEN v < 5 THEN 1 ELSE 2 END AS class FROM test), (SELECT unnest(['boosting', 'extra trees']) AS model) GROUP BY model, class""", test)
    train = "train AS (SELECT * FROM fx WHERE ('0x' || substr(md5(k), 1, 8))::BIGINT % 10000 >= 2000)"
    sql["step_shapley"] = query(S, """SELECT 'v' AS feature, round(avg(abs(round(v - m, 6))), 6) AS importance, NULL::VARCHAR AS warning
FROM (SELECT v FROM test ORDER BY k LIMIT 200), (SELECT avg(v) AS m FROM (SELECT v FROM train ORDER BY k LIMIT 100))""", test, train)
    sql["step_fallback"] = query(S, f"SELECT 'v' AS feature, {right} AS importance, true AS warned")
    far = "id % 20 = 0"
    sql["far_summary"] = query("fx_far", f"""SELECT n AS total_rows, f AS iqr_rows, z AS zscore_rows, {pct('f', 'n')} AS iqr_pct, {pct('z', 'n')} AS zscore_pct, f AS iforest_rows, {pct('f', 'n')} AS iforest_pct FROM (
  SELECT count(*) AS n, count(*) FILTER ({far}) AS f, count(*) FILTER (abs(v - m) / s > 3) AS z FROM fx, (SELECT avg(v) AS m, stddev_samp(v) AS s FROM fx))""")
    sql["far_rows"] = query("fx_far", f"SELECT id, {far} AS is_anomaly FROM fx")
    sql["far_flagged"] = query("fx_far", f"SELECT id FROM fx WHERE {far} ORDER BY id LIMIT 100")
    return sql
