"""The same results stated in plain SQL over the raw tables, for the registered queries."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from tabwright.sources.fixtures import OBS_FEATURES

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
SHORT = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
NUMERIC = ["f_tax", "f_size", "f_retail", "f_order", "f_spiky", "f_size2"]


def u(key: str, salt) -> str:
    """The draw of a key: the first 52 bits of the md5 digest of 'key:salt'."""
    return f"(CAST('0x' || substr(md5(CAST(({key}) AS VARCHAR) || ':{salt}'), 1, 13) AS BIGINT) / 4503599627370496.0E0)"


OBS = """obs AS (
 SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
  l.l_orderkey * 7919 + l.l_linenumber * 104729 + l.l_partkey * 31 + l.l_suppkey AS k,
  CASE WHEN l.l_suppkey % 50 = 0 THEN NULL ELSE l.l_extendedprice / 1000.0E0 END AS target,
  CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS gender,
  CAST(year(o.o_orderdate) AS INT) AS year_collect,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 13 = 0 THEN NULL ELSE l.l_quantity END AS f_qty,
  CASE WHEN l.l_partkey % 41 = 0 THEN NULL ELSE l.l_discount END AS f_disc,
  l.l_tax AS f_tax, CAST(p.p_size AS DOUBLE) AS f_size, p.p_retailprice AS f_retail,
  o.o_totalprice AS f_order,
  l.l_quantity * (CASE WHEN l.l_orderkey % 97 = 0 THEN 20.0E0 ELSE 1.0E0 END) AS f_spiky,
  2.0E0 * p.p_size + l.l_orderkey % 7 AS f_size2,
  3.0E0 * l.l_quantity - 0.5E0 * p.p_size + 10.0E0 * l.l_tax * l.l_tax AS signal
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""
BIN = """binary_obs AS (
 SELECT b.doc_id, CAST(b.quality AS DOUBLE) AS y, CAST(d.n_chars AS DOUBLE) AS x_chars, d.lang AS x_lang
 FROM labels b JOIN documents d ON b.doc_id = d.doc_id)"""
SCORES = """scores AS (
 SELECT event_type AS method, CAST(user_id % 10 AS INT) AS fold, -avg(value) AS error
 FROM events GROUP BY event_type, user_id % 10)"""
POP = """pop AS (
 SELECT c_custkey AS program_id, 1.0E0 + abs(c_acctbal) / 1000.0E0 AS raw_fitness,
  1.0E0 + abs(c_acctbal) / 1000.0E0 AS fitness, 3 + c_nationkey AS length, 1 + c_nationkey % 6 AS depth
 FROM customer)"""
CLUSTERED = """clustered AS (
 SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS cluster, o_totalprice AS x,
  CAST(year(o_orderdate) AS INT) AS year_collect, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS gender
 FROM orders)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def union(rows) -> str:
    return "\nUNION ALL ".join(rows)


def digits(e: str) -> str:
    return f"CASE WHEN abs({e}) > 1e6 THEN round({e}, 0) ELSE round({e}, 5) END"


def q(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


SQL: dict[str, str] = {}
# The columns that seed 5 picks for the random subset.
_CHOSEN = ['f_retail', 'f_size2', 'f_spiky']

# --- scans, filters, set operations

SQL["labelled_unseen"] = with_(OBS) + f"SELECT {KEY}, f_tax FROM obs WHERE target IS NULL"
SQL["complete_rows"] = with_(OBS) + (f"SELECT {KEY}, f_qty, f_disc, target FROM obs WHERE f_qty IS NOT NULL "
                                     "AND f_disc IS NOT NULL AND target IS NOT NULL")
SQL["incomplete_rows"] = with_(OBS) + f"SELECT {KEY}, f_qty, f_disc FROM obs WHERE f_qty IS NULL OR f_disc IS NULL"
SQL["any_negative"] = with_(OBS) + "SELECT bool_or(" + " OR ".join(
    f"coalesce({c} < 0, false)" for c in [*OBS_FEATURES, "signal"]) + ") AS any_negative FROM obs"
SQL["first_rows"] = with_(OBS) + f"SELECT {KEY}, f_tax FROM obs ORDER BY {KEY} LIMIT 100"
SQL["near_constant"] = with_(OBS) + "SELECT feature FROM (" + union(
    f"SELECT '{c}' AS feature, stddev_samp({c}) AS s FROM obs" for c in OBS_FEATURES) + ") WHERE s < 0.05"
SQL["selected_columns"] = with_(OBS) + f"SELECT {KEY}, " + ", ".join(
    f"{c} AS \"{c}_01T\"" for c in [*OBS_FEATURES, "signal"]) + " FROM obs"
SQL["aligned_columns"] = """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, price_f, big_cust FROM
 (SELECT o_orderkey, o_totalprice AS price_f FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN
 (SELECT o_orderkey, o_custkey AS big_cust FROM orders WHERE o_totalprice > 200000) b
 ON a.o_orderkey = b.o_orderkey"""
_STD = ("b AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in OBS_FEATURES)
        + " FROM obs)")


def _std_out(cols, k=3):
    return "(" + " OR ".join(f"coalesce({c} < m_{c} - {k} * s_{c} OR {c} > m_{c} + {k} * s_{c}, false)"
                             for c in cols) + ")"


SQL["rows_without_outliers"] = with_(OBS, _STD) + (
    f"SELECT {KEY}, f_spiky, f_order FROM obs, b WHERE NOT {_std_out(['f_spiky', 'f_order'])}")
SQL["stacked_rows"] = with_(OBS, """m AS (SELECT avg(f_qty) AS mq, avg(f_disc) AS md FROM obs
 WHERE f_qty IS NOT NULL AND f_disc IS NOT NULL)""") + (
    f"SELECT {KEY}, round(coalesce(f_qty, mq), 6) AS f_qty, round(coalesce(f_disc, md), 6) AS f_disc FROM obs, m")
SQL["run_log_roundtrip"] = with_(POP) + """
SELECT 0 AS run_seed, CAST(depth - 1 AS INT) AS generation, round(avg(length), 8) AS average_length,
 round(avg(raw_fitness), 8) AS average_fitness,
 CAST(arg_min(length, (raw_fitness, program_id)) AS INT) AS best_length, round(min(raw_fitness), 8) AS best_fitness,
 CAST(NULL AS DOUBLE) AS best_val_fitness, CAST(NULL AS DOUBLE) AS best_oob_fitness,
 CAST(0 AS DOUBLE) AS generation_time
FROM pop GROUP BY depth"""

# --- profiling

SQL["missing_report"] = with_(OBS) + "SELECT feature, n_missing, round(100.0E0 * n_missing / n, 2) AS pct_missing, " \
    "100.0E0 * n_missing / n > 3 AS above_threshold FROM (" + union(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, count(*) AS n FROM obs"
    for c in [*OBS_FEATURES, "target"]) + ") WHERE n_missing > 0"
SQL["describe_numeric"] = with_(OBS) + union(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std,
 round(min({c}), 5) AS min, round({q(c, .25)}, 5) AS p25, round({q(c, .5)}, 5) AS p50, round({q(c, .75)}, 5) AS p75,
 round(max({c}), 5) AS max FROM obs""" for c in [*OBS_FEATURES, "target"])
SQL["percentiles"] = with_(OBS) + union(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, round({q(c, p)}, 6) AS value FROM obs"
    for c in OBS_FEATURES for p in (0.2, 0.4, 0.5, 0.6, 0.8))
SQL["target_rate"] = with_(OBS) + "SELECT round(avg(signal), 2) AS target_rate FROM obs"
SQL["corr_long"] = with_(OBS) + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS r FROM obs"
    for a, b in combinations([*OBS_FEATURES, "signal"], 2))


def ew(c: str, lo: str, hi: str, n: int = 10) -> str:
    return f"CAST(greatest(least(floor(({c} - {lo}) / ({hi} - {lo}) * {n}), {n - 1}), 0) AS INT)"


def _ranges(cols, src="obs"):
    return "r AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols) + f" FROM {src})"


SQL["contingency"] = with_(OBS, _ranges(["f_size"])) + f"""
SELECT {ew('f_size', 'lo_f_size', 'hi_f_size')} AS bin, year_collect, count(*) AS n FROM obs, r GROUP BY 1, 2"""
SQL["distinct_counts"] = with_(OBS) + union(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM obs"
    for c in ["gender", "year_collect", "f_tax", "f_size"])
SQL["box_statistics"] = with_(SCORES, f"""b AS (SELECT method, {q('error', .25)} AS a, {q('error', .5)} AS m,
 {q('error', .75)} AS c FROM scores GROUP BY method)""") + """
SELECT s.method, round(min(error), 8) AS min, round(any_value(a), 8) AS q25, round(any_value(m), 8) AS median,
 round(any_value(c), 8) AS q75, round(max(error), 8) AS max,
 round(min(CASE WHEN error BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) THEN error END), 8) AS whisker_low,
 round(max(CASE WHEN error BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) THEN error END), 8) AS whisker_high
FROM scores s JOIN b ON s.method = b.method GROUP BY s.method"""
SQL["fold_mean_sorted"] = with_(SCORES) + "SELECT method, round(avg(error), 8) AS error FROM scores GROUP BY method"
SQL["mean_covariance"] = with_(OBS) + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round((SELECT avg({a}) FROM obs), 5) AS mean_a, "
    f"{digits(f'covar_samp({a}, {b})')} AS cov FROM obs"
    for a in ("f_tax", "f_size", "f_order") for b in ("f_tax", "f_size", "f_order"))

# --- splits

SQL["train_test_split"] = with_(OBS) + f"SELECT {KEY}, k, {u('k', 7)} < 0.1 AS is_test FROM obs"
SQL["repeated_holdout"] = with_(OBS) + union(
    f"""SELECT {s} AS seed, count(*) AS n_train, round(avg(f_tax), 8) AS f_tax, round(avg(f_size), 8) AS f_size,
 round(avg(signal), 8) AS signal FROM obs WHERE target IS NOT NULL AND NOT {u('k', s)} < 0.1""" for s in range(1, 6))
SQL["val_holdout"] = with_(OBS) + f"""SELECT {KEY}, k,
 row_number() OVER (ORDER BY {u('k', 11)}, {KEY}) <= floor(0.1 * count(*) OVER ()) AS is_val FROM obs"""
SQL["kfold_sizes"] = with_(OBS) + f"""SELECT CAST(fold AS INT) AS fold, count(*) AS n, min(l_orderkey) AS first_key,
 round(sum(f_tax), 6) AS sum_tax FROM (SELECT *, ntile(7) OVER (ORDER BY {KEY}) - 1 AS fold FROM obs
 WHERE target IS NOT NULL) GROUP BY fold"""

# --- imputation

SQL["impute_mean_test"] = with_(OBS, f"""m AS (SELECT avg(f_qty) AS a, avg(f_disc) AS b, avg(target) AS c FROM obs
 WHERE NOT {u('k', 7)} < 0.1 AND f_qty IS NOT NULL AND f_disc IS NOT NULL AND target IS NOT NULL)""") + f"""
SELECT {KEY}, k, round(coalesce(f_qty, a), 6) AS f_qty, round(coalesce(f_disc, b), 6) AS f_disc,
 round(coalesce(target, c), 6) AS target FROM obs, m WHERE {u('k', 7)} < 0.1"""


def jb(c: str, src: str) -> str:
    return f"""(SELECT n, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb,
 mean, mid FROM (SELECT count({c}) AS n, avg(pow({c} - mu, 2)) AS m2, avg(pow({c} - mu, 3)) AS m3,
 avg(pow({c} - mu, 4)) AS m4, any_value(mu) AS mean, {q(c, .5)} AS mid
 FROM {src}, (SELECT avg({c}) AS mu FROM {src})))"""


_TRAIN = f"tr AS (SELECT * FROM obs WHERE NOT {u('k', 7)} < 0.1)"
_FILL = [f"fl_{c} AS (SELECT CASE WHEN exp(-jb / 2) > 0.05 THEN mid ELSE mean END AS v_{c} FROM {jb(c, 'tr')})"
         for c in ("f_qty", "f_disc")]
SQL["impute_by_shape"] = with_(OBS, _TRAIN, *_FILL) + f"""
SELECT {KEY}, k, round(coalesce(f_qty, v_f_qty), 6) AS f_qty, round(coalesce(f_disc, v_f_disc), 6) AS f_disc,
 f_tax, f_size, f_retail, f_order, f_spiky, f_size2 FROM obs, fl_f_qty, fl_f_disc WHERE {u('k', 7)} < 0.1"""
SQL["normality_report"] = with_(OBS) + union(
    f"""SELECT '{c}' AS feature, n, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 4) AS p,
 exp(-jb / 2) > 0.05 AS normal FROM {jb(c, 'obs')}""" for c in OBS_FEATURES)

# --- outliers


def _winsor(p1, p2):
    cols = ("f_qty", "f_order", "f_spiky")
    b = "b AS (SELECT " + ", ".join(f"{q(c, p1)} AS lo_{c}, {q(c, p2)} AS hi_{c}" for c in cols) + " FROM obs)"
    return with_(OBS, b) + f"SELECT {KEY}, " + ", ".join(
        f"round(CASE WHEN {c} > hi_{c} THEN hi_{c} WHEN {c} < lo_{c} THEN lo_{c} ELSE {c} END, 6) AS {c}"
        for c in cols) + " FROM obs, b"


SQL["winsorize_5_95"] = _winsor(0.05, 0.95)
SQL["winsorize_10_90"] = _winsor(0.1, 0.9)
SQL["outlier_std3"] = with_(OBS, _STD) + f"SELECT {KEY}, f_spiky FROM obs, b WHERE {_std_out(OBS_FEATURES)}"
_IQR = "b AS (SELECT " + ", ".join(f"{q(c, .25)} AS a_{c}, {q(c, .75)} AS c_{c}" for c in OBS_FEATURES) + " FROM obs)"
SQL["outlier_iqr17"] = with_(OBS, _IQR) + f"SELECT {KEY}, f_spiky FROM obs, b WHERE " + " OR ".join(
    f"coalesce({c} < a_{c} - 1.7E0 * (c_{c} - a_{c}) OR {c} > c_{c} + 1.7E0 * (c_{c} - a_{c}), false)"
    for c in OBS_FEATURES)
SQL["outlier_bounds"] = with_(OBS, _IQR) + union(
    f"SELECT '{c}' AS feature, round(a_{c} - 1.5 * (c_{c} - a_{c}), 6) AS lower, "
    f"round(c_{c} + 1.5 * (c_{c} - a_{c}), 6) AS upper FROM b" for c in OBS_FEATURES)
SQL["outlier_mahalanobis"] = with_(OBS, """s AS (SELECT avg(f_spiky) AS mx, avg(f_order) AS my,
 var_samp(f_spiky) AS xx, var_samp(f_order) AS yy, covar_samp(f_spiky, f_order) AS xy FROM obs)""", f"""
d AS (SELECT {KEY}, f_spiky, f_order, sqrt((yy * (f_spiky - mx) * (f_spiky - mx)
 - 2 * xy * (f_spiky - mx) * (f_order - my) + xx * (f_order - my) * (f_order - my)) / (xx * yy - xy * xy)) AS d
 FROM obs, s)""", "t AS (SELECT avg(d) + 3 * stddev_samp(d) AS cut FROM d)") + (
    f"SELECT {KEY}, f_spiky, f_order FROM d, t WHERE d >= cut")
SQL["log_transform"] = with_(OBS) + f"SELECT {KEY}, " + ", ".join(
    f"round(CASE WHEN {c} = 0 THEN 0.0001 WHEN {c} > 0 THEN ln({c}) END, 8) AS {c}"
    for c in ("f_tax", "f_order", "signal")) + " FROM obs"

# --- scaling and binning


def mm(c):
    return f"({c} - lo_{c}) / (hi_{c} - lo_{c})"


SQL["minmax"] = with_(OBS, _ranges(OBS_FEATURES)) + f"SELECT {KEY}, " + ", ".join(
    f"round({mm(c)}, 8) AS {c}" for c in OBS_FEATURES) + " FROM obs, r"
SQL["minmax_test"] = with_(OBS, _TRAIN, _ranges(["f_order", "f_retail"], "tr")) + f"SELECT {KEY}, k, " + ", ".join(
    f"round({mm(c)}, 8) AS {c}" for c in ["f_order", "f_retail"]) + f" FROM obs, r WHERE {u('k', 7)} < 0.1"
SQL["minmax_inverse"] = with_(OBS) + f"SELECT {KEY}, round(f_order, 6) AS f_order, round(signal, 6) AS signal FROM obs"
_EW = ["f_retail", "f_order", "f_spiky"]
SQL["equal_width_bins"] = with_(OBS, _ranges(_EW)) + f"SELECT {KEY}, " + ", ".join(
    f"{ew(c, 'lo_' + c, 'hi_' + c)} AS {c}" for c in _EW) + " FROM obs, r"


def _below(c, edges):
    return "CASE " + " ".join(f"WHEN {c} <= {e} THEN {i}" for i, e in enumerate(edges)) + " END"


SQL["quantile_bins"] = with_(OBS, "e AS (SELECT " + ", ".join(
    f"{q(c, i / 8)} AS {c}_{i}" for c in ("f_retail", "f_order") for i in range(1, 9)) + " FROM obs)") + (
    f"SELECT {KEY}, " + ", ".join(f"{_below(c, [f'{c}_{i}' for i in range(1, 9)])} AS {c}"
                                  for c in ("f_retail", "f_order")) + " FROM obs, e")
SQL["edge_bins"] = with_(OBS) + f"""SELECT {KEY}, CASE WHEN f_size < 5 THEN NULL WHEN f_size <= 10 THEN 0
 WHEN f_size <= 25 THEN 1 WHEN f_size <= 40 THEN 2 END AS bin FROM obs"""
POWERS = ["{x}", "CASE WHEN {x} > 0 THEN ln({x}) ELSE -50 END", "sqrt({x})", "exp({x})", "pow({x}, 1.0E0/3)",
          "pow({x}, 1.0E0/4)", "pow({x}, 1.0E0/5)", "pow({x}, 1.0E0/6)", "pow({x}, 1.0E0/7)", "{x} * {x}",
          "{x} * {x} * {x} * {x}"]
POWER_NAMES = ["x", "log", "sqrt", "exp", "**1/3", "**1/4", "**1/5", "**1/6", "**1/7", "**2", "**4"]
SQL["power_transforms"] = with_(OBS, _ranges(["f_retail"]), f"s AS (SELECT {KEY}, {mm('f_retail')} AS x FROM obs, r)") + (
    f"SELECT {KEY}, " + ", ".join(f"round({p.format(x='x')}, 7) AS t{i}" for i, p in enumerate(POWERS)) + " FROM s")


def _chi(long: str, keys: str) -> list[str]:
    """CTEs computing chi2 and dof per key from a (keys, bin, t) table, by expected counts."""
    return [f"o AS (SELECT {keys}, bin, t, count(*)::DOUBLE AS o FROM {long} GROUP BY ALL)",
            f"rw AS (SELECT {keys}, bin, sum(o) AS r FROM o GROUP BY ALL)",
            f"cl AS (SELECT {keys}, t, sum(o) AS c FROM o GROUP BY ALL)",
            f"tt AS (SELECT {keys}, sum(o) AS n FROM o GROUP BY ALL)",
            f"""cell AS (SELECT rw.*, cl.t, cl.c, tt.n, coalesce(o.o, 0) AS o FROM rw JOIN cl USING ({keys})
 JOIN tt USING ({keys}) LEFT JOIN o USING ({keys}, bin, t))""",
            f"""chi AS (SELECT {keys}, CASE WHEN dof = 1 THEN yates ELSE plain END AS chi2, dof FROM
 (SELECT {keys}, sum(pow(o - r * c / n, 2) / (r * c / n)) AS plain,
  sum(pow(abs(o - r * c / n) - 0.5, 2) / (r * c / n)) AS yates,
  (count(DISTINCT bin) - 1) * (count(DISTINCT t) - 1) AS dof FROM cell GROUP BY ALL))"""]


_RNG = [(0, 1), (-50, 0), (1, 2.718281828459045)] + [(0, 1)] * 8
_PLONG = "long AS (" + union(
    f"""SELECT '{c}' AS feature, {i} AS p, {ew('(' + POWERS[i].format(x=mm(c)) + ')', f'({float(lo)}E0)', f'({float(hi)}E0)')} AS bin,
 year_collect AS t FROM obs, r""" for c in ("f_retail", "f_order") for i, (lo, hi) in enumerate(_RNG)) + ")"
SQL["best_power_chi2"] = with_(OBS, _ranges(["f_retail", "f_order"]), _PLONG, *_chi("long", "feature, p")) + (
    "SELECT feature, CASE p " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(POWER_NAMES))
    + " END AS power, round(chi2, 6) AS chi2 FROM (SELECT *, row_number() OVER (PARTITION BY feature "
      "ORDER BY round(chi2, 7) DESC, p) AS rn FROM chi) WHERE rn = 1")

# --- feature worth

_CF = ["f_tax", "f_size", "f_retail", "f_order", "f_spiky"]


def _rank(v, desc=True):
    return (f"CAST(floor((2 * rank() OVER (ORDER BY {v} {'DESC' if desc else ''}) "
            f"+ count(*) OVER (PARTITION BY {v}) - 1) / 2) AS BIGINT)")


_CLONG = union(f"SELECT '{c}' AS feature, CAST({ew(c, 'lo_' + c, 'hi_' + c)} AS VARCHAR) AS bin, year_collect AS t "
               "FROM obs, r" for c in _CF)
SQL["chi2_rank"] = with_(OBS, _ranges(_CF), "long AS (" + _CLONG
                         + "\nUNION ALL SELECT 'gender', CAST(gender AS VARCHAR), year_collect FROM obs)",
                         *_chi("long", "feature")) + (
    f"SELECT feature, round(chi2, 6) AS chi2, dof, {_rank('chi2')} AS rank FROM chi")
SQL["chi2_yates"] = with_(OBS, """long AS (SELECT 'small' AS feature,
 CASE WHEN f_size <= 25 THEN 1 ELSE 0 END AS bin, gender AS t FROM obs)""", *_chi("long", "feature")) + (
    "SELECT feature, round(chi2, 8) AS chi2, dof FROM chi")


def _ols(cols, y="signal"):
    return "ols AS (" + union(f"SELECT '{c}' AS feature, regr_r2({y}, {c}) AS r2, "
                              f"round(regr_slope({y}, {c}), 3) AS slope FROM obs" for c in cols) + ")"


SQL["univariate_ols"] = with_(OBS, _ols(OBS_FEATURES)) + (
    f"SELECT feature, round(r2, 8) AS r2, slope, {_rank('r2')} AS rank FROM ols")
SQL["rank_vote"] = with_(OBS, _ranges(_CF), f"long AS ({_CLONG})", *_chi("long", "feature"), _ols(_CF),
                         f"a AS (SELECT feature, {_rank('chi2')} AS chi2 FROM chi)",
                         f"b AS (SELECT feature, {_rank('r2')} AS linreg FROM ols)",
                         "s AS (SELECT *, chi2 + linreg AS total FROM a JOIN b USING (feature))") + (
    f"SELECT feature, chi2, linreg, {_rank('total', False)} AS ranking FROM s")

_EVID = """SELECT var_name, category, min_value, max_value, count, round(event, 8) AS event,
 round(event / count, 8) AS event_rate, round(count - event, 8) AS nonevent,
 round((count - event) / count, 8) AS non_event_rate, round(de, 8) AS dist_event, round(dn, 8) AS dist_non_event,
 round(woe, 8) AS woe, round(sum((de - dn) * woe) OVER (PARTITION BY var_name), 8) AS iv
FROM (SELECT *, CASE WHEN de > 0 AND dn > 0 THEN ln(de / dn) ELSE 0 END AS woe FROM (SELECT *,
 event / sum(event) OVER (PARTITION BY var_name) AS de,
 (count - event) / sum(count - event) OVER (PARTITION BY var_name) AS dn FROM {src}))"""
_CAND = []
for _n in range(2, 11):
    _edges = [f"(SELECT {q('x_chars', i / _n)} FROM binary_obs)" for i in range(1, _n + 1)]
    _CAND.append(f"SELECT {_n} AS nb, {_below('x_chars', _edges)} AS bin, x_chars, y FROM binary_obs")
_MONO = ["cand AS (" + union(_CAND) + ")",
         """g AS (SELECT nb, bin, count(*) AS count, sum(y) AS event, avg(y) AS rate, min(x_chars) AS min_value,
 max(x_chars) AS max_value FROM cand GROUP BY nb, bin)""",
         "st AS (SELECT *, rate - lag(rate) OVER (PARTITION BY nb ORDER BY bin) AS step FROM g)",
         """pick AS (SELECT max(nb) AS nb FROM (SELECT nb FROM st GROUP BY nb HAVING count(*) = nb
 AND (count(*) FILTER (step > 0) = nb - 1 OR count(*) FILTER (step < 0) = nb - 1)))""",
         """num AS (SELECT 'x_chars' AS var_name, CAST(NULL AS VARCHAR) AS category, min_value, max_value, count, event
 FROM g WHERE nb = (SELECT nb FROM pick))"""]
_CHAR = """cat AS (SELECT 'x_lang' AS var_name, x_lang AS category, CAST(NULL AS DOUBLE) AS min_value,
 CAST(NULL AS DOUBLE) AS max_value, count(*) AS count, sum(y) AS event FROM binary_obs GROUP BY x_lang)"""
SQL["woe_numeric"] = with_(BIN, *_MONO) + _EVID.format(src="num")
SQL["woe_categorical"] = with_(BIN, _CHAR) + _EVID.format(src="cat")
_BOTH = with_(BIN, *_MONO, _CHAR, "allb AS (SELECT * FROM num UNION ALL SELECT * FROM cat)",
              "ev AS (" + _EVID.format(src="allb") + ")")
SQL["iv_table"] = _BOTH + "SELECT var_name, max(iv) AS iv FROM ev GROUP BY var_name"
SQL["woe_encode"] = _BOTH + """SELECT b.*, coalesce((SELECT arg_min(woe, max_value) FROM ev
 WHERE var_name = 'x_chars' AND b.x_chars <= max_value), 0) AS "WOE_x_chars",
 coalesce((SELECT max(woe) FROM ev WHERE var_name = 'x_lang' AND category = b.x_lang), 0) AS "WOE_x_lang"
FROM binary_obs b"""
SQL["gram_matrix"] = with_(OBS) + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {digits(f'covar_pop({a}, {b})')} AS cross FROM obs"
    for a in [*NUMERIC, "signal"] for b in [*NUMERIC, "signal"])
SQL["vif"] = with_(OBS, """g AS (SELECT sum(f_size * f_size) AS aa, sum(f_size2 * f_size2) AS bb,
 sum(f_retail * f_retail) AS cc, sum(f_size * f_size2) AS ab, sum(f_size * f_retail) AS ac,
 sum(f_size2 * f_retail) AS bc FROM obs)""", """d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac)
 + ac * (ab * bc - bb * ac) AS det FROM g)""") + union([
    "SELECT 'f_size' AS feature, round(aa * (bb * cc - bc * bc) / det, 6) AS vif FROM d",
    "SELECT 'f_size2', round(bb * (aa * cc - ac * ac) / det, 6) FROM d",
    "SELECT 'f_retail', round(cc * (aa * bb - ab * ab) / det, 6) FROM d"])
SQL["corr_prune"] = with_(OBS, _ols(NUMERIC), "rk AS (SELECT feature, row_number() OVER (ORDER BY r2 DESC) AS i FROM ols)",
                          "cr AS (" + union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM obs"
                                            for a in NUMERIC for b in NUMERIC if a != b) + ")",
                          """kept AS (SELECT feature, i FROM rk WHERE NOT EXISTS (SELECT 1 FROM cr JOIN rk e
 ON cr.a = e.feature WHERE cr.b = rk.feature AND e.i < rk.i AND cr.r >= 0.7))""") + (
    "SELECT feature FROM kept WHERE i < (SELECT max(i) FROM kept)")

# --- linear models

SQL["linear_coefficients"] = with_(OBS) + """SELECT round(regr_intercept(signal, f_spiky), 8) AS intercept,
 round(regr_slope(signal, f_spiky), 8) AS slope FROM obs"""
SQL["linear_cv"] = with_(OBS, f"""f AS (SELECT f_spiky AS x, signal AS y, CAST(ntile(5) OVER (ORDER BY {KEY}) - 1 AS INT)
 AS fold FROM obs)""", """c AS (SELECT b.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS xy,
 var_pop(x) * count(*) AS xx FROM f JOIN (SELECT DISTINCT fold FROM f) b ON f.fold <> b.fold GROUP BY b.fold)""",
                         """m AS (SELECT fold, 'linear' AS method, mx, my, xy / xx AS b FROM c
 UNION ALL SELECT fold, 'ridge', mx, my, xy / (xx + 1) FROM c)""",
                         "e AS (SELECT method, fold, y, y - (my + b * (x - mx)) AS e FROM f JOIN m USING (fold))") + """
SELECT method, fold, round(-avg(e * e), 6) AS neg_mse, round(1 - var_pop(e) / var_pop(y), 6) AS explained_variance,
 round(-avg(abs(e)), 6) AS neg_mae FROM e GROUP BY method, fold"""
SQL["linear_predictions"] = with_(OBS, _TRAIN, """c AS (SELECT regr_intercept(signal, f_spiky) AS a,
 regr_slope(signal, f_spiky) AS b FROM tr)""") + f"""SELECT {KEY}, round(signal, 6) AS y_real,
 round(a + b * f_spiky, 6) AS y_pred FROM obs, c WHERE {u('k', 7)} < 0.1"""
SQL["explained_variance"] = with_(OBS, """e AS (SELECT signal AS y, signal - (3 * f_spiky - 0.5 * f_size) AS e FROM obs)""") + """
SELECT round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(1 - var_pop(e) / var_pop(y), 6)
 AS explained_variance, round(avg(abs(y - (SELECT avg(y) FROM e))), 6) AS baseline_mae FROM e"""
SQL["pca_board"] = with_(OBS, """c AS (SELECT var_samp(f_size) AS a, var_samp(f_size2) AS b,
 covar_samp(f_size, f_size2) AS x FROM obs)""", """l AS (SELECT (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + x * x) AS l1,
 (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + x * x) AS l2 FROM c)""") + union([
    """SELECT 'PC1' AS component, round(l1, 6) AS variance, round(l1 / (l1 + l2), 6) AS share,
 round(l1 / (l1 + l2), 6) AS cumulative FROM l""",
    "SELECT 'PC2', round(l2, 6), round(l2 / (l1 + l2), 6), 1.0 FROM l"])

SQL["random_subset"] = with_(OBS) + (f"SELECT {KEY}, k, " + ", ".join(
    c for c in [*OBS_FEATURES] if c in _CHOSEN) + f" FROM obs WHERE {u('k', 5)} < 0.3")
# A projection matrix drawn once per seed: N(0, 1/k).
_R = np.random.default_rng(1).normal(0.0, (1.0 / 3) ** 0.5, (len(NUMERIC), 3))
SQL["random_projection"] = with_(OBS, _ranges(NUMERIC), "s AS (SELECT " + KEY + ", " + ", ".join(
    f"{mm(c)} AS {c}" for c in NUMERIC) + " FROM obs, r)") + f"SELECT {KEY}, " + ", ".join(
    "round(" + " + ".join(f"{c} * ({_R[i, j]!r})".replace("np.float64(", "(") for i, c in enumerate(NUMERIC))
    + f", 7) AS \"RP{j + 1}\"" for j in range(3)) + " FROM s"
# Scores of a centred two-column rotation: the angle follows from the 2 x 2 covariance.
SQL["pca_scores"] = with_(OBS, """c AS (SELECT avg(f_size) AS mx, avg(f_size2) AS my, var_samp(f_size) AS a,
 var_samp(f_size2) AS b, covar_samp(f_size, f_size2) AS x FROM obs)""", """w AS (SELECT mx, my,
 0.5 * atan2(2 * x, a - b) AS t FROM c)""") + f"""SELECT {KEY},
 round((f_size - mx) * cos(t) + (f_size2 - my) * sin(t), 6) AS "PC1",
 round((f_size - mx) * sin(t) - (f_size2 - my) * cos(t), 6) AS "PC2" FROM obs, w"""

# --- synthetic rows

_MODE = {c: f"""(SELECT cluster, {c} FROM (SELECT cluster, {c}, row_number() OVER (PARTITION BY cluster
 ORDER BY count(*) DESC, {c}) AS rn FROM clustered GROUP BY cluster, {c}) WHERE rn = 1)""" for c in ("gender", "year_collect")}
SQL["cluster_mode"] = with_(CLUSTERED) + (
    f"SELECT * FROM {_MODE['gender']} a JOIN {_MODE['year_collect']} b USING (cluster)")


def _lead(p):
    return f"""lead_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY o_orderkey) AS rn,
 count(*) OVER (PARTITION BY cluster) AS n FROM clustered) WHERE rn <= floor(n * {p}E0))"""


_CEN = "cen AS (SELECT cluster, avg(x) AS c FROM clustered GROUP BY cluster)"
SQL["cluster_first_rows"] = with_(CLUSTERED, _lead(0.5)) + "SELECT o_orderkey, cluster, x, year_collect, gender FROM lead_rows"
SQL["interpolate_rows"] = with_(CLUSTERED, _lead(0.8), _CEN) + f"""
SELECT cluster, o_orderkey, round(c + {u('o_orderkey', 40)} * (x - c), 6) AS x, a.gender, b.year_collect
FROM lead_rows JOIN cen USING (cluster) JOIN {_MODE['gender']} a USING (cluster)
 JOIN {_MODE['year_collect']} b USING (cluster)"""
SQL["append_synthetic"] = with_(CLUSTERED, _lead(0.5), _CEN) + f"""
SELECT cluster, synthetic, count(*) AS n, round(avg(x), 5) AS mean_x FROM (
 SELECT cluster, false AS synthetic, x FROM clustered UNION ALL
 SELECT cluster, true, c + {u('o_orderkey', 40)} * (x - c) FROM lead_rows JOIN cen USING (cluster))
GROUP BY cluster, synthetic"""

# --- expressions

A, B = "(f_size / 10.0E0)", "f_tax"
FN = {"add": f"{A} + {B}", "sub": f"{A} - {B}", "mul": f"{A} * {B}",
      "div": f"CASE WHEN abs({B}) > 0.001 THEN {A} / {B} ELSE 1 END", "sqrt": f"sqrt(abs({A}))",
      "power": f"{A} * {A}", "log": f"CASE WHEN abs({A}) > 0.001 THEN ln(abs({A})) ELSE 0 END",
      "exp": f"exp({A})", "neg": f"-{A}", "abs": f"abs({A})",
      "inv": f"CASE WHEN abs({A}) > 0.001 THEN 1 / {A} ELSE 0 END", "max": f"greatest({A}, {B})",
      "min": f"least({A}, {B})", "sin": f"sin({A})", "cos": f"cos({A})", "tan": f"tan({A})",
      "sig": f"1 / (1 + exp(-{A}))", "tanh": f"tanh({A})"}
SQL["fn_protected"] = with_(OBS) + f"SELECT {KEY}, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 7) AS fn_{n}" for n, e in FN.items()) + " FROM obs"
PROGRAM_SQL = ["f_tax + 0.5", "1.0E0", "0.0E0", "sqrt(abs(-f_retail))",
               "CASE WHEN f_order > 709.782712893384 THEN 1.0E0 ELSE exp(least(f_order, 700)) END",
               "3 * f_spiky - 0.5 * f_size",
               "greatest(least(f_tax, 0.05), CASE WHEN abs(f_tax) > 0.001 THEN 1 / f_tax ELSE 0 END)",
               "f_size", "tanh(f_tax * f_tax)", "abs(sin(f_size) + cos(f_size))"]
SQL["apply_program"] = with_(OBS) + f"SELECT {KEY}, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 7) AS p{i}" for i, e in enumerate(PROGRAM_SQL)) + " FROM obs"


def _scores(exprs, digits, where="", y="signal", name="raw_fitness"):
    return union(f"SELECT {i} AS program_id, round({e}, {digits}) AS {name} FROM obs{where}" for i, e in exprs)


def _err(i):
    return f"(signal - ({PROGRAM_SQL[i]}))"


_ALL = range(10)
SQL["score_mae"] = SQL["score_many"] = with_(OBS) + _scores([(i, f"avg(abs({_err(i)}))") for i in _ALL], 6)
SQL["score_mse"] = with_(OBS) + _scores([(i, f"avg({_err(i)} * {_err(i)})") for i in _ALL], 4)
SQL["score_rmse"] = with_(OBS) + _scores([(i, f"sqrt(avg({_err(i)} * {_err(i)}))") for i in _ALL], 6)
_FLAT = (1, 2, 4)     # constant outputs have no correlation
SQL["score_pearson"] = with_(OBS) + _scores(
    [(i, "CAST(any_value(0) AS DOUBLE)" if i in _FLAT else f"abs(corr(signal, {PROGRAM_SQL[i]}))") for i in _ALL], 7)


def _wcorr(e):
    f, w = f"({e})", "f_size"
    return (f"abs((sum({w} * signal * {f}) / sum({w}) - sum({w} * signal) / sum({w}) * (sum({w} * {f}) / sum({w})))"
            f" / sqrt((sum({w} * signal * signal) / sum({w}) - pow(sum({w} * signal) / sum({w}), 2))"
            f" * (sum({w} * {f} * {f}) / sum({w}) - pow(sum({w} * {f}) / sum({w}), 2))))")


SQL["score_pearson_weighted"] = with_(OBS) + _scores(
    [(i, "CAST(any_value(0) AS DOUBLE)" if i in _FLAT else _wcorr(PROGRAM_SQL[i])) for i in _ALL], 7)


def _spear(i):
    return f"""SELECT {i} AS program_id, round(abs(corr(ry, rf)), 8) AS raw_fitness FROM (
 SELECT rank() OVER (ORDER BY signal) + (count(*) OVER (PARTITION BY signal) - 1) / 2.0E0 AS ry,
 rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0E0 AS rf
 FROM (SELECT signal, {PROGRAM_SQL[i]} AS f FROM obs))"""


SQL["score_spearman"] = with_(OBS) + union(
    f"SELECT {i} AS program_id, 0.0E0 AS raw_fitness" if i in _FLAT else _spear(i) for i in _ALL)


def _ll(i):
    p = f"(1 / (1 + exp(-CAST({PROGRAM_SQL[i]} AS DOUBLE))))"
    return f"avg(-(gender * ln(greatest({p}, 1E-15)) + (1 - gender) * ln(greatest(1 - {p}, 1E-15))))"


SQL["score_logloss"] = with_(OBS) + _scores([(i, _ll(i)) for i in _ALL], 7)
SQL["score_val"] = with_(OBS) + union(
    f"""SELECT {i} AS program_id, round(avg(abs({_err(i)})) FILTER (NOT {u('k', 3)} < 0.2), 6) AS raw_fitness,
 round(avg(abs({_err(i)})) FILTER ({u('k', 3)} < 0.2), 6) AS val_fitness FROM obs""" for i in _ALL)
def _bag(i):
    """Share of the bag draw: a cubic in the key modulo 2^31 - 1, coefficients from sha256('program:seed')."""
    c = [f"(CAST('0x' || substr(sha256('{i}:0'), {8 * j + 1}, 8) AS BIGINT) % 2147483647)" for j in range(4)]
    return f"((((((k * {c[3]} + {c[2]}) % 2147483647) * k + {c[1]}) % 2147483647) * k + {c[0]}) % 2147483647 / 2147483647.0E0)"


SQL["score_oob"] = with_(OBS) + union(
    f"""SELECT {i} AS program_id, round(avg(abs({_err(i)})) FILTER ({_bag(i)} < 0.7), 6) AS raw_fitness,
 round(avg(abs({_err(i)})) FILTER (NOT {_bag(i)} < 0.7), 6) AS oob_fitness FROM obs""" for i in _ALL)
SQL["output_transformer"] = with_(OBS) + f"SELECT {KEY}, round(1 / (1 + exp(-signal / 100.0E0)), 8) AS probability FROM obs"
SQL["program_shape"] = """
SELECT CAST(c_custkey AS INT) AS program_id, true AS valid, CASE s WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 6 END AS length,
 CASE s WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS depth,
 CASE s WHEN 0 THEN 'X' || i WHEN 1 THEN 'sqrt(X' || i || ')' WHEN 2 THEN 'add(X' || i || ', ' || c || ')'
  ELSE 'div(mul(X' || i || ', ' || c || '), log(X' || j || '))' END AS text
FROM (SELECT c_custkey, c_custkey % 4 AS s, c_nationkey % 8 AS i, c_custkey % 8 AS j,
 printf('%.3f', floor(c_acctbal) / 1000.0E0) AS c FROM customer)"""
_SIG = "1 / (1 + exp(-({})))"
SQL["gs_crossover"] = with_(OBS) + f"""SELECT {KEY}, round({_SIG.format('f_tax')} * f_spiky
 + (1 - {_SIG.format('f_tax')}) * f_size, 7) AS child FROM obs"""
SQL["gs_mutation"] = with_(OBS) + f"""SELECT {KEY}, round(f_spiky + 0.1 * tanh(f_tax * 10), 7) AS tanh_child,
 round(f_spiky + 0.25 * tanh(f_tax * 10), 7) AS drawn_child,
 round(f_spiky + 0.5 * ({_SIG.format('f_tax * 10')} - {_SIG.format('f_size / 25.0E0')}), 7) AS sigmoid_child FROM obs"""
_NB = [(0, 0.5), (6, 0.25), (7, 1.0), (8, 0.75)]
SQL["semantic_neighbours"] = with_(OBS, f"""el AS (SELECT avg(abs({_err(5)})) AS f, stddev_samp(abs({_err(5)})) AS s FROM obs)""",
                                   "nb AS (" + union(
    f"""SELECT avg(abs(signal - ({PROGRAM_SQL[5]} + {s} * tanh({PROGRAM_SQL[i]})))) AS f,
 stddev_samp(abs(signal - ({PROGRAM_SQL[5]} + {s} * tanh({PROGRAM_SQL[i]})))) AS s FROM obs""" for i, s in _NB) + ")") + """
SELECT count(*) AS n, count(*) FILTER (nb.f < el.f) AS n_better, count(*) FILTER (nb.f < el.f AND nb.s < el.s) AS n_steadier,
 round(count(*) FILTER (nb.f < el.f) / count(*)::DOUBLE, 8) AS tie,
 round(count(*) FILTER (nb.f < el.f AND nb.s < el.s) / nullif(count(*) FILTER (nb.f < el.f), 0)::DOUBLE, 8) AS edv FROM nb, el"""

# --- populations

SQL["parsimony"] = with_(POP) + "SELECT program_id, round(raw_fitness + 0.01 * length, 8) AS fitness FROM pop"
SQL["auto_parsimony"] = with_(POP) + """SELECT program_id, round(raw_fitness + length *
 (SELECT covar_samp(length, raw_fitness) / var_pop(length) FROM pop), 8) AS fitness FROM pop"""
SQL["generation_summary"] = with_(POP) + """SELECT depth, count(*) AS n_programs, round(avg(length), 8) AS average_length,
 round(avg(raw_fitness), 8) AS average_fitness, arg_min(program_id, (raw_fitness, program_id)) AS best_id,
 arg_min(length, (raw_fitness, program_id)) AS best_length, round(min(raw_fitness), 8) AS best_fitness FROM pop GROUP BY depth"""
SQL["best_program"] = with_(POP) + """SELECT program_id, raw_fitness, length, depth FROM pop
 ORDER BY raw_fitness, program_id LIMIT 1"""
SQL["hall_of_fame"] = with_(POP) + "SELECT program_id, fitness FROM pop ORDER BY fitness, program_id LIMIT 20"
_WHEEL = """wh AS (SELECT program_id, (up - s) / total AS lo, up / total AS hi FROM (SELECT program_id, s,
 sum(s) OVER (ORDER BY program_id ROWS UNBOUNDED PRECEDING) AS up, sum(s) OVER () AS total FROM sh))"""
_SHARE = "sh AS (SELECT program_id, 1 / fitness AS s FROM pop)"
_RANKS = "sh AS (SELECT program_id, CAST(row_number() OVER (ORDER BY fitness DESC, program_id) AS DOUBLE) AS s FROM pop)"
SQL["cumulative_share"] = with_(POP, _SHARE, _WHEEL) + (
    "SELECT program_id, round(lo, 10) AS lo, round(hi, 10) AS hi FROM wh")
SQL["ordinal_rank"] = with_(POP, _RANKS) + "SELECT program_id, CAST(s AS BIGINT) AS rank FROM sh"
SQL["fractional_rank"] = """SELECT l_quantity, n, sum(n) OVER (ORDER BY l_quantity) - (n - 1) / 2.0E0 AS rank
 FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity)"""


def _spin(share, salt, scale=""):
    return with_(POP, share, _WHEEL, f"dr AS (SELECT program_id AS slot, {u('program_id', salt)}{scale} AS u FROM pop)") + (
        "SELECT slot, wh.program_id FROM dr JOIN wh ON dr.u > wh.lo AND dr.u <= wh.hi")


SQL["rank_selection"] = _spin(_RANKS, 21)
SQL["roulette_selection"] = _spin(_SHARE, 22)
SQL["sus_selection"] = _spin(_SHARE, 23, " / 5")
_PLACE = """pl AS (SELECT program_id, fitness, length, depth, row_number() OVER (ORDER BY program_id) - 1 AS place,
 count(*) OVER () AS n FROM pop)"""
SQL["random_selection"] = with_(POP, _PLACE) + f"""SELECT a.program_id AS slot, b.program_id FROM pl a
 JOIN pl b ON b.place = least(floor({u('a.program_id', 24)} * a.n), a.n - 1)"""


def _tour(by):
    return with_(POP, _PLACE, "ct AS (" + union(
        f"SELECT program_id AS slot, least(floor({u('program_id', 30 + i)} * n), n - 1) AS place FROM pl"
        for i in range(3)) + ")") + f"""SELECT slot, arg_min(program_id, ({by}, program_id)) AS program_id
 FROM ct JOIN pl USING (place) GROUP BY slot"""


SQL["tournament"] = _tour("fitness")
SQL["tournament_length"] = _tour("length")
SQL["tournament_depth"] = _tour("depth")
SQL["bloat_control"] = with_(POP) + """SELECT program_id, length, fitness FROM (SELECT * FROM pop ORDER BY length, program_id
 LIMIT 50) ORDER BY fitness, program_id LIMIT 1"""
SQL["prune_ancestors"] = with_(POP, """h AS (SELECT *, program_id % 2 AS generation, (program_id // 4) * 2 AS parent_id,
 CASE WHEN depth > 3 THEN (program_id // 6) * 2 END AS donor_id FROM pop)""") + """SELECT program_id, fitness FROM h
 WHERE generation = 0 AND (program_id IN (SELECT parent_id FROM h WHERE generation = 1 AND parent_id IS NOT NULL)
 OR program_id IN (SELECT donor_id FROM h WHERE generation = 1 AND donor_id IS NOT NULL))"""

# --- significance

SQL["ttest_ind"] = with_(SCORES, """s AS (SELECT avg(error) FILTER (method = 'click') AS ma, avg(error) FILTER (method = 'view') AS mb,
 var_samp(error) FILTER (method = 'click') AS va, var_samp(error) FILTER (method = 'view') AS vb,
 count(*) FILTER (method = 'click') AS na, count(*) FILTER (method = 'view') AS nb FROM scores)""") + """
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 8) AS t,
 CAST(na + nb - 2 AS DOUBLE) AS dof FROM s"""
_DIFF = """df AS (SELECT a.fold, a.error - b.error AS d FROM scores a JOIN scores b ON a.fold = b.fold
 WHERE a.method = 'click' AND b.method = 'view')"""
SQL["ttest_rel"] = SQL["ttest_1samp"] = with_(SCORES, _DIFF) + """
SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 8) AS t, CAST(count(*) - 1 AS DOUBLE) AS dof FROM df"""
# Student's t at 9 degrees of freedom: |t| > 1.833113 is p/2 < 0.05 (ten matched folds).
SQL["one_tailed"] = with_(SCORES, _DIFF) + """
SELECT t > 1.8331129326536335 AS greater, t < -1.8331129326536335 AS less
FROM (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM df)"""
SQL["wilcoxon"] = with_(SCORES, _DIFF, """rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1)
 / 2.0E0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM df WHERE d <> 0)""", """s AS (SELECT
 least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) AS n,
 sum(t * t - 1) AS ties FROM rk)""") + """
SELECT round(w, 8) AS w, n, round((w - n * (n + 1) / 4.0E0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0E0) / 24), 8) AS z FROM s"""

# --- the standard preparation, end to end

_LAB = f"tr AS (SELECT * FROM obs WHERE target IS NOT NULL AND NOT {u('k', 7)} < 0.1)"
_F = [f"fl_{c} AS (SELECT CASE WHEN exp(-jb / 2) > 0.05 THEN mid ELSE mean END AS v_{c} FROM {jb(c, 'tr')})" for c in OBS_FEATURES]
_FL = "fi AS (SELECT signal, " + ", ".join(f"coalesce({c}, v_{c}) AS {c}" for c in OBS_FEATURES) + " FROM tr, " + ", ".join(
    f"fl_{c}" for c in OBS_FEATURES) + ")"
_WB = "wb AS (SELECT " + ", ".join(f"{q(c, .05)} AS wl_{c}, {q(c, .95)} AS wh_{c}" for c in OBS_FEATURES) + " FROM fi)"
_WI = "wi AS (SELECT signal, " + ", ".join(
    f"CASE WHEN {c} > wh_{c} THEN wh_{c} WHEN {c} < wl_{c} THEN wl_{c} ELSE {c} END AS {c}" for c in OBS_FEATURES) + " FROM fi, wb)"
_SC = "sc AS (SELECT signal, " + ", ".join(f"{mm(c)} AS {c}" for c in OBS_FEATURES) + " FROM wi, r)"
SQL["study_slice"] = with_(OBS, _LAB, *_F, _FL, _WB, _WI, _ranges(OBS_FEATURES, "wi"), _SC,
                           _ols(OBS_FEATURES).replace("FROM obs", "FROM sc")) + (
    f"SELECT feature, round(r2, 8) AS r2, round(slope, 2) AS slope, {_rank('r2')} AS rank FROM ols")

# --- reads, exports, user functions and metrics ------------------------------------------------------------------
SQL["table_read"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_quantity FROM lineitem WHERE l_quantity > 25"""
SQL["export_roundtrip"] = with_(OBS) + f"SELECT {KEY}, f_qty, gender FROM obs WHERE target IS NOT NULL"
SQL["score_wide"] = with_(SCORES) + """SELECT 'TTFF' AS combination, fold AS seed,
 round(max(error) FILTER (method = 'click'), 8) AS click, round(max(error) FILTER (method = 'view'), 8) AS view
 FROM scores GROUP BY fold"""
SQL["user_function"] = with_(OBS) + f"SELECT {KEY}, round(1 / (1 + abs(f_size - f_size2)) + f_tax * 2, 8) AS p FROM obs"
SQL["user_metric"] = with_(OBS) + _scores([(i, f"max(abs({_err(i)}))") for i in _ALL], 6)
