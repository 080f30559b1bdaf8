"""The same queries in SQL: ``name -> statement`` for a plain SQL engine on the same tables.

Written from the definitions, not from the plans: gap filling by a span table and a join,
folds by range joins, quantiles by the engine's own aggregates.
"""

from __future__ import annotations

from panelcast.catalog.queries import (
    CONTEXT_GRID,
    CORRELATED,
    HORIZON,
    IMPORTANCE_FEATURES,
    SETTINGS,
    SUBSET,
)
from panelcast.schema import LAGS, ROLL_WINDOWS

UNDER, OVER = SETTINGS.under_weight, SETTINGS.over_weight
N_FOLDS, STRIDE = SETTINGS.n_folds, SETTINGS.cv_stride_days
HOLDOUT, CONTEXT, ORIGINS = (
    SETTINGS.final_horizon_days,
    SETTINGS.max_context,
    SETTINGS.train_origins,
)

# Named building blocks; each may use the ones listed before it.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """The statement with every block it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body
    blocks = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {blocks}\n{body}"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


cte(
    "visits",
    "SELECT l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS date, "
    "CAST(sum(l_quantity) AS DOUBLE) AS visitors FROM lineitem GROUP BY 1, 2",
)
cte(
    "nation_orders",
    "SELECT c_nationkey AS store_id, CAST(o_orderdate AS DATE) AS date, "
    "CAST(count(*) AS DOUBLE) AS visitors FROM orders JOIN customer ON o_custkey = c_custkey "
    "GROUP BY 1, 2",
)
cte(
    "relation",
    "SELECT p_partkey % (SELECT count(*) FROM supplier) AS store_id, p_partkey AS hpg_store_id "
    "FROM part WHERE p_size <= 25",
)
cte(
    "lines",
    "SELECT l_suppkey, l_partkey, l_linenumber, l_shipdate AS v, o_orderdate AS r, "
    "CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
cte(
    "bookings",
    "SELECT store_id, CAST(v AS DATE) AS visit_date, q AS reserve_visitors, "
    "(epoch_us(v) - epoch_us(r)) / 86400000000.0 AS lead_time_days, r AS reserve_ts FROM ("
    "SELECT l_suppkey AS store_id, v, r, q FROM lines WHERE l_linenumber % 2 = 1 UNION ALL "
    "SELECT store_id, v, r, q FROM lines JOIN relation ON l_partkey = hpg_store_id "
    "WHERE l_linenumber % 2 = 0)",
    "relation",
    "lines",
)
cte(
    "stores",
    "SELECT s_suppkey AS store_id, n_name AS genre, "
    "concat(replace(r_name, ' ', '-'), ' ', n_name, ' ', s_name) AS area FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
cte(
    "holidays",
    "SELECT date, CAST(CASE WHEN day(date) = 1 OR (month(date) = 12 AND day(date) >= 29) "
    "OR (month(date) = 5 AND day(date) BETWEEN 3 AND 5) THEN 1 ELSE 0 END AS INTEGER) "
    "AS is_holiday FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM visits), "
    "(SELECT max(date) + 60 FROM visits), INTERVAL 1 DAY)) AS DATE) AS date)",
    "visits",
)


def dense_body(source: str, until: str) -> str:
    return (
        f"SELECT g.store_id, g.date, coalesce(v.visitors, 0.0) AS visitors, "
        f"CAST(v.visitors IS NULL AS INTEGER) AS is_closed FROM ("
        f"SELECT store_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date "
        f"FROM (SELECT store_id, min(date) AS lo, {until} AS hi FROM {source} GROUP BY 1)) g "
        f"LEFT JOIN {source} v ON v.store_id = g.store_id AND v.date = g.date"
    )


cte("dense", dense_body("visits", "max(date)"), "visits")
cte("dense_to", dense_body("visits", "(SELECT max(date) FROM visits)"), "visits")
cte("nation_dense", dense_body("nation_orders", "max(date)"), "nation_orders")

_lags = ", ".join(f"lag(visitors, {k}) OVER w AS lag_{k}" for k in LAGS)
_rolls = ", ".join(
    f"CASE WHEN count(*) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} THEN "
    f"{fn}(visitors) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END AS roll_{label}_{w}"
    for w in ROLL_WINDOWS
    for label, fn in (("mean", "avg"), ("median", "median"))
)


def history_body(source: str) -> str:
    return (
        f"SELECT *, {_lags}, {_rolls} FROM {source} "
        "WINDOW w AS (PARTITION BY store_id ORDER BY date)"
    )


cte("history", history_body("dense"), "dense")
cte(
    "res_daily",
    "SELECT store_id, visit_date AS date, CAST(sum(reserve_visitors) AS DOUBLE) AS reserve_visitors, "
    "count(*) AS reserve_count, avg(lead_time_days) AS reserve_lead_time_mean FROM bookings "
    "GROUP BY 1, 2",
    "bookings",
)
cte(
    "hol_flags",
    "SELECT date, is_holiday, lead(is_holiday, 1, 0) OVER (ORDER BY date) AS day_before_holiday, "
    "lag(is_holiday, 1, 0) OVER (ORDER BY date) AS day_after_holiday FROM holidays",
    "holidays",
)
DOW = "CAST(isodow(date) - 1 AS INTEGER)"
CAL = (
    f"{DOW} AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, "
    "CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_of_month, "
    "round(sin(2.0 * pi() * dayofyear(date) / 365.25), 9) AS doy_sin, "
    "round(cos(2.0 * pi() * dayofyear(date) / 365.25), 9) AS doy_cos"
)
GOLDEN = (
    "CAST((month(date) = 4 AND day(date) >= 29) OR (month(date) = 5 AND day(date) <= 5) "
    "AS INTEGER)"
)
cte("store_stats", "SELECT store_id, avg(visitors) AS store_mean, median(visitors) AS store_median "
    "FROM visits GROUP BY 1", "visits")  # fmt: skip
cte("dow_stats", f"SELECT store_id, {DOW} AS dow, avg(visitors) AS store_dow_mean, "
    "median(visitors) AS store_dow_median FROM visits GROUP BY 1, 2", "visits")  # fmt: skip
cte(
    "metadata",
    "SELECT store_id, genre, string_split(area, ' ')[1] AS area_prefecture, "
    "string_split(area, ' ')[2] AS area_ward FROM (SELECT *, row_number() OVER "
    "(PARTITION BY store_id ORDER BY genre NULLS FIRST, area NULLS FIRST) AS rn FROM stores) "
    "WHERE rn = 1",
    "stores",
)
_roll_out = ", ".join(
    r6(f"roll_{s}_{w}", f"roll_{s}_{w}") for w in ROLL_WINDOWS for s in ("mean", "median")
)
_lag_out = ", ".join(f"lag_{k}" for k in LAGS)
_levels_out = ", ".join(
    r6(c, c) for c in ("store_mean", "store_median", "store_dow_mean", "store_dow_median")
)
cte(
    "features",
    f"SELECT h.store_id, h.date, visitors, is_closed, {CAL.replace('(date)', '(h.date)')}, "
    "coalesce(is_holiday, 0) AS is_holiday, coalesce(day_before_holiday, 0) AS day_before_holiday, "
    "coalesce(day_after_holiday, 0) AS day_after_holiday, "
    f"{GOLDEN.replace('(date)', '(h.date)')} AS golden_week, {_lag_out}, "
    + ", ".join(f"roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("mean", "median"))
    + ", coalesce(reserve_visitors, 0.0) AS reserve_visitors, "
    "coalesce(reserve_count, 0) AS reserve_count, "
    "coalesce(reserve_lead_time_mean, 0.0) AS reserve_lead_time_mean "
    "FROM history h LEFT JOIN hol_flags f ON f.date = h.date "
    "LEFT JOIN res_daily r ON r.store_id = h.store_id AND r.date = h.date",
    "history",
    "hol_flags",
    "res_daily",
)

# Temporal validation.
cte("last_day", "SELECT max(date) AS d FROM visits", "visits")
cte(
    "holdout",
    f"SELECT CAST(0 AS INTEGER) AS fold, d - {HOLDOUT} AS train_end, d - {HOLDOUT - 1} AS "
    "valid_start, d AS valid_end FROM last_day",
    "last_day",
)
cte("cv", "SELECT v.* FROM visits v JOIN holdout ON v.date <= train_end", "visits", "holdout")
cte("cv_last", "SELECT max(date) AS d FROM cv", "cv")


def splits_body(n: int) -> str:
    end = f"d - CAST(i * {STRIDE} AS INTEGER)"
    return (
        f"SELECT CAST({n - 1} - i AS INTEGER) AS fold, {end} - {HORIZON} AS train_end, "
        f"{end} - {HORIZON - 1} AS valid_start, {end} AS valid_end FROM cv_last, range({n}) t(i)"
    )


cte("splits", splits_body(N_FOLDS), "cv_last")
cte("splits3", splits_body(3), "cv_last")
cte(
    "cv_train",
    "SELECT s.fold, s.train_end, v.* FROM cv v JOIN splits s ON v.date <= s.train_end",
    "cv",
    "splits",
)
cte(
    "cv_valid",
    "SELECT s.fold, v.store_id, v.date, v.visitors AS y_true, "
    "CAST(v.date - s.train_end AS INTEGER) AS horizon_offset FROM cv v "
    "JOIN splits s ON v.date BETWEEN s.valid_start AND s.valid_end",
    "cv",
    "splits",
)


def naive_body(train: str, horizon: int) -> str:
    """Day +k repeats the trailing zero-filled week; unknown days fall back."""
    return (
        f"SELECT p.fold, p.store_id, p.train_end + p.k AS date, p.k AS horizon_offset, "
        "greatest(coalesce(r.visitors, CASE WHEN p.src >= f.lo THEN 0.0 END, w.m, g.m), 0.0) "
        "AS y_pred FROM ("
        "SELECT fold, store_id, train_end, k, train_end - 7 + ((k - 1) % 7) + 1 AS src FROM "
        f"(SELECT DISTINCT fold, store_id, train_end FROM {train}), "
        f"(SELECT CAST(i AS INTEGER) AS k FROM range(1, {horizon + 1}) t(i))) p "
        f"LEFT JOIN (SELECT fold, store_id, min(date) AS lo FROM {train} "
        "WHERE date >= train_end - 80 GROUP BY 1, 2) f "
        "ON f.fold = p.fold AND f.store_id = p.store_id "
        f"LEFT JOIN {train} r ON r.fold = p.fold AND r.store_id = p.store_id AND r.date = p.src "
        f"LEFT JOIN (SELECT fold, store_id, isodow(date) AS wd, avg(visitors) AS m FROM {train} "
        "GROUP BY 1, 2, 3) w ON w.fold = p.fold AND w.store_id = p.store_id "
        "AND w.wd = isodow(p.train_end + p.k) "
        "JOIN (SELECT fold, sum(s) / sum(n) AS m FROM (SELECT fold, sum(visitors) AS s, "
        f"max(date) - min(date) + 1 AS n FROM {train} GROUP BY fold, store_id) GROUP BY 1) g "
        "ON g.fold = p.fold"
    )


def window_body(train: str, horizon: int, context: int) -> str:
    """Weekday mean and deciles of the trailing zero-filled days of each (fold, store)."""
    return (
        "SELECT p.fold, p.store_id, p.train_end, p.k, coalesce(w.m, a.m) AS point, "
        "coalesce(w.q, a.q) AS q FROM ("
        "SELECT fold, store_id, train_end, k FROM (SELECT DISTINCT fold, store_id, train_end FROM "
        f"{train}), (SELECT CAST(i AS INTEGER) AS k FROM range(1, {horizon + 1}) t(i))) p "
        f"LEFT JOIN (SELECT fold, store_id, isodow(date) AS wd, avg(y) AS m, {DECILES} AS q FROM "
        f"({_grid(train, context)}) GROUP BY 1, 2, 3) w ON w.fold = p.fold "
        "AND w.store_id = p.store_id AND w.wd = isodow(p.train_end + p.k) "
        f"LEFT JOIN (SELECT fold, store_id, avg(y) AS m, {DECILES} AS q FROM "
        f"({_grid(train, context)}) GROUP BY 1, 2) a ON a.fold = p.fold "
        "AND a.store_id = p.store_id"
    )


DECILES = "quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])"


def _grid(train: str, context: int) -> str:
    """The trailing ``context`` days of each (fold, store), from its first day on."""
    return (
        "SELECT g.fold, g.store_id, g.date, coalesce(v.visitors, 0.0) AS y FROM ("
        "SELECT fold, store_id, CAST(unnest(generate_series(lo, train_end, INTERVAL 1 DAY)) "
        "AS DATE) AS date FROM (SELECT fold, store_id, train_end, greatest(min(date), "
        f"train_end - {context - 1}) AS lo FROM {train} GROUP BY 1, 2, 3)) g "
        f"LEFT JOIN {train} v ON v.fold = g.fold AND v.store_id = g.store_id AND v.date = g.date"
    )


def scored_body(preds: str, valid: str, value: str = "y_pred") -> str:
    return (
        f"SELECT v.fold, v.store_id, v.date, p.{value} AS y_pred, v.y_true, v.horizon_offset "
        f"FROM {valid} v JOIN {preds} p ON p.fold = v.fold AND p.store_id = v.store_id "
        "AND p.horizon_offset = v.horizon_offset"
    )


cte("naive_cv", naive_body("cv_train", HORIZON), "cv_train")
for _c in CONTEXT_GRID:
    cte(f"window_cv{_c}", window_body("cv_train", HORIZON, _c), "cv_train")
    cte(
        f"window_preds{_c}",
        "SELECT fold, store_id, train_end + k AS date, k AS horizon_offset, "
        f"greatest(point, 0.0) AS y_pred FROM window_cv{_c}",
        f"window_cv{_c}",
    )
cte(
    "cv_preds",
    f"SELECT 'seasonal_naive' AS model, * FROM ({scored_body('naive_cv', 'cv_valid')}) UNION ALL "
    f"SELECT 'window_profile' AS model, * FROM ({scored_body(f'window_preds{CONTEXT}', 'cv_valid')})",
    "naive_cv",
    f"window_preds{CONTEXT}",
    "cv_valid",
)
cte("ho_train", "SELECT h.fold, h.train_end, v.* FROM visits v JOIN holdout h "
    "ON v.date <= h.train_end", "visits", "holdout")  # fmt: skip
cte(
    "ho_valid",
    "SELECT h.fold, v.store_id, v.date, v.visitors AS y_true, CAST(v.date - h.train_end AS INTEGER) "
    "AS horizon_offset FROM visits v JOIN holdout h ON v.date BETWEEN h.valid_start AND h.valid_end",
    "visits",
    "holdout",
)
cte("ho_naive", naive_body("ho_train", HOLDOUT), "ho_train")
cte("ho_window", window_body("ho_train", HOLDOUT, CONTEXT), "ho_train")
cte("ho_window_preds", "SELECT fold, store_id, k AS horizon_offset, greatest(point, 0.0) AS y_pred "
    "FROM ho_window", "ho_window")  # fmt: skip
cte(
    "ho_preds",
    f"SELECT 'seasonal_naive' AS model, * FROM ({scored_body('ho_naive', 'ho_valid')}) UNION ALL "
    f"SELECT 'window_profile' AS model, * FROM ({scored_body('ho_window_preds', 'ho_valid')})",
    "ho_naive",
    "ho_window_preds",
    "ho_valid",
)

T, P = "greatest(y_true, 0.0)", "greatest(y_pred, 0.0)"
RAW_SUITE = (
    f"sqrt(avg(pow(ln(1 + {T}) - ln(1 + {P}), 2))) AS rmsle, avg(abs(y_true - {P})) AS mae, "
    f"avg(CASE WHEN {P} < {T} THEN {UNDER} ELSE {OVER} END * abs({T} - {P})) AS weighted_mae"
)
SUITE_OUT = ", ".join(r6(m, m) for m in ("rmsle", "mae", "weighted_mae"))
SEASON = (
    "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' "
    "WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
)
cte(
    "segmented",
    f"SELECT p.*, {SEASON.replace('(date)', '(p.date)')} AS season, "
    "coalesce(string_split(s.area, ' ')[1], 'unknown') AS region FROM cv_preds p "
    "LEFT JOIN stores s ON s.store_id = p.store_id",
    "cv_preds",
    "stores",
)


def _scope(name: str, key: str) -> str:
    by = "model" if name == "overall" else f"model, {key}"
    shown = "'all'" if name == "overall" else f"CAST({key} AS VARCHAR)"
    return (
        f"SELECT model, '{name}' AS scope, {shown} AS key, {RAW_SUITE}, count(*) AS n "
        f"FROM segmented GROUP BY {by}"
    )


cte(
    "cube",
    " UNION ALL ".join(
        _scope(n, k)
        for n, k in (
            ("overall", ""),
            ("season", "season"),
            ("region", "region"),
            ("horizon", "horizon_offset"),
        )
    ),
    "segmented",
)
cte(
    "config_preds",
    " UNION ALL ".join(
        [f"SELECT 'seasonal_naive' AS model, 0 AS ordinal, * FROM "
         f"({scored_body('naive_cv', 'cv_valid')})"]
        + [
            f"SELECT 'window_profile' AS model, {i} AS ordinal, * FROM "
            f"({scored_body(f'window_preds{c}', 'cv_valid')})"
            for i, c in enumerate(CONTEXT_GRID, 1)
        ]
    ),
    "naive_cv",
    "cv_valid",
    *[f"window_preds{c}" for c in CONTEXT_GRID],
)

# Signals.
cte("train_dense", dense_body("cv", "max(date)"), "cv")
cte("origins", f"SELECT DISTINCT date FROM train_dense ORDER BY date DESC LIMIT {ORIGINS}",
    "train_dense")
cte("origin_train", "SELECT o.date AS fold, o.date AS train_end, v.* FROM cv v "
    "JOIN origins o ON v.date <= o.date", "cv", "origins")  # fmt: skip
cte("origin_window", window_body("origin_train", HORIZON, CONTEXT), "origin_train")
cte("full_train", "SELECT 0 AS fold, l.d AS train_end, v.* FROM visits v, last_day l",
    "visits", "last_day")
cte("full_window", window_body("full_train", HORIZON, CONTEXT), "full_train")
cte("full_naive", naive_body("full_train", HORIZON), "full_train")
_sig_out = ", ".join(
    [r6("point", "sig_point"), r6("point", "sig_q0")] + [r6(f"q[{i}]", f"sig_q{i}") for i in range(1, 10)]
)
cte(
    "series_asked",
    "SELECT fold, store_id, string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY date) "
    f"AS ys FROM ({_grid('cv_train', CONTEXT)}) GROUP BY 1, 2",
    "cv_train",
)

# Importances and correlations.
cte(
    "leveled",
    "SELECT f.*, store_mean, store_median, store_dow_mean, store_dow_median FROM features f "
    "LEFT JOIN store_stats s ON s.store_id = f.store_id "
    "LEFT JOIN dow_stats d ON d.store_id = f.store_id AND d.dow = f.dow",
    "features",
    "store_stats",
    "dow_stats",
)
cte(
    "importances",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(coalesce(abs(corr({c}, visitors)), 0.0), 6) AS value "
        "FROM leveled"
        for c in IMPORTANCE_FEATURES
    ),
    "leveled",
)
cte(
    "observed",
    "SELECT *, lag(visitors, 1) OVER w AS lag_1, lag(visitors, 7) OVER w AS lag_7, "
    "CASE WHEN count(*) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN "
    "avg(visitors) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS roll_7_mean, "
    "avg(visitors) OVER (PARTITION BY store_id) AS store_mean FROM visits "
    "WINDOW w AS (PARTITION BY store_id ORDER BY date)",
    "visits",
)
cte(
    "observed_panel",
    "SELECT o.*, coalesce(h.is_holiday, 0) AS is_holiday, isodow(o.date) - 1 AS dow, "
    "day(o.date) AS day_of_month, month(o.date) AS month, "
    "coalesce(r.reserve_visitors, 0.0) AS reserve_visitors FROM observed o "
    "LEFT JOIN holidays h ON h.date = o.date "
    "LEFT JOIN res_daily r ON r.store_id = o.store_id AND r.date = o.date",
    "observed",
    "holidays",
    "res_daily",
)

# Columns of the profiled tables.
COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
    "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
}


def _null_rows(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n_rows, "
        f'count(*) - count("{column}") AS n_null FROM {table}'
    )


def _counts(name: str, source: str, expr: str) -> str:
    return (
        f"SELECT '{name}' AS variable, CAST({expr} AS VARCHAR) AS value, count(*) AS n, "
        f"round(count(*) / (SELECT count(*) FROM {source}), 6) AS share FROM {source} GROUP BY {expr}"
    )


def _hist(source: str, value: str, bins: int, extra: str = "", keys: str = "") -> str:
    """Equal-width counts between the minimum and maximum of ``value``."""
    width = f"((hi - lo) / {bins}.0)"
    return (
        f"SELECT {keys}{extra}bin, round(lo + bin * {width}, 6) AS left_edge, n FROM ("
        f"SELECT {keys}lo, hi, CAST(least(floor((x - lo) / {width}), {bins - 1}) AS INTEGER) AS bin, "
        f"count(*) AS n FROM (SELECT {keys}{value} AS x FROM {source}), "
        f"(SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) GROUP BY ALL)"
    )


def _pairs() -> str:
    names = ["visitors", *CORRELATED]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr "
        "FROM observed_panel"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )


COVERAGE = (
    "SELECT store_id, count(*) AS present_days, CAST(max(date) - min(date) + 1 AS BIGINT) AS "
    "span_days, CAST(max(date) - min(date) + 1 - count(*) AS BIGINT) AS missing_days, "
    "count(*) / (max(date) - min(date) + 1) AS coverage FROM visits GROUP BY 1"
)
cte("cov", COVERAGE, "visits")
cte("visit_days", "SELECT date, dayname(date) AS day_name FROM visits", "visits")
cte("visit_holidays", "SELECT is_holiday FROM visits JOIN holidays USING (date)", "visits", "holidays")

cte("fold0", "SELECT v.* FROM cv v JOIN splits3 s ON s.fold = 0 AND v.date <= s.train_end",
    "cv", "splits3")
cte("fold0_dense", dense_body("fold0", "max(date)"), "fold0")
cte("fold0_history", history_body("fold0_dense"), "fold0_dense")

ORACLES: dict[str, str] = {
    "visits_scan": sql("SELECT * FROM visits", "visits"),
    "reservations_union": sql(
        f"SELECT store_id, visit_date, reserve_visitors, {r6('lead_time_days', 'lead_time_days')} "
        "FROM bookings",
        "bookings",
    ),
    "stores_scan": sql("SELECT * FROM stores", "stores"),
    "holidays_scan": sql("SELECT * FROM holidays", "holidays"),
    "densify": sql("SELECT * FROM dense", "dense"),
    "densify_to_cutoff": sql("SELECT * FROM dense_to", "dense_to"),
    "series_arrays": sql(
        "SELECT store_id, min(date) AS first_day, CAST(count(*) AS INTEGER) AS n_days, "
        "string_agg(CAST(CAST(visitors AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS ys "
        "FROM dense GROUP BY 1",
        "dense",
    ),
    "future_scaffold": sql(
        "SELECT store_id, CAST(unnest(generate_series(d + 1, "
        f"d + {HORIZON}, INTERVAL 1 DAY)) AS DATE) AS date, CAST(0.0 AS DOUBLE) AS visitors "
        "FROM (SELECT DISTINCT store_id FROM visits), last_day",
        "visits",
        "last_day",
    ),
    "demand_matrix": sql(
        "SELECT g.date, "
        + ", ".join(f"max(CASE WHEN store_id = {i} THEN visitors END) AS s{i}" for i in range(25))
        + " FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date "
        "FROM nation_dense) g LEFT JOIN nation_dense n ON n.date = g.date GROUP BY 1",
        "nation_dense",
    ),
    "coverage": sql(
        f"SELECT store_id, present_days, span_days, missing_days, {r6('coverage', 'coverage')} "
        "FROM cov",
        "cov",
    ),
    "coverage_histogram": sql(_hist("cov", "coverage", 40), "cov"),
    "calendar_features": sql(f"SELECT store_id, date, {CAL} FROM visits", "visits"),
    "holiday_features": sql(
        "SELECT v.store_id, v.date, coalesce(is_holiday, 0) AS is_holiday, "
        "coalesce(day_before_holiday, 0) AS day_before_holiday, "
        "coalesce(day_after_holiday, 0) AS day_after_holiday, "
        f"{GOLDEN.replace('(date)', '(v.date)')} AS golden_week "
        "FROM visits v LEFT JOIN hol_flags f ON f.date = v.date",
        "visits",
        "hol_flags",
    ),
    "lag_features": sql(f"SELECT store_id, date, {_lag_out} FROM history", "history"),
    "rolling_features": sql(f"SELECT store_id, date, {_roll_out} FROM history", "history"),
    "lag_observed": sql(
        "SELECT store_id, date, visitors, lag_1, lag_7, "
        f"{r6('roll_7_mean', 'roll_7_mean')}, {r6('store_mean', 'store_mean')} FROM observed",
        "observed",
    ),
    "reservations_daily": sql(
        "SELECT store_id, date, reserve_visitors, reserve_count, "
        f"{r6('reserve_lead_time_mean', 'reserve_lead_time_mean')} FROM res_daily",
        "res_daily",
    ),
    "reservation_features": sql(
        "SELECT v.store_id, v.date, coalesce(reserve_visitors, 0.0) AS reserve_visitors, "
        "coalesce(reserve_count, 0) AS reserve_count, "
        f"{r6('coalesce(reserve_lead_time_mean, 0.0)', 'reserve_lead_time_mean')} FROM visits v "
        "LEFT JOIN res_daily r ON r.store_id = v.store_id AND r.date = v.date",
        "visits",
        "res_daily",
    ),
    "reservation_features_as_of": sql(
        "SELECT v.store_id, v.date, CAST(coalesce(sum(reserve_visitors), 0) AS DOUBLE) AS "
        "reserve_visitors, count(reserve_visitors) AS reserve_count, "
        f"{r6('coalesce(avg(lead_time_days), 0.0)', 'reserve_lead_time_mean')} FROM visits v "
        "LEFT JOIN (SELECT b.* FROM bookings b, last_day WHERE reserve_ts <= "
        f"CAST(d - {HORIZON} AS TIMESTAMP)) r ON r.store_id = v.store_id AND r.visit_date = v.date "
        "GROUP BY 1, 2",
        "visits",
        "bookings",
        "last_day",
    ),
    "entity_stats": sql(
        f"SELECT store_id, dow, {_levels_out} FROM dow_stats JOIN store_stats USING (store_id)",
        "dow_stats",
        "store_stats",
    ),
    "entity_metadata": sql("SELECT * FROM metadata", "metadata"),
    "feature_matrix": sql(
        "SELECT f.store_id, f.date, visitors, is_closed, f.dow, is_weekend, month, day_of_month, "
        "doy_sin, doy_cos, is_holiday, day_before_holiday, day_after_holiday, golden_week, "
        f"{_lag_out}, {_roll_out}, reserve_visitors, reserve_count, "
        f"{r6('reserve_lead_time_mean', 'reserve_lead_time_mean')}, {_levels_out}, "
        "genre, area_prefecture, area_ward FROM features f "
        "LEFT JOIN store_stats s ON s.store_id = f.store_id "
        "LEFT JOIN dow_stats d ON d.store_id = f.store_id AND d.dow = f.dow "
        "LEFT JOIN metadata m ON m.store_id = f.store_id",
        "features",
        "store_stats",
        "dow_stats",
        "metadata",
    ),
    "feature_matrix_dense_reference": sql(
        "SELECT d.store_id, d.date, CAST(0.0 AS DOUBLE) AS reserve_visitors, "
        "CAST(0 AS BIGINT) AS reserve_count, CAST(0 AS INTEGER) AS is_holiday, "
        f"{_levels_out} FROM dense d JOIN (SELECT store_id, avg(visitors) AS store_mean, "
        "median(visitors) AS store_median FROM dense GROUP BY 1) s ON s.store_id = d.store_id "
        "JOIN (SELECT store_id, isodow(date) AS wd, avg(visitors) AS store_dow_mean, "
        "median(visitors) AS store_dow_median FROM dense GROUP BY 1, 2) w "
        "ON w.store_id = d.store_id AND w.wd = isodow(d.date)",
        "dense",
    ),
    "feature_subset": sql(
        "SELECT f.store_id, f.date, visitors, "
        + ", ".join(
            r6(c, c) if c in ("roll_mean_7", "store_mean") else c for c in sorted(SUBSET)
        )
        + " FROM features f LEFT JOIN store_stats s ON s.store_id = f.store_id",
        "features",
        "store_stats",
    ),
    "log_target_roundtrip": sql(
        f"SELECT store_id, date, visitors, {r6('ln(1 + visitors)', 'log_target')}, "
        f"{r6('greatest(exp(ln(1 + visitors)) - 1, 0.0)', 'restored')} FROM visits",
        "visits",
    ),
    "holdout_split": sql("SELECT train_end, valid_start, valid_end FROM holdout", "holdout"),
    "rolling_splits": sql("SELECT * FROM splits", "splits"),
    "fold_slices": sql(
        "SELECT fold, CAST(count(*) FILTER (v.date <= train_end) AS BIGINT) AS train_rows, "
        "CAST(count(*) FILTER (v.date BETWEEN valid_start AND valid_end) AS BIGINT) AS valid_rows, "
        "sum(visitors) FILTER (v.date <= train_end) AS train_total, "
        "sum(visitors) FILTER (v.date BETWEEN valid_start AND valid_end) AS valid_total "
        "FROM cv v, splits s GROUP BY 1",
        "cv",
        "splits",
    ),
    "fold_entity_stats": sql(
        f"SELECT s.fold, s.store_id, dow, {_levels_out} FROM (SELECT fold, store_id, "
        "avg(visitors) AS store_mean, median(visitors) AS store_median FROM cv_train "
        f"GROUP BY 1, 2) s JOIN (SELECT fold, store_id, {DOW} AS dow, avg(visitors) AS "
        "store_dow_mean, median(visitors) AS store_dow_median FROM cv_train GROUP BY 1, 2, 3) d "
        "ON d.fold = s.fold AND d.store_id = s.store_id",
        "cv_train",
    ),
    "fold_features": sql(
        "SELECT h.store_id, h.date, visitors, is_closed, "
        + ", ".join(r6(c, c) for c in ("lag_7", "roll_mean_7", "roll_median_28", "store_mean"))
        + f", {r6('store_dow_median', 'store_dow_median')} FROM fold0_history h "
        "JOIN (SELECT store_id, avg(visitors) AS store_mean FROM fold0 GROUP BY 1) s "
        "ON s.store_id = h.store_id LEFT JOIN (SELECT store_id, isodow(date) AS wd, "
        "median(visitors) AS store_dow_median FROM fold0 GROUP BY 1, 2) d "
        "ON d.store_id = h.store_id AND d.wd = isodow(h.date)",
        "fold0_history",
    ),
    "naive_onestep": sql(
        "SELECT h.store_id, h.date, round(greatest(coalesce(lag_7, store_dow_mean, "
        "(SELECT avg(visitors) FROM dense)), 0.0), 6) AS y_pred FROM history h "
        "LEFT JOIN dow_stats d ON d.store_id = h.store_id AND d.dow = isodow(h.date) - 1",
        "history",
        "dow_stats",
    ),
    "rollout_naive": sql(
        f"SELECT fold, store_id, date, horizon_offset, {r6('y_pred', 'y_pred')} FROM naive_cv",
        "naive_cv",
    ),
    "batch_predict": sql(
        f"SELECT store_id, date, {r6('y_pred', 'y_pred')} FROM full_naive", "full_naive"
    ),
    "backtest_naive": sql(
        f"SELECT fold, store_id, date, {r6('y_pred', 'y_pred')}, y_true, horizon_offset FROM "
        f"({scored_body('naive_cv', 'cv_valid')})",
        "naive_cv",
        "cv_valid",
    ),
    "backtest_window": sql(
        f"SELECT fold, store_id, date, {r6('y_pred', 'y_pred')}, y_true, horizon_offset FROM "
        f"({scored_body(f'window_preds{CONTEXT}', 'cv_valid')})",
        f"window_preds{CONTEXT}",
        "cv_valid",
    ),
    "metrics_overall": sql(
        f"SELECT model, {SUITE_OUT}, n FROM cube WHERE scope = 'overall'", "cube"
    ),
    "error_by_season": sql(
        f"SELECT model, key AS season, {SUITE_OUT}, n FROM cube WHERE scope = 'season'", "cube"
    ),
    "error_by_region": sql(
        f"SELECT model, key AS region, {SUITE_OUT}, n FROM cube WHERE scope = 'region'", "cube"
    ),
    "error_by_horizon": sql(
        f"SELECT model, CAST(key AS INTEGER) AS horizon_offset, {SUITE_OUT}, n FROM cube "
        "WHERE scope = 'horizon'",
        "cube",
    ),
    "error_cube": sql(f"SELECT model, scope, key, {SUITE_OUT}, n FROM cube", "cube"),
    "cv_scores": sql(
        "SELECT model, round(avg(rmsle), 6) AS rmsle, round(avg(mae), 6) AS mae, "
        "round(avg(weighted_mae), 6) AS weighted_mae, count(*) AS n_folds FROM "
        f"(SELECT model, fold, {RAW_SUITE} FROM cv_preds GROUP BY 1, 2) GROUP BY 1",
        "cv_preds",
    ),
    "runs_flat": sql(
        "SELECT model, CASE WHEN scope = 'overall' THEN m WHEN scope = 'season' THEN "
        "concat(m, '_', key) ELSE concat(m, '_h', key) END AS metric, round(value, 6) AS value "
        "FROM (SELECT model, scope, key, 'rmsle' AS m, rmsle AS value FROM cube UNION ALL "
        "SELECT model, scope, key, 'mae', mae FROM cube WHERE scope <> 'horizon' UNION ALL "
        "SELECT model, scope, key, 'weighted_mae', weighted_mae FROM cube "
        "WHERE scope <> 'horizon') WHERE scope <> 'region'",
        "cube",
    ),
    "region_topk": sql(
        "SELECT key AS region, count(*) AS n_models FROM cube WHERE scope = 'region' GROUP BY 1 "
        "ORDER BY 2 DESC, 1 LIMIT 12",
        "cube",
    ),
    "ablation_delta": sql(
        "SELECT metric, round(a, 6) AS base_value, round(b, 6) AS variant_value, "
        "round(b - a, 6) AS delta, round((b - a) / a * 100, 6) AS delta_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, max({m}) FILTER (model = 'seasonal_naive') AS a, "
            f"max({m}) FILTER (model = 'window_profile') AS b FROM cube WHERE scope = 'overall'"
            for m in ("rmsle", "mae", "weighted_mae")
        )
        + ")",
        "cube",
    ),
    "select_best": sql(
        "SELECT model, ordinal, rmsle, mae, weighted_mae, n_folds, "
        "CAST(row_number() OVER (ORDER BY rmsle, ordinal) = 1 AS INTEGER) AS is_winner FROM ("
        "SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmsle, ordinal) AS rk FROM ("
        "SELECT model, ordinal, round(avg(rmsle), 6) AS rmsle, round(avg(mae), 6) AS mae, "
        "round(avg(weighted_mae), 6) AS weighted_mae, count(*) AS n_folds FROM "
        f"(SELECT model, ordinal, fold, {RAW_SUITE} FROM config_preds GROUP BY 1, 2, 3) "
        "GROUP BY 1, 2)) WHERE rk = 1",
        "config_preds",
    ),
    "holdout_metrics": sql(
        f"SELECT model, {SUITE_OUT}, n FROM (SELECT model, {RAW_SUITE}, count(*) AS n "
        "FROM ho_preds GROUP BY 1)",
        "ho_preds",
    ),
    "pred_vs_real_daily": sql(
        "SELECT model, date, round(sum(y_true), 6) AS y_true, round(sum(y_pred), 6) AS y_pred, "
        "count(*) AS n FROM ho_preds GROUP BY 1, 2",
        "ho_preds",
    ),
    "residual_histogram": sql(
        "SELECT model, bin, round(lo + bin * ((hi - lo) / 40.0), 6) AS left_edge, n FROM ("
        "SELECT model, lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / 40.0)), 39) AS INTEGER) "
        "AS bin, count(*) AS n FROM (SELECT model, y_true - y_pred AS x FROM ho_preds), "
        "(SELECT quantile_cont(y_true - y_pred, 0.01) AS lo, quantile_cont(y_true - y_pred, 0.99) "
        "AS hi FROM ho_preds) WHERE x BETWEEN lo AND hi GROUP BY ALL)",
        "ho_preds",
    ),
    "window_forecast": sql(
        "SELECT fold, store_id, date, horizon_offset, round(y_pred, 6) AS y_pred FROM "
        f"window_preds{CONTEXT}",
        f"window_preds{CONTEXT}",
    ),
    "window_signal": sql(
        f"SELECT store_id, k AS step, {_sig_out} FROM full_window", "full_window"
    ),
    "signal_origins": sql("SELECT date FROM origins", "origins"),
    "signal_training_rows": sql(
        "SELECT t.store_id, t.date, w.fold AS origin, t.visitors, t.lag_7, "
        f"{r6('w.point', 'sig_point')}, {r6('w.q[1]', 'sig_q1')}, {r6('w.q[5]', 'sig_q5')}, "
        f"{r6('w.q[9]', 'sig_q9')} FROM (SELECT *, lag(visitors, 7) OVER (PARTITION BY store_id "
        "ORDER BY date) AS lag_7 FROM train_dense) t JOIN origin_window w "
        "ON w.store_id = t.store_id AND w.train_end + w.k = t.date",
        "train_dense",
        "origin_window",
    ),
    "signal_store_misses": sql(
        f"SELECT DISTINCT ys FROM series_asked WHERE fold >= {N_FOLDS // 2} AND ys NOT IN "
        f"(SELECT ys FROM series_asked WHERE fold < {N_FOLDS // 2})",
        "series_asked",
    ),
    "importance_topk": sql(
        "SELECT feature, value, round(value / sum(value) OVER () * 100, 6) AS share_pct "
        "FROM importances ORDER BY value DESC, feature LIMIT 15",
        "importances",
    ),
    "feature_select": sql(
        "SELECT CAST(rank AS INTEGER) AS rank, feature, value FROM ("
        "SELECT row_number() OVER o AS rank, feature, value, coalesce(sum(value) OVER "
        "(o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(value) OVER () AS before "
        "FROM importances WINDOW o AS (ORDER BY value DESC, feature)) "
        f"WHERE value > 0 AND before < {SETTINGS.feature_select_threshold}",
        "importances",
    ),
    "row_sample": sql(
        "SELECT v.store_id, v.date, v.visitors, r.reserve_visitors FROM visits v JOIN res_daily r "
        "ON r.store_id = v.store_id AND r.date = v.date WHERE r.reserve_visitors > 0 "
        "ORDER BY md5(concat_ws('|', '0', CAST(v.store_id AS VARCHAR), CAST(v.date AS VARCHAR))), "
        "v.store_id, v.date LIMIT 8000",
        "visits",
        "res_daily",
    ),
    "stump_fit_predict": sql(
        "SELECT store_id, date, visitors, "
        + r6("exp(avg(ln(1 + visitors)) OVER (PARTITION BY is_closed)) - 1", "y_pred")
        + " FROM dense",
        "dense",
    ),
    "stump_importance": "SELECT 'is_closed' AS feature, CAST(1.0 AS DOUBLE) AS value",
    "stump_rollout": sql(
        "SELECT s.store_id, CAST((SELECT max(date) FROM visits) + k AS DATE) AS date, "
        + r6("(SELECT exp(avg(ln(1 + visitors))) - 1 FROM dense WHERE is_closed = 0)", "y_pred")
        + f" FROM (SELECT DISTINCT store_id FROM visits) s, (SELECT CAST(i AS INTEGER) AS k FROM range(1, {HORIZON + 1}) t(i))",
        "visits",
        "dense",
    ),
    "null_profile": " UNION ALL ".join(
        _null_rows(t, c) for t, names in COLUMNS.items() for c in names.split()
    ),
    "null_profile_features": sql(
        " UNION ALL ".join(
            _null_rows("history", c)
            for c in ["store_id", "date", "visitors", "is_closed"]
            + [f"lag_{k}" for k in LAGS]
            + [f"roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("mean", "median")]
        ),
        "history",
    ),
    "duplicate_keys": (
        "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, "
        "CAST(sum(c - 1) AS BIGINT) AS n_duplicate_rows FROM (SELECT count(*) AS c FROM lineitem "
        "GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"
    ),
    "cardinality": sql(
        "SELECT 'visit_stores' AS variable, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem "
        "UNION ALL SELECT 'stores', count(DISTINCT store_id) FROM stores "
        "UNION ALL SELECT 'genres', count(DISTINCT genre) FROM stores "
        "UNION ALL SELECT 'areas', count(DISTINCT area) FROM stores "
        "UNION ALL SELECT 'mapped_ids', count(DISTINCT hpg_store_id) FROM relation",
        "stores",
        "relation",
    ),
    "value_counts": sql(
        " UNION ALL ".join(
            [
                _counts("genre", "stores", "genre"),
                _counts("prefecture", "metadata", "area_prefecture"),
                _counts("day_of_week", "visit_days", "day_name"),
                _counts("is_holiday", "visit_holidays", "is_holiday"),
            ]
        ),
        "stores",
        "metadata",
        "visit_days",
        "visit_holidays",
    ),
    "describe_target": sql(
        "SELECT count(visitors) AS n_values, round(avg(visitors), 6) AS mean, "
        "round(stddev_samp(visitors), 6) AS std, min(visitors) AS min, "
        "round(quantile_cont(visitors, 0.25), 6) AS p25, round(median(visitors), 6) AS p50, "
        "round(quantile_cont(visitors, 0.75), 6) AS p75, max(visitors) AS max FROM visits",
        "visits",
    ),
    "skew_target": sql(
        "SELECT round(skewness(visitors), 6) AS skew_raw, "
        "round(skewness(ln(1 + visitors)), 6) AS skew_log1p FROM visits",
        "visits",
    ),
    "target_histogram": sql(
        _hist("visits", "visitors", 60, "'raw' AS scale, ")
        + " UNION ALL "
        + _hist("visits", "ln(1 + visitors)", 60, "'log1p' AS scale, "),
        "visits",
    ),
    "mean_by_dow": sql(
        f"SELECT {DOW} AS dow, dayname(date) AS day_name, round(avg(visitors), 6) AS mean_visitors, "
        "count(*) AS n FROM visits GROUP BY 1, 2",
        "visits",
    ),
    "mean_by_holiday": sql(
        "SELECT is_holiday, round(avg(visitors), 6) AS mean_visitors, count(*) AS n FROM visits v "
        "LEFT JOIN holidays h ON h.date = v.date GROUP BY 1",
        "visits",
        "holidays",
    ),
    "mean_by_day": sql(
        "SELECT date, round(avg(visitors), 6) AS mean_visitors, count(*) AS n FROM visits GROUP BY 1",
        "visits",
    ),
    "corr_with_target": sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(corr({c}, visitors), 6) AS corr, "
            f"round(abs(corr({c}, visitors)), 6) AS abs_corr FROM observed_panel"
            for c in CORRELATED
        ),
        "observed_panel",
    ),
    "corr_matrix": sql(_pairs(), "observed_panel"),
    "reservation_lift": sql(
        "SELECT count(*) AS n_days, count(*) FILTER (rv > 0) AS n_reserved_days, "
        "round(avg(CAST(rv > 0 AS DOUBLE)), 6) AS reserved_share, "
        "round(corr(rv, visitors) FILTER (rv > 0), 6) AS corr_reserved, "
        "round(avg(visitors) FILTER (rv > 0), 6) AS mean_reserved, "
        "round(avg(visitors) FILTER (rv = 0), 6) AS mean_unreserved FROM ("
        "SELECT v.*, coalesce(r.reserve_visitors, 0.0) AS rv FROM visits v LEFT JOIN res_daily r "
        "ON r.store_id = v.store_id AND r.date = v.date)",
        "visits",
        "res_daily",
    ),
    "store_sample": sql(
        "SELECT DISTINCT store_id FROM visits ORDER BY store_id LIMIT 2", "visits"
    ),
}
