"""The SQL counterparts of ``more_queries``."""

from __future__ import annotations

from panelcast.catalog.more_queries import ALPHA, CLUSTERS
from panelcast.catalog.oracles import HORIZON, ORACLES, cte, naive_body, r6, scored_body, sql
from panelcast.catalog.queries import IMPORTANCE_FEATURES
from panelcast.operators.drift import BINS_PER_E
from panelcast.operators.smoothing import RATES, ewm_column
from panelcast.schema import ROLL_WINDOWS

cte(
    "paths",
    "SELECT v.store_id, 'total' AS n0, 'total/' || coalesce(area_prefecture, 'unknown') AS n1, "
    "'total/' || coalesce(area_prefecture, 'unknown') || '/' || coalesce(area_ward, 'unknown') AS n2, "
    "'total/' || coalesce(area_prefecture, 'unknown') || '/' || coalesce(area_ward, 'unknown') || '/' || "
    "CAST(v.store_id AS VARCHAR) AS n3 FROM (SELECT DISTINCT store_id FROM visits) v "
    "LEFT JOIN metadata m ON m.store_id = v.store_id",
    "visits",
    "metadata",
)
cte(
    "tree",
    "SELECT DISTINCT n0 AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS INTEGER) AS depth FROM paths "
    + "".join(f"UNION ALL SELECT DISTINCT n{d}, n{d - 1}, CAST({d} AS INTEGER) FROM paths " for d in (1, 2, 3)),
    "paths",
)
cte(
    "node_visits",
    " UNION ALL ".join(
        f"SELECT n{d} AS store_id, date, sum(visitors) AS visitors FROM visits v JOIN paths p "
        "ON p.store_id = v.store_id GROUP BY 1, 2"
        for d in range(4)
    ),
    "visits",
    "paths",
)
cte("node_cv", "SELECT v.* FROM node_visits v JOIN holdout ON v.date <= train_end", "node_visits", "holdout")
cte(
    "node_train",
    "SELECT s.fold, s.train_end, v.* FROM node_cv v JOIN splits s ON v.date <= s.train_end",
    "node_cv",
    "splits",
)
cte(
    "node_valid",
    "SELECT s.fold, v.store_id, v.date, v.visitors AS y_true, "
    "CAST(v.date - s.train_end AS INTEGER) AS horizon_offset FROM node_cv v "
    "JOIN splits s ON v.date BETWEEN s.valid_start AND s.valid_end",
    "node_cv",
    "splits",
)
cte("node_naive", naive_body("node_train", HORIZON), "node_train")
cte(
    "variances",
    f"SELECT depth, avg(pow(y_true - y_pred, 2)) AS variance FROM ({scored_body('node_naive', 'node_valid')}) "
    "JOIN tree ON node = store_id GROUP BY 1",
    "node_naive",
    "node_valid",
    "tree",
)
cte(
    "node_ho_train",
    "SELECT h.fold, h.train_end, v.* FROM node_cv v, holdout h",
    "node_cv",
    "holdout",
)
cte("node_ho_naive", naive_body("node_ho_train", HORIZON), "node_ho_train")
cte(
    "node_base",
    "SELECT node, parent, t.depth, date, y_pred, variance AS v FROM node_ho_naive n JOIN tree t "
    "ON t.node = n.store_id JOIN variances r ON r.depth = t.depth",
    "node_ho_naive",
    "tree",
    "variances",
)
cte("up3", "SELECT *, y_pred AS m, v AS u FROM node_base WHERE depth = 3", "node_base")
for _d in (2, 1, 0):
    cte(
        f"up{_d}",
        "SELECT b.*, s, w, (s / w + y_pred / v) / (1 / w + 1 / v) AS m, 1 / (1 / w + 1 / v) AS u FROM node_base b "
        f"JOIN (SELECT parent, date, sum(m) AS s, sum(u) AS w FROM up{_d + 1} GROUP BY 1, 2) c "
        f"ON c.parent = b.node AND c.date = b.date WHERE b.depth = {_d}",
        "node_base",
        f"up{_d + 1}",
    )
cte("down0", "SELECT *, m AS y FROM up0", "up0")
for _d in (1, 2, 3):
    cte(
        f"down{_d}",
        f"SELECT c.*, c.m + c.u / p.w * (p.y - p.s) AS y FROM up{_d} c JOIN down{_d - 1} p "
        "ON p.node = c.parent AND p.date = c.date",
        f"up{_d}",
        f"down{_d - 1}",
    )

cte(
    "demands",
    "SELECT s.fold, s.train_end, store_id, visitors AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY "
    "s.fold, store_id) AS n, CAST(date - lag(date) OVER w AS DOUBLE) AS gap FROM cv v JOIN splits s "
    "ON v.date <= s.train_end AND visitors > 0 WINDOW w AS (PARTITION BY s.fold, store_id ORDER BY date)",
    "cv",
    "splits",
)


def _smoothed(value: str, first: str) -> str:
    """The recurrence written out: the first value decays from 1, the others count ALPHA when new."""
    keep = 1.0 - ALPHA
    return (
        f"sum(CASE WHEN i = 1 THEN {first} * pow({keep}, n - 1) ELSE {ALPHA} * {value} * pow({keep}, n - i) END)"
    )


cte(
    "demand_states",
    f"SELECT fold, train_end AS cutoff, store_id, {_smoothed('y', 'y')} AS z, {_smoothed('gap', '1.0')} AS p "
    "FROM demands GROUP BY 1, 2, 3",
    "demands",
)
cte(
    "intermittent_cv",
    "SELECT fold, store_id, CAST(k AS INTEGER) AS horizon_offset, greatest(z / p * "
    f"{1.0 - ALPHA / 2.0}, 0.0) AS y_pred FROM demand_states, range(1, {HORIZON + 1}) t(k)",
    "demand_states",
)

_BIN = f"CAST(floor(ln(1 + greatest(visitors, 0.0)) * {BINS_PER_E}) AS INTEGER)"
cte(
    "bins",
    f"SELECT store_id, {_BIN} AS bin, count(*) FILTER (date <= train_end) AS base, "
    "count(*) FILTER (date > train_end) AS recent FROM visits, holdout GROUP BY 1, 2",
    "visits",
    "holdout",
)
cte(
    "shares",
    "SELECT *, (base + 0.5) / (nb + 0.5 * k) AS p, (recent + 0.5) / (nr + 0.5 * k) AS q, "
    "abs(sum(recent / nr - base / nb) OVER (PARTITION BY store_id ORDER BY bin)) AS d FROM (SELECT *, "
    "sum(base) OVER s AS nb, sum(recent) OVER s AS nr, count(*) OVER s AS k FROM bins "
    "WINDOW s AS (PARTITION BY store_id))",
    "bins",
)
cte(
    "reference_days",
    "SELECT store_id, isodow(date) AS wd, avg(visitors) AS m, var_pop(visitors) * count(*) AS sq, count(*) AS n "
    "FROM visits JOIN holdout ON date <= train_end GROUP BY 1, 2",
    "visits",
    "holdout",
)
cte(
    "scores",
    "SELECT v.store_id, v.date, (visitors - m) / nullif(spread, 0) AS z FROM visits v JOIN holdout h "
    "ON v.date > h.train_end JOIN reference_days r ON r.store_id = v.store_id AND r.wd = isodow(v.date) JOIN "
    "(SELECT store_id, sqrt(sum(sq) / sum(n)) AS spread FROM reference_days GROUP BY 1) s "
    "ON s.store_id = v.store_id",
    "visits",
    "holdout",
    "reference_days",
)
cte(
    "sums",
    "SELECT *, cu - least(0.0, min(cu) OVER w) AS up, cd - least(0.0, min(cd) OVER w) AS down FROM ("
    "SELECT store_id, date, sum(z - 0.5) OVER w AS cu, sum(-z - 0.5) OVER w AS cd FROM scores "
    "WHERE z IS NOT NULL WINDOW w AS (PARTITION BY store_id ORDER BY date)) "
    "WINDOW w AS (PARTITION BY store_id ORDER BY date)",
    "scores",
)
cte(
    "alarms",
    "SELECT store_id, max(up) AS rise, max(down) AS fall, min(date) FILTER (up > 8 OR down > 8) AS first_alarm "
    "FROM sums GROUP BY 1",
    "sums",
)
cte(
    "numbered",
    "SELECT store_id, date, visitors AS y, row_number() OVER (PARTITION BY store_id ORDER BY date) AS i FROM dense",
    "dense",
)
_start = ", ".join(f"CAST(NULL AS DOUBLE) AS {ewm_column(r)}" for r in RATES)
_next = ", ".join(f"CASE WHEN s.i = 1 THEN s.y ELSE {r} * s.y + {1.0 - r} * s.{ewm_column(r)} END" for r in RATES)
cte(
    "smoothed",
    f"SELECT store_id, date, i, y, {_start} FROM numbered WHERE i = 1 UNION ALL "
    f"SELECT n.store_id, n.date, n.i, n.y, {_next} FROM smoothed s JOIN numbered n "
    "ON n.store_id = s.store_id AND n.i = s.i + 1",
    "numbered",
)


def _recursive(body: str, *needs: str) -> str:
    return sql(body, *needs).replace("WITH ", "WITH RECURSIVE ", 1)


_spread = ", ".join(
    f"round(CASE WHEN count(*) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN "
    f"{f} OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 6) AS roll_{s}_{n}"
    for n in ROLL_WINDOWS
    for s, f in (
        ("std", "stddev_samp(visitors)"),
        ("min", "min(visitors)"),
        ("max", "max(visitors)"),
        ("q90", "quantile_cont(visitors, 0.9)"),
    )
)


def _place(key: str, lat: int, lon: int) -> str:
    return f"({key} * {lat} % 18000) / 100.0 - 90.0 AS lat, ({key} * {lon} % 36000) / 100.0 - 180.0 AS lon"


cte(
    "places",
    f"SELECT store_id, lat, lon FROM (SELECT s_suppkey AS store_id, {_place('s_suppkey', 7919, 104729)} FROM supplier) "
    "WHERE store_id % 10 <> 3",
)
cte("stations", f"SELECT c_custkey AS station_id, {_place('c_custkey', 15731, 32452843)} FROM customer")
cte(
    "nearest",
    "SELECT store_id, station_id, distance FROM (SELECT store_id, station_id, distance, row_number() OVER "
    "(PARTITION BY store_id ORDER BY distance, station_id) AS i FROM (SELECT store_id, station_id, "
    "sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)) AS distance FROM places p, stations s)) WHERE i = 1",
    "places",
    "stations",
)
cte(
    "last_reading",
    "SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS read_on, "
    "arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS value FROM orders GROUP BY 1, 2",
)
cte(
    "cluster0",
    "SELECT CAST(row_number() OVER (ORDER BY md5(CAST(store_id AS VARCHAR))) - 1 AS INTEGER) AS i, lat, lon FROM places "
    f"WHERE store_id IN (SELECT store_id FROM cv) QUALIFY i < {CLUSTERS}",
    "places",
    "cv",
)


def _assigned(centres: str, where: str) -> str:
    return (
        f"SELECT p.store_id, p.lat, p.lon, arg_min(c.i, pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2)) AS i "
        f"FROM places p, {centres} c {where} GROUP BY 1, 2, 3"
    )


for _step in range(1, 26):
    cte(
        f"cluster{_step}",
        f"SELECT c.i, coalesce(m.lat, c.lat) AS lat, coalesce(m.lon, c.lon) AS lon FROM cluster{_step - 1} c LEFT JOIN "
        f"(SELECT i, avg(lat) AS lat, avg(lon) AS lon FROM "
        f"({_assigned(f'cluster{_step - 1}', 'WHERE p.store_id IN (SELECT store_id FROM cv)')}) GROUP BY 1) m ON m.i = c.i",
        f"cluster{_step - 1}",
        "places",
        "cv",
    )
cte(
    "fold_last",
    "SELECT s.fold, s.train_end, store_id, max(date) AS last, avg(visitors) AS store_mean FROM cv v JOIN splits s "
    "ON v.date <= s.train_end GROUP BY 1, 2, 3",
    "cv",
    "splits",
)
cte(
    "fold_dow",
    "SELECT s.fold, store_id, isodow(date) AS wd, median(visitors) AS store_dow_median FROM cv v JOIN splits s "
    "ON v.date <= s.train_end GROUP BY 1, 2, 3",
    "cv",
    "splits",
)

_NUMERIC = ["visitors", *IMPORTANCE_FEATURES]

ORACLES.update(
    {
        "store_tree": sql("SELECT * FROM tree", "tree"),
        "level_panels": sql("SELECT * FROM node_visits", "node_visits"),
        "level_variances": sql(f"SELECT depth, {r6('variance', 'variance')} FROM variances", "variances"),
        "reconciled_forecast": sql(
            " UNION ALL ".join(
                f"SELECT node, depth, date, {r6('y_pred', 'y_pred')}, {r6('y', 'y_reconciled')} FROM down{d}"
                for d in range(4)
            ),
            "down3",
        ),
        "intermittent_states": sql(
            f"SELECT fold, cutoff, store_id, {r6('z', 'z')}, {r6('p', 'p')} FROM demand_states", "demand_states"
        ),
        "backtest_intermittent": sql(
            f"SELECT fold, store_id, date, {r6('y_pred', 'y_pred')}, y_true, horizon_offset FROM "
            f"({scored_body('intermittent_cv', 'cv_valid')})",
            "intermittent_cv",
            "cv_valid",
        ),
        "store_drift": sql(
            "SELECT b.store_id, CAST(nb AS BIGINT) AS n_base, CAST(nr AS BIGINT) AS n_recent, "
            f"{r6('stability_index', 'stability_index')}, {r6('distance', 'distance')}, {r6('rise', 'rise')}, "
            f"{r6('fall', 'fall')}, first_alarm, CAST(first_alarm IS NOT NULL AS INTEGER) AS drifted FROM ("
            "SELECT store_id, any_value(nb) AS nb, any_value(nr) AS nr, "
            "CASE WHEN any_value(nb) > 0 AND any_value(nr) > 0 THEN sum((q - p) * ln(q / p)) END AS stability_index, "
            "CASE WHEN any_value(nb) > 0 AND any_value(nr) > 0 THEN max(d) END AS distance "
            "FROM shares GROUP BY 1) b LEFT JOIN alarms a ON a.store_id = b.store_id",
            "shares",
            "alarms",
        ),
        "ewm_features": _recursive(
            f"SELECT store_id, date, {', '.join(r6(ewm_column(r), ewm_column(r)) for r in RATES)} FROM smoothed",
            "smoothed",
        ),
        "backtest_bookings_as_of": sql(
            "SELECT fold, store_id, visit_date AS date, CAST(sum(reserve_visitors) AS DOUBLE) AS reserve_visitors, "
            f"count(*) AS reserve_count, {r6('avg(lead_time_days)', 'reserve_lead_time_mean')} FROM bookings "
            "JOIN splits ON visit_date BETWEEN valid_start AND valid_end "
            "AND CAST(reserve_ts AS DATE) <= train_end GROUP BY 1, 2, 3",
            "bookings",
            "splits",
        ),
        "corr_features": sql(
            " UNION ALL ".join(
                f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", CAST(regr_count({a}, {b}) AS BIGINT) AS n, "
                f"round(CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN corr({a}, {b}) END, 6) AS corr FROM leveled"
                for i, a in enumerate(_NUMERIC)
                for b in _NUMERIC[i + 1 :]
            ),
            "leveled",
        ),
        "rolling_spread": sql(
            f"SELECT store_id, date, {_spread} FROM dense WINDOW w AS (PARTITION BY store_id ORDER BY date)", "dense"
        ),
        "nearest_stations": sql("SELECT store_id, station_id, round(distance, 6) AS distance FROM nearest", "nearest"),
        "weather_features": sql(
            "SELECT v.store_id, v.date, v.station_id, round(v.distance, 6) AS distance, round(r.value, 6) AS weather, "
            "CAST(v.date - r.read_on AS INTEGER) AS weather_age FROM (SELECT v.store_id, v.date, station_id, distance "
            "FROM visits v LEFT JOIN nearest n ON n.store_id = v.store_id) v ASOF LEFT JOIN last_reading r "
            "ON r.station_id = v.station_id AND r.read_on <= v.date",
            "visits",
            "nearest",
            "last_reading",
        ),
        "location_clusters": sql(
            "SELECT s.s_suppkey AS store_id, a.i AS location_cluster, round(c.lat, 6) AS centre_lat, "
            f"round(c.lon, 6) AS centre_lon FROM supplier s LEFT JOIN ({_assigned('cluster25', '')}) a "
            "ON a.store_id = s.s_suppkey LEFT JOIN cluster25 c ON c.i = a.i",
            "cluster25",
        ),
        "fold_features_all": sql(
            "SELECT l.fold, is_closed, count(*) AS n, round(sum(f.visitors), 3) AS visitors, round(sum(lag_7), 3) AS lag_7, "
            "round(sum(roll_mean_7), 3) AS roll_mean_7, round(sum(roll_median_28), 3) AS roll_median_28, "
            "round(sum(store_mean), 3) AS store_mean, round(sum(store_dow_median), 3) AS store_dow_median, "
            "round(sum(reserve_visitors), 3) AS reserve_visitors FROM features f JOIN fold_last l "
            "ON l.store_id = f.store_id AND f.date <= l.last LEFT JOIN fold_dow d ON d.fold = l.fold "
            "AND d.store_id = f.store_id AND d.wd = isodow(f.date) GROUP BY 1, 2",
            "features",
            "fold_last",
            "fold_dow",
        ),
        "backtest_stump": sql(
            "SELECT v.fold, v.store_id, v.date, v.y_true, v.horizon_offset, round(p.y, 6) AS y_pred FROM cv_valid v JOIN "
            "(SELECT fold, exp(avg(ln(1 + visitors))) - 1 AS y FROM cv_train GROUP BY 1) p ON p.fold = v.fold "
            "WHERE (v.fold, v.store_id) IN (SELECT fold, store_id FROM cv_train)",
            "cv_valid",
            "cv_train",
        ),
        "holdout_stump": sql(
            "SELECT v.fold, v.store_id, v.date, v.y_true, v.horizon_offset, round(p.y, 6) AS y_pred FROM ho_valid v, "
            "(SELECT exp(avg(ln(1 + visitors))) - 1 AS y FROM ho_train) p "
            "WHERE v.store_id IN (SELECT store_id FROM ho_train)",
            "ho_valid",
            "ho_train",
        ),
        "capped_visits": sql(
            "SELECT v.store_id, v.date, round(coalesce(least(greatest(visitors, lo), hi), visitors), 6) AS visitors, "
            "CAST(coalesce(least(greatest(visitors, lo), hi) <> visitors, FALSE) AS INTEGER) AS is_capped "
            "FROM visits v LEFT JOIN (SELECT store_id, quantile_cont(visitors, 0.01) AS lo, "
            "quantile_cont(visitors, 0.99) AS hi FROM cv GROUP BY 1) c ON c.store_id = v.store_id",
            "visits",
            "cv",
        ),
    }
)
