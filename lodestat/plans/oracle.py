"""SQL text for the DuckDB oracles (correctness checks only; never run by Spark).

The oracle side deliberately takes a different route from the library:
least squares by modified Gram-Schmidt as chained CTEs (each step one
aggregate and one projection), fitted values as ``y - residual``, and raw
coefficients by back-substitution.  The library solves grouped moments with a
pseudo-inverse instead, so agreement checks both.
"""

from __future__ import annotations

from typing import Sequence

from .. import config as C
from ..functions.columns import test_threshold
from ..sources.fixtures import NIGHT_MINUTES

D = C.OUT_DECIMALS


def r(expr: str, d: int = D) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {d}) + 0.0)"


def key_hash_sql(key_cols: Sequence[str], seed: int) -> str:
    if len(key_cols) == 1:
        text = f"CAST({key_cols[0]} AS VARCHAR)"
    else:
        text = "concat_ws(':', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key_cols) + ")"
    return f"CAST(('0x' || substr(md5(concat('{seed}:', {text})), 1, 8)) AS BIGINT)"


def is_test_sql(key_cols: Sequence[str], seed: int, test_size: float = C.TEST_SIZE) -> str:
    return f"({key_hash_sql(key_cols, seed)} < {test_threshold(test_size)})"


def fold_sql(key_cols: Sequence[str], seed: int, k: int = C.N_FOLDS) -> str:
    return f"CAST(({key_hash_sql(key_cols, seed + 1_000_003)} % {k}) AS INTEGER)"


def bucket_sql(ts: str, minutes: int = C.BUCKET_MINUTES) -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', {ts})"


def ts_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def season_sql(month: str) -> str:
    w = ", ".join(str(m) for m in C.WINTER_MONTHS)
    s = ", ".join(str(m) for m in C.SPRING_MONTHS)
    return f"(CASE WHEN {month} IN ({w}) THEN 'Winter' WHEN {month} IN ({s}) THEN 'Spring' ELSE 'Other' END)"


def nan_null(x: str) -> str:
    return f"(CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL ELSE CAST({x} AS DOUBLE) END)"


# --- fixtures ---------------------------------------------------------------------

LANDING = f"""landing AS (
  SELECT event_id AS key, ts AS start_time, strftime(ts, '%Y-%m-%d') AS date,
         {nan_null('value')} AS time_to_food,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS risk,
         CAST(((user_id % 2) + 2) % 2 AS INTEGER) AS reward,
         CAST(((minute(ts) % 30) + 30) % 30 AS DOUBLE) AS min_after_arrival,
         CAST(month(ts) AS INTEGER) AS month
  FROM events WHERE event_type IN ('view', 'click'))"""

OBSERVATION = f"""observation AS (
  SELECT time, strftime(time, '%Y-%m-%d') AS date, arrival_number, landing_number,
         food_availability, arrival_minutes, CAST(month(time) AS INTEGER) AS month
  FROM (SELECT {bucket_sql('ts')} AS time,
               count(*) FILTER (WHERE event_type = 'error') AS arrival_number,
               count(*) FILTER (WHERE event_type = 'signup') AS landing_number,
               CAST(least(count(*) FILTER (WHERE event_type = 'purchase'), 4) AS DOUBLE) AS food_availability,
               sum({nan_null('value')}) FILTER (WHERE event_type = 'error') AS arrival_minutes
        FROM events WHERE event_type IN ('error', 'purchase', 'signup')
        GROUP BY 1))"""

# JON1 + JON2: left join on (date, bucket); bucket_count = joined rows per key
def joined_sql(extra: str = "") -> str:
    return f"""lb AS (
  SELECT *, {bucket_sql('start_time')} AS start_time_interval FROM landing),
ob AS (
  SELECT *, {bucket_sql('time')} AS time_interval FROM observation),
j0 AS (
  SELECT lb.key, lb.start_time, lb.date, lb.time_to_food, lb.risk, lb.reward, lb.min_after_arrival,{extra}
         lb.month AS month_x, lb.start_time_interval,
         ob.time, ob.arrival_number, ob.landing_number, ob.food_availability, ob.arrival_minutes,
         ob.month AS month_y, ob.time_interval
  FROM lb LEFT JOIN ob ON lb.date = ob.date AND lb.start_time_interval = ob.time_interval),
joined AS (
  SELECT j0.*, CASE WHEN j0.date IS NOT NULL AND j0.start_time_interval IS NOT NULL
                    THEN count(*) OVER (PARTITION BY j0.date, j0.start_time_interval) END AS bucket_count
  FROM j0)"""

FEATURES = f"""feat AS (
  SELECT *,
         CASE WHEN coalesce(arrival_number, 0) > 0 THEN 1 ELSE 0 END AS arrival_present,
         round_even(food_availability / {C.FOOD_SCALE}, {C.FOOD_DECIMALS}) AS food_fraction,
         CAST(month(CAST(date AS DATE)) AS INTEGER) AS month_num,
         {season_sql('month(CAST(date AS DATE))')} AS season,
         CASE WHEN coalesce(arrival_number > bucket_count, false) THEN 1 ELSE 0 END AS arrivals_exceed
  FROM joined),
feat2 AS (
  SELECT *, arrivals_exceed * risk AS risk_arrivals, food_fraction * risk AS risk_food FROM feat),
feat3 AS (
  SELECT *, risk_arrivals * risk_food * reward AS risk_reward FROM feat2)"""

FIXTURE_A = ",\n".join([LANDING, OBSERVATION, joined_sql(), FEATURES])

_ORDER_MINUTE = f"((o_orderkey * 7) % {NIGHT_MINUTES})"
LANDING_D = f"""landing AS (
  SELECT o_orderkey AS key, o_orderdate + to_minutes(CAST({_ORDER_MINUTE} AS BIGINT)) AS start_time, strftime(o_orderdate, '%Y-%m-%d') AS date,
         {nan_null('o_totalprice')} / 1000.0 AS time_to_food,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 0 END AS risk,
         CAST(o_custkey % 2 AS INTEGER) AS reward,
         CAST((o_orderkey * 13) % 97 AS DOUBLE) AS min_after_arrival,
         CAST({_ORDER_MINUTE} AS DOUBLE) AS min_after_sunset,
         CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders)"""

OBSERVATION_D = f"""observation AS (
  SELECT time, strftime(time, '%Y-%m-%d') AS date, arrival_number, landing_number,
         food_availability, arrival_minutes, CAST(month(time) AS INTEGER) AS month
  FROM (SELECT {bucket_sql(f'(l_shipdate + to_minutes(CAST((l_partkey * 3 + l_suppkey) % {NIGHT_MINUTES} AS BIGINT)))')} AS time,
               count(*) FILTER (WHERE l_returnflag = 'R') AS arrival_number,
               count(*) FILTER (WHERE l_returnflag = 'A') AS landing_number,
               CAST(least(count(*) FILTER (WHERE l_returnflag = 'N'), 4) AS DOUBLE) AS food_availability,
               sum({nan_null('l_quantity')}) FILTER (WHERE l_returnflag = 'R') AS arrival_minutes
        FROM lineitem GROUP BY 1))"""

#: The analysis of fixture A on the landings and observations of fixture D.
FIXTURE_D = ",\n".join([LANDING_D, OBSERVATION_D, joined_sql(" lb.min_after_sunset,"), FEATURES])


def on_orders(sql: str) -> str:
    """The oracle of a query on fixture A, for the same query on fixture D."""
    return sql.replace(FIXTURE_A, FIXTURE_D)

ORDER_FRAME = f"""per_order AS (
  SELECT l_orderkey, count(*) AS n_lines, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc,
         avg(l_tax) AS avg_tax
  FROM lineitem GROUP BY l_orderkey),
ordf AS (
  SELECT o.o_orderkey AS key, o.o_totalprice / 1000.0 AS target, CAST(p.n_lines AS DOUBLE) AS n_lines,
         p.avg_qty, p.avg_disc, p.avg_tax,
         CASE WHEN starts_with(o.o_orderpriority, '1') THEN 1 ELSE 0 END AS urgent,
         {season_sql('month(o.o_orderdate)')} AS season,
         CASE WHEN {season_sql('month(o.o_orderdate)')} = 'Winter' THEN 'winter' ELSE 'not_winter' END AS atom
  FROM orders o LEFT JOIN per_order p ON o.o_orderkey = p.l_orderkey)"""


def segments_union(src: str, segments: dict[str, list[str]], atom_col: str = "atom") -> str:
    """Rows of each segment, labelled (a row appears once per segment holding it)."""
    parts = []
    for seg, atoms in segments.items():
        lst = ", ".join(f"'{a}'" for a in atoms)
        parts.append(f"SELECT '{seg}' AS segment, * FROM {src} WHERE {atom_col} IN ({lst})")
    return "\nUNION ALL\n".join(parts)


# --- Gram-Schmidt least squares ------------------------------------------------------

def gs_ctes(prefix: str, src: str, group: Sequence[str], carry: Sequence[str], features: Sequence[str],
            target: str, train: str, intercept: bool = True, tol: float = 1e-9) -> tuple[list[str], str, str]:
    """CTEs fitting ``target ~ features`` per ``group`` on rows where ``train``.

    Returns (ctes, scored_cte, coef_cte).  ``scored_cte`` has group, carry
    columns, __t (train flag), __y and __yhat for every row of ``src``;
    ``coef_cte`` has group, b0 (intercept), b1..bk (raw) and s1..sk
    (coefficients on standardised features), per group.
    """
    k = len(features)
    g = list(group)
    gsel = ", ".join(g)
    gsel_c = (gsel + ", ") if g else ""
    using = f"USING ({gsel})" if g else "ON TRUE"
    grp_by = f"GROUP BY {gsel}" if g else ""
    carry_sel = "".join(f"{c}, " for c in carry)
    ctes = []
    u = [f"u{i}" for i in range(k)]
    base = f"{prefix}_b"
    ctes.append(f"""{base} AS (
  SELECT {gsel_c}{carry_sel}({train}) AS __t, CAST({target} AS DOUBLE) AS __y,
         {', '.join(f'CAST({f} AS DOUBLE) AS {u[i]}' for i, f in enumerate(features))}{',' if k else ''} CAST({target} AS DOUBLE) AS uy
  FROM {src})""")
    # centring (intercept) and the norms used by the rank tolerance
    mean_cols = [f"avg({u[i]}) FILTER (WHERE __t) AS m{i}" for i in range(k)] + ["avg(uy) FILTER (WHERE __t) AS my"]
    sd_cols = [f"stddev_pop({u[i]}) FILTER (WHERE __t) AS sd{i}" for i in range(k)]
    ctes.append(f"""{prefix}_m AS (
  SELECT {gsel_c}{', '.join(mean_cols + sd_cols)} FROM {base} {grp_by})""")
    cur = f"{prefix}_c"
    if intercept:
        proj = ", ".join([f"{u[i]} - m{i} AS {u[i]}" for i in range(k)] + ["uy - my AS uy"])
    else:
        proj = ", ".join([f"{u[i]}" for i in range(k)] + ["uy"])
    ctes.append(f"""{cur} AS (
  SELECT {gsel_c}{carry_sel}__t, __y, {proj} FROM {base} JOIN {prefix}_m {using})""")
    ctes.append(f"""{prefix}_n AS (
  SELECT {gsel_c}{', '.join(f'sum({u[i]} * {u[i]}) FILTER (WHERE __t) AS n{i}' for i in range(k)) or '1 AS n_'}
  FROM {cur} {grp_by})""")
    for j in range(k):
        later = list(range(j + 1, k))
        aggs = [f"sum({u[j]} * {u[j]}) FILTER (WHERE __t) AS ss"]
        aggs += [f"sum({u[j]} * {u[i]}) FILTER (WHERE __t) AS p{i}" for i in later]
        aggs += [f"sum({u[j]} * uy) FILTER (WHERE __t) AS py"]
        ctes.append(f"""{prefix}_a{j} AS (
  SELECT {gsel_c}{', '.join(aggs)} FROM {cur} {grp_by})""")
        ok = f"(a.ss > {tol} * nn.n{j} AND a.ss > 0)"
        coef_cols = [f"CASE WHEN {ok} THEN a.p{i} / a.ss ELSE 0 END AS r{j}_{i}" for i in later]
        coef_cols += [f"CASE WHEN {ok} THEN a.py / a.ss ELSE 0 END AS g{j}"]
        gq = ", ".join(f"a.{c}" for c in g)
        ctes.append(f"""{prefix}_r{j} AS (
  SELECT {gq + ', ' if g else ''}{', '.join(coef_cols)}
  FROM {prefix}_a{j} a JOIN {prefix}_n nn {('USING (' + gsel + ')') if g else 'ON TRUE'})""")
        nxt = f"{prefix}_s{j}"
        proj = []
        for i in range(k):
            proj.append(f"{u[i]} - r{j}_{i} * {u[j]} AS {u[i]}" if i > j else u[i])
        proj.append(f"uy - g{j} * {u[j]} AS uy")
        ctes.append(f"""{nxt} AS (
  SELECT {gsel_c}{carry_sel}__t, __y, {', '.join(proj)} FROM {cur} JOIN {prefix}_r{j} {using})""")
        cur = nxt
    scored = f"{prefix}_scored"
    ctes.append(f"""{scored} AS (
  SELECT {gsel_c}{carry_sel}__t, __y, __y - uy AS __yhat FROM {cur})""")
    # back-substitution b_j = g_j - sum_{i>j} r_j_i b_i
    b = [""] * k
    for j in reversed(range(k)):
        terms = [f"g{j}"] + [f"- r{j}_{i} * ({b[i]})" for i in range(j + 1, k)]
        b[j] = " ".join(terms)
    joins = " ".join(f"JOIN {prefix}_r{j} {using}" for j in range(k))
    b0 = "my - (" + " + ".join(f"({b[i]}) * m{i}" for i in range(k)) + ")" if (intercept and k) else ("my" if intercept else "0.0")
    cols = [f"{b0} AS b0"] + [f"{b[i]} AS b{i + 1}" for i in range(k)]
    cols += [f"({b[i]}) * (CASE WHEN sd{i} > 0 THEN sd{i} ELSE 1 END) AS s{i + 1}" for i in range(k)]
    coef = f"{prefix}_coef"
    ctes.append(f"""{coef} AS (
  SELECT {gsel_c}{', '.join(cols)} FROM {prefix}_m {joins})""")
    return ctes, scored, coef


def metric_select(y: str, yhat: str, rounded: bool = True) -> list[str]:
    """SQL aggregates matching ``operators.metrics`` (n, mae, mse, rmse, nrmse, r2)."""
    r = globals()["r"] if rounded else (lambda x: x)
    e = f"({y} - {yhat})"
    n = "count(*)"
    sst = f"(var_pop({y}) * count(*))"
    sse = f"sum({e} * {e})"
    return [
        f"CAST({n} AS BIGINT) AS n",
        f"{r(f'avg(abs({e}))')} AS mae",
        f"{r(f'avg({e} * {e})')} AS mse",
        f"{r(f'sqrt(avg({e} * {e}))')} AS rmse",
        f"{r(f'CASE WHEN max({y}) - min({y}) > 0 THEN sqrt(avg({e} * {e})) / (max({y}) - min({y})) END')} AS nrmse",
        f"{r(f'CASE WHEN {n} < 2 THEN NULL WHEN {sst} > 0 THEN 1 - {sse} / {sst} WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END')} AS r2",
    ]


DUCK_TO_SPARK_TYPE = """CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
 WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({t}) END"""


def profile_sql(ctes: str, src: str, cols: Sequence[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        t = DUCK_TO_SPARK_TYPE.format(t=f"typeof(first({c}))")   # the column type, even without rows
        parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, {t} AS dtype, "
                     f"count({c}) AS non_null, count(*) AS n_rows FROM {src}")
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(parts)
