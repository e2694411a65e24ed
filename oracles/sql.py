"""DuckDB SQL for the registered queries.

Written step by step as the feature sets are defined, one grouping per window and
chained joins, and so independent of how the Spark side computes them.
"""

from __future__ import annotations

TRAIN, TARGET, THRESHOLD = "2001-06", "2001-07", 200000
MEASURES = ["quantity", "price", "total"]
FULL = ["mean", "max", "min", "sum", "count", "std", "skew"]
SHORT = ["mean", "sum", "count", "skew"]
SEASON = ["mean", "count", "sum", "skew"]
# Digits of the statistics whose last ones depend on the order of addition.
ROUNDED = {"std": 2, "skew": 4}
ORD = "order_date, order_id, line_no, product_id, supplier_id, quantity, line_gross"

LOG = """log AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
    o_orderdate AS order_date, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
    o_custkey AS customer_id,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2))
      * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS total,
    l_linenumber AS line_no, l_suppkey AS supplier_id, l_extendedprice AS line_gross,
    strftime(o_orderdate, '%Y-%m') AS ym
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""


def shift(ym: str, n: int) -> str:
    i = int(ym[:4]) * 12 + int(ym[5:]) - 1 + n
    return f"{i // 12:04d}-{i % 12 + 1:02d}"


def before(ym: str) -> str:
    return f"order_date < TIMESTAMP '{ym}-01 00:00:00'"


def stat(c: str, s: str, digits: dict[str, int] = ROUNDED) -> str:
    """One statistic of column ``c``; its group mean is in ``mu_<c>``."""
    x = f"CAST({c} AS DOUBLE)"
    if s in digits:
        return f"ROUND({stat(c, s, {})}, {digits[s]})"
    if s == "mean":
        return f"CAST(SUM({c}) AS DOUBLE) / NULLIF(COUNT({c}), 0)"
    if s == "max":
        return f"MAX({x})"
    if s == "min":
        return f"MIN({x})"
    if s == "sum":
        return f"COALESCE(CAST(SUM({c}) AS DOUBLE), 0.0::DOUBLE)"
    if s == "count":
        return f"CAST(COUNT({c}) AS DOUBLE)"
    if s == "std":
        return f"STDDEV_SAMP({x})"
    if s == "skew":
        n = f"CAST(COUNT({c}) AS DOUBLE)"
        d = f"({x} - mu_{c})"
        return (
            f"CASE WHEN COUNT({c}) < 3 THEN NULL WHEN MAX({c}) = MIN({c}) THEN 0.0 "
            f"ELSE SQRT({n} * ({n} - 1)) / ({n} - 2) * (SUM({d} * {d} * {d}) / {n}) "
            f"/ POWER(SUM({d} * {d}) / {n}, 1.5) END"
        )
    raise ValueError(s)


def grouped(source: str, columns: list[str], stats: list[str], where: str = "TRUE",
            suffix: str = "", extra: str = "", digits: dict[str, int] = ROUNDED) -> str:
    means = ", ".join(
        f"AVG(CAST({c} AS DOUBLE)) OVER (PARTITION BY customer_id) AS mu_{c}" for c in columns
    )
    aggs = ", ".join(f'{stat(c, s, digits)} AS "{c}-{s}{suffix}"' for c in columns for s in stats)
    return (
        f"SELECT customer_id, {aggs}{extra} FROM "
        f"(SELECT *, {means} FROM {source} WHERE {where}) GROUP BY customer_id"
    )


def label(ym: str, source: str = "log") -> str:
    return (
        f"SELECT c.customer_id, '{ym}' AS year_month, "
        f"CAST(COALESCE(m.total, 0) AS DOUBLE) AS total, "
        f"CAST(COALESCE(m.total, 0) > {THRESHOLD} AS INT) AS label "
        f"FROM (SELECT DISTINCT customer_id FROM {source} WHERE ym < '{ym}') c "
        f"LEFT JOIN (SELECT customer_id, SUM(total) AS total FROM {source} WHERE ym = '{ym}' "
        f"GROUP BY customer_id) m USING (customer_id)"
    )


def q(names: list[str], table: str = "") -> str:
    dot = f"{table}." if table else ""
    return ", ".join(f'{dot}"{n}"' for n in names)


def both(feature_sql, names: list[str], ctes: str = "") -> str:
    """Label rows of train and target month, left joined with their features."""
    parts = [
        f"SELECT l.customer_id, l.year_month, l.label, {q(names, 'f')} "
        f"FROM ({label(ym)}) l LEFT JOIN ({feature_sql(ym)}) f USING (customer_id)"
        for ym in (TRAIN, TARGET)
    ]
    return f"WITH {LOG}{ctes} " + " UNION ALL ".join(parts)


def names_of(columns, stats, suffixes=("",)):
    return [f"{c}-{s}{x}" for x in suffixes for c in columns for s in stats]


def base() -> str:
    return both(
        lambda ym: grouped("log", MEASURES, FULL, before(ym)), names_of(MEASURES, FULL)
    )


KEY_NAME = {"customer_id": "cust_id", "product_id": "prod_id", "order_id": "order_id"}
CUMSUMS = [
    f"cumsum_{m}_by_{KEY_NAME[k]}"
    for k in ("customer_id", "product_id", "order_id")
    for m in ("total", "quantity", "price")
]
DIFFS = ["order_ts_diff", "quantity_diff", "price_diff", "total_diff"]


def running_columns(keys=("customer_id", "product_id", "order_id")) -> str:
    return ", ".join(
        f"SUM({m}) OVER (PARTITION BY {k} ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) "
        f"AS cumsum_{m}_by_{KEY_NAME[k]}"
        for k in keys
        for m in ("total", "quantity", "price")
    )


def diff_columns() -> str:
    w = f"OVER (PARTITION BY customer_id ORDER BY {ORD})"
    ts = "CAST(epoch(order_date) AS DOUBLE)"
    parts = [f"{ts} AS order_ts", f"{ts} - LAG({ts}) {w} AS order_ts_diff"]
    parts += [f"{m} - LAG({m}) {w} AS {m}_diff" for m in MEASURES]
    return ", ".join(parts)


def lines_until(ym: str, columns: str) -> str:
    return f"(SELECT *, {columns} FROM log WHERE {before(ym)})"


def cumsum() -> str:
    return both(
        lambda ym: grouped(lines_until(ym, running_columns()), CUMSUMS, FULL),
        names_of(CUMSUMS, FULL),
    )


FIRST_LAST = (
    ', CAST(arg_min(order_ts, order_date) AS DOUBLE) AS "order_ts-first"'
    ', CAST(arg_max(order_ts, order_date) AS DOUBLE) AS "order_ts-last"'
)


def diff() -> str:
    return both(
        lambda ym: grouped(lines_until(ym, diff_columns()), DIFFS, FULL, extra=FIRST_LAST),
        ["order_ts-first", "order_ts-last", *names_of(DIFFS, FULL)],
    )


def nunique() -> str:
    return both(
        lambda ym: (
            'SELECT customer_id, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS "order_id-nunique", '
            'CAST(COUNT(DISTINCT product_id) AS DOUBLE) AS "product_id-nunique" '
            f"FROM log WHERE {before(ym)} GROUP BY customer_id"
        ),
        ["order_id-nunique", "product_id-nunique"],
    )


def top_value(expr: str, name: str, ym: str) -> str:
    return (
        f'SELECT customer_id, v AS "{name}" FROM (SELECT customer_id, {expr} AS v, '
        f"ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, {expr}) AS rn "
        f"FROM log WHERE {before(ym)} GROUP BY customer_id, {expr}) WHERE rn = 1"
    )


def mode_features_of(ym: str) -> str:
    month = top_value("CAST(month(order_date) AS DOUBLE)", "month-mode", ym)
    year_month = top_value("ym", "year_month-mode", ym)
    return f"SELECT * FROM ({month}) JOIN ({year_month}) USING (customer_id)"


def mode() -> str:
    return both(mode_features_of, ["month-mode", "year_month-mode"])


# Fixed values, as in the feature sets.
TREND = [1, 2, 3, 5, 7, 12, 20, 23]
TREND_NAMES = names_of(MEASURES, FULL, [f"-{i}" for i in range(8)])
# Fixed values, as in the feature sets.
BANDS = [1, 6, 12, 18]
SEASON_NAMES = names_of(MEASURES, SEASON, [f"-season{i}" for i in range(4)])


def chain(blocks: list[str]) -> str:
    """Right joins in turn, each block's keys replacing those before it."""
    out = f"({blocks[0]})"
    for block in blocks[1:]:
        out = f"(SELECT * FROM {out} a RIGHT JOIN ({block}) b USING (customer_id))"
    return f"SELECT * FROM {out}"


def trend_of(ym: str) -> str:
    return chain(
        [
            grouped("log", MEASURES, FULL, f"{before(ym)} AND ym >= '{shift(ym, -b)}'", f"-{i}")
            for i, b in enumerate(TREND)
        ]
    )


def season_blocks(ym: str, digits: dict[str, int] = ROUNDED) -> list[str]:
    return [
        grouped(
            "log", MEASURES, SEASON,
            f"{before(ym)} AND ym >= '{shift(ym, -b - 2)}' AND ym <= '{shift(ym, -b)}'",
            f"-season{i}",
            digits=digits,
        )
        for i, b in enumerate(BANDS)
    ]


def season_of(ym: str) -> str:
    return chain(season_blocks(ym))


def windows(sql_of, names: list[str]) -> str:
    parts = [
        f"SELECT customer_id, '{ym}' AS year_month, {q(names)} FROM ({sql_of(ym)})"
        for ym in (TRAIN, TARGET)
    ]
    return f"WITH {LOG} " + " UNION ALL ".join(parts)


def trend() -> str:
    return windows(trend_of, TREND_NAMES)


def season() -> str:
    return windows(season_of, SEASON_NAMES)


def season_independent() -> str:
    def of(ym: str) -> str:
        out = f"({season_blocks(ym)[0]})"
        for block in season_blocks(ym)[1:]:
            out = f"(SELECT * FROM {out} a FULL JOIN ({block}) b USING (customer_id))"
        return f"SELECT * FROM {out}"

    return windows(of, SEASON_NAMES)


def tenure(ts: str, until: str) -> str:
    d = f"TIMESTAMP '{until}-01 00:00:00'"
    return (
        f"((year({d}) * 12 + month({d})) - (year({ts}) * 12 + month({ts})) "
        f"- CAST({ts} > date_trunc('month', {ts}) AS INT))"
    )


def mean_spend_of(where: str) -> str:
    return (
        f"SELECT customer_id, CAST(SUM(total) AS DOUBLE) / ({tenure('MIN(order_date)', TARGET)} + 1) "
        f"AS mean FROM log WHERE {where} GROUP BY customer_id"
    )


OWN = ["mean-mean", "mean-sum", "mean-count", "mean-skew"]
FULL_NAMES = [
    "order_ts-first", "order_ts-last", *names_of([*DIFFS, *CUMSUMS], SHORT), *OWN,
    *TREND_NAMES, *SEASON_NAMES,
]


def full() -> str:
    columns = [*DIFFS, *CUMSUMS]

    def of(ym: str) -> str:
        lines = lines_until(ym, f"{diff_columns()}, {running_columns()}")
        rows = grouped(lines, columns, SHORT, extra=FIRST_LAST)
        spend = (
            f'SELECT customer_id, mean AS "mean-mean", mean * n AS "mean-sum", '
            f'CAST(n AS DOUBLE) AS "mean-count", CASE WHEN n >= 3 THEN 0.0 END::DOUBLE AS "mean-skew" '
            f"FROM ({mean_spend_of(before(ym))}) JOIN (SELECT customer_id, COUNT(*) AS n FROM log "
            f"WHERE {before(ym)} GROUP BY customer_id) USING (customer_id)"
        )
        return (
            f"SELECT * FROM ({rows}) JOIN ({spend}) USING (customer_id) "
            f"LEFT JOIN ({trend_of(ym)}) USING (customer_id) "
            f"LEFT JOIN ({season_of(ym)}) USING (customer_id)"
        )

    return both(of, FULL_NAMES)


LINE_KEYS = "order_id, line_no, product_id, supplier_id"


def running_lines(key: str) -> str:
    names = [f"cumsum_{m}_by_{KEY_NAME[key]}" for m in ("total", "quantity", "price")]
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    return (
        f"WITH {LOG} SELECT {LINE_KEYS}, {casts} "
        f"FROM (SELECT *, {running_columns((key,))} FROM log)"
    )


def order_diff() -> str:
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in DIFFS)
    return f"WITH {LOG} SELECT {LINE_KEYS}, {casts} FROM (SELECT *, {diff_columns()} FROM log)"


def running_blocks() -> str:
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in [*CUMSUMS, *DIFFS])
    return f"WITH {LOG} SELECT {LINE_KEYS}, {casts} FROM (SELECT *, {running_columns()}, {diff_columns()} FROM log)"


def generated_columns() -> str:
    names = [*CUMSUMS, *DIFFS]
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    keys = ", ".join(f"x.{k}" for k in LINE_KEYS.split(", "))
    return (
        f"WITH {LOG} SELECT {keys}, CAST(month(x.order_date) AS INT) AS month, x.ym AS year_month, "
        f"{casts}, m.mean FROM {lines_until(TARGET, f'{diff_columns()}, {running_columns()}')} x "
        f"LEFT JOIN ({mean_spend_of(before(TARGET))}) m USING (customer_id)"
    )


# Month calendar of the data, and the sums of every customer in every month of it.
DENSE = f"""WITH {LOG},
  span AS (SELECT MIN(order_date) AS a, MAX(order_date) AS b FROM log),
  calendar AS (SELECT DISTINCT strftime(d, '%Y-%m') AS period FROM
    (SELECT UNNEST(generate_series(CAST(a AS DATE)::TIMESTAMP, CAST(b AS DATE)::TIMESTAMP,
      INTERVAL 1 DAY)) AS d FROM span)),
  frame AS (SELECT customer_id, period FROM (SELECT DISTINCT customer_id FROM log), calendar),
  sums AS (SELECT customer_id, ym AS period, SUM(quantity) AS quantity, SUM(price) AS price,
    SUM(total) AS total FROM log GROUP BY customer_id, ym),
  dense AS (SELECT customer_id, period, CAST(COALESCE(quantity, 0) AS DOUBLE) AS quantity,
    CAST(COALESCE(price, 0) AS DOUBLE) AS price, CAST(COALESCE(total, 0) AS DOUBLE) AS total
    FROM frame LEFT JOIN sums USING (customer_id, period))"""

FIRST5 = "(SELECT DISTINCT customer_id FROM log ORDER BY customer_id LIMIT 5)"

# A score with ties, made of a customer's history, next to the label.
SCORED = f"""WITH {LOG},
  lab AS ({label(TARGET)}),
  hist AS (SELECT customer_id, CAST(SUM(total) AS DOUBLE) AS t, CAST(SUM(quantity) AS DOUBLE) AS n
    FROM log WHERE {before(TARGET)} GROUP BY customer_id),
  folded AS (SELECT customer_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label
    ORDER BY md5('0|' || CAST(customer_id AS VARCHAR)), customer_id) - 1) % 10 AS INT) AS fold
    FROM lab),
  scored AS (SELECT customer_id, label, fold,
    FLOOR(t / (SELECT MAX(t) FROM hist) * 100) / 100 AS probability,
    FLOOR(n / (SELECT MAX(n) FROM hist) * 100) / 100 AS second
    FROM folded JOIN hist USING (customer_id))"""


def auc(by: str = "", digits: int | None = 8) -> str:
    value = (
        "(SUM(CASE WHEN label = 1 THEN r END) - SUM(label) * (SUM(label) + 1) / 2.0) "
        "/ (SUM(label) * SUM(1 - label))"
    )
    value = value if digits is None else f"ROUND({value}, {digits})"
    part = f"PARTITION BY {by}" if by else ""
    pre = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {pre}CAST(SUM(label) AS BIGINT) AS positives, "
        f"CAST(SUM(1 - label) AS BIGINT) AS negatives, "
        f"{value} AS auc "
        f"FROM (SELECT *, RANK() OVER ({part} ORDER BY probability) "
        f"+ (COUNT(*) OVER (PARTITION BY {pre}probability) - 1) / 2.0 AS r FROM scored) {group}"
    )


def high_corr(threshold: float = 0.9) -> str:
    names = names_of(MEASURES, FULL)
    pairs = []
    for j, b in enumerate(names):
        for i, a in enumerate(names[:j]):
            pairs.append(
                f"SELECT '{b}' AS \"column\", {j} AS position, corr(\"{a}\", \"{b}\") AS r FROM f"
            )
    features = grouped("log", MEASURES, FULL, before(TARGET))
    return (
        f"WITH {LOG}, f AS ({features}), r AS ({' UNION ALL '.join(pairs)}) "
        f'SELECT "column", CAST(position AS INT) AS position, COUNT(*) AS partners FROM r '
        f"WHERE NOT isnan(r) AND ABS(r) > {threshold} GROUP BY \"column\", position"
    )


def correlations_full() -> str:
    """Correlation of all pairs of columns of the full set, on the rows where both are set."""
    return f"""
WITH f AS (SELECT * FROM ({full()}) WHERE year_month = '{TARGET}'),
long AS (UNPIVOT f ON COLUMNS(* EXCLUDE (customer_id, year_month, label)) INTO NAME feature VALUE v),
n AS (SELECT unnest({FULL_NAMES}) AS feature, unnest(range({len(FULL_NAMES)})) AS i),
x AS (SELECT customer_id, feature, i, CAST(v AS DOUBLE) AS v FROM long JOIN n USING (feature))
SELECT a.feature AS first, b.feature AS second, ROUND(corr(a.v, b.v), 6) AS r
FROM x a JOIN x b ON a.customer_id = b.customer_id AND a.i < b.i GROUP BY ALL
HAVING count(DISTINCT a.v) > 1 AND count(DISTINCT b.v) > 1 AND isfinite(corr(a.v, b.v))
"""


def approx_nunique() -> str:
    """Exact distinct counts; every approximate one is to lie within 3 % of them."""
    windows = [("", "TRUE"), ("-6", "ym >= '{low}'")]
    parts = []
    for ym in (TRAIN, TARGET):
        cells = ", ".join(
            f"CAST(COUNT(DISTINCT CASE WHEN {c.format(low=shift(ym, -6))} THEN {column} END) AS DOUBLE) "
            f'AS "{column}-nunique{suffix}", TRUE AS "{column}-close{suffix}"'
            for suffix, c in windows for column in ("order_id", "product_id")
        )
        parts.append(f"SELECT customer_id, '{ym}' AS year_month, {cells} FROM log WHERE {before(ym)} GROUP BY customer_id")
    return f"WITH {LOG} " + " UNION ALL ".join(parts)


def associations(categories: list[str], numbers: list[str]) -> str:
    ratio, uncertain = [], []
    for c in categories:
        for x in numbers:
            ratio.append(
                f"SELECT '{c}' AS first, '{x}' AS second, 'correlation ratio' AS kind, "
                f"sqrt(SUM(n * (m - t) * (m - t)) / ANY_VALUE(ss)) AS strength FROM (SELECT COUNT({x}) AS n, "
                f"AVG(CAST({x} AS DOUBLE)) AS m FROM wide GROUP BY {c}), (SELECT AVG(CAST({x} AS DOUBLE)) AS t, "
                f"VAR_POP(CAST({x} AS DOUBLE)) * COUNT({x}) AS ss FROM wide)"
            )
        for d in categories:
            if d != c:
                uncertain.append(
                    f"SELECT '{c}' AS first, '{d}' AS second, 'uncertainty' AS kind, 1 - (SELECT "
                    f"SUM(n / t * -LN(n / g)) FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(COUNT(*)) OVER "
                    f"(PARTITION BY {d}) AS DOUBLE) AS g, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS t FROM wide "
                    f"GROUP BY {c}, {d})) / (SELECT SUM(n / t * -LN(n / t)) FROM (SELECT CAST(COUNT(*) AS DOUBLE) "
                    f"AS n, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS t FROM wide GROUP BY {c})) AS strength"
                )
    return (
        "SELECT first, second, kind, ROUND(strength, 6) AS strength FROM ("
        + " UNION ALL ".join(ratio + uncertain) + ")"
    )


def median_impute() -> str:
    frame = both(lambda ym: chain(season_blocks(ym, {})), SEASON_NAMES)

    def fill(n: str) -> str:
        return (
            f'COALESCE("{n}", (SELECT COALESCE(MEDIAN("{n}"), 0) FROM f '
            f"WHERE year_month = '{TRAIN}'))"
        )

    filled = ", ".join(
        (f'ROUND({fill(n)}, 4)' if "-skew" in n else fill(n)) + f' AS "{n}"' for n in SEASON_NAMES
    )
    head, tail = frame.split(" SELECT l.customer_id", 1)
    return (
        f"{head}, f AS (SELECT l.customer_id{tail}) "
        f"SELECT customer_id, year_month, label, {filled} FROM f"
    )


def label_encode() -> str:
    frame = mode()
    head, tail = frame.split(" SELECT l.customer_id", 1)
    return (
        f"{head}, f AS (SELECT l.customer_id{tail}), "
        'codes AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS DOUBLE) AS code '
        'FROM (SELECT DISTINCT "year_month-mode" AS v FROM f)) '
        'SELECT customer_id, year_month, label, "month-mode", code AS "year_month-mode" '
        'FROM f JOIN codes ON "year_month-mode" = v'
    )


def multi_month() -> str:
    parts = [
        f"SELECT l.customer_id, l.year_month, l.label, {q(names_of(MEASURES, FULL), 'f')} "
        f"FROM ({label(ym)}) l LEFT JOIN ({grouped('log', MEASURES, FULL, before(ym))}) f "
        f"USING (customer_id)"
        for ym in ("2001-03", "2001-05", "2001-06")
    ]
    return f"WITH {LOG} " + " UNION ALL ".join(parts)


def profile(columns: list[str], numeric: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({c} AS DOUBLE)"
        numbers = [
            ("mean", f"ROUND(AVG({x}), 4)"),
            ("std", f"ROUND(STDDEV_SAMP({x}), 2)"),
            ("min", f"MIN({x})"),
            ("max", f"MAX({x})"),
            ("p25", f"ROUND(quantile_cont({x}, 0.25), 6)"),
            ("p50", f"ROUND(quantile_cont({x}, 0.5), 6)"),
            ("p75", f"ROUND(quantile_cont({x}, 0.75), 6)"),
        ]
        stats = ", ".join(
            f"{sql if c in numeric else 'CAST(NULL AS DOUBLE)'} AS {name}" for name, sql in numbers
        )
        top = (
            f"SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM log WHERE {c} IS NOT NULL "
            f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT({c}) AS \"count\", "
            f"COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS \"unique\", "
            f"(SELECT v FROM ({top})) AS top, (SELECT n FROM ({top})) AS freq, {stats} FROM log"
        )
    return f"WITH {LOG} " + " UNION ALL ".join(parts)


def dense_events() -> str:
    """Monthly sums of the events of every user, from the first to the last day."""
    return """WITH span AS (SELECT MIN(ts) AS a, MAX(ts) AS b FROM events WHERE user_id IS NOT NULL),
      calendar AS (SELECT DISTINCT strftime(d, '%Y-%m') AS period FROM (SELECT UNNEST(
        generate_series(CAST(a AS DATE)::TIMESTAMP, CAST(b AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d
        FROM span)),
      sums AS (SELECT user_id, strftime(ts, '%Y-%m') AS period, SUM(CAST(value AS DECIMAL(18,4))) AS total
        FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
      frame AS (SELECT user_id, period FROM (SELECT DISTINCT user_id FROM sums), calendar)
      SELECT user_id AS customer_id, period, CAST(COALESCE(total, 0) AS DOUBLE) AS total
      FROM frame LEFT JOIN sums USING (user_id, period)"""


def naive_bayes(folds: int = 10) -> str:
    """Out-of-fold probabilities of a Gaussian naive Bayes on the two distinct counts."""
    def term(c: str) -> str:
        return f"ln(2 * pi() * v{c}) + ({c} - m{c}) * ({c} - m{c}) / v{c}"

    return f"""WITH t AS (SELECT customer_id, label, "order_id-nunique" AS a, "product_id-nunique" AS b
        FROM ({nunique()}) WHERE year_month = '{TRAIN}'),
      f AS (SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY label
        ORDER BY md5('0|' || CAST(customer_id AS VARCHAR)), customer_id) - 1) % {folds} AS INT) AS fold FROM t),
      k AS (SELECT CAST(UNNEST(range({folds})) AS INT) AS k),
      e AS (SELECT k, COUNT(*) AS n, 1e-9 * GREATEST(VAR_SAMP(a), VAR_SAMP(b)) AS eps
        FROM f JOIN k ON fold <> k GROUP BY k),
      s AS (SELECT k, f.label, COUNT(*) AS c, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS pa,
        VAR_POP(b) AS pb FROM f JOIN k ON fold <> k GROUP BY k, f.label),
      p AS (SELECT k, label, ln(c / n) AS prior, ma, mb, pa + eps AS va, pb + eps AS vb
        FROM s JOIN e USING (k)),
      l AS (SELECT customer_id, f.label, fold, p.label AS c,
        prior - 0.5::DOUBLE * ({term('a')} + {term('b')}) AS l FROM f JOIN p ON fold = k)
      SELECT customer_id, label, fold, ROUND(1 / (1 + exp(MAX(l) FILTER (WHERE c = 0)
        - MAX(l) FILTER (WHERE c = 1))), 6) AS probability FROM l GROUP BY customer_id, label, fold"""


# Trials, trees and folds of each rung of a search of fifty.
RUNGS = [(50, 2, 1), (25, 4, 1), (13, 8, 2), (7, 16, 2), (4, 20, 3), (2, 20, 10)]


def _bayes_scores() -> str:
    """``scores``: mean probability of the ten folds' models, for the target month's customers."""
    whole = naive_bayes()
    head = whole[: whole.index("l AS (SELECT")].rstrip().rstrip(",")

    def term(c: str) -> str:
        return f"ln(2 * pi() * v{c}) + ({c} - m{c}) * ({c} - m{c}) / v{c}"

    return f"""{head}, u AS (SELECT customer_id, "order_id-nunique" AS a, "product_id-nunique" AS b
        FROM ({nunique()}) WHERE year_month = '{TARGET}'),
      l AS (SELECT customer_id, k, label AS c, prior - 0.5::DOUBLE * ({term('a')} + {term('b')}) AS l FROM u, p),
      each AS (SELECT customer_id, k, 1 / (1 + exp(MAX(l) FILTER (WHERE c = 0) - MAX(l) FILTER (WHERE c = 1)))
        AS probability FROM l GROUP BY customer_id, k),
      scores AS (SELECT customer_id, AVG(probability) AS probability FROM each GROUP BY customer_id)"""


def score_naive_bayes() -> str:
    return f"{_bayes_scores()} SELECT customer_id, ROUND(probability, 6) AS probability FROM scores"


def backtest_naive_bayes() -> str:
    """AUC by ranks, and precision, recall and F1 above one half."""
    return f"""{_bayes_scores()}, {LOG}, y AS (SELECT customer_id, label FROM ({label(TARGET)})),
      m AS (SELECT label, round(probability, 12) AS s, probability FROM y JOIN scores USING (customer_id)),
      r AS (SELECT *, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM m),
      c AS (SELECT CAST(COUNT(*) FILTER (WHERE label = 1 AND probability > 0.5) AS DOUBLE) AS tp,
        CAST(COUNT(*) FILTER (WHERE label = 0 AND probability > 0.5) AS DOUBLE) AS fp,
        CAST(COUNT(*) FILTER (WHERE label = 1 AND probability <= 0.5) AS DOUBLE) AS fn,
        CAST(COUNT(*) FILTER (WHERE label = 1) AS DOUBLE) AS p, CAST(COUNT(*) FILTER (WHERE label = 0) AS DOUBLE) AS n,
        SUM(r) FILTER (WHERE label = 1) AS ranks FROM r)
      SELECT ROUND((ranks - p * (p + 1) / 2) / (p * n), 6) AS auc, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6)
        AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall,
        ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1, 0::BIGINT AS unscored FROM c"""


def train_rows() -> str:
    """Rows of the train month in the base set, without encoding or imputation, with folds."""
    return f"""t AS (SELECT * FROM ({base()}) WHERE year_month = '{TRAIN}'),
      f AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY label
        ORDER BY md5('0|' || CAST(customer_id AS VARCHAR)), customer_id) - 1) % 10 AS fold FROM t)"""


def univariate_f() -> str:
    parts = [
        f"""SELECT '{n}' AS feature, (SUM(n * (m - t) * (m - t)) / (COUNT(*) - 1)) / (SUM(n * v) / (SUM(n) - COUNT(*))) AS f
        FROM (SELECT CAST(COUNT("{n}") AS DOUBLE) AS n, AVG("{n}") AS m, VAR_POP("{n}") AS v FROM f GROUP BY label),
        (SELECT AVG("{n}") AS t FROM f)"""
        for n in names_of(MEASURES, FULL)
    ]
    return f"WITH {train_rows()} SELECT feature, ROUND(f, 4) AS f FROM ({' UNION ALL '.join(parts)})"


def select_subset(steps: int) -> str:
    """Forward selection, a step after the other, from the terms of all rows and features."""
    names = names_of(MEASURES, FULL)
    parts = [f"""SELECT {i} AS i, customer_id, label, fold, "{n}" AS x FROM f""" for i, n in enumerate(names)]

    def distance(c: int) -> str:
        return f"ln(v{c}) + (x - m{c}) * (x - m{c}) / v{c}"

    steps_sql = ["b0 AS (SELECT DISTINCT customer_id, label, prior AS base FROM l), s0 AS (SELECT -1 AS i, -1::BIGINT AS score)"]
    for k in range(steps):
        taken = " AND ".join([f"i NOT IN (SELECT i FROM s{j})" for j in range(1, k + 1)]) or "TRUE"
        steps_sql.append(
            f"""c{k + 1} AS (SELECT i, SUM(CASE WHEN b.label = 1 AND base + term > 0 THEN zero
                WHEN b.label = 0 AND NOT base + term > 0 THEN one ELSE 0 END)::BIGINT AS score
                FROM l JOIN b{k} b USING (customer_id), sizes WHERE {taken} GROUP BY i),
            s{k + 1} AS MATERIALIZED (SELECT i, score FROM c{k + 1} WHERE score > (SELECT max(score) FROM s{k})
                AND (SELECT count(*) FROM s{k}) > 0 ORDER BY score DESC, i LIMIT 1),
            b{k + 1} AS MATERIALIZED (SELECT b.customer_id, b.label, base + coalesce(term, 0) AS base FROM b{k} b
                LEFT JOIN (SELECT * FROM l WHERE i IN (SELECT i FROM s{k + 1})) USING (customer_id))"""
        )
    listed = ", ".join(f"'{n}'" for n in names)
    out = " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS step, [{listed}][i + 1] AS feature, ROUND(score / (2.0::DOUBLE * zero * one), 8) "
        f"AS balanced_accuracy FROM s{k}, sizes" for k in range(1, steps + 1)
    )
    return f"""WITH {train_rows()}, x AS MATERIALIZED ({' UNION ALL '.join(parts)}),
      k AS (SELECT UNNEST(range(10)) AS k),
      sizes AS (SELECT count(*) FILTER (WHERE label = 0) AS zero, count(*) FILTER (WHERE label = 1) AS one FROM f),
      p AS (SELECT k, ln(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0)) AS prior
        FROM f JOIN k ON fold <> k GROUP BY k),
      m AS (SELECT k, i, AVG(x) FILTER (WHERE label = 0) AS m0, AVG(x) FILTER (WHERE label = 1) AS m1,
        GREATEST(VAR_POP(x) FILTER (WHERE label = 0), 1e-9) AS v0,
        GREATEST(VAR_POP(x) FILTER (WHERE label = 1), 1e-9) AS v1 FROM x JOIN k ON fold <> k GROUP BY k, i),
      l AS MATERIALIZED (SELECT customer_id, label, x.i, prior, coalesce((({distance(0)}) - ({distance(1)})) / 2, 0) AS term
        FROM x JOIN m ON m.k = fold AND m.i = x.i JOIN p ON p.k = fold),
      {', '.join(steps_sql)} {out}"""
