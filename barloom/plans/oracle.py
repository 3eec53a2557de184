"""The same queries in SQL for DuckDB, built from shared table expressions."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

COLUMNS = ["Open", "High", "Low", "Close", "Volume"]

BARS = """bars AS (
  SELECT o_orderpriority AS Symbol, CAST(o_orderdate AS DATE) AS Date,
         arg_min(o_totalprice, o_orderkey) AS Open, max(o_totalprice) AS High, min(o_totalprice) AS Low,
         arg_max(o_totalprice, o_orderkey) AS Close, CAST(count(*) AS DOUBLE) AS Volume
  FROM orders GROUP BY 1, 2)"""

HOURLY = """hours AS (
  SELECT event_type AS Symbol, date_trunc('hour', ts) AS Date,
         arg_min(value, ts) AS Open, max(value) AS High, min(value) AS Low,
         arg_max(value, ts) AS Close, CAST(count(*) AS DOUBLE) AS Volume
  FROM events GROUP BY 1, 2)"""

WIDE = """wide AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS Symbol, CAST(l_shipdate AS DATE) AS Date,
         arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS Open,
         max(l_extendedprice) AS High, min(l_extendedprice) AS Low,
         arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS Close,
         sum(l_quantity) AS Volume
  FROM lineitem GROUP BY 1, 2)"""

DIRTY = f"""{BARS},
placed AS (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS k FROM bars),
spoiled AS (
  SELECT Symbol, Date, Open, High, Low,
         CASE WHEN k % 17 = 0 THEN NULL WHEN k % 101 = 0 THEN Close * 10 ELSE Close END AS Close,
         CASE WHEN k % 23 = 0 OR k <= 2 THEN NULL ELSE Volume END AS Volume, k
  FROM placed),
dirty AS (
  SELECT Symbol, Date, Open, High, Low, Close, Volume, 2 * k AS _row FROM spoiled
  UNION ALL
  SELECT Symbol, Date, Open, High, Low, Close + 1, Volume, 2 * k + 1 FROM spoiled WHERE k % 50 = 0)"""

DEDUPED = f"""{DIRTY},
deduped AS (
  SELECT Symbol, Date, Open, High, Low, Close, Volume
  FROM dirty QUALIFY row_number() OVER (PARTITION BY Symbol, Date ORDER BY _row) = 1)"""

TICKS = """ticks AS (
  SELECT event_type AS Symbol, ts AS Date, CASE WHEN event_id % 13 <> 0 THEN value END AS Close
  FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1)"""

SCORED = f"""{BARS},
moves AS (SELECT *, Close / nullif(lag(Close) OVER (PARTITION BY Symbol ORDER BY Date), 0) - 1 AS Daily_Return FROM bars),
zs AS (
  SELECT *, abs((Daily_Return - avg(Daily_Return) OVER ()) / stddev_pop(Daily_Return) OVER ()) AS z
  FROM moves WHERE Daily_Return IS NOT NULL),
scored AS (
  SELECT *, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS anomaly_score,
         CAST(z > 2.5 AS INTEGER) AS is_anomaly
  FROM zs)"""

TIME = "strftime(Date, '%Y-%m-%d %H:%M:%S.%f')"
W = "OVER (PARTITION BY Symbol ORDER BY Date)"


def frame(rows: int) -> str:
    return f"OVER (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def full(value: str, counted: str, rows: int) -> str:
    """A window value only where the window holds that many values."""
    return f"CASE WHEN count({counted}) {frame(rows)} = {rows} THEN {value} {frame(rows)} END"


def lag(column: str, rows: int = 1) -> str:
    return f"lag({column}, {rows}) {W}"


def change(column: str) -> str:
    return f"{column} / nullif({lag(column)}, 0) - 1"


def rounded(columns: dict[str, str] | list[str], digits: int = 4) -> str:
    items = columns.items() if isinstance(columns, dict) else [(c, c) for c in columns]
    return ", ".join(f'round({value}, {digits}) + 0.0 AS "{out}"' for out, value in items)


def nudged(columns: list[str] | dict[str, str], digits: int = 4) -> str:
    """Rounded, with what lies exactly between two steps moved to one side."""
    items = columns if isinstance(columns, dict) else {c: c for c in columns}
    return rounded({out: f"({value}) + 0.0000003" for out, value in items.items()}, digits)


def named(columns: dict[str, str]) -> str:
    return ", ".join(f'{value} AS "{out}"' for out, value in columns.items())


SHOWN = f"Symbol, Date, {rounded(COLUMNS)}"

# --- bars ---------------------------------------------------------------------------

ORACLE["bars_daily"] = f"WITH {BARS} SELECT {SHOWN} FROM bars"
ORACLE["bars_hourly"] = f"WITH {HOURLY} SELECT Symbol, {TIME} AS Date, {rounded(COLUMNS)} FROM hours"
ORACLE["bars_wide"] = f"WITH {WIDE} SELECT Symbol, Date, {rounded(COLUMNS, 2)} FROM wide"
REBUCKET = """min(Low) AS Low, max(High) AS High, arg_min(Open, Date) AS Open, arg_max(Close, Date) AS Close,
  sum(Volume) AS Volume"""
ORACLE["bars_weekly_from_daily"] = f"""WITH {BARS}, weeks AS (
  SELECT Symbol, CAST(date_trunc('week', Date) AS DATE) AS Week, {REBUCKET} FROM bars GROUP BY 1, 2)
SELECT Symbol, Week AS Date, {rounded(COLUMNS)} FROM weeks"""
ORACLE["bars_six_hours"] = f"""WITH {HOURLY}, sixes AS (
  SELECT Symbol, time_bucket(INTERVAL 6 HOURS, Date) AS Start, {REBUCKET} FROM hours GROUP BY 1, 2)
SELECT Symbol, {TIME.replace('Date', 'Start')} AS Date, {rounded(COLUMNS)} FROM sixes"""

# --- mapping, coercion, validation --------------------------------------------------

ORACLE["coerce_money_dates"] = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS Date, round(o_totalprice, 2) AS Close
FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 31 <> 0"""
ORACLE["map_columns"] = f"WITH {BARS} SELECT {SHOWN}, round(Close, 4) AS Adj_Close FROM bars"
ORACLE["keyword_columns"] = f"WITH {BARS} SELECT 'ALL' AS Symbol, Date, {rounded(COLUMNS)}, round(Close, 4) AS Adj_Close FROM bars"
ORACLE["validate_report"] = f"""WITH {DIRTY}, checks AS (
  SELECT 'Date' AS "column", 'unparseable_date' AS "check", count(*) FILTER (_row % 40 = 0) AS n_bad FROM dirty
  UNION ALL SELECT 'Close', 'not_numeric', count(*) FILTER (_row % 90 = 0) FROM dirty
  UNION ALL SELECT 'Close', 'has_nulls', count(*) FILTER (_row % 90 <> 0 AND Close IS NULL) FROM dirty
  UNION ALL SELECT 'Low', 'missing_column', -1)
SELECT * FROM checks WHERE n_bad <> 0"""
ORACLE["quality_report"] = f"""WITH {DIRTY}
SELECT count(*) AS n_rows, min(Date) AS first_date, max(Date) AS last_date,
       count(*) FILTER (Close IS NULL) AS missing_close, count(*) FILTER (Volume IS NULL) AS missing_volume,
       count(Close) AS usable_rows
FROM dirty"""

# --- cleaning -----------------------------------------------------------------------

ORACLE["dedupe_first"] = f"WITH {DEDUPED} SELECT {SHOWN} FROM deduped"

UPTO = "OVER (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ONWARD = "OVER (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def before(value: str) -> str:
    return f"last_value({value} IGNORE NULLS) {UPTO}"


def after(value: str) -> str:
    return f"first_value({value} IGNORE NULLS) {ONWARD}"


def forward(c: str) -> str:
    return f"coalesce({before(c)}, {after(c)})"


def backward(c: str) -> str:
    return f"coalesce({after(c)}, {before(c)})"


def line(c: str) -> str:
    at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    return (
        f"coalesce({c}, {before(c)} + ({after(c)} - {before(c)}) * (rn - {before(at)}) "
        f"/ nullif({after(at)} - {before(at)}, 0), {before(c)}, {after(c)})"
    )


ORACLE["fill_ffill"] = f"WITH {DEDUPED} SELECT Symbol, Date, {rounded({c: forward(c) for c in COLUMNS})} FROM deduped"
ORACLE["fill_bfill"] = f"WITH {DEDUPED} SELECT Symbol, Date, {rounded({c: backward(c) for c in COLUMNS})} FROM deduped"
ORACLE["fill_interpolate"] = f"""WITH {DEDUPED}, numbered AS (SELECT *, row_number() {W} AS rn FROM deduped)
SELECT Symbol, Date, {rounded({c: line(c) for c in COLUMNS})} FROM numbered"""
ORACLE["fill_mean"] = f"""WITH {DEDUPED}
SELECT Symbol, Date, {rounded({c: f'coalesce({c}, avg({c}) OVER (PARTITION BY Symbol))' for c in COLUMNS})} FROM deduped"""
ORACLE["auto_clean"] = ORACLE["fill_ffill"]


def quartiles(source: str) -> str:
    parts = ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in COLUMNS
    )
    return f"SELECT Symbol, {parts} FROM {source} GROUP BY Symbol"


def capped(c: str) -> str:
    margin = f"1.5 * (b_{c} - a_{c})"
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, a_{c} - {margin}), b_{c} + {margin}) END"


CAPS = named({c: capped(c) for c in COLUMNS})
ORACLE["iqr_cap"] = f"""WITH {DEDUPED}, quarters AS ({quartiles('deduped')})
SELECT Symbol, Date, {rounded({c: capped(c) for c in COLUMNS})} FROM deduped JOIN quarters USING (Symbol)"""

# --- features -----------------------------------------------------------------------

PRICE = {
    "Daily_Return": change("Close"),
    "Log_Return": f"CASE WHEN Close / nullif({lag('Close')}, 0) > 0 THEN ln(Close / nullif({lag('Close')}, 0)) END",
    **{f"MA{n}": full("avg(Close)", "Close", n) for n in (5, 10, 20)},
    **{f"Price_Momentum_{n}d": f"Close - {lag('Close', n)}" for n in (1, 5)},
    "Price_Gap": f"Open - {lag('Close')}",
    "HL_Range": "High - Low",
    "HL_Range_Pct": "(High - Low) / nullif(Close, 0)",
}
VARIES = f"min(Close) {frame(5)} < max(Close) {frame(5)} AND min(Volume) {frame(5)} < max(Volume) {frame(5)}"
VOLUME = {
    "Volume_Change": change("Volume"),
    **{f"Volume_MA{n}": full("avg(Volume)", "Volume", n) for n in (5, 10)},
    "Volume_Ratio_MA5": f"Volume / nullif({full('avg(Volume)', 'Volume', 5)}, 0)",
    "Price_Volume_Corr": f"""CASE WHEN count(CASE WHEN Close IS NOT NULL AND Volume IS NOT NULL THEN 1 END) {frame(5)} = 5
      AND {VARIES} THEN covar_pop(Close, Volume) {frame(5)}
      / (stddev_pop(Close) {frame(5)} * stddev_pop(Volume) {frame(5)}) END""",
}
VOLATILITY = {
    **{f"Volatility_{n}d": full("stddev_samp(Daily_Return)", "Daily_Return", n) for n in (5, 10)},
    "ATR_5d": full("avg(TR)", "TR", 5),
}
TRUE_RANGE = f"""CASE WHEN {lag('Close')} IS NOT NULL
  THEN greatest(High - Low, abs(High - {lag('Close')}), abs(Low - {lag('Close')})) END"""
DELTA = f"coalesce(Close - {lag('Close')}, 0)"
STRENGTH = f"""CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END"""
GAIN = full("avg(greatest(delta, 0))", "delta", 14)
LOSS = full("avg(greatest(-delta, 0))", "delta", 14)
MIDDLE, DEVIATION = full("avg(Close)", "Close", 20), full("stddev_samp(Close)", "Close", 20)
BANDS = {
    "BB_Middle": "middle",
    "BB_Std": "deviation",
    "BB_Upper": "middle + 2 * deviation",
    "BB_Lower": "middle - 2 * deviation",
    "BB_Width": "4 * deviation / nullif(middle, 0)",
}

ORACLE["price_features"] = f"WITH {BARS} SELECT Symbol, Date, {rounded(PRICE)} FROM bars"
ORACLE["volume_features"] = f"WITH {BARS} SELECT Symbol, Date, {rounded(VOLUME)} FROM bars"
ORACLE["volatility_features"] = f"""WITH {BARS},
ranges AS (SELECT *, {change('Close')} AS Daily_Return, {TRUE_RANGE} AS TR FROM bars)
SELECT Symbol, Date, {rounded({**VOLATILITY, 'TR': 'TR'})} FROM ranges"""
ORACLE["rsi"] = f"""WITH {BARS}, deltas AS (SELECT *, {DELTA} AS delta FROM bars),
sides AS (SELECT *, {GAIN} AS gain, {LOSS} AS loss FROM deltas)
SELECT Symbol, Date, {rounded({'RSI': STRENGTH})} FROM sides"""
BANDED = f"banded AS (SELECT *, {MIDDLE} AS middle, {DEVIATION} AS deviation FROM bars)"
ORACLE["bollinger"] = f"WITH {BARS}, {BANDED} SELECT Symbol, Date, {rounded(BANDS)} FROM banded"
ORACLE["breakouts"] = f"""WITH {BARS}, {BANDED}
SELECT Symbol, Date, {rounded({'Close': 'Close', 'BB_Upper': BANDS['BB_Upper'], 'BB_Lower': BANDS['BB_Lower']})}
FROM banded WHERE Close > middle + 2 * deviation OR Close < middle - 2 * deviation"""


def recursion(source: str) -> str:
    """Exponential averages row by row: 12, 26 and the 9 of their difference."""
    return f"""ordered AS (SELECT Symbol, Date, Close, row_number() {W} AS rn FROM {source}),
averages AS (
  SELECT Symbol, Date, rn, Close AS fast, Close AS slow, CAST(0 AS DOUBLE) AS signal FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.Symbol, o.Date, o.rn,
         2.0 / 13 * o.Close + 11.0 / 13 * a.fast, 2.0 / 27 * o.Close + 25.0 / 27 * a.slow,
         2.0 / 10 * ((2.0 / 13 * o.Close + 11.0 / 13 * a.fast) - (2.0 / 27 * o.Close + 25.0 / 27 * a.slow))
           + 8.0 / 10 * a.signal
  FROM averages a JOIN ordered o ON o.Symbol = a.Symbol AND o.rn = a.rn + 1)"""


MACD = {"MACD": "fast - slow", "MACD_Signal": "signal", "MACD_Hist": "fast - slow - signal"}
ORACLE["ema"] = f"WITH RECURSIVE {BARS}, {recursion('bars')} SELECT Symbol, Date, {rounded({'EMA12': 'fast'})} FROM averages"
ORACLE["macd"] = f"WITH RECURSIVE {BARS}, {recursion('bars')} SELECT Symbol, Date, {rounded(MACD)} FROM averages"


def gap_recursion(source: str) -> str:
    """The averages row by row where closes may be missing: rows since the last value weigh it down."""
    met = lambda y, k, x, n: (
        f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} "
        f"ELSE ({y} * pow({n - 1}.0 / {n + 1}, {k}) + {x} * 2.0 / {n + 1}) / (pow({n - 1}.0 / {n + 1}, {k}) + 2.0 / {n + 1}) END"
    )
    fast, slow = met("a.fast", "a.k", "o.Close", 12), met("a.slow", "a.k", "o.Close", 26)
    return f"""ordered AS (SELECT Symbol, Date, Close, row_number() {W} AS rn FROM {source}),
averages AS (
  SELECT Symbol, Date, rn, 1 AS k, Close AS fast, Close AS slow, CASE WHEN Close IS NOT NULL THEN CAST(0 AS DOUBLE) END AS signal FROM ordered WHERE rn = 1
  UNION ALL
  SELECT Symbol, Date, rn, k, fast, slow, CASE WHEN signal IS NULL THEN fast - slow ELSE 0.2 * (fast - slow) + 0.8 * signal END FROM (
    SELECT o.Symbol, o.Date, o.rn, CASE WHEN o.Close IS NULL THEN a.k + 1 ELSE 1 END AS k, {fast} AS fast, {slow} AS slow, a.signal
    FROM averages a JOIN ordered o ON o.Symbol = a.Symbol AND o.rn = a.rn + 1))"""


ORACLE["macd_gaps"] = f"WITH RECURSIVE {DEDUPED}, {gap_recursion('deduped')} SELECT Symbol, Date, {rounded(MACD)} FROM averages"
ORACLE["date_features"] = f"""WITH {BARS}
SELECT Symbol, Date, CAST(isodow(Date) - 1 AS INTEGER) AS day_of_week, CAST(month(Date) AS INTEGER) AS month,
       CAST(quarter(Date) AS INTEGER) AS quarter
FROM bars"""
EDA = {
    "Returns": f"({change('padded')}) * 100",
    "MA7": full("avg(Close)", "Close", 7),
    "MA30": full("avg(Close)", "Close", 30),
}
ORACLE["eda_returns"] = f"""WITH {DEDUPED}, pads AS (SELECT *, {before('Close')} AS padded FROM deduped)
SELECT Symbol, Date, {rounded(EDA)} FROM pads"""
ORACLE["eval_features"] = f"""WITH {BARS},
r AS (SELECT *, coalesce({change('Close')}, 0) AS ret FROM bars),
m AS (SELECT *, {full('avg(Close)', 'Close', 5)} AS m5, {full('avg(Close)', 'Close', 20)} AS m20,
             {full('stddev_samp(ret)', 'ret', 20)} AS vol FROM r)
SELECT Symbol, Date, {rounded({'return': 'ret', 'ma5': f'coalesce({after("m5")}, 0)',
                               'ma20': f'coalesce({after("m20")}, 0)', 'volatility': f'coalesce({after("vol")}, 0)'})}
FROM m"""


def pipeline(source: str) -> str:
    """Fill, cap and every indicator, of a table without repeated rows."""
    return f"""filled AS (SELECT Symbol, Date, {named({c: forward(c) for c in COLUMNS})} FROM {source}),
quarters AS ({quartiles('filled')}),
clean AS (SELECT Symbol, Date, {CAPS} FROM filled JOIN quarters USING (Symbol)),
stage1 AS (SELECT *, {named(PRICE)}, {named(VOLUME)}, {TRUE_RANGE} AS TR, {DELTA} AS delta,
                  {MIDDLE} AS middle, {DEVIATION} AS deviation FROM clean),
stage2 AS (SELECT *, {named(VOLATILITY)}, {GAIN} AS gain, {LOSS} AS loss FROM stage1),
stage3 AS (SELECT *, {STRENGTH} AS RSI, {named(BANDS)} FROM stage2)"""


def complete(columns: list[str]) -> str:
    return " AND ".join(f'"{c}" IS NOT NULL' for c in columns)


EARLY = [*COLUMNS, *PRICE, *VOLUME, "TR", *VOLATILITY, "RSI", *BANDS]
ORACLE["full_pipeline"] = f"""WITH RECURSIVE {DEDUPED}, {pipeline('deduped')}, {recursion('clean')}
SELECT Symbol, Date, {nudged(EARLY)}, {nudged(MACD)}
FROM stage3 JOIN (SELECT Symbol, Date, fast, slow, signal FROM averages) USING (Symbol, Date)
WHERE {complete(EARLY)}"""
ORACLE["pipeline_wide"] = f"""WITH {WIDE}, {pipeline('wide')}
SELECT Symbol, Date, {nudged(['Close', 'Daily_Return', 'Volatility_5d', 'ATR_5d', 'Price_Momentum_5d'])}
FROM stage3 WHERE {complete(EARLY)}"""

TICK = {k: PRICE[k] for k in ("Daily_Return", "MA5", "MA20", "Price_Momentum_5d")}
ORACLE["tick_features"] = f"""WITH {TICKS}, filled AS (SELECT Symbol, Date, {forward('Close')} AS Close FROM ticks)
SELECT Symbol, {TIME} AS Date, {nudged({'Close': 'Close', **TICK})} FROM filled"""
ORACLE["tick_interpolated"] = f"""WITH {TICKS}, numbered AS (SELECT *, row_number() {W} AS rn FROM ticks)
SELECT Symbol, {TIME} AS Date, {rounded({'Close': line('Close')})} FROM numbered"""
ORACLE["tick_iqr_cap"] = f"""WITH {TICKS}, quarters AS (
  SELECT Symbol, quantile_cont(Close, 0.25) AS a_Close, quantile_cont(Close, 0.75) AS b_Close FROM ticks GROUP BY 1)
SELECT Symbol, {TIME} AS Date, {rounded({'Close': capped('Close')}, 6)} FROM ticks JOIN quarters USING (Symbol)"""

# --- profile ------------------------------------------------------------------------

ORACLE["symbol_list"] = "SELECT DISTINCT o_orderpriority AS Symbol FROM orders"
ORACLE["symbol_slice"] = f"""WITH {BARS} SELECT {SHOWN} FROM bars
WHERE Symbol IN ('1-URGENT', '2-HIGH') AND Date >= DATE '1996-01-01' AND Date < DATE '1997-01-01'"""
ORACLE["last_year"] = f"""WITH {BARS} SELECT {SHOWN} FROM bars
WHERE Date > (SELECT max(Date) FROM bars) - INTERVAL 365 DAYS"""
ORACLE["preview"] = f"WITH {BARS} SELECT {SHOWN} FROM bars ORDER BY Symbol, Date LIMIT 20"
ORACLE["overview_summary"] = f"""WITH {BARS}
SELECT count(*) AS n_rows, min(Date) AS first_date, max(Date) AS last_date,
       round(min(Close), 4) AS min_close, round(max(Close), 4) AS max_close FROM bars"""


def described(source: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", {rounded({
            'mean': f'avg({c})', 'std': f'stddev_samp({c})', 'min': f'min({c})', 'q25': f'quantile_cont({c}, 0.25)',
            'q50': f'quantile_cont({c}, 0.5)', 'q75': f'quantile_cont({c}, 0.75)', 'max': f'max({c})'}, 3)} FROM {source}"""
        for c in columns
    )


ORACLE["describe"] = f"WITH {BARS} {described('bars', COLUMNS)}"
ORACLE["describe_lineitem"] = described("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
ALL = ["Symbol", "Date", *COLUMNS]
ORACLE["missing_values"] = f"WITH {DIRTY} " + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct FROM dirty""" for c in ALL
)
ORACLE["column_info"] = f"WITH {DIRTY} " + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) - count({c}) AS nulls,
    round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM dirty""" for c in ALL
)


def binned(source: str, column: str, by: str, digits: int) -> str:
    by = f", {by}" if by else ""
    return f"""limits AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
bins AS (
  SELECT CAST(least(floor(({column} - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS bin, lo, hi{by}
  FROM {source}, limits WHERE {column} IS NOT NULL)
SELECT bin{by}, count(*) AS n, round(min(lo) + (bin - 1) * ((min(hi) - min(lo)) / 50), {digits}) + 0.0 AS bin_start
FROM bins GROUP BY bin{by}"""


ORACLE["histogram"] = f"WITH {BARS}, {binned('bars', 'Close', '', 3)}"
ORACLE["score_histogram"] = f"WITH {SCORED}, {binned('scored', 'anomaly_score', 'is_anomaly', 6)}"
ORACLE["plot_series"] = f"WITH {SCORED} SELECT Symbol, Date, round(Close, 4) AS value, is_anomaly FROM scored"
ORACLE["corr_matrix"] = f"WITH {BARS} " + "\nUNION ALL ".join(
    f"""SELECT '{x}' AS x, '{y}' AS y,
    round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) + 0.0 AS correlation FROM bars"""
    for x in COLUMNS for y in COLUMNS
)

# --- scaling and detectors ----------------------------------------------------------

ORACLE["zscore_scale"] = f"""WITH {BARS}, m AS (SELECT {', '.join(
    f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in COLUMNS)} FROM bars)
SELECT Symbol, Date, {rounded({c: f'({c} - m_{c}) / s_{c}' for c in COLUMNS}, 6)} FROM bars, m"""
ORACLE["minmax_scores"] = f"""WITH {BARS}, m AS (SELECT min(Close) AS lo, max(Close) AS hi FROM bars)
SELECT Symbol, Date, round((Close - lo) / (hi - lo), 6) + 0.0 AS anomaly_score FROM bars, m"""
ORACLE["contamination_flags"] = f"""WITH {BARS}, m AS (SELECT quantile_cont(Close, 0.95) AS cut FROM bars)
SELECT Symbol, Date, round(Close, 4) AS Close, CAST(Close > cut AS INTEGER) AS is_anomaly FROM bars, m"""


def squared(a: str, b: str, columns: list[str]) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns)


def factors(source: str, distance: str, k: int, order: str, among: str = "true") -> str:
    """Brute-force local outlier factors of a table with unique ``vid``, of pairs that meet ``among``."""
    return f"""near AS (
  SELECT a.vid AS id, b.vid AS other, {distance} AS d2
  FROM {source} a JOIN {source} b ON a.vid <> b.vid AND {among}
  QUALIFY row_number() OVER (PARTITION BY a.vid ORDER BY {distance}, {order}) <= {k}),
kd AS (SELECT id, sqrt(max(d2)) AS kdist FROM near GROUP BY id),
density AS (
  SELECT n.id, 1 / (avg(greatest(k.kdist, sqrt(n.d2))) + 1e-10) AS lrd
  FROM near n JOIN kd k ON k.id = n.other GROUP BY n.id),
factors AS (
  SELECT n.id, avg(o.lrd) / min(s.lrd) AS factor
  FROM near n JOIN density o ON o.id = n.other JOIN density s ON s.id = n.id GROUP BY n.id)"""


SCALED = "(factor - min(factor) OVER ()) / (max(factor) OVER () - min(factor) OVER ())"
NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS vid FROM {source})".format(
    order=", ".join(COLUMNS), source="{source}"
)
ORACLE["lof_exact"] = f"""WITH {HOURLY}, {NUMBERED.format(source='hours')},
{factors('numbered', squared('a', 'b', COLUMNS), 20, 'b.vid')}
SELECT Symbol, {TIME} AS Date, round({SCALED}, 6) + 0.0 AS anomaly_score, CAST(factor > 1.5 AS INTEGER) AS is_anomaly
FROM numbered JOIN factors ON id = vid"""
ORACLE["lof_by_symbol"] = f"""WITH {HOURLY}, {NUMBERED.format(source='hours')},
{factors('numbered', squared('a', 'b', COLUMNS), 20, 'b.vid', 'a.Symbol = b.Symbol')}
SELECT Symbol, {TIME} AS Date, round({SCALED}, 6) + 0.0 AS anomaly_score, CAST(factor > 1.5 AS INTEGER) AS is_anomaly
FROM numbered JOIN factors ON id = vid"""
NOVEL = f"""WITH {HOURLY},
known AS (SELECT * FROM hours WHERE Date < TIMESTAMP '2024-01-20'),
{NUMBERED.format(source='known')},
{factors('numbered', squared('a', 'b', COLUMNS), 20, 'b.vid')},
fresh AS (SELECT *, row_number() OVER (ORDER BY Symbol, Date) AS qid FROM hours WHERE Date >= TIMESTAMP '2024-01-20'),
asked AS (
  SELECT q.qid, r.vid, {squared('q', 'r', COLUMNS)} AS d2 FROM fresh q, numbered r
  QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY {squared('q', 'r', COLUMNS)}, r.vid) <= 20),
own AS (
  SELECT n.qid, 1 / (avg(greatest(k.kdist, sqrt(n.d2))) + 1e-10) AS lrd, avg(d.lrd) AS around
  FROM asked n JOIN kd k ON k.id = n.vid JOIN density d ON d.id = n.vid GROUP BY n.qid),
result AS (SELECT f.Symbol, f.Date, o.around / o.lrd AS factor FROM fresh f JOIN own o USING (qid))"""
ORACLE["lof_novelty"] = f"""{NOVEL}
SELECT Symbol, {TIME} AS Date, round({SCALED}, 6) + 0.0 AS anomaly_score, CAST(factor > 1.5 AS INTEGER) AS is_anomaly
FROM result"""
# a stream is scaled by the range of the training scores
ORACLE["stream_lof"] = f"""{NOVEL},
span AS (SELECT min(factor) AS lo, max(factor) AS hi FROM factors)
SELECT Symbol, {TIME} AS Date, round(greatest(0, least(1, (factor - lo) / (hi - lo))), 6) + 0.0 AS anomaly_score,
  CAST(factor > 1.5 AS INTEGER) AS is_anomaly FROM result, span"""
ORACLE["lof_embeddings"] = f"""WITH numbered AS (SELECT vec_id AS vid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
{factors('numbered', 'pow(list_distance(a.e, b.e), 2)', 10, 'b.vid')}
SELECT vid AS vec_id, round({SCALED}, 5) + 0.0 AS anomaly_score, CAST(factor > 1.5 AS INTEGER) AS is_anomaly
FROM numbered JOIN factors ON id = vid"""

# the first component of two standardised columns is their sum or difference, by the sign of their correlation
ORACLE["recon_pair"] = f"""WITH {BARS},
m AS (SELECT avg(High) AS mh, stddev_pop(High) AS sh, avg(Close) AS mc, stddev_pop(Close) AS sc,
             sign(covar_pop(High, Close)) AS s FROM bars),
errors AS (SELECT Symbol, Date, pow((High - mh) / sh - s * (Close - mc) / sc, 2) / 4 AS e FROM bars, m),
cut AS (SELECT quantile_cont(e, 0.95) AS q, min(e) AS lo, max(e) AS hi FROM errors)
SELECT Symbol, Date, round((e - lo) / (hi - lo), 6) + 0.0 AS anomaly_score, CAST(e > q AS INTEGER) AS is_anomaly
FROM errors, cut"""

# --- reports ------------------------------------------------------------------------

ORACLE["anomaly_summary"] = f"""WITH {SCORED}
SELECT count(*) AS total, count(*) FILTER (is_anomaly = 1) AS flagged,
       round(count(*) FILTER (is_anomaly = 1) * 100.0 / count(*), 6) AS flagged_pct,
       count(*) FILTER (is_anomaly = 0) AS normal FROM scored"""
TOP = "SELECT * FROM scored WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, Symbol, Date LIMIT {k}"
ORACLE["top_anomalies"] = f"""WITH {SCORED}, top AS ({TOP.format(k=20)})
SELECT strftime(Date, '%Y-%m-%d 00:00:00') AS Date, Symbol,
       {rounded(['Close', 'Volume', 'anomaly_score', 'Daily_Return'], 6)} FROM top"""
ORACLE["gap_patterns"] = f"""WITH {SCORED},
gaps AS (SELECT Date, date_diff('day', lag(Date) OVER (ORDER BY Date, Symbol), Date) AS gap FROM scored WHERE is_anomaly = 1),
runs AS (SELECT *, sum(CASE WHEN coalesce(gap, 3) >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY Date
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM gaps)
SELECT (SELECT count(*) FROM gaps) AS n_anomalies,
       (SELECT CAST(floor(avg(gap)) AS BIGINT) FROM gaps) AS mean_gap_days,
       (SELECT count(*) FROM gaps WHERE gap < 3) AS gaps_under_3_days,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM runs GROUP BY run)) AS longest_run"""
ORACLE["price_position"] = f"""WITH {SCORED},
q AS (SELECT quantile_cont(Close, 0.9) AS p90, quantile_cont(Close, 0.25) AS p25 FROM scored)
SELECT round(count(*) FILTER (Close > p90) * 100.0 / count(*), 6) AS high_price_pct,
       round(count(*) FILTER (Close < p25) * 100.0 / count(*), 6) AS low_price_pct
FROM scored, q WHERE is_anomaly = 1"""


def rank_of(column: str) -> str:
    below = f"(SELECT count(*) FROM scored s WHERE s.{column} < c.{column})"
    upto = f"(SELECT count(*) FROM scored s WHERE s.{column} <= c.{column})"
    return f"({below} + {upto} + CASE WHEN {below} < {upto} THEN 1 ELSE 0 END) * 50.0 / (SELECT count({column}) FROM scored)"


ORACLE["explain_top"] = f"""WITH {SCORED},
steps AS (SELECT *, (Close - {lag('Close')}) / nullif({lag('Close')}, 0) * 100 AS change_pct FROM scored),
c AS ({TOP.format(k=10).replace('FROM scored', 'FROM steps')}),
ranks AS (SELECT c.*, {rank_of('Close')} AS pr, {rank_of('Volume')} AS vr,
          (High - Low) / (SELECT avg(High - Low) FROM scored) AS wide FROM c),
told AS (SELECT *, concat_ws('; ', CASE WHEN pr > 95 THEN 'price_high' END, CASE WHEN pr < 5 THEN 'price_low' END,
  CASE WHEN vr > 95 THEN 'volume_high' END, CASE WHEN vr < 5 THEN 'volume_low' END,
  CASE WHEN wide > 2 THEN 'wide_range' END) AS found FROM ranks)
SELECT Symbol, Date, {rounded(['Close', 'anomaly_score', 'change_pct'], 6)},
       CASE WHEN anomaly_score > 0.8 THEN 'High' WHEN anomaly_score > 0.6 THEN 'Medium' ELSE 'Low' END AS confidence,
       CASE WHEN found = '' THEN 'pattern' ELSE found END AS reasons
FROM told"""

def said(code: str, value: str, text: str) -> str:
    """A reason with its number and words where its test holds."""
    return f"printf('%s %.3f ', '{code}', {value}) || printf('{text}', {value})"


REASONS = {
    "price_high": ("pr > 95", "100 - pr", "close is in the highest %.1f%% of all rows"),
    "price_low": ("pr < 5", "pr", "close is in the lowest %.1f%% of all rows"),
    "volume_high": ("vr > 95", "100 - vr", "volume is in the highest %.1f%% of all rows"),
    "volume_low": ("vr < 5", "vr", "volume is in the lowest %.1f%% of all rows"),
    "wide_range": ("wide > 2", "wide", "high and low are %.1f times as far apart as on average"),
}
WORDED = ", ".join(f"CASE WHEN {test} THEN {said(code, value, text)} END" for code, (test, value, text) in REASONS.items())
ORACLE["explain_all"] = f"""WITH {SCORED},
c AS (SELECT * FROM scored WHERE is_anomaly = 1),
ranks AS (SELECT c.*, {rank_of('Close')} AS pr, {rank_of('Volume')} AS vr,
          (High - Low) / (SELECT avg(High - Low) FROM scored) AS wide FROM c),
told AS (SELECT *, concat_ws('; ', {WORDED}) AS found FROM ranks)
SELECT Symbol, Date, {rounded(['anomaly_score'], 6)},
       CASE WHEN anomaly_score > 0.8 THEN 'High' WHEN anomaly_score > 0.6 THEN 'Medium' ELSE 'Low' END AS confidence,
       CASE WHEN found = '' THEN 'no feature stands out alone, their combination does' ELSE found END AS reasons
FROM told"""

# --- comparison and evaluation ------------------------------------------------------

ORACLE["compare_configs"] = f"WITH {SCORED} " + " UNION ALL ".join(
    f"""SELECT '{config}' AS config, count(*) AS total, count(*) FILTER (anomaly_score > {cut}) AS flagged,
    round(count(*) FILTER (anomaly_score > {cut}) * 100.0 / count(*), 6) AS flagged_pct FROM scored"""
    for config, cut in (("loose", 0.2), ("strict", 0.4))
)
ORACLE["config_agreement"] = f"""WITH {SCORED},
votes AS (SELECT CAST((anomaly_score > 0.2)::INT + (anomaly_score > 0.3)::INT + (anomaly_score > 0.4)::INT AS BIGINT)
          AS flagged_by FROM scored)
SELECT flagged_by, count(*) AS n_rows FROM votes GROUP BY 1"""
ORACLE["chrono_split"] = f"""WITH {BARS}, placed AS (SELECT *, row_number() OVER (ORDER BY Date, Symbol) AS nth FROM bars)
SELECT Symbol, Date, CASE WHEN nth <= floor((SELECT count(*) FROM bars) * 0.8) THEN 'train' ELSE 'test' END AS part
FROM placed"""
ORACLE["synthetic_labels"] = f"""WITH {BARS}
SELECT count(*) AS n_rows, CAST(greatest(1, floor(count(*) * 0.02)) AS BIGINT) AS n_labelled FROM bars"""
ORACLE["synthetic_label_keys"] = f"""WITH {BARS},
hashed AS (SELECT *, CAST('0x' || substr(md5('7|' || Symbol || '|' || strftime(Date, '%Y-%m-%d %H:%M:%S.%f')), 1, 15) AS BIGINT) AS h FROM bars)
SELECT Symbol, Date, CAST(1 AS INTEGER) AS label FROM hashed
QUALIFY row_number() OVER (ORDER BY h, Symbol, Date) <= (SELECT greatest(1, floor(count(*) * 0.05)) FROM bars)"""
JUDGED = """judged AS (
  SELECT model, label, predicted FROM (
    SELECT toxic AS label, n_chars > 3000 AS long, n_chars < 500 AS short, quality = 0 AS quality
    FROM labels JOIN documents USING (doc_id))
  UNPIVOT (predicted FOR model IN (long, short, quality))),
counts AS (
  SELECT model, count(*) FILTER (predicted AND label = 1) AS tp, count(*) FILTER (predicted AND label <> 1) AS fp,
         count(*) FILTER (NOT predicted AND label = 1) AS fn, count(*) AS n FROM judged GROUP BY model),
table_ AS (
  SELECT model, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS flagged_ratio FROM counts)"""
ORACLE["metrics_by_model"] = f"""WITH {JUDGED}
SELECT model, {rounded({'precision': '"precision"', 'recall': 'recall', 'f1': 'f1', 'flagged_ratio': 'flagged_ratio'}, 6)}
FROM table_"""
ORACLE["best_model"] = f"""WITH {JUDGED}
SELECT model AS best_model, round(f1, 6) AS f1 FROM table_ ORDER BY f1 DESC, model LIMIT 1"""

# --- files and streams --------------------------------------------------------------

ORACLE["json_xml_csv_same_bars"] = f"""WITH {BARS}
SELECT Symbol, Date, {rounded(COLUMNS, 2)}, round(Close, 2) AS Adj_Close, source
FROM bars, (VALUES ('csv'), ('json'), ('xml'), ('parquet')) AS s(source)"""
ORACLE["vendor_payload"] = ORACLE["map_columns"]
ORACLE["wide_to_bars"] = ORACLE["bars_daily"]
ORACLE["export_anomalies_roundtrip"] = f"""WITH {SCORED}
SELECT Symbol, Date, round(Close, 4) AS Close, is_anomaly, source
FROM scored, (VALUES ('parquet'), ('csv'), ('json')) AS s(source) WHERE is_anomaly = 1"""
ORACLE["stream_hourly_bars"] = f"""WITH {HOURLY}
SELECT Symbol, {TIME} AS Date, {rounded(COLUMNS)} FROM hours
WHERE Date + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
# the window of a week ends seven days after its Monday
ORACLE["stream_weekly_bars"] = f"""WITH weeks AS (
  SELECT event_type AS Symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS Date, arg_min(value, ts) AS Open,
         max(value) AS High, min(value) AS Low, arg_max(value, ts) AS Close, CAST(count(*) AS DOUBLE) AS Volume
  FROM events GROUP BY 1, 2)
SELECT Symbol, {TIME} AS Date, {rounded(COLUMNS)} FROM weeks
WHERE Date + INTERVAL 7 DAYS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
ORACLE["stream_all_hours"] = ORACLE["bars_hourly"]
ORACLE["stream_monthly_bars"] = f"""WITH months AS (
  SELECT o_orderpriority AS Symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS Date,
         arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS Open, max(o_totalprice) AS High, min(o_totalprice) AS Low,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS Close, CAST(count(*) AS DOUBLE) AS Volume
  FROM orders GROUP BY 1, 2)
SELECT {SHOWN} FROM months"""

# --- what files hold ----------------------------------------------------------------

ORACLE["json_nested"] = f"WITH {BARS} SELECT Symbol, Date, {rounded(COLUMNS, 2)} FROM bars"
ORACLE["json_records"] = ORACLE["xml_found_tag"] = ORACLE["json_nested"]
ORACLE["parquet_symbols"] = f"WITH {BARS} SELECT '070' || Symbol[1] AS Symbol, Date, {rounded(COLUMNS)} FROM bars"
ORACLE["found_column"] = f"WITH {BARS} SELECT Symbol, Date, {rounded({'found': 'Open'})} FROM bars"
ORACLE["saved_lof"] = ORACLE["lof_novelty"]
ORACLE["column_types"] = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls,
    round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM lineitem"""
    for c, kind in {
        **dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey"), "bigint"), "l_linenumber": "int",
        **dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "double"),
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    }.items()
)
SPELLINGS = ["%Y-%m-%d", "%m/%d/%Y", "%Y%m%d", "%d.%m.%Y", "%-d-%b-%Y", "%B %-d, %Y", "%-d %b %Y", "%Y/%-m/%-d %-I:%M %p", "%-m/%-d/%Y %-H:%M"]
TOLD = f"""told AS (
  SELECT o_orderkey AS k, o_orderpriority AS Symbol, o_orderdate AS moment,
         CASE WHEN k % 41 = 0 THEN 'soon' WHEN k % 43 = 0 THEN NULL WHEN k % 47 = 0 THEN '31/31/1996'
              ELSE CASE k % {len(SPELLINGS)} {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{s}')" for i, s in enumerate(SPELLINGS))} END END AS Date,
         CASE WHEN k % 31 = 0 THEN 'n/a' WHEN k % 37 = 0 THEN NULL ELSE printf('$%,.2f', o_totalprice) END AS Close,
         CASE WHEN Date IS NULL THEN 'no_date' WHEN k % 41 = 0 OR k % 47 = 0 THEN 'bad_date'
              WHEN Close IS NULL THEN 'no_close' WHEN k % 31 = 0 THEN 'bad_close' END AS reason
  FROM orders)"""
ORACLE["date_shapes"] = f"""WITH {TOLD}
SELECT k AS order_key, strftime(CASE WHEN k % {len(SPELLINGS)} >= 7 THEN moment ELSE date_trunc('day', moment) END, '%Y-%m-%d %H:%M') AS read
FROM told WHERE reason IS NULL OR reason NOT IN ('no_date', 'bad_date')"""
ORACLE["rejected_rows"] = f"""WITH {TOLD}
SELECT k AS order_key, Symbol, Date, Close, reason FROM told WHERE reason IS NOT NULL"""
ORACLE["load_report"] = f"""WITH {TOLD}
SELECT count(*) AS "rows", count(*) FILTER (reason IS NULL) AS usable_rows,
       {', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ('no_date', 'bad_date', 'no_close', 'bad_close'))},
       CAST(min(moment) FILTER (reason IS NULL) AS DATE) AS first_date, CAST(max(moment) FILTER (reason IS NULL) AS DATE) AS last_date
FROM told"""
