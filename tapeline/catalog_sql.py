"""SQL twins of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from tapeline import catalog
from tapeline.functions.indicators import INDICATOR_NAMES
from tapeline.operators.equity import KEY_METRICS, METRIC_COLUMNS, VERSUS_METRICS

_START, _END = f"DATE '{catalog.RANGE_START}'", f"DATE '{catalog.RANGE_END}'"
_OLD_END, _NEW_START = f"DATE '{catalog.OLD_END}'", f"DATE '{catalog.NEW_START}'"
_CASH = catalog.ACCOUNT.initial_cash
_FEE, _SLIP = catalog.ACCOUNT.commission, catalog.ACCOUNT.slippage


def r4(expr: str, name: str | None = None, digits: int = 4) -> str:
    scale = 10 ** catalog.PLACES.get(name or expr, digits)
    return f"floor(({expr}) * {scale}.0::DOUBLE + 0.5) / {scale}.0::DOUBLE + 0.0 AS {name or expr}"


_OHLC = ", ".join(r4(c) for c in ("open", "high", "low", "close"))
_PRICES = f"ticker_code, date, {_OHLC}, volume, {r4('adj_close')}"


def _code(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"CASE WHEN length({text}) >= 6 THEN {text} ELSE lpad({text}, 6, '0') END"


def _ticker(key: str) -> str:
    suffixes = ", ".join(f"'{s}'" for s in ("", *catalog.market.SUFFIXES))
    return f"({_code(key)}) || ([{suffixes}])[{key} % 6 + 2]"


_TICKS = f"""ticks AS (
    SELECT {_ticker('l_suppkey')} AS ticker_code, l_shipdate AS ts,
        l_orderkey::HUGEINT * 100000000000000000000 + l_linenumber::HUGEINT * 1000000000000000 + l_partkey AS seq,
        l_orderkey AS order_key,
        l_extendedprice / l_quantity AS price,
        l_extendedprice / l_quantity * (1.0::DOUBLE - l_discount) AS adj_price, l_quantity AS volume
    FROM lineitem)"""


def _resampled(bucket: str, ticks: str = "ticks") -> str:
    return f"""SELECT ticker_code, {bucket} AS date, arg_min(price, seq) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume,
        arg_max(adj_price, seq) AS adj_close FROM {ticks} GROUP BY 1, 2"""


_BARS = f"{_TICKS}, bars AS ({_resampled('CAST(ts AS DATE)')})"
_EVENTS = f"""event_ticks AS (
    SELECT 'U' || ({_code('user_id')}) AS ticker_code, ts, epoch_us(ts)::HUGEINT * 10000000000000000000 + event_id AS seq,
        value AS price, value AS adj_price, 1 AS volume FROM events)"""


def _market(code: str) -> str:
    up = f"upper({code})"
    return f"""CASE WHEN {up} LIKE '%.KS' THEN 'KOSPI' WHEN {up} LIKE '%.KQ' THEN 'KOSDAQ'
        WHEN {up} LIKE '%-USD%' THEN 'CRYPTO' WHEN {up} LIKE '%.T' THEN 'TOKYO'
        WHEN {up} LIKE '%.HK' THEN 'HONGKONG' WHEN {up} NOT LIKE '%.%' THEN 'US' ELSE 'UNKNOWN' END"""


def _exchange(code: str) -> str:
    up = f"upper({code})"
    return f"""CASE WHEN {up} LIKE '%.KS' OR {up} LIKE '%.KQ' THEN 'XKRX' WHEN {up} LIKE '%.T' THEN 'XTKS'
        WHEN {up} LIKE '%.HK' THEN 'XHKG' WHEN {up} NOT LIKE '%.%' THEN 'XNYS' END"""


_TICKERS = f"""tickers AS (
    SELECT {_ticker('s_suppkey')} AS ticker_code, s_name AS name,
        {_market(_ticker('s_suppkey'))} AS market, n_name AS sector
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
_LISTING = f"""listing AS (
    SELECT CASE WHEN s_nationkey % 5 < 3 THEN 'KRX' WHEN s_nationkey % 5 = 3 THEN 'NYSE' ELSE 'AMEX' END AS exchange,
        s_suppkey AS pos,
        CASE WHEN s_suppkey % 11 = 10 THEN ' nan ' ELSE ' ' || ({_code('s_suppkey')}) || ' ' END AS symbol,
        CASE s_nationkey % 5 WHEN 0 THEN 'KOSPI' WHEN 1 THEN 'Kosdaq Global' WHEN 2 THEN 'KONEX'
            WHEN 3 THEN 'NYSE' ELSE 'AMEX' END AS market
    FROM supplier)"""
_KOREAN_SUFFIX = """CASE WHEN upper(market) LIKE 'KOSPI%' THEN '.KS'
    WHEN upper(market) LIKE 'KOSDAQ%' THEN '.KQ' ELSE '' END"""
_USABLE = "trim(symbol) <> '' AND lower(trim(symbol)) <> 'nan'"
_SYMBOLS = f"""{_LISTING}, korean AS (
    SELECT CASE WHEN upper(market) LIKE 'KOSPI%' THEN 'KOSPI' ELSE 'KOSDAQ' END AS part, pos,
        trim(symbol) || {_KOREAN_SUFFIX} AS ticker_code FROM listing
    WHERE exchange = 'KRX' AND {_USABLE} AND (upper(market) LIKE 'KOSPI%' OR upper(market) LIKE 'KOSDAQ%')),
symbols AS (
    SELECT 'KRX' AS exchange, part, pos, ticker_code FROM korean
    UNION ALL SELECT part, part, pos, ticker_code FROM korean
    UNION ALL SELECT exchange, exchange, pos, trim(symbol) FROM listing
        WHERE exchange IN ('NYSE', 'AMEX') AND trim(symbol) <> '')"""


def _universe(order: list[tuple[str, str]]) -> str:
    ranks = " ".join(
        f"WHEN exchange = '{name}' AND part = '{part}' THEN {i}" for i, (name, part) in enumerate(order)
    )
    return f"""{_SYMBOLS}, ranked_symbols AS (SELECT *, CASE {ranks} END AS rank FROM symbols), universe AS (
        SELECT ticker_code, rank, pos FROM (
            SELECT *, row_number() OVER (PARTITION BY ticker_code ORDER BY rank, pos) AS place
            FROM ranked_symbols WHERE rank IS NOT NULL)
        WHERE place = 1)"""


_KRX = [("KRX", "KOSPI"), ("KRX", "KOSDAQ")]
_KOREAN = [("KOSPI", "KOSPI"), ("KOSDAQ", "KOSDAQ")]
_US = [("NYSE", "NYSE"), ("AMEX", "AMEX")]
_SP500 = [("S&P500", "S&P500")]
_HOLIDAY_ROWS = ", ".join(
    f"('{exchange}', DATE '{day}')" for exchange, days in catalog.HOLIDAYS.items() for day in days
)
_HOLIDAYS = f"holidays(exchange, date) AS (VALUES {_HOLIDAY_ROWS})"
_ALL_SESSIONS = f"""all_sessions AS (
    SELECT DISTINCT {_exchange('ticker_code')} AS exchange, CAST(ts AS DATE) AS date FROM ticks)"""
_SESSIONS = f"""{_BARS}, {_ALL_SESSIONS}, {_HOLIDAYS}, sessions AS (
    SELECT s.* FROM all_sessions s WHERE NOT EXISTS (
        SELECT 1 FROM holidays h WHERE h.exchange = s.exchange AND h.date = s.date))"""


def _filled(bars: str, sessions_only: bool) -> str:
    """Sessions between each ticker's ends, plus (unless ``sessions_only``) its own other bars."""
    extra = "" if sessions_only else "UNION SELECT ticker_code, date FROM src"
    return f"""src AS (SELECT *, {_exchange('ticker_code')} AS exchange FROM {bars}),
    ends AS (SELECT ticker_code, exchange, min(date) AS lo, max(date) AS hi FROM src
        WHERE exchange IS NOT NULL GROUP BY ALL),
    days AS (SELECT e.ticker_code, s.date FROM ends e
        JOIN sessions s ON s.exchange = e.exchange AND s.date BETWEEN e.lo AND e.hi {extra}),
    filled AS (SELECT d.ticker_code, d.date, b.open, b.high, b.low, b.close, b.volume, b.adj_close
        FROM days d LEFT JOIN src b ON b.ticker_code = d.ticker_code AND b.date = d.date)"""


_W = "OVER (PARTITION BY ticker_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LAG = "OVER (PARTITION BY ticker_code ORDER BY date)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker_code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _decayed(value: str, rate: str, index: str) -> str:
    return f"sum({value} * pow({rate}::DOUBLE, -{index})) {_W} * pow({rate}::DOUBLE, {index})"


def _ema(n: int, x: str = "adj_close", k: str = "k", mean: str = "mean_to") -> str:
    a = f"(2.0::DOUBLE / {n + 1})"
    v = f"(CASE WHEN {k} = {n} THEN {mean} WHEN {k} > {n} THEN {a} * {x} ELSE 0 END)"
    return f"CASE WHEN {k} >= {n} THEN {_decayed(v, f'(1 - {a})', k)} END"


def _full(agg: str, n: int) -> str:
    return f"CASE WHEN k >= {n} THEN {agg} {_frame(n)} END"


_WILDER = "(13.0::DOUBLE / 14)"
# Indicators of ``base``, a bar table without NULLs, in layers that read each other.
_MA = ", ".join(f"{_ema(n)} AS ma_{n}" for n in (5, 10, 20, 50, 60, 100, 120, 200))


def _indicator_layers(base: str) -> str:
    return f"""i1 AS (
        SELECT *, row_number() {_LAG} AS k, avg(adj_close) {_W} AS mean_to, lag(adj_close) {_LAG} AS prev,
            high * (adj_close / close) AS ah, low * (adj_close / close) AS al,
            volume / (adj_close / close) AS av FROM {base}),
    i2 AS (
        SELECT *, {_MA}, {_ema(12)} - {_ema(26)} AS macd,
            {_full('avg(adj_close)', 20)} AS bb_mid, {_full('stddev_pop(adj_close)', 20)} AS sd,
            ln(adj_close) - ln(prev) AS lr,
            greatest(adj_close - prev, 0) AS up, greatest(prev - adj_close, 0) AS down,
            greatest(ah - al, abs(ah - prev), abs(prev - al)) AS tr0,
            {_full('min(al)', 14)} AS ll, {_full('max(ah)', 14)} AS hh,
            sum(CASE WHEN k = 1 THEN 1 ELSE sign(adj_close - prev) END * av) {_W} AS obv
        FROM i1),
    i3 AS (
        SELECT *, CASE WHEN k > 1 THEN tr0 END AS tr, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower,
            CASE WHEN hh = ll THEN 0 ELSE 100 * (adj_close - ll) / (hh - ll) END AS fast_k,
            avg(macd) {_W} AS macd_mean FROM i2),
    i4 AS (
        SELECT *, {_ema(9, 'macd', '(k - 25)', 'macd_mean')} AS macd_signal,
            {_decayed('up', _WILDER, 'k')} AS gain, {_decayed('down', _WILDER, 'k')} AS loss,
            CASE WHEN k >= 15 THEN {_decayed('tr', _WILDER, 'k')} * {1 / 14} / (1 - pow({_WILDER}, k - 1)) END AS atr,
            CASE WHEN k >= 21 THEN stddev_samp(lr) {_frame(20)} * sqrt(252) END AS hv,
            CASE WHEN k >= 16 THEN avg(fast_k) {_frame(3)} END AS stoch_k FROM i3),
    ind AS (
        SELECT * EXCLUDE (mean_to), macd - macd_signal AS macd_hist,
            CASE WHEN k >= 15 AND gain + loss <> 0 THEN 100 * gain / (gain + loss) END AS rsi,
            CASE WHEN bb_upper <> bb_lower THEN (adj_close - bb_lower) / (bb_upper - bb_lower) END AS bb_pct,
            CASE WHEN k >= 18 THEN avg(stoch_k) {_frame(3)} END AS stoch_d FROM i4)"""


_IND = f"{_BARS}, {_indicator_layers('bars')}"
# Three indicators alone, for twins that read them twice.
_THREE = f"""{_BARS}, t1 AS (SELECT ticker_code, date, adj_close, row_number() {_LAG} AS k, avg(adj_close) {_W} AS mean_to,
        lag(adj_close) {_LAG} AS prev, volume / (adj_close / close) AS av FROM bars),
    three AS MATERIALIZED (SELECT ticker_code, date, {_ema(5)} AS ma_5, {_full('avg(adj_close)', 20)} AS bb_mid,
        sum(CASE WHEN k = 1 THEN 1 ELSE sign(adj_close - prev) END * av) {_W} AS obv FROM t1)"""
_FOLD = "CAST(greatest(0, 5 - (n - place) // (n // 6)) AS INTEGER)"
_PLACED = "row_number() OVER (ORDER BY date, ticker_code) AS place, count(*) OVER () AS n"


def _pick(names: list[str]) -> str:
    return ", ".join(r4(n) for n in names)


def _indicators(names: list[str], where: str = "TRUE") -> str:
    return f"WITH {_IND} SELECT ticker_code, date, {_pick(names)} FROM ind WHERE {where}"


_OLD = f"old AS (SELECT * FROM bars WHERE date <= {_OLD_END})"
_NEW = f"""new AS (SELECT ticker_code, date, open, high, low, close * 1.01 AS close, volume,
    CASE WHEN volume % 7 <> 0 THEN adj_close END AS adj_close FROM bars WHERE date >= {_NEW_START})"""


def _merged(new: str, value: str = "n") -> str:
    other = "o" if value == "n" else "n"
    hit = f"{value}.ticker_code IS NOT NULL"
    cols = ", ".join(
        r4(f"(CASE WHEN {hit} THEN {value}.{c} ELSE {other}.{c} END)", c)
        for c in ("open", "high", "low", "close", "adj_close")
    )
    return f"""SELECT coalesce(n.ticker_code, o.ticker_code) AS ticker_code, coalesce(n.date, o.date) AS date,
        {cols}, CASE WHEN {hit} THEN {value}.volume ELSE {other}.volume END AS volume,
        CASE WHEN o.ticker_code IS NOT NULL THEN 2020 ELSE 2024 END AS retrieved_year
        FROM old o FULL JOIN {new} n ON n.ticker_code = o.ticker_code AND n.date = o.date"""


_LABELS = f"""labelled AS (
    SELECT *, CASE WHEN lead(1, 5) {_LAG} IS NULL THEN NULL
        WHEN floor((lead(adj_close, 5) {_LAG} - adj_close) / adj_close * 1e8 + 0.5) / 1e8 >= 0.02 THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END AS label FROM {{}})"""
_LABELLED = f"{_BARS}, {_LABELS.format('bars')}"
_RANKED = f"""{_BARS}, ranked AS (SELECT ticker_code, date, row_number() OVER (ORDER BY date, ticker_code) AS place,
    count(*) OVER () AS n FROM bars)"""
_RULE = f"""{_BARS}, s1 AS (SELECT *, row_number() {_LAG} AS k, avg(adj_close) {_W} AS mean_to FROM bars),
    s2 AS (SELECT *, {_ema(5)} AS ma_5, {_ema(20)} AS ma_20 FROM s1),
    rule AS (SELECT ticker_code, date, close, adj_close, k,
        CAST(floor(ma_5 * 1e8 + 0.5) > floor(ma_20 * 1e8 + 0.5) AS INTEGER) AS raw FROM s2),
    sig AS MATERIALIZED (SELECT ticker_code, date, close, k, coalesce(raw, 0) AS signal FROM rule)"""


def _positions(rules, signalled: str = _RULE) -> str:
    """The state machine of the rules as a recursion over bar numbers of ``sig``, which ``signalled`` defines.

    ``st`` holds the state after each bar and, on exit bars, the finished trade.
    """
    weight = rules.position_weight
    share = repr(float(weight)) if weight is not None else "1.0::DOUBLE / (SELECT count(DISTINCT ticker_code) FROM sig)"
    move = "round(b.close / s.fill - 1, 8)"
    if rules.use_stop_loss:
        price_rule = f"WHEN {move} <= -{rules.stop_loss_pct} THEN 'STOP_LOSS'"
    elif rules.use_take_profit:
        price_rule = f"WHEN {move} >= {rules.take_profit_pct} THEN 'TAKE_PROFIT'"
    else:
        price_rule = ""
    why = f"""CASE WHEN s.entry_date IS NULL THEN NULL
        WHEN s.held + 1 >= {rules.holding_period} THEN CASE WHEN b.signal = 1 THEN NULL ELSE 'HOLDING_PERIOD' END
        {price_rule} END"""
    opens = "b.signal = 1 AND b.close > 0 AND floor(b.cash / b.close) > 0"

    def enter(test: str) -> str:
        return f"""CASE WHEN {test} THEN b.date END, CASE WHEN {test} THEN b.close * {1 + _SLIP} END,
            CASE WHEN {test} THEN CAST(floor(b.cash / b.close) AS BIGINT) END, 0"""

    return f"""{signalled}, feed AS MATERIALIZED (SELECT *, {share} * {_CASH} AS cash FROM sig),
    st(ticker_code, k, entry_date, fill, size, held, done_entry, done_date, done_buy, done_sell, done_size, done_held, done_why) AS (
        SELECT b.ticker_code, b.k, {enter(opens)}, NULL::DATE, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE,
            NULL::BIGINT, NULL::INTEGER, NULL::VARCHAR
        FROM feed b WHERE b.k = 1
        UNION ALL
        SELECT ticker_code, k,
            CASE WHEN why IS NOT NULL THEN NULL WHEN was IS NULL AND opening THEN day ELSE was END,
            CASE WHEN why IS NOT NULL THEN NULL WHEN was IS NULL AND opening THEN price * {1 + _SLIP} ELSE paid END,
            CASE WHEN why IS NOT NULL THEN NULL WHEN was IS NULL AND opening THEN CAST(floor(cash / price) AS BIGINT) ELSE n END,
            CASE WHEN was IS NULL OR why IS NOT NULL OR (bars_held + 1 >= {rules.holding_period} AND signal = 1) THEN 0
                ELSE bars_held + 1 END,
            CASE WHEN why IS NOT NULL THEN was END, CASE WHEN why IS NOT NULL THEN day END,
            CASE WHEN why IS NOT NULL THEN paid END, CASE WHEN why IS NOT NULL THEN price * {1 - _SLIP} END,
            CASE WHEN why IS NOT NULL THEN n END, CASE WHEN why IS NOT NULL THEN bars_held + 1 END, why
        FROM (SELECT b.ticker_code, b.k, b.date AS day, b.close AS price, b.signal, b.cash, s.entry_date AS was,
                s.fill AS paid, s.size AS n, s.held AS bars_held, {why} AS why, {opens} AS opening
            FROM st s JOIN feed b ON b.ticker_code = s.ticker_code AND b.k = s.k + 1)),
    closed AS (SELECT ticker_code, done_entry AS entry_date, done_date AS exit_date, done_buy AS buy_price,
            done_sell AS sell_price, done_size AS size, (done_sell - done_buy) / done_buy AS pnl_pct,
            done_size * (done_sell - done_buy) - (done_sell + done_buy) * done_size * {_FEE} AS pnl_net,
            done_held AS holding_days, done_why AS exit_reason FROM st WHERE done_why IS NOT NULL),
    still AS (SELECT ticker_code, entry_date, fill AS buy_price, size, held AS holding_days FROM (
            SELECT *, row_number() OVER (PARTITION BY ticker_code ORDER BY k DESC) AS back FROM st)
        WHERE back = 1 AND entry_date IS NOT NULL),
    held AS (SELECT ticker_code, entry_date, exit_date, buy_price, sell_price, size FROM closed
        UNION ALL SELECT ticker_code, entry_date, NULL, buy_price, NULL, size FROM still)"""


_POSITIONS = _positions(catalog.RULES)
_TRADES = f"""SELECT ticker_code, entry_date, exit_date, {r4('buy_price')}, {r4('sell_price')}, size,
    {r4('pnl_pct')}, {r4('pnl_net')}, holding_days, exit_reason FROM closed"""

# Daily profit by a range join of bars and positions, unlike the carried form in Spark.
_STRATEGY_CURVE = f"""daily AS (
    SELECT b.date, sum(CASE
        WHEN b.date = p.entry_date THEN p.size * (b.close - p.buy_price) - p.size * p.buy_price * {_FEE}
        WHEN b.date = p.exit_date THEN p.size * (p.sell_price - b.last_close) - p.size * p.sell_price * {_FEE}
        WHEN p.entry_date IS NOT NULL THEN p.size * (b.close - b.last_close) ELSE 0 END) AS profit
    FROM (SELECT *, lag(close) {_LAG} AS last_close FROM bars) b
    LEFT JOIN held p ON p.ticker_code = b.ticker_code AND b.date >= p.entry_date
        AND b.date <= coalesce(p.exit_date, DATE '9999-12-31')
    GROUP BY b.date),
    mine AS (SELECT 'strategy' AS strategy, date, {_CASH} + sum(profit) OVER (ORDER BY date) AS value FROM daily)"""
_HOLD_CURVE = f"""first_close AS (SELECT ticker_code, arg_min(close, date) AS c0 FROM bars GROUP BY 1),
    hold AS (SELECT ticker_code, c0, floor({_CASH} / (SELECT count(*) FROM first_close) / c0) AS size FROM first_close),
    hold_daily AS (
        SELECT b.date, sum(CASE WHEN b.last_close IS NULL
            THEN h.size * (b.close - b.close * {1 + _SLIP}) - h.size * b.close * {1 + _SLIP} * {_FEE}
            ELSE h.size * (b.close - b.last_close) END) AS profit
        FROM (SELECT *, lag(close) {_LAG} AS last_close FROM bars) b JOIN hold h USING (ticker_code) GROUP BY b.date),
    theirs AS (SELECT 'benchmark' AS strategy, date, {_CASH} + sum(profit) OVER (ORDER BY date) AS value FROM hold_daily)"""


def _curve_figures(curve: str, out: str) -> str:
    return f"""{out}_r AS (SELECT *, value / coalesce(lag(value) OVER (ORDER BY date), {_CASH}) - 1 AS ret,
        max(value) OVER (ORDER BY date) AS peak FROM {curve}),
    {out}_d AS (SELECT *, (peak - value) / peak AS drawdown,
        sum(CASE WHEN peak = value THEN 1 ELSE 0 END) OVER (ORDER BY date) AS island FROM {out}_r),
    {out}_l AS (SELECT *, CAST(sum(CASE WHEN drawdown > 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY island ORDER BY date) AS BIGINT) AS dd_length FROM {out}_d),
    {out}_a AS (SELECT strategy, {_CASH}::DOUBLE AS initial_value, arg_max(value, date) AS final_value,
        min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days,
        stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) AS mean_ret, stddev_pop(ret) AS sd,
        stddev_samp(ret) FILTER (WHERE floor(ret * 1e8 + 0.5) < 0) * sqrt(252) AS down, max(drawdown) AS max_drawdown,
        max(dd_length) AS max_drawdown_duration, avg(ln(1 + ret)) AS avg_log_return FROM {out}_l GROUP BY strategy),
    {out}_b AS (SELECT *, (final_value - {_CASH}) / {_CASH} AS total_return,
        pow(greatest(final_value / {_CASH}, 0), 252.0::DOUBLE / trading_days) - 1 AS annual_return FROM {out}_a),
    {out} AS (SELECT *, coalesce((mean_ret - (pow(1.03::DOUBLE, 1.0::DOUBLE / 252) - 1)) / nullif(sd, 0) * sqrt(252), 0) AS sharpe_ratio,
        coalesce((annual_return - 0.03) / nullif(down, 0), 0) AS sortino_ratio,
        coalesce(annual_return / nullif(abs(max_drawdown), 0), 0) AS calmar_ratio FROM {out}_b)"""


def _trade_figures(trades: str, out: str) -> str:
    return f"""{out}_a AS (SELECT count(*) AS total_trades, count(*) FILTER (WHERE pnl_net >= 0) AS winning_trades,
        count(*) FILTER (WHERE pnl_net < 0) AS losing_trades, coalesce(avg(pnl_net), 0) AS avg_trade_pnl,
        coalesce(avg(pnl_net) FILTER (WHERE pnl_net >= 0), 0) AS avg_winning_pnl,
        coalesce(avg(pnl_net) FILTER (WHERE pnl_net < 0), 0) AS avg_losing_pnl,
        coalesce(sum(pnl_net) FILTER (WHERE pnl_net >= 0) / abs(sum(pnl_net) FILTER (WHERE pnl_net < 0)), 0) AS profit_factor,
        coalesce(avg(pnl_net) * sqrt(count(*)) / nullif(stddev_pop(pnl_net), 0), 0) AS sqn FROM {trades}),
    {out}_b AS (SELECT *, coalesce(winning_trades / nullif(total_trades, 0)::DOUBLE, 0) AS win_rate FROM {out}_a),
    {out} AS (SELECT *, win_rate * avg_winning_pnl / {_CASH} - (1 - win_rate) * abs(avg_losing_pnl) / {_CASH} AS expectancy
        FROM {out}_b)"""


_WHOLE = {
    "max_drawdown_duration", "total_trades", "winning_trades", "losing_trades", "trading_days",
    "start_date", "end_date",
}


def _metric_list(names: list[str]) -> str:
    return ", ".join(n if n in _WHOLE else r4(n) for n in names)


_NO_TRADES = "none AS (SELECT 0.0::DOUBLE AS pnl_net WHERE FALSE)"
_RECURSIVE = "WITH RECURSIVE"
_BOTH = f"""{_RECURSIVE} {_POSITIONS}, {_STRATEGY_CURVE}, {_HOLD_CURVE}, {_NO_TRADES},
    {_curve_figures('mine', 'mc')}, {_curve_figures('theirs', 'tc')}, {_trade_figures('closed', 'mt')},
    {_trade_figures('none', 'tt')}"""


def _versus() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, a.{m}::DOUBLE AS s, b.{m}::DOUBLE AS t FROM va a, vb b" for m in VERSUS_METRICS
    )
    return f"""{_BOTH}, va AS (SELECT * FROM mc, mt), vb AS (SELECT * FROM tc, tt),
        pairs AS ({rows} UNION ALL SELECT 'alpha', a.total_return, b.total_return FROM va a, vb b)
        SELECT metric, {r4('s', 'strategy')}, {r4('t', 'benchmark')}, {r4('s - t', 'difference')} FROM pairs"""


def _rule_scored() -> str:
    return f"""{_RULE}, {_LABELS.format('rule')},
        scored AS (SELECT * FROM labelled WHERE raw IS NOT NULL AND label IS NOT NULL)"""


def _report(scored: str) -> str:
    """Precision, recall and F1 of ``raw`` against the label, written out per class."""
    def measures(cls: str) -> str:
        return f"""SELECT '{cls}' AS row, count(*) FILTER (WHERE label = {cls}) AS support,
            coalesce(count(*) FILTER (WHERE label = {cls} AND raw = {cls})::DOUBLE / nullif(count(*) FILTER (WHERE raw = {cls}), 0), 0) AS precision,
            coalesce(count(*) FILTER (WHERE label = {cls} AND raw = {cls})::DOUBLE / nullif(count(*) FILTER (WHERE label = {cls}), 0), 0) AS recall,
            FROM scored"""

    kinds = " UNION ALL ".join(
        f"SELECT '{kind} avg', {', '.join(how.format(m) for m in ('precision', 'recall', 'f1'))}, CAST(sum(support) AS BIGINT) FROM per"
        for kind, how in (("macro", "avg({})"), ("weighted", "sum({} * support) / sum(support)"))
    )
    return f"""WITH {scored},
        classes AS ({measures('0')} UNION ALL {measures('1')}),
        per AS (SELECT row, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM classes),
        hits AS (SELECT avg(CASE WHEN raw = label THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n FROM scored),
        lines AS (SELECT * FROM per UNION ALL SELECT 'accuracy', share, share, share, n FROM hits UNION ALL {kinds})
        SELECT row, {_pick(['precision', 'recall', 'f1'])}, support FROM lines"""


def _pair_model() -> str:
    """A logistic model of two standardised features by eight Newton steps, then the scores ``p``.

    ``h..`` is the curvature and ``g.`` the slope of the summed loss with half the squared coefficients added.
    """
    a, b = catalog.PAIR
    score = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(b0 + b1 * za + b2 * zb)))"
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for i in range(8):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT b0, b1, b2, sum(p - label) AS g0, sum((p - label) * za) + b1 AS g1,
            sum((p - label) * zb) + b2 AS g2, sum(v) AS h00, sum(v * za) AS h01, sum(v * zb) AS h02,
            sum(v * za * za) + 1 AS h11, sum(v * za * zb) AS h12, sum(v * zb * zb) + 1 AS h22
            FROM (SELECT *, p * (1 - p) AS v FROM (SELECT *, {score} AS p FROM fed, w{i})) GROUP BY b0, b1, b2)""")
        steps.append(f"""w{i + 1} AS MATERIALIZED (SELECT
            b0 - ((h11 * h22 - h12 * h12) * g0 + (h02 * h12 - h01 * h22) * g1 + (h01 * h12 - h02 * h11) * g2) / det AS b0,
            b1 - ((h02 * h12 - h01 * h22) * g0 + (h00 * h22 - h02 * h02) * g1 + (h01 * h02 - h00 * h12) * g2) / det AS b1,
            b2 - ((h01 * h12 - h02 * h11) * g0 + (h01 * h02 - h00 * h12) * g1 + (h00 * h11 - h01 * h01) * g2) / det AS b2
            FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det
                FROM s{i}))""")
    return f"""{_IND}, whole AS (SELECT ticker_code, date, close, adj_close, {a}, {b} FROM ind WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
        {_LABELS.format('whole')},
        scale AS (SELECT avg({a}) AS ma, stddev_pop({a}) AS sa, avg({b}) AS mb, stddev_pop({b}) AS sb FROM labelled WHERE label IS NOT NULL),
        scaled AS MATERIALIZED (SELECT ticker_code, date, close, label, ({a} - ma) / sa AS za, ({b} - mb) / sb AS zb FROM labelled, scale),
        fed AS MATERIALIZED (SELECT * FROM scaled WHERE label IS NOT NULL), {', '.join(steps)},
        pair_scores AS MATERIALIZED (SELECT *, {score} AS p FROM scaled, w8)"""


_PAIR_SIGNALS = f"""{_pair_model()}, sig AS MATERIALIZED (
    SELECT ticker_code, date, close, row_number() {_LAG} AS k, CAST(p >= 0.57 AS INTEGER) AS signal FROM pair_scores)"""


def _standardized(names: list[str]) -> str:
    cols = ", ".join(r4(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()", f"z_{n}") for n in names)
    complete = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"WITH {_IND} SELECT ticker_code, date, {cols} FROM ind WHERE {complete}"


def _fold_statistics(names: list[str]) -> str:
    complete = " AND ".join(f"{n} IS NOT NULL" for n in names)
    sides = " UNION ALL ".join(f"""SELECT b.fold, '{c}' AS feature, count(*) AS n_rows, {r4(f'avg(r.{c})', 'mean')},
        {r4(f'stddev_pop(r.{c})', 'deviation')} FROM folded r JOIN later b ON r.fold < b.fold GROUP BY 1""" for c in names)
    return f"""WITH {_BARS}, s1 AS (SELECT *, row_number() {_LAG} AS k, avg(adj_close) {_W} AS mean_to FROM bars),
        s2 AS (SELECT ticker_code, date, {_ema(5)} AS ma_5, {_ema(20)} AS ma_20, {_full('avg(adj_close)', 20)} AS bb_mid FROM s1),
        folded AS MATERIALIZED (SELECT *, {_FOLD} AS fold FROM (SELECT *, {_PLACED} FROM s2 WHERE {complete})),
        later AS (SELECT DISTINCT fold FROM folded WHERE fold > 0) {sides}"""


_MODEL_FEATURES = catalog.training.FEATURES
_COMPLETE = f"""{_IND}, {_LABELS.format('ind')}, complete AS MATERIALIZED (SELECT ticker_code, date, label FROM labelled
    WHERE label IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _MODEL_FEATURES)})"""


def _certificate(counted: str) -> str:
    """What the best coefficients of a model have in common: no slope in any of them, on all rows it was fitted on."""
    names = ", ".join(f"('{c}')" for c in ("intercept", *_MODEL_FEATURES))
    return f"""WITH {_COMPLETE}, c AS ({counted}) SELECT name, 0.0::DOUBLE AS gradient, n_rows FROM (VALUES {names}) v(name), c"""


def statements() -> dict[str, str]:
    seen = f"""seen AS (SELECT DISTINCT ticker_code FROM ticks UNION SELECT ticker_code FROM event_ticks)"""
    variants = """variants AS (SELECT DISTINCT ticker_code AS code FROM ticks
        UNION ALL SELECT DISTINCT lower(ticker_code) FROM ticks UNION ALL SELECT DISTINCT ticker_code || '.UW' FROM ticks)"""
    renames = f"""{_TICKS}, {_EVENTS}, {_TICKERS}, {seen}, renames AS (
        SELECT s.ticker_code, CASE WHEN s.ticker_code LIKE '%.KS' THEN t.name ELSE 'Name of ' || s.ticker_code END AS name
        FROM seen s LEFT JOIN tickers t USING (ticker_code))"""
    asked = f"""{_TICKS}, {_EVENTS}, {_TICKERS}, asked AS (
        SELECT ticker_code FROM tickers UNION SELECT ticker_code FROM event_ticks)"""
    named = ["ma_5", "bb_mid", "obv"]
    sql = {
        "bars_daily": f"WITH {_BARS} SELECT {_PRICES} FROM bars",
        "bars_weekly": f"WITH {_TICKS}, b AS ({_resampled('CAST(date_trunc($$week$$, ts) AS DATE)')}) SELECT {_PRICES} FROM b".replace("$$", "'"),
        "bars_monthly": f"WITH {_TICKS}, b AS ({_resampled('CAST(date_trunc($$month$$, ts) AS DATE)')}) SELECT {_PRICES} FROM b".replace("$$", "'"),
        "bars_rolled_up": f"""WITH {_BARS}, b AS (SELECT ticker_code, CAST(date_trunc('week', bars.date) AS DATE) AS date,
            arg_min(open, bars.date) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.date) AS close,
            CAST(sum(volume) AS BIGINT) AS volume, arg_max(adj_close, bars.date) AS adj_close FROM bars GROUP BY 1, 2)
            SELECT {_PRICES} FROM b""",
        "event_bars": f"WITH {_EVENTS}, b AS ({_resampled('CAST(ts AS DATE)', 'event_ticks')}) SELECT {_PRICES} FROM b",
        "normalized_columns": f"""SELECT o_orderkey AS order_key, o_orderstatus AS order_status,
            {r4('o_totalprice', 'total_price')} FROM orders""",
        "bar_scan": f"""WITH {_BARS} SELECT {_PRICES} FROM bars WHERE (ticker_code LIKE '%.KS' OR ticker_code LIKE '%.KQ')
            AND date >= {_START} AND date < {_END}""",
        "price_range_scan": f"WITH {_BARS} SELECT {_PRICES} FROM bars WHERE date BETWEEN {_START} AND {_END}",
        "indicator_range_scan": _indicators(["ma_20", "rsi", "obv"], f"date >= {_START}"),
        "period_scan": f"""WITH {_BARS} SELECT {_PRICES} FROM bars
            WHERE date BETWEEN CAST(DATE '{catalog.NOW}' - INTERVAL 18 MONTH AS DATE) AND DATE '{catalog.NOW}'""",
        "ticker_metadata": f"WITH {_TICKERS} SELECT ticker_code, name, market, sector FROM tickers",
        "listing_scan": f"WITH {_LISTING} SELECT * FROM listing",
        "market_inference": f"WITH {_TICKS}, {variants} SELECT code, {_market('code')} AS market FROM variants",
        "exchange_inference": f"WITH {_TICKS}, {variants} SELECT code, {_exchange('code')} AS exchange FROM variants",
        "korean_listing": f"""WITH {_LISTING} SELECT trim(symbol) || {_KOREAN_SUFFIX} AS ticker_code, pos FROM listing
            WHERE exchange = 'KRX' AND {_USABLE}""",
        "korean_listing_plain": f"WITH {_LISTING} SELECT trim(symbol) AS ticker_code, pos FROM listing WHERE exchange = 'KRX' AND {_USABLE}",
        "plain_listing": f"WITH {_LISTING} SELECT trim(symbol) AS ticker_code, pos FROM listing WHERE exchange <> 'KRX' AND trim(symbol) <> ''",
        "market_prefix_listing": f"WITH {_LISTING} SELECT * FROM listing WHERE upper(market) LIKE 'KOSDAQ%'",
        "market_suffix_codes": f"""WITH {_LISTING} SELECT trim(symbol) || CASE WHEN upper(market) = 'KOSPI' THEN '.KS' ELSE '.KQ' END
            AS ticker_code, pos FROM listing""",
        "universe": f"WITH {_universe([_KOREAN[0], *_KRX, *_US])} SELECT * FROM universe",
        "universe_head": f"""WITH {_universe([*_KRX, *_KOREAN, *_SP500, *_US])}
            SELECT * FROM universe ORDER BY rank, pos, ticker_code LIMIT 20""",
        "tickers_by_exchange": f"WITH {_SYMBOLS} SELECT exchange, pos, ticker_code FROM symbols",
        "upsert_prices": f"WITH {_BARS}, {_OLD}, {_NEW} {_merged('new')}",
        "insert_ignore_prices": f"WITH {_BARS}, {_OLD}, {_NEW} {_merged('new', 'o')}",
        "upsert_counts": f"""WITH {_BARS}, {_OLD}, {_NEW} SELECT n.ticker_code, count(*) AS rows_in,
            count(*) FILTER (WHERE o.ticker_code IS NULL) AS rows_inserted,
            count(*) FILTER (WHERE o.ticker_code IS NOT NULL AND (n.close IS DISTINCT FROM o.close
                OR n.adj_close IS DISTINCT FROM o.adj_close)) AS rows_changed
            FROM new n LEFT JOIN old o ON o.ticker_code = n.ticker_code AND o.date = n.date GROUP BY 1""",
        "upsert_partial_indicators": f"""WITH {_THREE}, o AS (SELECT * FROM three WHERE date <= {_OLD_END}),
            n AS (SELECT * FROM three WHERE date >= {_NEW_START})
            SELECT coalesce(n.ticker_code, o.ticker_code) AS ticker_code, coalesce(n.date, o.date) AS date,
                {r4('o.ma_5', 'ma_5')}, {r4('CASE WHEN n.ticker_code IS NULL THEN o.bb_mid ELSE n.bb_mid * 2 END', 'bb_mid')},
                {r4('n.obv', 'obv')}, CASE WHEN o.ticker_code IS NULL THEN 'v1.0' ELSE 'v0.9' END AS calculated_version
            FROM o FULL JOIN n ON n.ticker_code = o.ticker_code AND n.date = o.date""",
        "latest_price_per_key": f"""WITH {_BARS}, {_OLD}, {_NEW}, batch AS (SELECT *, 1 AS seq FROM old UNION ALL BY NAME SELECT *, 2 AS seq FROM new)
            SELECT {_PRICES} FROM (SELECT *, row_number() OVER (PARTITION BY ticker_code, date ORDER BY seq DESC) AS place FROM batch)
            WHERE place = 1""",
        "repeated_keys": f"""WITH {_TICKS} SELECT ticker_code, CAST(ts AS DATE) AS date, count(*) AS n_rows FROM ticks
            GROUP BY 1, 2 HAVING count(*) > 1""",
        "ticker_get_or_create": f"""WITH {_TICKS}, {_EVENTS}, {_TICKERS}, {seen} SELECT * FROM tickers UNION ALL
            SELECT ticker_code, NULL, {_market('ticker_code')}, NULL FROM seen
            WHERE ticker_code NOT IN (SELECT ticker_code FROM tickers)""",
        "ticker_update": f"""WITH {renames} SELECT t.ticker_code,
            CASE WHEN r.ticker_code IS NOT NULL THEN r.name ELSE t.name END AS name, t.market, t.sector
            FROM tickers t LEFT JOIN renames r USING (ticker_code)""",
        "ticker_changes": f"""WITH {renames} SELECT t.ticker_code FROM tickers t JOIN renames r USING (ticker_code)
            WHERE t.name IS DISTINCT FROM r.name""",
        "cascade_delete": f"WITH {_BARS} SELECT {_PRICES} FROM bars WHERE ticker_code NOT LIKE '%.T'",
        "numeric_clean": f"""SELECT event_id, TRY_CAST(regexp_extract(props, ': (\\d+)', 1) AS DOUBLE) AS k,
            CASE WHEN event_id % 2 = 1 THEN value END AS v FROM events""",
        "price_ticker_join": f"""WITH {_BARS}, {_TICKERS} SELECT {_PRICES}, name, market, sector FROM bars
            JOIN tickers USING (ticker_code)""",
        "price_indicator_join": f"WITH {_IND} SELECT {_PRICES}, {_pick(['ma_20', 'bb_pct'])} FROM ind WHERE date >= {_NEW_START}",
        "price_indicator_view": "WITH " + _IND + " SELECT ticker_code, date, " + r4("close") + ", " + ", ".join(
            r4(f"CASE WHEN date >= {_NEW_START} THEN {c} END", c) for c in ("ma_20", "ma_60", "bb_mid", "obv")
        ) + " FROM ind WHERE ticker_code NOT LIKE '%-USD%'",
        "exchange_sessions": f"WITH {_SESSIONS} SELECT exchange, date FROM sessions WHERE exchange IS NOT NULL",
        "holiday_list": f"WITH {_TICKS}, {_ALL_SESSIONS}, {_HOLIDAYS} SELECT s.* FROM all_sessions s JOIN holidays h USING (exchange, date)",
        "gap_fill": f"WITH {_SESSIONS}, {_filled('bars', False)} SELECT {_PRICES} FROM filled",
        "gap_fill_sessions_only": f"WITH {_SESSIONS}, {_filled('bars', True)} SELECT {_PRICES} FROM filled",
        "missing_sessions": f"WITH {_SESSIONS}, {_filled('bars', True)} SELECT ticker_code, date FROM filled WHERE close IS NULL",
        "short_coverage": f"""WITH {_SESSIONS}, span AS (SELECT ticker_code, {_exchange('ticker_code')} AS exchange, min(date) AS first_bar,
                max(date) AS last_bar, count(*) AS n_bars FROM bars WHERE date BETWEEN {_START} AND {_END} GROUP BY 1),
            want AS (SELECT exchange, min(date) AS first_session, max(date) AS last_session FROM sessions
                WHERE date BETWEEN {_START} AND {_END} GROUP BY 1)
            SELECT s.*, w.first_session, w.last_session FROM span s JOIN want w USING (exchange)
            WHERE first_bar <> first_session OR last_bar <> last_session""",
        "failed_tickers": f"WITH {asked} SELECT ticker_code FROM asked EXCEPT SELECT ticker_code FROM ticks",
        "unknown_exchange_tickers": f"""WITH {_TICKS} SELECT DISTINCT ticker_code, {_exchange('ticker_code')} AS exchange FROM ticks
            WHERE {_exchange('ticker_code')} IS NOT NULL""",
        "stage_counts": f"""WITH {_BARS} SELECT ticker_code, fetched, saved, coalesce(recent, 0) AS recent FROM
            (SELECT ticker_code, count(*) AS fetched FROM ticks GROUP BY 1) JOIN
            (SELECT ticker_code, count(*) AS saved, count(*) FILTER (WHERE date >= {_NEW_START}) AS recent FROM bars GROUP BY 1)
            USING (ticker_code)""",
        "stage_totals": f"""WITH {_BARS} SELECT (SELECT count(*) FROM ticks) AS fetched, count(*) AS saved,
            count(*) FILTER (WHERE date >= {_NEW_START}) AS recent FROM bars""",
        "success_rate": f"""WITH {asked}, got AS (SELECT DISTINCT ticker_code FROM ticks) SELECT count(*) AS requested,
            count(g.ticker_code) AS obtained, {r4('count(g.ticker_code) * 100.0::DOUBLE / count(*)', 'success_rate')}
            FROM asked a LEFT JOIN got g USING (ticker_code)""",
        "null_counts": f"""WITH {_SESSIONS}, {_filled('bars', False)} SELECT count(*) AS n_rows, 0::BIGINT AS ticker_code, 0::BIGINT AS date,
            {', '.join(f'count(*) - count({c}) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'adj_close'))} FROM filled""",
        "null_profile": f"""WITH {_SESSIONS}, {_filled('bars', False)} SELECT ticker_code, 6 * (count(*) - count(close)) AS null_cells,
            8 * count(*) AS cells, {r4('600.0::DOUBLE * (count(*) - count(close)) / (8 * count(*))', 'null_pct')} FROM filled GROUP BY 1""",
        "series_check": f"""WITH {_TICKS}, m AS (SELECT *, CAST(ts AS DATE) AS date,
                CAST(ts AS DATE) < lag(CAST(ts AS DATE)) OVER (PARTITION BY ticker_code ORDER BY seq, CAST(ts AS DATE)) AS late FROM ticks)
            SELECT ticker_code, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) - count(DISTINCT date) AS repeated,
            count(*) FILTER (WHERE late) AS out_of_order FROM m GROUP BY 1""",
        "adjusted_bars": f"""WITH {_BARS} SELECT ticker_code, date, {r4('high * (adj_close / close)', 'adj_high')},
            {r4('low * (adj_close / close)', 'adj_low')}, {r4('volume / (adj_close / close)', 'adj_volume')} FROM bars""",
        "ema_all": _indicators([f"ma_{n}" for n in (5, 10, 20, 50, 60, 100, 120, 200)]),
        "sma": f"WITH {_IND} SELECT ticker_code, date, {r4('bb_mid', 'sma_20')} FROM ind",
        "macd": _indicators(["macd", "macd_signal", "macd_hist"]),
        "rsi": _indicators(["rsi"]),
        "bollinger": _indicators(["bb_upper", "bb_mid", "bb_lower", "bb_pct"]),
        "true_range": f"WITH {_IND} SELECT ticker_code, date, {r4('tr', 'true_range')} FROM ind",
        "atr": _indicators(["atr"]),
        "log_return": f"WITH {_IND} SELECT ticker_code, date, {r4('lr', 'log_ret')} FROM ind",
        "hv": _indicators(["hv"]),
        "stochastic": _indicators(["stoch_k", "stoch_d"]),
        "obv": _indicators(["obv"]),
        "all_indicators": _indicators(INDICATOR_NAMES),
        "all_indicators_blocked": _indicators(INDICATOR_NAMES),
        "forward_label": f"WITH {_LABELLED} SELECT ticker_code, date, label FROM labelled",
        "label_balance": f"""WITH {_LABELLED} SELECT count(label) AS n_rows, {r4('avg(label)', 'up_share')},
            {r4('1 - avg(label)', 'down_share')} FROM labelled""",
        "class_weights": f"""WITH {_LABELLED} SELECT label, count(*) AS n_rows,
            {r4('sum(count(*)) OVER () / (2.0::DOUBLE * count(*))', 'weight')} FROM labelled WHERE label IS NOT NULL GROUP BY label""",
        "training_rows": f"""WITH {_IND}, {_LABELS.format('ind')} SELECT ticker_code, date, {_pick(['ma_5', 'ma_50'])}, label
            FROM labelled WHERE ma_5 IS NOT NULL AND ma_50 IS NOT NULL AND label IS NOT NULL""",
        "chrono_split": f"""WITH {_RANKED} SELECT ticker_code, date,
            CASE WHEN place <= n - CAST(ceil(0.2 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ranked""",
        "ts_folds": f"""WITH {_RANKED} SELECT ticker_code, date, CAST(greatest(0, 5 - (n - place) // (n // 6)) AS INTEGER) AS fold FROM ranked""",
        "chrono_split_sketched": f"""WITH {_BARS} SELECT count(*) AS n_rows,
            count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS wanted, TRUE AS within FROM bars""",
        "fold_statistics": _fold_statistics(["ma_5", "ma_20", "bb_mid"]),
        "model_certificate": _certificate("SELECT count(*) AS n_rows FROM complete"),
        "train_certificate": _certificate("SELECT count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_rows FROM complete"),
        "train_folds": f"""WITH {_COMPLETE}, part AS (SELECT date, ticker_code, label FROM (SELECT *, {_PLACED} FROM complete)
                WHERE place <= n - CAST(ceil(0.2 * n) AS BIGINT))
            SELECT fold, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_up
            FROM (SELECT label, {_FOLD} AS fold FROM (SELECT label, {_PLACED} FROM part)) GROUP BY 1""",
        "standardized_features": _standardized(["ma_5", "ma_20", "bb_mid"]),
        "rule_report": _report(_rule_scored()),
        "rule_accuracy": f"""WITH {_RULE}, {_LABELS.format('rule')} SELECT
            {r4('avg(CASE WHEN raw = label THEN 1.0::DOUBLE ELSE 0 END)', 'test_accuracy')}, count(*) AS n_rows
            FROM labelled WHERE raw IS NOT NULL AND label IS NOT NULL""",
        "rule_signal_density": f"""WITH {_RULE} SELECT ticker_code, count(*) FILTER (WHERE signal = 1) AS buys, count(*) AS days,
            {r4('count(*) FILTER (WHERE signal = 1)::DOUBLE / count(*)', 'density')} FROM sig GROUP BY 1""",
        "signal_join": f"""WITH {_RULE} SELECT b.ticker_code, b.date, {', '.join(r4(f'b.{c}', c) for c in ('open', 'high', 'low', 'close'))},
            b.volume, {r4('b.adj_close', 'adj_close')},
            CASE WHEN b.date >= {_NEW_START} THEN s.signal ELSE 0 END AS signal
            FROM bars b JOIN sig s USING (ticker_code, date)
            WHERE b.ticker_code IN (SELECT ticker_code FROM rule WHERE raw IS NOT NULL AND date >= {_NEW_START})""",
        "bad_signals": f"WITH {_RULE} SELECT ticker_code, date FROM rule WHERE raw IS NULL",
        "trade_log": f"{_RECURSIVE} {_POSITIONS} {_TRADES}",
        "trade_log_folded": f"{_RECURSIVE} {_POSITIONS} {_TRADES}",
        "trade_log_take_profit": f"{_RECURSIVE} {_positions(catalog.TAKE_RULES)} {_TRADES}",
        "open_positions": f"{_RECURSIVE} {_POSITIONS} SELECT ticker_code, entry_date, {r4('buy_price')}, size, holding_days FROM still",
        "trade_stats": f"""{_RECURSIVE} {_POSITIONS} SELECT count(*) AS total_trades,
            {r4('avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'win_rate')}, {r4('avg(pnl_pct)', 'avg_pnl_pct')},
            {r4('avg(holding_days)', 'avg_holding_days')} FROM closed""",
        "transactions": f"""{_RECURSIVE} {_POSITIONS}, moves AS (
                SELECT ticker_code, entry_date AS date, size AS amount, buy_price AS price FROM held
                UNION ALL SELECT ticker_code, exit_date, -size, sell_price FROM held WHERE exit_date IS NOT NULL)
            SELECT ticker_code, date, amount, {r4('price')}, {r4('-amount * price', 'value')} FROM moves""",
        "equal_weight_sizes": f"""WITH {_BARS} SELECT ticker_code, date,
            CAST(floor({_CASH} / (SELECT count(DISTINCT ticker_code) FROM bars) / close) AS BIGINT) AS shares FROM bars""",
        "strategy_equity": f"{_RECURSIVE} {_POSITIONS}, {_STRATEGY_CURVE} SELECT strategy, date, {r4('value')} FROM mine",
        "buy_and_hold_equity": f"WITH {_BARS}, {_HOLD_CURVE} SELECT strategy, date, {r4('value')} FROM theirs",
        "daily_returns": f"""WITH {_BARS}, {_HOLD_CURVE}, {_curve_figures('theirs', 'tc')} SELECT strategy, date,
            {r4('value', digits=8)}, {r4('ret', digits=8)} FROM tc_r""",
        "drawdown": f"""WITH {_BARS}, {_HOLD_CURVE}, {_curve_figures('theirs', 'tc')} SELECT strategy, date, {r4('value')},
            {r4('peak')}, {r4('drawdown')}, dd_length FROM tc_l""",
        "curve_metrics": f"""WITH {_BARS}, {_HOLD_CURVE}, {_curve_figures('theirs', 'tc')} SELECT strategy, {_metric_list([
            'initial_value', 'final_value', 'start_date', 'end_date', 'trading_days', 'volatility', 'max_drawdown',
            'max_drawdown_duration', 'avg_log_return', 'total_return', 'annual_return', 'sharpe_ratio', 'sortino_ratio',
            'calmar_ratio'])} FROM tc""",
        "trade_metrics": f"""{_RECURSIVE} {_POSITIONS}, {_trade_figures('closed', 'mt')} SELECT {_metric_list([
            'total_trades', 'winning_trades', 'losing_trades', 'avg_trade_pnl', 'avg_winning_pnl', 'avg_losing_pnl',
            'profit_factor', 'sqn', 'win_rate', 'expectancy'])} FROM mt""",
        "perf_metrics": f"{_BOTH} SELECT strategy, {_metric_list(METRIC_COLUMNS)} FROM mc, mt",
        "strategy_comparison": f"""{_BOTH} SELECT strategy, {_metric_list(KEY_METRICS)} FROM mc, mt
            UNION ALL SELECT strategy, {_metric_list(KEY_METRICS)} FROM tc, tt""",
        "strategy_vs_benchmark": _versus(),
    }
    sql["local_days"] = "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS date, count(*) AS n_rows FROM events GROUP BY 1"
    sql["rows_per_ticker"] = f"WITH {_TICKS} SELECT ticker_code, count(*) AS n_rows FROM ticks GROUP BY 1"
    sql["traded_sessions"] = f"WITH {_TICKS}, {_ALL_SESSIONS} SELECT * FROM all_sessions WHERE exchange IS NOT NULL"
    sql["indicator_versions"] = f"""WITH {_BARS} SELECT CASE WHEN date <= {_OLD_END} THEN 'v0.9' ELSE 'v1.0' END AS calculated_version,
        count(*) AS n_rows FROM bars GROUP BY 1"""
    sql["explicit_universe"] = f"WITH {_universe([_US[0], _KOREAN[0]])} SELECT * FROM universe"
    sql["bar_file"] = sql["bars_daily"]
    sql["listing_file"] = sql["korean_listing"]
    sql["holiday_file"] = sql["holiday_list"]
    sql["stored_prices"] = f"SELECT * EXCLUDE (retrieved_year) FROM ({sql['upsert_prices']})"
    sql["stored_new_prices"] = f"SELECT * EXCLUDE (retrieved_year) FROM ({sql['insert_ignore_prices']})"
    sql["stored_delete"] = f"{sql['stored_prices']} WHERE ticker_code NOT LIKE '%.T'"
    sql["stored_indicators"] = f"SELECT * EXCLUDE (calculated_version) FROM ({sql['upsert_partial_indicators']})"
    sql["metrics_file"] = sql["perf_metrics"]
    trimmed = ["ma_5", "macd_hist", "bb_mid"]
    sql["indicator_refresh"] = _trimmed(trimmed, 34)
    sql["indicator_refresh_nulls"] = f"""SELECT count(*) AS n_rows, 0::BIGINT AS ticker_code, 0::BIGINT AS date,
        {', '.join(f'count(*) - count({c}) AS {c}' for c in trimmed)} FROM ({sql['indicator_refresh']})"""
    sql["pair_model_scores"] = f"""WITH {_pair_model()} SELECT ticker_code, date, {r4('p', 'p1', 3)},
        CAST(p > 0.5 AS DOUBLE) AS prediction FROM pair_scores"""
    sql["saved_model_scores"] = sql["pair_model_scores"]
    sql["pair_model_signals"] = f"WITH {_PAIR_SIGNALS} SELECT ticker_code, date, signal FROM sig"
    sql["pair_model_report"] = _report(f"""{_pair_model()}, scored AS (
        SELECT label, CAST(p > 0.5 AS INTEGER) AS raw FROM pair_scores WHERE label IS NOT NULL)""")
    curve = _STRATEGY_CURVE.replace("FROM bars)", "FROM sig)")
    sql["pair_model_metrics"] = f"""{_RECURSIVE} {_positions(catalog.RULES, _PAIR_SIGNALS)}, {curve}, {_curve_figures('mine', 'mc')},
        {_trade_figures('closed', 'mt')} SELECT strategy, {_metric_list(METRIC_COLUMNS)} FROM mc, mt"""
    sql["trimmed_range_indicators"] = _trimmed(["ma_5", "macd_hist", "bb_mid"], 34)
    sql["price_refresh"] = _price_refresh()
    sql["full_refresh"] = _full_refresh()
    return sql


def _trimmed(names: list[str], lookback: int) -> str:
    """Indicators over the widened range only, cut to the asked range."""
    wide = f"{_START} - {int(lookback * 1.6) + 10}"
    return f"""WITH {_BARS}, wide AS (SELECT * FROM bars WHERE date BETWEEN {wide} AND {_END}), {_indicator_layers('wide')}
        SELECT ticker_code, date, {_pick(names)} FROM ind WHERE date >= {_START}"""


def _price_refresh() -> str:
    return f"""WITH {_SESSIONS}, {_OLD}, part AS (SELECT * FROM bars WHERE date >= {_NEW_START} AND date < {_END}),
        {_filled('part', False)} {_merged('filled')}"""


def _full_refresh() -> str:
    """EMAs and the band over priced rows of the widened, gap-filled range.

    The exponential means run over priced rows; the 20-row mean needs 20 priced rows
    in a row of the filled table.
    """
    wide = f"{_START} - {int(20 * 1.6) + 10}"
    return f"""WITH {_SESSIONS}, part AS (SELECT * FROM bars WHERE date >= {wide} AND date < {_END}), {_filled('part', False)},
        f1 AS (SELECT *, count(adj_close) {_W} AS k, avg(adj_close) {_W} AS mean_to, count(adj_close) {_frame(20)} AS n20,
            avg(adj_close) {_frame(20)} AS m20 FROM filled),
        f2 AS (SELECT *, {_null_ema(5)} AS ma_5, {_null_ema(20)} AS ma_20, CASE WHEN n20 = 20 THEN m20 END AS bb_mid FROM f1)
        SELECT {_PRICES}, {_pick(['ma_5', 'ma_20', 'bb_mid'])} FROM f2 WHERE date >= {_START}"""


def _null_ema(n: int) -> str:
    a = f"(2.0::DOUBLE / {n + 1})"
    v = f"(CASE WHEN adj_close IS NULL OR k < {n} THEN 0 WHEN k = {n} THEN mean_to ELSE {a} * adj_close END)"
    return f"CASE WHEN adj_close IS NOT NULL AND k >= {n} THEN {_decayed(v, f'(1 - {a})', 'k')} END"
