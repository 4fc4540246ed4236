"""Strategies as tables: signals, executed signals, weights, portfolio returns, sweeps, walk-forward.

There is no account simulator; a position is last bar's weight and the return is weight times move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.recursive import span, with_recursions
from barloom.functions.windows import Series, ladder, ratio

S = Series(("code",), ("date",))
c = F.col

# Default trading costs.
COMMISSION, MIN_COMMISSION, TRANSFER_FEE, STAMP_DUTY, SLIPPAGE = 0.0003, 5.0, 0.00001, 0.0005, 0.001


# ---- signals -------------------------------------------------------------------------------------

def _sign(a: Column, b: Column, first: int) -> Column:
    return F.when(S.idx() <= first, 0.0).otherwise(ladder((a > b, 1.0), (a < b, -1.0), default=0.0))


def dual_ma(short: int = 5, long: int = 20) -> Column:
    return _sign(S.mean("close", short), S.mean("close", long), long)


def rsi_reversal(panel: DataFrame, n: int = 14, low: float = 30, high: float = 70) -> DataFrame:
    """+1 oversold, -1 overbought; the mean gain counts the missing first change as 0."""
    d = panel.withColumn("_d", c("close") - S.lag("close"))
    gain = S.mean(F.when(c("_d") > 0, c("_d")).otherwise(0.0), n)
    loss = S.mean(F.when(c("_d") < 0, -c("_d")).otherwise(0.0), n)
    rsi = 100 - 100 / (1 + ratio(gain, loss))
    sig = F.when(S.idx() <= n, 0.0).otherwise(ladder((rsi < low, 1.0), (rsi > high, -1.0), default=0.0))
    return d.withColumn("sig", sig).drop("_d")


def macd_trend(panel: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    rec = [("_f", "ema", "close", span(fast)), ("_s", "ema", "close", span(slow)), ("_m", "minus", "_f", "_s"),
           ("_g", "ema", "_m", span(smooth))]
    d = with_recursions(panel, rec, order="date")
    return d.withColumn("sig", _sign(c("_m"), c("_g"), slow)).drop("_f", "_s", "_m", "_g")


# ---- tradability ---------------------------------------------------------------------------------

def board_limit(code: Column) -> Column:
    """Daily price limit by board prefix."""
    p3 = F.substring(code, 1, 3)
    return ladder((p3.isin("300", "301", "688", "689"), 0.20),
                  (code.startswith("4") | code.startswith("8") | code.startswith("92"), 0.30), default=0.10)


def with_limits(panel: DataFrame, overrides: DataFrame | None = None, symbol: str = "symbol", key: str = "code") -> DataFrame:
    """Append ratio and limit prices. ``overrides(key, ratio)`` lists special-treatment codes, each once; two codes may share a symbol."""
    r = board_limit(c(symbol))
    if overrides is not None:
        panel = panel.join(overrides.withColumnRenamed("ratio", "_o"), key, "left")
        r = F.coalesce("_o", r)
    p = panel.withColumn("ratio", r).withColumn("_pc", S.lag("close"))
    cent = lambda x: F.floor(x * 100 + 0.5) / 100
    return p.withColumn("limit_up", cent(c("_pc") * (1 + c("ratio")))).withColumn(
        "limit_down", cent(c("_pc") * (1 - c("ratio")))).drop("_o", "_pc")


def with_flags(panel: DataFrame) -> DataFrame:
    return panel.select(
        "*", (c("volume") <= 0).alias("suspended"),
        F.coalesce(c("close") >= c("limit_up") - 1e-6, F.lit(False)).alias("at_up"),
        F.coalesce(c("close") <= c("limit_down") + 1e-6, F.lit(False)).alias("at_down"))


def blocked_reason() -> Column:
    """Why the move from the previous target cannot trade on this bar."""
    prev = F.coalesce(S.lag("sig"), F.lit(0.0))
    return ladder((c("suspended"), "suspended"), (c("at_up") & (c("sig") > prev), "limit_up"),
                  (c("at_down") & (c("sig") < prev), "limit_down"))


def execute(panel: DataFrame) -> DataFrame:
    """A blocked target waits: the executed signal is the last target seen on an open bar."""
    p = panel.withColumn("blocked", blocked_reason())
    held = F.last(F.when(c("blocked").isNull(), c("sig")), ignorenulls=True).over(S.run())
    return p.withColumn("executed", F.coalesce(held, F.lit(0.0)))


def rebalance_log(executed: DataFrame) -> DataFrame:
    """Bars where the target or the executed signal moves."""
    e = executed.select("code", "date", "sig", F.coalesce(S.lag("executed"), F.lit(0.0)).alias("before"),
                        c("executed").alias("after"), "blocked")
    return e.where((c("before") != c("after")) | (c("blocked").isNotNull() & (c("sig") != c("before"))))


# ---- weights and returns -------------------------------------------------------------------------

def active_weights(signals: DataFrame, sig: str = "sig", by: Sequence[str] = ("date",)) -> DataFrame:
    """sig / number of non-zero signals of the date. Counts have one row per date."""
    n = signals.where(c(sig) != 0).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return signals.join(n, list(by), "left").withColumn(
        "weight", F.coalesce(c(sig) / c("_n"), F.lit(0.0))).drop("_n")


def trade_cost(notional: Column, is_sell: Column) -> Column:
    """Commission with its floor, transfer fee, stamp duty on sells."""
    return F.when(notional <= 0, 0.0).otherwise(
        F.greatest(notional * COMMISSION, F.lit(MIN_COMMISSION)) + notional * TRANSFER_FEE
        + F.when(is_sell, notional * STAMP_DUTY).otherwise(0.0))


def portfolio_returns(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per date: last bar's weight times the move, less proportional cost of the weight change."""
    s = Series((*by, "code"), ("date",))
    p = weights.select(*by, "date", F.coalesce(s.lag("weight"), F.lit(0.0)).alias("_w"), "weight",
                       F.coalesce(s.pct("close"), F.lit(0.0)).alias("_r"))
    move = c("weight") - c("_w")
    cost = F.abs(move) * (COMMISSION + TRANSFER_FEE + SLIPPAGE) + F.greatest(-move, F.lit(0.0)) * STAMP_DUTY
    return p.groupBy(*by, "date").agg(F.sum(c("_w") * c("_r")).alias("gross"), F.sum(cost).alias("cost")).withColumn(
        "net", c("gross") - c("cost"))


def with_nav(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """NAV along the calendar; one row per strategy and date by now."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("nav", F.exp(F.sum(growth("net")).over(w)))


def growth(ret: str) -> Column:
    """Log growth of a return; a loss of everything or more leaves a NAV of practically 0."""
    return F.log(F.greatest(1 + c(ret), F.lit(1e-12)))


def performance(returns: DataFrame, by: Sequence[str] = ("strategy",), year: int = 252) -> DataFrame:
    """Total, annual, Sharpe, worst drawdown, daily win rate, days. The first date only sets positions."""
    nav = with_nav(returns, by)
    order = Window.partitionBy(*by).orderBy("date")
    peak = F.greatest(F.lit(1.0), F.max("nav").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = nav.select(*by, "net", (c("nav") / peak - 1).alias("_dd"), F.row_number().over(order).alias("_i"), "nav", "date")
    live = c("_i") > 1
    m = d.groupBy(*by).agg(
        (F.max_by("nav", "date") - 1).alias("_t"), F.min("_dd").alias("_dd"), F.count(F.when(live, 1)).alias("n_days"),
        F.avg(F.when(live, c("net"))).alias("_m"), F.stddev_samp(F.when(live, c("net"))).alias("_s"),
        F.avg(F.when(live, (c("net") > 0).cast("double"))).alias("_win"))
    return m.select(
        *by, (c("_t") * 100).alias("total_return_pct"),
        ((F.pow(1 + c("_t"), F.lit(float(year)) / F.greatest(c("n_days"), F.lit(1))) - 1) * 100).alias("annual_return_pct"),
        F.when(c("_s") > 0, c("_m") / c("_s") * (year ** 0.5)).otherwise(0.0).alias("sharpe_ratio"),
        (c("_dd") * 100).alias("max_drawdown_pct"), (c("_win") * 100).alias("win_rate_pct"), "n_days")


def rate_strategy(metrics: DataFrame) -> DataFrame:
    """60 less 30 / 10 / 5 for no trades, heavy loss, deep drawdown; pass at 60."""
    no_trades, loss = c("trade_count") == 0, c("total_return_pct") < -20
    deep, dull = c("max_drawdown_pct") < -30, c("sharpe_ratio") < 0.5
    score = F.lit(60) - F.when(no_trades, 30).otherwise(0) - F.when(loss, 10).otherwise(0) - F.when(deep, 5).otherwise(0)
    issues = F.filter(F.array(F.when(no_trades, "no_trades"), F.when(loss, "heavy_loss"), F.when(deep, "deep_drawdown"),
                              F.when(dull, "low_sharpe")), lambda x: x.isNotNull())
    return metrics.select("*", score.alias("rating"), (score >= 60).alias("passed"), F.concat_ws(",", issues).alias("issues"))


# ---- parameter sweep -----------------------------------------------------------------------------

def ma_grid_states(panel: DataFrame, grid: Sequence[tuple[int, int]]) -> DataFrame:
    """(pid, date, pdate, sig, psig, n, sum_r) for every (short, long) pair of the grid.

    Every window length is averaged once per code; the pairs are expanded per row and counted
    map-side by (date, signal, previous signal), so the shuffle carries counts, not the market
    times the grid.
    """
    lengths = sorted({x for pair in grid for x in pair})
    p = panel.select("date", "code", "close", S.idx().alias("_i"), S.lag("date").alias("pdate"),
                     F.coalesce(S.pct("close"), F.lit(0.0)).alias("_r"),
                     # rows up to the longer window are forced to 0 below, so no count gate is needed here
                     *[F.avg("close").over(S.trail(n)).alias(f"_m{n}") for n in lengths])

    def sig(a, b):
        return F.when(c("_i") <= b, 0.0).otherwise(ladder((c(f"_m{a}") > c(f"_m{b}"), 1.0), (c(f"_m{a}") < c(f"_m{b}"), -1.0), default=0.0))

    p = p.select("date", "code", "pdate", "_r", F.array(*[sig(a, b) for a, b in grid]).alias("sig"))
    flat = F.array_repeat(F.lit(0.0), len(grid))
    p = p.select("date", "pdate", "_r", F.arrays_zip("sig", F.coalesce(S.lag("sig"), flat).alias("psig")).alias("_p"))
    rows = p.select("date", "pdate", "_r", F.posexplode("_p").alias("pid", "_q")).select(
        "pid", "date", "pdate", "_r", "_q.sig", "_q.psig")
    return rows.groupBy("pid", "date", "pdate", "sig", "psig").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("sum_r"))


def returns_from_states(states: DataFrame) -> DataFrame:
    """Portfolio return per (pid, date) from signal-transition counts, in one pass.

    The active count of a row's previous date is met by sending each row to both of its dates.
    """
    active = F.when(c("sig") != 0, c("n"))
    s = states.withColumn("na", F.sum(active).over(Window.partitionBy("pid", "date")))
    both = s.select("*", F.inline(F.array(F.struct(c("date").alias("_key"), F.lit(False).alias("_row")), F.struct(c("pdate").alias("_key"), F.lit(True).alias("_row")))))
    both = both.withColumn("np", F.sum(F.when(~c("_row"), active)).over(Window.partitionBy("pid", "_key"))).where("_row")
    w, pw = F.coalesce(c("sig") / c("na"), F.lit(0.0)), F.coalesce(F.when(c("pdate").isNotNull(), c("psig") / c("np")), F.lit(0.0))
    move = w - pw
    cost = c("n") * (F.abs(move) * (COMMISSION + TRANSFER_FEE + SLIPPAGE) + F.greatest(-move, F.lit(0.0)) * STAMP_DUTY)
    return both.groupBy("pid", "date").agg(F.sum(pw * c("sum_r")).alias("gross"), F.sum(cost).alias("cost")).withColumn(
        "net", c("gross") - c("cost"))


def sweep(panel: DataFrame, grid: Sequence[tuple[int, int]], metric: str = "sharpe_ratio") -> DataFrame:
    """Metrics of every parameter pair with its place by ``metric`` (at most one row per pair)."""
    names = panel.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(grid)], "pid int, short int, long int")
    m = performance(returns_from_states(ma_grid_states(panel, grid)), ("pid",))
    return m.join(F.broadcast(names), "pid").withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round(metric, 9)), "pid")))


# ---- walk-forward --------------------------------------------------------------------------------

def walk_forward(returns: DataFrame, train: int = 120, test: int = 20) -> DataFrame:
    """Per window: the parameter with the best training Sharpe and its return on the next ``test`` dates.

    ``returns(pid, date, net)`` holds signals that use history only, so slicing dates is enough. The
    windows of a date follow from its index by arithmetic; no range join is needed. As each slice
    starts flat, its first date earns nothing.
    """
    days = returns.select("date").distinct()    # the calendar; returns only join it
    days = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("_i"), (F.count(F.lit(1)).over(Window.partitionBy()) - 1).alias("_max"))
    r = returns.select("pid", "date", "net").join(days, "date")
    n_win = F.floor((c("_max") + 1 - train) / test)
    lo = F.greatest(F.ceil((c("_i") - (train - 1)) / test), F.lit(0))
    hi = F.least(F.floor(c("_i") / test), n_win - 1)
    mine = F.floor((c("_i") - train) / test)
    roles = F.concat(
        F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: F.struct(k.alias("win"), F.lit(True).alias("fit")))).otherwise(F.array()),
        F.when((c("_i") >= train) & (mine < n_win), F.array(F.struct(mine.alias("win"), F.lit(False).alias("fit")))).otherwise(F.array()))
    e = r.select("pid", "net", "_i", F.inline(roles))
    start = c("win") * test + F.when(c("fit"), 0).otherwise(train)
    g = e.where(c("_i") > start).groupBy("win", "pid").agg(
        F.avg(F.when(c("fit"), c("net"))).alias("_m"), F.stddev_samp(F.when(c("fit"), c("net"))).alias("_s"),
        (F.exp(F.sum(F.when(~c("fit"), growth("net")))) - 1).alias("test_return"))
    sharpe = F.when(c("_s") > 0, c("_m") / c("_s") * (252 ** 0.5)).otherwise(0.0)
    w = Window.partitionBy("win").orderBy(F.desc(F.round("train_sharpe", 9)), "pid")
    out = g.select("win", "pid", sharpe.alias("train_sharpe"), "test_return").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return out.withColumn("oos_equity", F.exp(F.sum(growth("test_return")).over(
        Window.orderBy("win").rowsBetween(Window.unboundedPreceding, 0))))


def parameter_votes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("pid").agg(F.count(F.lit(1)).alias("times"), F.sum((c("test_return") > 0).cast("int")).alias("wins"))
