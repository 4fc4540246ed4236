"""Statements, valuation, ownership and expectations.

Statements are long tables keyed by (code, end_date). ``latest`` rows are picked by a trailing
window; history per code is bounded by the number of reporting periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranking import average_rank, quantiles
from barloom.functions.sums import exact_sum
from barloom.functions.windows import Series, ladder, ratio
from barloom.session import cut

c = F.col
S = Series(("code",), ("end_date",))
D = Series(("code",), ("date",))


def latest(df: DataFrame, n: int = 1, keys: Sequence[str] = ("code",), order: str = "end_date") -> DataFrame:
    """The last n periods of every code."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n).drop("_r")


def count_true(*conds: Column) -> Column:
    return sum((F.when(x, 1).otherwise(0) for x in conds), F.lit(0))


# ---- joins ---------------------------------------------------------------------------------------

def join_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame, n: int = 4) -> DataFrame:
    """Three statements on (code, end_date), last n periods. All joins share one key, hence one shuffle each."""
    return latest(income.join(balance, ["code", "end_date"]).join(cashflow, ["code", "end_date"]), n)


def point_in_time(prices: DataFrame, statements: DataFrame, fields: Sequence[str]) -> DataFrame:
    """For every (code, date) the newest statement announced by then (as-of by union and fill)."""
    st = statements.select("code", c("ann_date").alias("date"), F.struct("end_date", *fields).alias("_s"), F.lit(0).alias("_k"))
    px = prices.withColumn("_k", F.lit(1))
    both = px.unionByName(st, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("date", "_k", "_s.end_date").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_f", F.last("_s", ignorenulls=True).over(w)).where("_k = 1")
    return out.select(*prices.columns, "_f.*")


# ---- statement analysis --------------------------------------------------------------------------

def statement_checks(st: DataFrame) -> DataFrame:
    """Latest period: profit to equity, accruals, cash flow against cash."""
    roe = ratio("n_income_attr_p", "equity")
    acc = ratio(c("n_income") - c("cfo"), "total_assets")
    cash = ladder(((c("cfo") > 0) & (c("money_cap") > 0), "ok"),
                  ((c("cfo") < 0) & (c("money_cap") > c("total_assets") * 0.3), "warning"), default="info")
    d = latest(st).select("code", "end_date", roe.alias("equity_ratio"), acc.alias("accrual_ratio"),
                          F.when((roe > 0) & (roe < 0.5), "ok").otherwise("warning").alias("equity_check"),
                          F.when(F.abs(acc) < 0.1, "ok").otherwise("warning").alias("accrual_check"), cash.alias("cash_check"))
    return d.withColumn("warnings", count_true(*[c(x) == "warning" for x in ("equity_check", "accrual_check", "cash_check")]))


def with_changes(st: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Append previous value p_x and growth g_x of each column."""
    return st.select("*", *[S.lag(x).alias(f"p_{x}") for x in cols], *[(ratio(x, S.lag(x)) - 1).alias(f"g_{x}") for x in cols])


def earnings_quality(st: DataFrame) -> DataFrame:
    """Five 1..3 items weighted .25/.20/.20/.20/.15 on the latest period."""
    d = with_changes(st, ["revenue", "accounts_receiv"]).select(
        "*", S.idx().alias("_n"), (c("cfo") - S.lag("cfo")).alias("_dc"),
        F.avg((c("cfo") > 0).cast("double")).over(S.trail(4)).alias("_pos"),
        (ratio("total_cogs", "inventories") - ratio(S.lag("total_cogs"), S.lag("inventories"))).alias("_dt"))
    d = latest(d)
    ni, cfo = c("n_income_attr_p"), c("cfo")
    cash = ladder(((ni > 0) & (ratio(cfo, ni) > 1.2), 3), ((ni > 0) & (ratio(cfo, ni) > 0.8), 2), (ni > 0, 1),
                  ((ni < 0) & (cfo > 0), 2), (ni < 0, 1), default=2)
    gr, ga = c("g_revenue"), c("g_accounts_receiv")
    recv = ladder((gr.isNull() | ga.isNull(), 2), (ga < gr, 3), (ga < gr * 1.5, 2), default=1)
    extra = c("excite_income") - c("excite_tax")
    core = ratio(ni - extra, ni)
    core_s = ladder(((ni == 0) | (extra == 0), 2), (core > 0.9, 3), (core > 0.7, 2), default=1)
    trend = ladder((c("_n") < 2, 2), ((c("_pos") == 1) & (c("_dc") > 0), 3), (c("_pos") >= 0.5, 2), default=1)
    inv = ladder((c("_dt").isNull(), 2), (c("_dt") > 0, 3), (F.abs("_dt") < 0.1, 2), default=1)
    d = d.select("code", "end_date", cash.alias("cash_item"), recv.alias("receivable_item"), core_s.alias("core_item"),
                 trend.alias("trend_item"), inv.alias("inventory_item"))
    # whole twentieths keep the sum exact at the band edges
    total = (c("cash_item") * 5 + (c("receivable_item") + c("core_item") + c("trend_item")) * 4 + c("inventory_item") * 3) / 20
    return d.withColumn("quality", total).withColumn("quality_level", ladder(
        (c("quality") >= 2.5, "excellent"), (c("quality") >= 2.0, "good"), (c("quality") >= 1.5, "fair"), default="poor"))


def red_flags(st: DataFrame) -> DataFrame:
    """Seven rules on the latest period (rules 2 and 4 look back two and four periods)."""
    d = with_changes(st, ["revenue", "accounts_receiv"])
    grown = F.coalesce((c("g_accounts_receiv") > c("g_revenue") * 1.5) & (c("g_accounts_receiv") > 0), F.lit(False))
    inv = ratio("inventories", "revenue")
    d = d.select("*", F.sum(grown.cast("int")).over(S.trail(2)).alias("_ar"),
                 F.sum(((c("cfo") < 0) & (c("n_income") > 0)).cast("int")).over(S.trail(4)).alias("_paper"),
                 ratio(inv, ratio(S.lag("inventories"), S.lag("revenue"))).alias("_inv"))
    debt = c("st_borr") + c("lt_borr") + c("bond_payable")
    rules = {
        "f1_cash_and_debt": (ratio("money_cap", "total_assets") > 0.3) & (ratio(debt, "total_assets") > 0.3),
        "f2_receivables": c("_ar") >= 2, "f3_inventory": c("_inv") > 1.5, "f4_paper_profit": c("_paper") >= 2,
        "f7_construction": ratio("cip", "fix_assets_total") > 0.5, "f8_prepayment": ratio("prepayment", "total_assets") > 0.1,
        "f12_goodwill": ratio("goodwill", "equity") > 0.3}
    d = latest(d).select("code", "end_date", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()])
    n = count_true(*[c(k) for k in rules])
    return d.withColumn("triggered", n).withColumn("risk_level", ladder(
        (c("triggered") <= 1, "low"), (c("triggered") <= 3, "medium"), (c("triggered") <= 5, "high"), default="extreme"))


def dupont(st: DataFrame, n: int = 4) -> DataFrame:
    """Margin x turnover x leverage, tax and interest burden; driver of the return."""
    ok = (c("revenue") != 0) & (c("total_assets") != 0) & (c("equity") != 0)
    d = latest(st, n).where(ok).select(
        "code", "end_date", ratio("n_income_attr_p", "revenue").alias("net_margin"), ratio("revenue", "total_assets").alias("asset_turnover"),
        ratio("total_assets", "equity").alias("equity_multiplier"), F.coalesce(ratio("n_income_attr_p", "total_profit"), F.lit(0.0)).alias("tax_burden"),
        F.coalesce(ratio("total_profit", "operate_profit"), F.lit(0.0)).alias("interest_burden"), ratio("operate_profit", "revenue").alias("operating_margin"))
    d = d.withColumn("roe", c("net_margin") * c("asset_turnover") * c("equity_multiplier"))
    top = F.greatest("net_margin", "asset_turnover", "equity_multiplier")
    return d.withColumn("driver", ladder(
        (F.round("roe", 4) <= 0, "loss"), (c("net_margin") == top, "profitability"), (c("asset_turnover") == top, "efficiency"), default="leverage"))


def cash_flow_matrix(st: DataFrame) -> DataFrame:
    sign = lambda x: F.when(x, "+").otherwise("-")
    p = F.concat(sign(c("cfo") > 0), sign(c("cfi") >= 0), sign(c("cff") >= 0))
    # Sign pattern (operating, investing, financing) -> status.
    names = {"+--": "excellent", "+-+": "expanding", "++-": "steady", "--+": "dangerous", "-++": "distress", "-+-": "declining"}
    return latest(st).select("code", "end_date", p.alias("pattern"),
                             ladder(*[(p == k, v) for k, v in names.items()], default="unclear").alias("status"),
                             ladder((c("cfo") > 0, "healthy"), (c("cfo") < 0, "warning"), default="neutral").alias("cash_quality"))


def health_score(st: DataFrame) -> DataFrame:
    """.15 checks + .30 quality + .25 red flags + .15 DuPont + .15 cash matrix.

    The statements are stored once, dealt by code: the five blocks and their joins need no further exchange.
    """
    st = cut(st.repartition("code"))
    d = (statement_checks(st).select("code", "warnings").join(earnings_quality(st).select("code", "quality"), "code")
         .join(red_flags(st).select("code", "triggered"), "code").join(dupont(st, 1).select("code", "driver"), "code", "left")
         .join(cash_flow_matrix(st).select("code", "cash_quality"), "code"))
    driver = ladder((c("driver") == "profitability", 90), (c("driver") == "efficiency", 80), (c("driver") == "leverage", 55),
                    (c("driver") == "loss", 20), default=50)
    cash = ladder((c("cash_quality") == "healthy", 90), (c("cash_quality") == "warning", 30), default=60)
    total = (F.greatest(F.lit(0), 100 - c("warnings") * 15) * 0.15 + c("quality") / 3 * 100 * 0.30
             + F.greatest(F.lit(0), 100 - c("triggered") * 18) * 0.25 + driver * 0.15 + cash * 0.15)
    return d.withColumn("score", total).withColumn("rating", ladder(
        (c("score") >= 80, "excellent"), (c("score") >= 65, "good"), (c("score") >= 50, "average"), (c("score") >= 35, "weak"), default="dangerous"))


def growth_summary(st: DataFrame, value: str = "revenue") -> DataFrame:
    """Latest growth, mean growth and stability over all periods of a code."""
    g = with_changes(st, [value]).select("code", "end_date", value, c(f"g_{value}").alias("_g"))
    return g.groupBy("code").agg(
        F.max_by(value, "end_date").alias("current"), (F.max_by("_g", "end_date") * 100).alias("yoy_growth"),
        (F.avg("_g") * 100).alias("avg_growth"), F.stddev_samp("_g").alias("_sd"), F.count(F.lit(1)).alias("periods")).where("periods >= 2").select(
        "code", "current", "yoy_growth", "avg_growth", F.when(c("yoy_growth") > 0, "up").otherwise("down").alias("trend"),
        F.when(c("_sd") < 0.1, "stable").otherwise("volatile").alias("stability"))


def quarterly_profile(st: DataFrame) -> DataFrame:
    """Per period: revenue and profit change on the previous period, net margin; cash-flow stability of the code."""
    w = Window.partitionBy("code")
    return st.select(
        "code", "end_date", ((ratio("revenue", S.lag("revenue")) - 1) * 100).alias("qoq_revenue"),
        (ratio(c("n_income") - S.lag("n_income"), F.abs(S.lag("n_income"))) * 100).alias("qoq_profit"),
        (ratio("n_income", "revenue") * 100).alias("net_margin"),
        F.when(F.stddev_pop("cfo").over(w) < F.avg("cfo").over(w) * 0.3, "stable").otherwise("volatile").alias("cash_stability"))


def margin_trend(st: DataFrame) -> DataFrame:
    m = (1 - ratio("total_cogs", "revenue")) * 100
    d = st.select("code", "end_date", m.alias("_m")).select("*", S.lag("_m").alias("_p"))
    return d.groupBy("code").agg(
        F.max_by("_m", "end_date").alias("current_margin"), F.avg("_m").alias("avg_margin"), F.stddev_pop("_m").alias("_sd"),
        (F.max("_m") - F.min("_m")).alias("margin_range"), F.max_by("_p", "end_date").alias("_p")).select(
        "code", "current_margin", "avg_margin", "margin_range", F.when(c("current_margin") > c("_p"), "up").otherwise("down").alias("trend"),
        F.when(c("_sd") < 5, "stable").otherwise("volatile").alias("stability"),
        F.when(c("margin_range") > 10, "marked").otherwise("flat").alias("seasonality"))


def segment_mix(seg: DataFrame) -> DataFrame:
    """Segments of the latest period: share, margin and change on the previous reported period."""
    d = seg.groupBy("code", "end_date", "item").agg(F.max("sales").alias("sales"), F.max("profit").alias("profit"))
    rank = F.dense_rank().over(Window.partitionBy("code").orderBy(F.desc("end_date")))
    d = d.withColumn("_r", rank).where("_r <= 2")
    cur = d.where("_r = 1")
    prev = d.where("_r = 2").select("code", "item", c("sales").alias("_ps"))
    total = F.sum("sales").over(Window.partitionBy("code"))
    return cur.withColumn("_t", total).join(prev, ["code", "item"], "left").select(
        "code", "end_date", "item", "sales", (ratio("profit", "sales") * 100).alias("margin_pct"),
        (ratio("sales", "_t") * 100).alias("share_pct"), ((ratio("sales", "_ps") - 1) * 100).alias("change_pct"))


def rising_streak(col: str) -> Column:
    """Consecutive rises up to this row: distance to the last row that did not rise."""
    flat = F.when(~F.coalesce(c(col) > c(f"_prev_{col}"), F.lit(False)), c("_i"))
    return c("_i") - F.max(flat).over(S.run())


def contract_liabilities(st: DataFrame, col: str = "contract_liab") -> DataFrame:
    d = st.select("code", "end_date", col, S.idx().alias("_i"), S.lag(col).alias(f"_prev_{col}"))
    d = latest(d.withColumn("streak", rising_streak(col))).where("_i >= 2")
    v, p = c(col), c(f"_prev_{col}")
    return d.select("code", "end_date", v.alias("current"), (ratio(v - p, F.abs(p)) * 100).alias("growth_rate"), "streak", ladder(
        (c("streak") >= 2, "expanding"), (v > p, "positive"), ((v == 0) & (p == 0), "none"), default="cautious").alias("indicator"))


def inventory_signal(st: DataFrame) -> DataFrame:
    d = with_changes(st, ["inventories", "revenue"]).select("*", S.idx().alias("_i"), c("p_inventories").alias("_prev_inventories"),
                                                           (ratio("total_cogs", "inventories")).alias("_turn")).select("*", S.lag("_turn").alias("_pturn"))
    d = latest(d.withColumn("streak", rising_streak("inventories"))).where("_i >= 2")
    gap = (c("g_inventories") - c("g_revenue")) * 100
    return d.select("code", "end_date", (c("g_inventories") * 100).alias("inventory_growth"), (c("g_revenue") * 100).alias("revenue_growth"), "streak",
                    F.when(c("_turn") > c("_pturn"), "faster").otherwise("slower").alias("turn_trend"),
                    ladder((c("inventories") == 0, "no_inventory"), (gap > 15, "piling_up"), (gap < -15, "short_supply"), default="matched").alias("signal"))


def cash_reconciliation(st: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Cash change against the three flows; receivable against revenue growth."""
    d = with_changes(st, ["revenue", "accounts_receiv"])
    gap = (c("money_cap") - S.lag("money_cap")) - (c("cfo") + c("cfi") + c("cff"))
    return d.select("code", "end_date", gap.alias("cash_gap"), (F.abs(gap) <= tolerance).alias("reconciled"),
                    (c("g_accounts_receiv") > c("g_revenue")).alias("receivables_outgrow"))


def liquidity_ratios(st: DataFrame) -> DataFrame:
    debt = c("st_borr") + c("lt_borr") + c("bond_payable")
    return st.select("code", "end_date", (1 - ratio("total_cogs", "revenue")).alias("gross_margin"), ratio("n_income", "revenue").alias("net_margin"),
                     ratio("expenses", "revenue").alias("expense_ratio"), ratio("current_assets", "current_liab").alias("current_ratio"),
                     ratio(c("current_assets") - c("inventories"), "current_liab").alias("quick_ratio"),
                     ratio(debt, "total_assets").alias("interest_debt_ratio"), ratio("total_liab", "total_assets").alias("debt_ratio"))


def documented_flags(st: DataFrame) -> DataFrame:
    """Rules without source code: related parties, auditor changes, minority swings, opinion, R&D capitalisation.

    A rule whose input is null stays null.
    """
    share = ratio("minority_income", "n_income")
    d = st.select("*", S.lag("auditor").alias("_pa"), (share - ratio(S.lag("minority_income"), S.lag("n_income"))).alias("_swing"))
    d = d.withColumn("_changes", F.sum((c("auditor") != c("_pa")).cast("int")).over(S.trail(12)))
    return latest(d).select("code", "end_date", (ratio("related_sales", "revenue") > 0.3).alias("f5_related_party"), (c("_changes") >= 2).alias("f6_auditor"),
                            (F.abs("_swing") > 0.3).alias("f9_minority"), (c("audit_opinion") != "standard").alias("f10_opinion"),
                            (ratio("rd_capitalised", "rd_total") > 0.5).alias("f11_rd"))


# ---- valuation -----------------------------------------------------------------------------------

# Industry -> (low WACC, high WACC, beta); others use the default.
INDUSTRY_WACC = {
    "白酒": (0.08, 0.10, 0.85), "食品": (0.08, 0.10, 0.90), "银行": (0.07, 0.09, 1.10), "保险": (0.08, 0.10, 1.00),
    "房地产": (0.09, 0.12, 1.30), "电力": (0.06, 0.08, 0.60), "计算机": (0.10, 0.13, 1.30), "电子": (0.10, 0.13, 1.25),
    "医药": (0.09, 0.12, 0.95), "机械": (0.09, 0.11, 1.10), "汽车": (0.09, 0.11, 1.10), "通信": (0.09, 0.11, 1.00),
    "钢铁": (0.09, 0.12, 1.20), "煤炭": (0.09, 0.12, 1.20), "石油": (0.08, 0.10, 0.90), "建筑": (0.09, 0.11, 1.10)}
# Industry -> EV/EBITDA (median, undervalued, overvalued).
INDUSTRY_MULTIPLES = {
    "白酒": (22, 16, 30), "食品": (18, 13, 25), "银行": (10, 7, 14), "房地产": (8, 5, 12), "计算机": (16, 10, 22),
    "电子": (14, 9, 20), "医药": (16, 11, 22), "电力": (10, 7, 14), "机械": (12, 8, 17), "汽车": (12, 8, 17)}
# Cyclical industries.
CYCLICAL = ["钢铁", "煤炭", "有色金属", "石油", "化工", "建材"]
# Weights of the valuation methods.
METHOD_WEIGHTS = {"dcf": 0.35, "ddm": 0.10, "pe_band": 0.25, "pb_roe": 0.15, "ev_ebitda": 0.15}


def _lookup(table: dict, k: int, default: float) -> Column:
    return ladder(*[(c("industry") == name, float(v[k])) for name, v in table.items()], default=default)


def wacc_mid() -> Column:
    return (_lookup(INDUSTRY_WACC, 0, 0.09) + _lookup(INDUSTRY_WACC, 1, 0.11)) / 2


def _projection(fcff: Column, cagr: Column) -> list[Column]:
    out, prev = [], fcff
    for i in range(5):
        g = F.greatest(cagr * (0.8 if i < 2 else 0.5 if i < 4 else 0.3), F.lit(0.02))
        prev = prev * (1 + g)
        out.append(prev)
    return out


def dcf_inputs(annual: DataFrame, n: int = 5) -> DataFrame:
    """Latest FCFF, revenue CAGR over up to n years (clamped 0..30 %), net debt and shares per code."""
    a = latest(annual, n)
    k = F.count(F.lit(1))
    g = a.groupBy("code").agg(
        F.max_by(c("cfo") - F.abs("capex"), "end_date").alias("fcff"), F.min_by("revenue", "end_date").alias("_r0"),
        F.max_by("revenue", "end_date").alias("_r1"), k.alias("years"),
        F.max_by(c("st_borr") + c("lt_borr") + c("bond_payable") - c("money_cap"), "end_date").alias("net_debt"),
        F.max_by("total_share", "end_date").alias("shares"), F.max_by("industry", "end_date").alias("industry"))
    cagr = F.when(c("years") >= 3, F.pow(c("_r1") / c("_r0"), 1.0 / (c("years") - 1)) - 1).otherwise(0.08)
    return g.withColumn("cagr", F.greatest(F.lit(0.0), F.least(cagr, F.lit(0.30)))).withColumn("wacc", wacc_mid()).drop("_r0", "_r1")


def dcf_per_share(w: Column, g: Column | float, exit_multiple: float | None = None) -> Column:
    """Five discounted flows plus a terminal value (perpetual growth, or EBITDA times an exit multiple)."""
    flows = _projection(c("fcff"), c("cagr"))
    pv = sum((f / F.pow(1 + w, F.lit(float(i + 1))) for i, f in enumerate(flows)), F.lit(0.0))
    if exit_multiple is None:
        terminal = flows[-1] * (1 + g) / (w - g)
    else:
        growth = flows[-1] / c("fcff")
        terminal = c("ebitda") * growth * exit_multiple
    return (pv + terminal / F.pow(1 + w, F.lit(5.0)) - c("net_debt")) / c("shares")


def dcf(annual: DataFrame) -> DataFrame:
    return dcf_inputs(annual).withColumn("per_share", dcf_per_share(c("wacc"), F.lit(0.025)))


def dcf_grid(annual: DataFrame) -> DataFrame:
    """15 (WACC, growth) pairs per code: the pairs are expanded per row."""
    grid = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(g).alias("g")) for w in (0.08, 0.09, 0.10, 0.11, 0.12) for g in (0.020, 0.025, 0.030)])
    return dcf_inputs(annual).select("*", F.inline(grid)).withColumn("per_share", dcf_per_share(c("w"), c("g")))


def dcf_exit(annual: DataFrame, multiple: float = 10.0) -> DataFrame:
    e = latest(annual).select("code", (c("operate_profit") * 1.1).alias("ebitda"))
    return dcf_inputs(annual).where("fcff <> 0").join(e, "code").withColumn("per_share", dcf_per_share(c("wacc"), 0.0, multiple))


def ddm(dividends: DataFrame) -> DataFrame:
    """Two stages from the last five positive dividends; at least three are needed."""
    d = latest(dividends.where(c("dps") > 0), 5)
    g = d.groupBy("code").agg(F.min_by("dps", "end_date").alias("_d0"), F.max_by("dps", "end_date").alias("latest_dps"),
                              F.count(F.lit(1)).alias("n"), F.max_by("industry", "end_date").alias("industry")).where("n >= 3")
    gr = F.pow(c("latest_dps") / c("_d0"), 1.0 / (c("n") - 1)) - 1
    ke = (_lookup(INDUSTRY_WACC, 0, 0.08) + _lookup(INDUSTRY_WACC, 1, 0.10)) / 2 + 0.01
    g = g.withColumn("dividend_cagr", gr).withColumn("ke", ke)
    up = (1 + c("dividend_cagr")) / (1 + c("ke"))
    stage1 = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0.0), lambda a, i: a + c("latest_dps") * F.pow(up, i.cast("double")))
    stage2 = c("latest_dps") * F.pow(up, F.lit(5.0)) * 1.025 / (c("ke") - 0.025)
    return g.withColumn("per_share", stage1 + stage2).withColumn("applicable", c("dividend_cagr") > 0)


PCTS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def pe_band(daily: DataFrame, eps: DataFrame) -> DataFrame:
    """Quantiles of positive PE, strict rank of the current one, implied prices and judgement."""
    pos = daily.where(c("pe") > 0)
    q = quantiles(pos, ("code",), "pe", PCTS)
    # read once: summed anew, the current PE can differ in its last digit from the one in the history and count itself
    now = pos.withColumn("current_pe", F.max_by("pe", "date").over(Window.partitionBy("code")))
    rank = now.groupBy("code").agg(F.max("current_pe").alias("current_pe"), F.avg((c("pe") < c("current_pe")).cast("double")).alias("rank"))
    d = q.join(rank, "code").join(eps, "code", "left")
    return d.withColumn("implied_p50", F.when(c("eps") > 0, c("p50") * c("eps"))).withColumn("judgement", ladder(
        (c("rank") < 0.25, "deeply_undervalued"), (c("rank") < 0.40, "undervalued"), (c("rank") < 0.60, "fair"), (c("rank") < 0.75, "rich"),
        default="deeply_overvalued"))


def pe_band_month_end(daily: DataFrame, years: int = 5) -> DataFrame:
    """Last PE per month over the window years; percentiles by index, not interpolated."""
    m = daily.where(c("pe").isNotNull()).groupBy("code", F.trunc("date", "month").alias("month")).agg(F.max_by("pe", "date").alias("pe"))
    last = m.groupBy("code").agg(F.max(F.year("month")).alias("_y"))
    arr = m.join(last, "code").where(F.year("month") >= c("_y") - years).groupBy("code").agg(F.sort_array(F.collect_list("pe")).alias("a"))
    at = lambda p: F.element_at("a", F.greatest(F.floor(F.size("a") * p / 100).cast("int"), F.lit(1)))
    return arr.select("code", F.size("a").alias("months"), *[at(p).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


def pb_roe(d: DataFrame) -> DataFrame:
    """Quadrant by PB 2 and ROE 12 %; theoretical PB = (ROE - 3 %) / 7 %."""
    low, good = c("pb") < 2.0, c("roe") > 0.12
    theo = F.when(c("roe") > 0.03, (c("roe") - 0.03) / 0.07).otherwise(0.0)
    return d.select("*", ladder((low & good, "undervalued"), (good, "fair_premium"), (low, "value_trap_or_turnaround"), default="overvalued").alias("quadrant"),
                    theo.alias("theoretical_pb"), F.when(c("pb") < theo, "below").otherwise("above").alias("versus_theory"))


def ev_ebitda(d: DataFrame) -> DataFrame:
    """Market value plus net debt over 1.1 x operating profit, against the industry band; only positive EBITDA."""
    x = d.where(c("operate_profit") > 0).withColumn("ev_ebitda", (c("market_cap") + c("net_debt")) / (c("operate_profit") * 1.1))
    x = x.withColumn("industry_median", _lookup(INDUSTRY_MULTIPLES, 0, 14.0))
    lo, hi = _lookup(INDUSTRY_MULTIPLES, 1, 10.0), _lookup(INDUSTRY_MULTIPLES, 2, 20.0)
    return x.withColumn("judgement", ladder((c("ev_ebitda") < lo, "undervalued"), (c("ev_ebitda") < c("industry_median"), "fair_low"),
                                            (c("ev_ebitda") < hi, "fair_high"), default="overvalued"))


def valuation_traps(st: DataFrame) -> DataFrame:
    """Cyclical low PE, lasting low ROE, goodwill, receivables."""
    d = st.select("*", F.sum((c("roe_pct") < 5).cast("int")).over(S.trail(5)).alias("_low"), F.count("roe_pct").over(S.trail(5)).alias("_n"),
                  ratio(S.lag("accounts_receiv"), S.lag("revenue")).alias("_pr"))
    r = ratio("accounts_receiv", "revenue")
    rules = {"t1_cyclical_pe": (c("pe") > 0) & (c("pe") < 8) & c("industry").isin(*CYCLICAL), "t3_low_roe": (c("_n") >= 3) & (c("_low") == c("_n")),
             "t4_goodwill": ratio("goodwill", "equity") > 0.30, "t5_receivables": (r > c("_pr") * 1.2) & (r > 0.3)}
    d = latest(d).select("code", "end_date", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()])
    return d.withColumn("triggered", count_true(*[c(k) for k in rules])).withColumn("risk_level", ladder(
        (c("triggered") >= 3, "high"), (c("triggered") >= 1, "medium"), default="low"))


def valuation_cross_check(d: DataFrame) -> DataFrame:
    """(code, price, one column per method): weights renormalised over positive values, median, spread, upside."""
    long = d.unpivot(["code", "price"], list(METHOD_WEIGHTS), "method", "value").where(c("value") > 0)
    w = ladder(*[(c("method") == k, v) for k, v in METHOD_WEIGHTS.items()])
    g = long.groupBy("code", "price").agg((F.sum(w * c("value")) / F.sum(w)).alias("target"), F.median("value").alias("median"),
                                          F.max("value").alias("_mx"), F.min("value").alias("_mn"), F.count(F.lit(1)).alias("methods"))
    g = g.withColumn("spread", ratio(c("_mx") - c("_mn"), "median")).withColumn("upside", ratio("target", "price") - 1)
    return g.withColumn("consistent", c("spread") < 0.30).withColumn("label", ladder((c("upside") > 0.10, "up"), (c("upside") < -0.10, "down"), default="neutral"))


def history_percentile(daily: DataFrame, cols: Sequence[str] = ("pe", "pb", "ps"), compat: bool = False) -> DataFrame:
    """Share (%) of positive history below the current value; ``compat`` counts values at or above it."""
    long = daily.unpivot(["code", "date"], list(cols), "metric", "value").where(c("value") > 0)
    long = long.withColumn("current", F.max_by("value", "date").over(Window.partitionBy("code", "metric")))
    hit = c("value") >= c("current") if compat else c("value") < c("current")
    return long.groupBy("code", "metric", "current").agg((F.avg(hit.cast("double")) * 100).alias("percentile")).withColumn(
        "rating", ladder((c("percentile") >= 80, "expensive"), (c("percentile") <= 20, "cheap"), default="fair"))


def industry_percentile(day: DataFrame, value: str = "pe", order: str | None = None) -> DataFrame:
    """Within date x industry: median, mean, min, max and the share (%) of peers below each code.

    Peers are told apart by ``order``, if given: by a value whose last digit is the same for equal codes in every run.
    """
    order = order or value
    by = ("date", "industry")
    pos = day.where(c(value) > 0)
    stats = pos.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("_n"))
    med = quantiles(pos, by, value, {"median": 0.5})
    from barloom.functions.ranking import cumulated_counts
    below = cumulated_counts(pos, by, order).select(*by, order, "below")
    return pos.join(below, [*by, order]).join(stats.join(med, list(by)), list(by)).withColumn("percentile", c("below") * 100.0 / c("_n"))


def wacc_capm(d: DataFrame, rf: float = 0.025, premium: float = 0.06, kd: float = 0.045, tax: float = 0.25) -> DataFrame:
    ke = F.lit(rf) + c("beta") * premium
    v = c("equity_value") + c("debt")
    return d.select("*", ke.alias("ke"), (ratio("equity_value", v) * ke + ratio("debt", v) * kd * (1 - tax)).alias("wacc"))


# ---- expectations --------------------------------------------------------------------------------

def sue(actuals: DataFrame) -> DataFrame:
    """(code, end_date, actual, consensus): surprise over the deviation of the previous eight errors."""
    d = actuals.withColumn("_e", c("actual") - c("consensus"))
    sd = F.when(F.count("_e").over(S.w.rowsBetween(-8, -1)) >= 8, F.stddev_samp("_e").over(S.w.rowsBetween(-8, -1)))
    return d.withColumn("sue", ratio("_e", sd)).withColumn("signal", F.when(c("sue").isNotNull(), ladder(
        (c("sue") > 2, "strong_buy"), (c("sue") > 1, "buy"), (c("sue") >= -1, "none"), (c("sue") >= -2, "sell"), default="strong_sell")))


def event_drift(events: DataFrame, prices: DataFrame, holds: Sequence[int]) -> DataFrame:
    """Return from the first bar after each event over the next h bars.

    Every price row carries its own forward prices, so the as-of step finds one row per event and no
    range join is needed.
    """
    s = Series(("code",), ("date",))
    px = prices.select("code", "date", F.struct("date", "close", *[s.lead("close", h).alias(f"f{h}") for h in holds]).alias("_p"))
    ev = events.select("code", c("date"), F.struct(*[x for x in events.columns if x != "code"]).alias("_e"))
    both = px.withColumn("_k", F.lit(0)).unionByName(ev.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    # a price of the event's own date lies before the event, so it is not the entry
    w = Window.partitionBy("code").orderBy("date", "_k").rowsBetween(1, Window.unboundedFollowing)
    hit = both.withColumn("_n", F.first("_p", ignorenulls=True).over(w)).where("_k = 1")
    return hit.select("code", "_e.*", c("_n.date").alias("entry"), *[(ratio(c("_n")[f"f{h}"], c("_n.close")) - 1).alias(f"ret{h}") for h in holds])


def pead(surprises: DataFrame, prices: DataFrame, hold: int = 40, drift: int = 60, threshold: float = 1.5) -> DataFrame:
    """Direction by |SUE|, drift quintile by SUE rank over all events."""
    d = event_drift(surprises.where(c("sue").isNotNull()), prices, (hold, drift))
    d = average_rank(d.withColumn("_all", F.lit(1)), ("_all",), "sue", "_rk", "_n")
    d = d.withColumn("quintile", F.least(F.ceil(c("_rk") * 5 / c("_n")), F.lit(5)))
    return d.withColumn("side", ladder((c("sue") > threshold, "long"), (c("sue") < -threshold, "short"), default="none")).drop("_all", "_rk", "_n")


def revisions(est: DataFrame, days: int = 30) -> DataFrame:
    """(code, analyst, date, eps) -> per (code, date): revision ratio and change on the consensus ``days`` ago.

    Consensus is the mean of the estimates made on the day; the older one is the last at least
    ``days`` back (union and fill on shifted dates).
    """
    w = Window.partitionBy("code", "analyst").orderBy("date")
    p = F.lag("eps").over(w)
    d = est.select("code", "date", "eps", F.signum(c("eps") - p).alias("_s"))
    day = d.groupBy("code", "date").agg(
        F.avg("eps").alias("consensus"), F.sum((c("_s") > 0).cast("int")).alias("ups"), F.sum((c("_s") < 0).cast("int")).alias("downs"),
        F.count(F.lit(1)).alias("n"))
    old = day.select("code", F.date_add("date", days).alias("date"), c("consensus").alias("_o"), F.lit(0).alias("_k"))
    both = day.withColumn("_k", F.lit(1)).unionByName(old, allowMissingColumns=True)
    fill = Window.partitionBy("code").orderBy("date", "_k").rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_o", F.last("_o", ignorenulls=True).over(fill)).where("_k = 1")
    return x.select("code", "date", "consensus", F.coalesce(ratio(c("ups") - c("downs"), "n"), F.lit(0.0)).alias("erm"),
                    ratio(c("consensus") - c("_o"), F.abs("_o")).alias("change"))


def dispersion(est: DataFrame) -> DataFrame:
    """Latest estimate per analyst, then deviation over mean per code."""
    lastest = est.groupBy("code", "analyst").agg(F.max_by("eps", "date").alias("eps"))
    return lastest.groupBy("code").agg(F.count(F.lit(1)).alias("analysts"), F.avg("eps").alias("mean"),
                                       ratio(F.stddev_samp("eps"), F.avg("eps")).alias("dispersion")).withColumn(
        "agreement", ladder((c("dispersion") > 0.3, "split"), (c("dispersion") < 0.1, "firm"), default="mixed"))


def guidance_labels(g: DataFrame) -> DataFrame:
    """(code, end_date, midpoint, consensus): against consensus +-2 %, against the prior +-1 %."""
    p = S.lag("midpoint")
    return g.select("*", ladder((c("midpoint") > c("consensus") * 1.02, "above"), (c("midpoint") < c("consensus") * 0.98, "below"), default="inline").alias("versus_consensus"),
                    F.when(p.isNotNull(), ladder((c("midpoint") > p * 1.01, "raised"), (c("midpoint") < p * 0.99, "lowered"), default="maintained")).alias("revision"))


def consensus_rollup(rc: DataFrame) -> DataFrame:
    """Per (code, quarter): estimate statistics, brokers and target-price range."""
    return rc.groupBy("code", "quarter").agg(
        F.count("eps").alias("n"), F.countDistinct("org").alias("brokers"), F.avg("eps").alias("eps_avg"), F.max("eps").alias("eps_max"),
        F.min("eps").alias("eps_min"), F.max("max_price").alias("high_target"), F.min("min_price").alias("low_target"),
        F.sum((c("rating") == "buy").cast("int")).alias("buys"))


def institution_visits(v: DataFrame) -> DataFrame:
    """Distinct days, visitors seen at least twice, most common type (smallest name wins ties)."""
    org = v.groupBy("code", "org").agg(F.count(F.lit(1)).alias("k")).groupBy("code").agg(
        F.sum((c("k") >= 2).cast("int")).alias("frequent_orgs"), F.count(F.lit(1)).alias("orgs"))
    kinds = v.groupBy("code", "org_type").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("code").orderBy(F.desc("k"), "org_type")
    top = kinds.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("code", c("org_type").alias("top_type"), c("k").alias("top_count"))
    days = v.groupBy("code").agg(F.countDistinct("date").alias("days"), F.count(F.lit(1)).alias("records"))
    return days.join(org, "code").join(top, "code")


# ---- ownership -----------------------------------------------------------------------------------

def chip_distribution(chips: DataFrame, price: DataFrame, levels: int = 5) -> DataFrame:
    """(code, price, percent) and (code, current) -> profit share, cost percentiles, mean cost, peak, level shares."""
    w = Window.partitionBy("code").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    d = chips.where(c("price") > 0).withColumn("_cum", exact_sum("percent", w)).join(price, "code")
    at = lambda p: F.coalesce(F.min(F.when(c("_cum") >= p, c("price"))), F.max("price"))
    g = d.groupBy("code", "current").agg(
        F.sum(F.when(c("price") <= c("current"), c("percent")).otherwise(0.0)).alias("profit_share"), F.sum("percent").alias("_t"),
        at(5).alias("cost5"), at(15).alias("cost15"), at(85).alias("cost85"), at(95).alias("cost95"),
        F.sum(c("price") * c("percent")).alias("_pc"), F.min("price").alias("_lo"), F.max("price").alias("_hi"), F.max("percent").alias("_mp"))
    peak = d.join(g.select("code", c("_mp")), "code").where(c("percent") == c("_mp")).groupBy("code").agg(F.min("price").alias("peak_price"))
    step = (c("_hi") - c("_lo")) / levels
    lv = d.join(g.select("code", "_lo", "_hi"), "code").groupBy("code").agg(*[
        F.sum(F.when((c("price") >= c("_lo") + step * i) & (c("price") < c("_lo") + step * (i + 1)), c("percent")).otherwise(0.0)).alias(f"level{i + 1}")
        for i in range(levels)])
    g = g.withColumn("avg_cost", ratio("_pc", "_t"))
    return g.join(peak, "code").join(lv, "code").withColumn("loss_share", c("_t") - c("profit_share")).withColumn(
        "density_pct", ratio(c("cost95") - c("cost5"), "current") * 100).withColumn("deviation_pct", (ratio("current", "avg_cost") - 1) * 100)


def chip_drift(chips: DataFrame) -> DataFrame:
    """Mean cost per sample date; first-to-last drift (%)."""
    d = chips.groupBy("code", "date").agg(ratio(F.sum(c("price") * c("percent")), F.sum("percent")).alias("cost"))
    return d.groupBy("code").agg(F.min_by("cost", "date").alias("first_cost"), F.max_by("cost", "date").alias("last_cost"),
                                 F.count(F.lit(1)).alias("samples")).where("samples >= 2").withColumn(
        "drift_pct", (ratio("last_cost", "first_cost") - 1) * 100)


def margin_analysis(m: DataFrame) -> DataFrame:
    """Balances, flows, 5-row change, volatility, risk and 0..100 score per code."""
    w = Window.partitionBy("code").orderBy("date")
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    d = m.select("*", F.row_number().over(w).alias("_i"), F.row_number().over(back).alias("_a"),
                 (ratio("rzye", F.lag("rzye").over(w)) - 1).alias("_rz"), (ratio("rqye", F.lag("rqye").over(w)) - 1).alias("_rq"))
    n = F.count(F.lit(1))

    def change(x):
        recent, older = F.avg(F.when(c("_a") <= 5, c(x))), F.avg(F.when(c("_a") > 5, c(x)))
        older = F.when(n > 5, older).otherwise(F.avg(F.when(c("_i") == 1, c(x))))
        return F.when(n >= 5, (ratio(recent, older) - 1) * 100).otherwise(0.0)

    g = d.groupBy("code").agg(
        n.alias("n"), ratio(F.regr_slope("rzye", "_i"), F.avg("rzye")).alias("_ts"), ratio(F.regr_slope("rqye", "_i"), F.avg("rqye")).alias("_tq"),
        F.sum(c("rzmre") - c("rzche")).alias("net_financing"), F.sum(c("rqmcl") - c("rqchl")).alias("net_lending"),
        ratio(F.avg("rzmre"), F.avg("rzye")).alias("turnover"), change("rzye").alias("rz_change"), change("rqye").alias("rq_change"),
        F.coalesce(F.stddev_pop("_rz"), F.lit(0.0)).alias("rz_vol"), F.coalesce(F.stddev_pop("_rq"), F.lit(0.0)).alias("rq_vol"))
    tr = lambda x: ladder((c(x) > 0.01, "increasing"), (c(x) < -0.01, "decreasing"), default="stable")
    g = g.withColumn("rz_trend", tr("_ts")).withColumn("rq_trend", tr("_tq"))
    risk = (F.when(c("rz_vol") > 0.1, 30).otherwise(0) + F.when(c("rq_vol") > 0.15, 20).otherwise(0)
            + F.when(c("net_financing") < -1e8, 25).otherwise(0) + F.when(c("net_lending") > 1e6, 25).otherwise(0))
    g = g.withColumn("risk", risk)
    s = (F.lit(50) + ladder((c("rz_trend") == "increasing", 15), (c("rz_trend") == "decreasing", -10), default=0)
         + ladder((c("rq_trend") == "decreasing", 10), (c("rq_trend") == "increasing", -15), default=0)
         + F.when(c("net_financing") > 0, 15).otherwise(-10) + F.when(c("net_lending") < 0, 10).otherwise(-10)
         + ladder((c("risk") >= 50, -20), (c("risk") >= 25, 0), default=10))
    return g.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), s))).withColumn(
        "view", ladder((c("score") >= 70, "bullish"), (c("score") <= 30, "bearish"), default="neutral"))


def holder_trend(h: DataFrame) -> DataFrame:
    """Latest holder count against the previous: bands of 2 and 5 %."""
    d = latest(h.select("code", "end_date", "holder_num", (ratio("holder_num", S.lag("holder_num")) - 1).alias("change")))
    return d.where(c("change").isNotNull()).withColumn("signal", ladder(
        (c("change") < -0.05, "bullish"), (c("change") < -0.02, "slightly_bullish"), (c("change") > 0.05, "bearish"),
        (c("change") > 0.02, "slightly_bearish"), default="neutral"))


# Words that mark an institution in a holder's name.
INSTITUTION_WORDS = ["基金", "社保", "保险", "信托", "证券", "银行", "公司", "集团", "有限", "股份", "资本", "投资", "资产管理", "理财", "QFII", "香港"]


def top_holders(h: DataFrame, words: Sequence[str] = tuple(INSTITUTION_WORDS), n: int = 10) -> DataFrame:
    w = Window.partitionBy("code").orderBy(F.desc("hold_ratio"), "holder")
    d = h.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n)
    return d.groupBy("code").agg(F.sum("hold_ratio").alias("total_ratio"), F.sum(c("holder").rlike("|".join(words)).cast("int")).alias("institutions"),
                                 F.count(F.lit(1)).alias("holders")).withColumn(
        "concentration", ladder((c("total_ratio") > 60, "high"), (c("total_ratio") > 40, "medium"), default="low"))


def holder_trades(t: DataFrame) -> DataFrame:
    v = c("change_vol")
    g = t.groupBy("code").agg(F.sum((v > 0).cast("int")).alias("buys"), F.sum((v < 0).cast("int")).alias("sells"),
                              F.sum(F.when(v > 0, v).otherwise(0.0)).alias("bought"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("sold"))
    return g.withColumn("direction", ladder((c("bought") > c("sold"), "net_buy"), (c("bought") < c("sold"), "net_sell"), default="balanced"))


def pledge_risk(p: DataFrame) -> DataFrame:
    """Worst of the stated percentages ('12.5%'): above 50 high, above 30 medium. Unreadable text counts as none."""
    x = F.expr("try_cast(replace(pledge, '%', '') AS double)")
    return p.groupBy("code").agg(F.max(x).alias("ratio")).withColumn("risk", ladder((c("ratio") > 50, "high"), (c("ratio") > 30, "medium"), default="low"))


def event_counts(ev: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return ev.groupBy("code").agg(*[F.sum((c("kind") == k).cast("int")).alias(k) for k in kinds], F.count(F.lit(1)).alias("total_events"))


def shareholder_score(d: DataFrame) -> DataFrame:
    """(signal, total_ratio, direction, risk, letters) -> 50 +- components and rating."""
    s = (F.lit(50) + ladder((c("signal") == "bullish", 15), (c("signal") == "slightly_bullish", 8), (c("signal") == "bearish", -15),
                            (c("signal") == "slightly_bearish", -8), default=0)
         + ladder((c("total_ratio") > 60, 10), (c("total_ratio") > 40, 5), (c("total_ratio") < 20, -5), default=0)
         + ladder((c("direction") == "net_buy", 15), (c("direction") == "net_sell", -15), default=0)
         + ladder((c("risk") == "high", -10), (c("risk") == "medium", -5), default=5) - F.least(c("letters") * 3, F.lit(10)))
    d = d.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), s)))
    return d.withColumn("rating", ladder((c("score") >= 80, "excellent"), (c("score") >= 65, "good"), (c("score") >= 50, "neutral"),
                                         (c("score") >= 35, "weak"), default="poor"))
