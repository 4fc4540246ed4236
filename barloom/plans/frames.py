"""SQL building blocks for bar queries: staged window columns over brand-week bars."""

from barloom.plans import bindings as D

_PREV = ", ".join(f"lag({x}) OVER w AS p{x[0]}" for x in ("open", "high", "low", "close", "volume"))
BASE = D.BRAND_WEEK + f""",
b0 AS (SELECT *, row_number() OVER w - 1 AS i, {_PREV} FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)),
b AS (SELECT *, close - pc AS d, close / pc - 1 AS r, (high + low + close) / 3 AS tp,
  greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM b0)"""
WIN = "WINDOW w AS (PARTITION BY code ORDER BY ts)"


def over(expr: str, n: int, skip: int = 0, need: int | None = None) -> str:
    """expr over the last n rows (skipping the newest ``skip``); null before n rows unless ``need`` is given."""
    frame = f"OVER (w ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else f"OVER (w ROWS {n - 1} PRECEDING)"
    need = n if need is None else need
    if need <= 1:
        return f"({expr} {frame})"
    arg = expr[expr.index("(") + 1:expr.rindex(")")].split(",")[0]
    return f"(CASE WHEN count({arg}) {frame} >= {need} THEN {expr} {frame} END)"


def run(expr: str) -> str:
    return f"({expr} OVER (w ROWS UNBOUNDED PRECEDING))"


def ema(x: str, a: float, start: int = 0) -> str:
    """Closed form of the exponential mean whose first value is at position ``start``."""
    q = repr(1 - a)
    return (f"(pow({q}, i) * sum((CASE WHEN i = {start} THEN 1e0 ELSE {a!r} END) * {x} * pow({q}, -i)) "
            f"OVER (w ROWS UNBOUNDED PRECEDING))")


def span(n):
    return 2.0 / (n + 1)


MACD = [{"e12": ema("close", span(12)), "e26": ema("close", span(26))}, {"dif": "e12 - e26"},
        {"dea": ema("dif", span(9))}, {"bar": "(dif - dea) * 2"}]


def staged(stages, base: str = BASE, src: str = "b") -> tuple[str, str]:
    """CTE text with one CTE per stage, and the name of the last one."""
    text, last = base, src
    for k, stage in enumerate(stages, 1):
        cols = ", ".join(f"{v} AS {n}" for n, v in stage.items())
        text += f",\nst{k} AS (SELECT *, {cols} FROM {last} {WIN})"
        last = f"st{k}"
    return text, last


def frame_sql(select: str, stages=(), base: str = BASE, src: str = "b", where: str = "") -> str:
    text, last = staged(stages, base, src)
    return f"{text}\n---\nSELECT {select} FROM {last} {where} {WIN}"


def bands(x: str, steps, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {t} THEN '{label}'" for t, label in steps) + f" WHEN {x} IS NOT NULL THEN '{last}' END"
