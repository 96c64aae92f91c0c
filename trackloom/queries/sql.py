"""SQL text of rolling figures and of queries in layers."""

from __future__ import annotations

OVER = "partition by entity order by frame"


def rows(ws: int, centred: bool) -> str:
    low, high = (ws // 2, (ws - 1) // 2) if centred else (ws - 1, 0)
    return f"rows between {low} preceding and {high} following"


def roll(agg: str, e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    """agg has {} where the expression goes."""
    mp = mp if mp is not None else max(1, ws // part) if part else 1
    frame = f"over ({over} {rows(ws, centred)})"
    return f"case when count({e}) {frame} >= {mp} then {agg.format(e)} {frame} end"


def mean(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("avg({})", e, ws, centred, part, mp, over)


def total(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("sum({})", e, ws, centred, part, mp, over)


def std(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("stddev_samp({})", e, ws, centred, part, mp, over)


def var(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("var_samp({})", e, ws, centred, part, mp, over)


def least(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("min({})", e, ws, centred, part, mp, over)


def most(e: str, ws: int, centred: bool = False, part: int | None = None, mp: int | None = None, over: str = OVER) -> str:
    return roll("max({})", e, ws, centred, part, mp, over)


def shift(e: str, n: int, over: str = OVER) -> str:
    return f"lag({e}, {n}) over ({over})" if n >= 0 else f"lead({e}, {-n}) over ({over})"


def diff(e: str, n: int = 1, over: str = OVER) -> str:
    return f"({e} - {shift(e, n, over)})"


def norm(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def cosine(ax: str, ay: str, bx: str, by: str) -> str:
    return f"((({ax}) * ({bx}) + ({ay}) * ({by})) / ({norm(ax, ay)} * {norm(bx, by)} + 1e-6))"


def wrap(a: str) -> str:
    return f"(case when {a} > pi() then {a} - 2 * pi() when {a} < -pi() then {a} + 2 * pi() else {a} end)"


def wrap_mod(a: str) -> str:
    turn = f"(({a}) + pi())"
    return f"({turn} - floor({turn} / (2 * pi())) * 2 * pi() - pi())"


def flag(condition: str) -> str:
    return f"(case when {condition} then 1.0 else 0.0 end)::double"


def layered(base: str, layers: list[dict[str, str]], keys: list[str], out: list[str], digits: int = 4, ctes: str = "") -> str:
    """base is a SELECT; each layer adds columns that may use those below; keys come as they are, out rounded."""
    text = f"with {ctes + ', ' if ctes else ''}l0 as ({base})"
    for k, layer in enumerate(layers):
        text += f",\nl{k + 1} as (select *, " + ", ".join(f'{e} as "{n}"' for n, e in layer.items()) + f" from l{k})"
    cells = ", ".join(f'round("{n}"::double, {digits}) + 0.0 as "{n}"' for n in out)
    return f"{text}\nselect {', '.join(keys)}, {cells} from l{len(layers)}"
