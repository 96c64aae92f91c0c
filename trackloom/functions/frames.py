"""Windows over the rows of a trajectory, and the small geometry that features are made of.

Rows are taken in frame order within the keys, by position: a gap in frame numbers is no gap here. Missing values are
NULL throughout. Rolling figures skip NULLs and need a least number of values in their window (mp).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-6
#: Over so many rows a mean or sum is taken from running totals: a sliding window costs its length for every row.
LONG = 200
#: Weights of an exponentially weighted mean grow by so many powers of ten in a block of rows.
GROWN = 100


def scale(n: float, fps: float | None = 30.0) -> int:
    """A length in frames at 30 a second, at fps: half-even rounding, 1 at least. An unknown or bad fps counts as 30."""
    fps = fps if fps and fps > 0 and math.isfinite(fps) else 30.0
    return max(1, round(n * fps / 30.0))


def scale_signed(n: float, fps: float | None = 30.0) -> int:
    """The same with a sign; 0 stays 0."""
    return 0 if n == 0 else int(math.copysign(scale(abs(n), fps), n))


def milliseconds(ms: float, fps: float | None = 30.0) -> int:
    """Frames in a time; half-even rounding, 1 at least."""
    fps = fps if fps and fps > 0 and math.isfinite(fps) else 30.0
    return max(1, round(ms * fps / 1000.0))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def cosine(ax: Column, ay: Column, bx: Column, by: Column, eps: float = EPS) -> Column:
    return (ax * bx + ay * by) / (norm(ax, ay) * norm(bx, by) + F.lit(eps))


def wrap(angle: Column) -> Column:
    """An angle difference within two turns, brought to [-pi, pi]."""
    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle < -math.pi, angle + 2 * math.pi).otherwise(angle)


def wrap_mod(angle: Column) -> Column:
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def flag(condition: Column) -> Column:
    """1.0 where true; 0.0 where false or unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def bins(c: Column, edges: tuple[float, ...] = (0.5, 2.0, 5.0)) -> Column:
    """Number of the right-closed bin."""
    out = reduce(lambda done, ke: done.when(c <= ke[1], ke[0]), enumerate(edges), F.when(c.isNull(), None))
    return out.otherwise(len(edges))


@dataclass(frozen=True)
class Track:
    """Windows within keys, by frame, at a frame rate."""

    keys: tuple[str, ...]
    frame: str = "frame"
    fps: float | None = 30.0

    @property
    def over(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.frame)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def rate(self) -> float:
        return self.fps if self.fps and self.fps > 0 and math.isfinite(self.fps) else 30.0

    def ws(self, n: float) -> int:
        return scale(n, self.fps)

    def shift(self, c: Column, n: int) -> Column:
        """The value n rows before (after, if negative)."""
        return F.lag(c, n).over(self.over) if n >= 0 else F.lead(c, -n).over(self.over)

    def diff(self, c: Column, n: int = 1) -> Column:
        return c - self.shift(c, n)

    def rows(self, ws: int, centred: bool) -> tuple[int, int]:
        return (-(ws // 2), (ws - 1) // 2) if centred else (-(ws - 1), 0)

    def roll(self, agg, c: Column, ws: int, centred: bool, mp: int) -> Column:
        frame = self.over.rowsBetween(*self.rows(ws, centred))
        value = agg(c).over(frame)
        return value if mp <= 1 else F.when(F.count(c).over(frame) >= mp, value)

    def _mp(self, ws: int, part: int | None, mp: int | None) -> int:
        return mp if mp is not None else max(1, ws // part) if part else 1

    def mean(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.avg, c, ws, centred, self._mp(ws, part, mp))

    def sum(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.sum, c, ws, centred, self._mp(ws, part, mp))

    def std(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.stddev_samp, c, ws, centred, self._mp(ws, part, mp))

    def var(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.var_samp, c, ws, centred, self._mp(ws, part, mp))

    def least(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.min, c, ws, centred, self._mp(ws, part, mp))

    def most(self, c: Column, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        ws = self.ws(n)
        return self.roll(F.max, c, ws, centred, self._mp(ws, part, mp))

    def quantile(self, c: Column, p: float, n: float, centred: bool = False, part: int | None = None, mp: int | None = None) -> Column:
        """Interpolated, exact."""
        ws = self.ws(n)
        return self.roll(lambda x: F.percentile(x, p), c, ws, centred, self._mp(ws, part, mp))

    def corr(self, a: Column, b: Column, n: float, centred: bool = False, part: int | None = None) -> Column:
        """Pearson's correlation of the rows that have both values; NULL where one doesn't vary."""
        ws = self.ws(n)
        frame = self.over.rowsBetween(*self.rows(ws, centred))
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        spread = F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
        return F.when(F.count(a).over(frame) >= self._mp(ws, part, None), F.try_divide(F.covar_samp(a, b).over(frame), spread))

    def percent_rank(self, c: Column, n: float, mp: int) -> Column:
        """Average rank of the current value among those of the trailing window, as a share of their number."""
        seen = F.collect_list(c).over(self.over.rowsBetween(-(self.ws(n) - 1), 0))
        below = F.size(F.filter(seen, lambda v: v < c))
        same = F.size(F.filter(seen, lambda v: v == c))
        return F.when(c.isNotNull() & (F.size(seen) >= mp), (below + (same + 1) / 2) / F.size(seen))

    def full(self, agg, c: Column, ws: int, centred: bool = True) -> Column:
        """A rolling figure that needs a value in every row of its window, ws rows as they are."""
        return self.roll(agg, c, ws, centred, max(ws, 1)) if ws > 1 else agg(c).over(self.over.rowsBetween(0, 0))

    def lagged_mean(self, c: Column, ws: int) -> Column:
        """Mean of the ws rows before this one, if all have a value."""
        frame = self.over.rowsBetween(-ws, -1)
        return F.when(F.count(c).over(frame) == ws, F.avg(c).over(frame))

    def ewm(self, df: DataFrame, out: dict[str, tuple[str, int]]) -> DataFrame:
        """Adds exponentially weighted means by absolute position, {name: (column, span)}: exact, and carried over missing
        rows however many.

        A row in a block weighs 1 / (1 - a) for each place before it, so a mean is a ratio of two running sums. A block is
        so long that weights grow by about 10 ** GROWN in it; what its sums start from is, by the same scale, what the
        last block with values ended with, together with the block before that one: all else weighs nothing beside it.
        """
        whole = {name: (column, 1 - 2.0 / (span + 1)) for name, (column, span) in out.items()}
        lost = [name for name, (_, keep) in whole.items() if keep <= 0]
        whole = {name: x for name, x in whole.items() if name not in lost}
        made = df.withColumns({name: F.last(F.col(out[name][0]), True).over(self.over.rowsBetween(Window.unboundedPreceding, 0)) for name in lost})
        size = {keep: max(1, int(GROWN * math.log(10) / -math.log(keep))) for _, keep in whole.values()}
        tag = {keep: f"_ew{k}" for k, keep in enumerate(size)}
        made = made.withColumn("_ew_at", F.row_number().over(self.over) - 1) if whole else made
        made = made.withColumns({f"{tag[keep]}_block": F.floor(F.col("_ew_at") / n) for keep, n in size.items()} | {f"{tag[keep]}_weight": F.pow(F.lit(1 / keep), F.pmod("_ew_at", F.lit(n))) for keep, n in size.items()})
        sums, before, carry = {}, {}, {}
        upto, earlier = (Window.unboundedPreceding, 0), self.over.rowsBetween(Window.unboundedPreceding, -1)
        for name, (column, keep) in whole.items():
            own = Window.partitionBy(*self.keys, f"{tag[keep]}_block").orderBy(self.frame).rowsBetween(*upto)
            weight = F.when(F.col(column).isNotNull(), F.col(f"{tag[keep]}_weight"))
            sums |= {f"_ew_n_{name}": F.coalesce(F.sum(F.col(column) * weight).over(own), F.lit(0.0)), f"_ew_d_{name}": F.coalesce(F.sum(weight).over(own), F.lit(0.0))}
        made = made.withColumns(sums)
        for name, (_, keep) in whole.items():
            ends = F.pmod("_ew_at", F.lit(size[keep])) == size[keep] - 1
            before[f"_ew_b_{name}"] = F.last(F.when(ends, F.struct(F.col(f"_ew_n_{name}").alias("n"), F.col(f"_ew_d_{name}").alias("d"))), True).over(earlier)
        made = made.withColumns(before)
        for name, (_, keep) in whole.items():
            ends = F.pmod("_ew_at", F.lit(size[keep])) == size[keep] - 1
            with_last = [F.col(f"_ew_{x}_{name}") + F.coalesce(F.col(f"_ew_b_{name}.{x}"), F.lit(0.0)) * keep ** size[keep] for x in "nd"]
            state = F.struct(with_last[0].alias("n"), with_last[1].alias("d"), F.col(f"{tag[keep]}_block").alias("block"))
            carry[f"_ew_c_{name}"] = F.last(F.when(ends & (F.col(f"_ew_d_{name}") > 0), state), True).over(earlier)
        made, means = made.withColumns(carry), {}
        for name, (_, keep) in whole.items():
            old = F.col(f"_ew_c_{name}")
            fade = F.coalesce(F.pow(F.lit(keep**size[keep]), F.col(f"{tag[keep]}_block") - old["block"]), F.lit(0.0))
            n, d = (F.col(f"_ew_{x}_{name}") + F.coalesce(old[x], F.lit(0.0)) * fade for x in "nd")
            means[name] = F.when(F.col(f"_ew_d_{name}") > 0, n / d).otherwise(old["n"] / old["d"])
        extra = [k for k in made.columns if k.startswith("_ew") and k not in df.columns]
        return made.withColumns(means).drop(*extra)

    def islands(self, change: Column) -> Column:
        """Number of changes so far."""
        return F.sum(change.cast("int")).over(self.over.rowsBetween(Window.unboundedPreceding, 0))

    def totals(self, c: Column) -> tuple[Column, Column]:
        """Running sum and count, for long_mean(); columns of a layer below it."""
        upto = self.over.rowsBetween(Window.unboundedPreceding, 0)
        return F.coalesce(F.sum(c).over(upto), F.lit(0.0)), F.count(c).over(upto)

    def long_mean(self, total: Column, count: Column, ws: int, centred: bool, mp: int) -> Column:
        """mean() of a long window from the columns of totals(): two look-ups instead of ws values a row."""
        low, high = self.rows(ws, centred)
        whole = self.over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # read once a track

        def upto(c: Column, k: int) -> Column:
            """The running figure k rows on; that of the last row beyond the end."""
            return F.coalesce(self.shift(c, -k), F.last(c).over(whole)) if k > 0 else c

        n = upto(count, high) - F.coalesce(self.shift(count, 1 - low), F.lit(0))
        return F.when(n >= max(mp, 1), (upto(total, high) - F.coalesce(self.shift(total, 1 - low), F.lit(0.0))) / n)
