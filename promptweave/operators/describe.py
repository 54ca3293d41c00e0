"""Descriptive statistics with exact quartiles over tables of any size, in two scans.

An exact percentile aggregate would keep every distinct value of a column in one
task. Here the first scan takes a mergeable quantile sketch (KLL) per column, which
knows the number of values, both ends, and for every wanted rank a bracket of two
values that few rows lie between. The second scan counts cells: the gaps before,
between and behind brackets, and a bracket's rows value by value where it is expected
to hold at most ``VALUES`` of them, else by ``BINS`` bins. Counts, means and variances
of the cells add up to those of the column, and the running count finds each rank's
cell. One that is no single value, be it a bin or, which is very unlikely, a gap, is
the bracket of another scan, so quartiles are exact whatever the sketch says.

A bracket holds about ``2 * RANK_ERROR`` of the rows: two scans do for up to two million
values per column, and each further one for ``BINS`` times as many. A scan returns by
expectation at most ``VALUES`` rows per bracket and moves no values between executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.session import shared_folder

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
BINS = 512
VALUES = 8192
WIDE_RATIO = 1000.0
SKETCH_SIZE = 4096
#: Half a bracket as a share of the rows, near three times what a sketch of that size errs by.
RANK_ERROR = 0.002


@dataclass(frozen=True)
class _Bracket:
    """Closed range of a column's values that should hold a rank, and how many rows it may have."""

    low: float
    high: float
    rows: float

    def by_value(self) -> bool:
        return self.rows <= VALUES or self.low == self.high

    def bin_of(self, value: Column) -> Column:
        """Number of a value's bin, for values in the bracket, whose ends are finite if it has bins.

        Bins are of equal width, or of equal ratio where a positive bracket
        spans orders of magnitude. A bracket that is counted by value is one bin.
        """
        if self.by_value():
            return F.lit(0)
        low, high = F.lit(self.low), F.lit(self.high)
        if self.low > 0 and self.high / WIDE_RATIO > self.low:
            share = (F.ln(value) - F.ln(low)) / (F.ln(high) - F.ln(low))
        else:
            # The ends may be further apart than the largest double.
            scale = 1.0 if math.isfinite(self.high - self.low) else 0.5
            share = (value * scale - low * scale) / (high * scale - low * scale)
        return F.greatest(F.least((share * BINS).cast("int"), F.lit(BINS - 1)), F.lit(0))


@dataclass(frozen=True)
class _Cell:
    """Values of a column next to each other: both ends, their number, mean and variance."""

    low: float
    high: float
    rows: int
    mean: float
    variance: float


def _disjoint(brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """In order, overlapping ones as one."""
    found: list[_Bracket] = []
    for b in sorted(set(brackets), key=lambda b: (b.low, b.high)):
        if found and b.low < found[-1].high:
            last = found.pop()
            b = _Bracket(last.low, max(last.high, b.high), last.rows + b.rows)
        found.append(b)
    return found


def _cell_number(value: Column, brackets: list[_Bracket]) -> Column:
    cell = F.when(value < brackets[0].low, F.lit(0))
    for i, b in enumerate(brackets):
        first = 1 + i * (BINS + 1)
        if i:
            cell = cell.when(value < b.low, F.lit(first - 1))
        cell = cell.when(value <= b.high, F.lit(first) + b.bin_of(value))
    return cell.otherwise(F.lit(len(brackets) * (BINS + 1)))


def _standing_apart(value: Column, brackets: list[_Bracket]) -> Column:
    """The value where it is counted for itself, else NULL."""
    apart = F.lit(False)
    for b in brackets:
        if b.by_value():
            apart = apart | ((value >= b.low) & (value <= b.high))
    return F.when(apart, value)


def _counted(df: DataFrame, brackets: dict[str, list[_Bracket]]) -> dict[str, list[_Cell]]:
    """Non-empty cells of every column, in order; in one job."""
    # Each value is worked out once, before it is stacked, and compared with its column's brackets after that.
    entries = [e for n, c in enumerate(brackets) for e in (F.lit(n), F.col(c))]
    stacked = F.stack(F.lit(len(brackets)), *entries).alias("column", "value")
    rows = df.select(stacked).where("value IS NOT NULL")
    value, cell, apart = F.col("value"), F.lit(0), F.lit(None).cast("double")
    for n, own in enumerate(brackets.values()):
        here = F.col("column") == n
        cell = F.when(here, _cell_number(value, own)).otherwise(cell)
        apart = F.when(here, _standing_apart(value, own)).otherwise(apart)
    cells = rows.select("column", "value", cell.alias("cell"), apart.alias("apart"))
    found: dict[str, list[_Cell]] = {c: [] for c in brackets}
    names = list(brackets)
    counted = cells.groupBy("column", "cell", "apart").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
    )
    for r in sorted(counted.collect(), key=lambda r: (r["column"], r["low"])):
        found[names[r["column"]]].append(_Cell(r["low"], r["high"], r["n"], r["mean"], r["variance"]))
    return found


def _moments(cells: list[_Cell]) -> tuple[float, float | None]:
    """Mean and sample deviation of all values from those of their cells."""
    rows = sum(c.rows for c in cells)
    mean = math.fsum(c.rows / rows * c.mean for c in cells) if all(math.isfinite(c.mean) for c in cells) else sum(
        c.mean for c in cells
    )
    if rows < 2:
        return mean, None
    squares = sum(c.rows * (c.variance + (c.mean - mean) * (c.mean - mean)) for c in cells)
    return mean, math.sqrt(squares / (rows - 1))


def _values_at(
    ranks: dict[str, dict[int, _Bracket]], counted: dict[str, list[_Cell]], solved: dict[tuple[str, int], float]
) -> dict[str, dict[int, _Bracket]]:
    """Enter the ranks whose cell is one value into ``solved``; returns brackets for the others."""
    left: dict[str, dict[int, _Bracket]] = {}
    for column, wanted in ranks.items():
        for rank in wanted:
            below = 0
            for cell in counted[column]:
                if rank < below + cell.rows:
                    if cell.low == cell.high:
                        solved[column, rank] = cell.low
                    else:
                        left.setdefault(column, {})[rank] = _Bracket(cell.low, cell.high, cell.rows)
                    break
                below += cell.rows
    return left


def _with_finite_ends(df: DataFrame, ranks: dict[str, dict[int, _Bracket]]) -> dict[str, dict[int, _Bracket]]:
    """Brackets to be cut into bins get the outermost finite values in place of infinite ends."""
    endless = [
        c
        for c, wanted in ranks.items()
        if any(not b.by_value() and not (math.isfinite(b.low) and math.isfinite(b.high)) for b in wanted.values())
    ]
    if not endless:
        return ranks
    ends = []
    for c in endless:
        finite = F.when(F.abs(c) < math.inf, F.col(c))
        ends += [F.min(finite).alias(f"{c}.from"), F.max(finite).alias(f"{c}.to")]
    row = df.agg(*ends).first()

    def finite_ends(column: str, bracket: _Bracket) -> _Bracket:
        least, greatest = row[f"{column}.from"], row[f"{column}.to"]
        if bracket.by_value() or least is None:
            return _Bracket(bracket.low, bracket.high, 0 if least is None else bracket.rows)
        return _Bracket(max(bracket.low, least), min(bracket.high, greatest), bracket.rows)

    return {
        c: {r: finite_ends(c, b) for r, b in wanted.items()} if c in endless else wanted for c, wanted in ranks.items()
    }


def _sketched(numbers: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, list[float]]]:
    """Number of values of each column, its ends, and the ends of the quartiles' brackets."""
    shares = [0.0, 1.0]
    for share in QUARTILES.values():
        shares += [share - RANK_ERROR, share + RANK_ERROR]
    wanted, taken = F.array(*[F.lit(s) for s in shares]), []
    for i, c in enumerate(columns):
        sketch = F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE))
        n = F.kll_sketch_get_n_double(sketch)
        quantiles = F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, wanted))
        taken += [n.alias(f"n{i}"), quantiles.alias(f"q{i}")]
    row = numbers.agg(*taken).first()
    return {c: (row[f"n{i}"] or 0, row[f"q{i}"]) for i, c in enumerate(columns)}


def _interpolated(values: dict[tuple[str, int], float], column: str, position: float) -> float:
    rank = math.floor(position)
    low, high, share = values[column, rank], values[column, math.ceil(position)], position - rank
    if share == 0 or low == high:
        return low
    step = (high - low) * share
    if math.isfinite(step) or math.isinf(low) or math.isinf(high):
        return low + step
    return low * (1 - share) + high * share


def describe(
    df: DataFrame, columns: Sequence[str], digits: int | None = 2, materialise: bool = True
) -> DataFrame:
    """One row per column: count, mean, std (sample), min, quartiles, max.

    Quartiles interpolate linearly between neighbouring ranks and values are
    rounded half to even; NULL and NaN are left out. Infinities are the ends of
    the order. ``materialise`` writes the numeric columns once to the shared
    folder, which pays off when they are computed from text; pass False for a
    table that is already stored.
    """
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    if materialise:
        shared_folder(df.sparkSession)
        numbers = numbers.checkpoint()
    sketched = _sketched(numbers, columns)
    position: dict[tuple[str, str], float] = {}
    ranks: dict[str, dict[int, _Bracket]] = {}
    for c, (n, found) in sketched.items():
        for q, (name, share) in enumerate(QUARTILES.items() if n else ()):
            ends = found[:2] if n <= VALUES else found[2 * q + 2 : 2 * q + 4]
            bracket = _Bracket(*ends, min(n, math.ceil(2 * RANK_ERROR * n)) if n > VALUES else n)
            position[c, name] = share * (n - 1)
            for rank in (math.floor(position[c, name]), math.ceil(position[c, name])):
                ranks.setdefault(c, {})[rank] = bracket
    moments: dict[str, tuple[float, float | None]] = {}
    values: dict[tuple[str, int], float] = {}
    while ranks:
        ranks = _with_finite_ends(numbers, ranks)
        counted = _counted(numbers, {c: _disjoint(list(w.values())) for c, w in ranks.items()})
        moments = moments or {c: _moments(cells) for c, cells in counted.items()}
        ranks = _values_at(ranks, counted, values)
    rows = []
    for c, (n, found) in sketched.items():
        if n:
            quartiles = [_interpolated(values, c, position[c, name]) for name in QUARTILES]
            rows.append((c, n, *moments[c], found[0], *quartiles, found[1]))
        else:
            rows.append((c, 0, *[None] * 7))
    schema = (
        "feature string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    table = df.sparkSession.createDataFrame(rows, schema)
    if digits is None:
        return table
    rounded = {c: F.bround(c, digits) for c in table.columns[2:]}
    return table.withColumns(rounded)
