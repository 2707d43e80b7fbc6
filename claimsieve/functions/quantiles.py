"""Quantiles of many columns: sketched within a rank error, or exact.

The quantile of ``prob`` over n values is the value of rank ``ceil(prob * n)``: an element of
the column, never an interpolation. Nulls and NaN are left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from claimsieve.functions.columns import finite

Quantiles = dict[str, list[float | None]]


#: Groups of input splits whose sketches are merged ahead of the last merge.
_GROUPS = 512


def sketch_size(rel_err: float) -> int:
    """The size of a KLL sketch whose rank error is, in all but one of a hundred cases, ``rel_err`` at most."""
    return min(65_535, max(8, math.ceil((2.296 / rel_err) ** (1 / 0.9021))))


def sketch_aggregates(
    df: DataFrame, columns: Mapping[str, Column], probs: Mapping[str, Sequence[float]], size: int, others: Mapping[str, tuple[Column, Column]] | None = None
) -> Row:
    """Quantiles of expressions, one row: an array of ``probs[name]`` for each name, None without values.

    Sketches are merged in two levels: each task makes its own, ``_GROUPS`` tasks at most merge those of
    a group of splits, and the last task has a sketch of each group, however many splits there are.
    ``others`` are more aggregates, as a pair: over the rows, and over the groups' results under the same name.
    """
    others = others or {}
    by_group = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("_group")).agg(
        *(F.kll_sketch_agg_double(value, F.lit(size)).alias(f"sketch_{name}") for name, value in columns.items()),
        *(F.count(value).alias(f"n_{name}") for name, value in columns.items()),
        *(inner.alias(name) for name, (inner, _) in others.items()),
    )
    merged = by_group.agg(
        *(F.kll_merge_agg_double(f"sketch_{name}").alias(f"sketch_{name}") for name in columns),
        *(F.sum(f"n_{name}").alias(f"n_{name}") for name in columns),
        *(outer.alias(name) for name, (_, outer) in others.items()),
    )
    found = []
    for name in columns:
        ranks = F.array(*(F.lit(float(p)) for p in probs[name]))
        found.append(F.when(F.col(f"n_{name}") > 0, F.kll_sketch_get_quantile_double(f"sketch_{name}", ranks)).alias(f"q_{name}"))
    return merged.select(*(f"n_{name}" for name in columns), *others, *found).head()


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], rel_err: float) -> Quantiles:
    """Quantiles of every column in one pass; ``rel_err`` 0 asks for exact ones.

    A column without values has ``None`` for each probability. The sketches are four times as fine as
    ``rel_err`` asks for, as their error is a matter of chance.
    """
    if rel_err == 0:
        return exact_quantiles(df, columns, probs)
    names = {str(i): finite(c) for i, c in enumerate(columns)}
    row = sketch_aggregates(df, names, dict.fromkeys(names, probs), sketch_size(rel_err / 4))
    return {c: row[f"q_{i}"] or [None] * len(probs) for i, c in enumerate(columns)}


#: Cuts on either side of a wanted rank.
_CUTS = 16


@dataclass
class _Target:
    """A quantile being looked for: its rank lies among the values from ``low`` up to but not at ``high``."""

    place: int
    prob: float
    rank: int
    inside: int  # values in that interval
    low: float = -math.inf
    high: float = math.inf
    below: int = 0  # values under low
    value: float | None = None

    def within(self) -> Column:
        """The column's values in the interval, null elsewhere."""
        value = F.col(_name(self.place))
        return F.when((value >= F.lit(self.low)) & (value < F.lit(self.high)), value)

    def narrow(self, splits: Sequence[float], counts: Mapping[int, int]) -> None:
        """Keep the piece that holds the rank, given the counts of the column's values between splits."""
        under = 0
        for k, (low, high) in enumerate(zip(splits, splits[1:])):
            under, before = under + counts.get(k, 0), under
            if under >= self.rank:
                self.low, self.high, self.below, self.inside = low, high, before, under - before
                if high == math.nextafter(low, math.inf):
                    self.value = low
                return


def _name(place: int) -> str:
    return f"v{place}"


def _shares(share: float, err: float) -> list[float]:
    """Shares evenly around the wanted one, so that their sketched values lie on both sides of the value wanted."""
    return [min(1.0, max(0.0, share + 2 * err * k / _CUTS)) for k in range(-_CUTS, _CUTS + 1)]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    sketch_err: float = 0.0025,
    collect_rows: int = 20_000,
) -> Quantiles:
    """Exact quantiles whose memory does not grow with the data.

    A pass sketches some 33 cuts around each wanted rank, the next counts the values of all columns between all cuts (and at each cut, however many
    rows have that value), by binary search. What then holds a rank has about an eighth of ``sketch_err`` of the values; once that
    is ``collect_rows`` or fewer, they are collected and sorted, else it is cut again. The counts are exact, so
    cuts that the sketch puts wrongly cost a round and not the result. Up to 60 million rows take one
    round, ten billion two; ``df`` should be a stored table. Infinite values are counted apart.
    """
    some = [finite(c) + F.lit(0.0) for c in columns]  # -0.0 becomes 0.0
    real = [F.when(F.abs(v) < F.lit(math.inf), v) for v in some]
    values = df.select(*(v.alias(_name(i)) for i, v in enumerate(real)))
    lowest = {f"low_{i}": (F.count_if(v == F.lit(-math.inf)), F.sum(f"low_{i}")) for i, v in enumerate(some)}
    highest = {f"high_{i}": (F.count_if(v == F.lit(math.inf)), F.sum(f"high_{i}")) for i, v in enumerate(some)}
    shares = [x for p in probs for x in _shares(p, sketch_err)]
    first = sketch_aggregates(df, {str(i): v for i, v in enumerate(real)}, dict.fromkeys(map(str, range(len(columns))), shares), sketch_size(sketch_err), lowest | highest)
    targets, cuts = [], {}
    for i in range(len(columns)):
        n, low, high = first[f"n_{i}"], first[f"low_{i}"] or 0, first[f"high_{i}"] or 0
        for p in probs if n + low + high else []:
            rank = max(1, math.ceil(Fraction(str(p)) * (n + low + high))) - low
            value = -math.inf if rank < 1 else math.inf if rank > n else None
            targets.append(_Target(i, p, rank, n, value=value))
        cuts[i] = first[f"q_{i}"] or []
    while wide := [t for t in targets if t.value is None and t.inside > collect_rows]:
        cuts = cuts or _cuts(values, wide, sketch_err)
        splits = {i: sorted({-math.inf, math.inf, *(x for c in cuts[i] for x in (c, math.nextafter(c, math.inf)))}) for i in {t.place for t in wide}}
        counts = _count_between(values, splits)
        for t in wide:
            t.narrow(splits[t.place], counts[t.place])
        cuts = {}
    if near := [t for t in targets if t.value is None]:
        _decide(values, near)
    found = {(t.place, t.prob): t.value for t in targets}
    return {c: [found.get((i, p)) for p in probs] for i, c in enumerate(columns)}


def _cuts(values: DataFrame, targets: list[_Target], err: float) -> dict[int, list[float]]:
    """By column, new cuts for every target, sketched from the values in its present interval, and the ends of that."""
    shares = {str(k): _shares((t.rank - t.below) / t.inside, err) for k, t in enumerate(targets)}
    row = sketch_aggregates(values, {str(k): t.within() for k, t in enumerate(targets)}, shares, sketch_size(err))
    found: dict[int, list[float]] = {}
    for k, t in enumerate(targets):
        found.setdefault(t.place, []).extend([*row[f"q_{k}"], *(x for x in (t.low, t.high) if math.isfinite(x))])
    return found


def _count_between(values: DataFrame, splits: Mapping[int, Sequence[float]]) -> dict[int, dict[int, int]]:
    """By column, how many values lie from each split up to the next, all in one pass; at most a row for each interval and task is shuffled."""
    places = sorted(splits)
    names, pieces = [_name(i) for i in places], [f"piece{i}" for i in places]
    cut = Bucketizer(splitsArray=[list(splits[i]) for i in places], inputCols=names, outputCols=pieces, handleInvalid="keep")
    # nulls have no piece
    numbers = [F.when(F.col(n).isNotNull(), F.col(p)).alias(p) for n, p in zip(names, pieces)]
    rows = cut.transform(values.select(*names)).select(*numbers).unpivot([], pieces, "column", "piece")
    found: dict[int, dict[int, int]] = {i: {} for i in places}
    for column, piece, n in rows.where("piece is not null").groupBy("column", "piece").agg(F.count("*")).collect():
        found[int(column.removeprefix("piece"))][int(piece)] = n
    return found


def counts_between(df: DataFrame, splits: Mapping[str, Sequence[float]]) -> tuple[int, dict[str, dict[int, int]]]:
    """The rows, and by column how many of its values lie from each split up to the next; null and NaN lie nowhere.

    Each column needs three splits or more, in ascending order.
    """
    columns = list(splits)
    values = df.select(*(finite(c).alias(_name(i)) for i, c in enumerate(columns)))
    counted = _count_between(values, {i: splits[c] for i, c in enumerate(columns)})
    return values.count(), {c: counted[i] for i, c in enumerate(columns)}


def _decide(values: DataFrame, targets: list[_Target]) -> None:
    """Sort the values of the last pieces, whose number has been counted.

    A binary search a column finds a value's piece, however many targets there are: a condition for each of them would be worked out for every row.
    """
    by_place: dict[int, list[_Target]] = {}
    for t in targets:
        by_place.setdefault(t.place, []).append(t)
    splits = {i: sorted({-math.inf, 0.0, math.inf, *(x for t in some for x in (t.low, t.high))}) for i, some in by_place.items()}
    names, pieces = [_name(i) for i in splits], [f"piece{i}" for i in splits]
    cut = Bucketizer(splitsArray=list(splits.values()), inputCols=names, outputCols=pieces, handleInvalid="keep")
    found = []
    for i, name, piece in zip(splits, names, pieces):
        spans = enumerate(zip(splits[i], splits[i][1:]))
        wanted = [float(k) for k, (low, high) in spans if any(t.low <= low and high <= t.high for t in by_place[i])]
        inside = F.col(name).isNotNull() & F.col(piece).isin(wanted)
        found.append(F.when(inside, F.struct(F.lit(i).alias("place"), F.col(name).alias("value"))))
    rows = cut.transform(values.select(*names)).select(F.explode(F.array(*found)).alias("near")).where("near is not null")
    near: dict[int, list[float]] = {}
    for place, value in rows.select("near.*").collect():
        near.setdefault(place, []).append(value)
    for place, some in near.items():
        some.sort()
        for t in by_place[place]:
            t.value = some[bisect_left(some, t.low) + t.rank - t.below - 1]
