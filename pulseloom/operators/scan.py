"""Ordered recurrences over series that are cut into blocks.

A recurrence that waits for the row before can still be split where a run of
rows is one map from the state before it to the state behind it, and such maps
compose: an exponential mean is an affine map, the variance of a scalar Kalman
filter a 2x2 matrix (a fraction of two linear forms) that a reset makes
constant, and its state an affine map once the variances are known.

Rows of a series are dealt to chunks of CHUNK rows, which tasks hold on their
own. The chunks of a longer series first give their maps, a row each; these are
combined in order, and every chunk then runs from its own start. Within a task
the chunks of all series are cut into lanes of LANE rows that are stepped
through side by side, so that a step is one operation on a vector of lanes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that one task holds at most, rows of a lane, rows that are stepped through side by side.
CHUNK, LANE, TOGETHER = 1 << 18, 64, 1 << 17


class Grid:
    """Rows of some chunks, one after the other, as a matrix of lanes: [step, lane]."""

    def __init__(self, sizes: np.ndarray, lane: int | None = None):
        self.sizes, lane = sizes, lane or LANE
        self.per = -(-sizes // lane)
        self.first = np.cumsum(self.per) - self.per
        self.begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(self.begin, sizes)
        self.at = at % lane, np.repeat(self.first, sizes) + at // lane
        self.shape = (int(min(lane, sizes.max(initial=0))), int(self.per.sum()))
        self._order = np.argsort(-self.per, kind="stable")
        self._sorted = -self.per[self._order]

    def spread(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full((*self.shape, *values.shape[1:]), fill)
        out[self.at] = values
        return out

    def rows(self, matrix: np.ndarray) -> np.ndarray:
        return matrix[self.at]

    def _with(self, j: int) -> np.ndarray:
        """The chunks that have a j-th lane."""
        return self._order[: np.searchsorted(self._sorted, -j, side="left")]

    def enter(self, starts: np.ndarray, through: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The states at the beginnings of all lanes; through(lanes, states) gives those behind some lanes."""
        out = np.empty((self.shape[1], *starts.shape[1:]))
        for j in range(int(self.per.max(initial=0))):
            some = self._with(j)
            lanes = self.first[some] + j
            out[lanes] = starts[some] if j == 0 else through(lanes - 1, out[lanes - 1])
        return out

    def folded(self, maps: np.ndarray, compose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The map of each chunk, from those of its lanes; compose(later, earlier)."""
        out = maps[self.first].copy()
        for j in range(1, int(self.per.max(initial=0))):
            some = self._with(j)
            out[some] = compose(maps[self.first[some] + j], out[some])
        return out


def affine_maps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[lane, (slope, shift)] of the lanes whose steps are s -> a s + b."""
    slope, shift = np.ones(a.shape[1]), np.zeros(a.shape[1])
    for i in range(len(a)):
        slope, shift = a[i] * slope, a[i] * shift + b[i]
    return np.stack((slope, shift), 1)


def affine_compose(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.stack((later[:, 0] * earlier[:, 0], later[:, 0] * earlier[:, 1] + later[:, 1]), 1)


def affine_run(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and behind every step."""
    before, behind, s = np.empty(a.shape), np.empty(a.shape), starts
    for i in range(len(a)):
        before[i] = s
        s = a[i] * s + b[i]
        behind[i] = s
    return before, behind


def fraction_compose(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Products of matrices, which stand for the same fraction at any scale."""
    out = later @ earlier
    return out / np.abs(out).max((1, 2), keepdims=True)


def fraction_maps(steps: np.ndarray) -> np.ndarray:
    """[lane, 2, 2] of the lanes whose steps are p -> (m00 p + m01) / (m10 p + m11); steps: [step, lane, 2, 2]."""
    out = np.broadcast_to(np.eye(2), steps.shape[1:]).copy()
    for step in steps:
        out = fraction_compose(step, out)
    return out


def fraction(maps: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (maps[:, 0, 0] * p + maps[:, 0, 1]) / (maps[:, 1, 0] * p + maps[:, 1, 1])


class Ewma:
    """s = alpha z + (1 - alpha) s, begun at a series' first value."""

    levels, width, columns = 1, 1, ["ewma"]

    def __init__(self, value: str = "delta_t_s", alpha: str | float = 0.2, name: str = "ewma"):
        self.value, self.alpha, self.columns = value, alpha, [name]

    def inputs(self) -> list[str]:
        return [self.value] + ([self.alpha] if isinstance(self.alpha, str) else [])

    def _steps(self, grid: Grid, data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        alpha = data[self.alpha] if isinstance(self.alpha, str) else np.full(len(data[self.value]), self.alpha)
        return grid.spread(1 - alpha, 1.0), grid.spread(alpha * data[self.value], 0.0)

    def map(self, level: int, grid: Grid, data: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
        """What a chunk passes on, and its first value."""
        maps = grid.folded(affine_maps(*self._steps(grid, data)), affine_compose)
        return np.column_stack((maps, data[self.value][grid.begin]))

    def follow(self, level: int, maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The state at the beginning of every chunk of one series, in order."""
        out, s = np.empty((len(maps), 1)), maps[0, 2]
        for i, (slope, shift, _) in enumerate(maps):
            out[i], s = s, slope * s + shift
        return out

    def begin(self, grid: Grid, data: dict[str, np.ndarray]) -> np.ndarray:
        """The state at the beginning of chunks that begin a series."""
        return data[self.value][grid.begin][:, None]

    def run(self, grid: Grid, data: dict[str, np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        a, b = self._steps(grid, data)
        maps = affine_maps(a, b)
        entries = grid.enter(starts[:, 0], lambda lanes, s: maps[lanes, 0] * s + maps[lanes, 1])
        return [grid.rows(affine_run(a, b, entries)[1])]


class Kalman:
    """Random-walk Kalman filter: a value above ``gap`` first sets the state to itself and the variance to p0."""

    levels, width = 2, 2
    columns = ["kalman_filtered", "kalman_innovation", "kalman_variance", "kalman_z"]

    def __init__(self, q: float, r: float, p0: float, gap: float, x0: float | None = None, value: str = "delta_t_s"):
        self.q, self.r, self.p0, self.gap, self.x0, self.value = q, r, p0, gap, x0, value

    def inputs(self) -> list[str]:
        return [self.value]

    def _fractions(self, reset: np.ndarray, real: np.ndarray) -> np.ndarray:
        after = self.r * (self.p0 + self.q) / (self.p0 + self.q + self.r)
        kinds = np.array([[[1.0, 0.0], [0.0, 1.0]], [[self.r, self.r * self.q], [1.0, self.q + self.r]], [[0.0, after], [0.0, 1.0]]])
        kinds /= np.abs(kinds).max((1, 2), keepdims=True)
        return kinds[np.where(real, 1 + reset, 0)]

    def _parts(self, grid: Grid, data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = data[self.value]
        return grid.spread(z, 0.0), grid.spread(z > self.gap, 0.0).astype(bool), grid.spread(np.ones(len(z)), 0.0).astype(bool)

    def _gains(self, grid: Grid, reset: np.ndarray, real: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gains and innovation variances of all rows from the chunks' variances at their beginning."""
        maps = fraction_maps(self._fractions(reset, real))
        p = grid.enter(p, lambda lanes, x: fraction(maps[lanes], x))
        gain, variance = np.zeros(reset.shape), np.ones(reset.shape)
        for i in range(len(reset)):
            ahead = np.where(reset[i], self.p0, p) + self.q
            variance[i] = ahead + self.r
            gain[i] = ahead / variance[i]
            p = (1 - gain[i]) * ahead
        return gain, variance

    @staticmethod
    def _steps(z: np.ndarray, reset: np.ndarray, real: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = np.where(real, np.where(reset, 1.0, gain), 0.0)
        return 1 - gain, gain * z

    def map(self, level: int, grid: Grid, data: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
        z, reset, real = self._parts(grid, data)
        if level == 0:
            return grid.folded(fraction_maps(self._fractions(reset, real)), fraction_compose).reshape(-1, 4)
        gain, _ = self._gains(grid, reset, real, starts[:, 0])
        maps = grid.folded(affine_maps(*self._steps(z, reset, real, gain)), affine_compose)
        return np.column_stack((maps, data[self.value][grid.begin]))

    def follow(self, level: int, maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(maps), 2))
        if level == 0:
            p = np.array([self.p0])
            for i, m in enumerate(maps.reshape(-1, 1, 2, 2)):
                out[i, 0], p = p[0], fraction(m, p)
            return out
        out[:, 0], x = starts[:, 0], maps[0, 2] if self.x0 is None else self.x0
        for i, (slope, shift, _) in enumerate(maps):
            out[i, 1], x = x, slope * x + shift
        return out

    def begin(self, grid: Grid, data: dict[str, np.ndarray]) -> np.ndarray:
        x = data[self.value][grid.begin] if self.x0 is None else np.full(len(grid.sizes), self.x0)
        return np.column_stack((np.full(len(x), self.p0), x))

    def run(self, grid: Grid, data: dict[str, np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        z, reset, real = self._parts(grid, data)
        gain, variance = self._gains(grid, reset, real, starts[:, 0])
        a, b = self._steps(z, reset, real, gain)
        maps = affine_maps(a, b)
        before, state = affine_run(a, b, grid.enter(starts[:, 1], lambda lanes, s: maps[lanes, 0] * s + maps[lanes, 1]))
        innovation = np.where(reset, 0.0, z - before)
        return [grid.rows(x) for x in (np.where(reset, z, state), innovation, variance, innovation / np.sqrt(variance))]


def _chunks(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole chunks that come in order, and the chunks' sizes; about TOGETHER rows at once."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = _cuts(table, names)
            if len(cuts) > 2:
                yield table.slice(0, int(cuts[-2])), np.diff(cuts[:-1])
                held = table.slice(int(cuts[-2])).to_batches()
                rows = sum(b.num_rows for b in held)
    if held and rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.diff(_cuts(table, names))


def _cuts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a chunk begins, and the end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for name in names:
        code = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows])) if table.num_rows else np.zeros(1, np.int64)


def _numbers(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {n: pc.cast(table[n], pa.float64()).to_numpy(zero_copy_only=False) for n in dict.fromkeys(names)}


def _doubles(matrix: np.ndarray) -> pa.Array:
    return pa.array(list(matrix), pa.list_(pa.float64()))


def _starts(table: pa.Table, begin: np.ndarray, width: int) -> np.ndarray | None:
    """The starts of chunks, where a level has given them; NaN for the others."""
    if "_starts" not in table.column_names:
        return None
    found = table["_starts"].take(pa.array(begin)).to_pylist()
    return np.array([x if x is not None else [np.nan] * width for x in found]).reshape(-1, width)


def scan(rows: DataFrame, folds: list, series: str = "series_id", order: str = "k") -> DataFrame:
    """rows with the columns of all folds, which run over each series in order of its rows' number ``order`` (from 0)."""
    made = [c for f in folds for c in f.columns]
    kept = [c for c in rows.columns if c not in made]
    inputs, width = [c for f in folds for c in f.inputs()], sum(f.width for f in folds)
    offsets = np.cumsum([0, *(f.width for f in folds)])
    kind, chunk = rows.schema[series].dataType.simpleString(), CHUNK
    dealt = rows.select(*kept, F.floor(F.col(order) / chunk).alias("_chunk"), F.max(order).over(Window.partitionBy(series)).alias("_last"))
    keys = [series, "_chunk"]

    def in_order(df: DataFrame) -> DataFrame:
        return df.drop("_last").repartition(*keys).sortWithinPartitions(*keys, order)

    def maps(level: int):
        def of(batches):
            for table, sizes in _chunks(batches, keys):
                grid, data = Grid(sizes), _numbers(table, inputs)
                starts = _starts(table, grid.begin, width)
                found = [f.map(level, grid, data, starts[:, a:b] if starts is not None else None) if level < f.levels else np.zeros((len(sizes), 0)) for f, a, b in zip(folds, offsets, offsets[1:])]
                first = table.select(keys).take(pa.array(grid.begin))
                old = _doubles(starts if starts is not None else np.full((len(sizes), width), np.nan))
                yield from pa.table([first[series], first["_chunk"], old, *(_doubles(m) for m in found)], [*keys, "old", *(f"map{i}" for i in range(len(folds)))]).to_batches()

        return of

    def follow(level: int):
        def of(table: pa.Table) -> pa.Table:
            table = table.sort_by("_chunk")
            old = np.array(table["old"].to_pylist()).reshape(-1, width)
            for i, f in enumerate(folds):
                if level < f.levels:
                    part = slice(offsets[i], offsets[i + 1])
                    old[:, part] = f.follow(level, np.array(table[f"map{i}"].to_pylist()), old[:, part])
            return pa.table([table[series], table["_chunk"], _doubles(old)], ["_of", "_at", "_starts"])

        return of

    def started(starts: DataFrame) -> DataFrame:
        return long.join(starts, F.col(series).eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_at"))).drop("_of", "_at")

    # Only series of several chunks have maps to combine, a row for each chunk.
    long, starts = dealt.filter(F.col("_last") >= chunk), None
    fields = ", ".join(["old array<double>", *(f"map{i} array<double>" for i in range(len(folds)))])
    for level in range(max(f.levels for f in folds)):
        df = long if starts is None else started(starts)
        found = in_order(df).mapInArrow(maps(level), f"{series} {kind}, _chunk long, {fields}")
        starts = found.groupBy(series).applyInArrow(follow(level), f"_of {kind}, _at long, _starts array<double>")

    def run(batches):
        for table, sizes in _chunks(batches, keys):
            grid, data = Grid(sizes), _numbers(table, inputs)
            given = _starts(table, grid.begin, width)
            out = table.drop_columns([c for c in ("_chunk", "_starts") if c in table.column_names])
            for f, a, b in zip(folds, offsets, offsets[1:]):
                own = f.begin(grid, data)
                for name, values in zip(f.columns, f.run(grid, data, own if given is None else np.where(np.isnan(given[:, a:b]), own, given[:, a:b]))):
                    out = out.append_column(name, pa.array(values, pa.float64()))
            yield from out.to_batches()

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.select(*kept).dtypes] + [f"`{c}` double" for c in made])
    short = in_order(dealt.filter(F.col("_last") < chunk)).mapInArrow(run, schema)
    return short.unionByName(in_order(started(starts)).mapInArrow(run, schema))


def whole(rows: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: list[str], value: str = "delta_t_s", series: str = "series_id", order: str = "k") -> DataFrame:
    """rows with the columns of a recurrence whose runs don't compose: series are stepped through side by side, a task holds the values of some.

    kernel: [row, series] -> its columns; rows behind a series' end are 0.
    """
    kept = [c for c in rows.columns if c not in columns]

    def run(batches):
        for table, sizes in _chunks(batches, [series]):
            z = _numbers(table, [value])[value]
            begin, found = np.cumsum(sizes) - sizes, [np.empty(len(z)) for _ in columns]
            by_size = np.argsort(sizes, kind="stable")
            # Series of about one length go together, so that the filling stays below their own rows.
            for some in np.split(by_size, np.flatnonzero(np.diff(np.ceil(np.log2(sizes[by_size])))) + 1):
                at = np.concatenate([np.arange(begin[i], begin[i] + sizes[i]) for i in some])
                grid = Grid(sizes[some], int(sizes[some].max(initial=1)))
                made = kernel(grid.spread(z[at], 0.0))
                for out, name in zip(found, columns):
                    out[at] = grid.rows(made[name])
            for name, values in zip(columns, found):
                table = table.append_column(name, pa.array(values, pa.float64()))
            yield from table.to_batches()

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.select(*kept).dtypes] + [f"`{c}` double" for c in columns])
    return rows.select(*kept).repartition(series).sortWithinPartitions(series, order).mapInArrow(run, schema)
