"""Weighted Gaussian kernel density of all rows by binned weights and a separable convolution.

Coordinates are turned so that the kernel is round with variance one: by the
Cholesky factor of the weighted covariance times the square of the bandwidth.
Each row's weight is shared out over the four nodes around it, these are summed by
cell, and cells meet in tiles of the grid, with the cells around a tile that the kernel
reaches: there weights are spread along one axis and then along the other. Sums are
read off between the four nodes around each row. After the first sum a cell moves once
(more only near the edge of a tile), and a task holds a tile, not a group. Both linear steps widen the kernel by a sixth of the
square of a step each, which its variance leaves out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Nodes in a standard deviation of the kernel, and standard deviations after which it is cut.
STEPS, REACH = 4, 5
#: Cells along the side of a tile, which a task holds; the nodes around a cell.
TILE, CORNERS = 512, [(a, b) for a in (0, 1) for b in (0, 1)]


def kernel(steps: int = STEPS, reach: int = REACH) -> list[float]:
    """Weights of the nodes from -reach * steps to reach * steps."""
    variance = 1 - 1 / (3 * steps * steps)
    return [math.exp(-((d / steps) ** 2) / (2 * variance)) / math.sqrt(2 * math.pi * variance) for d in range(-reach * steps, reach * steps + 1)]


def _place(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _whitened(rows: DataFrame, keys: list[str], x: str, y: str, weight: Column, bandwidth: float) -> DataFrame:
    """keys, m1, m2, l11, l21, l22, total for each group with spread in both directions."""
    w = F.col("_w")
    usable = rows.select(*keys, _place(x).alias("_x"), _place(y).alias("_y"), weight.alias("_w")).filter("_x IS NOT NULL AND _y IS NOT NULL AND _w > 0")
    # Moments about a value of the group, so that far-off positions keep their digits.
    first = usable.groupBy(*keys).agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"))
    near = _joined(usable, first, keys).withColumns({"_x": F.col("_x") - F.col("_x0"), "_y": F.col("_y") - F.col("_y0")})
    p = lambda *c: F.sum(math.prod(map(F.col, c[1:]), start=F.col(c[0])))
    sums = near.groupBy(*keys).agg(
        F.first("_x0").alias("_x0"), F.first("_y0").alias("_y0"), F.count("*").alias("_n"), F.sum(w).alias("total"), p("_w", "_w").alias("_ww"), p("_w", "_x").alias("_sx"),
        p("_w", "_y").alias("_sy"), p("_w", "_x", "_x").alias("_sxx"), p("_w", "_x", "_y").alias("_sxy"), p("_w", "_y", "_y").alias("_syy"),
    )
    t = F.col("total")
    ax, ay = F.col("_sx") / t, F.col("_sy") / t
    scale = F.try_divide(F.lit(bandwidth**2), 1 - F.col("_ww") / (t * t))
    c = sums.withColumns({
        "m1": F.col("_x0") + ax, "m2": F.col("_y0") + ay, "_cxx": (F.col("_sxx") / t - ax * ax) * scale,
        "_cxy": (F.col("_sxy") / t - ax * ay) * scale, "_cyy": (F.col("_syy") / t - ay * ay) * scale,
    })
    c = c.filter("_n > 2 AND _cxx > 0").withColumn("l11", F.sqrt("_cxx")).withColumn("l21", F.col("_cxy") / F.col("l11"))
    c = c.withColumn("_rest", F.col("_cyy") - F.col("l21") * F.col("l21")).filter("_rest > 1e-12 * _cyy").withColumn("l22", F.sqrt("_rest"))
    return c.select(*keys, "m1", "m2", "l11", "l21", "l22", "total")


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(few, keys, how) if keys else rows.join(F.broadcast(few), how=how)


def _read_off(cells: DataFrame, keys: list[str], steps: int, parts: int) -> DataFrame:
    """keys, i, j and the kernel's sums d00 to d11 at the four nodes around each cell (keys, i, j, w00 to w11: its weights at them).

    Cells meet in tiles of TILE x TILE, each with the cells around it that the kernel
    reaches from there; the middle tile of a group lies around its mean. Within one
    the two axes are products of matrices over the nodes that occur.
    """
    ks = np.array(kernel(steps))
    far = (len(ks) - 1) // 2
    tile = lambda c: F.floor((c + TILE // 2) / TILE)
    reached = lambda c: F.explode(F.sequence(tile(F.col(c) - far - 1), tile(F.col(c) + far + 1)))
    dealt = cells.withColumn("_ti", reached("i")).withColumn("_tj", reached("j")).repartition(parts, *keys, "_ti", "_tj")

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        off = a[:, None] - b[None]
        return np.where(np.abs(off) <= far, ks[np.clip(off + far, 0, 2 * far)], 0.0)

    def convolved(table: pa.Table) -> pa.Table:
        i, j, ti, tj = (table[c].to_numpy() for c in ("i", "j", "_ti", "_tj"))
        own = ((i + TILE // 2) // TILE == ti) & ((j + TILE // 2) // TILE == tj)
        mine = table.select([*keys, "i", "j"]).filter(pa.array(own))
        rows, at_i = np.unique(np.concatenate((i, i + 1)), return_inverse=True)
        columns, at_j = np.unique(np.concatenate((j, j + 1)), return_inverse=True)
        n, width = len(i), len(columns)
        place = {(a, b): at_i[a * n : a * n + n] * width + at_j[b * n : b * n + n] for a, b in CORNERS}
        weights = sum(np.bincount(place[a, b], table[f"w{a}{b}"].to_numpy(), len(rows) * width) for a, b in CORNERS)
        sums = (between(rows, rows) @ weights.reshape(len(rows), width) @ between(columns, columns)).ravel()
        for a, b in CORNERS:
            mine = mine.append_column(f"d{a}{b}", pa.array(sums[place[a, b][own]]))
        return mine

    kind = StructType([*(cells.schema[c] for c in keys), *(StructField(c, LongType()) for c in "ij"), *(StructField(f"d{a}{b}", DoubleType()) for a, b in CORNERS)])
    return dealt.groupBy(*keys, "_ti", "_tj").applyInArrow(convolved, kind)


def kernel_density(rows: DataFrame, x: str, y: str, weight: Column | None = None, keys: list[str] | None = None, bandwidth: float = 0.15, steps: int = STEPS, parts: int | None = None) -> DataFrame:
    """Adds the ``density`` of (x, y) at each row, from all rows of its group of keys (of all rows without keys).

    The kernel's covariance is the group's weighted one times the square of the
    bandwidth. Rows without a place (null or NaN) have no density (null), nor have those of a
    group of less than three rows or without spread in both directions; rows
    without a positive weight count for nothing but get a density. Keys are not null.
    The result is within 1 % of the group's largest density of the direct sum (steps=4).
    parts: in how many parts tiles are dealt; None: the session's number for shuffles.
    """
    keys = keys or []
    weight = F.abs(F.col(y)) if weight is None else weight
    weight = F.when(~F.isnan(weight) & (weight > 0), weight).otherwise(0.0)
    shape = _whitened(rows, keys, x, y, weight, bandwidth)
    own = [c for c in rows.columns]
    placed = _joined(rows.withColumn("_w", weight), shape, keys, "left")
    u1 = (_place(x) - F.col("m1")) / F.col("l11")
    u2 = (_place(y) - F.col("m2") - F.col("l21") * u1) / F.col("l22")
    placed = placed.withColumns({"_u": u1 * steps, "_v": u2 * steps})
    placed = placed.withColumns({"i": F.floor("_u"), "j": F.floor("_v")}).withColumns({"_fu": F.col("_u") - F.col("i"), "_fv": F.col("_v") - F.col("j")})
    fu, fv = F.col("_fu"), F.col("_fv")
    part = lambda a, b: (fu if a else 1 - fu) * (fv if b else 1 - fv)
    # A sum for each cell and node around it before cells meet: no row is copied.
    # Cells of rows without weight are read off too.
    held = F.col("_w") / F.col("total")
    known = placed.filter("i IS NOT NULL AND j IS NOT NULL")
    cells = known.groupBy(*keys, "i", "j").agg(*[F.sum(held * part(a, b)).alias(f"w{a}{b}") for a, b in CORNERS])
    grid = _read_off(cells, keys, steps, parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = sum((part(a, b) * F.col(f"d{a}{b}") for a, b in CORNERS), F.lit(0.0))
    density = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), read / (F.col("l11") * F.col("l22")))
    return placed.join(grid, [*keys, "i", "j"], "left").select(*own, density.alias("density"))
