"""Grid operators (G) on long cell tables: keys, then row and col (or cell), then values.

A grid is nrow x ncol cells of side res from (xmin, ymax); cells count from 1 along rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.checkpoints import cut


def cell_xy(df: DataFrame, grids: DataFrame, cell: str = "cell", site: str = "site") -> DataFrame:
    """G1. Row, column, centre and kilometres from the grid's lower left corner; a cell outside its grid is an error."""
    g = F.broadcast(grids.select(site, "nrow", "ncol", "xmin", "ymin", "ymax", "res"))  # a row a site
    out = df.join(g, site, "left")
    ok = F.col(cell).between(1, F.col("nrow").cast("long") * F.col("ncol"))
    out = out.withColumn(cell, F.when(ok, F.col(cell)).otherwise(F.raise_error(F.concat(F.lit("no such cell: "), F.coalesce(F.col(cell).cast("string"), F.lit("null"))))))
    out = out.withColumn("row", F.expr(f"cast(({cell} - 1) div ncol as int)")).withColumn("col", F.pmod(F.col(cell) - 1, F.col("ncol")).cast("int"))
    out = out.withColumn("x", F.col("xmin") + (F.col("col") + 0.5) * F.col("res")).withColumn("y", F.col("ymax") - (F.col("row") + 0.5) * F.col("res"))
    return out.withColumn("x_km", (F.col("x") - F.col("xmin")) / 1000).withColumn("y_km", (F.col("y") - F.col("ymin")) / 1000).drop("nrow", "ncol", "xmin", "ymin", "ymax", "res")


def xy_cell(points: DataFrame, grids: DataFrame, x: str = "x", y: str = "y", site: str = "site") -> DataFrame:
    """G1 back: the cell of each point, NULL outside the grid."""
    g = F.broadcast(grids.select(site, "nrow", "ncol", "xmin", "ymax", "res"))
    row, c = F.floor((F.col("ymax") - F.col(y)) / F.col("res")), F.floor((F.col(x) - F.col("xmin")) / F.col("res"))
    inside = (row >= 0) & (row < F.col("nrow")) & (c >= 0) & (c < F.col("ncol"))
    return points.join(g, site, "left").withColumn("cell", F.when(inside, row * F.col("ncol") + c + 1)).drop("nrow", "ncol", "xmin", "ymax", "res")


def same_geometry(a: DataFrame, b: DataFrame) -> None:
    """G2. Raise unless both grid tables have the same rows."""
    if a.exceptAll(b).union(b.exceptAll(a)).take(1):
        raise ValueError("grids differ")


def mosaic(tiles: list[DataFrame], keys: list[str], value: str, fun: str = "avg") -> DataFrame:
    """G3. One layer from tiles; where they overlap the mean, max or min."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(getattr(F, fun)(value).alias(value))


def coarsen(df: DataFrame, factor: int, value: str, keys: tuple[str, ...] = (), fun: str = "avg") -> DataFrame:
    """G4. Blocks of factor x factor cells: mean, or the mode (the smallest of equals)."""
    agg = F.mode(value, deterministic=True) if fun == "mode" else getattr(F, fun)(value)
    return df.groupBy(*keys, F.expr(f"row div {factor}").cast("int").alias("row"), F.expr(f"col div {factor}").cast("int").alias("col")).agg(agg.alias(value))


def resample_bilinear(coarse: DataFrame, cells: DataFrame, factor: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """G5. Values of a grid `factor` times coarser at the finer cells: weights of the 4 nearest centres, over those present."""
    x, y = (F.col("col") + 0.5) / factor - 0.5, (F.col("row") + 0.5) / factor - 0.5
    near = cells.select(*keys, "row", "col").withColumn("x", x).withColumn("y", y)
    near = near.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)])))
    r, c = (F.floor("y") + F.col("o.dr")).cast("int"), (F.floor("x") + F.col("o.dc")).cast("int")
    w = (1 - F.abs(F.col("y") - r)) * (1 - F.abs(F.col("x") - c))
    near = near.select(*keys, "row", "col", r.alias("__r"), c.alias("__c"), w.alias("__w"))
    have = coarse.filter(F.col(value).isNotNull()).select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    some = near.join(have, [*keys, "__r", "__c"]).groupBy(*keys, "row", "col").agg((F.sum(F.col("__w") * F.col(value)) / F.nullif(F.sum("__w"), F.lit(0.0))).alias(value))
    return cells.select(*keys, "row", "col").join(some, [*keys, "row", "col"], "left")


def grid_cells(grids: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """keys, row, col and the centre x, y of every cell of grids (keys, nrow, ncol, xmin, ymax, res)."""
    d = grids.select(*keys, "ncol", "xmin", "ymax", "res", F.explode(F.sequence(F.lit(0), F.col("nrow").cast("int") - 1)).alias("row"))
    d = d.select(*keys, "xmin", "ymax", "res", "row", F.explode(F.sequence(F.lit(0), F.col("ncol").cast("int") - 1)).alias("col"))
    return d.select(*keys, "row", "col", (F.col("xmin") + (F.col("col") + 0.5) * F.col("res")).alias("x"), (F.col("ymax") - (F.col("row") + 0.5) * F.col("res")).alias("y"))


def resample_grid(df: DataFrame, src: DataFrame, dst: DataFrame, value: str, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """G5 between any two grids of a key, whatever their sides and corners: each cell of dst gets the bilinear mean of the 4 src centres around it.

    src and dst: keys, nrow, ncol, xmin, ymax, res. Weights are taken over the centres that have a value, so edges and gaps do not pull to 0. A cell whose
    centre is outside src, or without any value around it, is NULL.
    """
    g = src.select(*keys, F.col("xmin").alias("__x0"), F.col("ymax").alias("__y0"), F.col("res").alias("__s"), F.col("nrow").alias("__nr"), F.col("ncol").alias("__nc"))
    at = grid_cells(dst, keys).join(g, list(keys), "left").withColumn("__fx", (F.col("x") - F.col("__x0")) / F.col("__s") - 0.5).withColumn("__fy", (F.col("__y0") - F.col("y")) / F.col("__s") - 0.5)
    inside = (F.col("__fx") >= -0.5) & (F.col("__fx") <= F.col("__nc") - 0.5) & (F.col("__fy") >= -0.5) & (F.col("__fy") <= F.col("__nr") - 0.5)
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (0, 1) for b in (0, 1)]))
    near = at.filter(inside).select(*keys, "row", "col", "__fx", "__fy", corner.alias("__o"))
    r, c = (F.floor("__fy") + F.col("__o.r")).cast("int"), (F.floor("__fx") + F.col("__o.c")).cast("int")
    near = near.select(*keys, "row", "col", r.alias("__r"), c.alias("__c"), ((1 - F.abs(F.col("__fy") - r)) * (1 - F.abs(F.col("__fx") - c))).alias("__w")).filter("__w > 0")
    have = df.filter(F.col(value).isNotNull()).select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    mean = (F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias(value)
    some = near.join(have, [*keys, "__r", "__c"]).groupBy(*keys, "row", "col").agg(mean)
    return at.select(*keys, "row", "col").join(some, [*keys, "row", "col"], "left")


def resample_near(coarse: DataFrame, cells: DataFrame, factor: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """G6. The value of the coarse cell that holds each finer one."""
    near = cells.select(*keys, "row", "col").withColumn("__r", F.expr(f"row div {factor}").cast("int")).withColumn("__c", F.expr(f"col div {factor}").cast("int"))
    have = coarse.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return near.join(have, [*keys, "__r", "__c"], "left").drop("__r", "__c")


def crop(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """G7. Cells within the extent, both ends included."""
    return df.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def intersect_extent(a: DataFrame, b: DataFrame) -> DataFrame:
    """G7. The common extent of two layers, one row; empty if they do not meet."""
    ext = [f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))]
    both = a.agg(*ext).union(b.agg(*ext))
    return both.agg(F.max("lo_row").alias("lo_row"), F.min("hi_row").alias("hi_row"), F.max("lo_col").alias("lo_col"), F.min("hi_col").alias("hi_col")).filter("lo_row <= hi_row and lo_col <= hi_col")


def extend(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """G7. Every cell of the extent, NULL where df has none."""
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    frame = base.withColumn("row", F.explode(F.sequence(F.lit(rows[0]), F.lit(rows[1])))).withColumn("col", F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1]))))
    return frame.join(df, [*keys, "row", "col"], "left")


def trim(df: DataFrame, value: str) -> DataFrame:
    """G7. Without border rows and columns that are all NULL."""
    ext = df.filter(F.col(value).isNotNull()).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return df.join(F.broadcast(ext), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")


def mask(df: DataFrame, mask_df: DataFrame, keys: list[str], value: str, mask_value: str, values: list | None = None, inverse: bool = False) -> DataFrame:
    """G8. NULL where the mask is missing or (with values) has one of them; inverse: where it is not."""
    m = mask_df.select(*keys, F.col(mask_value).alias("__m"))
    out = F.col("__m").isNull() if values is None else F.coalesce(F.col("__m").isin(values), F.lit(False))
    out = ~out if inverse else out
    return df.join(m, keys, "left").withColumn(value, F.when(~out, F.col(value))).drop("__m")


def mask_above_canopy(df: DataFrame, chm: DataFrame, keys: list[str], height: str, values: list[str], canopy: str = "canopy", strict: bool = False) -> DataFrame:
    """G9. NULL where the canopy is at or below the height (strict: below it), or not known."""
    c = chm.select(*keys, F.col(canopy).alias("__c"))
    keep = F.col("__c") >= F.col(height) if strict else F.col("__c") > F.col(height)
    return df.join(c, keys, "left").withColumns({v: F.when(keep, F.col(v)) for v in values}).drop("__c")


def focal_mean(df: DataFrame, value: str, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """G10. Mean of the n x n window, NULLs ignored; each value is sent to the cells it serves."""
    h = n // 2
    sent = df.filter(F.col(value).isNotNull()).select(*keys, "row", "col", value).withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in range(-h, h + 1) for b in range(-h, h + 1)])))
    means = sent.groupBy(*keys, (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).agg(F.avg(value).alias("__m"))
    return df.join(means, [*keys, "row", "col"], "left").withColumn(value, F.col("__m")).drop("__m")


def usable_levels(df: DataFrame, levels: tuple[int, ...] = (2, 4, 8, 16)) -> list[int]:
    """The levels of G11 that both sides of the grid are longer than."""
    size = df.agg(F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1).first()  # two numbers
    return [f for f in levels if size[0] is not None and min(size) > f]


def fill_multiscale(df: DataFrame, value: str, zero_to_null: bool = False, mask_df: DataFrame | None = None, levels: tuple[int, ...] = (2, 4, 8, 16), keys: tuple[str, ...] = ()) -> DataFrame:
    """G11. Gaps from block means brought back bilinearly, finest first, then from the global mean (of each of keys), then the mask.

    A level is used if both sides of the grid are longer than its factor. All levels' blocks are one aggregation and
    meet the gaps, and only these, in one join.
    """
    base = df.withColumn(value, F.when(F.col(value) != 0, F.col(value))) if zero_to_null else df
    used = usable_levels(df, levels)
    out, fills = base, [F.col(value)]
    if used:
        level, known = F.explode(F.array(*map(F.lit, used))).alias("__f"), F.col(value).isNotNull()
        block = [F.expr(f"{c} div __f").cast("int").alias(f"__{c[0]}") for c in ("row", "col")]
        blocks = base.filter(known).select(*keys, "row", "col", value, level).groupBy(*keys, "__f", *block).agg(F.avg(value).alias("__v"))
        x, y = (F.col("col") + 0.5) / F.col("__f") - 0.5, (F.col("row") + 0.5) / F.col("__f") - 0.5
        near = base.filter(~known).select(*keys, "row", "col", level).withColumn("x", x).withColumn("y", y)
        near = near.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)])))
        r, c = (F.floor("y") + F.col("o.dr")).cast("int"), (F.floor("x") + F.col("o.dc")).cast("int")
        near = near.select(*keys, "row", "col", "__f", r.alias("__r"), c.alias("__c"), ((1 - F.abs(F.col("y") - r)) * (1 - F.abs(F.col("x") - c))).alias("__w"))
        at = lambda f, v: F.sum(F.when(F.col("__f") == f, v))
        means = [(at(f, F.col("__w") * F.col("__v")) / F.nullif(at(f, F.col("__w")), F.lit(0.0))).alias(f"__f{f}") for f in used]
        out = out.join(near.join(blocks, [*keys, "__f", "__r", "__c"]).groupBy(*keys, "row", "col").agg(*means), [*keys, "row", "col"], "left")
        fills += [F.col(f"__f{f}") for f in used]
    mean = base.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    out = out.join(mean, list(keys), "left") if keys else out.join(F.broadcast(mean), how="cross")  # one row without keys
    out = out.withColumn(value, F.coalesce(*fills, F.col("__mean"))).select(*df.columns)
    return mask(out, mask_df, ["row", "col"], value, [c for c in mask_df.columns if c not in ("row", "col")][0]) if mask_df is not None else out


def _from_blocks(row: np.ndarray, col: np.ndarray, y: np.ndarray, todo: np.ndarray, f: int) -> np.ndarray:
    """At the cells todo the means of y over blocks of f x f cells brought back bilinearly, over the blocks that have any; NaN without one."""
    known = ~np.isnan(y)
    r, c = (np.trunc(x[known] / f).astype(np.int64) for x in (row, col))
    low, high = (r.min(), c.min()), (r.max(), c.max())
    width = high[1] - low[1] + 1
    at, size = (r - low[0]) * width + c - low[1], (high[0] - low[0] + 1) * width
    sums, counts = np.bincount(at, y[known], size), np.bincount(at, minlength=size)
    means = np.divide(sums, counts, out=np.zeros(size), where=counts > 0)
    fy, fx = (row[todo] + 0.5) / f - 0.5, (col[todo] + 0.5) / f - 0.5
    weight, total = np.zeros(len(fy)), np.zeros(len(fy))
    for r in (np.floor(fy), np.floor(fy) + 1):
        for c in (np.floor(fx), np.floor(fx) + 1):
            inside = (r >= low[0]) & (r <= high[0]) & (c >= low[1]) & (c <= high[1])
            at = np.where(inside, (r - low[0]) * width + c - low[1], 0).astype(np.int64)
            w = (1 - np.abs(fy - r)) * (1 - np.abs(fx - c)) * (inside & (counts[at] > 0))
            weight, total = weight + w, total + w * means[at]
    return np.divide(total, weight, out=np.full(len(fy), np.nan), where=weight > 0)


def fill_gaps(df: DataFrame, values: list[str], used: list[int], there: Column, tile: int = 512) -> DataFrame:
    """Of the cells `there` with a gap in any of values: row, col and the values that G11 fills from the levels `used`; NULL where these give none or there is no gap.

    Cells are dealt to square tiles of side `tile`, with a margin that holds all blocks around a tile's cells, so that a table meets one shuffle.
    """
    margin = 3 * max(used, default=0)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile).cast("int"), F.floor((F.col(c) + margin) / tile).cast("int")))
    dealt = df.filter(F.col("row").isNotNull() & F.col("col").isNotNull()).select("row", "col", *values, there.alias("__there")).withColumn("__tr", span("row")).withColumn("__tc", span("col"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        row, col = p["row"].to_numpy(float), p["col"].to_numpy(float)
        core = (row // tile == p["__tr"].iloc[0]) & (col // tile == p["__tc"].iloc[0]) & p["__there"].to_numpy(bool)
        some, out = np.zeros(len(p), bool), {}
        for v in values:
            y, out[v] = p[v].to_numpy(float), np.full(len(p), np.nan)
            gap = core & np.isnan(y)
            some |= gap
            for f in used if gap.any() and not np.isnan(y).all() else []:
                todo = gap & np.isnan(out[v])
                out[v][todo] = _from_blocks(row, col, y, todo, f)
        q = pd.DataFrame({"row": p["row"], "col": p["col"], **out})[some]
        return q.groupby(["row", "col"], as_index=False).max() if q.duplicated(["row", "col"]).any() else q

    out = dealt.groupBy("__tr", "__tc").applyInPandas(run, "row int, col int, " + ", ".join(f"{v} double" for v in values))
    return out.withColumns({v: F.nanvl(v, F.lit(None).cast("double")) for v in values})


def fill_idw(df: DataFrame, target: DataFrame, value: str, k: int = 10, power: float = 2, bucket: int = 8, rings: int = 2) -> DataFrame:
    """G12. Inverse-distance weighted mean of the k nearest known cells, or of all if there are fewer.

    An equi-join on buckets of side `bucket` bounds what a target meets: those within `rings` buckets hold all cells up to rings * bucket
    away. Targets whose k-th cell is farther, or that have fewer than k, are sought again with buckets of twice the side, until
    none is left or the buckets cover the grid.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col("row").alias("kr"), F.col("col").alias("kc"), F.col(value).alias("kv"))
    offs = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1)])
    d2 = (F.col("row") - F.col("kr")) ** 2 + (F.col("col") - F.col("kc")) ** 2
    rank = F.row_number().over(Window.partitionBy("row", "col").orderBy("d2", "kr", "kc"))
    w = F.when(F.col("d2") == 0, 1e12).otherwise(F.pow("d2", F.lit(-power / 2)))
    ends = known.select("kr", "kc").union(target.select("row", "col")).agg(F.max("kr") - F.min("kr"), F.max("kc") - F.min("kc")).first()  # two numbers
    span, left, found = max(ends[0] or 0, ends[1] or 0), target.select("row", "col").distinct(), None
    while True:
        at = known.withColumn("br", F.floor(F.col("kr") / bucket).cast("int")).withColumn("bc", F.floor(F.col("kc") / bucket).cast("int"))
        want = left.withColumn("o", F.explode(offs)).select("row", "col", (F.floor(F.col("row") / bucket) + F.col("o.r")).cast("int").alias("br"), (F.floor(F.col("col") / bucket) + F.col("o.c")).cast("int").alias("bc"))
        pairs = want.join(at, ["br", "bc"]).withColumn("d2", d2.cast("double"))
        near = pairs.withColumn("__k", rank).filter(F.col("__k") <= k).groupBy("row", "col").agg((F.sum(w * F.col("kv")) / F.sum(w)).alias(value), F.count("*").alias("__n"), F.max("d2").alias("__far"))
        reach = rings * bucket + 1  # what is not met is at least so far away
        if reach <= span:
            near = cut(near.filter((F.col("__n") >= k) & (F.col("__far") < reach**2)))
        near = near.select("row", "col", value)
        found = near if found is None else found.union(near)
        if reach > span:
            break
        left = cut(left.join(near, ["row", "col"], "left_anti"))
        if left.isEmpty():
            break
        bucket *= 2
    return target.select("row", "col").join(found, ["row", "col"], "left")


def _inverse_sums(r: np.ndarray, c: np.ndarray, kr: np.ndarray, kc: np.ndarray, v: np.ndarray, power: float) -> np.ndarray:
    """Sums of the weights and of the weighted v of whole-numbered points kr, kc, none of them at a point r, c.

    Square distances are one product of matrices, exact as its sums stay below 2^53, unless points lie too far apart for that. Pieces stay in a core's cache.
    """
    near = max(np.abs(x).max() for x in (r, c, kr, kc)) < 1 << 25
    ours, theirs = np.column_stack([r * r + c * c, np.ones(len(r)), -2 * r, -2 * c]), np.vstack([np.ones(len(kr)), kr * kr + kc * kc, kr, kc])
    terms, sums, room = np.column_stack([np.ones(len(v)), v]), np.zeros((len(r), 2)), np.empty(128 * 512)
    for i in range(0, len(r), 128):
        for j in range(0, len(v), 512):
            a, b = slice(i, i + 128), slice(j, j + 512)
            d2 = room[: len(r[a]) * len(v[b])].reshape(len(r[a]), -1)
            if near:
                np.matmul(ours[a], theirs[:, b], out=d2)
            else:
                np.add((r[a, None] - kr[b]) ** 2, (c[a, None] - kc[b]) ** 2, out=d2)
            sums[a] += (np.divide(1, d2, out=d2) if power == 2 else np.power(d2, -power / 2, out=d2)) @ terms[b]
    return sums


def fill_idw_all(df: DataFrame, target: DataFrame, value: str, power: float = 2, most: int | None = None, block: int = 1 << 16) -> DataFrame:
    """G12 over all known cells: inverse-distance weighted means of the targets; a target that is a known cell has its value.

    Both sides are counted and dealt into blocks of about `block` cells by their hash. A task holds one block of each, whose sums meet those of the other
    blocks in one aggregation, so memory is bounded whatever the number of cells; time is that of all pairs. With `most`, more known cells are an error.
    """
    known = df.filter(F.col(value).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("__v"))
    asked = target.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    n = known.count()
    if most is not None and n > most:
        raise ValueError(f"{n} known cells, at most {most}: use fill_idw")
    own = asked.distinct().join(known, ["row", "col"]).groupBy("row", "col").agg(F.avg("__v").alias("__own"))
    far = asked.filter(F.col("row").isNotNull() & F.col("col").isNotNull()).distinct().join(known, ["row", "col"], "left_anti")
    ks, ts = max(1, -(-n // block)), max(1, -(-far.count() // block))
    dealt = lambda d, k: F.pmod(F.xxhash64(*d.columns), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = far.select("row", "col", dealt(far, ts).alias("__t"), each(ks).alias("__k"))
    right = known.select("row", "col", "__v", each(ts).alias("__t"), dealt(known, ks).alias("__k"))

    def run(t: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((len(t), 2))
        if len(t) and len(k):
            r, c, kr, kc, v = (x.to_numpy(float) for x in (t["row"], t["col"], k["row"], k["col"], k["__v"]))
            sums = _inverse_sums(r - kr[0], c - kc[0], kr - kr[0], kc - kc[0], v, power)
        return pd.DataFrame({"row": t["row"], "col": t["col"], "__w": sums[:, 0], "__s": sums[:, 1]})

    parts = left.groupBy("__t", "__k").cogroup(right.groupBy("__t", "__k")).applyInPandas(run, "row int, col int, __w double, __s double")
    found = parts.groupBy("row", "col").agg((F.sum("__s") / F.nullif(F.sum("__w"), F.lit(0.0))).alias("__mean"))
    both = asked.join(own, ["row", "col"], "left").join(found, ["row", "col"], "left")
    return both.select("row", "col", F.nanvl(F.coalesce("__own", "__mean"), F.lit(None).cast("double")).alias(value))


def extract_at_points(points: DataFrame, df: DataFrame, value: str, res: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """G13. The value of the cell under each point, with rows down from 0 at y = 0 upwards."""
    at = points.withColumn("row", F.floor(F.col(y) / res).cast("int")).withColumn("col", F.floor(F.col(x) / res).cast("int"))
    return at.join(df.select("row", "col", value), ["row", "col"], "left")


def nearest_layer(points: DataFrame, heights: list[float], z: str = "z", out: str = "height_m") -> DataFrame:
    """G14. The nearest of a few heights; at a midpoint the upper one."""
    hs = sorted(heights)
    c: Column = F.lit(float(hs[0]))
    for lo, hi in zip(hs[:-1], hs[1:], strict=True):
        c = F.when(F.col(z) >= (lo + hi) / 2, F.lit(float(hi))).otherwise(c)
    return points.withColumn(out, F.when(F.col(z).isNotNull(), c))


def modal_replace(df: DataFrame, value: str) -> DataFrame:
    """G15. 0 becomes the most common other value, the smallest of equals."""
    m = df.filter(F.col(value) != 0).agg(F.mode(value, deterministic=True).alias("__m"))
    return df.join(F.broadcast(m), how="cross").withColumn(value, F.when(F.col(value) == 0, F.col("__m")).otherwise(F.col(value))).drop("__m")  # one row


def fill_by_regression(df: DataFrame, layer: str, value: str, covariate: str, least: int = 10) -> DataFrame:
    """G16. NULLs from a line on the covariate fitted within the layer; layers of fewer than `least` rows stay."""
    fit = df.groupBy(layer).agg(F.regr_slope(value, covariate).alias("__b"), F.regr_intercept(value, covariate).alias("__a"), F.regr_count(value, covariate).alias("__n"))
    line = F.when(F.col("__n") >= least, F.col("__a") + F.col("__b") * F.col(covariate))
    return df.join(fit, layer, "left").withColumn(value, F.coalesce(value, line)).drop("__a", "__b", "__n")


def sharpen(coarse: DataFrame, fine: DataFrame, factor: int, value: str, cls: str) -> DataFrame:
    """G17. Coarse values at fine cells by class.

    The mean of each class over coarse cells, weighted by its share there, gives an expected coarse surface; the ratio of
    actual to expected, filled, capped at 3 * max / mean and brought back, multiplies the class means at the fine cells.
    """
    share = fine.groupBy(F.expr(f"row div {factor}").cast("int").alias("row"), F.expr(f"col div {factor}").cast("int").alias("col"), cls).agg(F.count("*").alias("__k"))
    share = share.withColumn("__w", F.col("__k") / F.sum("__k").over(Window.partitionBy("row", "col")))
    both = share.join(coarse.select("row", "col", value), ["row", "col"])
    means = both.filter(F.col(value).isNotNull()).groupBy(cls).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("__mean"))
    means = F.broadcast(means)  # a row a class
    expected = both.join(means, cls).groupBy("row", "col").agg(F.sum(F.col("__w") * F.col("__mean")).alias("__e"), F.first(value).alias(value))
    ratio = fill_multiscale(expected.select("row", "col", (F.col(value) / F.nullif(F.col("__e"), F.lit(0.0))).alias("__ratio")), "__ratio")
    cap = coarse.agg((3 * F.max(value) / F.avg(value)).alias("__cap"))
    ratio = ratio.join(F.broadcast(cap), how="cross").select("row", "col", F.least("__ratio", "__cap").alias("__ratio"))
    back = resample_bilinear(ratio, fine, factor, "__ratio")
    return fine.join(back, ["row", "col"]).join(means, cls, "left").withColumn(value, F.col("__mean") * F.col("__ratio")).drop("__mean", "__ratio")


def tile_with_buffer(df: DataFrame, tile: int, buffer: int) -> DataFrame:
    """G18. Cells of overlapping tiles of side `tile` with a margin; a cell is in each tile whose margin reaches it."""
    lo = lambda c: F.greatest(F.floor((F.col(c) - buffer) / tile), F.lit(0)).cast("int")
    hi = lambda c: F.least(F.floor((F.col(c) + buffer) / tile), F.col(f"__max_{c}")).cast("int")
    top = df.agg(*[F.floor(F.max(c) / tile).cast("int").alias(f"__max_{c}") for c in ("row", "col")])
    out = df.join(F.broadcast(top), how="cross")
    return out.withColumn("tile_row", F.explode(F.sequence(lo("row"), hi("row")))).withColumn("tile_col", F.explode(F.sequence(lo("col"), hi("col")))).drop("__max_row", "__max_col")


def tile_points(points: DataFrame, tile: str, most: int, size: int, x: str = "x", part: str = "part") -> DataFrame:
    """G18 for points: a tile of more than `most` points is split on x into ceil(points / size) parts of equal width, numbered from 1; others are one part.

    A part holds its lower break, the last one both. A point without x is in part 1.
    """
    ends = points.groupBy(tile).agg(F.count("*").alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    ends = ends.withColumn("__k", F.when(F.col("__n") > most, F.ceil(F.col("__n") / size)).otherwise(1))
    width = F.nullif((F.col("__hi") - F.col("__lo")) / F.col("__k"), F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col(x) - F.col("__lo")) / width) + 1, F.lit(1)), F.col("__k"))
    ends = ends.withColumnRenamed(tile, "__tile")
    out = points.join(ends, F.col(tile).eqNullSafe(F.col("__tile")))
    return out.withColumn(part, at.cast("int")).drop("__tile", "__n", "__lo", "__hi", "__k")


def bbox(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """G19. One row: the bounding box."""
    return df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def class_area(df: DataFrame, cls: str, res: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """G20. Cells, hectares and percent of each class."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.filter(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.count("*").alias("cells")).withColumn("hectares", F.col("cells") * (res * res / 10000)).withColumn("percent", 100 * F.col("cells") / F.sum("cells").over(w))


#: Land-cover codes
BARE, GRASS, TREE, OTHER_COVER = 16, 10, 2, 0


def landcover_rules(df: DataFrame, cell: str, height: str, pai: str, cut: float = 1.0) -> DataFrame:
    """G21. Bare, grass or tree from the mean density of the two lowest layers over the months."""
    means = df.groupBy(cell, height).agg(F.avg(pai).alias("m"))
    rank = F.dense_rank().over(Window.partitionBy(cell).orderBy(height))
    two = means.withColumn("k", rank).filter("k <= 2").groupBy(cell).agg(F.max(F.when(F.col("k") == 1, F.col("m"))).alias("low"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("m"))), F.lit(0.0)).alias("next"))
    code = F.when(F.col("next") > 0, TREE).when((F.col("next") == 0) & (F.col("low") < cut), BARE).when((F.col("next") == 0) & (F.col("low") >= cut), GRASS).otherwise(OTHER_COVER)
    return two.select(cell, code.cast("int").alias("cover"))


def global_stats(df: DataFrame, value: str, q: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """G22. Max, mean, sum and a quantile of a whole layer."""
    aggs = (F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    top = quantiles(df, value, [q], keys).withColumnRenamed("q0", "q")
    if not keys:
        return df.agg(*aggs).join(F.broadcast(top), how="left")  # a row each
    other = top.toDF(*[f"__{k}" for k in keys], "q")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.groupBy(*keys).agg(*aggs).join(other, same, "left").drop(*[f"__{k}" for k in keys])


def class_mean_fill(df: DataFrame, cls: str, value: str) -> DataFrame:
    """G23. NULLs from their class's mean."""
    means = F.broadcast(df.groupBy(cls).agg(F.avg(value).alias("__m")))
    return df.join(means, cls, "left").withColumn(value, F.coalesce(value, "__m")).drop("__m")


def expected_by_class(df: DataFrame, grid: DataFrame, cls: str, value: str) -> DataFrame:
    """G23. Another grid's cells with the mean of their class."""
    return grid.join(F.broadcast(df.groupBy(cls).agg(F.avg(value).alias(value))), cls, "left")


def habitat_params(df: DataFrame, lookup: DataFrame, code: str) -> DataFrame:
    """G24. Vegetation parameters of each cell's land-cover code; leaft is half of leafr."""
    return df.join(F.broadcast(lookup), code, "left").withColumn("leaft", 0.5 * F.col("leafr"))
