"""Two-dimensional grid functions.

A grid is one ``ARRAY<ARRAY<INT>>`` of at most 30 x 30 cells, so it always fits its row: every
function here maps columns to columns, and no grid operation needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.arrays import bound, counts, let, upto

MAX_SIDE = 30
DIHEDRAL_INVERSE = [0, 3, 2, 1, 4, 5, 6, 7]


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- shape and conversion -----------------------------------------------------------------------


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.coalesce(F.size(F.get(g, F.lit(0))), F.lit(0))


def shape(g: Column) -> Column:
    return F.struct(height(g).alias("i"), width(g).alias("j"))


def portrait(g: Column) -> Column:
    return height(g) > width(g)


def square(g: Column) -> Column:
    return height(g) == width(g)


def cell(g: Column, r: Column, c: Column) -> Column:
    """Value at a location, null outside the grid."""
    return F.get(F.get(g, r), c)


def build(h: Column | int, w: Column | int, value: Callable[[Column, Column], Column]) -> Column:
    """Grid of the given shape filled by ``value(r, c)``."""
    return F.transform(upto(_c(h)), lambda r: F.transform(upto(_c(w)), lambda c: value(r, c)))


def values(g: Column) -> Column:
    return F.flatten(g)


def asobject(g: Column) -> Column:
    """Every cell as ``(v, r, c)``."""
    return F.flatten(
        F.transform(
            g,
            lambda row, r: F.transform(
                row, lambda v, c: F.struct(v.alias("v"), r.alias("r"), c.alias("c"))
            ),
        )
    )


def asindices(g: Column) -> Column:
    return F.transform(asobject(g), lambda s: F.struct(s["r"], s["c"]))


def explode_cells(df: DataFrame, grid: str = "grid") -> DataFrame:
    """One row per cell: the other columns plus ``r, c, v``."""
    rest = [c for c in df.columns if c != grid]
    rows = df.select(*rest, F.posexplode(grid).alias("r", "_row"))
    return rows.select(*rest, "r", F.posexplode("_row").alias("c", "v"))


def collect_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse of ``explode_cells``; a grid is bounded, so its cells fit one group."""
    rows = cells.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("row"))
    cols = F.transform("row", lambda s: s["v"])
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("r", cols.alias("row")))).alias("rows")
    )
    return packed.select(*keys, F.transform("rows", lambda s: s["row"]).alias("grid"))


def to_text(g: Column) -> Column:
    """Cells joined by a space, rows joined by `` | ``."""
    rows = F.transform(g, lambda row: F.array_join(F.transform(row, lambda v: v.cast("string")), " "))
    return F.array_join(rows, " | ")


def from_text(text: Column) -> Column:
    """Inverse of ``to_text``."""
    return F.transform(
        F.split(text, r" \| "),
        lambda row: F.transform(F.split(row, " "), lambda v: v.cast("int")),
    )


@bound
def grid_hash(g: Column) -> Column:
    """md5 of shape and values; grids of different shape never share a hash input."""
    flat = F.array_join(F.transform(values(g), lambda v: v.cast("string")), ",")
    return F.md5(F.concat(height(g).cast("string"), F.lit("x"), width(g).cast("string"), F.lit(":"), flat))


@bound
def is_valid(g: Column) -> Column:
    """Rectangular, 1..30 rows and columns, every value 0..9."""
    sides = (F.size(g).between(1, MAX_SIDE)) & (width(g).between(1, MAX_SIDE))
    same = F.forall(g, lambda row: F.size(row) == width(g))
    good = F.forall(values(g), lambda v: v.between(0, 9))
    return F.coalesce(sides & same & good, F.lit(False))


# --- symmetry -----------------------------------------------------------------------------------


def flip_rows(g: Column) -> Column:
    return F.reverse(g)


def flip_cols(g: Column) -> Column:
    return F.transform(g, lambda row: F.reverse(row))


def transpose(g: Column) -> Column:
    return let(
        g,
        lambda x: F.transform(upto(width(x)), lambda c: F.transform(x, lambda row: F.get(row, c))),
    )


def dihedral(g: Column, tid: Column | int) -> Column:
    """Transform 0..7 of the square's symmetry group; any other id leaves the grid as it is.

    1-3 are counter-clockwise quarter turns, 4 mirrors columns, 5 mirrors rows, 6 transposes and
    7 mirrors along the counter-diagonal.
    """
    forms = {
        1: lambda: F.reverse(transpose(g)),
        2: lambda: F.reverse(flip_cols(g)),
        3: lambda: flip_cols(transpose(g)),
        4: lambda: flip_cols(g),
        5: lambda: flip_rows(g),
        6: lambda: transpose(g),
        7: lambda: F.reverse(flip_cols(transpose(g))),
    }
    if isinstance(tid, int):
        return forms[tid]() if tid in forms else g
    out = None
    for k, form in forms.items():
        out = F.when(tid == k, form()) if out is None else out.when(tid == k, form())
    return out.otherwise(g)


def inverse_dihedral(g: Column, tid: Column | int) -> Column:
    """Undo ``dihedral`` with the same id."""
    if isinstance(tid, int):
        return dihedral(g, DIHEDRAL_INVERSE[tid] if 0 <= tid < 8 else tid)
    back = F.when(tid == 1, 3).when(tid == 3, 1).otherwise(tid)
    return dihedral(g, back)


def rot90(g: Column) -> Column:
    """Clockwise quarter turn."""
    return dihedral(g, 3)


def rot180(g: Column) -> Column:
    return dihedral(g, 2)


def rot270(g: Column) -> Column:
    return dihedral(g, 1)


def hmirror(g: Column) -> Column:
    return dihedral(g, 5)


def vmirror(g: Column) -> Column:
    return dihedral(g, 4)


def dmirror(g: Column) -> Column:
    return dihedral(g, 6)


def cmirror(g: Column) -> Column:
    return dihedral(g, 7)


# --- colours ------------------------------------------------------------------------------------


def mostcolor(g: Column) -> Column:
    """Most frequent colour, the smaller one on a tie."""
    return let(values(g), lambda vs: F.array_max(counts(vs))["x"])


def leastcolor(g: Column) -> Column:
    """Least frequent colour, the smaller one on a tie."""
    return let(
        values(g),
        lambda vs: F.array_min(F.transform(counts(vs), lambda s: F.struct(s["n"], s["x"])))["x"],
    )


def colorcount(g: Column, v: Column | int) -> Column:
    return F.size(F.filter(values(g), lambda x: x == _c(v)))


def palette(g: Column) -> Column:
    """Distinct colours in ascending order."""
    return F.array_sort(F.array_distinct(values(g)))


def numcolors(g: Column) -> Column:
    return F.size(F.array_distinct(values(g)))


def ofcolor(g: Column, v: Column | int) -> Column:
    """Locations of one colour."""
    hits = F.filter(asobject(g), lambda s: s["v"] == _c(v))
    return F.transform(hits, lambda s: F.struct(s["r"], s["c"]))


def replace(g: Column, old: Column | int, new: Column | int) -> Column:
    return F.transform(
        g, lambda row: F.transform(row, lambda v: F.when(v == _c(old), _c(new)).otherwise(v))
    )


def switch(g: Column, a: Column | int, b: Column | int) -> Column:
    return F.transform(
        g,
        lambda row: F.transform(
            row, lambda v: F.when(v == _c(a), _c(b)).when(v == _c(b), _c(a)).otherwise(v)
        ),
    )


# --- windows and assembly -----------------------------------------------------------------------


def crop(g: Column, r: Column | int, c: Column | int, h: Column | int, w: Column | int) -> Column:
    """Rows ``r..r+h-1`` and columns ``c..c+w-1``, cut at the border."""
    rows = F.slice(g, _c(r) + 1, F.greatest(_c(h), F.lit(0)))
    return F.transform(rows, lambda row: F.slice(row, _c(c) + 1, F.greatest(_c(w), F.lit(0))))


@bound
def trim(g: Column) -> Column:
    """Drop the outer ring."""
    return crop(g, 1, 1, height(g) - 2, width(g) - 2)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


@bound
def tophalf(g: Column) -> Column:
    return crop(g, 0, 0, _half(height(g)), width(g))


@bound
def bottomhalf(g: Column) -> Column:
    n = _half(height(g))
    return crop(g, height(g) - n, 0, n, width(g))


@bound
def lefthalf(g: Column) -> Column:
    return crop(g, 0, 0, height(g), _half(width(g)))


@bound
def righthalf(g: Column) -> Column:
    n = _half(width(g))
    return crop(g, 0, width(g) - n, height(g), n)


def _stretch(a: Column, factor: Column | int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, _c(factor))))


def hupscale(g: Column, factor: Column | int) -> Column:
    return F.transform(g, lambda row: _stretch(row, factor))


def vupscale(g: Column, factor: Column | int) -> Column:
    return _stretch(g, factor)


def upscale(g: Column, factor: Column | int) -> Column:
    return vupscale(hupscale(g, factor), factor)


def downscale(g: Column, factor: Column | int) -> Column:
    """Keep every ``factor``-th row and column, from the first."""
    def keep(x, i):
        return F.pmod(i, _c(factor)) == 0

    return F.transform(F.filter(g, keep), lambda row: F.filter(row, keep))


def hconcat(a: Column, b: Column) -> Column:
    """Side by side; the taller grid is cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.concat(x, y))


def vconcat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


@bound
def hsplit(g: Column, n: int) -> Column:
    """``n`` parts from left to right; one column is skipped between parts if not divisible."""
    w = F.floor(width(g) / n).cast("int")
    gap = F.when(width(g) % n != 0, 1).otherwise(0)
    return F.array(*[crop(g, 0, w * i + gap * i, height(g), w) for i in range(n)])


@bound
def vsplit(g: Column, n: int) -> Column:
    """``n`` parts from top to bottom; one row is skipped between parts if not divisible."""
    h = F.floor(height(g) / n).cast("int")
    gap = F.when(height(g) % n != 0, 1).otherwise(0)
    return F.array(*[crop(g, h * i + gap * i, 0, h, width(g)) for i in range(n)])


def cellwise(a: Column, b: Column, fallback: Column | int) -> Column:
    """Value where both grids agree, ``fallback`` elsewhere; shaped like ``a``."""
    def same(other: Column) -> Column:
        return F.transform(
            a,
            lambda row, r: F.transform(
                row, lambda v, c: F.when(v == cell(other, r, c), v).otherwise(_c(fallback))
            ),
        )

    return let(b, same)


def canvas(value: Column | int, h: Column | int, w: Column | int) -> Column:
    return F.array_repeat(F.array_repeat(_c(value), _c(w)), _c(h))


def compress(g: Column) -> Column:
    """Drop single-coloured rows and columns, judged on the whole grid."""

    def varied(a: Column) -> Column:
        return F.size(F.array_distinct(a)) > 1

    def cut(x: Column) -> Column:
        columns = F.filter(upto(width(x)), lambda c: varied(F.transform(x, lambda row: F.get(row, c))))
        rows = F.filter(x, varied)
        return let(
            columns,
            lambda cs: F.transform(rows, lambda row: F.transform(cs, lambda c: F.get(row, c))),
        )

    return let(g, cut)


@bound
def frontiers(g: Column) -> Column:
    """Single-coloured rows and columns as ``(axis, index, value)``."""
    rows = F.filter(
        F.transform(
            g,
            lambda row, r: F.struct(
                F.lit("h").alias("axis"),
                r.alias("at"),
                F.get(row, F.lit(0)).alias("v"),
                F.size(F.array_distinct(row)).alias("n"),
            ),
        ),
        lambda s: s["n"] == 1,
    )
    cols = F.filter(
        F.transform(
            transpose(g),
            lambda col, c: F.struct(
                F.lit("v").alias("axis"),
                c.alias("at"),
                F.get(col, F.lit(0)).alias("v"),
                F.size(F.array_distinct(col)).alias("n"),
            ),
        ),
        lambda s: s["n"] == 1,
    )
    return F.concat(rows, cols)


def occurrences(g: Column, pattern: Column) -> Column:
    """Locations where the pattern grid occurs in full."""
    def search(s: Column) -> Column:
        x, p = s["x"], s["p"]
        places = F.flatten(
            F.transform(
                upto(height(x) - height(p) + 1),
                lambda r: F.transform(
                    upto(width(x) - width(p) + 1), lambda c: F.struct(r.alias("r"), c.alias("c"))
                ),
            )
        )
        same = lambda at: F.zip_with(
            p,
            F.slice(x, at["r"] + 1, F.size(p)),
            lambda want, row: F.slice(row, at["c"] + 1, F.size(want)) == want,
        )
        return F.filter(places, lambda at: F.forall(same(at), lambda ok: ok))

    return let(F.struct(g.alias("x"), pattern.alias("p")), search)


def hperiod(g: Column) -> Column:
    """Smallest column shift under which the grid repeats, else its width."""
    def search(x: Column) -> Column:
        w = width(x)

        def repeats(p: Column) -> Column:
            return F.forall(x, lambda row: F.slice(row, p + 1, w - p) == F.slice(row, F.lit(1), w - p))

        return F.coalesce(F.array_min(F.filter(upto(w), lambda p: (p > 0) & repeats(p))), w)

    return let(g, search)


def vperiod(g: Column) -> Column:
    """Smallest row shift under which the grid repeats, else its height."""
    def search(x: Column) -> Column:
        h = height(x)
        hits = F.filter(
            upto(h), lambda p: (p > 0) & (F.slice(x, p + 1, h - p) == F.slice(x, F.lit(1), h - p))
        )
        return F.coalesce(F.array_min(hits), h)

    return let(g, search)


# --- measures -----------------------------------------------------------------------------------


def edge_cells(g: Column) -> Column:
    """Number of cells in the first h-1 rows and w-1 columns with a change to the right or below."""

    def count(x: Column) -> Column:
        inner = F.transform(
            F.slice(x, F.lit(1), F.greatest(height(x) - 1, F.lit(0))),
            lambda row, r: F.size(
                F.filter(
                    F.slice(row, F.lit(1), F.greatest(width(x) - 1, F.lit(0))),
                    lambda v, c: (v != F.get(row, c + 1)) | (v != cell(x, r + 1, c)),
                )
            ),
        )
        return F.aggregate(inner, F.lit(0), lambda acc, n: acc + n)

    return let(g, count)


@bound
def edge_density(g: Column) -> Column:
    """``edge_cells`` over (h-1)(w-1); 0 for grids of one row or column."""
    h, w = height(g), width(g)
    thin = (h <= 1) | (w <= 1)
    return F.when(thin, F.lit(0.0)).otherwise(edge_cells(g) / ((h - 1) * (w - 1)))


def difficulty(a: Column, b: Column) -> Column:
    """Heuristic difficulty of an input/output pair, with its four parts."""
    return let(a, lambda x: let(b, lambda y: _difficulty(x, y)))


def _difficulty(a: Column, b: Column) -> Column:
    cells_a, cells_b = height(a) * width(a), height(b) * width(b)
    h, w = F.least(height(a), height(b)), F.least(width(a), width(b))
    differing = F.aggregate(
        F.zip_with(
            F.slice(a, F.lit(1), h),
            F.slice(b, F.lit(1), h),
            lambda x, y: F.size(
                F.filter(
                    F.zip_with(F.slice(x, F.lit(1), w), F.slice(y, F.lit(1), w), lambda p, q: p != q),
                    lambda d: d,
                )
            ),
        ),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    diff = F.when((h > 0) & (w > 0), differing / (h * w)).otherwise(F.lit(1.0))
    size_diff = F.abs(cells_a - cells_b) / F.greatest(cells_a, cells_b)
    parts = F.struct(
        (cells_a / F.lit(float(MAX_SIDE * MAX_SIDE))).alias("size_factor"),
        ((numcolors(a) + numcolors(b)) / F.lit(20.0)).alias("color_diversity"),
        (F.lit(0.7) * diff + F.lit(0.3) * size_diff).alias("transformation"),
        ((edge_density(a) + edge_density(b)) / 2).alias("pattern"),
    )

    def total(s: Column) -> Column:
        return (
            F.lit(0.2) * s["size_factor"]
            + F.lit(0.3) * s["color_diversity"]
            + F.lit(0.3) * s["transformation"]
            + F.lit(0.2) * s["pattern"]
        )

    return let(parts, lambda s: s.withField("difficulty", total(s)))


@bound
def valid_rect(x: Column, low: int = 2, high: int = 11) -> Column:
    """Largest top-left rectangle free of values outside ``low..high``, shifted down by ``low``.

    The usable width of the first r rows is the running minimum of the row prefixes, so one pass
    over the rows finds the first rectangle of maximum area.
    """
    clean = F.transform(
        x,
        lambda row: F.coalesce(
            F.array_min(
                F.filter(
                    F.transform(row, lambda v, c: F.when(v.between(low, high), None).otherwise(c)),
                    lambda c: c.isNotNull(),
                )
            ),
            F.size(row),
        ),
    )
    start = F.struct(
        F.lit(0).alias("r"), F.lit(10**6).alias("run"), F.lit(0).alias("h"), F.lit(0).alias("w")
    )

    def step(acc: Column, n: Column) -> Column:
        r, run = acc["r"] + 1, F.least(acc["run"], n)
        better = r * run > acc["h"] * acc["w"]
        return F.struct(
            r.alias("r"),
            run.alias("run"),
            F.when(better, r).otherwise(acc["h"]).alias("h"),
            F.when(better, run).otherwise(acc["w"]).alias("w"),
        )

    best = F.aggregate(clean, start, step)
    cut = let(best, lambda b: crop(x, 0, 0, b["h"], b["w"]))
    return F.transform(cut, lambda row: F.transform(row, lambda v: v - low))


@bound
def rescale(g: Column) -> Column:
    """Min-max scaling to 0..255, truncated; the 1e-8 in the divisor keeps the maximum below 255."""
    span = F.struct(F.array_min(values(g)).alias("lo"), F.array_max(values(g)).alias("hi"))
    return let(
        span,
        lambda s: F.transform(
            g,
            lambda row: F.transform(
                row,
                lambda v: F.floor((v - s["lo"]) / (s["hi"] - s["lo"] + F.lit(1e-8)) * 255).cast("int"),
            ),
        ),
    )


@bound
def rescale_by_max(g: Column) -> Column:
    """Scaling by the maximum to 0..255 in single precision, truncated; an all-zero grid stays."""
    def scaled(v: Column, hi: Column) -> Column:
        return F.floor((v / hi).cast("float") * F.lit(255.0).cast("float")).cast("int")

    return let(
        F.array_max(values(g)),
        lambda hi: F.transform(
            g,
            lambda row: F.transform(
                row, lambda v: F.when(hi > 0, scaled(v, hi)).otherwise(v)
            ),
        ),
    )


def mosaic(panels: Column, side: int, columns: int = 3, empty: int = 255) -> Column:
    """Panels of ``side`` x ``side`` laid out row by row; missing panels are filled with ``empty``."""
    total = columns * side

    def board(tiles: Column) -> Column:
        def value(r: Column, c: Column) -> Column:
            at = F.floor(r / side) * columns + F.floor(c / side)
            inside = cell(F.get(tiles, at.cast("int")), F.pmod(r, F.lit(side)), F.pmod(c, F.lit(side)))
            return F.coalesce(inside, F.lit(empty))

        return build(total, total, value)

    return let(panels, board)
