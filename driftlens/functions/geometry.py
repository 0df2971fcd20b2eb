"""Column geometry: homogeneous transforms, canvases, tile arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def homography(*values) -> list[list[Column]]:
    """Nine row-major entries, columns or numbers."""
    cells = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]
    return [cells[0:3], cells[3:6], cells[6:9]]


def transform_point(x: Column, y: Column, h) -> tuple[Column, Column, Column]:
    """(x', y', ok): coordinates are NULL on the projective horizon."""
    u, v, w = (row[0] * x + row[1] * y + row[2] for row in h)
    ok = F.abs(w) >= 1e-10
    return F.when(ok, u / w), F.when(ok, v / w), ok


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matrix_problem(m) -> Column:
    """``singular`` or NULL for a matrix with greatest entry 1.

    The least singular value is the determinant over the norm of the cofactors,
    which holds up to a factor of three and needs no decomposition.
    """
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    norm = lambda values: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    cofactors = F.array(*[minor(i, j) for i in range(3) for j in range(3)])
    whole = F.array(*[x for row in m for x in row])
    least = lambda c: F.abs(m[0][0] * c[0] + m[0][1] * c[1] + m[0][2] * c[2])
    # Rank two: the determinant is lost in rounding; rank one: the cofactors are.
    flat = lambda c: (least(c) <= 3 * 2.0**-52 * norm(whole) * norm(c)) | (norm(c) <= 3 * 2.0**-52 * norm(whole) * norm(whole))
    return F.when(_let(cofactors, flat), "singular")


def expanded_canvas(width, height, src_width, src_height, h, max_side=16000, max_pixels=50_000_000) -> dict[str, Column]:
    """Bounding canvas of a reference and a warped source, with safety limits.

    The matrix is scaled by its largest entry first, so the tests do not depend
    on its scale. A matrix that is not finite (or all zeros) or singular, or
    whose horizon cuts the source, has no canvas.
    """
    half = F.lit(0.5)
    corners = [(-half, -half), (src_width - half, -half), (src_width - half, src_height - half), (-half, src_height - half)]
    given = F.array(*[x.cast("double") for row in h for x in row])
    sizes = lambda cells: F.aggregate(cells, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    lost = lambda cells: F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def scaled(cells):
        size = sizes(cells)
        return F.when(~lost(cells) & (size > 0), F.transform(cells, lambda x: x / size))

    def placed(cells):
        m = [[cells[3 * i + j] for j in range(3)] for i in range(3)]
        moved = [transform_point(x, y, m) for x, y in corners]
        return F.struct(
            F.array(-half, width - half, *[p[0] for p in moved]).alias("xs"), F.array(-half, height - half, *[p[1] for p in moved]).alias("ys"),
            F.array(*[m[2][0] * x + m[2][1] * y + m[2][2] for x, y in corners]).alias("ws"), F.when(cells.isNull(), "not_finite").otherwise(_matrix_problem(m)).alias("problem"),
        )

    def bounded(at):
        low, high = F.array_min(at["ws"]), F.array_max(at["ws"])
        near = F.array_min(F.transform(at["ws"], F.abs)) < 1e-10
        broken = F.coalesce(at["problem"], F.when(near | (low * high <= 0), "horizon"))
        sound = lambda value: F.when(broken.isNull(), value)
        least = lambda c: sound(F.floor(F.array_min(at[c]) + 0.5 + 1e-9))
        most = lambda c: sound(F.ceil(F.array_max(at[c]) + 0.5 - 1e-9))
        return F.struct(least("xs").alias("left"), least("ys").alias("top"), (most("xs") - least("xs")).alias("cols"), (most("ys") - least("ys")).alias("rows"), broken.alias("problem"))

    canvas = _let(_let(_let(given, scaled), placed), bounded)
    cols, rows = canvas["cols"], canvas["rows"]
    unsafe = (F.least(cols, rows) <= 0) | (F.greatest(cols, rows) > max_side) | (cols.cast("double") * rows > max_pixels)
    return {"left": canvas["left"], "top": canvas["top"], "canvas_width": cols, "canvas_height": rows, "problem": F.coalesce(canvas["problem"], F.when(unsafe, "unsafe_size"))}


def tile_origins(length: Column, size: int, stride: int) -> Column:
    """Regular origins plus a final origin anchored to the edge."""
    last = F.greatest(F.lit(0), length - size)
    return F.array_union(F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride)), F.array(last.cast("int")))


def tile_count(width: Column, height: Column, size: int, stride: int) -> Column:
    """Closed form of the number of tiles."""
    axis = lambda n: F.floor((F.greatest(F.lit(0), n - size) + stride - 1) / stride) + 1
    return (axis(width) * axis(height)).cast("bigint")


def covering_origins(position: Column, length: Column, size: int, stride: int) -> Column:
    """Origins of the tiles that contain a position: at most size/stride + 2 of them."""
    last = F.greatest(F.lit(0), length - size).cast("int")
    low = F.greatest(F.lit(0), F.ceil((position - size + 1) / stride)).cast("int")
    high = F.least(F.floor(position / stride), F.floor(last / stride)).cast("int")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    edge = F.when(position >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_union(regular, edge)


def overlap_area(a, b) -> Column:
    """Shared area of two boxes given as (x, y, w, h) columns."""
    dx = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), dx) * F.greatest(F.lit(0), dy)


def box_iou(a, b) -> Column:
    shared = overlap_area(a, b)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


def box_containment(a, b) -> Column:
    return overlap_area(a, b) / F.greatest(F.lit(1), F.least(a[2] * a[3], b[2] * b[3]))
