"""Grid and image rasters as sparse cell tables.

Neighbourhood operators send every cell, or words of 32 cells, to the cells they touch (a fixed
number of copies) and aggregate; partial results are combined before the shuffle and no table is
joined to itself. Zero cells are never materialised unless the result asks for a dense grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions.coders import gaussian_radius
from voxelmill.schemas import Grid

c = F.col
CELL = ("row", "col")


def _offsets(radius: int, plus: bool = False) -> Column:
    pts = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)
           if not plus or abs(a) + abs(b) <= radius]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pts]))


def spread(cells: DataFrame, radius: int, cell: Sequence[str] = CELL, plus: bool = False) -> DataFrame:
    """Copies of each cell at all neighbours; ``own`` marks the copy at the cell itself."""
    r, q = cell
    out = cells.withColumn("_o", _offsets(radius, plus))
    return out.withColumns({r: c(r) + c("_o.dr"), q: c(q) + c("_o.dc"),
                            "own": ((c("_o.dr") == 0) & (c("_o.dc") == 0)).cast("int")}).drop("_o")


def in_grid(rows: int, cols: int, cell: Sequence[str] = CELL) -> Column:
    r, q = cell
    return c(r).between(0, rows - 1) & c(q).between(0, cols - 1)


WORD = 32  # columns of a block of cells; its word has 16 more places on both sides for the columns beyond
HALO = 16


def _steps(radius: int) -> list[int]:
    """A radius as steps that words can take."""
    return [HALO] * (radius // HALO) + ([radius % HALO] if radius % HALO or radius == 0 else [])


def _shift(word: Column, by: int | Column) -> Column:
    return F.call_function("shiftleft", word, by if isinstance(by, Column) else F.lit(by))


def to_words(cells: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """Cells as bits of one word for each (keys, row, block of columns), with ``halo`` columns of the blocks
    beside it. Many cells meet in one word already in the task that holds them."""
    near = cells.where(c("col").isNotNull()).select(*keys, "row", "col", F.explode(F.sequence(
        F.shiftright(c("col").cast("bigint") - halo, 5), F.shiftright(c("col").cast("bigint") + halo, 5))).alias("_block"))
    bit = _shift(F.lit(1).cast("bigint"), (c("col") - c("_block") * WORD + HALO).cast("int"))
    return near.groupBy(*keys, "row", "_block").agg(F.bit_or(bit).alias("_word"))


def _own(word: Column) -> Column:
    """The word's own columns, from bit 0."""
    return F.shiftrightunsigned(word, HALO).bitwiseAND(F.lit((1 << WORD) - 1))


def _to_cells(words: DataFrame, keys: Sequence[str], bits: Column) -> DataFrame:
    places = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))
    set_ = words.select(*keys, "row", "_block", bits.alias("_bits")).where(c("_bits") != 0).withColumn("_i", places)
    set_ = set_.where(F.getbit("_bits", c("_i")) == 1)
    return set_.select(*keys, "row", (c("_block") * WORD + c("_i")).cast("bigint").alias("col"))


def _moved(word: Column, step: int, how: str) -> Column:
    """Words shifted by up to ``step`` places both ways, joined by ``bitwiseOR`` or ``bitwiseAND``."""
    out = word
    for d in range(1, step + 1):
        out = getattr(getattr(out, how)(_shift(word, d)), how)(F.shiftrightunsigned(word, d))
    return out


def _down(words: DataFrame, step: int) -> DataFrame:
    """Copies of each word along the rows; ``_d`` is the step taken."""
    return words.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in range(-step, step + 1)]))).withColumn("row", c("row") + c("_d"))


def dilate(cells: DataFrame, keys: Sequence[str], radius: int, rows: int, cols: int) -> DataFrame:
    """Square growth on words of 32 cells: shifts along the columns, ``2r + 1`` copies of a word along the rows."""
    out = cells.select(*keys, *CELL)
    for step in _steps(radius):
        wide = to_words(out, keys, step).withColumn("_word", _own(_moved(c("_word"), step, "bitwiseOR"))).where(c("_word") != 0)
        grown = _down(wide, step).groupBy(*keys, "row", "_block").agg(F.bit_or("_word").alias("_word"))
        out = _to_cells(grown, keys, c("_word"))
    return out.where(in_grid(rows, cols))


def _eroded_words(cells: DataFrame, keys: Sequence[str], step: int, rows: int, cols: int) -> DataFrame:
    """(keys, row, _block, _set, _core): the cells of the grid that are set, and those of them whose whole window is
    (places outside the grid count as set)."""
    words = to_words(cells.select(*keys, *CELL).where(in_grid(rows, cols)), keys, step)
    beyond = (cols - c("_block") * WORD + HALO).cast("int")  # the first place right of the grid
    outside = F.when(c("_block") == 0, F.lit((1 << HALO) - 1)).otherwise(F.lit(0)).cast("bigint").bitwiseOR(
        F.when(beyond < 64, _shift(F.lit(-1).cast("bigint"), beyond)).otherwise(F.lit(0).cast("bigint")))
    wide = words.withColumns({"_set": _own(c("_word")), "_in": _own(_moved(c("_word").bitwiseOR(outside), step, "bitwiseAND"))})
    wide = wide.where(c("_set") != 0).withColumn("_in", c("_in").bitwiseAND(c("_set")))
    met = _down(wide.select(*keys, "row", "_block", "_set", "_in"), step).where(c("row").between(0, rows - 1)).groupBy(*keys, "row", "_block").agg(
        F.bit_or(F.when(c("_d") == 0, c("_set"))).alias("_set"), F.bit_and("_in").alias("_core"), F.count("*").alias("_n"))
    window = F.least(c("row") + step, F.lit(rows - 1)) - F.greatest(c("row") - step, F.lit(0)) + 1
    return met.where(c("_set").isNotNull()).withColumn("_core", F.when(c("_n") == window, c("_core")).otherwise(F.lit(0).cast("bigint"))).drop("_n")


def erode(cells: DataFrame, keys: Sequence[str], radius: int, rows: int, cols: int) -> DataFrame:
    """Cells whose whole window (clipped at the border) is set."""
    out = cells
    for step in _steps(radius):
        out = _to_cells(_eroded_words(out, keys, step, rows, cols), keys, c("_core"))
    return out


def cell_boundary(cells: DataFrame, keys: Sequence[str], rows: int, cols: int) -> DataFrame:
    """Set cells that erosion removes."""
    return _to_cells(_eroded_words(cells, keys, 1, rows, cols), keys, c("_set").bitwiseAND(F.bitwise_not("_core")))


def core_words(cells: DataFrame, keys: Sequence[str], radius: int, rows: int, cols: int) -> DataFrame:
    """``erode`` as words: (keys, row, _block, _bits) with the first column of the block at bit 0."""
    *first, last = _steps(radius)
    for step in first:
        cells = _to_cells(_eroded_words(cells, keys, step, rows, cols), keys, c("_core"))
    return _eroded_words(cells, keys, last, rows, cols).select(*keys, "row", "_block", c("_core").alias("_bits")).where(c("_bits") != 0)


def boundary_words(cells: DataFrame, keys: Sequence[str], rows: int, cols: int) -> DataFrame:
    """``cell_boundary`` as words."""
    edge = c("_set").bitwiseAND(F.bitwise_not("_core")).alias("_bits")
    return _eroded_words(cells, keys, 1, rows, cols).select(*keys, "row", "_block", edge).where(c("_bits") != 0)


def grown_words(words: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """``dilate`` from words to words, also beyond the grid."""
    side = {-1: _shift(c("_bits"), WORD + HALO), 0: _shift(c("_bits"), HALO), 1: F.shiftrightunsigned("_bits", HALO)}
    copies = F.inline(F.array(*[F.struct((c("_block") + d).alias("_to"), w.alias("_word")) for d, w in side.items()]))
    for step in _steps(radius):
        wide = words.select(*keys, "row", copies).where(c("_word") != 0).groupBy(*keys, "row", c("_to").alias("_block")).agg(F.bit_or("_word").alias("_word"))
        wide = wide.withColumn("_bits", _own(_moved(c("_word"), step, "bitwiseOR"))).where(c("_bits") != 0)
        words = _down(wide.select(*keys, "row", "_block", "_bits"), step).groupBy(*keys, "row", "_block").agg(F.bit_or("_bits").alias("_bits"))
    return words


def semantic_boundary(pixels: DataFrame, radius: int, rows: int, cols: int) -> DataFrame:
    """Pixels whose right, left, upper or lower neighbour has another label, then dilated. The neighbours are seen by
    windows along the rows and the columns of a frame, so no pixel is copied; a pixel has one label."""
    at = pixels.select("frame_id", c("v").alias("row"), c("u").alias("col"), "semantic_id")
    for line, along in (CELL, CELL[::-1]):
        w = Window.partitionBy("frame_id", line).orderBy(along).rangeBetween(-1, 1)
        at = at.withColumns({f"_{f.__name__}_{along}": f("semantic_id").over(w) for f in (F.min, F.max)})
    edge = at.where(F.least("_min_col", "_min_row") != F.greatest("_max_col", "_max_row")).select("frame_id", *CELL)
    return edge if radius == 0 else dilate(edge, ["frame_id"], radius, rows, cols)


def trusted_pixels(pixels: DataFrame, mapped: Column, boundary: DataFrame) -> DataFrame:
    """Pixels with a mapped class that are not near a label edge."""
    edge = boundary.select("frame_id", c("row").alias("v"), c("col").alias("u"))
    return pixels.where(mapped).join(edge, ["frame_id", "v", "u"], "left_anti")


def farthest_per_azimuth(points: DataFrame, origin: Sequence[float], degrees: float = 0.5) -> DataFrame:
    """Farthest point of each azimuth bin (lowest id on ties), as an aggregate."""
    dx, dy = c("x") - origin[0], c("y") - origin[1]
    rows = points.withColumns({"_dx": dx, "_dy": dy}).withColumn("_r", F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy")))
    rows = rows.where(c("_r") > 1e-4).withColumn(
        "bin", F.rint(F.atan2("_dy", "_dx") / math.radians(degrees)).cast("bigint"))
    best = rows.groupBy("frame_id", "bin").agg(F.max(F.struct(
        c("_r").alias("r"), (-c("point_id")).alias("neg"), c("_dx").alias("dx"), c("_dy").alias("dy"))).alias("m"))
    return best.select("frame_id", "bin", (-c("m.neg")).alias("point_id"), c("m.r").alias("range"), "m.dx", "m.dy")


def _grid_part(origin: float, step: Column, low: float, high: float) -> tuple[Column, Column]:
    """Parameters at which ``origin + step * t`` enters and leaves ``[low, high]``; nothing is left if it never does."""
    to_low, to_high = (F.lit(low) - origin) / F.nullif(step, F.lit(0.0)), (F.lit(high) - origin) / F.nullif(step, F.lit(0.0))
    still = F.lit(low <= origin <= high)
    none, always = (F.lit(2.0), F.lit(-1.0)), (F.lit(0.0), F.lit(1.0))
    return tuple(F.when(step == 0, F.when(still, yes).otherwise(no)).otherwise(pick(to_low, to_high))
                 for yes, no, pick in zip(always, none, (F.least, F.greatest)))


def observed_rays(points: DataFrame, origin: Sequence[float], g: Grid) -> DataFrame:
    """Cells on the way to the farthest point of each azimuth bin, sampled at half a cell. A ray's entry
    into the grid and its exit are known before it is sampled, so samples outside are never made."""
    far = farthest_per_azimuth(points, origin)
    last = F.greatest(F.ceil(c("range") / (g.cell * 0.5)) + 1, F.lit(2)) - 1
    in_x, out_x = _grid_part(origin[0], c("dx"), g.x0, g.x1)
    in_y, out_y = _grid_part(origin[1], c("dy"), g.y0, g.y1)
    far = far.withColumns({"_last": last, "_in": F.greatest(in_x, in_y, F.lit(0.0)), "_out": F.least(out_x, out_y, F.lit(1.0))}).where(c("_in") <= c("_out"))
    # one sample more at both ends, for rounding; the test below decides
    first = F.greatest(F.floor(c("_in") * c("_last")) - 1, F.lit(0).cast("bigint"))
    final = F.least(F.ceil(c("_out") * c("_last")) + 1, c("_last"))
    # a frame has one ray an azimuth bin at most, so its samples meet where its rays are and are never shuffled
    ray = far.repartition("frame_id").withColumn("_k", F.explode(F.sequence(first, final)))
    t = c("_k") / c("_last")
    ray = ray.withColumns({"_x": c("dx") * t + origin[0], "_y": c("dy") * t + origin[1]})
    ray = ray.where((c("_x") >= g.x0) & (c("_x") < g.x1) & (c("_y") >= g.y0) & (c("_y") < g.y1))
    cells = ray.select("frame_id", F.floor((c("_x") - g.x0) / g.cell).alias("row"), F.floor((c("_y") - g.y0) / g.cell).alias("col"))
    return _to_cells(to_words(cells, ["frame_id"], 0), ["frame_id"], _own(c("_word")))


def depth_map(points: DataFrame, u: Column, v: Column, depth: Column, height: int, width: int) -> DataFrame:
    """Depth per pixel: nearest depth, then lowest point id; depth is clamped, not dropped."""
    clamped = F.greatest(depth, F.lit(1e-5))
    px = points.withColumns({"_u": F.floor(u), "_v": F.floor(v), "_d": clamped})
    px = px.where(c("_u").between(0, width - 1) & c("_v").between(0, height - 1))
    best = px.groupBy("frame_id", c("_v").alias("v"), c("_u").alias("u")).agg(
        F.min(F.struct(c("_d"), c("point_id"))).alias("_m"))
    return best.select("frame_id", "v", "u", c("_m._d").alias("depth"), c("_m.point_id").alias("point_id"))


def depth_downsample(pixels: DataFrame, factor: int, start: float, step: float, bins: int) -> DataFrame:
    """Nearest non-zero depth per block and its bin; bins outside the range become 0."""
    near = pixels.where(c("depth_mm") > 0).groupBy(
        "frame_id", F.floor(c("v") / factor).alias("row"), F.floor(c("u") / factor).alias("col")).agg(
        (F.min("depth_mm") / 1000.0).alias("depth"))
    raw = (c("depth") - (start - step)) / step
    return near.withColumn("bin", F.when((raw >= 0) & (raw < bins + 1), raw.cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def bev_resample(cells: DataFrame, keys: Sequence[str], value: str, src: tuple, dst: tuple) -> DataFrame:
    """Bilinear sampling from one grid scope to another; outside is 0.

    ``src`` and ``dst`` hold (start, stop, step) per axis. Every source cell is sent to the
    output cells whose footprint covers it, so the result is one aggregate.
    """
    out = cells
    weight = F.lit(1.0)
    for axis, (i0, _, istep), (o0, o1, ostep) in zip(CELL, src, dst):
        n = round((o1 - o0) / ostep)
        low = ((c(axis) - 0.5) * istep + i0 - o0) / ostep - 0.5
        high = ((c(axis) + 1.5) * istep + i0 - o0) / ostep - 0.5
        first, last = F.greatest(F.ceil(low), F.lit(0)), F.least(F.floor(high), F.lit(n - 1))
        target = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(f"_{axis}", F.explode(target))
        at = (F.lit(o0) + (c(f"_{axis}") + 0.5) * ostep - i0) / istep - 0.5
        weight = weight * F.greatest(1.0 - F.abs(at - c(axis)), F.lit(0.0))
    out = out.withColumn("_w", weight).where(c("_w") > 0)
    return out.groupBy(*keys, c("_row").alias("row"), c("_col").alias("col")).agg(
        F.sum(c("_w") * c(value)).alias(value))


def heat_targets(boxes: DataFrame, origin: Sequence[float], voxel: float, stride: int, size: tuple[int, int],
                 overlap: float, min_radius: int, max_objs: int) -> DataFrame:
    """Per object: cell, sub-cell offset, Gaussian radius. Objects outside the map are dropped
    after the first ``max_objs`` of the frame were taken."""
    w = Window.partitionBy("frame_id").orderBy("box_id")
    rows = boxes.withColumn("slot", F.row_number().over(w)).where(c("slot") <= max_objs)
    unit = voxel * stride
    rows = rows.withColumns({"_u": (c("x") - origin[0]) / unit, "_v": (c("y") - origin[1]) / unit})
    rows = rows.withColumns({"cu": c("_u").cast("bigint"), "cv": c("_v").cast("bigint")})
    rows = rows.where(c("cu").between(0, size[0] - 1) & c("cv").between(0, size[1] - 1) & (c("dx") > 0) & (c("dy") > 0))
    r = gaussian_radius(c("dy") / unit, c("dx") / unit, overlap)
    return rows.withColumns({
        "radius": F.greatest(r.cast("bigint"), F.lit(min_radius).cast("bigint")),
        "off_u": c("_u") - c("cu"), "off_v": c("_v") - c("cv"), "ind": c("cu") * size[1] + c("cv")}).drop("_u", "_v")


def draw_gaussian(targets: DataFrame, size: tuple[int, int], k: float = 1.0) -> DataFrame:
    """Heat map cells: the largest Gaussian value over all objects of a class."""
    step = lambda: F.explode(F.sequence(-c("radius"), c("radius")))
    disc = targets.withColumn("_a", step()).withColumn("_b", step())
    disc = disc.withColumns({"row": c("cu") + c("_a"), "col": c("cv") + c("_b")}).where(in_grid(*size))
    sigma = (2 * c("radius") + 1) / 6
    heat = F.exp(-(c("_a") * c("_a") + c("_b") * c("_b")) / (2 * sigma * sigma))
    heat = F.when(heat < 2.220446049250313e-16, 0.0).otherwise(heat) * k
    return disc.groupBy("frame_id", "name", "row", "col").agg(F.max(heat).alias("heat"))


def centre_targets(targets: DataFrame) -> DataFrame:
    """Regression values of each object at its cell."""
    return targets.select(
        "frame_id", "box_id", "ind", "off_u", "off_v", "z", F.log("dx").alias("ldx"), F.log("dy").alias("ldy"),
        F.log("dz").alias("ldz"), F.sin("yaw").alias("sin_yaw"), F.cos("yaw").alias("cos_yaw"), "vx", "vy")


def flatten_by_priority(scores: DataFrame, threshold: float, priority: Column) -> DataFrame:
    """One class per cell: the highest display priority among scores above the threshold."""
    return scores.where(c("score") > threshold).groupBy("frame_id", *CELL).agg(
        F.max_by("class_id", priority).alias("class_id"))


def lattice(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of a grid for each frame. Frames are dealt over a given number of tasks first: they are few bytes, and
    coalescing by bytes would have one task make the cells of thousands of frames."""
    def steps(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(tasks).withColumn("row", steps(rows)).withColumn("col", steps(cols))


def missing_region(frames: DataFrame, g: Grid, region: Sequence[float]) -> DataFrame:
    """Cells whose centre lies in the closed rectangle ``(x0, x1, y0, y1)``."""
    x, y = (c("row") + 0.5) * g.cell + g.x0, (c("col") + 0.5) * g.cell + g.y0
    return lattice(frames, g.rows, g.cols).where(x.between(region[0], region[1]) & y.between(region[2], region[3]))


def local_peaks(heat: DataFrame, radius: int, rows: int, cols: int, single: Sequence[int] = ()) -> DataFrame:
    """Cells that equal the largest value of their window. Border cells never count (their
    window does not fit); classes in ``single`` use a window of one cell. A cell of a class has one score.
    A cell is copied to the rows of its window only; along a row a range of columns is looked at, without an aggregate."""
    w = Window.partitionBy("frame_id", "class_id", "row").orderBy("col").rangeBetween(-radius, radius)
    seen = _down(heat.select("frame_id", "class_id", *CELL, "score"), radius).withColumn("_top", F.max("score").over(w))
    inner = c("row").between(radius, rows - 1 - radius) & c("col").between(radius, cols - 1 - radius)
    peak = (inner & (c("score") == c("_top"))) | c("class_id").isin(*single)
    return seen.where((c("_d") == 0) & c("score").isNotNull() & peak).drop("_top", "_d")


def lift_features(pixels: DataFrame, logits: str, context: str) -> DataFrame:
    """Softmax over the depth bins of a pixel times its context value, one row per bin."""
    top = F.array_max(logits)
    shifted = F.transform(c(logits), lambda v: F.exp(v - c("_top")))
    rows = pixels.withColumn("_top", top).withColumn("_e", shifted)
    rows = rows.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v))
    out = rows.select("frame_id", "v", "u", context, "_s", F.posexplode("_e").alias("bin", "_p"))
    return out.withColumn("value", c("_p") / c("_s") * c(context)).drop("_p", "_s")


def frustum_points(cameras: DataFrame, depth: tuple[float, float, float], image: tuple[int, int],
                   feature: tuple[int, int], fx: float, fy: float, cx: float, cy: float,
                   resize: float, crop: tuple[float, float]) -> DataFrame:
    """Lattice (depth, row, column) of every camera in ego coordinates: the image resize and
    crop are undone, pixels are scaled by depth and turned by the camera pose."""
    bins = math.ceil((depth[1] - depth[0]) / depth[2])
    (h, w), (fh, fw) = image, feature
    def steps(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = cameras.withColumn("d", steps(bins)).withColumn("r", steps(fh)).withColumn("q", steps(fw))
    dist = F.lit(depth[0]) + c("d") * depth[2]
    u = (c("q") * ((w - 1) / (fw - 1)) + crop[0]) / resize
    v = (c("r") * ((h - 1) / (fh - 1)) + crop[1]) / resize
    px, py = (u - cx) * dist / fx, (v - cy) * dist / fy
    # optical axes to a planar ego pose
    fwd, left = dist, -px
    return grid.withColumns({
        "x": fwd * F.cos("yaw") - left * F.sin("yaw") + c("tx"),
        "y": fwd * F.sin("yaw") + left * F.cos("yaw") + c("ty"), "z": -py})

