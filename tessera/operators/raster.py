"""Neighbourhoods, masks, components and resampling of cell tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.grid import Grid


def neighbourhood_mean(cells: DataFrame, keys: list[str], value: str, height: int, width: int, size: int = 5) -> DataFrame:
    """Mean over a size x size square that ignores missing values; cells beyond the
    edge repeat the edge.  ``cells`` holds every cell, missing values as null.
    ``{value}_near_n`` counts the values, repeated ones as often as they stand there.

    Separable: sums along rows, then along columns, each partitioned by its line.
    """
    k = size // 2

    def along(table: DataFrame, line: str, at: str, total: Column, count: Column, last: int) -> tuple[Column, Column]:
        w = Window.partitionBy(*keys, line).orderBy(at)
        frame = w.rowsBetween(-k, k)
        whole = Window.partitionBy(*keys, line).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = F.greatest(k - F.col(at), F.lit(0)), F.greatest(F.col(at) + k - last, F.lit(0))

        def padded(c: Column) -> Column:
            return F.sum(c).over(frame) + low * F.first(c).over(whole) + high * F.last(c).over(whole)

        return padded(total), padded(count)

    start = cells.withColumn("_s", F.coalesce(F.col(value).cast("double"), F.lit(0.0))).withColumn("_n", F.col(value).isNotNull().cast("double"))
    s, n = along(start, "row", "col", F.col("_s"), F.col("_n"), width - 1)
    rows = start.withColumn("_rs", s).withColumn("_rn", n)
    s, n = along(rows, "col", "row", F.col("_rs"), F.col("_rn"), height - 1)
    return rows.withColumn("_cs", s).withColumn("_cn", n).withColumn(f"{value}_near", F.when(F.col("_cn") > 0, F.col("_cs") / F.col("_cn"))).withColumnRenamed("_cn", f"{value}_near_n").drop("_s", "_n", "_rs", "_rn", "_cs")


def dilation_ring(mask: DataFrame, keys: list[str], steps: int, height: int, width: int) -> DataFrame:
    """Cells within ``steps`` 4-neighbour steps of the mask and outside it.

    Only cells at the mask's boundary send offsets, as many as the ball has."""
    cell = [*keys, "row", "col"]
    sides = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    around = mask.select(*cell, F.explode(sides).alias("d")).select(*keys, "row", "col", (F.col("row") + F.col("d.dr")).alias("nr"), (F.col("col") + F.col("d.dc")).alias("nc"))
    other = dealt(mask.select(*keys, F.col("row").alias("nr"), F.col("col").alias("nc")))
    edge = around.join(other, [*keys, "nr", "nc"], "left_anti").select(*cell).distinct()
    ball = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if 0 < abs(r) + abs(c) <= steps])
    grown = edge.select(*cell, F.explode(ball).alias("d")).select(*keys, (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col")).distinct()
    return grown.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).join(dealt(mask), cell, "left_anti")


def distances(mask: DataFrame, keys: list[str], reach: int, height: int, width: int) -> DataFrame:
    """(keys, row, col, distance) of every cell within ``reach`` 4-neighbour steps of the
    mask, masked cells with 0: exact, and one table for the rings of all radii.

    Min-plus along rows, then along columns.  In a row each column belongs to its
    nearest masked cell.  In a column, running minima of distance less row (from above)
    and distance plus row (from below) decide between the rows that have one.  A cell is made
    once in each pass, whatever the reach, and a line has no more cells than the grid is wide or high.
    """
    in_row = Window.partitionBy(*keys, "row").orderBy("col")
    before, after = F.lag("col").over(in_row), F.lead("col").over(in_row)
    low = F.greatest(F.lit(0), F.col("col") - reach, F.coalesce(F.floor((F.col("_b") + F.col("col")) / 2) + 1, F.lit(0)))
    high = F.least(F.lit(width - 1), F.col("col") + reach, F.coalesce(F.floor((F.col("col") + F.col("_a")) / 2), F.lit(width - 1)))
    owned = mask.select(*keys, "row", "col").distinct().withColumn("_b", before).withColumn("_a", after)
    along = owned.select(*keys, "row", F.col("col").alias("_m"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("col")).withColumn("_h", F.abs(F.col("col") - F.col("_m")))
    down = Window.partitionBy(*keys, "col").orderBy("row")
    up = Window.partitionBy(*keys, "col").orderBy(F.desc("row"))
    from_above = F.min(F.col("_h") - F.col("row")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    from_below = F.min(F.col("_h") + F.col("row")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    lines = along.withColumn("_f", from_above).withColumn("_g", from_below)
    lines = lines.withColumn("_next", F.lead("row").over(down)).withColumn("_below", F.lead("_g").over(down)).withColumn("_top", F.lag("row").over(down).isNull())
    # rows from this one to the next that has a distance, as far as either of both reaches
    last = F.coalesce(F.col("_next") - 1, F.lit(height - 1))
    reached = F.least(last, F.lit(reach) - F.col("_f"))
    again = F.greatest(F.col("row"), F.col("_below") - reach)
    empty = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(a <= b, F.sequence(a.cast("long"), b.cast("long"))).otherwise(empty)
    second = F.when(F.col("_below").isNotNull(), span(F.greatest(again, reached + 1, F.col("row")), last)).otherwise(empty)
    first = F.when(F.col("_top"), span(F.greatest(F.lit(0), F.col("_g") - reach), F.col("row") - 1)).otherwise(empty)
    here = lines.select(*keys, "col", "_f", "_g", "_below", F.col("row").alias("_r"), F.explode(F.concat(first, span(F.col("row"), reached), second)).alias("row"))
    nearest = F.when(F.col("row") < F.col("_r"), F.col("_g") - F.col("row")).otherwise(F.least(F.col("_f") + F.col("row"), F.col("_below") - F.col("row")))
    return here.select(*keys, "row", "col", nearest.cast("int").alias("distance")).where(F.col("distance") <= reach)


def polygon_cells(rings: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Cells whose centre is inside polygons; see :func:`polygon_spans`."""
    return polygon_spans(rings, keys, grid).select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def polygon_spans(rings: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Runs (row, c0, c1) of cells whose centre is inside polygons, from ``rings(keys, points array<struct<x, y>>)``.

    Holes are further rings.  An edge covers the rows whose centre it crosses, half
    open in y, so a vertex counts once; sorted crossings of a row pair up.
    """
    pts = F.col("points")
    closed = F.when(pts[0] == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.array(pts[0])))
    edges = rings.where(F.size("points") >= 3).withColumn("p", closed).select(
        *keys, F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.col("p")[i].alias("a"), F.col("p")[i + 1].alias("b")))).alias("e")
    )
    x0, y0, x1, y1 = F.col("e.a.x"), F.col("e.a.y"), F.col("e.b.x"), F.col("e.b.y")
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    # centre of row r: top - (r + 0.5) res, inside [low, high)
    first = F.greatest(F.floor((grid.top - high) / grid.res - 0.5) + 1, F.lit(0))
    last = F.least(F.floor((grid.top - low) / grid.res - 0.5), F.lit(grid.height - 1))
    rows = edges.withColumn("r0", first).withColumn("r1", last).where("r0 <= r1").select(*keys, "e", F.explode(F.sequence("r0", "r1")).alias("row"))
    y = grid.y(F.col("row"))
    crossing = x0 + F.try_divide((y - y0) * (x1 - x0), y1 - y0)
    at = rows.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(crossing)).alias("xs"))
    pairs = at.select(*keys, "row", F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.col("xs")[i * 2].alias("a"), F.col("xs")[i * 2 + 1].alias("b")))).alias("s"))
    c0 = F.greatest(F.ceil((F.col("s.a") - grid.left) / grid.res - 0.5), F.lit(0))
    c1 = F.least(F.ceil((F.col("s.b") - grid.left) / grid.res - 0.5) - 1, F.lit(grid.width - 1))
    return pairs.withColumn("c0", c0).withColumn("c1", c1).where("c0 <= c1").select(*keys, "row", "c0", "c1")


def block_labels(group: np.ndarray, row: np.ndarray, col: np.ndarray, block: int) -> np.ndarray:
    """For each cell of the numbered blocks the smallest (row, col) code of its patch inside its block."""
    wide = block + 1  # a free row and column between blocks
    cells, first, where = np.unique((group * wide + row % block) * wide + col % block, return_index=True, return_inverse=True)
    pairs = []
    for step in (1, wide - 1, wide, wide + 1):
        to = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        one = np.flatnonzero(cells[to] == cells + step)
        pairs.append((one, to[one]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = np.arange(len(cells))  # cells of a block are in row-major order
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return (row[first].astype(np.int64) * (1 << 31) + col[first])[label][where]


def components(mask: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """``mask`` with ``component``, the smallest (row, col) code of its 8-connected patch.

    Blocks are labelled inside tasks, all that a batch holds at once, and their labels are
    checkpointed; labels that touch across block edges form a small graph, whose labels
    shrink to the smallest in rounds.  Each round is checkpointed, too.
    """
    schema = mask.select(*keys, "row", "col", F.lit(0).cast("long").alias("label")).schema
    of = [*keys, "_br", "_bc"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            return pdf.assign(label=block_labels(group, pdf["row"].to_numpy(), pdf["col"].to_numpy(), block))[[*keys, "row", "col", "label"]]

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            group = held.groupby(of, sort=False, dropna=False).ngroup().to_numpy()
            last = int(np.searchsorted(group == group[-1], True))  # rows are sorted: the last block may go on
            if last:
                yield told(held[:last], group[:last])
                held = held[last:]
        if held is not None:
            yield told(held, np.zeros(len(held), np.int64))

    blocks = mask.select(*keys, "row", "col", F.floor(F.col("row") / block).alias("_br"), F.floor(F.col("col") / block).alias("_bc"))
    labelled = checkpointed(blocks.repartition(*of).sortWithinPartitions(*of).mapInPandas(label, schema))
    edge_cells = labelled.where((F.pmod("row", F.lit(block)).isin(0, block - 1)) | (F.pmod("col", F.lit(block)).isin(0, block - 1)))
    near = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)])
    sent = edge_cells.select(*keys, F.explode(near).alias("d"), "row", "col", F.col("label").alias("a")).select(*keys, (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"), "a")
    links = sent.join(edge_cells.withColumnRenamed("label", "b"), [*keys, "row", "col"]).where("a <> b").select(*keys, "a", "b").distinct()
    current = checkpointed(links.select(*keys, F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    links = checkpointed(links)
    while True:
        told = links.join(current.select(*keys, F.col("node").alias("a"), F.col("root").alias("r")), [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(F.min("r").alias("r"))
        step = current.join(told, [*keys, "node"], "left").select(*keys, "node", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("old"))
        jump = step.select(*keys, F.col("node").alias("root"), F.col("root").alias("higher"))
        new = checkpointed(step.join(jump, [*keys, "root"], "left").select(*keys, "node", F.least("root", F.coalesce("higher", "root")).alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        current = new.drop("old")
        if not changed:
            break
    return labelled.join(current.withColumnRenamed("node", "label"), [*keys, "label"], "left").select(*keys, "row", "col", F.coalesce("root", "label").alias("component"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names, or on one machine a temporary one
    where it names none; a cluster without one is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"tessera-{uuid.uuid4().hex[:6]}"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that goes to its keys by a shuffle.  Its estimated size is that of the
    rows before they were exploded, so Spark would send it whole through the driver."""
    return side.hint("merge")


def resample_nearest(source: DataFrame, targets: DataFrame, value: str, factor: float, shift_row: float = 0.0, shift_col: float = 0.0) -> DataFrame:
    """The source cell under each target's centre; a target is ``factor`` source cells wide."""
    at = lambda c, s: F.floor((F.col(c) + 0.5) * factor + s)
    want = targets.withColumn("sr", at("row", shift_row)).withColumn("sc", at("col", shift_col))
    src = source.select("tile_id", F.col("row").alias("sr"), F.col("col").alias("sc"), value)
    return want.join(src, ["tile_id", "sr", "sc"], "left").drop("sr", "sc")


def resample_bilinear(source: DataFrame, targets: DataFrame, value: str, factor: float, shift_row: float = 0.0, shift_col: float = 0.0) -> DataFrame:
    """Weighted mean of the four source centres around each target's centre, over those that have a value."""
    y, x = (F.col("row") + 0.5) * factor + shift_row - 0.5, (F.col("col") + 0.5) * factor + shift_col - 0.5
    want = targets.withColumn("y", y).withColumn("x", x).withColumn("y0", F.floor("y")).withColumn("x0", F.floor("x"))
    fy, fx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    four = F.array(*[F.struct((F.col("y0") + i).alias("sr"), (F.col("x0") + j).alias("sc"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    each = want.select("tile_id", "row", "col", F.explode(four).alias("n")).select("tile_id", "row", "col", "n.sr", "n.sc", "n.w").where("w > 0")
    src = source.select("tile_id", F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    got = each.join(src, ["tile_id", "sr", "sc"]).groupBy("tile_id", "row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))
    return targets.join(got, ["tile_id", "row", "col"], "left")


def resample_sum(source: DataFrame, value: str, factor: float, shift_row: float = 0.0, shift_col: float = 0.0) -> DataFrame:
    """Totals moved to coarser cells by overlap area, so that sums are conserved."""
    def parts(c: str, shift: float) -> Column:
        lo, hi = (F.col(c) - shift) / factor, (F.col(c) + 1 - shift) / factor
        first, last = F.floor(lo), F.ceil(hi) - 1
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("t"), ((F.least(hi, t + 1.0) - F.greatest(lo, t.cast("double"))) / (hi - lo)).alias("w")))

    split = source.where(F.col(value).isNotNull()).select("tile_id", "col", value, F.explode(parts("row", shift_row)).alias("r")).select("tile_id", value, "r", F.explode(parts("col", shift_col)).alias("c"))
    return split.groupBy("tile_id", F.col("r.t").alias("row"), F.col("c.t").alias("col")).agg(F.sum(F.col(value) * F.col("r.w") * F.col("c.w")).alias(value))


def pack_blocks(cells: DataFrame, keys: list[str], value: str, block: int = 128) -> DataFrame:
    """float32 row-major blocks in base64 with their range and coverage, for export.
    A block has at most block x block cells, whatever the tile's size."""
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    grouped = cells.groupBy(*keys, br.alias("block_row"), bc.alias("block_col")).agg(
        F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).cast("float").alias("v")))).alias("cells"), F.min(value).cast("double").alias("vmin"), F.max(value).cast("double").alias("vmax"), (F.count(value) / F.count("*")).alias("valid_fraction")
    )

    @F.pandas_udf("binary")
    def to_bytes(v: pd.Series) -> pd.Series:
        return v.map(lambda a: np.array([np.nan if x is None else x for x in a], "<f4").tobytes())

    return grouped.select(*keys, "block_row", "block_col", F.size("cells").alias("n_cells"), "vmin", "vmax", "valid_fraction", F.base64(to_bytes(F.transform("cells", lambda c: c["v"]))).alias("data"))


def unpack_blocks(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Values of packed blocks again, in the blocks' row-major order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(b.as_py(), "<f4") for b in batch.column(batch.num_columns - 1)]
            flat = np.concatenate([np.empty(0, "<f4"), *values]).astype(np.float32)
            offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "values"])

    cols = [*keys, "block_row", "block_col"]
    schema = packed.select(*cols, F.array(F.lit(None).cast("float")).alias("values")).schema
    lists = packed.select(*cols, F.unbase64("data").alias("raw")).mapInArrow(run, schema)
    return lists.select(*cols, F.posexplode("values").alias("position", "value"))
