"""Scenes of many searches at once, by box, interval and cloud."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.raster import checkpointed, dealt

#: Sides of the squares that boxes are covered by, in degrees: a search takes the smallest that covers it with two
#: along each axis, and scenes are copied once for each side in use.
DEGREES = [16.0, 64.0, 512.0]
#: Scenes and searches of a square in one part; a square with more is dealt out.
PART = 100_000
#: Squares up to which the table of them, one row each, is broadcast.
BROADCAST_SQUARES = 10_000
#: Scenes that are met at once, as bits of words; searches that meet them at once.
BITS, AT_ONCE = 1024, 1024

def parse_interval(text: Column) -> tuple[Column, Column]:
    """Start and end of ``a/b`` or of one instant; ``..`` and an empty side are open, a day
    lasts until its last microsecond."""
    side = lambda n: F.nullif(F.nullif(F.trim(F.split_part(text, F.lit("/"), F.lit(n))), F.lit("..")), F.lit(""))
    first = side(1)
    last = F.when(F.contains(text, F.lit("/")), side(2)).otherwise(first)
    end = F.when(F.length(last) == 10, F.to_timestamp(last) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.to_timestamp(last))
    return F.to_timestamp(first), end


def _square(value: Column, size: Column) -> Column:
    return F.floor(value / size)


def _level(extent: Column, sizes: list, beyond: int) -> Column:
    out = F.lit(beyond)
    for k in range(len(sizes) - 1, -1, -1):
        out = F.when(extent <= sizes[k], k).otherwise(out)
    return out


def _together(scenes: DataFrame, searches: DataFrame) -> DataFrame:
    """Scenes and searches of each square that holds both, a part at a time, the scenes first."""
    over = F.col("west") > F.col("east")
    none = F.lit(None).cast("double").alias("before")
    halves = F.when(over, F.array(F.struct("west", F.lit(180.0).alias("east"), none), F.struct(F.lit(-180.0).alias("west"), "east", F.col("west").cast("double").alias("before")))).otherwise(F.array(F.struct("west", "east", none)))
    asked = searches.withColumn("_half", F.explode(halves)).withColumn("west", F.col("_half.west")).withColumn("east", F.col("_half.east")).withColumn("before", F.col("_half.before"))
    asked = asked.where("west <= east AND south <= north").withColumn("_size", _level(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")), DEGREES, len(DEGREES) - 1))
    box = [F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")]
    low, high = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("start", "end"))
    id_of = lambda t, c: F.lit(None).cast(t.schema[c].dataType).alias(c)
    asked = checkpointed(asked.select(
        "collection", "_size", F.lit(1).alias("_kind"), "search_id", id_of(scenes, "scene_id"), *box, F.coalesce(start, low).alias("t0"), F.coalesce(end, high).alias("t1"),
        (start.isNotNull() | end.isNotNull()).alias("timed"), F.col("max_cloud").cast("double").alias("cloud"), "before",
    ))  # else each later column carries all of these expressions
    used = sorted(r[0] for r in asked.select("_size").distinct().collect()) or [0]  # at most one for each side
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    there = scenes.where("west <= east AND south <= north").select(
        "collection", F.explode(F.array(*[F.lit(k) for k in used])).alias("_size"), F.lit(0).alias("_kind"), id_of(searches, "search_id"), "scene_id", *box, F.coalesce(ts, low).alias("t0"), F.lit(0).cast("long").alias("t1"),
        ts.isNotNull().alias("timed"), F.col("cloud_cover").cast("double").alias("cloud"), none,
    )

    def squares(table: DataFrame) -> DataFrame:
        side = F.array(*[F.lit(d) for d in DEGREES])[F.col("_size")]
        at = lambda c: _square(F.col(c), side)
        table = table.withColumn("_x", F.explode(F.sequence(at("west"), at("east")))).withColumn("_y", F.explode(F.sequence(at("south"), at("north"))))
        return table.withColumn("fx", F.col("_x") == at("west")).withColumn("fy", F.col("_y") == at("south"))

    on = ["collection", "_size", "_x", "_y"]
    asked, there = squares(asked), squares(there)
    n = there.groupBy(*on).agg(F.count("*").alias("n")).join(asked.groupBy(*on).agg(F.count("*").alias("q")), on)
    parts = lambda c: F.ceil(F.col(c) / PART).cast("int")
    groups = checkpointed(n.select(*on, F.monotonically_increasing_id().alias("_g"), parts("n").alias("_as"), parts("q").alias("_bs")))
    few = groups.count() <= BROADCAST_SQUARES

    def part(table: DataFrame, key: str, own: str, of: str, other: str, others: str) -> DataFrame:
        both = table.join(F.broadcast(groups), on) if few else dealt(table).join(groups, on)
        every = both.withColumn(own, F.pmod(F.xxhash64(key), F.col(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return every.select("_g", "_a", "_b", "_kind", "search_id", "scene_id", "west", "south", "east", "north", "t0", "t1", "timed", "cloud", "before", "fx", "fy")

    every = part(there, "scene_id", "_a", "_as", "_b", "_bs").unionByName(part(asked, "search_id", "_b", "_bs", "_a", "_as"))
    tasks = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(tasks, "_g", "_a", "_b").sortWithinPartitions("_g", "_a", "_b", "_kind")


def _smallest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in order, and for each k the set of the k smallest as bits."""
    order = np.argsort(values, kind="stable")
    sets = np.zeros((len(values) + 1, BITS // 64), np.uint64)
    sets[np.arange(1, len(values) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return values[order], np.bitwise_or.accumulate(sets, axis=0)


def _bits(flags: np.ndarray) -> np.ndarray:
    full = np.zeros(BITS, np.uint8)
    full[: len(flags)] = flags
    return np.packbits(full, bitorder="little").view(np.uint64)


class _Chunk:
    """At most BITS scenes of a part; what each search finds among them is an intersection of sets of bits."""

    def __init__(self, scenes: dict[str, np.ndarray]):
        self.first, self.last = scenes["t0"].min(), scenes["t0"].max()
        cloud = np.where(scenes["no_cloud"], 0.0, scenes["cloud"])
        self.sets = {c: _smallest(v) for c, v in [*((c, scenes[c]) for c in ("west", "south", "east", "north", "t0")), ("cloud", cloud)]}
        self.flags = {c: _bits(scenes[c]) for c in ("fx", "fy", "timed")}
        self.this_side = _bits(scenes["west"] <= 180.0)

    def at_most(self, c: str, x: np.ndarray) -> np.ndarray:
        values, sets = self.sets[c]
        return sets[np.searchsorted(values, x, "right")]

    def below(self, c: str, x: np.ndarray) -> np.ndarray:
        values, sets = self.sets[c]
        return sets[np.searchsorted(values, x, "left")]

    def found(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each search the scenes that it finds and those that are clear enough, as bits."""
        hits = self.at_most("west", s["east"]) & self.at_most("south", s["north"]) & self.at_most("t0", s["t1"])
        hits &= ~(self.below("east", s["west"]) | self.below("north", s["south"]) | self.below("t0", s["t0"]))
        hits[s["timed"]] &= self.flags["timed"]
        for c in ("fx", "fy"):  # a pair is taken in the first square that both have
            hits[~s[c]] &= self.flags[c]
        second = np.flatnonzero(~np.isnan(s["before"]))
        # a scene that meets the half west of the date line was found there
        hits[second] &= ~(self.this_side & ~self.below("east", s["before"][second]))
        return hits, np.where(s["no_cloud"][:, None], hits, hits & self.at_most("cloud", s["cloud"]))


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    names = ("west", "south", "east", "north", "t0", "t1", "timed", "cloud", "before", "fx", "fy")
    return {c: table[c].to_numpy() for c in names} | {"no_cloud": table["cloud"].is_null().to_numpy()}


def _met(batches: Iterator[pa.RecordBatch], told: Callable) -> Iterator[pa.RecordBatch]:
    """``told(scenes, searches)`` of each part; a part's scenes are held, its searches come in batches."""
    key, held, scenes = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)]) if batch.num_rows else np.empty((4, 0))
        edges = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1 if batch.num_rows else []
        for lo, hi in zip(np.r_[0, edges].astype(int), np.r_[edges, batch.num_rows].astype(int), strict=True):
            if lo == hi:
                continue
            if key != tuple(keys[:3, lo]):
                key, held, scenes = tuple(keys[:3, lo]), [], None
            if keys[3, lo] == 0:
                held.append(batch.slice(lo, hi - lo))
            elif held:
                if scenes is None:
                    scenes = pa.Table.from_batches(held).sort_by("t0")  # few chunks meet an interval
                yield from told(scenes, pa.Table.from_batches([batch.slice(lo, hi - lo)]))


def _each(scenes: pa.Table, searches: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first scene, searches, found, kept) for each chunk of scenes and the searches whose interval meets it."""
    there, asked = _columns(scenes), _columns(searches)
    for lo in range(0, scenes.num_rows, BITS):
        chunk = _Chunk({c: v[lo : lo + BITS] for c, v in there.items()})
        meet = np.flatnonzero((asked["t0"] <= chunk.last) & (chunk.first <= asked["t1"]))
        for k in range(0, len(meet), AT_ONCE):
            some = meet[k : k + AT_ONCE]
            yield lo, some, *chunk.found({c: v[some] for c, v in asked.items()})


def matches(scenes: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, scene_id, cloud_cover, kept), one row for each scene of a search's
    collection whose box meets the search's and whose time lies in its interval.

    ``scenes(scene_id, collection, west, south, east, north, ts, cloud_cover)`` against
    ``searches(search_id, collection, west, south, east, north, start, end, max_cloud)``.
    Boxes are closed; a search with west > east goes over the date line.  A null start
    or end is open, a null max_cloud keeps all; a scene without a cloud value counts as
    clear, one without a time is found by searches without an interval only.  Searches
    and scenes with a null side of the box find nothing.  ``kept`` says whether the
    scene is clear enough, so that both counts come from one pass.

    Both go to the squares that they lie in, scenes once for each side in use; a pair meets
    in several squares and is taken in the first of those that both have.  In a square,
    scenes are bits: a search meets 64 of them in a word.  Pairs are never shuffled, and
    at most BITS x AT_ONCE of them are held at once.
    """

    def told(there: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        for lo, some, found, kept in _each(there, asked):
            bits, clear = (np.unpackbits(x.view(np.uint8), axis=1, bitorder="little") for x in (found, kept))
            search, scene = np.nonzero(bits)
            if len(search):
                at = pa.array(lo + scene)
                columns = [asked["search_id"].take(pa.array(some[search])), there["scene_id"].take(at), there["cloud"].take(at), pa.array(clear[search, scene].astype(bool))]
                yield from pa.table(columns, names=["search_id", "scene_id", "cloud_cover", "kept"]).to_batches()

    # written once, as each reader of the pairs would deal both tables anew
    every = checkpointed(_together(scenes, searches))
    schema = every.select("search_id", "scene_id", F.col("cloud").alias("cloud_cover"), F.lit(True).alias("kept")).schema
    found = every.mapInArrow(lambda batches: _met(batches, told), schema)
    return found.withColumn("cloud_cover", F.col("cloud_cover").cast(scenes.schema["cloud_cover"].dataType))


def tallies(scenes: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, n_found, n_kept) of every search, as :func:`counts` of :func:`matches`
    would tell, without a row for each pair: bits are counted."""

    def told(there: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, asked.num_rows), np.int64)
        for _, some, *sets in _each(there, asked):
            for k in (0, 1):
                n[k, some] += np.bitwise_count(sets[k]).sum(axis=1, dtype=np.int64)
        yield from pa.table([asked["search_id"], pa.array(n[0]), pa.array(n[1])], names=["search_id", "n_found", "n_kept"]).to_batches()

    every = _together(scenes, searches)
    schema = every.select("search_id", F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_kept")).schema
    n = every.mapInArrow(lambda batches: _met(batches, told), schema).groupBy("search_id").agg(F.sum("n_found").alias("n_found"), F.sum("n_kept").alias("n_kept"))
    return searches.select("search_id").join(n, "search_id", "left").fillna(0, ["n_found", "n_kept"])


def counts(searches: DataFrame, found: DataFrame) -> DataFrame:
    """(search_id, n_found, n_kept) of every search, also of those that find nothing."""
    n = found.groupBy("search_id").agg(F.count("*").alias("n_found"), F.count_if("kept").alias("n_kept"))
    return searches.select("search_id").join(n, "search_id", "left").fillna(0, ["n_found", "n_kept"])
