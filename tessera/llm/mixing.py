"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Characters of a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) from ``sizes(source, source_size)``.

    Sources in code point order, null last, get ``weights`` in turn and share
    ``share`` of all sizes by weight.  No target is above ``most`` times its
    source's size; the excess goes to the others by weight until none is above.
    In closed form: sorted by most * size / weight, the sources that stop at their
    limit come first, and the others get one common amount per unit of weight.
    An all-empty corpus has targets of zero.  The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    nth = F.array(*[F.lit(int(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    ranked = (
        sizes.withColumn("weight", nth)
        .withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    left = F.col("all_size") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / heavy).withColumn("fits", F.col("level") <= F.col("ratio"))
    common = F.min(F.when(F.col("fits"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))
    return level.select("source", "source_size", "weight", target.cast("double").alias("target"))


#: Ranges of ranks in which running sums are first taken, at least, and the documents in one, about.
RANGES, IN_RANGE = 4096, 10_000
#: Sources up to which the plan, one row per source, is broadcast.
BROADCAST_SOURCES = 10_000


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of the document's id."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"))), 1, 12), 16, 10)
    return (word.cast("double") + 0.5) / float(2**48)


def pareto_rank(u: Column, p: Column, size: Column, mean: Column) -> Column:
    """The random odds of a document over its inclusion odds, null where it has none.

    A document of average size has the source's inclusion probability ``p``; the odds
    of others grow with the root of their size, so that a sample of a given number of
    words holds fewer fragments of pages.
    """
    return F.try_divide(F.try_divide(u, 1 - u), F.try_divide(p, 1 - p) * F.sqrt(F.try_divide(size, mean)))


def cuts(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source of ``rows(source, size, u)``: source_size, target, the
    certain copies of each document, the inclusion probability of one more for a
    document of average size, that size, and the rank at which the Pareto order is cut.

    Documents with words are taken in rank order until the words left after the
    certain copies are met to within half a document: a sample of fixed size in words.
    Sums are taken over ranges of ranks first and then inside the one range that holds
    the cut, so a source with a third of all rows is spread like any other.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("documents"))
    plan = targets(sums.select("source", "source_size"), weights, share, most)
    sure = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    counted = sums.select(F.col("source").alias("of2"), "documents")
    plan = stored(
        plan.join(counted, F.col("source").eqNullSafe(F.col("of2"))).select(
            F.col("source").alias("of"), "source_size", "target", "documents", sure.alias("sure"), (F.col("target") - sure * F.col("source_size")).alias("rest")
        ).withColumn("p", F.try_divide("rest", "source_size")).withColumn("mean", F.try_divide("source_size", "documents")),
        "plan",
    )
    documents, sources = plan.agg(F.sum("documents"), F.count(F.lit(1))).first()
    ranges = max(RANGES, (documents or 0) // IN_RANGE)
    open_plan = plan.where("rest > 0").select("of", "rest", "p", "mean")
    ranked = _with(rows.where("size > 0"), open_plan, F.col("source")).select("of", "rest", "size", pareto_rank(F.col("u"), F.col("p"), F.col("size"), F.col("mean")).alias("rank"))
    ranked = ranked.withColumn("range", F.floor(F.col("rank") / (1 + F.col("rank")) * ranges).cast("int"))
    up = Window.partitionBy("of").orderBy("range")
    edge = (
        ranked.groupBy("of", "rest", "range").agg(F.sum("size").alias("in_range"))
        .withColumn("upto", F.sum("in_range").over(up))
        .where("upto >= rest").groupBy("of")
        .agg(F.min(F.struct("range", (F.col("rest") - F.col("upto") + F.col("in_range")).alias("room"))).alias("edge"))
        .select(F.col("of").alias("edge_of"), F.col("edge.range").alias("edge"), F.col("edge.room").alias("room"))
    )
    # a row per source at most: estimates of both sides would send all documents through the driver instead
    edge = F.broadcast(edge) if sources <= BROADCAST_SOURCES else edge.hint("merge")
    near = ranked.join(edge, F.col("of").eqNullSafe(F.col("edge_of")) & (F.col("range") == F.col("edge"))).groupBy("of", "rank", "room").agg(F.sum("size").alias("size"))
    inside = F.sum("size").over(Window.partitionBy("of").orderBy("rank"))
    last = near.withColumn("mid", inside - F.col("size") / 2).where("mid <= room").groupBy("of").agg(F.max("rank").alias("last")).withColumnRenamed("of", "last_of")
    below = F.col("edge") / float(ranges)  # no document of the range fits: all ranks before it
    cut = edge.join(last, F.col("edge_of").eqNullSafe(F.col("last_of")), "left").select("edge_of", F.coalesce("last", below / (1 - below)).alias("cut"), F.col("last").isNotNull().alias("reached"))
    return plan.join(cut, F.col("of").eqNullSafe(F.col("edge_of")), "left").select("of", "source_size", "target", "sure", "p", "mean", "cut", "reached")


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), uniform(F.col(f"`{id_col}`"), seed).alias("u")
    )


def _with(rows: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(side, source.eqNullSafe(F.col("of")))


def _apply(rows: DataFrame, plan: DataFrame, source: Column, u: Column, size: Column) -> DataFrame:
    rank = pareto_rank(u, F.col("p"), size, F.col("mean"))
    once_more = F.when(F.col("reached"), rank <= F.col("cut")).otherwise(rank < F.col("cut"))
    copies = F.when(size == 0, 0).otherwise(F.col("sure") + F.when(once_more, 1).otherwise(0)).cast("int")
    return _with(rows, plan, source).withColumn("_copies", copies)


def mix_sizes(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; texts are read once.

    Null texts have size zero, documents of size zero are never taken, and rows
    with one doc_id draw the same random number.  Other columns are not looked at.
    An empty table gives an empty table.
    """
    rows = stored(sized(docs, seed, id_col, text_col, source_col), "sizes")
    plan = stored(cuts(rows, weights, share, most), "mix")
    out = _apply(rows, plan, F.col("source"), F.col("u"), F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).cast("long").alias("taken"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Columns and their names stay as they are.  The texts are not shuffled: the
    plan, one row per source, goes to them.
    """
    rows = stored(sized(docs, seed, id_col, text_col, source_col), "sizes")
    plan = stored(cuts(rows, weights, share, most), "mix")
    out = _apply(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")),
        plan, F.col(f"_row.`{source_col}`"), uniform(F.col(f"_row.`{id_col}`"), seed), word_count(F.col(f"_row.`{text_col}`")),
    )
    copied = out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth"))
    return copied.select("_row.*")
