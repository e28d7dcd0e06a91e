"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a random key from a hash. Within each source, documents are ranged by that
key, sizes are summed in key order (first over ranges, then inside each range), and the source is
cut at its exact budget. A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import free_name

WORD = r"[^\x20\x09-\x0D]+"
# Documents that one window partition of the prefix sum sorts.
RANGE_ROWS = 8_192


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _random_key(seed: str) -> Column:
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed), doc_id, F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def source_targets(
    sources: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0
) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, n_docs), one for each source.

    Sources in code point order, NULL last, take the weights in turn. They share ``share`` of all
    sizes by weight; none gets more than ``max_epochs`` times its size, and what it can't take is
    shared by the others. With sources in order of the share at which they fill up, the level
    at which the shares add up to the total follows from two running sums. The table has a row
    for each source, which is all that meets in one task.
    """
    in_order, all_rows = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    filling = Window.orderBy("full_at", F.asc_nulls_last("source"))
    turn = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), turn.cast("int"))
    table = sources.withColumn("weight", weight.cast("long")).withColumn(
        "most", F.col("source_size") * max_epochs
    )
    table = table.withColumn("full_at", F.col("most") / F.col("weight"))
    full = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(all_rows)
    total = total if share == 1.0 else total * share
    table = table.withColumn("level", (total - full) / left)
    # Levels above their own filling point belong to sources that fill up.
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level")))
    table = table.withColumn("level", level.over(all_rows)["level"])
    most = F.col("most").cast("double")
    target = F.coalesce(F.least(most, F.col("level") * F.col("weight")), most)
    return table.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: str = "",
) -> DataFrame:
    """Per document: doc_id, source, key, size, source_size, target and ``taken``.

    ``docs`` needs doc_id, text and source; other columns are ignored. ``taken`` is the number of
    words the mix takes from the document, repeats counted: size times the whole epochs of
    its source, plus what the last epoch takes before the cut; one document of a source may be
    taken in part. The key is a hash of ``seed``, doc_id and text, so reruns agree, and only rows
    equal in all three can swap places. A NULL text has size 0, a NULL source is a source of its
    own, sorted last. An empty table gives an empty table.
    """
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), _random_key(seed).alias("key")
    )
    # Rows that are equal in all of these are one entry, however many they are.
    entries = sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    entries = materialise(entries, "mix-sizes")
    whole = F.col("size") * F.col("rows")
    sources = entries.groupBy("source").agg(
        F.sum(whole).alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    targets = materialise(source_targets(sources, weights, max_epochs, share), "mix-targets")
    targets = targets.withColumnRenamed("source", "of")
    epochs = F.coalesce(
        F.floor(F.floor("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)
    )
    # Hash-random keys cut a source into ranges of about equal numbers of documents.
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(2**32)
    placed = (
        entries.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epochs", epochs)
        .withColumn("range", F.floor(unit * F.ceil(F.col("n_docs") / RANGE_ROWS)))
        .drop("of", "n_docs")
    )
    by_range = placed.groupBy("source", "range").agg(F.sum(whole).alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select(
        F.col("source").alias("of"),
        F.col("range").alias("of_range"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("before_range"),
    )
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range"))
    inside = (
        Window.partitionBy("source", "range")
        .orderBy("key", "size", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("before_range") + F.coalesce(F.sum(whole).over(inside), F.lit(0))
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    cut = placed.join(by_range, same).withColumn("left", rest - before)
    # Equal rows take what is left one after the other; which of them does not matter.
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return _each_row(cut).select(
        "doc_id",
        "source",
        "key",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
    )


def _each_row(entries: DataFrame) -> DataFrame:
    """A row for each of the ``rows`` of an entry, with their number ``copy`` from 0.

    Entries of very many rows are first dealt to tasks in runs of ``RANGE_ROWS``.
    """
    many = F.col("rows") > RANGE_ROWS
    few = entries.filter(~many).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RANGE_ROWS).cast("long")))
    runs = entries.filter(many).withColumn("first", first).repartition("key", "first")
    end = F.least(F.col("first") + RANGE_ROWS, F.col("rows")) - 1
    return few.unionByName(runs.withColumn("copy", F.explode(F.sequence("first", end))).drop("first"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, not at all if not taken.

    A document taken in part appears whole in its last epoch. Columns are those of ``docs``, which
    needs doc_id, text and source. Rows equal in all three share their copies, rounded up.
    """
    names = [free_name(docs.columns, n) for n in ("__source", "__key", "__copies", "__copy")]
    copies = F.ceil(F.sum(F.ceil(F.col("taken") / F.col("size"))) / F.count(F.lit(1)))
    plan = (
        mix_sources(docs, **options)
        .filter(F.col("taken") > 0)
        .groupBy(F.col("source").alias(names[0]), F.col("key").alias(names[1]))
        .agg(copies.cast("int").alias(names[2]))
    )
    key = _random_key(options.get("seed", ""))
    same = F.col("source").eqNullSafe(F.col(names[0])) & (key == F.col(names[1]))
    taken = docs.join(plan, same).withColumn(names[3], F.explode(F.sequence(F.lit(1), names[2])))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))
