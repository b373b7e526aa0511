"""How filters of a corpus act on each other, in every order in which they may be applied.

Rows are counted by part and by which filters they fail, which leaves 2^k rows for each part at most. A CUBE over the k flags and the part then gives each subset of filters a grouping set,
whose row with all selected flags false has that subset's survivors. A step of an order removes what survives the filters before it and not those with it, so each step is a
join of two subsets of one part; the orders are k! lists of the k filters, made from their names.

Parts with no survivor of some subset have zeros there. A flag or a measure that is null counts as false, a null part as the empty string. Rows that repeat count again.
Of labels that repeat a doc_id, one that says so is enough. A null doc_id has no label and no smaller doc_id, and is smaller than none. Texts are identical if their SHA-256 is. Null texts
are empty; an empty text fails A alone, or E too if a smaller doc_id has it. An empty table gives an empty result. Columns but those named are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import SPACE_CLASS, saved, spread_join

#: Most filters: orders grow as their factorial.
MOST = 7


def subset_survivors(rows: DataFrame, filters: list[str], part: str = "part", measures: tuple[str, ...] = ()) -> DataFrame:
    """(part, mask, kept, and for each measure the survivors that have it) for each part and each subset of filters, as a mask with bit i for filter i. rows: a boolean for each filter (fails it) and each measure."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    flags = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *(yes(f).alias(f"f{i}") for i, f in enumerate(filters)), *(yes(m).cast("long").alias(f"m{i}") for i, m in enumerate(measures)))
    names = [f"f{i}" for i in range(len(filters))]
    counted = flags.groupBy("part", *names).agg(F.count(F.lit(1)).alias("kept"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(measures))))
    cube = counted.cube(*names, "part").agg(F.sum("kept").alias("kept"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(measures))), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"all_{f}") for f in names))
    passed = reduce(Column.__and__, ((F.col(f"all_{f}") == 1) | ~F.col(f) for f in names), F.col("all_parts") == 0)
    mask = reduce(add, ((1 - F.col(f"all_{f}").cast("int")) * (1 << i) for i, f in enumerate(names)))
    some = cube.where(passed).select("part", mask.alias("mask"), "kept", *(F.col(f"m{i}").alias(m) for i, m in enumerate(measures)))
    every = flags.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return saved(every.join(some, ["part", "mask"], "left").select("part", "mask", *map(zero, ("kept", *measures))), "filter-survivors")


def orders(filters: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter's place, mask before the step, mask after it) of every order of the filters."""
    out = []
    for order in permutations(range(len(filters))):
        mask = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(filters[x] for x in order), step, i, mask, mask | 1 << i))
            mask |= 1 << i
    return out


def filter_interactions(rows: DataFrame, filters: list[str], part: str = "part", measures: tuple[str, ...] = ()) -> DataFrame:
    """Per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, for each measure its rows lost here, and shapley."""
    if not 0 < len(filters) <= MOST:
        raise ValueError(f"1 to {MOST} filters, as every order of them is a row")
    sets = subset_survivors(rows, filters, part, measures)
    spark, every = rows.sparkSession, (1 << len(filters)) - 1
    steps = spark.createDataFrame([(*o, 1 << o[2], every ^ 1 << o[2]) for o in orders(filters)], "filter_order string, step int, filter int, before int, after int, alone int, others int")
    of = lambda mask, *cols: sets.select("part", F.col("mask").alias(mask), *(F.col(c).alias(f"{mask}_{c}") for c in cols))
    whole = sets.where(F.col("mask").isin(0, every)).groupBy("part").agg(F.max(F.when(F.col("mask") == 0, F.col("kept"))).alias("rows"), F.max(F.when(F.col("mask") == every, F.col("kept"))).alias("all_kept"))
    met = of("before", "kept", *measures).join(F.broadcast(steps), "before")
    for mask, cols in (("after", ("kept", *measures)), ("alone", ("kept",)), ("others", ("kept",))):
        met = met.join(of(mask, *cols), ["part", mask])
    met = met.join(whole, "part").withColumn("removed", F.col("before_kept") - F.col("after_kept"))
    return met.select(
        "part", "filter_order", "step", F.col("after_kept").alias("kept"), "removed", (F.col("rows") - F.col("alone_kept") - F.col("removed")).alias("redundant"), (F.col("others_kept") - F.col("all_kept")).alias("unique_fails"),
        *((F.col(f"before_{m}") - F.col(f"after_{m}")).alias(f"{m}_lost") for m in measures), F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document: doc_id, part, which of the filters A to E it fails, and whether it is labelled good or toxic. A: under 100 words; B: fewer than 80 % distinct words; C: over 10 % capitals; D: holds any of #$%&*|; E: identical to the text of a smaller doc_id."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE_CLASS + "+"), ""))
    rows = rows.select(
        "doc_id", "part", (F.size("words") < 100).alias("A"), (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 10 * F.length("text").cast("long")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = saved(rows, "filter-flags")
    copies = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "filter-copies")
    rows = spread_join(rows, copies, "digest", "n", rows.count(), "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    told = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(told, "doc_id", "left").select("doc_id", "part", *"ABCDE", *(F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E over documents, in their 120 orders, by language."""
    return filter_interactions(document_failures(docs, labels), list("ABCDE"), "part", ("good", "toxic"))
