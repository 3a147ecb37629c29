"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import running
from tidemark.session import cut

DOCUMENTS_PER_BLOCK = 50_000


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: (source, target_share, max_repeats, available, goal, capacity, expected).

    sizes (doc_id, source, size); the mixture is as large as all documents of the targets' sources. expected is the number of
    copies of each document: goal / available, max_repeats at most; documents counts those of size above 0. A source without
    documents has 0 tokens. targets is a configuration table, one row per source.
    """
    have = sizes.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.when(F.col("size") > 0, 1)).alias("documents"))
    t = targets.where("source is not null").join(have, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("available", "documents")})
    t = t.withColumn("goal", F.col("target_share") * F.sum("available").over(Window.partitionBy(F.lit(0))))
    most = F.col("max_repeats").cast("double")
    rate = F.least(most, F.coalesce(F.try_divide("goal", F.col("available").cast("double")), most))
    return t.select("source", "target_share", "max_repeats", "available", "documents", "goal", (F.col("available") * F.col("max_repeats")).alias("capacity"), rate.alias("expected"))


def draw_mix(sizes: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, copies), copies >= 1, by systematic sampling.

    The documents of a source are laid in a row, by size class and then by a hash of doc_id, each as long as its expected
    copies; one random offset per source shifts the row, and a document is emitted once per integer boundary that it
    crosses. So copies differ from the expected number by less than 1, never exceed max_repeats, and size classes are
    represented evenly. Documents of size 0 or of other sources are not drawn; of documents that share a doc_id, or have
    none, any may come first.

    A source's documents all expect the same, so the end of the k-th is k times that: k is a prefix sum of ones, exact in any
    order, and the product never falls as k grows. Neighbours read the same end, so no boundary is lost or counted twice
    however small the expected number is. The prefix sums run in blocks (functions.prefix) of about DOCUMENTS_PER_BLOCK
    documents, so a source with a third of all documents is many tasks.
    """
    d = sizes.where("size > 0").join(F.broadcast(plan.select("source", "documents", "expected")), "source")  # one row per target
    size_class = F.floor(F.log2(F.col("size")) * 4)
    blocks = F.ceil(F.col("documents") / DOCUMENTS_PER_BLOCK)
    d = d.withColumn("block", size_class * blocks + F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks))
    d = running(d, ["source"], "block", ["block", "doc_id"], {"k": ("sum", F.lit(1))})
    shift = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(10**9)) / 10**9
    end = lambda k: F.floor(k * F.col("expected") + shift)
    return d.select("doc_id", "source", "size", (end(F.col("k")) - end(F.col("k") - 1)).cast("int").alias("copies")).where("copies > 0")


def report_mix(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: drawn size and actual share beside goal and capacity; reachable is false for a source whose
    documents, all used max_repeats times, stay below the goal."""
    got = draws.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn"), F.sum("copies").alias("copies"), F.max("copies").alias("most"))
    r = plan.join(got, "source", "left").withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "copies": F.coalesce("copies", F.lit(0)), "most": F.coalesce("most", F.lit(0))})
    share = F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(Window.partitionBy(F.lit(0))).cast("double"))
    exhausted = F.col("drawn") == F.col("capacity")
    return r.select("source", "target_share", "max_repeats", "available", "documents", "goal", "capacity", "drawn", "copies", "most", share.alias("actual_share"), (~(exhausted & (F.col("capacity") < F.col("goal")))).alias("reachable"))


def mix_documents(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(draws, report) of documents (doc_id, source, size); sizes is cut, since measuring them is the dear part."""
    sizes = cut(sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"))
    plan = cut(plan_mix(sizes, targets))
    draws = draw_mix(sizes, plan, seed)
    return draws, report_mix(draws, plan)
