"""History of changing attributes: versions with the period in which each was valid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import FIRST_DATE, genuine_date, round4
from tidemark.operators.filings import distinct_filings

FIRST_DAY = dt.date.fromisoformat(FIRST_DATE).toordinal() - dt.date(1970, 1, 1).toordinal()
SUBTREE_BITS = 13  # nodes of 2^13 neighbouring slots meet in one task at most


def coalesce_runs(snapshots: DataFrame, entity: str, slot: str, payload: str, slot_bits: int | None = None, first: int = 0) -> DataFrame:
    """(entity, first_slot, last_slot, next_slot, payload): longest runs of consecutive snapshots with equal payload.

    snapshots hold at most one row per (entity, slot), slot an integer. Null payloads are equal to each other. next_slot is the
    slot of the snapshot after the run, null if none follows. With slot_bits the slots must lie in [first, first + 2^slot_bits),
    else the query fails; without, the tree spans the observed slots, which one aggregate finds beforehand. Rows with null
    entity or slot are left out; empty input gives no rows.

    Every snapshot starts as an interval of its own. In round r, neighbouring nodes of 2^(r-1) slots are merged pairwise into
    nodes of 2^r slots: the first interval of the right node is absorbed by the last of the left node if their payloads are
    equal and nothing lies between them. SUBTREE_BITS rounds at a time run over the intervals of one subtree, a sorted array of
    at most 2^SUBTREE_BITS of them, after one shuffle by (entity, subtree). Then only a subtree's first and last interval can
    still change; these go on to the next rounds, all others are final.
    """
    x = snapshots.where(F.col(entity).isNotNull() & F.col(slot).isNotNull()).select(F.col(entity).alias("k"), F.col(slot).cast("bigint").alias("a"), F.col(payload).alias("v"))
    if slot_bits is None:
        seen = x.agg(F.min("a"), F.max("a")).first()
        first, last = (seen[0], seen[1]) if seen[0] is not None else (0, 0)
        slot_bits = (last - first).bit_length()
    else:
        inside = F.col("a").between(first, first + 2**slot_bits - 1)
        x = x.withColumn("a", F.when(inside, F.col("a")).otherwise(F.raise_error(F.lit(f"slots must lie in [{first}, {first} + 2^{slot_bits})")).cast("bigint")))
    none = F.lit(None).cast("bigint")
    x = x.select("k", F.struct("a", F.col("a").alias("z"), none.alias("nxt"), "v", F.lit(False).alias("gone")).alias("run"))

    def node(a: Column, r: Column) -> Column:
        return F.call_function("shiftright", a - first, r)

    def merged(left: Column, right: Column, r: Column) -> Column:
        """Whether round r merges two neighbours; null or false where one of them isn't there."""
        return (node(left["a"], r) == node(right["a"], r)) & left["v"].eqNullSafe(right["v"]) & (left["nxt"].isNull() | (left["nxt"] == right["a"]))

    def one_round(runs: Column, r: Column) -> Column:
        def grown(x: Column, i: Column) -> Column:
            left, right = F.get(runs, i - 1), F.get(runs, i + 1)
            grows = merged(x, right, r)
            return F.struct(
                x["a"].alias("a"), F.when(grows, right["z"]).otherwise(x["z"]).alias("z"), F.when(grows, right["nxt"]).otherwise(x["nxt"]).alias("nxt"), x["v"].alias("v"),
                F.coalesce(merged(left, x, r), F.lit(False)).alias("gone"),
            )

        return F.filter(F.transform(runs, grown), lambda x: ~x["gone"])

    done, bits = [], 0
    while True:
        top = min(bits + SUBTREE_BITS, slot_bits)
        runs = x.groupBy("k", node(F.col("run.a"), F.lit(top)).alias("top")).agg(F.sort_array(F.collect_list("run")).alias("runs"))
        if top > bits:
            runs = runs.withColumn("runs", F.aggregate(F.sequence(F.lit(bits + 1), F.lit(top)), F.col("runs"), one_round))
        # what follows within the subtree is known now; the last interval's neighbour is not
        known = F.transform("runs", lambda x, i: x.withField("nxt", F.coalesce(x["nxt"], F.get("runs", i + 1)["a"])))
        x, bits = runs.select("k", F.size("runs").alias("n"), F.posexplode(known).alias("i", "run")), top
        if bits == slot_bits:
            done.append(x.select("k", "run"))
            break
        edge = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
        done.append(x.where(~edge).select("k", "run"))
        x = x.where(edge).select("k", "run")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("k").alias(entity), F.col("run.a").alias("first_slot"), F.col("run.z").alias("last_slot"), F.col("run.nxt").alias("next_slot"), F.col("run.v").alias(payload))


def roe_history(fundamentals: DataFrame) -> DataFrame:
    """(ticker, valid_from, valid_to, roe): the versions of each ticker's roe by date_filed; dates as 'yyyy-MM-dd'.

    Of a ticker's filings of one day the greatest by (loaded_at, filing_id) counts. Runs of missing roe end the version
    before them and are left out; the last version is valid to '9999-12-31'. Same-day filings are reduced before the
    tree, so that a ticker brings at most one row per day to it.
    """
    f = distinct_filings(fundamentals, ["date_filed", "roe"]).select("ticker", F.unix_date(genuine_date()).alias("day"), "loaded_at", "filing_id", round4("roe").alias("roe")).where("day is not null")
    daily = f.groupBy("ticker", "day").agg(F.max(F.struct("loaded_at", "filing_id", "roe")).alias("last")).select("ticker", "day", F.col("last.roe").alias("roe"))
    runs = coalesce_runs(daily, "ticker", "day", "roe", slot_bits=13, first=FIRST_DAY)  # 8192 days from FIRST_DATE on, to 2027
    text = lambda c: F.date_from_unix_date(F.col(c).cast("int")).cast("string")
    return runs.where("roe is not null").select("ticker", text("first_slot").alias("valid_from"), F.coalesce(text("next_slot"), F.lit("9999-12-31")).alias("valid_to"), "roe")
