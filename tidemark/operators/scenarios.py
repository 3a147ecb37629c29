"""Scenario keys: folds, cuts and permutations as columns, so that a rule is replayed over all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Keys, fold_of, lag, over


#: Replicates that one row explodes into at once.
CHUNK = 25


def with_length(df: DataFrame, keys: Keys) -> DataFrame:
    """df with n, the bars of each key, by a small aggregate joined back."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, list(keys))


def folds(df: DataFrame, keys: Keys, n_folds: int = 6, least: int = 10) -> DataFrame:
    """df with fold and its bars numbered anew within each fold; folds of less than `least` bars are left out."""
    df = with_length(df, keys).withColumn("fold", fold_of(F.col("n"), n_folds))
    whole = Window.partitionBy(*keys, "fold")
    df = df.withColumns({"__size": F.count(F.lit(1)).over(whole), "__first": F.min("bar").over(whole)})
    return df.where(F.col("__size") >= least).withColumn("bar", F.col("bar") - F.col("__first")).drop("__size", "__first", "n")


def cut_points(n: Column, n_cuts: int = 12, warmup: int = 50) -> Column:
    """Whole numbers evenly spaced from warmup + 5 to n - 1, without repeats; an array column."""
    steps = F.sequence(F.lit(0), F.lit(n_cuts - 1))
    lo = F.lit(float(warmup + 5))
    at = F.transform(steps, lambda i: F.floor(lo + i * (n - 1 - lo) / F.lit(max(n_cuts - 1, 1)) + 1e-9).cast("int"))
    return F.array_distinct(F.filter(at, lambda k: (k > 0) & (k < n)))


def truncations(df: DataFrame, keys: Keys, n_cuts: int = 12, warmup: int = 50) -> DataFrame:
    """Each bar once for every cut after it: df with cut, the number of bars kept.

    Every bar explodes into the cuts beyond it, at most n_cuts copies; no range join.
    """
    d = with_length(df, keys).withColumn("__cuts", cut_points(F.col("n"), n_cuts, warmup))
    return d.withColumn("cut", F.explode(F.filter("__cuts", lambda k: k > F.col("bar")))).drop("n", "__cuts")


def salt(what: str, keys: Keys) -> Column:
    """A number below 2^32 for the keys and a purpose; once per key, not per row and permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(what), *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("bigint")


def first_mix(start: Column, perm_id: Column, bar: Column) -> Column:
    return (bar.cast("bigint") * 2654435761 + perm_id.cast("bigint") * 2246822507 + start) % 2**32


def fold(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix(x: Column) -> Column:
    return (fold(x) * 73244475) % 2**32


def draw(start: Column, perm_id: Column, bar: Column) -> Column:
    """A pseudo-random number below 2^32 that any SQL engine reproduces: a multiplicative mix in whole numbers below 2^63. For
    one start and perm_id it differs for all bars, so that its order is a permutation without ties."""
    return fold(mix(mix(first_mix(start, perm_id, bar))))


def replicates(df: DataFrame, n: int) -> DataFrame:
    """df n times, with perm_id 1..n: exploded in two steps, spread over all tasks between them, since a small df is one task."""
    few = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))))
    ids = F.sequence(F.col("__chunk") * CHUNK + 1, F.least((F.col("__chunk") + 1) * CHUNK, F.lit(n)))
    return few.repartition(tasks(df), "__chunk", "bar").withColumn("perm_id", F.explode(ids)).drop("__chunk")


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def replicated_keys(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """df, one row a key, n times with perm_id 1..n, partitioned by (keys, perm_id): what is exploded from a row's arrays
    needs no further shuffle for windows and aggregates by (keys, perm_id). Chunks of CHUNK permutations are spread first, as
    few keys are one task."""
    few = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK)))).repartition(tasks(df), *keys, "__chunk")
    ids = F.sequence(F.col("__chunk") * CHUNK + 1, F.least((F.col("__chunk") + 1) * CHUNK, F.lit(n)))
    return few.withColumn("perm_id", F.explode(ids)).drop("__chunk").repartition(tasks(df), *keys, "perm_id")


def drawn(df: DataFrame, rows: str, start: str, out: str) -> DataFrame:
    """df with out: the array column rows, of structs with bar, in the order of draw. Draw and place are packed into one number,
    so that plain numbers are sorted; one step of the draw is one pass over the array, which evaluates no step twice."""
    x = F.transform(F.col(rows)["bar"], lambda bar: first_mix(F.col(start), F.col("perm_id"), bar))
    x = F.transform(F.transform(x, mix), mix)
    packed = F.transform(x, lambda v, i: F.coalesce(F.shiftright(fold(v), 1) * 2**32 + i, F.lit(0)))
    return df.withColumn(out, F.transform(F.sort_array(packed), lambda at: F.get(F.col(rows), (at % 2**32).cast("int"))))


def permute_prices(df: DataFrame, keys: Keys, n_perm: int, start: int = 0, seed: int = 42) -> DataFrame:
    """(keys, perm_id, bar, open, high, low, close): bars rebuilt from shuffled gaps and shapes.

    In logs, a bar is a gap (open after the close before it) and a shape (high, low and close after its open). The gaps and
    the shapes of the bars after `start` are shuffled by two independent permutations and chained from the close at start;
    bars up to start stay. The sum of all gaps and shapes is kept, so the last close is as well. Keys with less than 3 bars
    stay as they are. The permutations order rows by draw, so SQL can replay them. A key's bars are one array: a permutation
    sorts numbers beside it and nothing but the arrays is shuffled.
    """
    keys = list(keys)
    logs = df.where("open > 0 and high > 0 and low > 0 and close > 0").select(*keys, "bar", *(F.ln(c).alias(c[0]) for c in ("open", "high", "low", "close")))
    logs = with_length(logs, keys).withColumn("prev", lag("c", keys))
    moved = (F.col("bar") > start) & (F.col("n") >= 3)
    tail = F.struct("bar", (F.col("o") - F.col("prev")).alias("gap"), *((F.col(x) - F.col("o")).alias(f"d{x}") for x in "hlc"))
    head = F.struct(F.col("bar").cast("int").alias("bar"), *(F.col(x) for x in "ohlc"), *(F.lit(None).cast("double").alias(x) for x in ("gap", "dh", "dl", "dc")))
    per = logs.groupBy(*keys).agg(F.collect_list(F.when(moved, tail)).alias("tail"), F.collect_list(F.when(~moved, head)).alias("head"), F.max(F.when(F.col("bar") == start, F.col("c"))).alias("anchor"))
    reps = replicated_keys(per.withColumns({"s1": salt(f"gap{seed}", keys), "s2": salt(f"shape{seed}", keys)}), keys, n_perm)
    reps = drawn(drawn(reps, "tail", "s1", "gaps"), "tail", "s2", "shapes")
    none = [F.lit(None).cast("double").alias(x) for x in "ohlc"]
    pairs = F.zip_with("gaps", "shapes", lambda g, x: F.struct(g["gap"].alias("gap"), x["dh"].alias("dh"), x["dl"].alias("dl"), x["dc"].alias("dc")))
    made = F.transform(pairs, lambda x, i: F.struct((i + 1 + start).cast("int").alias("bar"), *none, x["gap"].alias("gap"), x["dh"].alias("dh"), x["dl"].alias("dl"), x["dc"].alias("dc")))
    rows = reps.select(*keys, "perm_id", "anchor", F.explode(F.concat("head", F.when(F.col("anchor").isNotNull(), made).otherwise(F.slice(made, 1, 0)))).alias("x")).select(*keys, "perm_id", "anchor", "x.*")
    w = Window.partitionBy(*keys, "perm_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    path = F.col("anchor") + F.sum(F.col("gap") + F.col("dc")).over(w)
    rows = rows.withColumn("c", F.coalesce("c", path)).withColumn("o", F.coalesce(F.col("o"), F.col("c") - F.col("dc")))
    rows = rows.withColumns({"h": F.coalesce(F.col("h"), F.col("o") + F.col("dh")), "l": F.coalesce(F.col("l"), F.col("o") + F.col("dl"))})
    return rows.select(*keys, "perm_id", "bar", *(F.exp(x).alias(c) for x, c in zip("ohlc", ("open", "high", "low", "close"))))


def shuffle_values(df: DataFrame, keys: Keys, value: str, n_perm: int, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, perm_id, bar, value, keep): value shuffled within each key, n_perm times; the columns keep stay at their bars."""
    keys = list(keys)
    per = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bar", *dict.fromkeys([value, *keep])))).alias("rows"))
    reps = drawn(replicated_keys(per.withColumn("s1", salt(f"value{seed}", keys)), keys, n_perm), "rows", "s1", "drawn")
    pairs = F.zip_with("rows", "drawn", lambda at, x: F.struct(at["bar"].alias("bar"), x[value].alias(value), *(at[c].alias(c) for c in keep)))
    return reps.select(*keys, "perm_id", F.explode(pairs).alias("x")).select(*keys, "perm_id", "x.*")


__all__ = ["with_length", "folds", "cut_points", "truncations", "draw", "replicates", "permute_prices", "shuffle_values", "over"]
