"""Window-like, aggregate, set and write operators over any table; columns are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.desc(c) for c in order])


def carry_forward(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value so far in the group that is not null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(f"prev_{value}", F.lag(value).over(w)).withColumn(f"next_{value}", F.lead(value).over(w))


def segment_ends(df: DataFrame, group: Sequence[str], position: str, starts: Column) -> DataFrame:
    """Rows where a segment starts, with its end: one before the next start, for the last the end of the group."""
    last = df.groupBy(*group).agg(F.max(position).alias("_last"))
    w = Window.partitionBy(*group).orderBy(position)
    marked = df.filter(starts).withColumn("_next", F.lead(position).over(w))
    return marked.join(last, list(group)).withColumn("segment_end", F.coalesce(F.col("_next") - 1, F.col("_last"))).drop("_next", "_last")


def later_exists(df: DataFrame, group: Sequence[str], order: Sequence[str], test: Column, name: str) -> DataFrame:
    """Whether a row after this one in the group passes the test."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.max(test.cast("int")).over(w), F.lit(0)) == 1)


def budgeted(df: DataFrame, needs_work: Column, order: Sequence[Column | str], budget: int, group: Sequence[str] = ()) -> DataFrame:
    """``status``: 'cached' without work, 'run' for the first ``budget`` that need it, else 'waiting'.

    With no group the order is global: only the first ``budget`` keys are picked, by a top-k,
    and joined back, so no task holds all rows.
    """
    if group:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = F.sum(needs_work.cast("int")).over(w)
        return df.withColumn("status", F.when(~needs_work, "cached").when(n <= budget, "run").otherwise("waiting"))
    raise ValueError("a global budget needs a key: use budgeted_by_key")


def budgeted_by_key(df: DataFrame, key: str, needs_work: Column, order: Sequence[Column | str], budget: int) -> DataFrame:
    picked = df.filter(needs_work).orderBy(*order).limit(budget).select(F.col(key).alias("_picked"))
    joined = df.join(F.broadcast(picked), df[key] == picked["_picked"], "left")  # ``budget`` rows at most
    return joined.withColumn("status", F.when(~needs_work, "cached").when(F.col("_picked").isNotNull(), "run").otherwise("waiting")).drop("_picked")


def places(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row in a global order, from 1 on; the order must be total.

    Rows are dealt out by ranges of the order and numbered within each; the counts of the ranges
    before are added.  No task holds all rows; the driver gets one row a range.  Ranges are
    drawn from a sample, so the dealt rows are written once and read by both uses.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        offsets.append((r["_range"], before))
        before += r["count"]
    held = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(held, "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")


def monotone_run(values: Column, length: int) -> Column:
    """The first strictly descending run of ``length`` neighbours; null if none."""
    starts = F.when(F.size(values) >= length, F.sequence(F.lit(1), F.size(values) - length + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.slice(values, i, length))
    falls = lambda r: F.forall(F.sequence(F.lit(1), F.lit(length - 1)), lambda k: F.element_at(r, k.cast("int")) > F.element_at(r, (k + 1).cast("int")))
    return F.try_element_at(F.filter(runs, falls), F.lit(1))


def density_bands(df: DataFrame, group: Sequence[str], position: str, value: Column, threshold: float, least: int, gap: int) -> DataFrame:
    """Runs of positions at or above the threshold, bridging holes of up to ``gap``, of at least ``least`` length.

    A hole of more than ``gap`` positions below the threshold ends a band.
    """
    hit = df.filter(value >= threshold).select(*group, position)
    w = Window.partitionBy(*group).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) - 1 > gap).cast("int"), F.lit(0))
    marked = hit.withColumn("_new", new).withColumn("_band", F.sum("_new").over(w))
    bands = marked.groupBy(*group, "_band").agg(F.min(position).alias("band_start"), (F.max(position) + 1).alias("band_end"))
    return bands.filter(F.col("band_end") - F.col("band_start") >= least).drop("_band")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """metric, n: a row count per named (filtered) table, in one result."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def roll_up_text(df: DataFrame, group: Sequence[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """Texts of a group joined in order; groups are bounded by their source (pages of a document)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(text))


# -- writes, as pure functions of the table and what comes in ------------------------------


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str, kept: Sequence[str] = ()) -> DataFrame:
    """The union with the last row of each key by ``order``; the source wins a tie.

    Columns in ``kept`` stay those of the target's row where it has one, as a status does.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)))
    if kept:
        w = Window.partitionBy(*keys).orderBy("_new", F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        both = both.withColumns({c: F.first(c).over(w) for c in kept})
    return first_per_key(both, keys, [F.desc(order), F.desc("_new")]).drop("_new")


def upsert_folded(df: DataFrame, names: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """Key on the folded names and ``keys``: spelling of the first row, everything else of the last."""
    folded = df
    for n in names:
        folded = folded.withColumn(f"_f_{n}", F.lower(n))
    group = [f"_f_{n}" for n in names] + list(keys)
    rest = [c for c in df.columns if c not in (*names, *keys)]
    first, last = F.min_by(F.struct(*names), order), F.max_by(F.struct(*rest), order)
    out = folded.groupBy(*group).agg(first.alias("a"), last.alias("b"))
    return out.select(*[F.col(f"a.{n}").alias(n) for n in names], *keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def upsert_guarded(target: DataFrame, source: DataFrame, key: str, verified: str, score: str, slack: int = 4) -> DataFrame:
    """One row per key: a verified row yields to verified ones only, and a row richer by more than ``slack`` stays."""
    columns = target.columns
    t = target.select(F.col(key).alias("_k"), F.struct(*columns).alias("t"))
    s = source.select(F.col(key).alias("_k"), F.struct(*columns).alias("s"))
    both = t.join(s, "_k", "full_outer")
    keep = F.col("s").isNull() | (F.col("t").isNotNull() & ((F.col(f"t.{verified}") & ~F.col(f"s.{verified}")) | (F.col(f"t.{score}") > F.col(f"s.{score}") + slack)))
    return both.select(F.when(keep, F.col("t")).otherwise(F.col("s")).alias("r")).select("r.*")


def replace_group(target: DataFrame, source: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups named in the source are replaced whole; an empty source changes nothing."""
    named = source.select(*group).distinct()
    return target.join(named, list(group), "left_anti").unionByName(source)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def retract(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Parents in ``gone`` get ``flag`` true; their children go."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    marked = parents.join(g, parents[key] == g["_gone"], "left").withColumn(flag, F.col("_gone").isNotNull()).drop("_gone")
    return marked, children.join(g, children[key] == g["_gone"], "left_anti")


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """Rows that the test does not hold for; a null answer keeps the row, as a DELETE does."""
    return df.filter(~F.coalesce(test, F.lit(False)))


def set_null_where_missing(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """ON DELETE SET NULL: keys without a parent become null."""
    p = parents.select(F.col(parent_key).alias("_parent")).distinct()
    joined = children.join(p, children[key] == p["_parent"], "left")
    return joined.withColumn(key, F.col("_parent")).drop("_parent")
