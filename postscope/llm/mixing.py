"""Mixing sources to target weights with hash thresholds.

Every document has a hash of its id. Sizes are summed by source and hash bucket; the
bucket in which a source's budget ends is the only one summed again, by the next bits
of the hash. The budget becomes one threshold per source and taking is a filter: no
sort, and the same documents whenever it runs. With a larger budget a source keeps
what it had and adds to it.

Cases: a null text has size 0; a null source is a source and comes last; a null id is
hashed as the text ``null``; rows with equal ids have equal hashes and are taken
together; sources without words get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope.llm.shared import written
from postscope.session import literal_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
WORD = "[^\\x20\\x09-\\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 15
#: Up to so many sources are planned as a list that is sent to all tasks; more of them as a table.
MAX_SOURCES = 10_000


def fill_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: int = MOST_COPIES) -> list[float]:
    """Targets by weight that stop at ``most`` times a source's size, excess shared again.

    Sources reach their ceiling in order of ceiling by weight, so one pass in that order
    finds those that do; the others share what is left.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = share * sum(sizes), float(sum(weights))
    targets = [0.0] * len(sizes)
    for done, i in enumerate(order):
        if left * weights[i] < most * sizes[i] * weight:
            for j in order[done:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = float(most * sizes[i])
        left -= targets[i]
        weight -= weights[i]
    return targets


def _thresholds(rows: DataFrame, budgets: dict[int, float]) -> dict[int, int]:
    """For each source the hash below which documents add up to its budget.

    Each level sums the sizes of one bucket per source by the next bits. What comes to
    the driver is one row per source and level.
    """
    spark = rows.sparkSession
    limits = {s: 0 for s, b in budgets.items() if b <= 0}
    open_ = {s: (0, 0) for s in budgets if s not in limits}  # source: prefix of the hash, size below it
    shift = HASH_BITS
    while open_ and shift:
        shift -= LEVEL_BITS
        state = literal_rows(
            spark,
            [(s, p, float(budgets[s] - below)) for s, (p, below) in open_.items()],
            "sid int, prefix long, rest double",
        )
        inside = rows.join(F.broadcast(state), "sid").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        cells = inside.groupBy("sid", "rest", F.shiftright("hash", shift).alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("docs")
        )
        up_to = cells.withColumn("upto", F.expr("sum(size) OVER (PARTITION BY sid ORDER BY cell)"))
        over = up_to.where("upto > rest").groupBy("sid").agg(F.min(F.struct("cell", "upto", "size", "docs")).alias("c"))
        found = {r["sid"]: r["c"] for r in over.collect()}
        for s in list(open_):
            below = open_[s][1]
            if s not in found:  # the budget is not below all that is there
                limits[s] = 1 << HASH_BITS if open_[s][0] == 0 else (open_[s][0] + 1) << (shift + LEVEL_BITS)
                del open_[s]
                continue
            cell = found[s]
            upto, size = below + cell["upto"], cell["size"]
            if cell["docs"] == 1 or not shift:
                nearer = upto - budgets[s] < budgets[s] - (upto - size)
                limits[s] = (cell["cell"] + nearer) << shift
                del open_[s]
            else:
                open_[s] = (cell["cell"], upto - size)
    return limits


def _target_table(totals: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """The plan of ``fill_targets`` over a table (source, size) of any number of sources.

    Sources at their ceiling and the level of the others follow from each other: every pass
    sums both, and the level only rises, until no further source is at its ceiling. The driver
    holds these sums and one count per partition of the sorted sources.
    """
    spark = totals.sparkSession
    in_order = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    in_order = written(in_order, "sources").withColumn("part", F.shiftright("place", 33).cast("int"))
    before, firsts = 0, []
    for part, n in sorted(tuple(r) for r in in_order.groupBy("part").count().collect()):
        firsts.append((part, before))
        before += n
    firsts = literal_rows(spark, firsts, "part int, before long")
    place = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("sid") % len(weights)).cast("int")]
    sources = in_order.join(F.broadcast(firsts), "part").withColumn("sid", place).withColumn("weight", weight)
    ceiling = F.col("size") * most
    whole = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, left, rest, full = share * whole["size"], share * whole["size"], whole["weight"], 0
    while True:
        at_ceiling = F.lit(left) * F.col("weight") >= ceiling * F.lit(rest)
        sums = sources.agg(
            F.count_if(at_ceiling).alias("n"),
            F.sum(F.when(at_ceiling, ceiling).otherwise(0)).alias("size"),
            F.sum(F.when(at_ceiling, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if sums["n"] == full or not sums["weight"]:
            break
        full, left, rest = sums["n"], budget - sums["size"], sums["weight"]
    target = F.when(at_ceiling, ceiling.cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(rest))
    whole_times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    return sources.withColumn("target", target).select(
        "sid", F.col("source").alias("name"), F.col("size").alias("source_size"), "target", whole_times.alias("whole")
    )


def _threshold_table(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """As ``_thresholds``, with the sources' states in tables: the plan with its column ``below``."""
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    states = plan.select("sid", budget.alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    done = [states.where("budget <= 0").select("sid", F.lit(0).cast("long").alias("below"))]
    states = states.where("budget > 0")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.join(states, "sid").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        cells = inside.groupBy("sid", "budget", "under", F.shiftright("hash", shift).alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("docs")
        )
        up_to = cells.withColumn("upto", F.expr("under + sum(size) OVER (PARTITION BY sid ORDER BY cell)"))
        over = up_to.where("upto - under > budget - under").groupBy("sid")
        over = over.agg(F.min(F.struct("cell", "upto", "size", "docs")).alias("c"))
        nearer = (F.col("c.upto") - F.col("budget") < F.col("budget") - (F.col("c.upto") - F.col("c.size"))).cast("long")
        none_over = F.when(F.col("prefix") == 0, 1 << HASH_BITS).otherwise(
            F.shiftleft(F.col("prefix") + 1, shift + LEVEL_BITS)
        )
        ends = (F.col("c.docs") == 1) | F.lit(shift == 0)
        below = F.when(F.col("c").isNull(), none_over).when(ends, F.shiftleft(F.col("c.cell") + nearer, shift))
        found = states.join(over, "sid", "left").select(
            "sid", "budget", F.col("c.cell").alias("prefix"), (F.col("c.upto") - F.col("c.size")).alias("under"),
            below.cast("long").alias("below"),
        )
        found = written(found, "thresholds")
        done.append(found.where("below IS NOT NULL").select("sid", "below"))
        states = found.where("below IS NULL").drop("below")
    limits = done[0]
    for level in done[1:]:
        limits = limits.union(level)
    return plan.join(limits, "sid")


def row_digits() -> Column:
    """What decides whether a row is taken once more: a hash of its id and its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = F.substring(F.md5(F.concat_ws("/", name, F.md5(text))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def mix_plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Per source of (source, size, hash): its size, target, whole copies and the hash below which a row has one more."""
    spark = rows.sparkSession
    summed = rows.groupBy("source").agg(F.sum("size").alias("size"))
    totals = summed.limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        plan = written(_target_table(summed, weights, share, most), "targets")
        keyed = rows.join(plan, rows["source"].eqNullSafe(plan["name"])).select("sid", rows["size"], "hash")
        return written(_threshold_table(keyed, plan), "mix-plan")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    full = [int(t / s) if s else 0 for t, s in zip(targets, sizes)]
    schema = "sid int, name string, source_size long, target double, whole int"
    cells = [(i, r["source"], r["size"], targets[i], full[i]) for i, r in enumerate(totals)]
    plan = literal_rows(spark, cells, schema) if cells else spark.createDataFrame([], schema)
    keyed = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["name"]))
    limits = _thresholds(keyed.select("sid", "size", "hash"), {i: targets[i] - full[i] * sizes[i] for i in range(len(sizes))})
    cells = [(*cell, limits[cell[0]]) for cell in cells]
    schema += ", below long"
    return F.broadcast(literal_rows(spark, cells, schema) if cells else spark.createDataFrame([], schema))


def _with_copies(rows: DataFrame, plan: DataFrame, source: str, digits: Column) -> DataFrame:
    plan = plan.select([F.col(c).alias(f"_{c}") for c in plan.columns])
    joined = rows.join(plan, rows[source].eqNullSafe(plan["_name"]))
    return joined.withColumn("_copies", F.col("_whole") + F.when(digits < F.col("_below"), 1).otherwise(0))


def _sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), row_digits().alias("hash"))
    return written(rows, "sizes")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """Size, target and taken words of every document of (doc_id, source, text).

    A source whose target exceeds its size is taken whole as often as it fits, and a
    hash-chosen part once more. Rows with equal or null ids are chosen each by its own text;
    rows with equal ids and texts are taken alike.
    """
    rows = _sizes(docs)
    found = _with_copies(rows, mix_plan(rows, weights, share, most), "source", F.col("hash"))
    return found.select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
        F.col("_copies").cast("int").alias("copies"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """The documents as often as the mix of ``mix_sources`` takes them, with their own columns.

    The number of copies follows from the row itself and its source's plan, so no text is
    moved, and rows with equal or null ids, in whatever sources, are copied each as reported.
    """
    names = docs.columns
    plan = mix_plan(_sizes(docs), weights, share, most)
    taken = _with_copies(docs, plan, "source", row_digits()).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)
