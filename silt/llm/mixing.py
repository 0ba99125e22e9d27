"""Mixing sources to target weights (operator 5): pivotal dependent rounding, in DataFrame functions only.

A document's expected copies are its source's target over the source's size. The whole part is taken; the fractional
parts, which start equal within a source, are rounded against each other: of two documents, a random one gains what
words the other loses until one of them has a whole number of copies; that one is settled, the other meets the next.
The words expected of the pair stay the same, and so do each document's expected copies, so a source's taken words end
within one document's size of its target. Documents are dealt by a hash into groups of about FAN; each group settles
all but one, and what is left goes up a reduction tree of the same fan until one document a source remains, which a
coin settles. A source of any size, hot or not, is thus split into small groups, and no group meets in one task. Rows
with equal doc_id, source and text are counted before any of that: of m such rows with the fraction p, the whole part of
m * p gain a copy, and the rest of it is rounded as one document's.

Edge cases: a null or word-less text has size 0 and takes 0 words; a null source is a source of its own, last in
order; a source whose sizes sum to 0 has target 0; equal rows are separate rows of the result; null doc_ids are
allowed; extra columns are ignored, whatever their names; an empty table gives an empty table. Random draws are hashes
of doc_id, source, text, size, the level and the seed, so reruns agree on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import WORD, cut
from silt.llm.joins import join_unique

#: Fixed by the contract: weights that the sources take in turn, and most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that meet in one group of the reduction tree.
FAN = 64
#: Up to so many sources the table of targets is broadcast; beyond, hot sources are broadcast and the rest shuffled.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """silt_source, n_docs, source_size and target for each source of sizes (silt_source, size, rows that are alike).

    The null source is null; n_docs counts the rows of sizes. target = least(3 * source_size, level * weight), the level
    set so that targets sum to all sizes. Sources are ordered by how soon they fill; the level that counts is the
    highest reached when all before are full.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rank = F.row_number().over(Window.orderBy(F.col("silt_source").asc_nulls_last())) - 1
    by = (
        sizes.groupBy("silt_source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("size") * F.col("alike")).alias("source_size"))
        .withColumn("weight", F.element_at(weights, (rank % len(WEIGHTS) + 1).cast("int")))
        .withColumn("most", F.col("source_size").cast("double") * MOST_COPIES)
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("silt_source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    by = by.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return by.select("silt_source", "n_docs", "source_size", target.alias("target"))


_CELL = "struct<row: {row}, size: double, p: double, u: double>"


def _settle(cells: str, row_type: str) -> str:
    """SQL: folds an array of cells to (settled: array of (row, up), left: the last unsettled cell or null)."""
    settled = f"array<struct<row: {row_type}, up: int>>"
    # c: the cell in hand, x: the next one; gain and loss are the words that c can still gain from, and lose to, x.
    gain, loss = "least((1 - s.c.p) * s.c.size, x.p * x.size)", "least(s.c.p * s.c.size, (1 - x.p) * x.size)"
    c_to_1 = "(1 - s.c.p) * s.c.size <= x.p * x.size"
    c_to_0 = "s.c.p * s.c.size <= (1 - x.p) * x.size"

    def cell(of: str, p: str) -> str:
        return f"named_struct('row', {of}.row, 'size', {of}.size, 'p', {p}, 'u', {of}.u)"

    def outcome(row: str, up: int, left: str) -> str:
        done = f"concat(s.done, array(named_struct('row', {row}.row, 'up', {up})))"
        return f"named_struct('c', {left}, 'done', {done})"

    up = f"""if({c_to_1}, {outcome("s.c", 1, cell("x", "x.p - (1 - s.c.p) * s.c.size / x.size"))},
                          {outcome("x", 0, cell("s.c", "s.c.p + x.p * x.size / s.c.size"))})"""
    down = f"""if({c_to_0}, {outcome("s.c", 0, cell("x", "x.p + s.c.p * s.c.size / x.size"))},
                            {outcome("x", 1, cell("s.c", "s.c.p - (1 - x.p) * x.size / s.c.size"))})"""
    kind = _CELL.format(row=row_type)
    return f"""aggregate({cells},
        named_struct('c', cast(null as {kind}), 'done', cast(array() as {settled})),
        (s, x) -> cast(if(s.c is null, named_struct('c', x, 'done', s.done),
            if(x.u * ({gain} + {loss}) < {loss}, {up}, {down})) as struct<c: {kind}, done: {settled}>))"""


def _chance(level: int, seed: int) -> str:
    """SQL: a number in [0, 1) from the row, the level and the seed."""
    return f"(shiftrightunsigned(xxhash64(row.silt_id, row.size, {level}, {seed}), 11) / 9007199254740992D)"


def copies(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) for each row of docs (doc_id, source, text)."""
    return _rows(_planned(docs, seed))


def _id() -> Column:
    """A hash of a row's doc_id, source and text."""
    return F.xxhash64("doc_id", F.col("source").isNull(), F.col("source").cast("string"), "text")


def _planned(docs: DataFrame, seed: int) -> DataFrame:
    """row, alike and up for each distinct row of docs: of the `alike` rows, `up` get a copy more than the whole part."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("silt_source"), size.alias("size"), _id().alias("silt_id"))
    sized = cut(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("alike")))
    targets = cut(source_targets(sized))
    n_sources, n_docs, most = targets.agg(F.count(F.lit(1)), F.sum("n_docs"), F.max("n_docs")).first()
    # Null sources meet under a key that no source has: sources keep a leading mark, the null one hasn't it.
    keyed = F.coalesce(F.concat(F.lit("="), "silt_source"), F.lit(""))
    targets, sized = targets.withColumn("silt_by", keyed), sized.withColumn("silt_by", keyed)
    targets = targets.drop("silt_source")
    if n_sources <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), "silt_by")
    else:
        joined = join_unique(sized, targets, "silt_by", "n_docs", n_docs, "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", F.least(rate, F.lit(float(MOST_COPIES)))).withColumn("whole", F.floor("rate"))
    each = F.when(F.col("size") > 0, F.col("alike") * (F.col("rate") - F.col("whole"))).otherwise(F.lit(0.0))
    joined = joined.withColumn("ups", each).withColumn("sure", F.floor("ups"))
    row = F.struct(
        "doc_id", F.col("silt_source").alias("source"), "size", "source_size", "target", "whole", "silt_id", "alike", "sure")
    cells = joined.select(
        "silt_by",
        F.when(F.col("n_docs") > FAN, F.ceil(F.col("n_docs") / FAN)).otherwise(F.lit(1)).cast("bigint").alias("groups"),
        row.alias("row"),
        (F.col("ups") - F.col("sure")).alias("p"),
    )
    cells = cells.withColumn("at", F.expr("pmod(row.silt_id, groups)"))
    # Rows with nothing to round pass through the same groups as settled.
    row_type = cells.schema["row"].dataType.simpleString()
    levels, groups = 1, -(-(most or 1) // FAN)
    while groups > 1:
        levels, groups = levels + 1, -(-groups // FAN)
    parts = []
    for level in range(levels):
        last = level == levels - 1
        draw = _chance(level, seed)
        grouped = (
            cells.withColumn("u", F.expr(draw))
            .groupBy("silt_by", "at")
            .agg(F.first("groups").alias("groups"), F.expr(
                "collect_list(struct(u, row, p))").alias("cells"))
            .withColumn("cells", F.expr("array_sort(cells)"))
            .withColumn("still", F.expr(f"""transform(filter(cells, c -> c.p > 0 and c.row.size > 0),
                c -> named_struct('row', c.row, 'size', cast(c.row.size as double), 'p', c.p, 'u', c.u))"""))
            .withColumn("fold", F.expr(_settle("still", row_type)))
            .withColumn("done", F.expr("""concat(fold.done, transform(filter(cells, c -> not (c.p > 0 and c.row.size > 0)),
                c -> named_struct('row', c.row, 'up', 0)))"""))
            .select("silt_by", "at", "groups", "done", F.col("fold.c").alias("left"))
        )
        grouped = cut(grouped)
        parts.append(grouped.select(F.explode("done").alias("d")).select("d.row", "d.up"))
        rest = grouped.where("left is not null")
        if last:
            coin = F.expr(f"if(({_chance(level + 1, seed)}) < p, 1, 0)")
            parts.append(rest.select("left.row", "left.p").select("row", coin.alias("up")))
        else:
            cells = rest.select(
                "silt_by", F.expr(f"cast(ceil(groups / {FAN}) as bigint)").alias("groups"), "left.row", "left.p",
                F.expr(f"at div {FAN}").alias("at"),
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("row.*", (F.col("row.sure") + F.col("up")).alias("up"))


def _rows(planned: DataFrame) -> DataFrame:
    """A row for each of the rows that are alike."""
    out = planned.withColumn("k", F.explode(F.expr("sequence(1, alike)")))
    n = F.col("whole") + F.when(F.col("k") <= F.col("up"), 1).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", n.cast("bigint").alias("copies"),
        (n * F.col("size")).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all for 0 copies) and its number among those in `copy`.

    A column `copy` of docs gives way; columns of any other name stay as they are. Rows that are alike in doc_id, source
    and text get their copies in the order of a hash of all their columns.
    """
    plan = _planned(docs.select("doc_id", "source", "text"), seed)
    plan = plan.select("silt_id", "whole", "up", "alike").where("whole > 0 or up > 0")
    kept = [c for c in docs.columns if c.lower() != "copy"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = docs.select(_id().alias("silt_id"), row.alias("silt_row"))
    once = rows.join(plan.where("alike = 1"), "silt_id").withColumn("silt_k", F.lit(1))
    # Only rows that repeat are ranked.
    same = Window.partitionBy("silt_id").orderBy(F.xxhash64(F.to_json("silt_row")))
    often = rows.join(plan.where("alike > 1"), "silt_id").withColumn("silt_k", F.row_number().over(same))
    out = once.unionByName(often)
    n = F.col("whole") + F.when(F.col("silt_k") <= F.col("up"), 1).otherwise(0)
    out = out.withColumn("silt_copy", F.explode(F.sequence(F.lit(0), n.cast("int")))).where("silt_copy > 0")
    return out.select(*[F.col(f"silt_row.`{c}`") for c in kept], F.col("silt_copy").alias("copy"))
