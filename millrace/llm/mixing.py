"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Each source's target is its weight's share of all words, at most `cap` times what the source has; what a capped
source cannot take goes to the others by weight (water filling). Every document of a source is to be copied
target / source_size times on average. The whole part is copied outright. The fractional part is rounded by
pivotal steps: two documents with open fractions meet, a random amount of word mass moves from one to the other
(in both directions with the probabilities that keep every document's expectation), and at least one of them
becomes 0 or 1. Mass is counted in words, so a source's words stay fixed in every step but the last, in which the
one document still open is drawn by its fraction. Hence a source misses its target by less than one document.

The steps run as a reduction tree: documents are dealt by hash into leaves of about `fan` documents, each leaf
folds its documents, the longest first, so that the one still open at the end is short, and hands at most one open document to its parent, `fan` leaves to a parent, up to one root
for each source. A hot source only has more leaves; no task ever holds more than about `fan` documents of it.

The tree holds ids and sizes alone. Rows that are equal in all that the mixture reads are counted first, where they
lie, and told apart by an ordinal, which goes into their hashes: a null doc_id, or a row that repeats, fills no leaf of
its own. Columns to carry stay in a table with a key for each row and are joined to the settled copies once.

Defined results: a null text has size 0; a null source is a source of its own (last in order); size 0 takes 0
words; an empty table gives an empty result; repeated rows are documents of their own; extra columns are carried
only if named in `carry`, where source, doc_id and the columns made here go before carried ones of the same name.
Randomness comes from hashes of the rows' contents and ordinals, so reruns agree, whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, quoted, stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
FAN = 64
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000

#: One pivotal step. `a` is the open document so far (i: its place, m: word mass, c: its words; i = -1: none),
#: `x` the next; `ones` collects the places that are rounded up.
_STEP = """(a, x) -> CASE
  WHEN a.i < 0 THEN named_struct('i', x.i, 'm', x.m, 'c', x.c, 'ones', a.ones)
  WHEN x.u * (least(a.c - a.m, x.m) + least(a.m, x.c - x.m)) < least(a.m, x.c - x.m) THEN
    CASE WHEN a.c - a.m <= x.m
      THEN IF(x.m - (a.c - a.m) > 1e-9 * x.c,
              named_struct('i', x.i, 'm', x.m - (a.c - a.m), 'c', x.c, 'ones', array_append(a.ones, a.i)),
              named_struct('i', -1, 'm', 0D, 'c', 0D, 'ones', array_append(a.ones, a.i)))
      ELSE named_struct('i', a.i, 'm', a.m + x.m, 'c', a.c, 'ones', a.ones) END
  ELSE
    CASE WHEN a.m <= x.c - x.m
      THEN IF(x.c - x.m - a.m > 1e-9 * x.c,
              named_struct('i', x.i, 'm', x.m + a.m, 'c', x.c, 'ones', a.ones),
              named_struct('i', -1, 'm', 0D, 'c', 0D, 'ones', array_append(a.ones, x.i)))
      ELSE named_struct('i', a.i, 'm', a.m - (x.c - x.m), 'c', a.c, 'ones', array_append(a.ones, x.i)) END
END"""


def _uniform(*columns: F.Column) -> F.Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _folded(units: DataFrame, mass: str, words: str) -> DataFrame:
    """Adds `end` (the open document and the places rounded up) from `items`; `mass` and `words` are those of an item x."""
    return units.withColumn("end", F.expr(f"aggregate(transform(items, (x, k) -> named_struct('i', k, 'm', {mass}, 'c', {words}, 'u', x.u)), named_struct('i', -1, 'm', 0D, 'c', 0D, 'ones', cast(array() as array<int>)), {_STEP})"))


def _with_sums_before(rows: DataFrame, order: list[F.Column], **amounts: F.Column) -> DataFrame:
    """Adds to each row, by name, the sum of an amount over all rows before it in `order`.

    The rows are sorted in ranges; only one row for each range (at most spark.sql.shuffle.partitions) meets in one task.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order)))
    offsets = ranged.groupBy("_range").agg(*(F.sum(x).alias(f"_{name}") for name, x in amounts.items()))
    offsets = offsets.select("_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in amounts))
    rows = ranged.join(F.broadcast(offsets), "_range")
    return rows.select("*", *((F.col(f"_{name}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(name) for name, x in amounts.items())).drop("_range", *(f"_{name}" for name in amounts))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, rank, docs, source_size, target: one row for each source of `sizes` (source, size, and n, the number of
    equal rows that a row stands for, where there is such a column)."""
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    one = sizes.groupBy("source").agg(F.sum(F.col("size") * n).alias("source_size"), F.sum(n).alias("docs"))
    one = _with_sums_before(one, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    one = one.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("fills_at", F.col("most") / F.col("weight"))
    one = cut(_with_sums_before(one, [F.col("fills_at"), F.col("rank")], most_before=F.col("most"), weight_before=F.col("weight")))
    words, weight = one.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(words or 0)) - F.col("most_before")) / (F.lit(float(weight or 1)) - F.col("weight_before"))
    # the water stands as high as the first source, by where they fill, that is not full at its level
    water = one.select("fills_at", "rank", level.alias("level")).where("fills_at > level").agg(F.min(F.struct("fills_at", "rank", "level"))["level"]).first()[0]
    target = F.col("most") if water is None else F.least("most", F.lit(water) * F.col("weight"))
    return one.select("source", "rank", "docs", "source_size", target.alias("target"))


def _spread(equal: DataFrame, chunk: int = 10_000) -> DataFrame:
    """A row with an ordinal for each of the `n` rows that a row stands for; large numbers are dealt out in chunks first."""
    few = equal.where(F.col("n") <= chunk).withColumn("chunk", F.lit(0).cast("long"))
    many = equal.where(F.col("n") > chunk).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))).repartition("chunk", "doc_id", "size")
    at = F.col("chunk") * chunk
    return few.unionByName(many).withColumn("ordinal", F.explode(F.sequence(at, F.least(F.col("n"), at + chunk) - 1))).drop("chunk", "n")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, fan: int = FAN, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the columns of `carry` for each row of `docs`."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    carry = tuple(c for c in carry if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    marks = []
    if carry:  # rows are equal only if what they carry is; two hashes of 64 bits stand for it
        docs = stage_table(docs.select("doc_id", "source", "text", *(quoted(c) for c in carry if c != "text"), F.monotonically_increasing_id().alias("_mix_row")), "mix_input")
        held = [x for c in carry for x in (quoted(c), quoted(c).isNull())]
        marks = [F.xxhash64(*held).alias("mark"), F.xxhash64(F.lit("second"), *held).alias("mark_2")]
    key = ["source", "doc_id", "size", *(["mark", "mark_2"] if carry else [])]
    measured = docs.select("source", "doc_id", size, *marks, *(["_mix_row"] if carry else []))
    equal = cut(measured.groupBy(*key).agg(F.count("*").alias("n"), *([F.min("_mix_row").alias("_mix_row")] if carry else [])))
    targets = source_targets(equal, weights, cap)
    n_sources, most_docs = targets.agg(F.count("*"), F.max("docs")).first()
    side = targets.withColumnRenamed("source", "its")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side

    rows = _spread(equal).join(side, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate).cast("int")).withColumn("open", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)))
    drawn_by = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *map(F.col, [*key[2:], "ordinal"])]
    row_key = ["_mix_row"] if carry else []
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64(*drawn_by, F.lit(seed + 1)).alias("then"), "doc_id", *row_key, _uniform(*drawn_by, F.lit(seed + 2)).alias("u"))
    leaf = F.pmod(F.xxhash64(*drawn_by, F.lit(seed)), F.ceil(F.col("docs") / F.lit(fan)))
    leaves = rows.where("open > 0").withColumn("node", leaf).groupBy("rank", "node").agg(F.sort_array(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("source", "source_size", "target", "whole", "open")))
    leaves = cut(_folded(leaves, "-x.order * open", "cast(-x.order as double)"))
    nodes, levels, units = -(-(most_docs or 0) // fan), [], leaves.select("rank", "node", "end")
    while nodes > 1:
        up = units.where("end.i >= 0").withColumn("child", F.struct((-F.col("end.c")).alias("order"), "node", F.col("end.m").alias("m"), F.col("end.c").alias("c"), _uniform(F.col("rank"), F.col("node"), F.lit(seed + 3 + len(levels))).alias("u")))
        up = up.groupBy("rank", F.floor(F.col("node") / fan).alias("node")).agg(F.sort_array(F.collect_list("child")).alias("items"))
        units = cut(_folded(up, "x.m", "x.c"))
        levels.append(units)
        nodes = -(-nodes // fan)
    ruled = units.select("rank", "node", F.when(F.col("end.i") >= 0, _uniform(F.col("rank"), F.lit(seed + 99)) * F.col("end.c") < F.col("end.m")).otherwise(F.lit(False)).alias("up"))
    for level in reversed(levels):
        ruled = level.join(ruled, ["rank", "node"]).select("rank", F.posexplode("items").alias("place", "child"), "end", "up")
        ruled = ruled.select("rank", F.col("child.node").alias("node"), _rounded("place").alias("up"))
    out = leaves.join(ruled, ["rank", "node"], "left").withColumn("up", F.coalesce("up", F.lit(False)))
    drawn = out.select("*", F.posexplode("items").alias("place", "it"))
    made = ["source", "source_size", "target"]
    drawn = drawn.select("it.doc_id", *(f"it.{c}" for c in row_key), (-F.col("it.order")).alias("size"), *made, (F.col("whole") + _rounded("place").cast("int")).alias("copies"))
    settled = rows.where("open <= 0").select("doc_id", *row_key, "size", *made, F.col("whole").alias("copies"))
    both = drawn.unionByName(settled).withColumn("taken", F.col("size") * F.col("copies"))
    if carry:
        both = both.join(docs.select("_mix_row", *map(quoted, carry)), "_mix_row")
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *map(quoted, carry))


def _rounded(place: str) -> F.Column:
    return F.array_contains(F.col("end.ones"), F.col(place)) | ((F.col("end.i") == F.col(place)) & F.col("up"))
