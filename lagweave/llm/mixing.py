"""Mixing sources to target weights by entropy balancing.  Built-in expressions only.

Sources weigh 1, 2, 3, repeating, in code point order (null last) and share all words; a
target stops at ``cap`` times its source's words and the excess goes to the others by
weight.  Rates: of all non-negative document rates whose words meet the targets, take those
closest in relative entropy to "each document once".  They have the form
exp(lambda_source * size / mean_size), cut at ``cap``; the dual is convex and is solved by
Newton steps, kept inside a bisection bracket, each step one aggregation over
(source, size) cells.  Rates become whole copies by systematic rounding along sizes, so a
source misses its target by about one document, and two further passes move single copies
to close what is left.

Rates that after ``MAX_STEPS`` steps still miss a target by more than a millionth are an error, not a result.

Defined cases: a null text has size 0; documents of size 0 are taken once (0 words); null ids
are kept; a null source is a source of its own and comes last; repeated rows are documents of
their own; a very long text is one document like any other, and a source of few long texts
misses its target by up to half the shortest; an empty table gives an empty result; further
columns are ignored, whatever their names.  No randomness but hashes of the id is used, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, release, word_count

CAP = 3
SUB = 64  # least number of parts of a (source, size) cell, so that a cell with a third of all rows is spread
PART_ROWS = 1_000_000  # rows for which there is one part more
CELLS = 250_000  # (source, size) cells that may be broadcast: about 16 MB
MAX_STEPS = 80
STEPS_A_WRITE = 4
TOLERANCE = 1e-9
ACCEPTED = 1e-6  # relative miss above which unsettled rates are an error


def _key(col):
    """Null-safe text key that sorts by code point with null last."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), col.cast("string")))


def targets(totals: DataFrame, cap: int = CAP) -> DataFrame:
    """(skey, total) to (skey, total, target).  One row per source, so the windows are small.

    Sources fill up in the order of total per weight; the first that stays below its cap
    gives the words per unit of weight for all that do."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("total") / F.col("weight"), "skey")
    ranked = totals.withColumn("weight", (F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1).withColumn("all_words", F.sum("total").over(everything))
    filled = ranked.withColumns({
        "full_before": F.coalesce(F.sum(F.lit(cap) * F.col("total")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("all_words") - F.col("full_before")).cast("double") / F.col("weight_left")
    opened = filled.withColumn("level", level).withColumn("open_level", F.when(F.lit(cap) * F.col("total") > F.col("level") * F.col("weight"), F.struct(F.col("full_before"), F.col("level").alias("level"))))
    water = F.min("open_level").over(everything)["level"]
    return opened.select("skey", "total", F.coalesce(F.least((F.lit(cap) * F.col("total")).cast("double"), water * F.col("weight")), (F.lit(cap) * F.col("total")).cast("double")).alias("target"))


def _newton_step(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One Newton step per source on the logarithm of its words, or a bisection step where that
    would leave the bracket; a source that meets its target stays."""
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    words = F.col("n") * F.col("size") * rate
    sums = cells.join(state, "skey").groupBy("skey").agg(
        *(F.first(c).alias(c) for c in ("mean", "target", "lam", "lo", "hi")), F.sum(words).alias("phi"),
        F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope"))
    low, high = F.col("phi") < F.col("target"), F.col("phi") >= F.col("target")
    moved = sums.withColumns({"miss": F.when(F.col("lam") == float("inf"), 0.0).otherwise(F.abs(F.col("phi") / F.col("target") - 1)),
                              "lo": F.when(low, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(high, F.col("lam")).otherwise(F.col("hi"))})
    newton = F.when((F.col("slope") > 0) & (F.col("phi") > 0), F.col("lam") - F.ln(F.col("phi") / F.col("target")) * F.col("phi") / F.col("slope"))
    halved = F.when(F.col("lo").isNull(), 2 * F.col("hi") - 1).when(F.col("hi").isNull(), 2 * F.col("lo") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
    inside = (newton > F.coalesce("lo", F.lit(float("-inf")))) & (newton < F.coalesce("hi", F.lit(float("inf"))))
    step = F.when(F.col("miss") <= TOLERANCE, F.col("lam")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved)
    return moved.select("skey", "mean", "target", step.alias("lam"), "lo", "hi", "miss")


def solve_rates(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Multipliers (skey, lam, mean) whose tilted rates meet the targets.

    ``cells``: skey, size, n.  ``goals``: skey, total, target, docs.  State is one row per
    source, written every few steps; the driver only learns the largest relative miss."""
    state = cut(goals.filter((F.col("total") > 0) & (F.col("target") > 0)).select(
        "skey", (F.col("total") / F.col("docs")).alias("mean"), "target", F.when(F.col("target") >= cap * F.col("total"), F.lit(float("inf"))).otherwise(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("miss")), "mix-state")
    for _ in range(MAX_STEPS // STEPS_A_WRITE):
        moved = state
        for _ in range(STEPS_A_WRITE):
            moved = _newton_step(cells, moved, cap)
        before, state = state, cut(moved, "mix-state")
        release(before)
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            return state
    if worst <= ACCEPTED:
        return state
    raise RuntimeError(f"rates miss a target by a factor of {worst} after {MAX_STEPS} steps")


def _nudged(cells: DataFrame, cap: int) -> DataFrame:
    """Move one copy per source where that brings its words closer to the target."""
    gap = cells.groupBy("skey").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    moves = F.explode(F.array(*(F.struct(F.lit(s).alias("sign"), (F.lit(s) * F.col("size")).alias("change")) for s in (1, -1))))
    choice = cells.join(gap, "skey").select("skey", "size", "n", "copies", "gap", moves.alias("m")).filter(
        (F.col("size") > 0) & F.when(F.col("m.sign") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0))
    best = choice.groupBy("skey").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("m.change")).alias("left"), F.abs("gap").alias("now"), F.col("size"), F.col("m.sign").alias("sign"))).alias("b"))
    apply = best.filter("b.left < b.now").select(F.col("skey").alias("k"), F.col("b.size").alias("s"), F.col("b.sign").alias("sign"))
    joined = cells.join(apply, (cells["skey"] == apply["k"]) & (cells["size"] == apply["s"]), "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("k", "s", "sign")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, rate."""
    return _mixed(docs, id_col, text_col, source_col, cap)[0].drop("skey", "sub")


def _order(parts: int) -> list:
    """The order in which the documents of a cell take its odd copies: columns sub, h, doc_id."""
    return [F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("sub"), F.xxhash64("doc_id", "size").alias("h"), F.col("doc_id")]


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: int) -> tuple[DataFrame, int]:
    """The rows of ``mix`` with skey and sub, and the number of parts of a cell.

    Texts are read once; everything else works on (id, source, size) rows and on cells.
    Within a cell all documents have one rate; the cell's copies go to its documents evenly,
    the odd ones by hash of the id.  Cells are split into parts by that hash for the ranking;
    the number of parts grows with the table."""
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    n_parts = SUB + slim.count() // PART_ROWS
    slim = slim.withColumn("sub", _order(n_parts)[0])
    parts = cut(slim.groupBy("skey", "size", "sub").agg(F.count("*").alias("n")), "mix-parts")
    cells = parts.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    totals = cells.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"))
    goals = cut(targets(totals.select("skey", "total"), cap).join(totals.select("skey", "docs"), "skey"), "mix-goals")
    state = solve_rates(cut(cells.filter("size > 0"), "mix-cells"), goals, cap)
    # rounded, so that the order in which sums were made cannot show
    lam = state.select("skey", F.when(F.col("lam") == float("inf"), F.col("lam")).otherwise(F.round("lam", 9)).alias("lam"), "mean")
    rated = cells.join(goals.select("skey", "total", "target"), "skey").join(lam, "skey", "left").withColumn(
        "rate", F.when(F.col("size") == 0, 1.0).when(F.col("target") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))))
    upto = F.round(F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)), 6)
    rounded = rated.withColumn("upto", upto).withColumn(
        "copies", (F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(Window.partitionBy("skey").orderBy("size")), F.lit(0.0)) + 0.5)).cast("long"))
    held = rounded.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.greatest(F.lit(0), F.least("copies", F.lit(cap) * F.col("n"))))).drop("upto")
    final = cut(_nudged(_nudged(held, cap), cap), "mix-cells")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = F.col("cell_copies") % F.col("cell_n")
    dealt = parts.join(final.select("skey", "size", F.col("n").alias("cell_n"), F.col("copies").alias("cell_copies"), "rate", "total", "target"), ["skey", "size"]).withColumn("before", before)
    plan = dealt.select("skey", "size", "sub", "total", "target", "rate", F.floor(F.col("cell_copies") / F.col("cell_n")).alias("base"),
                        F.greatest(F.lit(0), F.least(odd - F.col("before"), F.col("n"))).alias("extra"))
    place = F.row_number().over(Window.partitionBy("skey", "size", "sub").orderBy(F.xxhash64("doc_id", "size"), "doc_id"))
    copies = (F.col("base") + (place <= F.col("extra")).cast("long")).alias("copies")
    out = slim.join(plan, ["skey", "size", "sub"]).select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "rate", copies, "skey", "sub")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "skey", "sub"), n_parts


def take_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cap: int = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    All documents of a (source, size) cell are taken equally often, but for the odd copies, which
    go to the first in ``_order``.  So a cell is told by a count and by the last document that
    takes an odd copy, and texts stay where they are: the cells are broadcast if there are at
    most ``CELLS``, and joined by their measured size beyond that.  Where rows that share an id
    take one odd copy only in part, the first by a hash of the row do."""
    plan, n_parts = _mixed(docs, id_col, text_col, source_col, cap)
    place = F.struct(*_order(n_parts))
    kept = cut(plan.select("skey", "size", "copies", place.alias("place")), "mix-plan")
    both = F.struct("copies", "place")
    cells = cut(kept.groupBy("skey", "size").agg(F.min(both).alias("low"), F.max(both).alias("high")).filter("high.copies > 0").select(
        F.col("skey").alias("k"), F.col("size").alias("z"), F.col("low.copies").cast("int").alias("least"), F.when(F.col("high.copies") > F.col("low.copies"), F.col("high.place")).alias("last"),
        ((F.col("high.copies") > F.col("low.copies")) & (F.col("high.place") == F.col("low.place"))).alias("tied")), "mix-cells")
    near = F.broadcast(cells) if cells.count() <= CELLS else cells
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), _key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"))
    met = whole.withColumn("place", place).join(near, (F.col("skey") == F.col("k")) & (F.col("size") == F.col("z")))
    copies = F.col("least") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    if not cells.filter("tied").limit(1).count():
        return _repeated(met.select("row", copies.alias("copies")))
    at_tie = F.coalesce(F.col("tied") & (F.col("place") == F.col("last")), F.lit(False))
    odd = kept.join(cells.filter("tied").select("k", "z", "least", "last"), (F.col("skey") == F.col("k")) & (F.col("size") == F.col("z")) & (F.col("place") == F.col("last"))).groupBy("k", "z").agg(
        F.sum(F.col("copies") - F.col("least")).alias("odd"))
    turn = F.row_number().over(Window.partitionBy("skey", "size").orderBy(F.xxhash64("row")))
    some = met.filter(at_tie).select("row", "skey", "size", "least").join(odd, (F.col("skey") == F.col("k")) & (F.col("size") == F.col("z"))).select("row", (F.col("least") + (turn <= F.col("odd")).cast("int")).alias("copies"))
    return _repeated(met.filter(~at_tie).select("row", copies.alias("copies")).unionByName(some))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("no")).select("row.*")
