"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document of a source is wanted in proportion to a measure of its size
(the logarithm of its words), at most ``most`` times, such that the words wanted are the target: its expected copies.
Whole copies are certain and are allocated first. What is left of the expected copies is the document's inclusion
probability p in a sample without replacement: it gets the ranking variable (u / (1 - u)) / (p / (1 - p)) from a
uniform u that depends only on the row, and the documents of lowest rank are taken until the words left to take are
reached (the document at the cut is taken if that comes nearer). Then one document of each source is turned round, where
that brings its words nearer to the target.

The cut is found without sorting a source in one task: the ranks are counted in histograms, twice, each time
inside the bin that holds the cut, and only the rows of the last bin are sorted. The factor of the measure comes from
a table of the sources' distinct sizes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, checkpointed
from pointloom.operators.points import with_positions

BINS = 4096
#: Sources up to which their table goes through the driver and to every executor.
MAX_SOURCES = 100_000
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source.

    The sources in code-point order, null last, get the weights in turn and share the sum of all sizes by
    weight. A target stops at ``most`` times the source's size; the excess is shared again, by weight, among
    the sources below their limit, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = Fraction(sum(size.values())), set(size), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * size[s]}
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(most * size[s])
            left -= most * size[s]
        open_ -= full
    return {s: float(t) for s, t in out.items()}


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: the first bin at which the words so far reach ``_left``, and the words before it."""
    counts = rows.groupBy(*keys, "_bin").agg(F.sum("size").alias("_words"), F.max("_left").alias("_left"))
    running = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_sum", F.sum("_words").over(running)).where(F.col("_sum") >= F.col("_left"))
    return found.groupBy(*keys).agg(F.min_by(F.struct("_bin", F.expr("_left - (_sum - _words) AS _rest")), "_bin").alias("_c")).select(*keys, F.col("_c._bin").alias("_cut"), F.col("_c._rest").alias("_rest"))


def _many_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """As :func:`targets`, for a table (source, source_size) of any length: source, source_size and target."""
    order = [F.col("source").asc_nulls_last()]
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    given = checkpointed(with_positions(sizes, order, "_place").select("source", "source_size", turn.alias("_w")))
    limit = F.col("source_size") * most
    share, before = float("-inf"), None
    while share != before:  # the share a weight gets, which grows until no source is above its limit
        before = share
        full = F.lit(before) * F.col("_w") > limit
        left, weight, total = given.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("_w"))), F.sum("source_size")).first()
        share = (total - (left or 0)) / weight if weight else before
    return given.select("source", "source_size", F.least(F.lit(share) * F.col("_w"), limit.cast("double")).alias("target"))


def measure(size: Column) -> Column:
    """What a document's expected copies are proportional to: the logarithm of its words and one."""
    return F.log1p(size.cast("double"))


def _expected(size: Column, most: int) -> Column:
    """Copies wanted of a document of the given size; a null factor: of all as many as allowed."""
    return F.when(size == 0, 0.0).otherwise(F.least(F.coalesce(F.col("_factor") * measure(size), F.lit(float(most))), F.lit(float(most))))


def _factors(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """source, source_size, target, _factor (of the measure) and _left (words beyond whole copies).

    The factor k has the sum of min(most, k * measure) * size over a source's documents equal its target. Documents
    above some size are at the limit; each distinct size is tried as the largest below it.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("_words")).alias("r")
    sizes = sizes.join(sources.alias("s"), F.expr("r.source <=> s.source")).select("s.*", "size", "_words", measure(F.col("size")).alias("_z"))
    upward = Window.partitionBy("source").orderBy("size")
    running = upward.rowsBetween(Window.unboundedPreceding, 0)
    k = F.try_divide(F.col("target") - most * (F.col("source_size") - F.sum("_words").over(running)), F.sum(F.col("_words") * F.col("_z")).over(running))
    tried = sizes.withColumns({"_k": k, "_next": F.lead("_z").over(upward)})
    good = F.when((F.col("_k") >= 0) & (F.col("_k") * F.col("_z") <= most) & (F.col("_next").isNull() | (F.col("_k") * F.col("_next") >= most)), F.col("_k"))
    factor = tried.withColumn("_factor", F.max(good).over(Window.partitionBy("source")))
    whole = F.floor(_expected(F.col("size"), most) + 1e-9) * F.col("_words")
    return factor.groupBy("source", "source_size", "target").agg(F.max("_factor").alias("_factor"), F.greatest(F.first("target") - F.sum(whole), F.lit(0.0)).alias("_left"))


def _nearer(rows: DataFrame, small) -> DataFrame:
    """``rows`` with one decision of each source turned round where that brings its words nearer to its target.

    A long document at the cut may leave a source far off; one more document taken, or one of the sample left out,
    mends that best. Of those that do it as well, the one of lowest rank, then of smallest id, is turned.
    """
    words = (F.col("_whole") + F.col("_extra")) * F.col("size")
    off = rows.groupBy("source").agg((F.first("target") - F.sum(words)).alias("_off")).where("_off != 0")
    change = F.when(F.col("_extra") == 1, -F.col("size")).otherwise(F.col("size"))
    open_ = rows.where("_left > 0 and _q is not null and size > 0").alias("d").join(small(off.alias("o")), F.expr("d.source <=> o.source"))
    miss = open_.select("d.source", "_off", "doc_id", "_row", "_q", "_extra", F.abs(F.col("_off") - change).alias("_miss")).where("_miss < abs(_off)")
    least = miss.groupBy("source").agg(F.min("_miss").alias("_least"))
    best = miss.alias("d").join(small(least.alias("l")), F.expr("d.source <=> l.source AND d._miss = l._least")).groupBy("d.source").agg(F.min(F.struct("_q", "doc_id", "_row", "_extra")).alias("_b"))
    turned = checkpointed(best.select("source", "_b.*"))
    found = rows.alias("d").join(small(turned.alias("t")), F.expr("d.source <=> t.source AND d._row = t._row AND d.doc_id <=> t.doc_id AND d._extra = t._extra"), "left").select("d.*", F.col("t._row").isNotNull().alias("_turned"))
    # of equal rows one is turned; they are few, as a source has one such decision
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) == 1
    one = found.where("_turned").withColumn("_extra", F.when(first, 1 - F.col("_extra")).otherwise(F.col("_extra")))
    return found.where("not _turned").unionByName(one).drop("_turned")


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, bins: int = BINS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """How often each document is taken.

    Columns: doc_id, source, size (words; null text: 0), source_size, target, expected (copies wanted), copies,
    taken = copies * size, and _row, a hash of the row by which repeated rows can be told from others. A document of
    no words is taken no time. The tables of sources are broadcast up to ``max_sources`` rows and joined like others
    beyond. Null sources are one source, the last; null ids and extra columns change nothing; equal rows are
    interchangeable; an empty table gives an empty result; reruns agree.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.lit(seed), "doc_id", "source", "text")
    rows = checkpointed(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row.alias("_row")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = per.limit(max_sources + 1).collect()
    small = F.broadcast if len(found) <= max_sources else lambda t: t
    if len(found) <= max_sources:
        goal = targets([(r["source"], r["source_size"]) for r in found], weights, most)
        sources = spark.createDataFrame([(r["source"], r["source_size"], goal[r["source"]]) for r in found], "source string, source_size long, target double")
    else:
        sources = _many_targets(per, weights, most)
    shares = checkpointed(_factors(rows, small(sources), most))
    all_shares = sources.alias("s").join(shares.alias("f"), F.expr("s.source <=> f.source"), "left").select("s.*", "_factor", F.coalesce("_left", F.lit(0.0)).alias("_left"))
    joined = rows.alias("d").join(small(all_shares.alias("s")), F.expr("d.source <=> s.source")).select("d.*", "source_size", "target", "_factor", "_left")
    joined = joined.withColumn("expected", _expected(F.col("size"), most)).withColumn("_whole", F.floor(F.col("expected") + 1e-9).cast("int"))
    p = F.greatest(F.col("expected") - F.col("_whole"), F.lit(0.0))
    u = (F.shiftrightunsigned(F.xxhash64("_row", F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    odds = (u / (1 - u)) / (p / (1 - p))
    # odds / (1 + odds) keeps the order and lies in (0, 1), for the bins; a document without a probability is never taken
    ranked = joined.withColumn("_q", F.when(p > 1e-9, odds / (1 + odds))).withColumn("_bin", F.least(F.floor(F.col("_q") * bins), F.lit(bins - 1)).cast("long"))
    some = ranked.where("_left > 0 and _q is not null")
    cut1 = _cut(some, ["source"])
    inside = some.alias("d").join(small(cut1.alias("c")), F.expr("d.source <=> c.source AND d._bin = c._cut")).select("d.*", F.col("_rest").alias("_rest1"), F.col("_cut").alias("_cut1"))
    fine = F.least(F.floor((F.col("_q") * bins - F.col("_bin")) * bins), F.lit(bins - 1)).cast("long")
    cut2 = _cut(inside.withColumn("_bin", fine).withColumn("_left", F.col("_rest1")), ["source"])
    cuts = cut1.withColumnRenamed("_rest", "_rest1").withColumnRenamed("_cut", "_cut1").alias("a").join(cut2.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", "_cut1", F.coalesce("b._cut", F.lit(bins)).alias("_cut2"), F.coalesce("b._rest", F.lit(0.0)).alias("_rest"))
    cuts = checkpointed(cuts)
    placed = ranked.alias("d").join(small(cuts.alias("c")), F.expr("d.source <=> c.source"), "left").select("d.*", "_cut1", "_cut2", "_rest").withColumn("_fine", fine)
    at = F.coalesce((F.col("_left") > 0) & (F.col("_bin") == F.col("_cut1")) & (F.col("_fine") == F.col("_cut2")), F.lit(False))
    before = (F.col("_bin") < F.col("_cut1")) | ((F.col("_bin") == F.col("_cut1")) & (F.col("_fine") < F.col("_cut2")))
    order = Window.partitionBy("source").orderBy("_q", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(at).withColumn("_sum", F.sum("size").over(order))
    # a document is taken if more than half of it lies before the cut
    edge = edge.withColumn("_extra", (F.col("_sum") - F.col("size") / 2.0 <= F.col("_rest")).cast("int")).drop("_sum")
    rest = placed.where(~at)
    # a source whose words never reach the rest to take (rounding) is taken whole once more
    extra = F.when((F.col("_left") <= 0) | F.col("_q").isNull(), 0).when(F.col("_cut1").isNull(), 1).when(before, 1).otherwise(0)
    out = _nearer(checkpointed(rest.withColumn("_extra", extra).unionByName(edge)), small)
    copies = F.least(F.col("_whole") + F.col("_extra"), F.lit(most))
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "_row")


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Nulls, ties, repeated rows and empty tables as in :func:`mix`.
    """
    # equal rows share an id and a hash: they share its copies, the first of them one more where that does not come out even
    key = F.struct("doc_id", "_row").alias("_key")
    counts = mix(docs, seed, **options).groupBy(key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")).where("_copies > 0")
    keyed = docs.select(F.struct("*").alias("_doc"), F.struct("doc_id", F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_row")).alias("_key"))
    chosen = keyed.join(counts, "_key").withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    times = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_k") <= F.col("_copies") % F.col("_n")).cast("long")
    return chosen.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")
