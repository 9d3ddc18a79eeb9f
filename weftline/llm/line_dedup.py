"""Line dedup over a suffix array of line ids, with DataFrame operations only.

Suffixes begin at lines that repeat and end before the next line that does not, or the
next two neighbours that stand together nowhere else, as no repeat goes past them;
stretches with too few words for a run are left out. Prefix doubling ranks them by their first 1, 2, 4, ... lines
until no class splits, which gives the suffix array. The longest common prefixes of
neighbours in it tell for each line the longest run from there that occurs again;
those with enough words are the maximal repeated runs. Over their lines, runs of
just enough words are named by two ranks that overlap over them: all but the first
of a name are later copies, and the lines under them are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from .common import carried, drop_staged, join_small, restored, stage, without, words

#: Words that a repeated run needs.
MIN_WORDS = 50


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``row, doc_id, line, pos, words, id_a, id_b``: lines with a word, counted by ``line``; ``pos`` counts all lines.

    ``docs`` has ``row`` (unique), ``doc_id`` and ``text``. A line is told by 128 bits of hashes.
    """
    raw = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("x"), F.size(words(x)).alias("words")))
    lines = docs.select("row", "doc_id", F.posexplode(F.filter(raw, lambda r: r["words"] > 0)).alias("line", "r"))
    return lines.select("row", "doc_id", "line", F.col("r.pos").alias("pos"), F.col("r.words").alias("words"), F.xxhash64("r.x").alias("id_a"), F.xxhash64(F.lit("line"), F.col("r.x")).alias("id_b"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The lines that occur at least twice, with ``island`` (they are consecutive in it) and ``rank`` in the order of line ids.

    A range shuffle sorts the distinct ids over all partitions; the number of a
    partition and of a row in it together grow in that order.
    """
    found = lines.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id_a").alias("r_a"), F.col("id_b").alias("r_b"))
    ranks = stage(found.repartitionByRange("r_a", "r_b").sortWithinPartitions("r_a", "r_b").withColumn("rank", F.monotonically_increasing_id()), "line-ranks")
    kept = join_small(lines, ranks, (F.col("id_a") == F.col("r_a")) & (F.col("id_b") == F.col("r_b"))).drop("id_a", "id_b", "r_a", "r_b")
    return kept.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line")))


def long_stretches(repeated: DataFrame, min_words: int) -> DataFrame:
    """``repeated``, staged, with its islands cut between neighbours that stand together only once, without those of fewer than ``min_words`` words.

    A repeated run holds no such neighbours, and lies in one stretch; so all runs of ``min_words`` words are left.
    """
    by_island = Window.partitionBy("row", "island").orderBy("line")
    islands = repeated.withColumn("all_words", F.sum("words").over(Window.partitionBy("row", "island"))).filter(F.col("all_words") >= min_words).drop("all_words")
    pairs = stage(islands.withColumn("next", F.lead("rank").over(by_island)), "line-pairs", codec="lz4")
    again = pairs.filter("next IS NOT NULL").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rank").alias("a_rank"), F.col("next").alias("a_next"))
    again = stage(again, "line-again", codec="lz4")
    marked = join_small(pairs, again, (F.col("rank") == F.col("a_rank")) & (F.col("next") == F.col("a_next")), "left")
    # an island goes on where the line before stands together with this one elsewhere too
    begins = F.coalesce(F.lag(F.col("a_rank").isNull()).over(by_island), F.lit(False))
    cut = marked.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(by_island))
    whole = cut.withColumn("all_words", F.sum("words").over(Window.partitionBy("row", "island", "part")))
    kept = whole.filter(F.col("all_words") >= min_words)
    # islands are told apart by the line at which they would begin
    out = stage(kept.withColumn("island", F.min("line").over(Window.partitionBy("row", "island", "part"))).select(*repeated.columns), "line-base", codec="lz4")
    drop_staged(pairs)
    drop_staged(again)
    return out


def prefix_doubling(lines: DataFrame, min_words: int | None = None) -> DataFrame:
    """``row, doc_id, island, line, words, ranks, sums`` of the lines that repeat; with ``min_words`` in their :func:`long_stretches` alone.

    ``ranks[k]`` orders the suffixes by their first ``2**k`` lines (the island's end is
    before all lines), ``sums[k]`` are the words of those. The last rank orders whole
    suffixes: doubling ends when no class splits. A level is a sort of distinct pairs
    of ranks and a join, of narrow rows; what it was made of is deleted when it is
    written, and the levels when they are put together at the end.
    """
    repeated = repeated_lines(lines).select("row", "doc_id", "island", "line", "words", "rank")
    base = long_stretches(repeated, min_words) if min_words else stage(repeated, "line-base", codec="lz4")
    level = base.select("row", "island", "line", "rank", F.col("words").cast("long").alias("sum"))
    levels, classes, step = [level], -1, 1
    by_island = Window.partitionBy("row", "island").orderBy("line")
    while True:
        ahead = lambda c, none, step=step: F.coalesce(F.lead(c, step).over(by_island), F.lit(none))
        pairs = levels[-1].select("row", "island", "line", F.col("rank").alias("left"), ahead("rank", -1).alias("right"), (F.col("sum") + ahead("sum", 0)).alias("sum"))
        pairs = stage(pairs, "line-pairs", codec="lz4")
        found = pairs.groupBy("left", "right").agg(F.lit(1)).select(F.col("left").alias("f_left"), F.col("right").alias("f_right"))
        ranks = stage(found.repartitionByRange("f_left", "f_right").sortWithinPartitions("f_left", "f_right").withColumn("rank", F.monotonically_increasing_id()), "line-ranks", codec="lz4")
        before, classes = classes, ranks.count()
        if classes == before:
            drop_staged(pairs)
            drop_staged(ranks)
            break
        joined = join_small(pairs, ranks, (F.col("left") == F.col("f_left")) & (F.col("right") == F.col("f_right")))
        levels.append(stage(joined.select("row", "island", "line", "rank", "sum"), "line-level", codec="lz4"))
        drop_staged(pairs)
        drop_staged(ranks)
        step *= 2
    each = reduce(DataFrame.unionByName, [x.select("row", "line", F.struct(F.lit(k).alias("k"), "rank", "sum").alias("x")) for k, x in enumerate(levels)])
    ladder = each.groupBy("row", "line").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = stage(base.drop("rank").join(ladder, ["row", "line"]).select("row", "doc_id", "island", "line", "words", F.col("x.rank").alias("ranks"), F.col("x.sum").alias("sums")), "line-suffixes", codec="lz4")
    drop_staged(base)
    for x in levels[1:]:
        drop_staged(x)
    return whole


def suffix_array(level: DataFrame) -> DataFrame:
    """``level`` with ``place``: 1, 2, ... in the order of suffixes; equal ones by document, row and line."""
    return global_rank(level.withColumn("rank", F.element_at("ranks", -1)), ["rank", "doc_id", "row", "line"], "place")


def _power(k: Column) -> Column:
    """Lines of a run of level ``k``."""
    return F.call_function("shiftleft", F.lit(1), k)


def common_prefixes(level: DataFrame, placed: DataFrame, min_words: int) -> DataFrame:
    """``place, row, line, p_row, p_line, lcp, lcp_words`` of neighbours in the suffix array that share at least ``min_words`` words.

    The prefix grows by the longest power of two that still agrees: classes of equal
    first lines are looked up where the prefix ends, for pairs that can still reach
    the words.
    """
    rank, most = F.element_at("ranks", -1), F.size("ranks")
    here = placed.select("place", "row", "line", "ranks", "sums", rank.alias("last"))
    prev = placed.select((F.col("place") + 1).alias("place"), F.col("row").alias("p_row"), F.col("line").alias("p_line"), F.col("ranks").alias("p_ranks"), rank.alias("p_last"))
    agreed = F.size(F.filter(F.zip_with("ranks", "p_ranks", lambda a, b: a == b), lambda x: x))
    pairs = here.join(prev, "place").withColumn("agreed", agreed).filter("agreed > 0")
    # two suffixes that are one to their ends agree in all levels, and the last sum is of the whole suffix
    reach = F.element_at("sums", F.least(F.col("agreed") + 1, most))
    pairs = stage(pairs.filter(reach >= min_words).withColumn("lcp", F.lit(0)).withColumn("lcp_words", F.lit(0).cast("long")), "line-neighbours")
    left = level.groupBy("row", "island").agg(F.max("line").alias("end"))
    ends = stage(level.select("row", "line", "island").join(left, ["row", "island"]).select("row", "line", (F.col("end") - F.col("line") + 1).alias("left")), "line-ends")
    whole = pairs.filter("last = p_last").join(ends, ["row", "line"]).select("place", "row", "line", "p_row", "p_line", F.col("left").cast("int").alias("lcp"), F.element_at("sums", -1).alias("lcp_words"))
    done, rest = [whole], pairs.filter("last <> p_last")
    look = level.select("row", "line", "ranks", "sums")
    while True:
        grown = rest.select("place", "row", "line", "p_row", "p_line", (F.col("lcp") + _power(F.col("agreed") - 1)).alias("lcp"), (F.col("lcp_words") + F.element_at("sums", F.col("agreed"))).alias("lcp_words"))
        a = look.select(F.col("row").alias("a_row"), F.col("line").alias("a_line"), "ranks", "sums")
        b = look.select(F.col("row").alias("b_row"), F.col("line").alias("b_line"), F.col("ranks").alias("p_ranks"))
        met = grown.join(a, (F.col("row") == F.col("a_row")) & (F.col("line") + F.col("lcp") == F.col("a_line")), "left").join(b, (F.col("p_row") == F.col("b_row")) & (F.col("p_line") + F.col("lcp") == F.col("b_line")), "left")
        met = stage(met.withColumn("agreed", F.coalesce(agreed, F.lit(0))).drop("a_row", "a_line", "b_row", "b_line", "p_ranks"), "line-prefixes")
        done.append(met.filter("agreed <= 0").select("place", "row", "line", "p_row", "p_line", "lcp", "lcp_words"))
        rest = met.filter("agreed > 0").filter(F.col("lcp_words") + F.element_at("sums", F.least(F.col("agreed") + 1, F.size("ranks"))) >= min_words)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done).filter(F.col("lcp_words") >= min_words)


def maximal_runs(prefixes: DataFrame) -> DataFrame:
    """``row, line, length``: the longest run from each line that occurs again, where the line before does not begin a longer one of it."""
    both = prefixes.select("row", "line", "lcp").unionByName(prefixes.select(F.col("p_row").alias("row"), F.col("p_line").alias("line"), "lcp"))
    longest = both.groupBy("row", "line").agg(F.max("lcp").alias("length"))
    before = Window.partitionBy("row").orderBy("line")
    part = (F.lag("line").over(before) == F.col("line") - 1) & (F.lag("length").over(before) == F.col("length") + 1)
    return longest.withColumn("part", F.coalesce(part, F.lit(False))).filter("NOT part").drop("part")


def least_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, doc_id, line, length``: from each line, and up to each line, the least run of ``min_words`` words.

    ``lines`` are those that repeat; a run has no gap. Each repeated run of so many
    words is the union of the least runs in it. As a line has a word, a frame of
    ``min_words`` rows holds the run.
    """
    by_row = Window.partitionBy("row").orderBy("line")
    gap = lines.withColumn("island", F.col("line") - F.row_number().over(by_row))
    run = Window.partitionBy("row", "island").orderBy("line")
    upto = gap.withColumn("upto", F.sum("words").over(run))
    ahead = F.collect_list("upto").over(run.rowsBetween(0, min_words - 1))
    back = F.collect_list(F.col("upto") - F.col("words")).over(run.rowsBetween(1 - min_words, 0))
    both = upto.select("row", "doc_id", "line", "upto", "words", ahead.alias("ahead"), back.alias("back"))
    forward = F.size(F.filter("ahead", lambda x: x < F.col("upto") - F.col("words") + min_words))
    backward = F.size(F.filter("back", lambda x: x > F.col("upto") - min_words))
    ends = F.array(F.when(forward < F.size("ahead"), F.struct(F.col("line").alias("line"), (forward + 1).alias("length"))), F.when(backward < F.size("back"), F.struct((F.col("line") - backward).alias("line"), (backward + 1).alias("length"))))
    return both.select("row", "doc_id", F.explode(F.array_distinct(F.array_compact(ends))).alias("r")).select("row", "doc_id", "r.line", "r.length").distinct()


def _named(length: Column) -> Column:
    """The level whose runs overlap over one of ``length`` lines."""
    return F.floor(F.log2(length) + 1e-9).cast("int")


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, line, length``: least runs of repeated lines that are not the first of their kind by ``doc_id, row, line``.

    A maximal run is the union of the least runs in it, so the lines under them are
    those of the later copies of all maximal repeated runs.
    """
    level = prefix_doubling(lines, min_words)
    placed = suffix_array(level)
    prefixes = common_prefixes(level, placed, min_words)
    runs = stage(maximal_runs(prefixes).withColumnsRenamed({"row": "m_row", "line": "m_line"}), "line-maximal")
    drop_staged(prefixes)
    drop_staged(placed)
    before = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = level.select("row", "doc_id", "line", "words").join(runs, (F.col("row") == F.col("m_row")) & (F.col("line") == F.col("m_line")), "left").withColumn("upto", F.max(F.col("line") + F.col("length")).over(before)).filter(F.col("line") < F.col("upto")).select("row", "doc_id", "line", "words")
    k = _named(F.col("length"))
    asked = least_runs(inside, min_words).withColumn("k", k).withColumn("second", F.col("line") + F.col("length") - _power(k))
    look = level.select("row", "line", "ranks")
    left = asked.join(look, ["row", "line"]).withColumn("left", F.element_at("ranks", F.col("k") + 1)).drop("ranks")
    both = left.join(look.withColumnRenamed("line", "second"), ["row", "second"]).withColumn("right", F.element_at("ranks", F.col("k") + 1))
    both = stage(both.select("row", "doc_id", "line", "length", "left", "right"), "line-intervals")
    drop_staged(level)
    drop_staged(runs)
    at = F.struct("doc_id", "row", "line")
    kinds = both.groupBy("length", "left", "right").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kinds = stage(kinds.withColumnsRenamed({c: f"k_{c}" for c in ("length", "left", "right")}), "line-kinds")
    on = (F.col("length") == F.col("k_length")) & (F.col("left") == F.col("k_left")) & (F.col("right") == F.col("k_right"))
    return join_small(both, kinds, on).filter(~at.eqNullSafe(F.col("first"))).select("row", "line", "length")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``dedup_text, n_lines, n_deleted``: later copies of repeated line runs taken out.

    A run is at least ``min_words`` words in consecutive lines that have words; the
    first copy by document id (null first) and place stays. Rows that repeat an id
    are documents of their own. Null and empty texts have no lines; the null stays
    null. Blank lines are neither counted nor deleted. Own columns of these three
    names are replaced, all others are kept whatever their names. A text without
    deletions is unchanged. An empty table gives no rows.
    """
    docs = without(docs, "dedup_text", "n_lines", "n_deleted")
    held = stage(carried(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "line-docs")
    lines = stage(numbered_lines(held.select("row", "doc_id", "text")), "line-lines")
    gone = later_copies(lines.select("row", "doc_id", "line", "words", "id_a", "id_b"), min_words)
    gone = gone.select("row", F.explode(F.sequence("line", F.col("line") + F.col("length") - 1)).alias("line")).distinct()
    places = gone.join(lines.select("row", "line", "pos"), ["row", "line"]).groupBy("row").agg(F.collect_set("pos").alias("q__gone")).withColumnRenamed("row", "q__gone_row")
    places = stage(places, "line-gone")
    drop_staged(gone)
    drop_staged(lines)
    out = join_small(held, places, F.col("row") == F.col("q__gone_row"), "left")
    split = F.split("text", "\n", -1)
    kept = F.when(F.col("q__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains("q__gone", i)), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^ \t\x0b\x0c\r]"))).cast("long")
    return out.select(*restored(docs, "doc_id", "text"), kept.alias("dedup_text"), n_lines.alias("n_lines"), F.when(F.col("q__gone").isNull(), 0).otherwise(F.size("q__gone")).cast("long").alias("n_deleted"))
