"""Quality rules by robust multivariate outliers, with DataFrame operations only.

Each document gives a vector of statistics that every ordinary text has: its mean word
length, and the shares of short words, of words with an upper-case letter, of words with
a sign or digit, and of words that are new among fifty. Shares become logits with a
half count. A statistic of n words varies by a + b / n; a and b are estimated per
language from the spreads of its shorter and its longer documents, and each entry is
centred and scaled by them. On these vectors the minimum-covariance-determinant
estimate gives each language, and each source of it, a centre and a covariance:
concentration steps run from two deterministic starts until they stand still, and the
least determinant wins. Documents far from their source's estimate by Mahalanobis
distance are rejected.

As in the regularised form of the estimate, a small share of every covariance is the
unit matrix of the scaled entries, and a source's estimate is drawn towards its
language's by the weight of a few documents, so that small sources have one too.
A step is two aggregations with a row per group and start: hot groups are summed
map-side and no group meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, carried, join_small, let, restored, spaced, stage, without, words

SYMBOLS = "#*$%&|<>"
#: Entries of the vector; all but the first are logits of a count among the words.
VECTOR = ("v_len", "v_short", "v_capital", "v_marked", "v_new")
#: Letters of a short word at most, and words among which one is new.
SHORT, STRETCH = 3, 50
#: Least variance of an entry for one word: of a logit at a share of one half, and of the log length.
LEAST_WORD = {"v_len": 0.01} | {v: 4.0 for v in VECTOR[1:]}
#: Least variance between long documents, as a share of that of a document of middle length.
LEAST_BETWEEN = 0.1
#: Share of the unit matrix in a covariance.
UNIT = 0.1
#: Variance below which a factor is held against rounding; never reached while UNIT is above it.
NOISE = 1e-8
#: Share of a group that a concentration step keeps; bound of steps; change of the log determinant at which a start stands still.
KEEP, MOST_STEPS, STILL = 0.75, 30, 1e-4
#: Rows that a language needs for an estimate, and a source; documents by whose weight a source is drawn to its language.
MIN_LANGUAGE, MIN_SOURCE, DRAWN = 50, 20, 50
#: Chi-square quantiles with five degrees of freedom: 0.975, and all but 1 in 10 ** 8.
INNER, FAR = 12.8325, 45.7946
#: Consistency of a covariance that was taken over the inner 75 % in five dimensions: 0.75 / P(chi2 with seven
#: degrees <= the 0.75 quantile with five), and of one within INNER.
CONSISTENCY, INNER_CONSISTENCY = 0.75 / 0.531135, 1.055533
MIN_WORDS, MAX_REPEAT_PCT = 50, 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_short", "n_capital", "n_marked", "n_new")


def _covered(starts: Column) -> Column:
    """Words under three-word windows that begin at the sorted positions ``starts``."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).cast("long").alias("n"), s.alias("last")),
    )
    return step["n"]


def _repeat_words(tokens: Column) -> Column:
    """Words in three-word windows that occur at least twice among ``tokens``."""

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda p: F.filter(p, lambda x, i: ((i > 0) & (p[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(p) - 1) & (p[F.least(i + 1, F.size(p) - 1)]["h"] == x["h"])))
        slow = let(placed, lambda p: _covered(F.sort_array(F.transform(twice(p), lambda x: x["i"]))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(slow)

    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]))
    return F.when(F.size(tokens) >= 4, let(hashes, counted)).otherwise(F.lit(0).cast("long"))


def _new_words(tokens: Column) -> Column:
    """Distinct words of each stretch of ``STRETCH`` words, summed."""
    begins = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / STRETCH).cast("int"))
    total = F.aggregate(begins, F.lit(0), lambda n, k: n + F.size(F.array_distinct(F.slice(tokens, k * STRETCH + 1, STRETCH))))
    return F.when(F.size(tokens) > 0, total).otherwise(0).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``STATISTICS``: counts of words, of characters in words, symbols, repeated lines, words in repeated windows, short words, words with an upper-case letter, words with anything but letters, and new words.

    One pass, no shuffle. Null and empty texts count 0 in each. Windows are told
    apart by a 64-bit hash within one text.
    """
    docs = without(docs, *STATISTICS)
    blank = F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))
    bare = blank
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    some = lambda w, test: F.size(F.filter(w, test)).cast("long")

    def counted(w: Column) -> Column:
        kinds = {"short": lambda x: F.length(x) <= SHORT, "capital": lambda x: x.rlike(r"\p{Lu}"), "marked": lambda x: x.rlike(r"[^\p{L}]")}
        return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("rep"), _new_words(w).alias("new"), *[some(w, t).alias(k) for k, t in kinds.items()])

    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    chars = let(blank, lambda b: F.length(b).cast("long"))
    parts = docs.withColumns({"q__word": let(words(F.col("text")), counted), "q__dup": dup, "q__chars": chars, "q__bare": F.length(bare).cast("long")})
    found = {"n_words": "q__word.n", "word_chars": "q__chars", "n_dup_lines": "q__dup", "n_repeat_words": "q__word.rep", "n_short": "q__word.short", "n_capital": "q__word.capital", "n_marked": "q__word.marked", "n_new": "q__word.new"}
    columns = {name: F.col(c) for name, c in found.items()} | {"n_symbols": F.col("q__chars") - F.col("q__bare")}
    return parts.select(*docs.columns, *[columns[name].alias(name) for name in STATISTICS])


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """The entries before they are scaled: log mean word length, and logits of the shares with a half count."""
    n = F.col("n_words")
    logit = lambda c: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    return {"v_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(n, F.lit(1)))} | {f"v_{c}": logit(f"n_{c}") for c in ("short", "capital", "marked", "new")}


_N = range(len(VECTOR))
_PAIRS = [(i, j) for i in _N for j in range(i + 1)]


def _factored(covariance: dict[tuple[int, int], Column], out: DataFrame) -> DataFrame:
    """``out`` with the Cholesky factor ``l_ij`` of a covariance and its ``log_det``."""
    for i, j in _PAIRS:
        value = covariance[i, j]
        for k in range(j):
            value = value - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(value, F.lit(NOISE * 1e-3))) if i == j else value / F.col(f"l_{j}{j}"))
    return out.withColumn("log_det", sum((2 * F.log(f"l_{i}{i}") for i in _N), F.lit(0.0)))


def _estimate(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Per key the means ``m_i``, regularised covariances ``c_ij`` and their factor of ``rows``, summed around the ``m_i`` that they come with."""
    off = [F.col(v) - F.col(f"m_{i}") for i, v in enumerate(VECTOR)]
    sums = [F.first(f"m_{i}").alias(f"m_{i}") for i in _N] + [F.avg(off[i]).alias(f"a_{i}") for i in _N] + [F.avg(off[i] * off[j]).alias(f"p_{i}{j}") for i, j in _PAIRS]
    made = rows.groupBy(*keys).agg(*sums)
    covariance = [((F.col(f"p_{i}{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")) * (scale * (1 - UNIT)) + (UNIT if i == j else 0.0)).alias(f"c_{i}{j}") for i, j in _PAIRS]
    out = made.select(*keys, *[(F.col(f"m_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in _N], *covariance)
    return _factored({(i, j): F.col(f"c_{i}{j}") for i, j in _PAIRS}, out)


def _squared_distance() -> Column:
    """The Mahalanobis distance of the vector to ``m_i`` under the factor ``l_ij``, squared (forward substitution)."""
    z: list[Column] = []
    for i, v in enumerate(VECTOR):
        value = F.col(v) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}{k}") * z[k]
        z.append(value / F.col(f"l_{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def _joined(rows: DataFrame, known: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the row of ``known`` of their key; ``few``: there are so few keys that it is broadcast."""
    renamed = known.withColumnsRenamed({k: f"e_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"e_{k}"))
    return rows.join(F.broadcast(renamed) if few else renamed, on).drop(*[f"e_{k}" for k in keys])


def _near(rows: DataFrame, estimate: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with ``d2`` by the estimate of their key."""
    known = estimate.select(*keys, *[f"m_{i}" for i in _N], *[f"l_{i}{j}" for i, j in _PAIRS])
    return _joined(rows, known, keys, few).select(*rows.columns, *[f"m_{i}" for i in _N], _squared_distance().alias("d2"))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Two starts per ``gid`` at its medians: the unit matrix, and the covariance of spatial signs."""
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = stage(rows.groupBy("gid").agg(*[median(F.col(v)).alias(f"m_{i}") for i, v in enumerate(VECTOR)]), "mcd-median")
    zero = F.lit(0.0)
    first = _factored({(i, j): F.lit(1.0 if i == j else 0.0) for i, j in _PAIRS}, centre).withColumn("start", F.lit(1))
    off = [F.col(v) - F.col(f"m_{i}") for i, v in enumerate(VECTOR)]
    norm2 = sum((o * o for o in off), zero)
    signs = _joined(rows, centre, ["gid"], few).select("gid", *[f"m_{i}" for i in _N], *[F.try_divide(off[i] * off[j], norm2).alias(f"u_{i}{j}") for i, j in _PAIRS])
    shape = signs.groupBy("gid").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in _N], *[F.coalesce(F.avg(f"u_{i}{j}"), zero).alias(f"u_{i}{j}") for i, j in _PAIRS])
    second = _factored({(i, j): F.col(f"u_{i}{j}") * (len(VECTOR) * (1 - UNIT)) + (UNIT if i == j else 0.0) for i, j in _PAIRS}, shape).withColumn("start", F.lit(2))
    kept = ["gid", "start", *[f"m_{i}" for i in _N], *[f"l_{i}{j}" for i, j in _PAIRS], "log_det"]
    return first.select(*kept).unionByName(second.select(*kept))


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``gid`` from rows with the vector entries: ``gid, m_i, c_ij, l_ij, log_det``.

    A concentration step keeps the rows within the group's quantile of the distance
    and estimates anew, for both starts at once, each until its determinant stands
    still; the next step is for those that moved. One that still moves after
    ``MOST_STEPS`` steps is taken as it is then. The start of least determinant is
    reweighted: the result is taken from the rows within its
    0.975 chi-square quantile. The quantiles are of Spark's mergeable sketch (exact up
    to 10,000 rows), so no group is sorted in one place; ties at one all stay.
    """
    keys = ["gid", "start"]
    few = rows.select("gid").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    now = stage(_starts(rows, few), "mcd-start")
    tried = rows.withColumn("start", F.explode(F.array(F.lit(1), F.lit(2))))
    still: list[DataFrame] = []
    for _ in range(MOST_STEPS):
        far = _near(tried, now, keys, few)
        inner = far.groupBy(*keys).agg(F.percentile_approx("d2", KEEP, 10_000).alias("inner_d2"))
        core = _joined(far, inner, keys, few).filter(F.col("d2") <= F.col("inner_d2"))
        step = _joined(_estimate(core, keys, CONSISTENCY), now.select(*keys, F.col("log_det").alias("was")), keys, few)
        step = stage(step.withColumn("moved", F.abs(F.col("log_det") - F.col("was")) > STILL).drop("was"), "mcd-step")
        still.append(step.filter("NOT moved"))
        now = step.filter("moved")
        if now.isEmpty():
            break
    else:
        still.append(now)
    ended = reduce(DataFrame.unionByName, still).drop("moved")
    best = ended.groupBy("gid").agg(F.min(F.struct("log_det", "start")).alias("b")).select("gid", F.col("b.start").alias("start"))
    chosen = ended.join(best, keys).drop("start")
    return stage(_estimate(_near(rows, chosen, ["gid"], few).filter(F.col("d2") <= INNER), ["gid"], INNER_CONSISTENCY), "mcd-final")


def groups_of(rows: DataFrame) -> DataFrame:
    """``g_lang, g_source, t_id, gid, n_own`` of each pair in ``rows`` (``lang, source, fits``): the names of its language's scale and estimate and of its source's.

    A language with fewer than ``MIN_LANGUAGE`` rows that fit is judged by all languages,
    and nobody by fewer than that; a source with fewer than ``MIN_SOURCE`` has no estimate of its own.
    """
    pairs = rows.groupBy("lang", "source").agg(F.count_if("fits").alias("n_own"))
    languages = pairs.groupBy("lang").agg(F.sum("n_own").alias("n_lang")).withColumnRenamed("lang", "l_lang")
    total = pairs.agg(F.coalesce(F.sum("n_own"), F.lit(0)).alias("n_all")).withColumn("one", F.lit(1))
    sized = pairs.join(languages, F.col("lang").eqNullSafe(F.col("l_lang"))).withColumn("q__one", F.lit(1)).join(F.broadcast(total), F.col("q__one") == F.col("one"))
    named = lambda level, *c: F.to_json(F.struct(F.lit(level).alias("level"), *c))
    t_id = F.when(F.col("n_lang") >= MIN_LANGUAGE, named("language", "lang")).when(F.col("n_all") >= MIN_LANGUAGE, named("all"))
    gid = F.when(t_id.isNotNull() & (F.col("n_own") >= MIN_SOURCE), named("source", "lang", "source"))
    return stage(sized.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), t_id.alias("t_id"), gid.alias("gid"), "n_own"), "mcd-groups")


def scales(rows: DataFrame) -> DataFrame:
    """Per ``t_id`` the medians ``s_i`` of the entries of ``rows``, and the variances ``b_i`` between long documents and ``w_i`` of one word.

    Median deviations of the half with fewer words and of the other give two variances;
    they are ``b + w / n`` at the halves' means of 1 / n.
    """
    few = rows.select("t_id").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = stage(rows.groupBy("t_id").agg(*[median(F.col(v)).alias(f"s_{i}") for i, v in enumerate(VECTOR)], median(F.col("n_words")).alias("cut")), "mcd-centres")
    off = [F.abs(F.col(v) - F.col(f"s_{i}")) for i, v in enumerate(VECTOR)]
    halves = {"lo": F.col("n_words") <= F.col("cut"), "hi": F.col("n_words") > F.col("cut")}
    inverse = 1 / F.greatest(F.col("n_words"), F.lit(1))
    spreads = [F.pow(1.4826 * median(F.when(half, o)), F.lit(2.0)).alias(f"{name}_{i}") for name, half in halves.items() for i, o in enumerate(off)]
    per_word = [F.avg(F.when(half, inverse)).alias(f"{name}_n") for name, half in halves.items()]
    found = _joined(rows, centre, ["t_id"], few).groupBy("t_id").agg(*[F.first(f"s_{i}").alias(f"s_{i}") for i in _N], F.first("cut").alias("cut"), *spreads, *per_word)
    out = found
    for i, v in enumerate(VECTOR):
        slope = F.try_divide(F.col(f"lo_{i}") - F.col(f"hi_{i}"), F.col("lo_n") - F.col("hi_n"))
        # where all have one length there is no other half, and all of the variance is taken as the words'
        out = out.withColumn(f"w_{i}", F.greatest(F.coalesce(slope, F.col(f"lo_{i}") / F.col("lo_n")), F.lit(LEAST_WORD[v])))
        between = F.coalesce(F.col(f"hi_{i}") - F.col(f"w_{i}") * F.col("hi_n"), F.lit(0.0))
        out = out.withColumn(f"b_{i}", F.greatest(between, LEAST_BETWEEN * F.col(f"w_{i}") / F.greatest(F.col("cut"), F.lit(1))))
    return stage(out.select("t_id", *[f"{x}_{i}" for i in _N for x in "sbw"]), "mcd-scales")


def scaled() -> dict[str, Column]:
    """The entries centred and scaled by the row's ``s_i, b_i, w_i``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {v: (F.col(v) - F.col(f"s_{i}")) / F.sqrt(F.col(f"b_{i}") + F.col(f"w_{i}") / n) for i, v in enumerate(VECTOR)}


def drawn_estimates(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``groups`` with the ``m_i, c_ij, l_ij`` that judge them: the source's, drawn to its language's by the weight of ``DRAWN`` documents."""
    names = [*[f"m_{i}" for i in _N], *[f"c_{i}{j}" for i, j in _PAIRS]]
    of = lambda p: known.select(F.col("gid").alias(f"{p}_gid"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    both = groups.join(of("t"), F.col("t_id") == F.col("t_gid"), "left").join(of("o"), F.col("gid") == F.col("o_gid"), "left")
    weight = F.when(F.col("o_gid").isNotNull(), F.col("n_own") / (F.col("n_own") + DRAWN)).otherwise(0.0)
    mixed = both.withColumn("q__own", weight).select("g_lang", "g_source", "t_id", *[(F.col("q__own") * F.coalesce(f"o_{c}", F.lit(0.0)) + (1 - F.col("q__own")) * F.col(f"t_{c}")).alias(c) for c in names])
    return _factored({(i, j): F.col(f"c_{i}{j}") for i, j in _PAIRS}, mixed)


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``outlier_d2`` and ``kept``.

    ``kept`` is false where a base rule fails, else true within the chi-square quantile
    ``FAR`` of the estimate for the document's language and source. Estimates are fitted on
    all documents that pass the base rules; null
    language or source form groups of their own, small sources are judged by their
    language and small languages by all, and where there are fewer than ``MIN_LANGUAGE`` documents in all the base rules
    decide alone. Repeated rows are judged alike. Own columns of the names that are
    added are replaced, all others are kept whatever their names. Empty tables give
    no rows.
    """
    read = ("doc_id", "text", "lang", "source")
    docs = without(docs, *STATISTICS, "base_failed", "outlier_d2", "kept")
    rows = stage(text_statistics(carried(docs, *read)).withColumn("base_failed", base_failed()).withColumns(statistics()), "quality-stats")
    vectors = rows.select("lang", "source", "n_words", (~F.col("base_failed")).alias("fits"), *VECTOR)
    groups = groups_of(vectors)
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    named = join_small(vectors.filter("fits"), groups.filter("t_id IS NOT NULL"), same)
    scale = scales(named.select("t_id", "n_words", *VECTOR))
    fit = join_small(named, scale.withColumnRenamed("t_id", "s_id"), F.col("t_id") == F.col("s_id")).withColumns(scaled())
    fit = stage(fit.select(F.explode(F.array_compact(F.array("t_id", "gid"))).alias("gid"), *VECTOR), "quality-fit")
    by_group = drawn_estimates(groups, estimates(fit)).join(scale.withColumnRenamed("t_id", "s_id"), F.col("t_id") == F.col("s_id"), "left").drop("t_id", "s_id", "log_det")
    near = join_small(rows, stage(by_group, "quality-groups"), same, "left").withColumns(scaled())
    far = near.withColumn("outlier_d2", _squared_distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("outlier_d2") <= FAR, F.lit(True))
    return far.select(*restored(docs, *read), *STATISTICS, "base_failed", "outlier_d2", kept.alias("kept"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their own columns alone."""
    read = ("doc_id", "text", "lang", "source")
    rows = carried(docs, *read)
    return judged(rows).filter("kept").select(*restored(docs, *read))
