"""Exact n-gram Jaccard join by token-combination prefixes.

Tokens are 64-bit hashes of word shingles. In a global order with rare tokens
first, two sets at the threshold share part of their prefixes. Rare tokens are
indexed alone, with prefixes extended so that partners share several of them;
where a set has too few, its prefix goes on over the classes of frequent tokens,
of which pairs are indexed. Sets that share enough signatures in short lists are
candidate pairs, those of the long lists with one least set are a candidate group;
both are compared exactly. Components of pairs are one task each, bigger ones are
dealt by pairs, so that chains of pairs cost no more than their pairs. Copies of one
set are joined as one member, big groups are compared in blocks, and only links that
join something are kept.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, join_sieved, join_small, python_batches, restored, stage
from .graph import connected_components

SHINGLE = 3
#: Two sets link at ``100 * intersection >= PERCENT * union``.
PERCENT = 90
#: Sets in whose windows a token must be to count as frequent.
FREQUENT = 8
#: Sets of one signature that are paired; longer lists are groups with their least set.
SHORT_LIST = 16
#: Frequent tokens of a prefix that fall in one subclass, about; pairs are made inside subclasses.
SUBCLASS = 8
#: Bytes and number of sets in one block of a candidate class, about.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 1000
#: Rows of two or three numbers below which a table is broadcast.
NARROW_ROWS = 50_000
#: The same for rows that hold a list of tokens.
WIDE_ROWS = 1000
#: Tokens shared by more sets than this are multiplied as a matrix, others are paired.
PAIRED = 24
#: Columns of that matrix at a time.
COLUMNS = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than ``width`` make one, none make none."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    row = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            row = _mixed(row + hashes[k : k + n] * _K[k % 3] + np.uint64(k + 1))
    return np.unique(row)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def least_linkable(percent: int = PERCENT) -> int:
    """Size below which a set links with equal sets only."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 30


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens of a prefix that cannot all be missing from a partner."""
    return n - least_shared(n, percent) + 1


def window_length(n: int, percent: int = PERCENT) -> int:
    """Tokens looked at first for a prefix of rare tokens."""
    return min(n, 2 * needed(n, percent) + 8)


def signatures(tokens: np.ndarray, frequent: dict[int, int], n: int, whole: bool, percent: int = PERCENT) -> tuple[np.ndarray, int] | None:
    """Signatures of a set from its tokens in hash order, and how many of them a partner shares at least.

    ``frequent`` gives the class of a frequent token, by its number of sets. The
    order is rare tokens, then frequent ones by class, each by hash. A prefix of
    ``needed + k`` rare tokens shares ``k + 1`` with a partner; a quarter more than
    needed is taken where there are so many. With fewer than needed the prefix goes
    on: a rare token adds one to what the signatures cover, ``c`` frequent tokens of
    one class and subclass add ``c - 1`` as pairs; classes and subclasses are so few
    that a whole set always covers ``need``. That takes the ``whole`` set; of a window
    that does not suffice the result is None.
    """
    need = needed(n, percent)
    level = np.fromiter((frequent.get(int(t), 0) for t in tokens), np.int64, len(tokens)) if frequent else np.zeros(len(tokens), np.int64)
    rare = tokens[level == 0]
    if len(rare) >= need:
        rare = rare[: need + need // 4]
        return rare, len(rare) - need + 1
    if not whole:
        return None
    order = np.lexsort((tokens, level))
    common = [(int(level[i]), int(tokens[i])) for i in order if level[i]]
    out = [rare]
    # Partners' sizes may fall in a neighbouring scale; both then index with the scale they share.
    for scale in {int(n * percent // 100).bit_length(), n.bit_length(), int(n * 100 // percent + 1).bit_length()}:
        groups = max(1, (1 << scale) // (10 * SUBCLASS))
        inside: dict[tuple[int, int], list[int]] = {}
        covered = len(rare)
        for c, t in common:
            row = inside.setdefault((c, t % groups), [])
            covered += bool(row)
            row.append(t)
            if covered >= need:
                break
        pairs = [p for row in inside.values() for p in combinations(row, 2)]
        if pairs:
            both = np.array(pairs, np.uint64)
            with np.errstate(over="ignore"):
                out.append(_mixed(both[:, 0] * _K[0] + _mixed(both[:, 1] + np.uint64(scale))))
    return np.unique(np.concatenate(out)), 1


def linked_roots(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first set of its component under exact links among ``sets``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    tokens = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(tokens)])
    shared = np.zeros((n, n), np.float32)
    flat = shared.reshape(-1)
    for c in range(2, PAIRED + 1):
        at = first[counts == c]
        if len(at):
            rows = owner[at[:, None] + np.arange(c)]
            for i, j in combinations(range(c), 2):
                np.add.at(flat, rows[:, i] * n + rows[:, j], 1)
    many = np.flatnonzero(counts > PAIRED)
    for at in range(0, len(many), COLUMNS):
        part = many[at : at + COLUMNS]
        column = np.repeat(np.arange(len(part)), counts[part])
        places = np.concatenate([np.arange(first[k], first[k] + counts[k]) for k in part])
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[owner[places], column] = 1
        shared += np.triu(matrix @ matrix.T, 1)
    link = np.zeros((n, n), bool)
    for i in range(n):  # a row at a time, so that no second square of wide numbers is needed
        row = shared[i, i + 1 :]
        link[i, i + 1 :] = (row > 0) & (100 * row.astype(np.int64) >= percent * (sizes[i] + sizes[i + 1 :] - row.astype(np.int64)))
    del shared, flat
    link |= link.T
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(link[front].any(axis=0) & (root < 0))
            root[front] = start
    return root


_SET_FIELDS = "doc_id long, n_shingles long, sig_a long, sig_b long, window array<long>"


def document_sets(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles``, a 128-bit signature of the set, and the window of its least hashes."""

    def rows(batches):
        from xxhash import xxh3_128_intdigest

        least = least_linkable(percent)
        for batch in batches:
            n, a, b, windows = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, width)
                digest = xxh3_128_intdigest(tokens.tobytes())
                n.append(len(tokens))
                a.append((digest >> 64) - (1 << 63))
                b.append((digest & ((1 << 64) - 1)) - (1 << 63))
                windows.append(tokens[: window_length(len(tokens), percent)].view(np.int64) if len(tokens) >= least else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "sig_a": pa.array(a, pa.int64()), "sig_b": pa.array(b, pa.int64()), "window": pa.array(windows, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _SET_FIELDS)


def _whole_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Columns of ``members`` (with ``node``) and ``tokens``: the set of the document with that id, as bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = join_sieved(texts, "doc_id", members, "node", F.col("doc_id") == F.col("node")).drop("doc_id")
    extra = [f for f in wanted.schema.fields if f.name != "text"]

    def rows(batches):
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            kept = batch.select([f.name for f in extra])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "tokens"])

    return wanted.mapInArrow(rows, T.StructType([*extra, T.StructField("tokens", T.BinaryType())]))


def _signature_rows(sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """``node, sig, least``: each signature, and how many a partner shares at least."""

    def rows(batches):
        for batch in batches:
            nodes, sigs, shared = [], [], []
            for node, n, tokens, frequent in zip(batch.column("node").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("window"), batch.column("frequent").to_pylist(), strict=True):
                values = np.sort(np.asarray(tokens.values, dtype=np.int64).view(np.uint64))
                found, least = signatures(values, {f["token"] & ((1 << 64) - 1): f["level"] for f in frequent or ()}, n, whole or len(values) == n, percent)
                nodes.append(np.full(len(found), node, np.int64))
                shared.append(np.full(len(found), least, np.int64))
                sigs.append(found.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(nodes)), "sig": pa.array(np.concatenate(sigs)), "least": pa.array(np.concatenate(shared))})

    return sets.select("node", "n_shingles", "window", "frequent").mapInArrow(rows, "node long, sig long, least long")


def _frequent(sets: DataFrame) -> DataFrame:
    """``token, level`` of the tokens in at least ``FREQUENT`` windows; a level for each eightfold number."""
    counts = sets.select(F.explode("window").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    return counts.select("token", F.least(F.lit(5), F.floor(F.log2(F.col("n") / FREQUENT) / 3) + 1).cast("int").alias("level"))


def _matched(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """``node, token, level`` of the ``frequent`` tokens in the windows of ``sets``."""
    tokens = sets.select("node", F.explode("window").alias("token"))
    return join_sieved(tokens, "token", frequent.withColumnRenamed("token", "f_token"), "f_token", F.col("token") == F.col("f_token"), rows=NARROW_ROWS).drop("f_token")


def _with_frequent(sets: DataFrame, matched: DataFrame) -> DataFrame:
    """``sets`` with ``frequent``: which tokens of its window are frequent, with their levels."""
    held = matched.groupBy("node").agg(F.collect_set(F.struct("token", "level")).alias("frequent"))
    held = stage(held.withColumnRenamed("node", "f_node"), "join-held", codec="lz4")
    return join_small(sets, held, F.col("node") == F.col("f_node"), "left", rows=WIDE_ROWS).drop("f_node")


def _dense(sets: DataFrame, matched: DataFrame, percent: int) -> DataFrame:
    """``node, n_shingles`` of the sets whose window has fewer rare tokens than a prefix needs."""
    found = matched.groupBy("node").agg(F.count(F.lit(1)).alias("n_frequent"))
    need = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    sized = sets.select("node", "n_shingles", F.size("window").alias("n_window")).join(found, "node")
    return sized.filter((F.col("n_window") - F.col("n_frequent") < need) & (F.col("n_window") < F.col("n_shingles"))).select("node", "n_shingles").distinct()


def _whole_windows(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, n_shingles, window`` with all tokens in the window."""

    def unpacked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), pa.array([np.frombuffer(t.as_py(), np.int64) for t in batch.column("tokens")], pa.list_(pa.int64()))], names=["node", "n_shingles", "window"])

    return _whole_sets(docs, nodes, width).select("node", "n_shingles", "tokens").mapInArrow(unpacked, "node long, n_shingles long, window array<long>")


def signature_table(sets: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``node, sig, least`` of all ``sets`` (``node, n_shingles, window``).

    Frequent tokens are counted over the windows, and once more over the whole sets
    of those whose windows hold too few rare tokens. A token's level is the same for
    all sets, so the order is one.
    """
    first = stage(_frequent(sets), "join-frequent")
    seen = stage(_matched(sets, first), "join-matched", codec="lz4")
    dense = stage(_dense(sets, seen, percent), "join-dense")
    whole = stage(_whole_windows(docs, dense, width), "join-whole", codec="lz4")
    frequent = stage(first.unionByName(_frequent(whole)).groupBy("token").agg(F.max("level").alias("level")), "join-frequent")
    added = stage(frequent.join(first, "token", "left_anti"), "join-frequent")
    matched = stage(seen.unionByName(_matched(sets, added)).select("node", "token").join(frequent, "token"), "join-matched", codec="lz4")
    more = stage(_dense(sets, matched, percent).join(dense, "node", "left_anti"), "join-dense")
    wholes = whole.unionByName(stage(_whole_windows(docs, more, width), "join-whole", codec="lz4"))
    gone = stage(dense.unionByName(more).select(F.col("node").alias("d_node")).distinct(), "join-dense")
    light = _signature_rows(join_small(_with_frequent(sets, matched), gone, F.col("node") == F.col("d_node"), "left_anti", rows=NARROW_ROWS), percent, False)
    return light.unionByName(_signature_rows(_with_frequent(wholes, _matched(wholes, frequent)), percent, True))


def candidates(sets: DataFrame, docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """What may link: pairs ``a, b``, and groups ``class, node, hub_score, n_shingles`` in which any two may.

    Sets in short lists are paired, and a pair stays if it shares as many signatures
    as one of the two demands. Two sets that share a long list are in the group of
    its least set, whatever other lists they share.
    """
    rows = stage(signature_table(sets, docs, percent, width), "join-rows", codec="lz4")
    ends = rows.groupBy("sig").agg(F.min(F.struct("node", "least")).alias("x"), F.max(F.struct("node", "least")).alias("y"), F.count(F.lit(1)).alias("n"))
    lists = stage(ends.filter(F.col("x.node") != F.col("y.node")), "join-lists", codec="lz4")
    known = lists.filter("n > 2").select(F.col("sig").alias("l_sig"), F.col("x.node").alias("hub"), "n")
    longer = stage(rows.join(known, F.col("sig") == F.col("l_sig")).drop("l_sig"), "join-longer", codec="lz4")
    short = longer.filter(F.col("n") <= SHORT_LIST).groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("node", "least"))).alias("m"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.filter("n = 2").select("x", "y").unionByName(short.select(F.explode(each).alias("p")).select("p.x", "p.y"))
    counted = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x.least", "y.least")).alias("least"))
    near = counted.filter((F.col("n") >= F.col("least")) & (F.col("a") != F.col("b"))).select("a", "b")
    hubs = longer.filter(F.col("n") > SHORT_LIST).groupBy(F.col("hub").alias("class"), "node").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    groups = hubs.join(sizes, "node").select("class", "node", (F.col("n") / F.col("n_shingles")).alias("hub_score"), "n_shingles")
    return stage(near, "join-near"), stage(groups, "join-groups")


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a spanning set of the exact links inside each task's sets (``task, node, tokens``)."""

    def compared(key, table):
        nodes = table.column("node").to_numpy()
        roots = linked_roots([np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")], percent)
        joined = roots != np.arange(len(roots))
        return pa.table({"a": pa.array(nodes[joined], pa.int64()), "b": pa.array(nodes[roots[joined]], pa.int64())})

    return tasks.groupBy("task").applyInArrow(compared, "a long, b long")


def _n_blocks() -> Column:
    """Blocks of about ``BLOCK_BYTES`` and ``BLOCK_SETS`` for the sets of a group of rows."""
    return F.ceil(F.greatest(F.sum("n_shingles") * 8 / F.lit(BLOCK_BYTES), F.count(F.lit(1)) / F.lit(BLOCK_SETS))).cast("int").alias("blocks")


def _pair_tasks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``task, node``: both sets of each candidate pair in one task; a component of pairs within the block size is one task, a bigger one is dealt by pairs."""
    roots = stage(connected_components(pairs), "join-roots").withColumnRenamed("node", "r_node")
    blocks = stage(roots.join(sizes, F.col("r_node") == F.col("node")).groupBy("root").agg(_n_blocks()), "join-blocks")
    one = roots.join(blocks.filter("blocks = 1"), "root").select(F.concat_ws("/", F.lit("one"), F.col("root").cast("string")).alias("task"), F.col("r_node").alias("node"))
    of = pairs.join(roots, F.col("a") == F.col("r_node")).join(blocks.filter("blocks > 1"), "root")
    at = F.pmod(F.xxhash64("a"), 2 * F.col("blocks"))
    dealt = of.select(F.concat_ws("/", F.lit("pairs"), F.col("root").cast("string"), at.cast("string")).alias("task"), F.explode(F.array("a", "b")).alias("node")).distinct()
    return one.unionByName(dealt)


def verified_links(docs: DataFrame, pairs: DataFrame, groups: DataFrame, sizes: DataFrame, percent: int, width: int) -> DataFrame:
    """``a, b``: exact links that join all that is linked in the candidate pairs and in each candidate group.

    A group within the block size is one task. A bigger one is dealt in blocks, each
    with the group's most shared sets as pivots; what is then still apart from the
    largest linked part is compared with every block.
    """
    blocks = groups.groupBy("class").agg(_n_blocks())
    pivots = groups.groupBy("class", F.pmod(F.hash("node"), F.lit(16)).alias("slot")).agg(F.max(F.struct("hub_score", "node"))["node"].alias("node")).select("class", "node", F.lit(True).alias("pivot"))
    members = groups.join(blocks, "class").join(pivots, ["class", "node"], "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(0)))
    members = stage(members.select("node", "class", "blocks", "block", F.coalesce("pivot", F.lit(False)).alias("pivot")), "join-members")
    into = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.col("block").cast("int")))
    placed = members.select("class", "node", F.explode(into).alias("at")).select(F.concat_ws("/", F.lit("group"), F.col("class").cast("string"), F.col("at").cast("string")).alias("task"), "node")
    dealt = placed.unionByName(_pair_tasks(pairs, sizes)).groupBy("node").agg(F.collect_set("task").alias("tasks"))
    sets = stage(_whole_sets(docs, stage(dealt, "join-tasks"), width), "join-sets", codec="lz4")
    found = stage(_links(sets.select(F.explode("tasks").alias("task"), "node", "tokens"), percent), "join-links")
    big = members.filter(F.col("blocks") > 1).select("node", "class", "blocks", "block")
    if big.isEmpty():
        return found
    roots = connected_components(found).withColumnsRenamed({"node": "r_node"})
    label = big.join(roots, F.col("node") == F.col("r_node"), "left").select("node", "class", "blocks", "block", F.coalesce("root", "node").alias("label"))
    label = stage(label, "join-labels")
    parts = label.groupBy("class", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("class").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > 1)
    open_ = label.join(main, "class").withColumn("apart", F.col("label") != F.col("main"))
    apart = open_.filter("apart").groupBy("class").agg(F.count(F.lit(1)).alias("n_apart"))
    sized = open_.join(open_.groupBy("class").agg(F.count(F.lit(1)).alias("n_all")), "class").join(apart, "class")
    dealt = sized.withColumn("rows", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("n_apart") / F.col("n_all")).cast("int")))
    row_of = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")).cast("int")
    cells = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("block").cast("int").alias("c"))), F.when(F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(row_of.alias("r"), c.alias("c")))).otherwise(F.array().cast("array<struct<r:int,c:int>>"))))
    grid = stage(dealt.select("node", "class", F.explode(cells).alias("cell")), "join-grid")
    again = grid.join(sets.select(F.col("node").alias("s_node"), "tokens"), F.col("node") == F.col("s_node")).select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("class", "cell.r", "cell.c")]).alias("task"), "node", "tokens")
    return found.unionByName(stage(_links(again, percent), "join-links"))


def join_components(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (``doc_id, text``).

    Ids are whole numbers; other text as an id fails the job. Rows that repeat an id count as one document. Null, empty and wordless texts have
    no shingles and stay alone; equal sets link; a null id gets no component and
    links nothing. The component is the least id reachable by links. All columns but
    the two are ignored; an empty table gives no rows. Sets are compared by 64-bit
    hashes of shingles, which differ within a pair but for odds below one in 10**9.
    """
    python_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = stage(document_sets(docs, percent, width), "join-sets-all", codec="lz4")
    usable = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = usable.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = usable.select("doc_id", "sig_a", "sig_b").join(classes, ["sig_a", "sig_b"]).filter(F.col("doc_id") != F.col("node"))
    copies = stage(keyed.select(F.col("doc_id").alias("a"), F.col("node").alias("b"), F.col("sig_a").alias("c_a"), F.col("sig_b").alias("c_b")).distinct(), "join-copies")
    once = join_sieved(usable, "doc_id", copies, "a", (F.col("doc_id") == F.col("a")) & (F.col("sig_a") == F.col("c_a")) & (F.col("sig_b") == F.col("c_b")), "left_anti")
    linkable = once.filter(F.col("window").isNotNull()).select(F.col("doc_id").alias("node"), "n_shingles", "window")
    pairs, groups = candidates(linkable, docs, percent, width)
    sizes = linkable.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    links = verified_links(docs, pairs, groups, sizes, percent, width)
    same = copies.select("a", "b")
    roots = connected_components(links.unionByName(same))
    out = sets.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id.

    Only ids of removed documents are joined back. Rows of a null id stay. Of rows
    that repeat an id one of the least text stays. Other columns are of any type and
    name and are not looked at.
    """
    found = stage(join_components(docs, percent, width), "join-result")
    gone = stage(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("q__gone")).distinct(), "join-gone")
    rows = carried(docs, "doc_id", "text")
    same = F.col("doc_id").cast("long") == F.col("q__gone")
    kept = join_sieved(rows, F.col("doc_id").cast("long"), gone, "q__gone", same, "left_anti")
    repeated = stage(found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("q__gone")), "join-repeated")
    if not repeated.isEmpty():
        again = join_small(kept, repeated, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text", "q__rest"), F.struct(F.col("text").isNotNull(), "text")).alias("q__s"))
        kept = join_small(kept, repeated, same, "left_anti").unionByName(again.select("doc_id", "q__s.text", "q__s.q__rest"))
    return kept.select(*restored(docs, "doc_id", "text"))
