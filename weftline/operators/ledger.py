"""Analytics on the change ledger, dependencies and contention."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_package
from ..functions.staging import settled, shared_dir
from .changes import Refused

#: States of a spec that may be run; of a dependency in any other state but ``applied`` nothing can be ordered.
RUNNABLE = ("pending", "failed")


def applied_index(migrations: DataFrame, jobs: DataFrame) -> DataFrame:
    """``epoch, spec_id, seen, succeeded, running, failed``: sorted sets of digests."""
    of = lambda state: F.array_sort(F.collect_set(F.when(F.col("state") == state, F.col("spec_digest")))).alias(state)
    return migrations.join(jobs.select("migration_id", "state"), "migration_id", "left").groupBy("epoch", "spec_id").agg(F.array_sort(F.collect_set("spec_digest")).alias("seen"), of("succeeded"), of("running"), of("failed"))


def classify_specs(specs: DataFrame, index: DataFrame) -> DataFrame:
    """``specs`` with ``status``: in_progress, applied, modified_after_apply, failed or pending, by the same epoch's ledger."""
    joined = specs.join(index, ["epoch", "spec_id"], "left")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("digest")), F.lit(False))
    status = F.when(has("running"), "in_progress").when(has("succeeded"), "applied").when(F.coalesce(F.size("succeeded") > 0, F.lit(False)), "modified_after_apply").when(has("failed"), "failed").otherwise("pending")
    return joined.select(*specs.columns, status.alias("status"))


def gate_specs(specs: DataFrame, database: str, environments: DataFrame, releases: DataFrame, epochs: DataFrame) -> DataFrame:
    """Pending and failed ``specs`` with ``gate``: the first reason not to run them, or ``open``.

    Only the one row of the database's environment is broadcast.
    """
    e = environments.filter(F.col("database") == F.lit(database)).agg(F.max("name").alias("e_name")).select(F.lit(1).alias("e_one"), "e_name")
    r = releases.filter(F.col("database") == F.lit(database)).select(F.col("tag").alias("r_tag"), "ready")
    p = epochs.filter(F.col("database") == F.lit(database)).select(F.col("name").alias("p_name"), "retired_at", F.lit(True).alias("known"))
    waiting = specs.filter(F.col("status").isin(*RUNNABLE)).withColumn("one", F.lit(1))
    j = waiting.join(F.broadcast(e), F.col("one") == F.col("e_one")).join(r, F.col("r_tag") == F.col("release"), "left").join(p, F.col("p_name") == F.col("epoch"), "left")
    gate = (
        F.when(F.col("database") != F.lit(database), "wrong_database")
        .when(F.col("environment").isNotNull() & ~F.col("environment").eqNullSafe(F.col("e_name")), "wrong_environment")
        .when(F.col("retired_at").isNotNull(), "retired_epoch")
        .when(F.col("epoch").isNotNull() & F.col("known").isNull(), "held_for_epoch")
        .when(F.col("release").isNotNull() & ~F.coalesce("ready", F.lit(False)), "held_for_release")
        .otherwise("open")
    )
    return j.select(*specs.columns, gate.alias("gate"))


def ledger_drift(specs: DataFrame, index: DataFrame, epochs: DataFrame, complete: bool = False) -> DataFrame:
    """``epoch, spec_id, kind``: ids of the ledger without a file; ``drift`` if applied or running, ``note`` if only failed.

    Only epochs that files have unless ``complete``; never retired ones.
    """
    gone = index.join(specs.select("epoch", "spec_id"), ["epoch", "spec_id"], "left_anti").join(epochs.filter("retired_at IS NOT NULL").select(F.col("name").alias("epoch")), "epoch", "left_anti")
    if not complete:
        gone = gone.join(specs.select("epoch").distinct(), "epoch", "left_semi")
    kind = F.when((F.size("succeeded") > 0) | (F.size("running") > 0), "drift").when(F.size("failed") > 0, "note")
    return gone.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("epoch", "spec_id", "kind")


def duplicate_ids(specs: DataFrame) -> DataFrame:
    """``spec_id, files, kind``: an id given by several files, identical or different."""
    return specs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("digest").alias("n")).filter("files > 1").select("spec_id", "files", F.when(F.col("n") == 1, "identical").otherwise("different").alias("kind"))


def missing_dependencies(specs: DataFrame, index: DataFrame) -> DataFrame:
    """``spec_id, depends_on``: a dependency neither on disk nor succeeded in any epoch."""
    needs = specs.select("spec_id", F.explode("depends_on").alias("depends_on"))
    known = specs.select(F.col("spec_id").alias("depends_on")).unionByName(index.filter(F.size("succeeded") > 0).select(F.col("spec_id").alias("depends_on")))
    return needs.join(known, "depends_on", "left_anti").select("spec_id", "depends_on")


#: Nodes and edges of a part of a graph, which one task settles as far as it can.
PART_NODES, PART_EDGES = 50_000, 200_000


def _settle_part(rows):
    """``id, level`` of what is newly settled in one part, from its rows ``part, kind, a, b``: sizes (0), open needs outside (1: node, number), edges inside (2: node, need), met needs (3: node, number; 4: node, level of a need), settled before (5: node)."""
    import numpy as np
    import pyarrow as pa

    part, kind, x, y = (rows.column(n).to_numpy() for n in ("part", "kind", "a", "b"))
    base = int(part[0]) << 33
    n = int(x[kind == 0][0])
    at = lambda k: (x[kind == k] - base, y[kind == k])
    open_, level, old = np.zeros(n, "i8"), np.ones(n, "i8"), np.zeros(n, bool)
    np.add.at(open_, *at(1))
    node, need = at(2)
    need = need - base
    np.add.at(open_, node, 1)
    np.subtract.at(open_, *at(3))
    who, of = at(4)
    np.maximum.at(level, who, of + 1)
    old[at(5)[0]] = True
    node = node[np.argsort(need, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(need, minlength=n))])
    front = np.flatnonzero(open_ == 0)
    while len(front):
        many = first[front + 1] - first[front]
        behind = node[np.repeat(first[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        np.maximum.at(level, behind, np.repeat(level[front], many) + 1)
        np.subtract.at(open_, behind, 1)
        front = np.unique(behind[open_[behind] == 0])
    new = np.flatnonzero((open_ == 0) & ~old)
    return pa.table({"part": pa.array(np.full(len(new), part[0], "i8")), "id": pa.array(new + base), "level": pa.array(level[new])})


def dependency_levels(edges: DataFrame, nodes: DataFrame, bound: int = 10_000) -> DataFrame:
    """``node, level``: 1 plus the highest level of what a node (``node``) needs (``edges``: ``node, needs``); NULL in or behind a cycle.

    Nodes are numbered in their order and dealt into parts of about ``PART_NODES`` (fewer where there are
    many edges). In a round each part that heard of settled needs settles its nodes as far as it can,
    over any number of levels, and what it settled is told to the parts that need it. So
    rounds are how often a chain of needs goes from part to part, not its length; ``bound`` is
    the most of them. A round reads only the parts that heard something.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    nodes = nodes.select("node").filter("node IS NOT NULL").distinct()
    n, m = nodes.count(), edges.count()
    parts = max(1, -(-n // PART_NODES), -(-m // PART_EDGES))
    placed = nodes.repartitionByRange(parts, "node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id())
    placed = settled(placed, "levels")
    part = lambda c: F.shiftright(c, 33).alias("part")
    inside = edges.select("node", "needs").distinct().join(placed.withColumnRenamed("id", "a"), "node").join(placed.select(F.col("node").alias("needs"), F.col("id").alias("b")), "needs").select("a", "b")
    inside = settled(inside, "levels")
    cross = inside.filter(F.shiftright("a", 33) != F.shiftright("b", 33))
    kinds = [
        placed.groupBy(part("id")).agg(F.count(F.lit(1)).alias("a")).select("part", F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("b")),
        cross.groupBy("a").agg(F.count(F.lit(1)).alias("b")).select(part("a"), F.lit(1).alias("kind"), "a", "b"),
        inside.filter(F.shiftright("a", 33) == F.shiftright("b", 33)).select(part("a"), F.lit(2).alias("kind"), "a", "b"),
    ]
    folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, kinds).repartition(parts, "part").write.partitionBy("part").parquet(f"{folder}/parts")
    cross.withColumn("from", F.shiftright("b", 33)).repartition(parts, "from").write.partitionBy("from").parquet(f"{folder}/cross")
    pair = "kind int, a long, b long"
    graph = spark.read.schema(f"{pair}, part long").parquet(f"{folder}/parts")
    needed = spark.read.schema("a long, b long, from long").parquet(f"{folder}/cross")
    done = f"{folder}/done"
    every = spark.createDataFrame([], "part long, id long, level long")
    heard: DataFrame | None = None
    active = [r[0] for r in graph.select("part").distinct().collect()]
    for k in range(bound + 1):
        if not active:
            return placed.join(every.select("id", F.col("level").cast("int").alias("level")), "id", "left").select("node", "level")
        if k == bound:
            break
        rows = graph.filter(F.col("part").isin(active)).select("part", "kind", "a", "b")
        if heard is not None:
            mine = heard.filter(F.col("part").isin(active)).select("part", "kind", "a", "b")
            before = every.filter(F.col("part").isin(active)).select("part", F.lit(5).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
            rows = rows.unionByName(mine).unionByName(before)
        rows.groupBy("part").applyInArrow(_settle_part, "part long, id long, level long").write.parquet(f"{done}/round={k}")
        new = spark.read.schema("part long, id long, level long").parquet(f"{done}/round={k}")
        every = spark.read.schema("part long, id long, level long, round int").parquet(done).drop("round")
        told = needed.filter(F.col("from").isin(active)).join(new.select(F.col("id").alias("b"), "level"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("met"), F.max("level").alias("level"))
        told.select(part("a"), F.explode(F.array(F.struct(F.lit(3).alias("kind"), F.col("met").alias("b")), F.struct(F.lit(4).alias("kind"), F.col("level").alias("b")))).alias("m"), "a").select("part", "m.kind", "a", "m.b").write.parquet(f"{folder}/heard/round={k}")
        heard = spark.read.schema("part long, kind int, a long, b long, round int").parquet(f"{folder}/heard")
        active = [r[0] for r in spark.read.schema("part long").parquet(f"{folder}/heard/round={k}").distinct().collect()]
    raise Refused("too many rounds")


def _both_sides(edges: DataFrame, bound: int) -> DataFrame:
    """Edges between nodes that some node needs and that need some node, however often that is asked.

    What gets a level leads into no cycle; of the rest, what gets one with the edges turned is behind none.
    """
    for _ in range(2):
        if edges.isEmpty():
            return edges
        ends = edges.select("node").union(edges.select("needs")).distinct()
        levels = dependency_levels(edges, ends, bound)
        stay = settled(levels.filter("level IS NULL").select("node"), "stuck")
        kept = edges.join(stay, "node", "left_semi").join(stay.withColumnRenamed("node", "needs"), "needs", "left_semi")
        edges = settled(kept.select(F.col("needs").alias("node"), F.col("node").alias("needs")), "stuck")
    return edges


def cycle_members(edges: DataFrame, bound: int = 10_000) -> DataFrame:
    """``node``: those of ``edges`` (``node, needs``) that need themselves, directly or through others.

    What is needed by nothing or needs nothing is trimmed off. The greatest id that
    reaches a node colours it; a node of its own colour and what reaches it inside the
    colour are one strong component, which is taken out before the next round.
    """
    edges = settled(edges.select("node", "needs").distinct(), "stuck")
    found = edges.filter("node = needs").select("node")
    rest = edges.filter("node <> needs")
    for _ in range(bound):
        rest = _both_sides(rest, bound)
        if rest.isEmpty():
            return found.distinct()
        colours = settled(rest.select("node", F.col("node").alias("colour")).distinct(), "stuck")
        for _ in range(bound):
            reach = rest.join(colours, "node").groupBy(F.col("needs").alias("node")).agg(F.max("colour").alias("by"))
            colours = settled(colours.join(reach, "node", "left").select("node", F.greatest("colour", "by").alias("colour"), (F.col("by") > F.col("colour")).alias("new")), "stuck")
            if colours.filter("new").isEmpty():
                break
            colours = colours.select("node", "colour")
        else:
            raise Refused("too many rounds")
        own = rest.join(colours.select("node", "colour"), "node").join(colours.select(F.col("node").alias("needs"), F.col("colour").alias("other")), "needs").filter("colour = other").select("node", "needs", "colour")
        own = settled(own, "stuck")
        front = part = settled(colours.filter("node = colour").select("node"), "stuck")
        for _ in range(bound):
            front = settled(own.join(front.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").distinct().join(part, "node", "left_anti"), "stuck")
            if front.isEmpty():
                break
            part = part.unionByName(front)
        else:
            raise Refused("too many rounds")
        part = settled(part.join(colours.select("node", "colour"), "node"), "stuck")
        large = part.groupBy("colour").count().filter("count > 1").select("colour")
        found = found.unionByName(part.join(large, "colour", "left_semi").select("node"))
        gone = part.select("node")
        rest = settled(rest.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "needs"), "needs", "left_anti").select("node", "needs"), "stuck")
    raise Refused("too many rounds")


def unorderable(edges: DataFrame, nodes: DataFrame, bound: int = 10_000) -> DataFrame:
    """``node, kind`` of the runnable ``nodes`` (``node, status``) that cannot be ordered by ``edges`` (``node, needs``).

    A need that is applied is met. ``state``: needs a node that is neither applied nor
    runnable. ``cycle``: needs itself. ``blocked``: behind one of those. Needs that are
    not among the nodes are for :func:`missing_dependencies`.
    """
    status = nodes.select(F.col("node").alias("needs"), F.col("status").alias("of"))
    runnable = nodes.filter(F.col("status").isin(*RUNNABLE)).select("node")
    open_ = settled(edges.join(runnable, "node", "left_semi").join(status, "needs").filter("of <> 'applied'").select("node", "needs", F.col("of").isin(*RUNNABLE).alias("runs")).distinct(), "open")
    held = open_.filter("NOT runs").select("node").distinct()
    # a node that is held needs itself here, so that no level is given to it
    levels = dependency_levels(open_.filter("runs").select("node", "needs").unionByName(held.select("node", F.col("node").alias("needs"))).distinct(), runnable, bound)
    left = settled(levels.filter("level IS NULL").select("node"), "left")
    stuck = open_.filter("runs").join(left, "node", "left_semi").join(left.withColumnRenamed("node", "needs"), "needs", "left_semi")
    members = cycle_members(stuck, bound).withColumn("cycle", F.lit(True))
    kinds = left.join(held.withColumn("state", F.lit(True)), "node", "left").join(members, "node", "left")
    return kinds.select("node", F.when(F.col("state"), "state").when(F.col("cycle"), "cycle").otherwise("blocked").alias("kind"))


#: Specs of a block of :func:`conflict_pairs`, and blocks of one relation that meet in one task.
BLOCK_SPECS, MET_BLOCKS = 1_000, 8
#: Pairs that a task of :func:`conflict_pairs` makes, about.
TASK_PAIRS = 4_000_000


def _blocks(specs: DataFrame) -> DataFrame:
    """``block, ids, marks``: specs with the same relations everywhere, about ``BLOCK_SPECS`` a row.

    ``marks`` are sorted structs of database, level, kind and relation: kind 0 for each level a spec is on, 1 where it has no relations there, 2 for a relation.
    """
    of = lambda kind, x: F.struct("database", "level", F.lit(kind).alias("kind"), x.alias("relation"))
    none = F.lit(None).cast("string")
    own = F.when(F.size("relations") == 0, F.array(of(0, none), of(1, none))).otherwise(F.concat(F.array(of(0, none)), F.coalesce(F.transform(F.filter("relations", lambda r: r.isNotNull()), lambda r: of(2, r)), F.array().cast(T.ArrayType(specs.select(of(2, none).alias("m")).schema["m"].dataType)))))
    placed = specs.filter("spec_id IS NOT NULL AND database IS NOT NULL AND level IS NOT NULL")
    marks = placed.select("spec_id", F.explode(own).alias("m")).groupBy("spec_id").agg(F.array_sort(F.collect_set("m")).alias("marks"))
    marks = marks.withColumn("key", F.sha2(F.to_json("marks"), 256))
    sizes = marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dealt = marks.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("spec_id"), F.ceil(F.col("n") / BLOCK_SPECS)))
    return dealt.groupBy("key", "at").agg(F.collect_list("spec_id").alias("ids"), F.any_value("marks").alias("marks")).select(F.struct("key", "at").alias("block"), "ids", "marks")


def conflict_pairs(specs: DataFrame) -> DataFrame:
    """``a, b, shared`` of ``spec_id, database, level, relations``: two specs of one level and database that touch the same relations.

    Specs without relations (incomplete evidence) conflict with all of their level and have ``shared`` empty.
    The pairs are the result, so they may be many; they are never shuffled. Blocks of specs with the same relations meet
    by each relation, dealt over tasks where a relation has many blocks, what they share is found once for two blocks, at the first relation
    both have, and their specs are paired last, two blocks after another dealt over as many tasks as their pairs ask for.
    """
    blocks = settled(_blocks(specs), "blocks")
    kind = F.col("mark.kind")
    marked = blocks.withColumn("mark", F.explode("marks"))
    many = settled(marked.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / MET_BLOCKS).cast("int").alias("__n")), "marks")
    marked = marked.join(many.withColumnRenamed("mark", "__m"), F.col("mark").eqNullSafe(F.col("__m"))).drop("__m")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "marks")], F.col("mark.database").alias(f"{s}_database"), F.col("mark.level").alias(f"{s}_level"), F.col("mark.relation").alias(f"{s}_relation"), F.col("__deal").alias(f"{s}_deal"))
    spread = lambda df: df.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = lambda df: df.withColumn("__deal", F.pmod(F.xxhash64("block"), F.col("__n")).cast("int"))
    of = lambda marks, n: F.transform(F.filter(marks, lambda m: m["kind"] == n), lambda m: F.struct(m["database"].alias("database"), m["level"].alias("level"), m["relation"].alias("relation")))
    same = (F.col("a_database") == F.col("b_database")) & (F.col("a_level") == F.col("b_level")) & (F.col("a_deal") == F.col("b_deal"))
    here = F.struct(F.col("a_database").alias("database"), F.col("a_level").alias("level"), F.col("a_relation").alias("relation"))

    met = side(spread(marked.filter(kind == 2)), "a").join(side(dealt(marked.filter(kind == 2)), "b"), same & (F.col("a_relation") == F.col("b_relation")) & (F.col("a_block") <= F.col("b_block")))
    both = met.withColumn("both", F.array_intersect(of("a_marks", 2), of("b_marks", 2))).filter(F.col("both")[0] == here)
    both = both.withColumn("shared", F.array_sort(F.array_distinct(F.transform("both", lambda m: m["relation"]))))

    # one without relations meets every block of its level; two of them at the block that comes first
    blank = side(dealt(marked.filter(kind == 1).drop("__n").join(many.filter("mark.kind = 0").select(F.col("mark.database").alias("__d"), F.col("mark.level").alias("__l"), "__n"), (F.col("mark.database") == F.col("__d")) & (F.col("mark.level") == F.col("__l")))), "a")
    denied = blank.join(side(spread(marked.filter(kind == 0)), "b"), same)
    first = F.array_min(F.concat(F.array_intersect(of("a_marks", 1), of("b_marks", 0)), F.array_intersect(of("a_marks", 0), of("b_marks", 1))))
    mutual = F.array_contains(of("b_marks", 1), here)
    denied = denied.filter((first == here) & (~mutual | (F.col("a_block") <= F.col("b_block")))).withColumn("shared", F.array().cast("array<string>"))

    pairs = both.select("a_block", "b_block", "a_ids", "b_ids", "shared").unionByName(denied.select("a_block", "b_block", "a_ids", "b_ids", "shared"))
    pairs = settled(pairs.select((F.col("a_block") == F.col("b_block")).alias("own"), "a_ids", "b_ids", "shared"), "met")
    made = pairs.agg(F.sum(F.size("a_ids").cast("long") * F.size("b_ids"))).first()[0] or 0
    # the rows that are dealt are few and short, what is made of them is long
    tasks = max(specs.sparkSession.sparkContext.defaultParallelism, -(-made // TASK_PAIRS))
    one = pairs.repartition(tasks).select("own", "b_ids", "shared", F.explode("a_ids").alias("x"))
    # a step that is not compiled into one loop with both lists, else a task holds all pairs of two blocks at once and not those of one spec
    one = one.withColumn("x", F.transform(F.array("x"), lambda x: x)[0])
    every = one.select("own", "x", F.explode("b_ids").alias("y"), "shared").filter("x <> y AND (NOT own OR x < y)")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def conflict_classes(specs: DataFrame) -> DataFrame:
    """``database, level, relation, spec_id, members, links`` of ``spec_id, database, level, relations``: who shares what, without pairs.

    A class are the specs of one level and database that touch one relation, and has
    ``links`` pairs; each of its specs has a row, so the result is no longer than the relations. Specs without relations (incomplete evidence) are a class
    with a NULL relation, linked with each other and with all others of their level.
    """
    touched = specs.select("database", "level", F.explode(F.array_distinct("relations")).alias("relation"), "spec_id")
    sizes = touched.groupBy("database", "level", "relation").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    pairs = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("long")
    shared = touched.join(sizes.withColumn("links", pairs("members")), ["database", "level", "relation"])
    per_level = specs.groupBy("database", "level").agg(F.count_if(F.size("relations") == 0).alias("members"), F.count_if(F.size("relations") > 0).alias("others"))
    held = per_level.withColumn("links", pairs("members") + F.col("members") * F.col("others")).filter("links > 0")
    blank = specs.filter(F.size("relations") == 0).select("database", "level", "spec_id").join(held, ["database", "level"])
    names = ["database", "level", "relation", "spec_id", "members", "links"]
    return shared.select(*names).unionByName(blank.withColumn("relation", F.lit(None).cast("string")).select(*names))


def conflicts_of(specs: DataFrame, asked: DataFrame) -> DataFrame:
    """``a, b, shared`` for the pairs of the ``asked`` specs (``spec_id``) alone; see :func:`conflict_pairs`."""
    some = specs.join(asked.select("spec_id").distinct(), "spec_id", "left_semi")
    own = some.select(F.col("spec_id").alias("x"), "database", "level", F.explode("relations").alias("relation"))
    rest = specs.select(F.col("spec_id").alias("y"), "database", "level", F.explode("relations").alias("relation"))
    met = own.join(rest, ["database", "level", "relation"]).select("x", "y", "relation")
    blank = lambda df, n: df.filter(F.size("relations") == 0).select(F.col("spec_id").alias(n), "database", "level")
    every = lambda df, n: df.select(F.col("spec_id").alias(n), "database", "level")
    denied = blank(some, "x").join(every(specs, "y"), ["database", "level"]).select("x", "y").unionByName(every(some, "x").join(blank(specs, "y"), ["database", "level"]).select("x", "y"))
    both = met.unionByName(denied.withColumn("relation", F.lit(None).cast("string"))).filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.array_sort(F.collect_set("relation")).alias("shared"))


def relation_closure(relations: DataFrame, fk_edges: DataFrame) -> DataFrame:
    """``spec_id, relation``: what a change touches, and its foreign-key neighbours both ways."""
    both = fk_edges.select("relation", "other").unionByName(fk_edges.select(F.col("other").alias("relation"), F.col("relation").alias("other")))
    return relations.unionByName(relations.join(both, "relation").select("spec_id", F.col("other").alias("relation"))).distinct()


#: Largest whole number that every reader of JSON keeps; larger ones are written as text.
SAFE_INTEGER = (1 << 53) - 1


def _quoted(text: Column) -> Column:
    """A JSON string: the two signs and the control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rest = out
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        rest = F.replace(rest, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON text of a value, by its type; ``null`` for NULL.

    Fields of structs and entries of maps are in the order of their UTF-16 names at every
    depth. Whole numbers and decimals without a fraction are digits (text beyond 2**53), decimals are text
    without trailing zeros, times are text of their microseconds (an instant ends in Z, a zoneless time is
    written out), binary is text in hexadecimal. Floats have no one encoding and are refused, as are other types.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        named = lambda k: _quoted(k) if isinstance(kind.keyType, T.StringType) else _quoted(canonical(k, kind.keyType))
        order = lambda k: F.hex(F.encode(k if isinstance(kind.keyType, T.StringType) else canonical(k, kind.keyType), "UTF-16BE"))
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(order(e["key"]).alias("o"), F.concat(named(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType)).alias("t"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["t"]), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = F.when(value.between(-SAFE_INTEGER, SAFE_INTEGER), value.cast("string")).otherwise(_quoted(value.cast("string")))
    elif isinstance(kind, T.DecimalType):
        # a value of a large scale is written with an exponent by a cast, so digits are taken one by one
        digits = F.regexp_replace(F.format_number(value, kind.scale), ",", "")
        plain = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
        plain = F.when(plain.isin("-0", ""), F.lit("0")).otherwise(plain)
        whole = ~plain.contains(".") & (F.length(plain) < 16)
        text = F.when(whole, plain).otherwise(_quoted(plain))
    elif isinstance(kind, T.StringType):
        text = _quoted(value)
    elif isinstance(kind, T.BinaryType):
        text = _quoted(F.lower(F.hex(value)))
    elif isinstance(kind, T.TimestampType):
        text = _quoted(F.concat(F.unix_micros(value).cast("string"), F.lit("Z")))
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        text = _quoted(value.cast("string"))
    else:
        raise Refused(f"no canonical form of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's canonical JSON (see :func:`canonical`); a NULL column is ``null``."""
    fields = sorted(df.schema.fields, key=lambda f: f.name.encode("utf-16-be"))
    parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical(F.col(f"`{f.name}`"), f.dataType)) for f in fields]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def content_digest(df: DataFrame) -> DataFrame:
    """One row ``rows, digest``: a digest of the table that does not depend on the order of rows, columns or nested fields.

    The first 240 bits of each row's digest are four numbers, each summed over the
    rows; the SHA-256 of the count and the four sums is the table's.
    """
    row = df.select(row_digest(df).alias("d"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k in range(4)]
    sums = row.agg(F.count(F.lit(1)).alias("rows"), *lanes)
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[f"s{k}" for k in range(4)]), 256).alias("digest"))


def _seconds(begin: str, end: str) -> Column:
    return F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(begin).cast("timestamp"))


def step_timeline(steps: DataFrame) -> DataFrame:
    """``job_id, ordinal, state, seconds, rows, rows_per_s`` of each step; one under way has no end and no seconds."""
    rows = steps.select("job_id", "ordinal", "state", _seconds("started_at", "finished_at").alias("seconds"), F.col("rows_affected").alias("rows"))
    return rows.withColumn("rows_per_s", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))


def job_timeline(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """``job_id, state, steps, first_start, last_finish, seconds, rows, rows_per_s`` (``jobs``: ``job_id, state``); the first start is kept over retries."""
    own = steps.groupBy("job_id").agg(F.count(F.lit(1)).alias("steps"), F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"), F.sum("rows_affected").alias("rows"))
    return jobs.select("job_id", "state").join(own, "job_id").withColumn("seconds", _seconds("first_start", "last_finish")).withColumn("rows_per_s", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))


def dead_jobs(jobs: DataFrame, locks: DataFrame) -> DataFrame:
    """Unfinished jobs whose pid and key no backend holds that began at or before the job."""
    j, k = jobs.filter("finished_at IS NULL").alias("j"), locks.alias("k")
    return j.join(k, (F.col("j.backend_pid") == F.col("k.pid")) & (F.col("j.lock_key") == F.col("k.lock_key")) & (F.col("k.backend_start") <= F.col("j.started_at")), "left_anti").select("job_id")


def last_state(jobs: DataFrame) -> DataFrame:
    """``spec_id, job_id, state`` of the newest job per spec."""
    return jobs.groupBy("spec_id").agg(F.max_by(F.struct("job_id", "state"), F.struct("started_at", "job_id")).alias("j")).select("spec_id", "j.job_id", "j.state")


def blocking_closure(edges: DataFrame, roots: DataFrame, max_depth: int = 16) -> DataFrame:
    """``root, waiter, depth``: who waits for a root, directly (1) or through others, at the least depth; cycles end.

    ``edges``: ``waiter, blocker``. A waiter is followed once a root.
    """
    seen = settled(roots.select(F.col("root"), F.col("root").alias("waiter"), F.lit(0).alias("depth")), "waits")
    front = seen
    for depth in range(1, max_depth + 1):
        met = edges.join(front.select("root", F.col("waiter").alias("blocker")), "blocker").select("root", "waiter").distinct()
        front = settled(met.join(seen, ["root", "waiter"], "left_anti").withColumn("depth", F.lit(depth)), "waits")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def blocking_summary(edges: DataFrame, roots: DataFrame, as_of: str, max_depth: int = 16) -> DataFrame:
    """A row for each root: ``direct`` and ``transitive`` waiters, the earliest direct one and its wait, and all direct waits together.

    ``edges``: ``waiter, blocker, waitstart``. Milliseconds are up to ``as_of``; a root
    without waiters has zeros and no waiter.
    """
    chain = blocking_closure(edges, roots, max_depth).filter("waiter <> root").groupBy("root").agg(F.count_distinct("waiter").alias("transitive"))
    ms = F.unix_millis(F.to_timestamp(F.lit(as_of))) - F.unix_millis(F.col("waitstart").cast("timestamp"))
    met = roots.join(edges, F.col("root") == F.col("blocker")).withColumn("ms", ms)
    direct = met.groupBy("root").agg(F.count_distinct("waiter").alias("direct"), F.min_by("waiter", F.struct("waitstart", "waiter")).alias("blocking_waiter"), F.max("ms").alias("oldest_wait_ms"), F.sum("ms").alias("inflicted_ms"))
    j = roots.select("root").distinct().join(direct, "root", "left").join(chain, "root", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("root", zero("direct"), zero("transitive"), "blocking_waiter", zero("oldest_wait_ms"), zero("inflicted_ms"))


def exhaustion_budget(ticks: DataFrame, max_connections: int, reserved: int) -> DataFrame:
    """``job_id, tick, headroom, seconds_left``: free connections, and the time to none at the rate since the last sample."""
    w = Window.partitionBy("job_id").orderBy("tick")
    secs = F.unix_timestamp(F.col("tick").cast("timestamp"))
    rate = F.try_divide(F.col("current_backends") - F.lag("current_backends").over(w), secs - F.lag(secs).over(w))
    rows = ticks.withColumns({"headroom": F.lit(max_connections - reserved) - F.col("current_backends"), "__rate": rate})
    return rows.select("job_id", "tick", "headroom", F.when(F.col("__rate") > 0, F.col("headroom") / F.col("__rate")).alias("seconds_left"))


def policy_drift(applied: DataFrame, policies: DataFrame) -> DataFrame:
    """``target, kind, drift``: the newest declaration (``target, kind, seq, schedule, config``) against what is there (``... paused``)."""
    newest = applied.groupBy("target", "kind").agg(F.max_by(F.struct("schedule", "config", "removed"), "seq").alias("d")).select("target", "kind", "d.*")
    there = policies.select("target", "kind", F.col("schedule").alias("p_schedule"), F.col("config").alias("p_config"), "paused", F.lit(True).alias("there"))
    j = newest.join(there, ["target", "kind"], "full_outer")
    declared = F.coalesce(~F.col("removed"), F.lit(False))
    drift = F.when(declared & F.col("there").isNull(), "removed").when(~declared & F.col("there"), "re-added").when(declared & F.col("paused"), "paused").when(declared & ~(F.col("schedule").eqNullSafe(F.col("p_schedule")) & F.col("config").eqNullSafe(F.col("p_config"))), "changed")
    return j.withColumn("drift", drift).filter("drift IS NOT NULL").select("target", "kind", "drift")


def schedule_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """``user, name, action`` of scheduled jobs (``user, name, schedule, command, database, active``)."""
    fields = ("schedule", "command", "database", "active")
    a = actual.select("user", "name", *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("there"))
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"a_{f}"))
    j = declared.withColumn("wanted", F.lit(True)).join(a, ["user", "name"], "full_outer")
    action = F.when(F.col("there").isNull(), "apply").when(F.col("wanted").isNull(), "undeclared").when(same, "satisfied").otherwise("conflict")
    return j.select("user", "name", action.alias("action"))


def estimate_freshness(tables: DataFrame, as_of: str, seconds: int = 3600) -> DataFrame:
    """``tables`` (``table, read_at``) with ``age_s`` and ``stale``."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col("read_at").cast("timestamp"))
    return tables.withColumn("age_s", age).withColumn("stale", F.col("age_s") > seconds)
