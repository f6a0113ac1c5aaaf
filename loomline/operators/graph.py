"""Ids, parents and ancestry of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomline.session import durable, ship, stored


def duplicate_ids(records: DataFrame, scope: list[str], line: str = "line") -> DataFrame:
    """Records whose id stood before in the scope, with the line where it stood first; null ids never repeat."""
    w = W.partitionBy(*scope, "id").orderBy(line)
    out = records.filter("id is not null").withColumn("first_line", F.first(line).over(w)).withColumn("nth", F.row_number().over(w))
    return out.filter("nth > 1").drop("nth")


def unknown_parents(records: DataFrame, scope: list[str]) -> DataFrame:
    """Records whose parent is no id of the scope."""
    ids = records.select(*scope, F.col("id").alias("parent_id")).distinct()
    return records.filter("parent_id is not null").join(ids, [*scope, "parent_id"], "left_anti")


def cyclic_ids(edges: DataFrame, scope: list[str], most: int) -> DataFrame:
    """Ids that lie on a cycle of parents, not those that lead to one.

    Each round replaces a node's parent by its parent's parent. After enough rounds
    (2^rounds >= `most`, the largest scope) only nodes on cycles are anyone's ancestor.
    edges(scope, id, parent_id): one parent for each id; others end their path.
    """
    hops = durable(edges.select(*scope, "id", F.col("parent_id").alias("up")).filter("up is not null"))
    for _ in range(max(1, (max(most, 2) - 1).bit_length())):
        ups = hops.select(*scope, F.col("id").alias("up"), F.col("up").alias("next"))
        hops = durable(hops.join(_large(ups), [*scope, "up"]).select(*scope, "id", F.col("next").alias("up")))
    return hops.select(*scope, F.col("up").alias("id")).distinct()


def nearest_ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor): the nearest proper ancestor with `mapped`, null if there is none.

    nodes(id, parent_id, mapped). Paths double each round, so the number of rounds is
    the logarithm of the depth; a cycle without a mapped node ends at null.
    """
    at = nodes.select(F.col("id").alias("p"), F.col("parent_id").alias("pp"), "mapped")
    state = durable(nodes.select("id", F.col("parent_id").alias("at")).join(at, F.col("at") == F.col("p"), "left").select(
        "id", "at", F.coalesce("mapped", F.lit(True)).alias("done")))
    jump = durable(nodes.select(F.col("id").alias("p"), F.when(~F.col("mapped"), F.col("parent_id")).alias("to"), F.col("mapped")))
    for _ in range(nodes.count().bit_length() + 1):
        if state.filter("not done").isEmpty():
            break
        state = durable(state.join(jump.withColumnRenamed("mapped", "m"), F.col("at") == F.col("p"), "left").select(
            "id", F.when(F.col("done") | F.col("m"), F.col("at")).otherwise(F.col("to")).alias("at"),
            (F.col("done") | F.coalesce("m", F.lit(True)) | F.col("to").isNull()).alias("done")))
        other = jump.select(F.col("p").alias("q"), F.col("to").alias("to2"), F.col("mapped").alias("m2"))
        jump = durable(jump.join(other, F.col("to") == F.col("q"), "left").select(
            "p", F.when(F.col("mapped"), F.lit(None)).when(F.col("m2"), F.col("to")).otherwise(F.col("to2")).alias("to"), "mapped"))
    known = nodes.filter("mapped").select(F.col("id").alias("k"))
    return state.join(known, F.col("at") == F.col("k"), "left").select("id", F.col("k").alias("ancestor"))


def closure(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(ancestor, id, depth): every pair of a lineage without cycles; depths double each round."""
    out = durable(edges.filter("parent_id is not null").select(F.col("parent_id").alias("ancestor"), "id", F.lit(1).alias("depth")))
    reach = 1
    for _ in range(rounds):
        upper = out.select(F.col("ancestor").alias("top"), F.col("id").alias("mid"), F.col("depth").alias("d1"))
        longer = upper.filter(F.col("d1") == reach).join(out, F.col("mid") == F.col("ancestor")).select(F.col("top").alias("ancestor"), "id", (F.col("d1") + F.col("depth")).alias("depth"))
        longer = durable(longer)
        if longer.isEmpty():
            break
        out = durable(out.unionByName(longer))
        reach *= 2
    return out


def bag_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, n): how often a row is preserved, a regression (only old) or an addition (only new)."""
    a = old.groupBy(*keys).agg(F.count("*").alias("a"))
    b = new.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    verdicts = F.array(F.struct(F.lit("preserved").alias("verdict"), F.least("a", "b").alias("n")), F.struct(F.lit("regression").alias("verdict"), (F.col("a") - F.least("a", "b")).alias("n")),
                       F.struct(F.lit("addition").alias("verdict"), (F.col("b") - F.least("a", "b")).alias("n")))
    return both.select(*keys, F.explode(verdicts).alias("v")).select(*keys, "v.verdict", "v.n").filter("n > 0")


def _large(table: DataFrame) -> DataFrame:
    """A table that grows with the nodes, and so never goes through the driver in a join, however small its files look."""
    return table.hint("merge")


def _known_parents(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """`nodes(scope, id, parent_id, ..)` with null for parents that are no node of the scope."""
    known = nodes.select(*scope, F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    return nodes.join(_large(known), [*scope, "parent_id"], "left").withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id"))).drop("_known")


class Forest:
    """Paths to the root of many nodes at once, by doubled jumps.

    nodes(scope, id, parent_id), and more columns. A parent that is no node of the scope ends
    the path like null does. A path that comes to a cycle ends before it repeats a node, so
    its last node depends on where it enters. `depth` has (scope, id, root, depth): the last
    node of a node's path and how many steps it is away. `jumps[k]` has (scope, id, to): the
    node 2^k steps up, which means something where the path is that long.
    """

    def __init__(self, nodes: DataFrame, scope: list[str]):
        self.scope = scope
        self.nodes = stored(_known_parents(nodes, scope))
        most = self.nodes.groupBy(*scope).count().agg(F.max("count")).first()[0] or 1
        self.rounds = max(1, most.bit_length())
        ups = self.nodes.filter("parent_id is not null").select(*scope, "id", F.col("parent_id").alias("to"))
        ring = stored(cyclic_ids(self.nodes.select(*scope, "id", "parent_id"), scope, most)) if not ups.isEmpty() else self.nodes.select(*scope, "id").limit(0)
        # Steps to the root or to the first node on a cycle: both point to themselves.
        end = F.col("to").isNull() | F.col("_ring").isNotNull()
        walk = self.nodes.select(*scope, "id", F.col("parent_id").alias("to")).join(_large(ring.withColumn("_ring", F.lit(True))), [*scope, "id"], "left").select(
            *scope, "id", F.when(end, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(end, 0).otherwise(1).cast("long").alias("steps"))
        walk = stored(walk)
        for _ in range(self.rounds):
            next_ = walk.select(*scope, F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
            walk = stored(walk.join(_large(next_), [*scope, "to"]).select(*scope, "id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
        # A path that enters a cycle goes once around it: its last node is the one whose parent is where it entered.
        lap = stored(self.nodes.join(_large(ring), [*scope, "id"], "left_semi").select(*scope, "id", F.col("parent_id").alias("to"), F.col("id").alias("least")))
        for _ in range(self.rounds if not lap.isEmpty() else 0):
            next_ = lap.select(*scope, F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("other"))
            lap = stored(lap.join(_large(next_), [*scope, "to"]).select(*scope, "id", F.col("far").alias("to"), F.least("least", "other").alias("least")))
        around = lap.join(_large(lap.groupBy(*scope, "least").agg(F.count("*").alias("around"))), [*scope, "least"]).select(*scope, F.col("id").alias("to"), "around")
        before = self.nodes.join(_large(ring), [*scope, "id"], "left_semi").select(*scope, F.col("parent_id").alias("to"), F.col("id").alias("last"))
        self.depth = stored(walk.join(_large(around), [*scope, "to"], "left").join(_large(before), [*scope, "to"], "left").select(
            *scope, "id", F.coalesce("last", "to").alias("root"), (F.col("steps") + F.coalesce(F.col("around") - 1, F.lit(0))).alias("depth")))
        deepest = self.depth.agg(F.max("depth")).first()[0] or 0
        self.jumps = [stored(ups)]
        while 1 << len(self.jumps) <= deepest:
            last = self.jumps[-1]
            self.jumps.append(stored(last.join(_large(last.select(*scope, F.col("id").alias("to"), F.col("to").alias("far"))), [*scope, "to"]).select(*scope, "id", F.col("far").alias("to"))))

    def joined(self, rows: DataFrame, column: str, table: DataFrame, **names: str) -> DataFrame:
        """`rows` with columns of a table by the id in `column`, null where there is none."""
        right = table.select(*[F.col(c).alias(f"__{c}") for c in self.scope], F.col("id").alias("__id"), *[F.col(c).alias(n) for c, n in names.items()])
        on = [F.col(c) == F.col(f"__{c}") for c in self.scope] + [F.col(column) == F.col("__id")]
        return rows.join(_large(right), on, "left").drop("__id", *[f"__{c}" for c in self.scope])

    def lifted(self, rows: DataFrame, column: str, steps: str) -> DataFrame:
        """`rows` with the node in `column` moved up by the number in `steps`."""
        for k, jump in enumerate(self.jumps):
            far = F.shiftright(F.coalesce(steps, F.lit(0).cast("long")), k).bitwiseAND(1) == 1
            rows = self.joined(rows, column, jump, to="_to").withColumn(column, F.when(far, F.col("_to")).otherwise(F.col(column))).drop("_to")
        return rows


def diverging(forest: Forest, pairs: DataFrame) -> DataFrame:
    """`pairs(scope, abandoned, active)` with `child`, the first node of the abandoned path, from the root, that is not on the active one, and `down`, its steps from the abandoned leaf.

    Both are null where the paths share no root, where the whole abandoned path is on the
    active one, and where a leaf is null or no node. Lowest common ancestors of all pairs
    are found together: the deeper leaf is lifted, then both, by ever smaller jumps.
    """
    f = forest
    rows = f.joined(f.joined(pairs, "abandoned", f.depth, root="_r1", depth="_d1"), "active", f.depth, root="_r2", depth="_d2")
    rows = rows.withColumn("_u", F.when(F.col("_r1") == F.col("_r2"), F.col("abandoned"))).withColumn("_v", F.when(F.col("_r1") == F.col("_r2"), F.col("active")))
    over = F.col("_d1") - F.col("_d2")
    # One step short of the active leaf's depth, so that a leaf on the abandoned path shows its child.
    rows = f.lifted(rows.withColumn("_a", F.greatest(over - 1, F.lit(0))).withColumn("_b", F.greatest(-over, F.lit(0))), "_u", "_a")
    rows = f.joined(f.lifted(rows, "_v", "_b"), "_u", f.jumps[0], to="_p")
    rows = rows.withColumn("_found", (over > 0) & (F.col("_p") == F.col("_v")))
    rows = stored(rows.withColumn("child", F.when(F.col("_found"), F.col("_u"))).withColumn("_u", F.when((over > 0) & ~F.col("_found"), F.col("_p")).otherwise(F.col("_u"))))
    # From here on both stand at one depth; equal nodes are the abandoned leaf itself.
    apart = ~F.coalesce("_found", F.lit(True)) & (F.col("_u") != F.col("_v"))
    rows = rows.withColumn("_apart", F.coalesce(apart, F.lit(False))).withColumn("_left", F.least("_d1", "_d2"))
    for k in reversed(range(len(f.jumps))):
        rows = f.joined(f.joined(rows, "_u", f.jumps[k], to="_x"), "_v", f.jumps[k], to="_y")
        go = F.coalesce(F.col("_apart") & (F.col("_left") >= 1 << k) & (F.col("_x") != F.col("_y")), F.lit(False))
        rows = rows.withColumn("_go", go).withColumn("_u", F.when(F.col("_go"), F.col("_x")).otherwise(F.col("_u"))).withColumn("_v", F.when(F.col("_go"), F.col("_y")).otherwise(F.col("_v")))
        rows = stored(rows.withColumn("_left", F.when(F.col("_go"), F.col("_left") - (1 << k)).otherwise(F.col("_left"))).drop("_x", "_y", "_go"))
    rows = rows.withColumn("child", F.when(F.col("_apart"), F.col("_u")).otherwise(F.col("child")))
    level = F.when(F.col("_apart"), F.col("_left")).otherwise(F.col("_d2") + 1)
    return stored(rows.withColumn("down", F.when(F.col("child").isNotNull(), F.col("_d1") - level)).select(*pairs.columns, "child", "down"))


#: Nodes up to which a scope travels as one row and its paths are walked; larger ones are joined with doubled jumps.
SMALL = 512


def _upwards(leaf, parents: dict) -> list:
    """A node's path, itself first; it ends before it repeats a node, and is empty where the leaf is no node."""
    path, seen = [], set()
    while leaf is not None and leaf in parents and leaf not in seen:
        path.append(leaf)
        seen.add(leaf)
        leaf = parents[leaf]
    return path


def _root_entry(pair: tuple, parents: dict, entries: dict) -> str | None:
    up, other = (_upwards(leaf, parents) for leaf in pair)
    same = 0
    while same < min(len(up), len(other)) and up[-1 - same] == other[-1 - same]:
        same += 1
    below = up[:len(up) - same][::-1] if same else []
    return next((entries[x] for x in [*below, *up] if entries[x] is not None), None)


def _walked(nodes: DataFrame, asked: DataFrame, scope: list[str], kind: T.DataType, answer: Callable) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """`asked` in small scopes with `_found`, what answer(row of asked, parents, entries) gives; nodes and asked of the others, None if there are none.

    nodes(scope, id, parent_id, entry). One shuffle brings the nodes of a scope into one row, and another what is asked of it.
    """
    keys = [c for c in asked.columns if c not in scope]
    many = durable(nodes.groupBy(*scope).agg(F.count("*").alias("_n")).filter(F.col("_n") > SMALL).select(*scope))
    large = None
    if not many.isEmpty():
        large = tuple(df.join(_large(many), scope, "left_semi") for df in (nodes, asked))
        nodes, asked = (df.join(_large(many), scope, "left_anti") for df in (nodes, asked))
    of = nodes.groupBy(*scope).agg(F.collect_list(F.struct("id", "parent_id", "entry")).alias("_of"))
    rows = asked.groupBy(*scope).agg(F.collect_list(F.struct(*keys)).alias("_asked")).join(_large(of), scope, "left")

    def found(ids, ups, entries, *questions) -> list:
        parents, entries = dict(zip(ids or [], ups or [])), dict(zip(ids or [], entries or []))
        return [answer(q, parents, entries) for q in zip(*questions)]

    ship(nodes.sparkSession)
    told = F.udf(found, T.ArrayType(kind), useArrow=True)(*[F.col("_of")[c] for c in ("id", "parent_id", "entry")], *[F.col("_asked")[c] for c in keys])
    rows = rows.withColumn("_found", told).select(*scope, F.explode(F.arrays_zip("_asked", "_found")).alias("_r"))
    return rows.select(*[F.col(c) if c in scope else F.col(f"_r._asked.{c}").alias(c) for c in asked.columns], F.col("_r._found").alias("_found")), large


def branch_roots(nodes: DataFrame, pairs: DataFrame, scope: list[str]) -> DataFrame:
    """`pairs(scope, abandoned, active)` with `root`, the entry that an abandoned branch starts with.

    nodes(scope, id, parent_id, entry): entry is what a node became, null if nothing. The root
    is the entry of the first node with one on the abandoned path below where it leaves the
    active path. Where there is no such node, no common root, no active leaf, or where the
    abandoned leaf is on the active path, it is the entry of the nearest node upwards from the
    leaf, itself included, and without any the leaf's id. Small scopes are walked one by one.
    """
    nodes = nodes.select(*scope, "id", "parent_id", F.col("entry").cast("string").alias("entry"))
    few, large = _walked(nodes, pairs, scope, T.StringType(), _root_entry)
    out = few.select(*pairs.columns, F.coalesce("_found", F.col("abandoned").cast("string")).alias("root"))
    return out if large is None else out.unionByName(_joined_roots(*large, scope))


def _joined_roots(nodes: DataFrame, pairs: DataFrame, scope: list[str]) -> DataFrame:
    """branch_roots by doubled jumps."""
    forest = Forest(nodes.select(*scope, "id", "parent_id", "entry"), scope)
    own = forest.nodes
    # The nearest proper ancestor with an entry, and how far it is: found within 2^k steps, or the node that far up.
    has = own.select(*scope, F.col("id").alias("to"), F.col("entry").isNotNull().alias("hit"))
    near = stored(own.filter("parent_id is not null").select(*scope, "id", F.col("parent_id").alias("to"), F.lit(1).cast("long").alias("steps")).join(has, [*scope, "to"]))
    for _ in range(forest.rounds + 1):
        next_ = near.select(*scope, F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("hit").alias("found"))
        both = near.join(next_, [*scope, "to"], "left")
        go = ~F.col("hit") & F.col("far").isNotNull()
        near = stored(both.select(*scope, "id", F.when(go, F.col("far")).otherwise(F.col("to")).alias("to"), F.when(go, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"), F.when(go, F.col("found")).otherwise(F.col("hit")).alias("hit")))
    near = near.filter("hit").select(*scope, "id", "to", "steps")
    rows = diverging(forest, pairs)
    rows = forest.joined(forest.joined(rows, "abandoned", own, entry="_own"), "abandoned", near, to="_n", steps="_s")
    start = F.col("_own").isNotNull()
    rows = rows.withColumn("_at", F.when(start, F.col("abandoned")).otherwise(F.col("_n"))).withColumn("_gone", F.when(start, F.lit(0).cast("long")).otherwise(F.col("_s")))
    rows = rows.withColumn("_near", F.col("_at")).drop("_own", "_n", "_s")
    # Up along nodes with an entry, as far as the child allows.
    leaps = [near]
    for _ in forest.jumps[1:]:
        last = leaps[-1]
        leaps.append(stored(last.join(last.select(*scope, F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more")), [*scope, "to"]).select(*scope, "id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))))
    for leap in reversed(leaps):
        rows = forest.joined(rows, "_at", leap, to="_x", steps="_s").withColumn("_go", F.coalesce(F.col("_gone") + F.col("_s") <= F.col("down"), F.lit(False)))
        rows = stored(rows.withColumn("_at", F.when(F.col("_go"), F.col("_x")).otherwise(F.col("_at"))).withColumn("_gone", F.when(F.col("_go"), F.col("_gone") + F.col("_s")).otherwise(F.col("_gone"))).drop("_x", "_s", "_go"))
    rows = rows.withColumn("_at", F.when(F.col("_gone") <= F.col("down"), F.col("_at")).otherwise(F.col("_near")))
    rows = forest.joined(rows, "_at", own, entry="_entry")
    return rows.select(*pairs.columns, F.coalesce(F.col("_entry").cast("string"), F.col("abandoned").cast("string")).alias("root"))


def active_paths(nodes: DataFrame, leaves: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, leaf, id, up): all nodes on the path of each leaf, and how many steps up they are.

    leaves(scope, leaf); leaves that are no node have no path. Small scopes are walked one by one.
    """
    nodes = nodes.select(*scope, "id", "parent_id", F.lit(None).cast("string").alias("entry"))
    leaves = leaves.select(*scope, "leaf")
    few, large = _walked(nodes, leaves, scope, T.ArrayType(nodes.schema["id"].dataType), lambda row, parents, _: _upwards(row[0], parents))
    out = few.select(*scope, "leaf", F.posexplode("_found").alias("up", "id")).select(*scope, "leaf", "id", F.col("up").cast("long").alias("up"))
    return out if large is None else out.unionByName(_joined_paths(*large, scope))


def _joined_paths(nodes: DataFrame, leaves: DataFrame, scope: list[str]) -> DataFrame:
    """active_paths by doubled jumps: marks are pushed along jumps of 2^k steps, from the longest down, so a path of n nodes takes log n joins."""
    forest = Forest(nodes.select(*scope, "id", "parent_id"), scope)
    marks = forest.joined(leaves.select(*scope, "leaf"), "leaf", forest.depth, depth="_left").filter("_left is not null").select(*scope, "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"), "_left")
    for k in reversed(range(len(forest.jumps))):
        far = marks.filter(F.col("_left") >= 1 << k).join(forest.jumps[k], [*scope, "id"]).select(*scope, "leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"), (F.col("_left") - (1 << k)).alias("_left"))
        marks = stored(marks.unionByName(far))
    return marks.drop("_left")


def divergence_roots(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(abandoned, active, root): the node where an abandoned branch leaves the path of the active one.

    It is the topmost node of the abandoned path that is not on the active path; null if
    the whole abandoned path is on it. pairs(abandoned, active) are leaves.
    """
    forest = Forest(edges.withColumn("tree", F.lit(0)).select("tree", "id", "parent_id"), ["tree"])
    rows = diverging(forest, pairs.select(F.lit(0).alias("tree"), "abandoned", "active"))
    rows = forest.joined(forest.joined(rows, "abandoned", forest.depth, root="_r1"), "active", forest.depth, root="_r2")
    return rows.select("abandoned", "active", F.coalesce("child", F.when(F.col("_r1") != F.col("_r2"), F.col("_r1"))).alias("root"))
