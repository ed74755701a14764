"""Walks over links: breadth-first traversal, closures, impact, inheritance, cycles, grants.

A loop's state is written to the cluster's shared folder each round, so lineage stays short and lost executors cost one
round; the driver only asks whether a frontier is empty.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.files import durable


def edges_of(links: DataFrame, predicate: str = "*", direction: str = "out") -> DataFrame:
    """map_id, src, dst, predicate in walking direction."""
    own = links if predicate == "*" else links.where(F.col("predicate") == predicate)
    out = own.select("map_id", F.col("source_uri").alias("src"), F.col("target_uri").alias("dst"), "predicate")
    back = own.select("map_id", F.col("target_uri").alias("src"), F.col("source_uri").alias("dst"), "predicate")
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def traverse(start: DataFrame, links: DataFrame, predicate: str = "*", direction: str = "out", depth: int = 1) -> DataFrame:
    """map_id, id, depth of all ids reached in at most `depth` steps, the start (map_id, id) left out.

    Each round joins the frontier with the edges and drops what has been seen; rounds are bounded by depth and end with
    an empty frontier. A single step is one join and needs no round trip.
    """
    edges = edges_of(links, predicate, direction).select("map_id", "src", "dst")  # a step drops what comes twice; all edges needn't
    begin = start.select("map_id", "id").distinct()
    if depth == 1:
        step = begin.withColumnRenamed("id", "src").join(edges, ["map_id", "src"]).select("map_id", F.col("dst").alias("id")).distinct()
        return step.join(begin, ["map_id", "id"], "left_anti").withColumn("depth", F.lit(1))
    edges = durable(edges, "edges")
    frontier = durable(begin, "frontier")
    seen, found = frontier, None
    for level in range(1, depth + 1):
        step = frontier.withColumnRenamed("id", "src").join(edges, ["map_id", "src"]).select("map_id", F.col("dst").alias("id")).distinct()
        frontier = durable(step.join(seen, ["map_id", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = frontier.withColumn("depth", F.lit(level))
        found = reached if found is None else found.unionByName(reached)
        seen = seen.unionByName(frontier)
    return found if found is not None else begin.where("false").withColumn("depth", F.lit(0))


def closure(edges: DataFrame) -> DataFrame:
    """node, ancestor, depth (>= 1, of the shortest way) of a graph of edges (node, up), of any depth.

    By doubling: after k rounds all pairs at most 2 ** k apart are known, and a jump is a way of exactly 2 ** k edges; a pair
    up to twice as far apart is a jump and a known pair. So a chain of a million takes twenty rounds. A round without a new
    pair ends it: a pair still further apart would have one of this round on its way. Cycles end by that too.
    """
    jump = durable(edges.select("node", "up").distinct(), "jumps")
    known, length = jump.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth")), 1
    while True:
        onward = known.select(F.col("node").alias("up"), "ancestor", "depth")
        step = jump.join(onward, "up").groupBy("node", "ancestor").agg((F.min("depth") + length).alias("depth"))
        fresh = durable(step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        jump = durable(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_far")), "up").select("node", F.col("_far").alias("up")).distinct(), "jumps")
        length *= 2


def chain_closure(edges: DataFrame) -> DataFrame:
    """The same as closure. Where every node has one edge and none leads into a ring, a round's pairs are all new: they are
    further apart than any known one, each once, so nothing is grouped or compared with what is known."""
    edges = durable(edges.select("node", "up").distinct(), "jumps")
    n = edges.count()
    if edges.select("node").distinct().count() < n:
        return closure(edges)
    jump, known, length = edges, edges.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth")), 1
    while True:
        # A jump joins a node of the middle with its own ancestors, of which there are at most `length`.
        onward = known.select(F.col("node").alias("up"), "ancestor", (F.col("depth") + length).alias("depth"))
        fresh = durable(jump.join(onward, "up").select("node", "ancestor", "depth"), "closure")
        if fresh.isEmpty():
            return known
        known, length = known.unionByName(fresh), 2 * length
        if length > n:  # longer than any chain can be: some lead into a ring
            return closure(edges)
        jump = durable(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_far")), "up").select("node", F.col("_far").alias("up")), "jumps")


def context_tree(contexts: DataFrame) -> DataFrame:
    """node, ancestor, depth of the containers, each also its own at depth 0."""
    own = contexts.select(F.col("uri").alias("node"), F.col("uri").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(chain_closure(contexts.where("parent_uri is not null").select(F.col("uri").alias("node"), F.col("parent_uri").alias("up"))))


def impact(start: DataFrame, links: DataFrame, owners: DataFrame, depth: int = 3) -> DataFrame:
    """map_id, id, depth, container_uri of everything that the start touches in either direction."""
    reached = traverse(start, links, "*", "both", depth)
    # Owners are many more than what is reached: those of the others go before anything is shuffled, if the reached are few.
    own = owners.select("map_id", "id", "container_uri").join(reached.select("map_id", "id"), ["map_id", "id"], "left_semi")
    return reached.join(own, ["map_id", "id"], "left")


def impact_report(start: DataFrame, links: DataFrame, owners: DataFrame, depth: int) -> DataFrame:
    """kind, id, predicate, depth of what depends on the start (map_id, id), in either direction: direct (a row for every link of a
    predicate and side, however often links has it), transitive (the least depth), container (of any of these; a context is its own; depth: how many of
    them it holds) and total (depth: how many are transitive)."""
    reached = durable(impact(start, links, owners, depth), "impact")
    begin = start.select("map_id", F.col("id").alias("_id"))
    out = links.join(begin.withColumnRenamed("_id", "source_uri"), ["map_id", "source_uri"]).select(F.col("target_uri").alias("id"), "predicate", F.lit("out").alias("_side"))
    into = links.join(begin.withColumnRenamed("_id", "target_uri"), ["map_id", "target_uri"]).select(F.col("source_uri").alias("id"), "predicate", F.lit("in").alias("_side"))
    none, n = F.lit(None).cast("string"), F.count(F.lit(1)).cast("int")
    direct = out.unionByName(into).distinct().select(F.lit("direct").alias("kind"), "id", "predicate", F.lit(1).alias("depth"))
    further = reached.select(F.lit("transitive").alias("kind"), "id", none.alias("predicate"), F.col("depth").cast("int").alias("depth"))
    places = reached.groupBy(F.col("container_uri").alias("id")).agg(n.alias("depth")).where("id is not null").select(F.lit("container").alias("kind"), "id", none.alias("predicate"), "depth")
    return direct.unionByName(further).unionByName(places).unionByName(reached.agg(n.alias("depth")).select(F.lit("total").alias("kind"), none.alias("id"), none.alias("predicate"), "depth"))


def inherit_attributes(extends: DataFrame, attributes: DataFrame) -> DataFrame:
    """thing, attribute, owner, depth: own attributes win, then those of the nearest ancestor. extends (node, up) has one
    row per Thing (its first link); attributes: thing, attribute."""
    up = closure(extends).where("node != ancestor")
    own = attributes.select("thing", "attribute", F.col("thing").alias("owner"), F.lit(0).alias("depth"))
    theirs = up.join(attributes.withColumnRenamed("thing", "ancestor"), "ancestor").select(F.col("node").alias("thing"), "attribute", F.col("ancestor").alias("owner"), "depth")
    nearest = own.unionByName(theirs).groupBy("thing", "attribute").agg(F.min(F.struct("depth", "owner")).alias("n"))
    return nearest.select("thing", "attribute", F.col("n.owner").alias("owner"), F.col("n.depth").alias("depth"))


def inheritance_chains(extends: DataFrame) -> DataFrame:
    """node, ancestor, depth, circular of extends links (node, up; one per node): the chain of every Thing, itself left out, and
    whether it runs into a cycle."""
    pairs = durable(closure(extends), "chains")
    rings = pairs.where("node = ancestor").select("node")
    caught = rings.union(pairs.join(rings.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("node")).distinct().withColumn("_caught", F.lit(True))
    return pairs.where("node != ancestor").join(caught, "node", "left").select("node", "ancestor", "depth", F.coalesce("_caught", F.lit(False)).alias("circular"))


def circular_extends(extends: DataFrame, order: str = "dst") -> DataFrame:
    """id of the Things on a cycle of extends links (src, dst, order); a Thing's last link counts.

    By doubling: of the ways of 2 ** k links, the ends are fewer each round until only Things on cycles are left; if a
    round loses none, all that are left are on cycles.
    """
    jump = durable(extends.groupBy("src").agg(F.max_by("dst", order).alias("dst")), "jumps")
    n = jump.select("dst").distinct().count()
    while True:
        jump = durable(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst")), "jumps")
        before, n = n, jump.select("dst").distinct().count()
        if n == before:
            return jump.select(F.col("dst").alias("id")).distinct()


def extends_neighbours(extends: DataFrame) -> DataFrame:
    """id, side (parent or child), neighbour of both ends of extends links (source_uri, target_uri)."""
    up = extends.select(F.col("source_uri").alias("id"), F.lit("parent").alias("side"), F.col("target_uri").alias("neighbour"))
    return up.union(extends.select("target_uri", F.lit("child"), "source_uri"))


#: Edges of a block; orders of nodes that are drawn at once; how many of the edges must go for another round of the same kind.
BLOCK, DRAWS, LESS = 100_000, 4, 0.7


def _strong(n: int, out: list[list[int]]) -> list[int]:
    """For each of n nodes the number of its strongly connected component (Tarjan's, without recursion)."""
    index, low, own, held, stack, seen, parts = [0] * n, [0] * n, [-1] * n, [False] * n, [], 0, 0
    for root in range(n):
        if index[root]:
            continue
        work = [(root, iter(out[root]))]
        while work:
            x, rest = work[-1]
            if not index[x]:
                seen += 1
                index[x] = low[x] = seen
                stack.append(x)
                held[x] = True
            for y in rest:
                if not index[y]:
                    work.append((y, iter(out[y])))
                    break
                if held[y]:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    while own[x] < 0:
                        y = stack.pop()
                        own[y], held[y] = parts, False
                    parts += 1
    return own


def _reached(starts: list[int], out: list[list[int]]) -> set[int]:
    seen, work = set(starts), list(starts)
    while work:
        for y in out[work.pop()]:
            if y not in seen:
                seen.add(y)
                work.append(y)
    return seen


def _solve_block(block: pa.Table) -> pa.Table:
    """id, component (NULL: on no cycle within the block), part (who stands for it outside; NULL: on no cycle that leaves the block)
    of a block's rows: edges within it (src, dst), nodes that edges enter (dst only) or leave by (src only)."""
    src, dst = block.column("src").to_pylist(), block.column("dst").to_pylist()
    ids = sorted({x for x in src if x is not None} | {x for x in dst if x is not None})
    number = {x: k for k, x in enumerate(ids)}
    out, back, loops = [[] for _ in ids], [[] for _ in ids], set()
    for a, b in zip(src, dst, strict=True):
        if a is not None and b is not None:
            out[number[a]].append(number[b])
            back[number[b]].append(number[a])
            if a == b:
                loops.add(number[a])
    entered, left = [number[b] for a, b in zip(src, dst, strict=True) if a is None], [number[a] for a, b in zip(src, dst, strict=True) if b is None]
    own = _strong(len(ids), out)
    size, first = Counter(own), {}
    for k, part in enumerate(own):
        first.setdefault(part, ids[k])
    onward = _reached(entered, out) & _reached(left, back)
    component = [first[part] if size[part] > 1 or k in loops else None for k, part in enumerate(own)]
    stands = [first[part] if k in onward else None for k, part in enumerate(own)]
    kind = block.schema.field("src").type
    return pa.table({"id": pa.array(ids, kind), "component": pa.array(component, kind), "part": pa.array(stands, kind)})


def by_blocks(edges: DataFrame, rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, component, part of the nodes, as _solve_block has them; edges between parts that are left). Nodes are cut into
    ranges with some `rows` edges each, and only what lies within a block goes to its task; where neighbours have near ids most
    of a graph falls together at once."""
    blocks = max(1, -(-edges.count() // rows))
    ranged = durable(edges.repartitionByRange(blocks, "src").withColumn("block", F.spark_partition_id()), "blocks")
    places = ranged.select("src", "block").distinct().select(F.col("src").alias("dst"), F.col("block").alias("to"))
    known = durable(ranged.join(places, "dst"), "edges")  # a node without edges of its own is on no cycle
    none, id_type = F.lit(None), edges.schema["src"].dataType.simpleString()
    inside, across = known.where("block = to").select("block", "src", "dst"), known.where("block != to")
    inside = inside.unionByName(across.select(F.col("to").alias("block"), none.cast(id_type).alias("src"), "dst").distinct())
    inside = inside.unionByName(across.select("block", "src", none.cast(id_type).alias("dst")).distinct())
    solved = durable(inside.groupBy("block").applyInArrow(lambda table: _solve_block(table), f"id {id_type}, component {id_type}, part {id_type}"), "parts")
    onward = solved.where("part is not null")
    end = lambda name: onward.select(F.col("id").alias(name), F.col("part").alias(f"_{name}"))
    left = known.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").where("_src != _dst")
    return solved, durable(left.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "edges")


def _tops(edges: DataFrame, salt: int) -> DataFrame:
    """id, draw, way, top: in each of several random orders the first of all nodes that a node is reached from (way 0), itself
    included, and of those it reaches (way 1). A node takes its neighbours' tops and its top's top, so that the reach of
    most grows by doubling; way and order are part of the row, so one loop finds all."""
    ways = edges.select("src", "dst", F.lit(0).alias("way")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way")))
    ways = durable(ways.where("src != dst"), "ways")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = nodes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    tops = durable(nodes.withColumn("top", F.struct(F.xxhash64("id", "draw", F.lit(salt)).alias("rank"), F.col("id").alias("id"))), "tops")
    while True:
        near = ways.join(tops.withColumnRenamed("id", "src"), ["src", "way"]).groupBy(F.col("dst").alias("id"), "draw", "way").agg(F.max("top").alias("_near"))
        far = tops.select(F.col("id").alias("_at"), "draw", "way", F.col("top").alias("_far"))
        own = tops.withColumn("_at", F.col("top.id")).join(far, ["_at", "draw", "way"]).join(near, ["id", "draw", "way"], "left")
        new = durable(own.select("id", "draw", "way", F.greatest("top", "_far", F.coalesce("_near", "top")).alias("top"), F.col("top").alias("old")), "tops")
        tops = new.select("id", "draw", "way", "top")
        if new.where("top != old").isEmpty():
            return tops


def shorten(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without chains; id, a, b of the nodes of chains and the ends of theirs; id, component of rings that nothing
    joins). A node in a chain has one edge in and one out, so it lies on a cycle if the chain's two ends are in one component.
    Ends are found by doubling, both ways at once; a ring has none, and its smallest node is known by then."""
    only = lambda own, other, name: edges.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias(f"_{name}"), F.min(other).alias(name))
    inner = only("src", "dst", "b").join(only("dst", "src", "a"), "id").where("_a = 1 and _b = 1 and a != id").select("id", "a", "b", F.col("id").alias("low"), F.lit(True).alias("moved"))
    inner = durable(inner, "chains")
    n, reach = inner.count(), 1
    while n:
        ahead = inner.select(F.col("id").alias("b"), F.col("b").alias("_b"), F.col("low").alias("_low"))
        behind = inner.select(F.col("id").alias("a"), F.col("a").alias("_a"))
        met = inner.join(ahead, "b", "left").join(behind, "a", "left")
        inner = durable(met.select("id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), F.least("low", F.coalesce("_low", "low")).alias("low"), (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("moved")), "chains")
        reach *= 2
        # When steps are longer than all chains, only rings still move.
        if reach > 2 * n or inner.where("moved").isEmpty():
            break
    rings = inner.where("moved").select("id", F.col("low").alias("component"))
    chains = inner.where("not moved").select("id", "a", "b")
    starts = edges.join(inner.select(F.col("id").alias("src")), "src", "left_anti")
    short = starts.join(chains.select(F.col("id").alias("dst"), "b"), "dst", "left").select("src", F.coalesce("b", "dst").alias("dst")).distinct()
    return durable(short, "edges"), chains, rings


def components(edges: DataFrame, rows: int = BLOCK, salt: int = 0) -> DataFrame:
    """id, component of the nodes on cycles (edges: src, dst): strongly connected components.

    Blocks of near ids find those within them, which stand as one node from then on, and leave out what no way through the block
    meets; that is done as long as it leaves far fewer edges. Then nodes that nothing points to, or that point to nothing, and
    chains are taken out. Of what is left every node gets its tops (_tops) in several random orders, both ways. Who is
    reached from and reaches the same top is in its component, which is whole by that; an edge between nodes whose tops
    differ is on no cycle. The rest goes on with other orders, and what was taken out is put in again. A top parts a row of
    components at a random place, so levels and rounds grow with the logarithm of its length; pairs of nodes are never made.
    """
    core, taken, solved = durable(edges.select("src", "dst").distinct(), "edges"), [], []
    n = core.count()
    while n:
        parts, core = by_blocks(core, rows)
        solved.append(parts)
        before, n = n, core.count()
        if n > LESS * before:
            break
    if n:
        core, chains, rings = shorten(core)
        taken.append((chains, rings))
        n = core.count()
    found = edges.select(F.col("src").alias("id"), F.col("src").alias("component")).where("false")
    if n:
        end = lambda way: F.max(F.when(F.col("way") == way, F.col("top.id")))
        ends = _tops(core, salt).groupBy("id", "draw").agg(end(0).alias("a"), end(1).alias("b"))
        kinds = ends.groupBy("id").agg(F.min(F.when(F.col("a") == F.col("b"), F.struct("draw", "a"))).alias("own"), F.sort_array(F.collect_list(F.struct("draw", "a", "b"))).alias("tops"))
        kinds = durable(kinds.select("id", F.col("own.a").alias("component"), F.sha2(F.to_json("tops"), 256).alias("tops")), "kinds")
        side = lambda name: kinds.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"), "tops")
        inner = durable(core.join(side("src"), "src").join(side("dst"), ["dst", "tops"]).select("src", "dst", F.col("_src").alias("component")), "inner")
        found = found.unionByName(inner.where("component is not null").select(F.col("src").alias("id"), "component").distinct())
        rest = inner.where("component is null").select("src", "dst")
        if not rest.isEmpty():
            found = found.unionByName(components(rest, rows, salt + 1))
    for chains, rings in taken:
        known = durable(found.unionByName(rings), "components")
        one = chains.join(known.select(F.col("id").alias("a"), "component"), "a").join(known.select(F.col("id").alias("b"), F.col("component").alias("_far")), "b").where("component = _far")
        found = known.unionByName(one.select("id", "component"))
    for parts in reversed(solved):
        later = durable(found, "components").select(F.col("id").alias("part"), F.col("component").alias("_later"))
        found = parts.join(later, "part", "left").select("id", F.coalesce("_later", "component").alias("component")).where("component is not null")
    return found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on any cycle (edges: src, dst)."""
    return components(edges).select("id")


# Capabilities from weak to strong.
CAPABILITIES = ("viewer", "editor", "owner")


def grants(users: DataFrame, personas: DataFrame, granted: DataFrame) -> DataFrame:
    """user, capability: the strongest grant of the user's persona (user, persona) or of any persona above it (node, up),
    viewer without one. granted: persona, capability."""
    above = closure(personas)
    reach = users.unionByName(users.join(above.withColumnRenamed("node", "persona"), "persona").select("user", F.col("ancestor").alias("persona"))).distinct()
    rank = F.array_position(F.array(*[F.lit(c) for c in CAPABILITIES]), F.col("capability"))
    best = reach.join(granted.withColumn("rank", rank), "persona").groupBy("user").agg(F.max("rank").alias("rank"))
    name = F.element_at(F.array(*[F.lit(c) for c in CAPABILITIES]), F.coalesce("rank", F.lit(1)).cast("int"))
    return users.select("user").distinct().join(best, "user", "left").select("user", name.alias("capability"))


def first_link(links: DataFrame, predicate: str, order: str, last: bool = False) -> DataFrame:
    """One link per source: the first or last by `order`."""
    way = F.col(order).desc() if last else F.col(order)
    ranked = links.where(F.col("predicate") == predicate).withColumn("_n", F.row_number().over(Window.partitionBy("map_id", "source_uri").orderBy(way)))
    return ranked.where("_n = 1").drop("_n")
