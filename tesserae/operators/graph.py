"""Graphs as edge tables (src, dst): degrees, reachability, depth, components, cycles, orders.

The loops join a frontier or a label table with the edges, one job a round, and write each round to the shared folder.
Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.iterate import drop_path, new_path, written


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()


def fan(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out; parallel edges count."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(reversed_edges(edges)).distinct()


def depth(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: the least number of steps from any of the roots (node); nodes out of reach are left out."""
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").distinct(), "edges")
    paths = [new_path(spark, "depth")]
    frontier = written(roots.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)), "depth", paths[0])
    d = 0
    while (most is None or d < most) and frontier.head(1):
        d += 1
        seen = spark.read.schema(frontier.schema).parquet(*paths)
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        paths.append(new_path(spark, "depth"))
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "depth", paths[-1])
    return spark.read.schema(frontier.schema).parquet(*paths)


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that can be reached from roots; roots are, even without an edge."""
    return depth(edges, roots).select("node")


def closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """What is tied to the changed nodes in either direction, themselves included."""
    return depth(undirected(edges), changed).select("node")


def lineage(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root: for each reached node the least root that reaches it."""
    return spread(edges, roots.select("node", F.col("node").alias("label")).distinct()).select("node", F.col("label").alias("root"))


def spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node (node, label) along the edges."""
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").filter("src != dst").distinct(), "edges")
    last = new_path(spark, "labels")
    cur = written(labels.groupBy("node").agg(F.min("label").alias("label")), "labels", last)
    changed = cur
    while changed.head(1):
        moved = changed.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        path = new_path(spark, "labels")
        old = cur.select(F.col("node").alias("n"), "label")
        nxt = written(
            moved.join(old, F.col("node") == F.col("n"), "full").select(F.coalesce("node", "n").alias("node"), F.least("label", "new").alias("label"), (F.col("new").isNotNull() & (F.col("label").isNull() | (F.col("new") < F.col("label")))).alias("moved")),
            "labels", path,
        )
        drop_path(spark, last)
        last, cur = path, nxt.select("node", "label")
        changed = nxt.filter("moved").select("node", "label")
    return cur


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components as (node, root), root being the least node, by alternating large-star and small-star steps.

    The number of rounds grows with the logarithm of the diameter. A step is a map-side combined minimum for each node,
    written as a table, and a join of the edges with it: both sides of that join are exchanges of their own, so Spark
    can split the partition of a node that has most of the edges.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    minima: list[str] = []

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        paths.append(new_path(spark, "components"))
        df = written(df, "components", paths[-1])
        for p in minima:
            drop_path(spark, p)
        minima.clear()
        return df, tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        swapped = df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = df.unionAll(swapped) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        minima.append(new_path(spark, "minima"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "minima", minima[-1])
        linked = both.join(least, F.col("a") == F.col("n"))
        if large:
            out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    start = edges.filter("src is not null and dst is not null and src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    cur, mark = kept(start)
    for _ in range(rounds if mark[0] else 0):
        half = new_path(spark, "stars")
        large = written(star(cur, True), "stars", half)
        minima.append(half)
        nxt, now = kept(star(large, False))
        for p in paths[:-1]:
            drop_path(spark, p)
        del paths[:-1]
        cur, done, mark = nxt, now == mark, now
        if done:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    root = F.col("b").alias("root")
    return cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), root), F.struct(F.col("b").alias("node"), root))).alias("x")).select("x.node", "x.root").distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that can be part of a cycle: nodes without a way in or a way out are taken off until none is left."""
    e = written(edges.select("src", "dst").filter("src != dst").distinct(), "trim")
    n = e.count()
    while n:
        inner = e.select(F.col("src").alias("node")).distinct().intersect(e.select(F.col("dst").alias("node")).distinct())
        inner = written(inner, "inner")
        nxt = written(e.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "trim")
        left = nxt.count()
        if left == n:
            break
        e, n = nxt, left
    return e


def scc(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node as (node, scc), scc being the least node.

    Least labels spread forward; a node that keeps its own label roots a component, which holds the nodes of
    that label from which the root can be reached. Found components go, and the rest is done again.
    """
    spark = edges.sparkSession
    e = trimmed(edges)
    out: DataFrame | None = None
    while e.head(1):
        labels = spread(e, nodes(e).select("node", F.col("node").alias("label")))
        of_src = labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))
        of_dst = labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
        inner = written(e.join(of_src, "src").join(of_dst, "dst").filter("ls = ld").select("src", "dst", "ls"), "inner")
        roots = labels.filter("node = label").select("node")
        back = depth(reversed_edges(inner.select("src", "dst")), roots).select("node")
        found = labels.join(back, "node", "left_semi").select("node", F.col("label").alias("scc"))
        big = found.groupBy("scc").count().filter("count > 1").select("scc")
        part = written(found.join(big, "scc", "left_semi").select("node", "scc"), "scc")
        out = part if out is None else out.unionAll(part)
        done = written(found.select("node"), "done")
        rest = inner.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        e = trimmed(rest)
    kind = edges.schema["src"].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"node {kind}, scc {kind}")


def levels(edges: DataFrame) -> DataFrame:
    """node, level: nodes without a way in are level 0, the others one over their highest predecessor; null on and behind cycles."""
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").distinct(), "edges")
    left = written(nodes(e), "left")
    parts: list[DataFrame] = []
    level = 0
    while True:
        ready = written(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)), "ready")
        if not ready.head(1):
            break
        parts.append(ready)
        left = written(left.join(ready.select("node"), "node", "left_anti"), "left")
        e = written(e.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    out = rest
    for p in parts:
        out = out.unionAll(p)
    return out if parts or edges.head(1) else spark.createDataFrame([], rest.schema)


def importance(facts: DataFrame) -> DataFrame:
    """facts (node, complexity, fan_in, fan_out, layer_weight) with importance 0 to 1: .15 complexity, .25 degree of the greatest, .20 degree of 50, .30 fan-in of the greatest, .10 layer."""
    most = facts.agg(F.max("fan_in").alias("fan_in"), F.max(F.col("fan_in") + F.col("fan_out")).alias("degree")).first()
    degree = F.col("fan_in") + F.col("fan_out")
    score = (
        0.15 * F.least(F.col("complexity") / 50.0, F.lit(1.0)) + 0.25 * degree / max(most.degree or 1, 1) + 0.20 * F.least(degree / 50.0, F.lit(1.0)) + 0.30 * F.col("fan_in") / max(most.fan_in or 1, 1)
        + 0.10 * F.col("layer_weight")
    )
    return facts.select("node", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("importance"))


def layer_matrix(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """src_layer, dst_layer, n: how many edges lead from layer to layer; layers: (node, layer)."""
    s, d = layers.select(F.col("node").alias("src"), F.col("layer").alias("src_layer")), layers.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(s, "src").join(d, "dst").groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz digraph, one for each distinct edge."""
    return edges.select("src", "dst").distinct().select(F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
