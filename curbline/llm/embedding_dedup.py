"""Near-duplicate vectors by NN-descent on a neighbour graph.

Equal vectors of a label are one node.  Neighbour lists start from rows that stand together when sorted by random
sign patterns.  Every round joins neighbours of neighbours: around each node, its neighbours and those
that list it are compared with one another, and better edges enter the lists.  A node whose list is full of
links ("saturated") may have more of them: saturated nodes are covered by balls, and all balls of a label that
are near enough to link are compared, which joins the classes that full lists keep apart.  Every class is then
compared in blocks, so link counts are whole.  An audit compares a fixed number of nodes with all others; rounds
go on until its recall suffices.  It is repeated on the final link counts, and a label that falls short there is
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

EDGES = "u long, v long, s double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all lists of a call have one length."""
    m = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1)[:, None]


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(s, np.float64))], ["u", "v", "s"])


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Slices of equal values of a sorted column."""
    if not len(column):
        return []
    codes = pc.dictionary_encode(column).indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(cuts, cuts[1:]))


def _signed(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                m = _matrix(part.column("vec"))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(size)]).standard_normal((int(size), bits))
                    x = m @ planes
                    sign = ((x > 0) @ (1 << np.arange(bits))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("g"), pa.array(np.full(len(m), t), pa.int32()), pa.array(sign), pa.array(x[:, 0]), part.column("vec")], ["id", "g", "t", "sign", "x", "vec"])

    return run


def _joined_batches(first: pa.RecordBatch, second: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches([first, second]).combine_chunks().to_batches()[0]


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a column, cut anew so that all rows of a value stand in one batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else _joined_batches(held, batch)
        start = _runs(batch.column(column))[-1][0]
        if start:
            yield batch.slice(0, start)
        held = batch.slice(start)
    if held is not None:
        yield held


def _window(width: int):
    """Edges between rows at most ``width`` apart in their order, in the same table and group.

    The last rows of a batch stand before the next one again; only the borders of partitions part neighbours, and
    every table has other borders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if last is None else _joined_batches(last, batch)
            last = batch.slice(max(0, batch.num_rows - width))
            key = pc.binary_join_element_wise(batch.column("g"), pc.cast(batch.column("t"), pa.string()), "/")
            for lo, hi in _runs(key):
                m, ids = _matrix(batch.column("vec").slice(lo, hi - lo)), batch.column("id").slice(lo, hi - lo).to_numpy()
                for d in range(1, min(width, hi - lo - 1) + 1):
                    s = np.einsum("ij,ij->i", m[:-d], m[d:])
                    yield _edges(ids[:-d], ids[d:], s)
                    yield _edges(ids[d:], ids[:-d], s)

    return run


def _best(edges: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """(u, near: the k best (s, v)); a salted first step bounds what one task gathers for a hub."""
    top = lambda c: F.slice(F.sort_array(c, asc=False), 1, k)
    rank = F.struct(F.col("s") if order is None else order.alias("s"), "v", F.col("s").alias("sim"))
    part = edges.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(32)).alias("salt")).agg(top(F.collect_set(rank)).alias("near"))
    return part.groupBy("u").agg(top(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, m, floor, vec) sorted by c: edges between the members of a centre that beat a member's k-th similarity.

    A centre's members, at most twice a list's length and itself, are taken together.
    """
    for batch in _whole(batches, "c"):
        c, floor = batch.column("c"), batch.column("floor").to_numpy()
        ids, vec = batch.column("m").to_numpy(), batch.column("vec")
        if not len(ids):
            continue
        sizes = pc.list_value_length(vec).to_numpy()
        whole = _matrix(vec) if (sizes == sizes[0]).all() else None
        out = [], [], []
        for lo, hi in _runs(c):
            m = _matrix(vec.slice(lo, hi - lo)) if whole is None else whole[lo:hi]
            s = m @ m.T
            a, b = np.nonzero((s > floor[lo:hi, None]) & (ids[lo:hi, None] != ids[None, lo:hi]))
            out[0].append(ids[lo:hi][a])
            out[1].append(ids[lo:hi][b])
            out[2].append(s[a, b])
        yield _edges(*(np.concatenate(x) for x in out))


def _counted(threshold: float):
    """Links between the members of two blocks of a class, for the members of the first block."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, links = [], []
        if left.num_rows and right.num_rows:
            a, b = (_matrix(t.column("vec").combine_chunks()) for t in (left, right))
            s = a @ b.T >= threshold
            own = left.column("id").to_numpy()[:, None] == right.column("id").to_numpy()[None, :]
            ids = left.column("id").to_numpy()
            links = ((s & ~own) * right.column("copies").to_numpy()[None, :]).sum(axis=1)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def _covered(threshold: float):
    """Balls around members of one part of a class: the first member left takes all left that link to it."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        m, ids = _matrix(part.column("vec").combine_chunks()), part.column("id").to_numpy()
        ball, cosine = np.full(len(ids), -1), np.ones(len(ids))
        while (left := np.flatnonzero(ball < 0)).size:
            s = m[left] @ m[left[0]]
            s[0] = 1.0
            ball[left[s >= threshold]], cosine[left[s >= threshold]] = left[0], s[s >= threshold]
        least = np.ones(len(ids))
        np.minimum.at(least, ball, cosine)
        radius = np.arccos(np.clip(least, -1.0, 1.0))
        return pa.table({"g": part.column("g"), "component": part.column("component"), "id": part.column("id"), "ball": pa.array(ids[ball]), "radius": pa.array(radius[ball]), "vec": part.column("vec")})

    return run


def _near_balls(threshold: float):
    """Pairs of balls of two blocks that belong to different classes and are near enough to hold a link."""
    reach = float(np.arccos(threshold)) + 1e-6

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        u = v = np.zeros(0, np.int64)
        s = np.zeros(0)
        if left.num_rows and right.num_rows:
            a, b = (_matrix(t.column("vec").combine_chunks()) for t in (left, right))
            cosine = np.clip(a @ b.T, -1.0, 1.0)
            near = np.arccos(cosine) <= left.column("radius").to_numpy()[:, None] + right.column("radius").to_numpy()[None, :] + reach
            x, y = np.nonzero(near & (left.column("component").to_numpy()[:, None] != right.column("component").to_numpy()[None, :]))
            u, v, s = left.column("id").to_numpy()[x], right.column("id").to_numpy()[y], cosine[x, y]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float64())})

    return run


def _closest(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The best edge between the members of two balls."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    a, b = (_matrix(t.column("vec").combine_chunks()) for t in (left, right))
    s = a @ b.T
    x, y = np.unravel_index(s.argmax(), s.shape)
    return pa.table({"u": left.column("id").take([x]), "v": right.column("id").take([y]), "s": pa.array([float(s[x, y])])})


def _paired(rows: DataFrame, by: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of equal ``by``, dealt in blocks i <= j that all meet: the left rows and the right rows of every pair."""
    size = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = stage(rows.join(size, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "dealt")
    left = dealt.select(*rows.columns, F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    right = dealt.select(*(F.col(c).alias(c) for c in rows.columns), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    return left, right


def bridges(nodes: DataFrame, edges: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (u, v, s) that join classes which full lists keep apart.

    A node whose list ends below the threshold holds all its links, so only links between two nodes whose
    lists are full of links can be missing.  Angles obey the triangle inequality: two balls hold a link only
    if their centres are no further apart than both radii and the threshold's angle.
    """
    full = edges.groupBy("u").agg(F.min("s").alias("least")).filter(F.col("least") >= threshold).select(F.col("u").alias("id"))
    member = full.join(classes, "id").join(nodes.select("id", "g", "vec"), "id")
    size = member.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    member = member.join(size, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    schema = f"g string, component long, id long, ball long, radius double, vec {kind_of(nodes)}"
    balls = stage(member.select("g", "component", "part", "id", "vec").groupBy("component", "part").applyInArrow(_covered(threshold), schema), "balls")
    centre = balls.filter("id = ball").select("g", "component", "id", "radius", "vec")
    left, right = _paired(centre, "g", block)
    keys = ["g", "i", "j"]
    near = stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_near_balls(threshold), EDGES).filter("u <> v"), "near-balls")
    # Centres that link need no look at their members.
    pair = near.filter(F.col("s") < threshold).select("u", "v")
    a = stage(pair.join(balls.select(F.col("ball").alias("u"), "id", "vec"), "u"), "ball-members")
    b = pair.join(balls.select(F.col("ball").alias("v"), "id", "vec"), "v")
    found = a.groupBy("u", "v").cogroup(b.groupBy("u", "v")).applyInArrow(_closest, EDGES)
    return near.unionByName(found).filter(F.col("s") >= threshold)


def kind_of(nodes: DataFrame) -> str:
    return nodes.schema["vec"].dataType.simpleString()


def neighbour_graph(nodes: DataFrame, k: int = 8, tables: int = 4, bits: int = 14, width: int = 4, rounds: int = 2, seed: int = 5, threshold: float = 0.98, audit_nodes: int = 256, min_recall: float = 0.95, more_rounds: int = 3) -> DataFrame:
    """Edges (u, v, s) of the refined lists of nodes (id, g, copies, vec); compared are nodes of one group g only."""
    signed = nodes.mapInArrow(_signed(tables, bits, seed), f"id long, g string, t int, sign long, x double, vec {kind_of(nodes)}")
    ordered = signed.repartitionByRange("t", "g", "sign", "x", "id").sortWithinPartitions("t", "g", "sign", "x", "id")
    graph = stage(_best(ordered.mapInArrow(_window(width), EDGES), k), "graph")
    done = 0
    while done < rounds + more_rounds:
        edges = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.sim").alias("s"))
        reverse = _best(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), k).select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"))
        around = edges.select("u", "v").unionByName(reverse).unionByName(graph.select("u", F.col("u").alias("v"))).distinct()
        floors = graph.select(F.col("u").alias("m"), F.when(F.size("near") >= k, F.col("near")[k - 1]["sim"]).otherwise(-2.0).alias("floor"))
        members = nodes.select(F.col("id").alias("m"), "vec").join(floors, "m", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        rows = around.select(F.col("u").alias("c"), F.col("v").alias("m")).join(members, "m")
        n = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        better = rows.select("c", "m", "floor", "vec").repartition(n, "c").sortWithinPartitions("c").mapInArrow(_local_join, EDGES)
        graph = stage(_best(edges.unionByName(better), k), "graph")
        done += 1
        if done >= rounds and recall(nodes, graph, threshold, audit_nodes, k) >= min_recall:
            break
        k += 0 if done < rounds else k // 2  # lists that the audit finds too short grow
    return graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.sim").alias("s"))


def _true_links(nodes: DataFrame, threshold: float, audit_nodes: int) -> DataFrame:
    """(u, g, n, copies): the links of ``audit_nodes`` nodes with all others, by nodes and by rows; audited nodes without one have zeros."""
    weight = F.col("copies") if "copies" in nodes.columns else F.lit(1)
    nodes = nodes.select("id", "g", "vec", weight.cast("long").alias("copies"))
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(audit_nodes).select("id", "g", "vec").collect()
    shared = nodes.sparkSession.sparkContext.broadcast([(r["id"], r["g"], np.array(r["vec"], np.float64)) for r in sample])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, ids, copies = np.array(batch.column("g").to_pylist(), object), batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            for group in {q[1] for q in shared.value}:
                here = np.flatnonzero(g == group)
                if not here.size:
                    continue
                m = _matrix(batch.column("vec").take(pa.array(here)))
                for i, own, v in shared.value:
                    if own == group:
                        s = m @ (v / np.linalg.norm(v))
                        hit = (s >= threshold) & (ids[here] != i)
                        yield pa.RecordBatch.from_pydict({"u": pa.array([i], pa.int64()), "g": [group], "n": pa.array([hit.sum()], pa.int64()), "copies": pa.array([copies[here][hit].sum()], pa.int64())})

    return nodes.mapInArrow(exact, "u long, g string, n long, copies long").groupBy("u", "g").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))


def recall(nodes: DataFrame, graph: DataFrame, threshold: float, audit_nodes: int, k: int) -> float:
    """Share of the links of ``audit_nodes`` nodes that their lists hold, as far as the lists reach; 1 without links.

    This ends the rounds only: what lists cannot hold is audited in the result by ``missed_groups``.
    """
    found = graph.select("u", F.size(F.filter("near", lambda e: e["sim"] >= threshold)).alias("f"))
    true = _true_links(nodes, threshold, audit_nodes)
    got = true.join(found, "u", "left").agg(F.sum(F.least(F.col("n"), F.lit(k))), F.sum(F.least(F.coalesce("f", F.lit(0)), F.least(F.col("n"), F.lit(k))))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def missed_groups(nodes: DataFrame, links: DataFrame, threshold: float, audit_nodes: int, min_recall: float) -> DataFrame:
    """The groups (g) whose final link counts (id, links) fall short of ``min_recall`` of all links of the audited nodes.

    A group without an audited link goes with the share of all groups together.
    """
    true = _true_links(nodes, threshold, audit_nodes).join(links.withColumnRenamed("id", "u"), "u", "left")
    by_group = stage(true.groupBy("g").agg(F.sum("copies").alias("n"), F.sum(F.coalesce("links", F.lit(0))).alias("f")), "audit")
    n, f = by_group.agg(F.sum("n"), F.sum("f")).first()
    if not n:
        return by_group.filter("false").select("g")
    short = F.when(F.col("n") > 0, F.col("f") < F.col("n") * min_recall).otherwise(F.lit(f < n * min_recall))
    groups = nodes.select("g").distinct().join(by_group, "g", "left")
    return stage(groups.filter(short).select("g"), "missed")


def _joined(threshold: float):
    """For two blocks of a group, the links of their rows as one star to each component's first member."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        u = v = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            a, b = (_matrix(t.column("vec").combine_chunks()) for t in (left, right))
            own, other = left.column("id").to_numpy(), right.column("id").to_numpy()
            s = (a @ b.T >= threshold) & (own[:, None] != other[None, :])
            x, y = own.copy(), other.copy()
            far = np.iinfo(np.int64).max
            while True:
                p = np.minimum(x, np.where(s, y[None, :], far).min(axis=1))
                q = np.minimum(y, np.where(s, p[:, None], far).min(axis=0))
                if (p == x).all() and (q == y).all():
                    break
                x, y = p, q
            u, v = np.concatenate([own, other]), np.concatenate([x, y])
        return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64()), "s": pa.array(np.ones((u != v).sum()))})

    return run


def exact_stars(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v, s) that connect what links connect, every node of a group being compared with all others of it."""
    left, right = _paired(nodes, "g", block)
    keys = ["g", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_joined(threshold), EDGES)


def class_links(nodes: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links) within whole classes: each is cut in blocks, and each block meets all blocks of its class."""
    size = classes.groupBy("component").agg(F.count("*").alias("size"))
    member = classes.join(size, "component").join(nodes.select("id", "copies", "vec"), "id").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    member = stage(member.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "class-members")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = member.select("component", F.col("part").alias("i"), other.alias("j"), "id", "vec")
    right = member.select("component", other.alias("i"), F.col("part").alias("j"), "id", "copies", "vec")
    counts = left.groupBy("component", "i", "j").cogroup(right.groupBy("component", "i", "j")).applyInArrow(_counted(threshold), "id long, links long")
    return stage(counts.groupBy("id").agg(F.sum("links").alias("links")), "class-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 1024, audit_nodes: int = 256, min_recall: float = 0.95, **graph) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows of one non-null label and of equal dimension link when their cosine in double precision reaches ``threshold``.
    Null, empty and zero vectors, and such as hold null or non-finite components, link with nothing, as do rows with
    a null id or label.  ``component_id`` is the smallest id that links reach.  Rows of equal id and vector count as
    copies of each other.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")  # no precision is lost
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("g", F.concat_ws(":", "label", F.size("vec").cast("string")))
    key = [F.xxhash64("g", "vec").alias("h1"), F.hash("vec", "g").alias("h2")]
    known = rows.filter("sound").select("id", "g", "vec", *key)
    nodes = stage(known.groupBy("g", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("vec", "id").alias("vec")), "vectors")
    edges = neighbour_graph(nodes.select("id", "g", "copies", "vec"), threshold=threshold, audit_nodes=audit_nodes, min_recall=min_recall, **graph)
    edges = stage(edges, "vector-edges")
    node = nodes.select("id", "g", "vec")
    found = components(edges.filter(F.col("s") >= threshold), "u", "v")
    more = bridges(node, edges, found, threshold, block)
    classes = stage(components(edges.filter(F.col("s") >= threshold).unionByName(more), "u", "v"), "vector-classes")

    links = class_links(nodes, classes, threshold, block)
    missed = missed_groups(nodes, links, threshold, audit_nodes, min_recall)
    if not missed.isEmpty():  # their labels are compared whole
        stars = stage(exact_stars(node.join(missed, "g"), threshold, block), "stars")
        classes = stage(components(classes.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(stars.select("u", "v")), "u", "v"), "vector-classes")
        links = class_links(nodes, classes, threshold, block)
    per_node = stage(nodes.select("g", "h1", "h2", F.col("id").alias("node"), "copies").join(links.withColumnRenamed("id", "node"), "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left"), "vector-links")
    found = known.drop("vec").join(per_node, ["g", "h1", "h2"])
    found = found.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.filter("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
