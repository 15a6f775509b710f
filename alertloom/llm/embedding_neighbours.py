"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a multiplicity. A neighbour graph starts from blocks of random hyperplanes that are
compared exactly: of a component's links in a block the nearest of each node and spanning ones are kept, never all pairs. It
is refined by neighbours-of-neighbours joins until a round adds nothing that passes the threshold. A node's list holds
its LIST nearest neighbours; a list whose neighbours all pass the threshold is saturated and is enlarged past them, until
LIST neighbours of other components are in it, and the joins pair members of different components only: at the end the
members of each component of threshold edges are compared with each other exactly, in tiles, so links in it are
complete however many there are. Recall is audited by comparing a sample of nodes with all, each
component counting once; more trees follow if it is low, and in the end an exact comparison of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, partitions

LIST, BLOCK, TILE, TREES, AUDIT = 10, 512, 512, 12, 400
#: Edges under this cosine (or under the threshold, where that is lower) lead nowhere: they are not followed.
FOLLOW = 0.6
_EDGES = "a long, b long, cosine double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length in double precision, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _same_dim(rows: pd.DataFrame) -> np.ndarray:
    return unit_rows(np.array(rows["v"].tolist(), dtype=np.float64))


def _codes(trees: range, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * (trees.stop)))
                signs = (unit_rows(_matrix(part.column(1))) @ planes[dim]) > 0
                for t in trees:
                    code = (signs[:, t * bits : (t + 1) * bits] * (1 << np.arange(bits))).sum(axis=1) + (dim << 40)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), t, np.int32)), pa.array(code.astype(np.int64))], ["node", "v", "tree", "code"])

    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, parent): the least index each row reaches over the links ``near``, and the row that it got it from (-1 for the least itself)."""
    size = len(near)
    label, parent = np.arange(size), np.full(size, -1)
    while True:
        told = np.where(near, label[None, :], size)
        source = told.argmin(axis=1)
        least = told[np.arange(size), source]
        lower = least < label
        if not lower.any():
            return label, parent
        parent[lower], label[lower] = source[lower], least[lower]


def _block_edges(threshold: float):
    """Each node's LIST nearest of its own component in the block and of others, and links that span each component: each pair once."""
    follow = min(FOLLOW, threshold)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, node = _same_dim(rows), rows["node"].to_numpy()
        c = x @ x.T
        np.fill_diagonal(c, -2)
        label, parent = _forest(c >= threshold)
        keep = c >= follow
        if len(node) > LIST + 1:
            same = label[:, None] == label[None, :]
            listed = np.zeros_like(same)
            for among in (same, ~same):
                np.put_along_axis(listed, np.argpartition(np.where(among, c, -2), -LIST, axis=1)[:, -LIST:], True, axis=1)
            keep &= listed
            child = np.flatnonzero(parent >= 0)
            keep[child, parent[child]] = True
        i, j = np.nonzero(keep)
        once = pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "cosine": c[i, j]})
        return once.drop_duplicates(["a", "b"])

    return run


def _pair_cosines(threshold: float):
    follow = min(FOLLOW, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
            cosine = np.full(batch.num_rows, -2.0)
            for dim in np.unique(nx[nx == ny]).tolist():
                at = np.flatnonzero((nx == dim) & (ny == dim))
                cosine[at] = (unit_rows(_matrix(x.take(pa.array(at)))) * unit_rows(_matrix(y.take(pa.array(at))))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["a", "b", "cosine"]).filter(pa.array(cosine >= follow))

    return run


def _bridges(threshold: float):
    """Of a pair of tiles one edge that passes the threshold for each two components that have any."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in rows.groupby(rows["v"].map(len), sort=False):
            x, node, comp = _same_dim(tile), tile["node"].to_numpy(), tile["comp"].to_numpy()
            c = x @ x.T
            i, j = np.nonzero((c >= threshold) & (comp[:, None] < comp[None, :]))
            found = pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "cosine": c[i, j], "ci": comp[i], "cj": comp[j]})
            out.append(found.drop_duplicates(["ci", "cj"])[["a", "b", "cosine"]])
        return pd.concat(out)

    return run


def bridges(nodes: DataFrame, joined: DataFrame, threshold: float, n: int) -> DataFrame:
    """Edges between different components of ``joined``, from comparing all nodes with all in tiles: every two that have a link get one."""
    tiles = max(1, -(-n // TILE))
    named = nodes.select("node", "v").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("tile", F.pmod(F.xxhash64("node"), F.lit(tiles)))
    dealt = named.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    return dealt.groupBy("i", "j").applyInPandas(_bridges(threshold), _EDGES)


def trees_for(threshold: float, bits: int, least_recall: float, least: int) -> int:
    """Trees in which two vectors at the threshold share a block at least once with probability ``least_recall``; ``least`` at least."""
    share = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    missed = max(1 - least_recall, 1e-3)
    return least if share >= 1 else max(least, int(np.ceil(np.log(missed) / np.log(1 - share))))


def audited_recall(truth: DataFrame, joined: DataFrame) -> float | None:
    """Share of the true pairs whose ends are in one component: the mean over the components of the sampled ends, each counting once."""
    pair = truth.join(joined.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    each = pair.groupBy(F.coalesce("ca", "a").alias("comp")).agg(F.avg(F.when(F.coalesce("ca", "a") == F.coalesce("cb", "b"), 1.0).otherwise(0.0)).alias("hit"))
    return each.agg(F.avg("hit")).first()[0]


def _bits(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n / BLOCK)))))


def _tile_links(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for (_, i, j), tile in rows.groupby(["comp", "i", "j"], sort=False):
            x, node, times, own = _same_dim(tile), tile["node"].to_numpy(), tile["times"].to_numpy(), tile["tile"].to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None, :]
            out.append((node, near @ times))
        return pd.DataFrame({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out])})

    return run


def _audit(sample, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dims, vectors = sample.value
        for batch in batches:
            own = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(dims).tolist():
                at, mine = np.flatnonzero(own == dim), np.flatnonzero(dims == dim)
                if len(at):
                    c = unit_rows(_matrix(batch.column(1).take(pa.array(at)))) @ unit_rows(np.array([vectors[k] for k in mine])).T
                    i, j = np.nonzero(c >= threshold)
                    node = batch.column(0).to_numpy()[at][i]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine][j]), pa.array(node)], ["a", "b"]).filter(pa.array(node != ids[mine][j]))

    return run


def neighbour_graph(nodes: DataFrame, threshold: float, trees: range, edges: DataFrame | None, n: int) -> DataFrame:
    """(a, b, cosine), a < b: the graph after the blocks of ``trees`` and as many rounds as add edges that pass the threshold.

    A round joins the lists of every node: its LIST nearest of its own component, its LIST nearest of others, and as many of each
    that list it. Two members, at least one of them new in the list, are compared unless they are of one component.
    """
    session = nodes.sparkSession
    bits = _bits(n)
    coded = nodes.select("node", "v").mapInArrow(_codes(trees, bits, 7), f"node long, v {nodes.schema['v'].dataType.simpleString()}, tree int, code long")
    # a block that gathers far more than its share is dealt to random parts of about BLOCK; what they miss the rounds and the other trees find
    load = coded.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("load"))
    block = coded.join(load, ["tree", "code"]).withColumn("salt", F.pmod(F.xxhash64("node", "tree"), F.greatest(F.lit(1), F.ceil(F.col("load") / (4 * BLOCK)))))
    found = block.groupBy("tree", "code", "salt").applyInPandas(_block_edges(threshold), _EDGES)
    edges = checkpointed((found if edges is None else found.unionByName(edges)).distinct())
    before = None
    while True:
        joined = checkpointed(components(edges.where(F.col("cosine") >= threshold), "a", "b"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
        named = both.join(joined.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        named = named.select("a", "b", "cosine", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        nearest = lambda e: e.withColumn("r", F.row_number().over(Window.partitionBy("a", F.col("ca") == F.col("cb")).orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= LIST).drop("r")
        own = checkpointed(nearest(named))
        listing = own.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", F.col("cb").alias("ca"), F.col("ca").alias("cb"))
        lists = checkpointed(own.unionByName(nearest(listing.join(own.select("a", "b"), ["a", "b"], "left_anti"))))
        newer = lists if before is None else lists.join(before.select("a", "b"), ["a", "b"], "left_anti")
        before = lists
        over = newer.select("a", F.col("b").alias("x"), F.col("cb").alias("cx")).join(lists.select("a", F.col("b").alias("y"), F.col("cb").alias("cy")), "a").where("cx != cy")
        candidates = over.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
        pairs = candidates.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")
        fresh = checkpointed(pairs.mapInArrow(_pair_cosines(threshold), _EDGES))
        edges = checkpointed(edges.unionByName(fresh))
        if not fresh.where(F.col("cosine") >= threshold).count():
            return edges


def near_vectors(vectors: DataFrame, threshold: float = 0.9, least_recall: float = 0.97, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of ``vectors`` (vec_id, embedding, any other columns).

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing: n_links 0, its own
    component. Vectors of different lengths don't link. Others link at cosine >= ``threshold`` in double precision; labels
    are not read. n_links counts other rows, equal vectors and repeated rows included. component_id is the smallest vec_id
    reachable; kept where it is the row's own. A row with a null vec_id takes part, but names no component unless alone (then null). An
    empty table gives no rows. Recall is audited on AUDIT nodes against all nodes; the mean over
    components; below ``least_recall`` further trees are added, up to three times, then all nodes are compared with all.
    """
    session = vectors.sparkSession
    fine = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    element = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("vec_id", F.expr(f"transform(embedding, x -> cast(x as {element}))").alias("embedding"), F.coalesce(F.expr(fine), F.lit(False)).alias("fine"))
    nodes = checkpointed(rows.where("fine").groupBy(F.col("embedding").alias("v")).agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first_id")))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    edges = links = None
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "v").collect()  # AUDIT rows at most
    sample = session.sparkContext.broadcast((np.array([p[0] for p in picked], np.int64), np.array([len(p[1]) for p in picked], np.int64), [p[1] for p in picked]))
    truth = checkpointed(nodes.select("node", "v").mapInArrow(_audit(sample, threshold), "a long, b long"))
    trees = trees_for(threshold, _bits(n), least_recall, trees)
    for turn in range(4):
        edges = neighbour_graph(nodes, threshold, range(turn * trees, (turn + 1) * trees), edges, n)
        joined = components(edges.where(F.col("cosine") >= threshold), "a", "b")
        joined = checkpointed(joined)
        recall = audited_recall(truth, joined)
        if recall is None or recall >= least_recall:
            break
    else:
        links = edges.where(F.col("cosine") >= threshold).unionByName(bridges(nodes, joined, threshold, n))
        joined = checkpointed(components(checkpointed(links), "a", "b"))
    members = nodes.join(joined, "node").select("node", "v", "times", "comp")
    sized = members.join(members.groupBy("comp").agg(F.count(F.lit(1)).alias("m")), "comp").withColumn("t", F.ceil(F.col("m") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    tiled = sized.select("node", "v", "times", "comp", "tile", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("o")).withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    parts = 4 * partitions(session)
    links = tiled.withColumn("part", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(parts))).drop("o").groupBy("part").applyInPandas(_tile_links(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    told = named.join(whole, "comp").join(links, "node", "left").select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.join(told, rows.fine & (rows.embedding == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
