"""Embedding near-duplicates: small-world graphs per shard, all vectors asked of every shard.

Equal vectors of a label are one node with a weight.  The nodes of a label are
dealt into shards of bounded size; each shard becomes one hierarchical navigable
small-world graph.  A graph is sent once to each group of at most about ``GROUP``
queries, which follow it as rows, so what is sent beside it is the queries' vectors.
Every node asks every shard of its label.  The beam is doubled for queries whose
beam is half full of matches, and for all while the recall of audited queries against
brute force, of matches or of nearest nodes, is too low; what a beam of ``MOST_BEAM``
does not settle is compared with the whole shard, so a vector with many partners loses
none of them.  Shards of fewer than twice the first beam are compared as a whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import require_long, stored
from tessera.llm.components import components

THRESHOLD = 0.98
#: Nodes in a shard, about.
SHARD = 8192
#: Queries of a label that follow one copy of a graph, about.
GROUP = 16384
LINKS = 12
BUILD_BEAM = 32
FIRST_BEAM = 24
#: Queries that a beam of this many does not settle are compared with the whole shard.
MOST_BEAM = 96
#: One in so many of a block's nodes is audited by brute force, so many at least; the recall they must reach.
AUDIT = 50
LEAST_AUDIT = 64
RECALL = 0.99


class Graph:
    """A hierarchical small-world graph of unit vectors, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 0):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        self.layers: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        top = int(level.max(initial=0))
        for k in range(top + 1):
            self.members.append(np.flatnonzero(level >= k))
            self.layers.append(np.full((n, links * (2 if k == 0 else 1)), -1, np.int32))
        self.entry = int(self.members[-1][0]) if n else -1
        # nodes come in batches; a batch finds its neighbours among the nodes before it
        order = np.r_[self.entry, np.setdiff1d(np.arange(n), [self.entry])] if n else np.empty(0, int)
        at = 1
        while at < n:
            size = min(max(1, at // 2), 256, n - at)
            new = order[at : at + size]
            self._insert(new, level, beam)
            at += size

    def _insert(self, new: np.ndarray, level: np.ndarray, beam: int) -> None:
        near = np.full(len(new), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level[new] >= k
            ids = self._search(self.v[new], near[:, None], k, beam if here.any() else 1)[0]
            near = ids[:, 0]
            own = np.flatnonzero(here)
            if not len(own):
                continue
            nodes, links = new[own], self.layers[k].shape[1]
            # a batch's own nodes are candidates for each other too
            mates = np.where(np.tri(len(own), k=-1, dtype=bool), self.v[nodes] @ self.v[nodes].T, -np.inf)
            top = np.argsort(-mates, axis=1)[:, :links]
            mate = np.where(np.take_along_axis(mates, top, 1) > -np.inf, nodes[top], -1)
            chosen = self._spread(nodes, np.concatenate([ids[own], mate], axis=1), links)
            self.layers[k][nodes] = chosen
            # the other way round: all new links of a node at once
            to, of = chosen.ravel(), np.repeat(nodes, links)
            to, of = to[to >= 0], of[to >= 0]
            order = np.argsort(to, kind="stable")
            to, of = to[order], of[order]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            added = np.full((len(target), int(count.max(initial=0))), -1, np.int64)
            added[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = of
            self.layers[k][target] = self._spread(target, np.concatenate([self.layers[k][target], added], axis=1), links)

    def _spread(self, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """``most`` neighbours of each node from its candidates (-1: none): nearest
        first, but those nearer to one taken than to the node only if room is left."""
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == nodes[:, None]] = -1
        out = np.full((len(nodes), most), -1, np.int64)
        for at in range(0, len(nodes), 256):
            c, v = cand[at : at + 256], self.v[nodes[at : at + 256]]
            sims = np.where(c >= 0, np.einsum("qd,qkd->qk", v, self.v[c]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
            vectors = self.v[c]
            between = np.matmul(vectors, vectors.transpose(0, 2, 1))
            closest = np.full(c.shape, -np.inf, np.float32)  # to one taken
            taken = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                ok = (c[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (taken.sum(axis=1) < most)
                taken[:, j] = ok
                closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
            rank = np.argsort(np.where(c < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(c, rank, 1)
            out[at : at + len(c), : got.shape[1]] = got
        return out

    def _search(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of nearest nodes found for each query in a layer, nearest first."""
        layer, v = self.layers[k], self.v
        q = len(queries)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, np.float32)
        done = np.zeros((q, beam), bool)
        ids[:, : start.shape[1]] = start[:, :beam]
        sims[:, : start.shape[1]] = np.einsum("qd,qkd->qk", queries, v[start[:, :beam]])
        live = np.arange(q)
        seen = np.zeros((q, len(v)), bool)
        seen[np.arange(q)[:, None], start] = True
        while len(live):
            open_sims = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
            best = open_sims.argmax(axis=1)
            some = open_sims[np.arange(len(live)), best] > -np.inf
            live, best = live[some], best[some]
            if not len(live):
                break
            done[live, best] = True
            near = layer[ids[live, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(fresh, near, ids[live, best][:, None])] = True
            ns = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], v[near]), -np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], ns], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            rows = np.arange(len(live))[:, None]
            ids[live], sims[live], done[live] = all_ids[rows, keep], all_sims[rows, keep], all_done[rows, keep]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def find(self, queries: np.ndarray, beam: int) -> np.ndarray:
        queries = np.ascontiguousarray(queries, np.float32)
        near = np.full((len(queries), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            near = self._search(queries, near, k, 1)[0][:, :1]
        return self._search(queries, near, 0, beam)[0]


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def audited(n: int) -> np.ndarray:
    """Marks of the queries whose answers are audited: one in ``AUDIT``, but ``LEAST_AUDIT`` or all at least."""
    return np.arange(n) % max(1, min(AUDIT, n // LEAST_AUDIT)) == 0


def matches(graph: Graph, exact: np.ndarray, queries: np.ndarray, audit: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[list[np.ndarray], int, int]:
    """For each query the nodes with cosine of at least ``threshold``, in double
    precision, without its own node ``own`` (-1: not in the graph).  ``audit`` marks
    queries whose answers are checked by brute force: their matches and, as most may
    have none, their nearest node.  Also the true matches of the audited queries, and
    how many of them are in the answers."""
    n = len(exact)
    own = np.full(len(queries), -1) if own is None else own
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    todo = np.arange(len(queries))
    beam = min(FIRST_BEAM, n)
    checked = np.flatnonzero(audit).tolist()
    truth, nearest, reached = {}, {}, {}

    def audited_answers() -> tuple[list[np.ndarray], int, int]:
        return out, sum(len(truth[i]) for i in checked), sum(len(np.intersect1d(out[i], truth[i])) for i in checked)

    for i in checked:
        cos = exact @ queries[i]
        if own[i] >= 0:
            cos[own[i]] = -2.0
        truth[i], nearest[i] = np.flatnonzero(cos >= threshold), cos.max()
    while True:
        if beam > min(MOST_BEAM, n // 2):
            for at in range(0, len(todo), 256):
                some = todo[at : at + 256]
                hit = queries[some] @ exact.T >= threshold
                inside = np.flatnonzero(own[some] >= 0)
                hit[inside, own[some[inside]]] = False
                for i, row in zip(some, hit, strict=True):
                    out[i] = np.flatnonzero(row)
            return audited_answers()
        full = []
        for at in range(0, len(todo), 512):
            some = todo[at : at + 512]
            found = graph.find(queries[some], beam)
            cos = np.where(found >= 0, np.einsum("qd,qkd->qk", queries[some], exact[np.maximum(found, 0)]), -2.0)
            cos[found == np.where(own[some] >= 0, own[some], -2)[:, None]] = -2.0
            hit = cos >= threshold
            for j, i in enumerate(some):
                out[i] = found[j][hit[j]]
                reached[i] = cos[j].max()
            full.append(some[hit.sum(axis=1) > beam // 2])
        todo_full = np.concatenate(full)
        settled = np.setdiff1d(checked, todo_full)
        want = sum(len(truth[i]) for i in settled)
        got = sum(len(np.intersect1d(out[i], truth[i])) for i in settled)
        near = sum(reached[i] >= nearest[i] - 1e-9 for i in settled)
        todo = todo_full if got >= RECALL * want and near >= RECALL * len(settled) else np.arange(len(queries))
        if not len(todo):
            return audited_answers()
        beam *= 2


def span(n: int, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of pairs of nodes that some group puts together."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for group in groups:
        first = find(int(group[0]))
        for x in group[1:]:
            other = find(int(x))
            if other != first:
                root[other] = first
                a.append(int(group[0]))
                b.append(int(x))
    return np.array(a, int), np.array(b, int)


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector may link: not null, empty or zero, with finite numbers only, under a label."""
    return (
        label.isNotNull()
        & F.coalesce(F.size(vector) > 0, F.lit(False))
        & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def search(nodes: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """What ``nodes(label, v, node, weight)`` are linked to, in rows of three kinds:
    ``links`` of a node (a = b), pairs (a, b) that join (links null), and the audit of
    some queries (a null): ``wanted`` true links, of which ``got`` were found."""
    sized = nodes.withColumn("width", F.size("v"))
    shards = sized.groupBy("label", "width").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = sized.join(shards, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        width = table["width"][0].as_py()
        exact = units(np.asarray(table["v"].combine_chunks().flatten()).reshape(-1, width))
        order = np.argsort(np.asarray(table["node"]))
        exact, node, weight = exact[order], np.asarray(table["node"])[order], np.asarray(table["weight"])[order]
        blob = pickle.dumps((Graph(exact), exact, node, weight))
        return pa.table([table["label"][:1], *(table[c][:1] for c in ("width", "shard", "groups")), pa.array([blob], pa.binary())], names=["label", "width", "shard", "groups", "graph"])

    kind = nodes.schema["label"].dataType.simpleString()
    graphs = stored(dealt.groupBy("label", "width", "shard").applyInArrow(build, f"label {kind}, width int, shard int, groups int, graph binary"), "graphs")
    key = ["label", "width", "shard", "group"]
    sent = graphs.select("label", "width", "shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "graph")
    asked = dealt.select(
        "label", "width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"),
        F.lit(None).cast("binary").alias("graph"), "node", "weight", "v",
    )
    rows = sent.select(*key, "graph", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("node", "weight", "v"))).unionByName(asked)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            graph_at = np.flatnonzero(np.asarray(batch.column(4).is_valid()))
            edges = np.unique(np.r_[0, graph_at, graph_at + 1, batch.num_rows])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if batch.column(4)[lo].is_valid:
                    held = pickle.loads(batch.column(4)[lo].as_py())
                    continue
                graph, exact, node, weight = held
                part = batch.slice(lo, hi - lo)
                q_node, q_weight = np.asarray(part.column(5)), np.asarray(part.column(6))
                queries = units(np.asarray(part.column(7).flatten()).reshape(len(q_node), -1))
                place = np.minimum(np.searchsorted(node, q_node), len(node) - 1)
                own = np.where(node[place] == q_node, place, -1)
                found, wanted, got = matches(graph, exact, queries, audited(len(q_node)), threshold, own)
                # a node's equal rows are known without a search
                links = np.array([weight[f].sum() for f in found], np.int64) + np.where(own >= 0, q_weight - 1, 0)
                a, b = span(len(node) + len(q_node), [np.r_[len(node) + k, f] for k, f in enumerate(found)])
                names = np.r_[node, q_node]
                none = np.arange(len(q_node) + len(a) + 1) >= len(q_node)
                audit = np.arange(len(none)) < len(none) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[q_node, names[a], 0], mask=~audit), pa.array(np.r_[q_node, names[b], 0], mask=~audit),
                        pa.array(np.r_[links, np.zeros(len(a) + 1, np.int64)], mask=none),
                        pa.array(np.r_[np.zeros(len(none) - 1, np.int64), wanted], mask=audit), pa.array(np.r_[np.zeros(len(none) - 1, np.int64), got], mask=audit),
                    ],
                    ["a", "b", "links", "wanted", "got"],
                )

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a graph comes before the queries that are put to it
    return rows.repartition(n, *key).sortWithinPartitions(*key, F.col("graph").isNull()).mapInArrow(ask, "a long, b long, links long, wanted long, got long")


def audited_recall(told: DataFrame) -> DataFrame:
    """(wanted, got, recall) of the audited queries of a :func:`search`."""
    sums = told.where("a IS NULL").agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum("got"), F.lit(0)).alias("got"))
    return sums.withColumn("recall", F.when(F.col("wanted") > 0, F.col("got") / F.col("wanted")))


def marked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, v) of every row, with v null where it links with nothing, and
    the distinct vectors (label, v, node, least, weight) with numbers of our own."""
    require_long(vectors, id_col)
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    ok = usable(F.col("v"), F.col("label"))
    # adding zero makes -0 and 0 equal
    marked = stored(rows.select("vec_id", "label", F.when(ok, F.transform("v", lambda x: x + F.lit(0.0))).alias("v")), "vectors")
    classes = marked.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    return marked, stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Only rows with equal labels that are not null are compared.  Vectors that are
    null, empty, zero, or hold null or non-finite numbers link with nothing; vectors
    of another length do not link.  Equal vectors link with each other.  Repeated
    vec_ids are rows of their own in the counts.  A component is named by its smallest
    vec_id that is not null, and by null if it has none; ``kept`` compares the two,
    nulls being equal.  Ids that are not whole numbers are refused.  Other columns are
    not looked at.  An empty table gives an empty table.
    """
    marked, nodes = marked_vectors(vectors, id_col, vector_col, label_col)
    told = stored(search(nodes, threshold, shard), "links")
    counts = told.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    joined = stored(components(told.where("a <> b").select("a", "b")), "components")
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = named.join(smallest, "component").join(counts, "node").select("label", "v", "n_links", "component_id")
    linked = marked.where("v IS NOT NULL").join(by_vector, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
