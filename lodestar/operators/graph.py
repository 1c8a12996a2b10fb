"""Graph search over navigable small-world graphs, one graph for each shard of
the base.

A shard's graph is built in one task from the exact neighbours of its own rows,
thinned by the diversity rule and linked both ways; it is one packed row. Rows go
to shards by hash, or to the shards of their nearest centroid, so that a query
needs to walk only the routes of the centroids near it. Query blocks meet the
shards in an equi-join and walk their graphs in NumPy; the union of the shards'
hits is ranked as over one base. The walk can be adaptive: it watches how the popped distance relates to the beam's farthest
one and lowers the beam's width once for queries that look easy."""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestar.functions.metrics import metric
from lodestar.operators.blocks import unpack
from lodestar.operators.knn import top

#: Rows of a shard aim at this number; queries that walk it in one go at the other.
SHARD_ROWS, WALKED = 4096, 1024
#: Distances of a shard's rows that are held at once while it is linked, and walks whose
#: results are.
CELLS, HELD = 1 << 22, 64
INDEX = "shard int, route int, ids binary, width int, vectors binary, degree int, links binary, upper binary, top_level int, entry int, metric string"


@dataclass
class Graph:
    ids: object
    vectors: object
    links: list  # an (n, degree) array for each level, -1 where there is no link
    entry: int
    metric: str

    def distances(self, q, nodes):
        """Distances as the walk ranks them: similarities negated."""
        m = metric(self.metric)
        d = m.tile(q[None, :], self.vectors[nodes])[0]
        return -d if m.larger_is_better else d

    def external(self, raw: float) -> float:
        return 1 + raw if metric(self.metric).larger_is_better else raw


def draw_levels(n: int, m: int, seed: int = 12345):
    """Geometric levels: each has 1/m of the nodes of the one below it."""
    import numpy as np

    u = 1 - np.random.default_rng(seed).random(n)
    return np.floor(-np.log(u) / math.log(m)).astype(int)


def diverse_neighbours(near, own, between, limit: int) -> list[int]:
    """Of candidates from near to far, those that are closer to the node than to
    any one kept before. ``own`` are their distances to the node, ``between``
    those among them."""
    kept: list[int] = []
    for i in range(len(near)):
        if len(kept) == limit:
            break
        if all(own[i] < between[i, j] for j in kept):
            kept.append(i)
    return [near[i] for i in kept]


def _rank_distance(vectors, name: str):
    m = metric(name)
    return (lambda a, b: -m.tile(a, b)) if m.larger_is_better else (lambda a, b: m.tile(a, b))


def link(vectors, name: str, limit: int, candidates: int):
    """Links of one level: each node's exact nearest ``candidates``, thinned,
    then linked back and thinned again where that exceeds the limit."""
    import numpy as np

    n, dist = len(vectors), _rank_distance(vectors, name)
    links: list[list[int]] = [[] for _ in range(n)]
    step = max(1, min(1024, CELLS // max(1, n)))
    for at in range(0, n, step):
        d = dist(vectors[at : at + step], vectors)
        rows = np.arange(len(d))
        d[rows, rows + at] = np.inf
        c = min(candidates, n - 1)
        if c < 1:
            continue
        near = np.argpartition(d, c - 1, axis=1)[:, :c] if c < n else np.argsort(d, axis=1)
        for r in range(len(d)):
            order = near[r][np.lexsort((near[r], d[r, near[r]]))]
            links[at + r] = diverse_neighbours(order.tolist(), d[r, order], dist(vectors[order], vectors[order]), max(1, limit // 2))
    back: list[set[int]] = [set(x) for x in links]
    for i, x in enumerate(links):
        for j in x:
            back[j].add(i)
    out = np.full((n, limit), -1, np.int32)
    for i, x in enumerate(back):
        x = sorted(x)
        if len(x) > limit:
            own = dist(vectors[i : i + 1], vectors[x])[0]
            order = np.lexsort((x, own))
            near = [x[k] for k in order]
            x = diverse_neighbours(near, own[order], dist(vectors[near], vectors[near]), limit)
            x += [k for k in near if k not in set(x)][: limit - len(x)]
        out[i, : len(x)] = x
    return out


def _reached(links, start: int):
    import numpy as np

    seen = np.zeros(len(links), bool)
    seen[start], front = True, np.array([start])
    while len(front):
        front = np.unique(links[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True
    return seen


def connect(vectors, links, start: int, name: str) -> None:
    """Give each part that can't be reached a link from its nearest node that
    can be, in place of that node's last link if it has no room."""
    import numpy as np

    dist, tried = _rank_distance(vectors, name), 0
    seen = _reached(links, start)
    while not seen.all() and tried < len(links):
        lost, there = np.flatnonzero(~seen), np.flatnonzero(seen)
        target = lost[0]
        source = there[int(np.argmin(dist(vectors[target : target + 1], vectors[there])[0]))]
        free = np.flatnonzero(links[source] < 0)
        if not len(free):
            # a node with room, so that nothing reached before is lost
            room = there[(links[there] < 0).any(axis=1)]
            if not len(room):
                break
            source = room[int(np.argmin(dist(vectors[target : target + 1], vectors[room])[0]))]
            free = np.flatnonzero(links[source] < 0)
        links[source, free[0]] = target
        seen |= _reached(links, target)
        tried += 1


def build_graph(ids, vectors, name: str, m: int = 16, candidates: int = 64, seed: int = 12345) -> Graph:
    import numpy as np

    vectors = np.asarray(vectors, np.float64)
    levels = draw_levels(len(ids), m, seed)
    entry = int(np.argmax(levels)) if len(ids) else -1
    links = []
    for level in range(int(levels.max()) + 1 if len(ids) else 0):
        nodes = np.flatnonzero(levels >= level)
        limit = 2 * m if level == 0 else m
        local = link(vectors[nodes], name, limit, candidates)
        connect(vectors[nodes], local, int(np.searchsorted(nodes, entry)), name)
        full = np.full((len(ids), limit), -1, np.int32)
        full[nodes] = np.where(local >= 0, nodes[local], -1)
        links.append(full)
    return Graph(np.asarray(ids, np.int64), vectors, links, entry, name)


def nsg_graph(ids, vectors, name: str, degree: int = 32, candidates: int = 64) -> Graph:
    """A navigating spreading-out graph: one level, entered at the row nearest to
    the mean. Each row chooses among its exact neighbours and the rows that a
    search for it passes, by the diversity rule; links back are added and thinned,
    and rows that can't be reached get a link."""
    import numpy as np

    v = np.asarray(vectors, np.float64)
    dist, n = _rank_distance(v, name), len(v)
    middle = int(np.argmin(dist(v.mean(0)[None, :], v)[0])) if n else -1
    near = link(v, name, 2 * degree, candidates)
    first = Graph(np.asarray(ids, np.int64), v, [near], middle, name)
    out = [[] for _ in range(n)]
    for i in range(n):
        passed = [j for _, j in beam_level(first, v[i], 0, [middle], max(degree, candidates // 2))]
        pool = np.array(sorted({*near[i][near[i] >= 0].tolist(), *passed} - {i}), int)
        own = dist(v[i : i + 1], v[pool])[0]
        order = np.lexsort((pool, own))
        pool, own = pool[order], own[order]
        out[i] = diverse_neighbours(pool.tolist(), own, dist(v[pool], v[pool]), degree)
    links = np.full((n, degree), -1, np.int32)
    for i, x in enumerate(out):
        links[i, : len(x)] = x
    for i, x in enumerate(out):
        for j in x:
            link_back(v, links, j, i, dist)
    if n:
        connect(v, links, middle, name)
    return Graph(first.ids, v, [links], middle, name)


def beam_level(g: Graph, q, level: int, entries: list[int], ef: int) -> list[tuple[float, int]]:
    """The nearest ``ef`` nodes that a beam finds on one level, near to far."""
    import numpy as np

    seen = set(entries)
    beam = _Beam(ef)
    for d, i in zip(g.distances(q, np.array(entries)).tolist(), entries):
        beam.push(d, i)
    while (popped := beam.pop()) is not None:
        nodes = [int(i) for i in g.links[level][popped[1]] if i >= 0 and int(i) not in seen]
        if nodes:
            seen.update(nodes)
            for d, i in zip(g.distances(q, np.array(nodes)).tolist(), nodes):
                beam.push(d, i)
    return beam.rows


def link_back(vectors, links, node: int, new: int, dist) -> None:
    """Add ``new`` to the links of ``node``; where there is no room, what the
    diversity rule keeps of all stays."""
    import numpy as np

    row = links[node]
    if (row == new).any():
        return
    free = np.flatnonzero(row < 0)
    if len(free):
        row[free[0]] = new
        return
    every = np.append(row, new)
    own = dist(vectors[node : node + 1], vectors[every])[0]
    order = np.lexsort((every, own))
    kept = diverse_neighbours(every[order].tolist(), own[order], dist(vectors[every[order]], vectors[every[order]]), len(row))
    links[node] = -1
    links[node, : len(kept)] = kept


def inserted(g: Graph, ids, vectors, ef: int = 64, seed: int = 12345) -> Graph:
    """The graph with more nodes, each linked to the diverse ones of those that a
    beam of ``ef`` finds for it on each of its levels, and back. ``ef`` may be one
    number for each node."""
    import numpy as np

    new = np.asarray(vectors, np.float64).reshape(len(ids), -1)
    if not len(ids):
        return g
    m = g.links[0].shape[1] // 2 if g.links else 16
    first, n = len(g.ids), len(g.ids) + len(ids)
    out = Graph(np.concatenate([g.ids, np.asarray(ids, np.int64)]), np.concatenate([g.vectors.reshape(first, -1), new]) if first else new, [], g.entry, g.metric)
    for x in g.links or [np.zeros((0, 2 * m), np.int32)]:
        out.links.append(np.concatenate([x, np.full((len(ids), x.shape[1]), -1, np.int32)]))
    dist, tops = _rank_distance(out.vectors, g.metric), draw_levels(n, m, seed)[first:]
    widths = np.broadcast_to(ef, len(ids))
    for i, top_level, width in zip(range(first, n), tops.tolist(), widths.tolist()):
        q, at = out.vectors[i], [out.entry]
        for level in range(len(out.links) - 1, -1, -1):
            if out.entry < 0:
                break
            found = beam_level(out, q, level, at, width if level <= top_level else 1)
            at = [j for _, j in found]
            if level <= top_level:
                kept = diverse_neighbours(at, [d for d, _ in found], dist(out.vectors[at], out.vectors[at]), m)
                out.links[level][i, : len(kept)] = kept
                for j in kept:
                    link_back(out.vectors, out.links[level], j, i, dist)
        while len(out.links) <= top_level:
            out.links.append(np.full((n, m), -1, np.int32))
            out.entry = i
        if out.entry < 0:
            out.entry = i
    return out


def without(g: Graph, gone) -> Graph:
    """The graph without the nodes whose ids are in ``gone``: each node that linked
    to one chooses anew among its other links and those of the lost ones, and
    parts that lost their way in get a link."""
    import numpy as np

    lost = np.isin(g.ids, np.asarray(list(gone), np.int64))
    if not lost.any():
        return g
    left = np.flatnonzero(~lost)
    place = np.full(len(g.ids), -1, np.int64)
    place[left] = np.arange(len(left))
    v, dist, links, entry = g.vectors[left], _rank_distance(g.vectors, g.metric), [], -1
    for level, x in enumerate(g.links):
        x = x.copy()
        there = (x >= 0).any(axis=1) | (np.arange(len(x)) == g.entry)
        for i in left[(lost[np.maximum(x[left], 0)] & (x[left] >= 0)).any(axis=1)]:
            pool = {int(j) for j in x[i] if j >= 0}
            pool |= {int(k) for j in x[i] if j >= 0 and lost[j] for k in x[j] if k >= 0}
            pool = np.array(sorted(j for j in pool - {int(i)} if not lost[j]), int)
            own = dist(g.vectors[i : i + 1], g.vectors[pool])[0] if len(pool) else np.zeros(0)
            pool, own = pool[np.lexsort((pool, own))], np.sort(own)
            kept = diverse_neighbours(pool.tolist(), own, dist(g.vectors[pool], g.vectors[pool]), x.shape[1]) if len(pool) else []
            x[i] = -1
            x[i, : len(kept)] = kept
        x = x[left]
        x = np.where(x >= 0, place[np.maximum(x, 0)], -1).astype(np.int32)
        nodes = np.flatnonzero(there[left])
        if level and not len(nodes):
            break
        links.append(x)
        if len(nodes):
            entry = int(nodes[0])
    for level, x in enumerate(links):
        nodes = np.arange(len(left)) if level == 0 else np.flatnonzero((x >= 0).any(axis=1) | (np.arange(len(x)) == entry))
        if len(nodes) > 1 and entry in nodes:
            spot = np.full(len(left), -1, np.int64)
            spot[nodes] = np.arange(len(nodes))
            local = np.where(x[nodes] >= 0, spot[np.maximum(x[nodes], 0)], -1)
            connect(v[nodes], local, int(spot[entry]), g.metric)
            x[nodes] = np.where(local >= 0, nodes[local], -1)
    return Graph(g.ids[left], v, links, entry if len(left) else -1, g.metric)


def relinked(g: Graph, neighbours: dict[int, list[int]]) -> Graph:
    """Level 0 from given neighbours: ids by id, near to far; those of other graphs
    are left out. The rest is as ``link`` does with exact neighbours."""
    import numpy as np

    place, dist = {int(i): p for p, i in enumerate(g.ids)}, _rank_distance(g.vectors, g.metric)
    links = np.full_like(g.links[0], -1)
    near = [[place[j] for j in neighbours.get(int(i), ()) if j in place and j != i] for i in g.ids]
    for i, x in enumerate(near):
        own = dist(g.vectors[i : i + 1], g.vectors[x])[0] if x else []
        kept = diverse_neighbours(x, own, dist(g.vectors[x], g.vectors[x]), links.shape[1] // 2) if x else []
        links[i, : len(kept)] = kept
    for i in range(len(links)):
        for j in links[i][links[i] >= 0].tolist():
            link_back(g.vectors, links, j, i, dist)
    connect(g.vectors, links, g.entry, g.metric)
    return Graph(g.ids, g.vectors, [links, *g.links[1:]], g.entry, g.metric)


def reordered(g: Graph, most: int | None = None) -> Graph:
    """Links of level 0 from near to far, the first ``most`` of them."""
    import numpy as np

    dist, links = _rank_distance(g.vectors, g.metric), np.full_like(g.links[0], -1)
    for i, x in enumerate(g.links[0]):
        x = x[x >= 0]
        x = x[np.lexsort((x, dist(g.vectors[i : i + 1], g.vectors[x])[0]))][:most]
        links[i, : len(x)] = x
    return Graph(g.ids, g.vectors, [links, *g.links[1:]], g.entry, g.metric)


def random_links(g: Graph, degree: int, seed: int = 12345) -> Graph:
    """Level 0 with links to random nodes: what a graph is to beat. Nodes that none
    leads to get a link."""
    import numpy as np

    n, random = len(g.ids), np.random.default_rng(seed)
    links = np.full_like(g.links[0], -1)
    k = min(degree, n - 1, links.shape[1])
    for i in range(n):
        x = random.choice(n - 1, k, replace=False)
        links[i, :k] = x + (x >= i)
    if n:
        connect(g.vectors, links, g.entry, g.metric)
    return Graph(g.ids, g.vectors, [links, *g.links[1:]], g.entry, g.metric)


def packed_row(g: Graph, shard: int, route: int, m: int) -> dict:
    """The graph as a row of an index."""
    import numpy as np

    upper = np.stack(g.links[1:]) if len(g.links) > 1 else np.zeros((0, 0, 0), np.int32)
    level = g.links[0] if g.links else np.zeros((0, 2 * m), np.int32)
    return {"shard": shard, "route": route, "ids": g.ids.tobytes(), "width": g.vectors.shape[1], "vectors": np.ascontiguousarray(g.vectors, np.float64).tobytes(), "degree": level.shape[1],
            "links": zlib.compress(np.ascontiguousarray(level, np.int32).tobytes(), 1), "upper": zlib.compress(np.ascontiguousarray(upper, np.int32).tobytes(), 1), "top_level": max(0, len(g.links) - 1), "entry": g.entry, "metric": g.metric}


def build(base: DataFrame, name: str = "l2", m: int = 16, candidates: int = 64, shard_rows: int = SHARD_ROWS, shards: int | None = None, nsg: bool = False, centroids: DataFrame | None = None) -> DataFrame:
    """An index over ``(id, embedding)``: a row for each shard. Rows are dealt by
    the hashes of their ids; with ``centroids`` (list_no, centroid) they go to the
    nearest one, its number being the shard's ``route``, and only what exceeds a
    shard's rows is dealt over more shards of that route."""
    rows = base.toDF("id", "v").where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    if centroids is None:
        n = shards or max(1, -(-rows.count() // shard_rows))
        dealt = rows.withColumn("route", F.lit(0)).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    else:
        from lodestar.operators.ivf import assign_lists, in_blocks
        from lodestar.sources.shared import materialize

        placed = materialize(assign_lists(rows, centroids, name).toDF("id", "v", "list_no"), "placed")
        routes = (placed.agg(F.max("list_no")).first()[0] or 0) + 1  # so that no two routes share a shard's number
        dealt = in_blocks(placed, shard_rows, "id").select("id", "v", F.col("list_no").alias("route"), (F.col("list_no") + F.lit(routes) * F.col("block")).cast("int").alias("shard"))

    def make(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        g = nsg_graph(ids, v, name, 2 * m, candidates) if nsg else build_graph(ids, v, name, m, candidates)
        return pd.DataFrame([packed_row(g, int(pdf["shard"].iloc[0]), int(pdf["route"].iloc[0]), m)])

    return dealt.select("shard", "route", "id", "v").groupBy("shard").applyInPandas(make, INDEX)


def changed(index: DataFrame, f: Callable[[Graph], Graph]) -> DataFrame:
    """The index with ``f`` applied to each shard's graph."""
    arrow = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([packed_row(f(load(row)), row["shard"], row["route"], row["degree"] // 2)], schema=arrow)

    return index.mapInArrow(run, INDEX)


def _with_rows(index: DataFrame, rows: DataFrame, f: Callable) -> DataFrame:
    """``f(graph, rows)`` for each shard with its rows ``(shard, ...)``, a pandas
    frame."""
    def run(key, graphs, more):
        import pandas as pd

        if not len(graphs):
            return pd.DataFrame(columns=graphs.columns)
        row = graphs.iloc[0].to_dict()
        return pd.DataFrame([packed_row(f(load(row), more), int(row["shard"]), int(row["route"]), int(row["degree"]) // 2)])

    return index.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(run, INDEX)


def shards_of(index: DataFrame, rows: DataFrame, centroids: DataFrame | None = None, name: str = "l2") -> DataFrame:
    """``rows(id, v)`` with the shard that a new row goes to."""
    known = sorted((r.route, r.shard) for r in index.select("route", "shard").collect())  # a row for each shard
    if centroids is None:
        return rows.withColumn("shard", F.get(F.array(*(F.lit(s) for _, s in known)), F.pmod(F.xxhash64("id"), F.lit(len(known))).cast("int")))
    from lodestar.operators.ivf import assign_lists

    by_route = index.sparkSession.createDataFrame([(r, [s for x, s in known if x == r]) for r in sorted({r for r, _ in known})], "list_no int, of array<int>")
    alive = centroids.join(by_route.select("list_no"), "list_no", "left_semi")  # a route without rows has no shard
    placed = assign_lists(rows.toDF("id", "embedding"), alive, name).join(F.broadcast(by_route), "list_no")
    return placed.select("id", F.col("embedding").alias("v"), F.get("of", F.pmod(F.xxhash64("id"), F.size("of")).cast("int")).alias("shard"))


def add(index: DataFrame, base: DataFrame, ef: int = 64, centroids: DataFrame | None = None, name: str = "l2") -> DataFrame:
    """The index with more rows ``(id, embedding)``; a third column, ``ef``, is a
    row's own width of the search for its links. Shards grow; ``build`` deals
    anew."""
    own = "ef" in base.columns
    rows = base.select(F.col(base.columns[0]).alias("id"), F.col(base.columns[1]).cast("array<double>").alias("v"))
    placed = shards_of(index, rows, centroids, name)
    if own:
        placed = placed.join(base.select(F.col(base.columns[0]).alias("id"), F.col("ef").cast("int").alias("ef")), "id")

    def f(g, more):
        import numpy as np

        more = more.sort_values("id")
        return inserted(g, more["id"].to_numpy(), np.stack(more["v"].to_numpy()), more["ef"].to_numpy() if own else ef) if len(more) else g

    return _with_rows(index, placed, f)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the rows whose ``id`` is in ``ids``."""
    shard_of = members(index).join(ids.select("id").distinct(), "id")
    return _with_rows(index, shard_of, lambda g, more: without(g, more["id"].tolist()))


def update(index: DataFrame, base: DataFrame, ef: int = 64, centroids: DataFrame | None = None, name: str = "l2") -> DataFrame:
    """The index with new vectors for rows that it has, or may have."""
    from lodestar.sources.shared import materialize

    return add(materialize(remove(index, base.select(F.col(base.columns[0]).alias("id"))), "left"), base, ef, centroids, name)


def members(index: DataFrame) -> DataFrame:
    """``(shard, id)`` of all rows of an index."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(x), shard, np.int32), "id": x})

    return index.select("shard", "ids").mapInArrow(run, "shard int, id long")


def vectors_of(index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, embedding)`` that an index holds, of ``ids`` or of all rows."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                i, v = unpack(row["ids"], row["width"], row["vectors"])
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "embedding"])

    rows = index.select("ids", "width", "vectors").mapInArrow(run, "id long, embedding array<double>")
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def build_binary(codes: DataFrame, bits: int, **options) -> DataFrame:
    """An index over ``(id, code)``, codes in 32-bit words: vectors of -1 and 1,
    whose L2 distance is four times the Hamming distance."""
    from lodestar.functions.vectors import bits_to_signs

    c = codes.toDF("id", "code")
    return build(c.select("id", bits_to_signs(F.col("code"), bits).alias("embedding")), "l2", **options)


def load(row: dict) -> Graph:
    import numpy as np

    ids, vectors = unpack(row["ids"], row["width"], row["vectors"])
    n, degree = len(ids), row["degree"]
    links = [np.frombuffer(zlib.decompress(row["links"]), np.int32).reshape(n, degree)]
    links += list(np.frombuffer(zlib.decompress(row["upper"]), np.int32).reshape(row["top_level"], n, degree // 2)) if row["top_level"] else []
    return Graph(ids, vectors, links, row["entry"], row["metric"])


def edges(index: DataFrame) -> DataFrame:
    """The graphs as rows: shard, level, node, neighbour (ids)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                g = load(row)
                for level, links in enumerate(g.links):
                    i, j = np.nonzero(links >= 0)
                    k = len(i)
                    yield pa.RecordBatch.from_pydict({"shard": np.full(k, row["shard"], np.int32), "level": np.full(k, level, np.int32), "node": g.ids[i], "neighbour": g.ids[links[i, j]]})

    return index.mapInArrow(run, "shard int, level int, node long, neighbour long")


def graph_stats(links: DataFrame) -> DataFrame:
    """Degrees of each level and how many links go both ways."""
    back = links.select("shard", "level", F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), F.lit(1).alias("back"))
    n = links.join(back, ["shard", "level", "node", "neighbour"], "left").groupBy("shard", "level", "node").agg(F.count(F.lit(1)).alias("degree"), F.count("back").alias("mutual"))
    return n.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("least"), F.avg("degree").alias("mean"), F.max("degree").alias("most"), (F.sum("mutual") / F.sum("degree")).alias("mutual_share"))


def integrity(links: DataFrame, base: DataFrame) -> DataFrame:
    """Self links, links to unknown rows, and rows of level 0 that no link leads to."""
    known = base.select(F.col("id").alias("neighbour"))
    into = links.where("level = 0").select(F.col("neighbour").alias("id")).distinct()
    counts = links.agg(F.count_if(F.col("node") == F.col("neighbour")).alias("self_links"))
    return counts.join(links.join(known, "neighbour", "left_anti").agg(F.count(F.lit(1)).alias("unknown")), F.lit(True)).join(base.select("id").join(into, "id", "left_anti").agg(F.count(F.lit(1)).alias("unlinked")), F.lit(True))


# --- the walk ---

@dataclass(frozen=True)
class Adaptive:
    """How a walk lowers its width. ``tau`` is the threshold of the mean ratio
    (NaN: never); ``gammas`` are the shares of tau up to which a query gets
    ef * (j + 1) / buckets. ``tiers`` uses three fixed steps instead."""

    tau: float = 0.6
    gammas: tuple[float, ...] = ()
    buckets: int = 4
    start: int = 4
    end: int = 16
    decay: float = 0.8
    tiers: bool = False
    super_gamma: float = math.nan
    mid_gamma: float = math.nan

    def __post_init__(self):
        if self.start < 0 or self.end < max(self.start, 1):
            raise ValueError("the window ends at its start or later, and at 1 or later")
        if not (math.isfinite(self.decay) and 0 <= self.decay <= 1):
            raise ValueError("decay is from 0 to 1")
        if not self.tiers:
            if not 2 <= self.buckets <= 8:
                raise ValueError("there are 2 to 8 buckets")
            if any(not math.isfinite(g) or not 0 <= g <= 1 for g in self.gammas) or list(self.gammas) != sorted(self.gammas):
                raise ValueError("gammas are from 0 to 1 and don't fall")

    def width(self, ef: int, k: int, mean: float) -> int:
        """The width for a mean ratio, at most ef and at least k."""
        if not math.isfinite(self.tau) or not mean <= self.tau:
            return ef
        share = mean / max(self.tau, 1e-6)
        if self.tiers:
            if math.isfinite(self.super_gamma) and share <= self.super_gamma:
                new = min(ef, max(128, ef // 4))
            elif not math.isfinite(self.mid_gamma):
                new = max(1, ef // 2)
            else:
                new = min(ef, max(128, ef // 2) if share <= self.mid_gamma else max(256, ef * 3 // 4))
        else:
            j = next((j for j, g in enumerate(self.gammas) if share <= g), None)
            new = ef if j is None else ef * (j + 1) // self.buckets
        return min(ef, max(1, k, new))


def bucket_width(ef: Column, mean: Column, tau: Column, gammas: Column, buckets: int, k: int) -> Column:
    """The same rule over columns, ``gammas`` an array."""
    share = mean / F.greatest(tau, F.lit(1e-6))
    j = F.size(F.filter(gammas, lambda g: g < share)) + 1
    routed = F.greatest(F.lit(k), F.lit(1), F.floor(ef * j / buckets))
    return F.when((mean <= tau) & (j <= F.size(gammas)), F.least(ef, routed)).otherwise(ef).cast("int")


class _Beam:
    """The nearest ``width`` candidates, popped or not, in order."""

    def __init__(self, width: int, unbounded: bool = False):
        self.width, self.rows, self.open, self.unbounded, self.full = width, [], [], unbounded, False

    def push(self, d: float, i: int) -> None:
        if len(self.rows) >= self.width:
            self.full = True  # some candidates have no room
            if d >= self.rows[-1][0]:
                if self.unbounded:
                    heapq.heappush(self.open, (d, i))
                return
            self.rows.pop()
        bisect.insort(self.rows, (d, i))
        heapq.heappush(self.open, (d, i))

    def pop(self):
        while self.open:
            d, i = heapq.heappop(self.open)
            if self.unbounded or self.rows and (d, i) <= self.rows[-1]:  # else it has been pushed out
                return d, i
        return None

    def below(self, d: float) -> int:
        return bisect.bisect_left(self.rows, (d, -1))

    def shrink(self, width: int) -> None:
        self.width = width
        del self.rows[width:]


TRACE = "array<struct<step:int,node:bigint,beam:int,is_full:boolean,full_pops:int,unvisited:int,accepted:int,cfr:double,cfr_smoothed:double,popped_dist:double,furthest_dist:double,best_dist:double,kth_dist:double,hits:int>>"
FOUND = f"qid long, shard int, ids array<long>, dists array<double>, ndis long, nhops long, full_pops long, window_obs long, cfr_mean double, effective_ef int, first_hit int, ended string, trace {TRACE}"


@dataclass(frozen=True)
class Walk:
    """Parameters of a walk. ``hide_self`` leaves the query's own id out of the
    graph; ``budget`` ends the walk at a number of distances; ``radius`` returns
    all hits strictly within it; ``stop`` is asked every ``interval`` distances
    with the walk's features; ``predict`` is asked once, after ``after``
    distances, for the budget; ``allowed`` says which ids may be hits;
    ``entries`` are ids at which the lowest level is entered, in place of the
    way down, in one beam or, if ``separate``, in a beam for each of them;
    ``unbounded`` keeps candidates that the beam has no room for in the queue.

    A walk has ``ended`` by its "width" if the beam was nearer than all that was
    left, "exhausted" if nothing was left, or by its "budget" or a "stop"."""

    k: int = 10
    ef: int = 64
    adaptive: Adaptive | None = None
    hide_self: bool = False
    budget: int | None = None
    radius: float | None = None
    trace: bool = False
    interval: int = 0
    stop: Callable[[dict], bool] | None = None
    allowed: Callable | None = None
    target_hits: int = 0
    after: int = 0
    predict: Callable[[dict], float] | None = None
    entries: tuple[int, ...] = ()
    separate: bool = False
    unbounded: bool = False


def features(ndis: int, hops: int, inserted: int, first: float, results: list[float]) -> dict:
    """What a learned stop sees: counts, and the distances of the hits so far."""
    import numpy as np

    r = np.asarray(results or [math.inf])
    q = np.percentile(r, [25, 50, 75])
    return {"steps": hops, "ndis": ndis, "inserted": inserted, "first": first, "nearest": float(r.min()), "furthest": float(r.max()), "mean": float(r.mean()), "variance": float(r.var()), "q25": float(q[0]), "q50": float(q[1]), "q75": float(q[2])}


def walk(g: Graph, q, w: Walk, hidden: int = -1, wanted: frozenset = frozenset()) -> dict:
    """One query over one graph. ``hidden`` is a node that is neither traversed
    nor returned; ``wanted`` are the ids whose first full appearance among the
    hits is reported as ``first_hit``."""
    import numpy as np

    if w.separate and len(w.entries) > 1:
        return _merged([walk(g, q, replace(w, entries=(e,), separate=False), hidden, wanted) for e in w.entries], w, metric(g.metric).larger_is_better)
    a, n = w.adaptive, len(g.ids)
    width = max(w.ef, 1, w.k)
    entry, level = g.entry, len(g.links) - 1
    if entry == hidden:
        left = [(lv, i) for lv, links in enumerate(g.links) for i in np.flatnonzero((links >= 0).any(axis=1)).tolist() if i != hidden]
        level, entry = max(left, default=(0, next((i for i in range(n) if i != hidden), -1)), key=lambda x: (x[0], -x[1]))
    out = {"ids": [], "dists": [], "ndis": 0, "nhops": 0, "full_pops": 0, "window_obs": 0, "cfr_mean": None, "effective_ef": width, "first_hit": None, "ended": "exhausted", "trace": [] if w.trace else None}
    if entry < 0:
        return out
    start = [i for i in np.flatnonzero(np.isin(g.ids, w.entries)).tolist() if i != hidden] if w.entries else [entry]
    if not start:
        return out
    d_start = g.distances(q, np.array(start)).tolist()
    near, d_near = start[0], d_start[0]
    ndis, hops = len(start), 0
    for lv in range(0 if w.entries else level, 0, -1):
        while True:
            nodes = g.links[lv][near]
            nodes = nodes[(nodes >= 0) & (nodes != hidden)]
            if not len(nodes):
                break
            d = g.distances(q, nodes)
            ndis += len(nodes)
            i = int(np.argmin(d))
            if not d[i] < d_near:
                break
            near, d_near, hops = int(nodes[i]), float(d[i]), hops + 1

    if not w.entries:
        start, d_start = [near], [d_near]
    seen = np.zeros(n, bool)
    seen[start] = True
    if hidden >= 0:
        seen[hidden] = True
    plain = not (a or w.trace or w.stop or w.predict or w.allowed or wanted) and w.budget is None and w.radius is None
    if plain and width > n - (hidden >= 0):
        return out | _everything(g, q, w.k, start, seen) | {"ndis": ndis + int(seen.sum()) - (hidden >= 0) - len(start), "nhops": hops + int(seen.sum()) - (hidden >= 0)}
    beam, first, inserted, budget = _Beam(width, w.unbounded), min(d_start), 0, w.budget
    hits: list[tuple[float, int]] = []  # a heap of (-distance, -id), the worst first
    within: list[tuple[float, int]] = []
    ok = w.allowed

    def offer(d: float, i: int) -> bool:
        nonlocal inserted
        beam.push(d, i)
        if ok is not None and not ok(int(g.ids[i])):
            return False
        if w.radius is not None and (d < (-w.radius if metric(g.metric).larger_is_better else w.radius)):
            within.append((d, int(g.ids[i])))
        row = (-d, -int(g.ids[i]))
        if len(hits) < w.k:
            heapq.heappush(hits, row)
        elif row > hits[0]:
            heapq.heapreplace(hits, row)
        else:
            return False
        inserted += 1
        return True

    for d, i in zip(d_start, start):
        offer(d, i)
    full = window = 0
    smoothed, total, mean, asked, classified = math.nan, 0.0, math.nan, 0, False
    start, end, decay = (a.start, a.end, a.decay) if a else (4, 16, 0.8)
    limit = width
    while (popped := beam.pop()) is not None:
        d, node = popped
        if beam.below(d) >= limit:
            out["ended"] = "width"
            break
        hops += 1
        is_full, cfr = len(beam.rows) >= limit, math.nan
        if is_full:
            full += 1
            cfr = g.external(d) / max(g.external(beam.rows[-1][0]), 1e-6)
            smoothed = cfr if math.isnan(smoothed) else decay * smoothed + (1 - decay) * cfr
            if start <= full <= end:
                total, window = total + smoothed, window + 1
            if full == end and not classified:
                classified, mean = True, total / max(1, window)
                if a and (new := a.width(limit, w.k, mean)) < limit:
                    limit = new
                    beam.shrink(limit)
        nodes = g.links[0][node]
        nodes = nodes[nodes >= 0]
        nodes = nodes[~seen[nodes]]
        taken = 0
        if len(nodes):
            seen[nodes] = True
            new = g.distances(q, nodes)
            ndis += len(nodes)
            for x, i in zip(new.tolist(), nodes.tolist()):
                taken += offer(x, i)
        if w.trace:
            found = sum(-i in wanted for _, i in hits) if wanted else 0
            out["trace"].append({"step": hops, "node": int(g.ids[node]), "beam": len(beam.rows), "is_full": is_full, "full_pops": full, "unvisited": len(nodes), "accepted": taken,
                                 "cfr": None if math.isnan(cfr) else cfr, "cfr_smoothed": None if math.isnan(smoothed) else smoothed, "popped_dist": g.external(d),
                                 "furthest_dist": g.external(beam.rows[-1][0]), "best_dist": g.external(beam.rows[0][0]), "kth_dist": g.external(-hits[0][0]) if hits else None, "hits": found})
        if wanted and out["first_hit"] is None and sum(-i in wanted for _, i in hits) >= min(w.target_hits or len(wanted), len(wanted)):
            out["first_hit"] = hops
        if w.predict is not None and budget is None and ndis >= w.after:
            budget = w.predict(features(ndis, hops, inserted, first, [-x for x, _ in hits]))
        if budget is not None and ndis >= budget:
            out["ended"] = "budget"
            break
        if w.stop is not None and w.interval and ndis - asked >= w.interval:
            asked = ndis
            if w.stop(features(ndis, hops, inserted, first, [-x for x, _ in hits])):
                out["ended"] = "stop"
                break
    if out["ended"] == "exhausted" and (beam.full or limit < width):
        out["ended"] = "width"
    best = sorted(within) if w.radius is not None else sorted((-x, -i) for x, i in hits)
    sign = -1 if metric(g.metric).larger_is_better else 1
    return out | {"ids": [i for _, i in best], "dists": [sign * x for x, _ in best], "ndis": ndis, "nhops": hops, "full_pops": full, "window_obs": window,
                  "cfr_mean": total / window if window else None, "effective_ef": limit}


def _everything(g: Graph, q, k: int, start: list[int], seen) -> dict:
    """Hits of a walk whose beam has room for all nodes: it ends when each that links
    lead to has been met, in whatever order, so links are followed a front at a time
    and distances computed at once. ``seen`` gets the nodes that were met."""
    import numpy as np

    links, front, met = g.links[0], np.array(start), [np.array(start)]
    while len(front):
        there = np.zeros(len(seen) + 1, bool)  # the last for places without a link
        there[links[front]] = True
        front = np.flatnonzero(there[:-1] & ~seen)
        seen[front] = True
        met.append(front)
    nodes = np.concatenate(met)
    d, ids = g.distances(q, nodes), g.ids[nodes]
    best = np.lexsort((ids, d))[:k]
    sign = -1 if metric(g.metric).larger_is_better else 1
    return {"ids": ids[best].tolist(), "dists": [sign * x for x in d[best].tolist()]}


def _merged(walks: list[dict], w: Walk, larger: bool) -> dict:
    """Walks from several entries as one: their hits together, what they did added
    up."""
    near: dict[int, float] = {}
    for x in walks:
        for d, i in zip(x["dists"], x["ids"]):
            near[i] = min(near.get(i, math.inf), -d if larger else d)
    best = sorted((d, i) for i, d in near.items())
    best = best if w.radius is not None else best[: w.k]
    means = [x["cfr_mean"] for x in walks if x["cfr_mean"] is not None]
    total = {k: sum(x[k] for x in walks) for k in ("ndis", "nhops", "full_pops", "window_obs")}
    return total | {"ids": [i for _, i in best], "dists": [-d if larger else d for d, _ in best], "cfr_mean": sum(means) / len(means) if means else None, "effective_ef": max(x["effective_ef"] for x in walks),
                    "first_hit": None, "ended": walks[-1]["ended"], "trace": [t for x in walks for t in x["trace"]] if w.trace else None}


def search(queries: DataFrame, index: DataFrame, w: Walk = Walk(), wanted: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Walk the shards for the queries: a row for each with its hits and what the
    walk did. ``queries`` is (qid, qv); ``wanted`` is (qid, ids). A query's own ef
    may stand in a third column, ``ef``, which replaces the walk's. ``routes``
    (qid, list_no), such as ``ivf.probes`` of an index's centroids, says which
    routes each query takes; without it, it takes all."""
    own_ef = "ef" in queries.columns
    q = queries.select(F.col(queries.columns[0]).alias("qid"), F.col(queries.columns[1]).cast("array<double>").alias("qv"), *([F.col("ef").cast("int").alias("ef")] if own_ef else [])).where("qid is not null and qv is not null")
    if wanted is not None:
        q = q.join(wanted.select("qid", "ids"), "qid", "left")
    extra = [c for c in ("ef", "ids") if c in q.columns]
    own = F.struct("qid", *extra) if extra else F.lit(None).cast("struct<qid:bigint>")
    q = q.select("qid", "qv", own.alias("own"), F.size("qv").alias("width"))
    if routes is not None:
        from lodestar.operators.ivf import in_blocks

        q = in_blocks(q.join(routes.select("qid", "list_no"), "qid"), WALKED, "qid").withColumnRenamed("list_no", "route")
        on = ["route", "width"]
    else:
        n = max(1, -(-q.count() // WALKED))
        q = q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int"))
        index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        on = ["block", "width"]
    q = q.groupBy(*dict.fromkeys([*on, "block"])).agg(F.collect_list(F.struct("qid", "qv", "own")).alias("queries"))
    work = index.join(q, on)
    arrow = to_arrow_schema(_parse_datatype_string(FOUND))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if (key := (row["shard"], zlib.crc32(row["links"]), zlib.crc32(row["ids"]))) not in known:
                    known.clear()  # one graph at a time; rows of a shard tend to follow each other
                    g = load(row)
                    known[key] = g, {int(i): p for p, i in enumerate(g.ids)}
                g, place = known[key]
                out = []
                for x in row["queries"]:
                    own = x["own"] or {}
                    mine = replace(w, ef=own["ef"]) if own.get("ef") else w
                    found = walk(g, np.asarray(x["qv"], float), mine, place.get(x["qid"], -1) if w.hide_self else -1, frozenset(own.get("ids") or ()))
                    out.append({"qid": x["qid"], "shard": row["shard"], **found})
                    if len(out) == HELD:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return work.mapInArrow(run, FOUND)


def hits(found: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The result ``(qid, rank, id, dist)`` over all shards."""
    rows = found.select("qid", F.explode(F.arrays_zip("ids", "dists")).alias("h")).select("qid", F.col("h.ids").alias("id"), F.col("h.dists").alias("dist"))
    return top(rows, k, metric(name).larger_is_better)


def stats(found: DataFrame) -> DataFrame:
    """What the walks of each query did, over all shards."""
    return found.groupBy("qid").agg(F.sum("ndis").alias("ndis"), F.sum("nhops").alias("nhops"), F.sum("full_pops").alias("full_pops"), F.avg("cfr_mean").alias("cfr_mean"), F.max("effective_ef").alias("effective_ef"))


def lists_of(index: DataFrame) -> DataFrame:
    """The rows of an index as inverted lists ``(id, embedding, list_no)``, by the
    routes of its shards."""
    rows = members(index).join(index.select("shard", F.col("route").alias("list_no")), "shard").select("id", "list_no")
    return vectors_of(index).join(rows, "id")


def steps(found: DataFrame) -> DataFrame:
    """The trace as rows."""
    return found.select("qid", "shard", F.explode("trace").alias("t")).select("qid", "shard", "t.*")


def permuted(index_edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Links with nodes renumbered by ``(old, new)``."""
    a, b = permutation.toDF("node", "new_node"), permutation.toDF("neighbour", "new_neighbour")
    return index_edges.join(a, "node").join(b, "neighbour").select("shard", "level", F.col("new_node").alias("node"), F.col("new_neighbour").alias("neighbour"))


def within_epsilon(queries: DataFrame, base: DataFrame, epsilon: float, least: int, most: int, name: str = "l2") -> DataFrame:
    """Hits within epsilon, but at least ``least`` and at most ``most``."""
    from lodestar.operators.knn import knn

    return at_most_within(knn(queries, base, most, name), epsilon, least)


def at_most_within(hits: DataFrame, epsilon: float, least: int) -> DataFrame:
    """Those of a result that are within epsilon, and the first ``least`` anyway."""
    return hits.where((F.col("dist") < epsilon) | (F.col("rank") <= least))


def train_stop(log: Sequence[tuple[dict, float]], ridge: float = 1e-3):
    """A linear model of recall from the features of a walk: weights by name,
    and a function that predicts."""
    import numpy as np

    names = sorted(log[0][0])
    x = np.array([[f[k] for k in names] for f, _ in log], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ np.array([y for _, y in log]))
    return lambda f: float(np.append((np.array([f[k] for k in names]) - mean) / scale, 1) @ weights)


def stop_at(predict: Callable[[dict], float], target: float, k: int) -> Callable[[dict], bool]:
    """Stop when the predicted recall reaches the target; never before k hits."""
    return lambda f: f["inserted"] >= k and predict(f) >= target


def recall_log(graph: Graph, queries, w: Walk, interval: int, truth: Sequence[frozenset], hidden: Sequence[int] | None = None) -> list[tuple[dict, float]]:
    """Features of walks at intervals with the recall that held there: what a
    learned stop trains on. ``hidden`` are nodes left out, one for each query, such
    as the query's own."""
    log: list[tuple[dict, float]] = []
    for q, true, own in zip(queries, truth, hidden or [-1] * len(truth)):
        seen: list[dict] = []
        walk(graph, q, replace(w, interval=interval, stop=lambda f: seen.append(f) or False), own)
        for f in seen:
            at = walk(graph, q, replace(w, budget=f["ndis"]), own)
            log.append((f, len(true & set(at["ids"])) / max(1, len(true))))
    return log


def save(index: DataFrame, path: str) -> None:
    index.write.parquet(path)


def load_or_build(base: DataFrame, path: str, name: str = "l2", **options) -> DataFrame:
    """The index at a path, built and saved there first if there is none."""
    from pyspark.errors import AnalysisException

    spark = base.sparkSession
    try:
        return spark.read.schema(INDEX).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save(build(base, name, options.pop("m", 16), options.pop("candidates", 64), **options), path)
    return spark.read.schema(INDEX).parquet(path)
