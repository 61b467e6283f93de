"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Vectors of a shard are gathered into cells: all members lie so close to their leader that any two of them
are linked.  The graph holds leaders only, so copies never crowd it.  Every vector is sent to every shard;
leaders near enough to hide a link are found by a beam search, and members of their cells are verified by
cosine in double precision.  A link to one member of a cell stands for the cell when components are joined.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, cut, shared_dir
from .tokens import gather

WIDTH, UPPER = 24, 12
BEAM, AUDITS, RECALL = 64, 256, 0.99
SHARDS, SHARD_ROWS = 4, 65_536
EDGE = 1e-6


class Graph:
    """A small-world graph over unit vectors with beam searches that run for many queries in step."""

    def __init__(self, dim: int, seed: int = 7):
        self.x = np.zeros((1024, dim), np.float32)
        self.near = [np.full((1024, WIDTH), -1, np.int32)]
        self.sims = np.full((1024, WIDTH), -2, np.float32)
        self.upper: list[list[int]] = []
        self.n = 0
        self.beam = BEAM
        self.rng = np.random.default_rng(seed)

    def _room(self, n: int) -> None:
        while n > len(self.x):
            self.x = np.concatenate([self.x, np.zeros_like(self.x)])
            self.sims = np.concatenate([self.sims, np.full_like(self.sims, -2)])
            self.near = [np.concatenate([a, np.full_like(a, -1)]) for a in self.near]

    def add(self, v: np.ndarray, found: np.ndarray) -> int:
        """A new node with forward links to a spread choice of `found` (ids, nearest first)."""
        i = self.n
        self._room(i + 1)
        self.x[i] = v
        self.n += 1
        if len(found):
            pool = self.x[found]
            to, among = pool @ v, pool @ pool.T
            kept: list[int] = []
            for k in range(len(found)):
                if not kept or to[k] > among[k, kept].max():
                    kept.append(k)
                    if len(kept) == WIDTH:
                        break
            for k in range(len(found)):  # fill up with the nearest
                if len(kept) >= WIDTH // 2:
                    break
                if k not in kept:
                    kept.append(k)
            nodes, s = found[kept], to[kept]
            self.near[0][i, : len(nodes)], self.sims[i, : len(nodes)] = nodes, s
            slot = self.sims[nodes].argmin(1)
            take = self.sims[nodes, slot] < s
            self.near[0][nodes[take], slot[take]] = i
            self.sims[nodes[take], slot[take]] = s[take]
        level = int(-math.log(max(self.rng.random(), 1e-12)) / math.log(UPPER))
        for up in range(min(level, 6)):
            if up == len(self.upper):
                self.upper.append([])
                self.near.append(np.full((len(self.x), UPPER), -1, np.int32))
            mates = np.array(self.upper[up], np.int64)
            if len(mates):
                s = self.x[mates] @ v
                best = mates[np.argsort(-s)[:UPPER]]
                table = self.near[up + 1]
                table[i, : len(best)] = best
                for b in best.tolist():
                    free = np.flatnonzero(table[b] < 0)
                    if len(free):
                        table[b, free[0]] = i
                    else:
                        own = self.x[table[b]] @ self.x[b]
                        k = int(own.argmin())
                        if own[k] < self.x[b] @ v:
                            table[b, k] = i
            self.upper[up].append(i)
        return i

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam of each query, nearest first; -1 where a beam is not full."""
        ids = np.full((len(q), beam), -1, np.int32)
        cos = np.full((len(q), beam), -2, np.float32)
        step = max(16, min(512, (64 << 20) // max(1, self.n)))
        for a in range(0, len(q), step):
            ids[a : a + step], cos[a : a + step] = self._search(q[a : a + step], beam)
        return ids, cos

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        cur = np.full(m, self.upper[-1][0] if self.upper else 0, np.int64)
        best = np.einsum("qd,qd->q", self.x[cur], q)
        for up in range(len(self.upper), 0, -1):
            table = self.near[up]
            live = np.arange(m)
            while len(live):
                nb = table[cur[live]]
                s = np.where(nb >= 0, np.einsum("qkd,qd->qk", self.x[nb], q[live]), -2)
                k = s.argmax(1)
                top = s[np.arange(len(live)), k]
                better = top > best[live]
                live = live[better]
                cur[live], best[live] = nb[better, k[better]], top[better]
        seen = np.zeros((m, self.n), bool)
        seen[np.arange(m), cur] = True
        ids = np.full((m, beam), -1, np.int32)
        cos = np.full((m, beam), -2, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], cos[:, 0], done[:, 0] = cur, best, False
        live, wide = np.arange(m), 4
        table = self.near[0]
        while len(live):
            open_ = np.where(done[live], -3, cos[live])
            pick = np.argpartition(-open_, wide - 1, axis=1)[:, :wide] if beam > wide else np.tile(np.arange(beam), (len(live), 1))
            rows = np.arange(len(live))[:, None]
            ok = open_[rows, pick] > -3
            done[live[:, None], pick] = True
            nb = np.where(ok[:, :, None], table[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            fresh = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
            # the same neighbour by two ways counts once
            order = np.argsort(nb, axis=1, kind="stable")
            sorted_ = np.take_along_axis(nb, order, 1)
            again = np.zeros_like(fresh)
            again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
            dup = np.zeros_like(fresh)
            np.put_along_axis(dup, order, again, 1)
            fresh &= ~dup
            r, c = np.nonzero(fresh)
            seen[live[r], nb[r, c]] = True
            s = np.full(nb.shape, -2, np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.x[nb[r, c]], q[live[r]])
            all_ids = np.concatenate([ids[live], np.where(fresh, nb, -1)], 1)
            all_cos = np.concatenate([cos[live], s], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            top = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids[live], cos[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_cos, all_done))
            live = live[(~done[live]).any(1)]
        order = np.argsort(-cos, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)

    def around(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) for nodes at cosine >= least; a beam full of such nodes is widened, in the end to
        a scan of all nodes, so no beam cuts an answer short."""
        rows, nodes, todo, beam = [], [], np.arange(len(q)), self.beam
        while len(todo):
            if beam >= self.n:
                for a in range(0, len(todo), 512):
                    r, c = np.nonzero(q[todo[a : a + 512]] @ self.x[: self.n].T >= least)
                    rows.append(todo[a : a + 512][r])
                    nodes.append(c)
                break
            ids, cos = self.search(q[todo], beam)
            full = cos[:, -1] >= least
            r, c = np.nonzero((cos >= least) & ~full[:, None])
            rows.append(todo[r])
            nodes.append(ids[r, c].astype(np.int64))
            todo, beam = todo[full], beam * 4
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(nodes) if nodes else np.zeros(0, np.int64)

    def audit(self, least: float, at: float) -> None:
        """Widen the beam until vectors planted at cosine `at` from nodes find what a full scan finds."""
        if self.n < 2 * BEAM:
            return
        pick = self.x[self.rng.choice(self.n, min(AUDITS, self.n), replace=False)]
        noise = self.rng.standard_normal(pick.shape).astype(np.float32)
        noise -= pick * np.einsum("qd,qd->q", noise, pick)[:, None]
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        q = pick * at + noise / np.where(norm > 0, norm, 1) * math.sqrt(1 - at * at)
        truth = q @ self.x[: self.n].T >= least
        while self.beam < self.n:
            ids, cos = self.search(q, self.beam)
            hit = np.zeros_like(truth)
            r, c = np.nonzero(cos >= least)
            hit[r, ids[r, c]] = True
            if (hit & truth).sum() >= RECALL * truth.sum():
                return
            self.beam *= 2


class Index:
    """A shard: graph of leaders, cells of members with their vectors."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray, cosine: float):
        angle = math.acos(cosine)
        self.cosine, self.cell = cosine, math.cos(angle / 2) + EDGE
        self.reach = math.cos(min(math.pi, angle * 1.5)) - 1e-4
        self.graph = g = Graph(v.shape[1])
        unit = v.astype(np.float32)
        cells: list[list[int]] = []
        at = 0
        while at < len(v):
            step = max(1, min(256, g.n // 2))
            part = unit[at : at + step]
            ids_, cos_ = g.search(part, BEAM) if g.n else (np.zeros((len(part), 0), np.int32), np.zeros((len(part), 0), np.float32))
            mates: list[int] = []
            for k, q in enumerate(part):
                found = ids_[k][ids_[k] >= 0].astype(np.int64)
                cos = cos_[k][: len(found)]
                if mates:
                    s = g.x[mates] @ q
                    found, cos = np.concatenate([found, mates]), np.concatenate([cos, s])
                    order = np.argsort(-cos, kind="stable")[:BEAM]
                    found, cos = found[order], cos[order]
                if len(found) and cos[0] >= self.cell:
                    cells[int(found[0])].append(at + k)
                else:
                    mates.append(g.add(q, found))
                    cells.append([at + k])
            at += step
        g.audit(self.reach, cosine)
        order = np.concatenate([np.array(c) for c in cells]) if cells else np.zeros(0, np.int64)
        self.start = np.cumsum([0, *map(len, cells)])
        self.ids, self.copies, self.v = ids[order], copies[order], v[order]

    def links(self, own: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of q, smallest linked id, vectors linked) for each query and cell that it is linked to."""
        rows, nodes = self.graph.around(q.astype(np.float32), self.reach)
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        cut_at = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else []
        for a, b in zip(cut_at, [*cut_at[1:], len(nodes)]):
            s, e = self.start[nodes[a]], self.start[nodes[a] + 1]
            for lo in range(a, b, 1024):
                who = rows[lo : min(b, lo + 1024)]
                n, least = np.zeros(len(who), np.int64), np.full(len(who), np.iinfo(np.int64).max)
                for m in range(s, e, 4096):
                    ids = self.ids[m : min(e, m + 4096)]
                    hit = (q[who] @ self.v[m : min(e, m + 4096)].T >= self.cosine) & (ids[None, :] != own[who][:, None])
                    n += hit @ self.copies[m : min(e, m + 4096)]
                    least = np.minimum(least, np.where(hit, ids[None, :], np.iinfo(np.int64).max).min(1))
                some = n > 0
                if some.any():
                    yield who[some], least[some], n[some]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit vector or null, dim): null for vectors that link with nothing."""
    for b in batches:
        out, dims = [], []
        for x in b.column(1).to_pylist():
            v = None
            if x and None not in x:
                v = np.array(x, np.float64)
                top = np.abs(v).max() if np.isfinite(v).all() else 0.0
                v = v / top if top > 0 else None
            out.append(None if v is None else v / np.sqrt(v @ v))
            dims.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.float64())), pa.array(dims, pa.int32())], ["id", "unit", "dim"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def near_links(vectors: DataFrame, *, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all: id, rep; nodes: rep, copies; links: a, b, n) of vectors at a cosine of at least `cosine`.

    Equal vectors are one node.  A row of links says that node a is linked to n vectors of one cell, among
    them b.  Shards hold about shard_rows nodes each, and there are at least `shards`.
    """
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/graphs-{uuid.uuid4().hex}"
    plain = cut(arrow_map(vectors.select(id_col, vector_col), _unit, "id bigint, unit array<double>, dim int").withColumn("mark", F.xxhash64("unit")))
    usable = plain.where("unit is not null and id is not null")
    nodes = cut(usable.groupBy("mark", "unit", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    dims = {r["dim"]: max(shards, -(-r["n"] // shard_rows)) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").collect()}
    count = F.lit(1)
    for dim, n in dims.items():
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("rep")), count.cast("long")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        table = table.sort_by("rep")  # the same graph again when a task is run again
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        index = Index(table.column("rep").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("unit")), cosine)
        name = f"{base.rstrip('/')}/{uuid.uuid4().hex}.graph"
        with files.open_output_stream(name, compression=None) as out:
            out.write(pickle.dumps(index, protocol=5))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "name": [name], "beam": pa.array([index.graph.beam], pa.int64())})

    built = cut(placed.select("dim", "shard", "rep", "copies", "unit").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, name string, beam bigint"))
    names: dict[int, list[str]] = {}
    for r in built.orderBy("dim", "shard").collect():  # a row for each shard
        names.setdefault(r["dim"], []).append(r["name"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        for table in gather(batches, 8 << 20):
            dim = table.column(2).to_numpy()
            for d in np.unique(dim):
                part = table.filter(pa.array(dim == d))
                own, q = part.column(0).to_numpy(), _matrix(part.column(1))
                for name in names[int(d)]:
                    with files.open_input_file(name) as file:
                        index = pickle.loads(file.read())
                    for rows, least, n in index.links(own, q):
                        yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(least), pa.array(n)], ["a", "b", "n"])

    links = cut(arrow_map(nodes.select("rep", "unit", "dim").repartition("rep"), search, "a bigint, b bigint, n bigint"))
    same = nodes.select(F.col("mark").alias("m"), F.col("unit").alias("u"), "rep")
    every = plain.join(same, (plain.mark == same.m) & (plain.unit == same.u), "left").select("id", "rep")
    return every, nodes.select("rep", "copies"), links


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: near vectors linked, components by their smallest id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link
    with nothing.  Vectors of different lengths never link.  Equal vectors link at cosine 1.  Links are found by
    graph search, so a few may be missed (audits demand 99 % of planted ones); none is below `cosine`.
    """
    every, nodes, links = near_links(vectors, cosine=cosine, id_col=id_col, vector_col=vector_col, **sizes)
    found = components(links.select("a", "b"))
    n = links.groupBy("a").agg(F.sum("n").alias("n"))
    info = nodes.join(n, nodes.rep == n.a, "left").join(found, nodes.rep == found.id, "left")
    info = cut(info.select(F.col("rep").alias("r"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = every.join(info, every.rep == info.r, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
