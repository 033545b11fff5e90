"""Most similar vectors for every vector: groups of linked vectors compared whole, or a navigable small-world graph per shard.

Groups. Where a similarity of ``GROUPED_FROM`` or more is asked for, vectors are first only linked: rounded to
bytes, which are a quarter as large, each asks its own cell and the ``ASKED`` nearest others, is compared with all
that live there, and is linked to those that may be similar enough (the bound of the rounding is allowed for). The linked vectors
of a cell come out as stars, the stars of all cells as groups, and in its group every vector is compared with all others at full
precision. So a pair that met in no cell is found if a chain of pairs that did meet joins it. Groups of more than
``GROUP_ROWS`` vectors, and all vectors where less similarity is asked for, are searched by graphs.

Routing. Centroids cut the collection into cells; every vector is indexed in the cell of its nearest centroid
and, for the graphs, asks its own cell and the ``PROBES`` nearest others. Few centroids are fitted on one bounded sample
(``SAMPLE_ROWS``); many are fitted in two steps, the second by one task per first-step cell on
``FIT_ROWS`` vectors a centroid. A cell that holds more than ``SHARD_ROWS`` vectors (a face that a third of all
rows show) is cut again by centroids of its own. What even these cannot part is split into shards by a hash,
and wherever many vectors ask one cell they are split into parts, so neither index nor queries of a task grow.

Index. ``SmallWorld`` is a hierarchical navigable small-world graph over one shard: random levels, on
each level flat arrays of neighbour numbers, filled by inserting vectors in growing batches, each batch
searching the graph of those before it. Neighbours are picked by the diversity rule with the closest
filling up the rest. A search enters by the top level, all of whose (about ``ENTRY`` at most) vectors are compared in one
product, and walks the levels below it. All searches of a batch run together as array operations.

Copies. Vectors with the same direction are collapsed first: one representative is indexed, and a
representative's copies are put back at the end by id order, so copies neither crowd the
candidate lists nor are lost.

Similarities of the pairs found are computed again in double precision before they are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumencase.operators.components import min_labels
from lumencase.staging import cut, release, small_enough

#: Vectors the centroids are fitted on at most; indexed vectors a shard has at most (about); other cells a vector asks.
SAMPLE_ROWS, SHARD_ROWS, CELL_ROWS, PROBES = 8192, 32_768, 16_384, 2
#: Centroids fitted at once at most; vectors a centroid is fitted on in a later step; times that cells too large are cut again; rows of a task that ask.
FIT_CELLS, FIT_ROWS, CUTS, ASKING_ROWS = 128, 64, 3, 131_072
#: Similarity from which vectors are grouped; other cells a vector asks for its links; vectors of a group that are compared whole at most, and of a task about.
GROUPED_FROM, ASKED, GROUP_ROWS, TASK_ROWS = 0.5, 7, 65_536, 8192
#: Links a task holds before it reduces them to stars.
LINKS = 1 << 20
#: Neighbours a vector keeps on the ground level and above; candidates while building and while searching.
GROUND, UPPER, EF_BUILD, EF_SEARCH = 16, 10, 16, 20
#: Neighbours a search returns beyond k; the vectors they are found for gain candidates the other way.
SPARE = 6
#: One vector in RISE rises a level, the top level has about ENTRY vectors at most; candidates carried down while an upper level is walked.
RISE, ENTRY, EF_UPPER = 8, 4096, 8
#: The step after which a search gives up that has met nothing within FLOOR_GAP of the similarity asked for.
FLOOR_STEP, FLOOR_GAP = 4, 0.3
#: Centroids more similar than this are one: copies whose float32 directions differ in the last bits.
SAME_CENTROID = 1 - 1e-5
#: Cells at most: the centroid table stays under 16 MB of 128 numbers.
MAX_CELLS = 32_768


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        # one vector in RISE rises a level, as in a skip list; the top level is the first that is small enough to enter by
        top = max(1, math.ceil(math.log(max(n, 1) / ENTRY, RISE)))
        level = np.minimum(np.floor(-np.log(1.0 - rng.random(n)) / math.log(RISE)).astype(np.int64), top)
        self.level = level
        self.neighbours: list[np.ndarray] = [np.full((n, GROUND if v == 0 else UPPER), -1, dtype=np.int32) for v in range(int(level.max(initial=0)) + 1)]
        self.closeness: list[np.ndarray] = [np.full(a.shape, -np.inf, dtype=np.float32) for a in self.neighbours]
        self.inserted = 0
        # the highest vectors come first, so that every level is there when it is needed
        self.order = np.lexsort((rng.random(n), -level))
        self.x, self.level = self.x[self.order], self.level[self.order]
        while self.inserted < n:
            self._insert(min(n - self.inserted, max(64, min(self.inserted, 1024))))

    def _top(self, level: int) -> int:
        """How many of the inserted vectors stand on a level; they are the first ones."""
        return int(np.searchsorted(-self.level[: self.inserted], -level, "right"))

    def _insert(self, m: int) -> None:
        start, end = self.inserted, self.inserted + m
        q = self.x[start:end]
        entry, beam = None, None
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        for level in range(len(self.neighbours) - 1, -1, -1):
            here = self.level[start:end] >= level
            if start:
                ids, sims = self._search_level(q, level, entry, EF_BUILD if here.any() else EF_UPPER)
                if ids is not None:
                    entry, beam = ids, sims
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            # candidates: what the search found among earlier vectors and the batch's own on this level
            own = np.where(here[None, :], within[rows], -np.inf)
            k = min(EF_BUILD, m)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            near_sims = np.take_along_axis(own, near, axis=1)
            near = np.where(np.isfinite(near_sims), near + start, -1)
            if entry is not None and start and self._top(level):
                ids, sims = np.hstack([entry[rows], near]), np.hstack([beam[rows], near_sims])
            else:
                ids, sims = near, near_sims
            self._link(level, rows + start, ids.astype(np.int32), sims)
        self.inserted = end

    def _pick(self, level: int, owner: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours kept out of candidates: half by the diversity rule, the rest the closest left."""
        width = self.neighbours[level].shape[1]
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        c = ids.shape[1]
        if c <= width:
            pad = ((0, 0), (0, width - c))
            return np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf)
        v = self.x[np.maximum(ids, 0)]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, dtype=bool)
        for j in range(c):
            # kept if it is closer to the owner than to any neighbour kept before it
            rival = np.where(kept[:, :j], mutual[:, j, :j], -np.inf).max(axis=1) if j else np.full(len(ids), -np.inf)
            kept[:, j] = (ids[:, j] >= 0) & (rival < sims[:, j]) & (kept.sum(axis=1) < width // 2)
        rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)[None, :]
        take = np.argsort(rank, axis=1)[:, :width]
        return np.take_along_axis(ids, take, axis=1), np.take_along_axis(sims, take, axis=1)

    def _link(self, level: int, owners: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        got, close = self._pick(level, owners, ids, sims)
        self.neighbours[level][owners], self.closeness[level][owners] = got, close
        # the reverse links: each target's list is picked again from what it had and the newcomers
        src, slot = np.nonzero(got >= 0)
        target, source, sim = got[src, slot], owners[src].astype(np.int32), close[src, slot]
        order = np.lexsort((-sim, target))
        target, source, sim = target[order], source[order], sim[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, dtype=np.int64)
        at = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        width = self.neighbours[level].shape[1]
        fits = at < width
        touched = target[first]
        row = np.searchsorted(touched, target)
        new = np.full((len(touched), min(width, int(at.max(initial=0)) + 1)), -1, dtype=np.int32)
        news = np.full(new.shape, -np.inf, dtype=np.float32)
        new[row[fits], at[fits]], news[row[fits], at[fits]] = source[fits], sim[fits]
        old, olds = self.neighbours[level][touched], self.closeness[level][touched]
        # one that links back already is not a second candidate
        again = (new[:, :, None] == old[:, None, :]).any(axis=2)
        new, news = np.where(again, -1, new), np.where(again, -np.inf, news)
        self.neighbours[level][touched], self.closeness[level][touched] = self._pick(level, touched, np.hstack([old, new]), np.hstack([olds, news]))

    def _search_level(self, q: np.ndarray, level: int, entry: np.ndarray | None, ef: int, floor: float | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        n = self._top(level)
        if not n:
            return None, None
        if level and entry is None:
            # the top level gives the entry points: all its vectors are compared, by one block product
            sims = q @ self.x[:n].T
            m = min(ef, n)
            ids = np.argpartition(-sims, m - 1, axis=1)[:, :m].astype(np.int32)
            return ids, np.take_along_axis(sims, ids, axis=1)
        if entry is None:  # nothing stands on the top level yet
            entry = np.broadcast_to(np.arange(min(n, 32), dtype=np.int32), (len(q), min(n, 32)))
        return self._beam(q, level, entry, ef, n, floor)

    def _beam(self, q: np.ndarray, level: int, entry: np.ndarray, ef: int, n: int, floor: float | None = None, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries together; each step opens the ``at_once`` best unopened of each.

        With a ``floor``, a query that has met nothing as similar after FLOOR_STEP steps gives up.
        """
        graph, x, m = self.neighbours[level], self.x, len(q)
        ids = np.full((m, ef), -1, dtype=np.int32)
        sims = np.full((m, ef), -np.inf, dtype=np.float32)
        opened = np.zeros((m, ef), dtype=bool)
        # 0 where a vector has not been met; else 1 + the place at which it was, so that of twins in a step one counts
        seen = np.zeros((m, n + 1), dtype=np.int8)
        seen[:, n] = 127  # where missing neighbours point
        rows = np.arange(m)
        fresh, who, step = np.where(entry >= 0, entry, n), rows, 0
        while len(who):
            place = np.arange(1, fresh.shape[1] + 1, dtype=np.int8)[None, :]
            new = seen[who[:, None], fresh] == 0
            r, c = np.nonzero(new)
            seen[who[r], fresh[r, c]] = place[0, c]
            last = seen[who[r], fresh[r, c]] == place[0, c]
            r, c = r[last], c[last]
            s = np.full(fresh.shape, -np.inf, dtype=np.float32)
            if len(r):
                s[r, c] = np.einsum("nd,nd->n", x[fresh[r, c]], q[who[r]])
            all_s = np.hstack([sims[who], s])
            all_i = np.hstack([ids[who], fresh.astype(np.int32)])
            all_o = np.hstack([opened[who], np.zeros(s.shape, dtype=bool)])
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[who] = np.take_along_axis(all_s, keep, axis=1)
            ids[who] = np.where(np.isfinite(sims[who]), np.take_along_axis(all_i, keep, axis=1), -1)
            opened[who] = np.take_along_axis(all_o, keep, axis=1) | ~np.isfinite(sims[who])
            who = who[~opened[who].all(axis=1)]
            step += 1
            if floor is not None and step == FLOOR_STEP:
                who = who[sims[who].max(axis=1) >= floor]
            if not len(who):
                break
            waiting = np.where(opened[who], -np.inf, sims[who])
            pick = np.argpartition(-waiting, at_once - 1, axis=1)[:, :at_once]
            live = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            opened[who[:, None], pick] = True
            node = np.where(live, np.take_along_axis(ids[who], pick, axis=1), 0)
            fresh = graph[node]
            fresh = np.where(live[:, :, None] & (fresh >= 0) & (fresh < n), fresh, n).reshape(len(who), -1)
        return ids, sims

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, floor: float | None = None, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, similarities) of about the k most similar vectors of each query, -1 where there are fewer."""
        outs = []
        for at in range(0, len(q), batch):
            part, entry, sims = np.ascontiguousarray(q[at : at + batch], dtype=np.float32), None, None
            for level in range(len(self.neighbours) - 1, -1, -1):
                ids, got = self._search_level(part, level, entry, max(ef, k) if level == 0 else EF_UPPER, floor if level == 0 else None)
                if ids is not None:
                    entry, sims = ids, got
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            outs.append((np.take_along_axis(entry, best, axis=1), np.take_along_axis(sims, best, axis=1)))
        ids, sims = (np.concatenate(p) for p in zip(*outs, strict=True)) if outs else (np.empty((0, k), np.int32), np.empty((0, k), np.float32))
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims


def unit_vectors(rows: DataFrame, id: str = "id", vector: str = "embedding", size: int = 128) -> DataFrame:
    """id, v: the direction of every usable vector, as the bytes of its float32 numbers.

    Usable means ``size`` finite numbers, not all zero; null ids and repeated rows of an id are left out or kept once.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"", dtype=np.float64).reshape(0, size) if not batch.num_rows else _flat(batch.column(1), size)
            fine = np.isfinite(x).all(axis=1)
            x = np.where(fine[:, None], x, 0.0)
            norm = np.sqrt((x * x).sum(axis=1))
            fine &= (norm > 0) & np.isfinite(norm)
            u = (x[fine] / norm[fine][:, None]).astype(np.float32)
            yield pa.record_batch([batch.column(0).filter(pa.array(fine)), pa.array([r.tobytes() for r in u], pa.binary())], ["id", "v"])

    cast = F.col(vector).cast("array<double>")
    usable = rows.select(F.col(id).cast("long").alias("id"), F.when(F.size(cast) == size, cast).alias("x")).where("id is not null and x is not null").where(~F.exists("x", lambda e: e.isNull()))
    return usable.mapInArrow(unit, "id long, v binary")


def _flat(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The vectors of a binary column without nulls, read from its buffer."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], dtype=np.float32, count=(ends[-1] - ends[0]) // 4, offset=int(ends[0])).reshape(-1, size))
    return np.concatenate(parts) if parts else np.empty((0, size), dtype=np.float32)


def _fit(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """At most ``cells`` unit centroids of distinct directions by spherical k-means."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where((norm > 0)[:, None], total / np.maximum(norm, 1e-30)[:, None], c).astype(np.float32)
    return c


def _distinct(c: np.ndarray) -> np.ndarray:
    """Of equal centroids one: a vector that asks cells of the same direction would meet none beyond them."""
    again = [(np.tril(c[at : at + 1024] @ c.T, at - 1) > SAME_CENTROID).any(axis=1) for at in range(0, len(c), 1024)]
    return c[~np.concatenate(again)]


def _refit(vectors: DataFrame, c: np.ndarray, wanted: dict[int, tuple[int, int]], size: int) -> np.ndarray:
    """The centroids with those in ``wanted`` (cell -> (its vectors, centroids it shall have)) replaced by ones fitted in the cell.

    Each cell is fitted by one task on about FIT_ROWS vectors a centroid, FIT_CELLS * FIT_ROWS at most, picked by their ids' hashes.
    """
    rows = [(cell, min(1.0, FIT_ROWS * k / n), k) for cell, (n, k) in wanted.items()]
    asked = vectors.sparkSession.createDataFrame(rows, "cell int, share double, k int")
    homes = _route(vectors, c, size, 0).join(F.broadcast(asked), "cell")  # at most MAX_CELLS rows
    picked = homes.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("cell", "id", "v", "k")

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"], size)[np.argsort(table["id"].to_numpy(), kind="stable")]
        found = _fit(x, table["k"][0].as_py())
        return pa.table({"cell": pa.array([table["cell"][0].as_py()] * len(found), pa.int32()), "v": pa.array([r.tobytes() for r in found], pa.binary())})

    made = picked.groupBy("cell").applyInArrow(fit, "cell int, v binary").orderBy("cell", "v").toArrow()  # at most MAX_CELLS centroids
    kept = np.ones(len(c), dtype=bool)
    kept[np.unique(made["cell"].to_numpy())] = False
    return _distinct(np.concatenate([c[kept], _matrix(made["v"], size)]))


def centroids(vectors: DataFrame, cells: int, size: int, total: int) -> np.ndarray:
    """About ``cells`` unit centroids fitted on a bounded share of the ``total`` vectors, picked by their ids' hashes."""
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(total, 1))  # so that no partition sorts and sends more than its part
    sample = vectors.where(order < share * (1 << 40)).orderBy(order, "id").limit(SAMPLE_ROWS).select("v").toArrow()
    x = _matrix(sample["v"], size)
    if not len(x):
        return np.zeros((1, size), dtype=np.float32)
    if cells <= FIT_CELLS:
        return _distinct(_fit(x, cells))
    c = _distinct(_fit(x, min(FIT_CELLS, math.ceil(math.sqrt(cells)))))
    sizes = {cell: n for cell, (n, _) in _sizes(_route(vectors, c, size, 0)).items()}
    whole = sum(sizes.values())
    return _refit(vectors, c, {cell: (n, min(FIT_CELLS, -(-cells * n // whole))) for cell, n in sizes.items()}, size)


def _sizes(routed: DataFrame) -> dict[int, tuple[int, int]]:
    """cell -> (vectors that live there, vectors that ask it): at most MAX_CELLS rows."""
    return {r["cell"]: (r["n"], r["asking"]) for r in routed.groupBy("cell").agg(F.count_if("home").alias("n"), F.count("*").alias("asking")).collect()}


def _cells(vectors: DataFrame, size: int, probes: int, total: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The centroids, cells that came out too large cut again, and the sizes of the cells."""
    c = centroids(vectors, int(min(MAX_CELLS, max(1, -(-total // CELL_ROWS)))), size, total)
    for cuts in range(CUTS + 1):
        sizes = _sizes(_route(vectors, c, size, probes, True))
        large = {cell: (n, min(FIT_CELLS, -(-n // CELL_ROWS))) for cell, (n, _) in sizes.items() if n > SHARD_ROWS}
        if not large or cuts == CUTS or len(c) + sum(k for _, k in large.values()) > MAX_CELLS:
            return c, sizes
        again = _refit(vectors, c, large, size)
        if len(again) == len(c):
            return c, sizes
        c = again


def _rounded(x: np.ndarray) -> pa.Array:
    """The directions as one signed byte a number, the largest at 127."""
    q = np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-30))[:, None]).astype(np.int8)
    ends = np.arange(len(q) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(q))])


def _route(vectors: DataFrame, c: np.ndarray, size: int, probes: int, rounded: bool = False) -> DataFrame:
    """id, v, cell, home: each vector, ``rounded`` to bytes or as it is, once for its own cell and once for each near cell it asks."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            near = x @ c.T
            k = min(probes + 1, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if len(x) else np.empty((0, k), np.int64)
            close = np.take_along_axis(near, top, axis=1)
            order = np.argsort(-close, axis=1)
            top, close = np.take_along_axis(top, order, axis=1), np.take_along_axis(close, order, axis=1)
            row, slot = np.nonzero(close > -np.inf)
            taken = pa.array(row)
            v = _rounded(x) if rounded else batch.column(1)
            yield pa.record_batch([batch.column(0).take(taken), v.take(taken), pa.array(top[row, slot].astype(np.int32)), pa.array(slot == 0)], ["id", "v", "cell", "home"])

    return vectors.mapInArrow(route, "id long, v binary, cell int, home boolean")


def _placed(vectors: DataFrame, size: int, probes: int, total: int, rounded: bool = False) -> DataFrame:
    """id, v, cell, shard, part, indexed, asks: each vector in all the tasks (cell, shard, part) that it lives in or asks."""
    c, sizes = _cells(vectors, size, probes, total)
    routed = _route(vectors, c, size, probes, rounded)
    # a cell that is still too large for one task is split by a hash into shards, all of which its queries ask in parts
    split = [(cell, -(-n // SHARD_ROWS), max(-(-n // SHARD_ROWS), -(-asking // ASKING_ROWS))) for cell, (n, asking) in sizes.items() if n > SHARD_ROWS or asking > ASKING_ROWS]
    if split:
        splits = vectors.sparkSession.createDataFrame(split, "cell int, shards int, parts int")
        routed = routed.join(F.broadcast(splits), "cell", "left").withColumns({"shards": F.coalesce("shards", F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})  # at most MAX_CELLS rows
        routed = routed.withColumns({"own": F.pmod(F.xxhash64("id"), F.col("shards")), "asks": F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))})
        routed = routed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        routed = routed.select("id", "v", "cell", "shard", "part", (F.col("home") & (F.col("own") == F.col("shard"))).alias("indexed"), (F.col("asks") == F.col("part")).alias("asks")).where("indexed or asks")
    else:
        routed = routed.select("id", "v", "cell", F.lit(0).alias("shard"), F.lit(0).alias("part"), F.col("home").alias("indexed"), F.lit(True).alias("asks"))

    # each group is a task's worth of work whatever its bytes, so the tasks are not merged
    groups = len(sizes) + sum(shards * parts for _, shards, parts in split)
    return routed.repartition(max(4 * groups, vectors.sparkSession.sparkContext.defaultParallelism), "cell", "shard", "part")


def _walked(vectors: DataFrame, k: int, min_similarity: float, size: int, probes: int, total: int) -> DataFrame:
    """id, other, similarity, rank by small-world graphs, of vectors among which no copies are."""
    routed = _placed(vectors, size, probes, total)

    def shard(table: pa.Table) -> pa.Table:
        ids, x, base = table["id"].to_numpy(), _matrix(table["v"], size), table["indexed"].to_numpy()
        got_id, got_other, got_sim = [], [], []
        # a repeated row of an id is indexed once
        pos = np.flatnonzero(base)
        pos = pos[np.unique(ids[pos], return_index=True)[1]]
        asking = np.flatnonzero(table["asks"].to_numpy())
        if len(pos) and len(asking):
            graph = SmallWorld(x[pos])
            for at in range(0, len(asking), 4096):
                part = asking[at : at + 4096]
                near, sims = graph.search(x[part], k + SPARE, floor=min_similarity - FLOOR_GAP if min_similarity > 0 else None)
                r, s = np.nonzero((near >= 0) & (sims >= min_similarity - 1e-4))
                found, r = pos[near[r, s]], part[r]
                keep = ids[r] != ids[found]
                r, found = r[keep], found[keep]
                a, b = x[r].astype(np.float64), x[found].astype(np.float64)
                exact = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                got_id.append(ids[r]), got_other.append(ids[found]), got_sim.append(exact)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"id": pa.array(join(got_id, np.int64)), "other": pa.array(join(got_other, np.int64)), "similarity": pa.array(join(got_sim, np.float64))})

    met = routed.groupBy("cell", "shard", "part").applyInArrow(shard, "id long, other long, similarity double")
    # what one vector's search found of another holds the other way too
    met = met.where(F.col("similarity") >= min_similarity)
    met = met.select(F.explode(F.array(F.struct("id", "other", "similarity"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))).alias("m")).select("m.*")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return met.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) join it to."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[a], least[b])
        now = least.copy()
        for at in (a, b, least[a], least[b]):
            np.minimum.at(now, at, m)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _links(table: pa.Table, min_similarity: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest ids of their stars) of the vectors of one task that may be as similar to another as ``min_similarity``."""
    ids, node = np.unique(table["id"].to_numpy(), return_inverse=True)
    home = np.flatnonzero(table["indexed"].to_numpy())
    home = home[np.unique(node[home], return_index=True)[1]]
    asking = np.flatnonzero(table["asks"].to_numpy())
    if not len(home) or not len(asking):
        return ids[:0], ids[:0]
    q = np.concatenate([np.frombuffer(c.buffers()[2], dtype=np.int8, count=len(c) * size, offset=int(np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset])).reshape(-1, size) for c in table["v"].chunks if len(c)])

    def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The directions, and how far rounding has moved them at most."""
        x = q[rows].astype(np.float32)
        norm = np.linalg.norm(x, axis=1)
        return x / norm[:, None], 0.5 * math.sqrt(size) / norm + 5e-4

    x, off = unit(home)
    x = np.ascontiguousarray(np.hstack([x, off[:, None]]).T, dtype=np.float32)
    a, b, held = [], [], 0
    for at in range(0, len(asking), 512):
        part = asking[at : at + 512]
        y, moved = unit(part)
        s = np.hstack([y, np.ones((len(y), 1), dtype=np.float32)]) @ x
        met = np.flatnonzero((s >= (min_similarity - moved).astype(np.float32)[:, None]).ravel())
        r, c = np.divmod(met, len(home))
        one, two = node[part[r]], node[home[c]]
        apart = one != two
        a.append(one[apart]), b.append(two[apart])
        held += int(apart.sum())
        if held > LINKS:
            star = _stars(len(ids), np.concatenate(a), np.concatenate(b))
            a, b, held = [np.flatnonzero(star != np.arange(len(ids)))], [star[star != np.arange(len(ids))]], 0
    star = _stars(len(ids), np.concatenate(a), np.concatenate(b))
    linked = star != np.arange(len(ids))
    return ids[linked], ids[star[linked]]


def _best_of_groups(table: pa.Table, k: int, min_similarity: float, size: int) -> pa.Table:
    """id, other, similarity, rank within each group of the table, all of a group being compared."""
    ids, label = table["id"].to_numpy(), table["label"].to_numpy()
    order = np.lexsort((ids, label))
    order = order[np.r_[True, np.diff(ids[order]) != 0]] if len(order) else order  # a repeated row of an id is kept once
    ids, label, x = ids[order], label[order], _matrix(table["v"], size)[order]
    first = np.r_[np.flatnonzero(np.r_[True, label[1:] != label[:-1]]), len(label)]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start, end in zip(first[:-1], first[1:], strict=True):
        own = x[start:end]
        m = min(k + SPARE, len(own) - 1)
        for at in range(0, len(own) if m else 0, 512):
            s = own[at : at + 512] @ own.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            r, c = np.nonzero(np.take_along_axis(s, near, axis=1) >= min_similarity - 1e-4)
            a.append(r + at + start), b.append(near[r, c] + start)
    a, b = np.concatenate(a), np.concatenate(b)
    sims = [np.empty(0)]
    for at in range(0, len(a), 16_384):
        u, v = x[a[at : at + 16_384]].astype(np.float64), x[b[at : at + 16_384]].astype(np.float64)
        sims.append((u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1)))
    sims = np.concatenate(sims)
    fine = np.flatnonzero(sims >= min_similarity)
    fine = fine[np.lexsort((ids[b[fine]], -sims[fine], a[fine]))]
    a, b, sims = a[fine], b[fine], sims[fine]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)])) + 1
    kept = rank <= k
    return pa.table({"id": ids[a[kept]], "other": ids[b[kept]], "similarity": sims[kept], "rank": rank[kept].astype(np.int32)})


def _grouped(vectors: DataFrame, k: int, min_similarity: float, size: int, probes: int, total: int) -> DataFrame:
    """id, other, similarity, rank by groups of linked vectors, of vectors among which no copies are."""
    routed = _placed(vectors, size, probes, total, True)

    def link(table: pa.Table) -> pa.Table:
        ids, least = _links(table, min_similarity, size)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(least, pa.int64())})

    links = routed.groupBy("cell", "shard", "part").applyInArrow(link, "a long, b long")
    labels = cut(min_labels(links).select(F.col("node").alias("id"), "label"))
    large = cut(labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS))
    n_large, n = large.count(), labels.count()
    sent = F.broadcast(labels) if small_enough(n, 32) else labels
    held = vectors.join(sent, "id")
    whole = held.join(F.broadcast(large), "label", "left_anti") if n_large else held  # at most one in GROUP_ROWS
    tasks = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    whole = whole.select("id", "label", "v", F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("task")).repartition(tasks, "task")
    top = whole.groupBy("task").applyInArrow(lambda table: _best_of_groups(table, k, min_similarity, size), "id long, other long, similarity double, rank int")
    if not n_large:
        return top
    rest = cut(held.join(F.broadcast(large), "label", "left_semi").select("id", "v"))
    return top.unionByName(_walked(rest, k, min_similarity, size, PROBES, rest.count()))


def nearest(rows: DataFrame, k: int = 10, min_similarity: float = -1.0, id: str = "id", vector: str = "embedding", size: int = 128, probes: int | None = None) -> DataFrame:
    """id, other, similarity, rank: for every usable vector about its k most similar others, ties to the smaller id.

    Only similarities of at least ``min_similarity`` are returned, and a graph's
    search that meets nothing near them gives up early. ``probes`` is the number of other cells a vector asks. Repeated rows of one id count once; null, short, non-finite and zero vectors are left out; fewer than two give no rows.
    """
    unit = cut(unit_vectors(rows, id, vector, size))
    # copies of a direction: only the smallest id is indexed, the others come back at the end
    keyed = unit.select("id", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"))
    copies = cut(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    n_copies, total = copies.count(), unit.count()
    members = keyed.join(F.broadcast(copies) if small_enough(n_copies, 40) else copies, ["k1", "k2"]).select("id", "rep").distinct()
    members = cut(members) if n_copies else None
    release(copies)
    # a repeated row of one id is a copy of itself: the id stays once
    extra = members.where("id != rep").select("id") if n_copies else None
    n_extra = extra.count() if n_copies else 0
    indexed = unit
    if n_copies:
        indexed = unit.join(F.broadcast(extra) if small_enough(n_extra, 24) else extra, "id", "left_anti")
    if min_similarity >= GROUPED_FROM:
        top = _grouped(indexed, k, min_similarity, size, ASKED if probes is None else probes, total - n_extra)
    else:
        top = _walked(indexed, k, min_similarity, size, PROBES if probes is None else probes, total - n_extra)
    if not n_copies:
        return top
    return _with_copies(cut(top.drop("rank")), members, k, Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))


def _with_copies(top: DataFrame, members: DataFrame, k: int, best: Window) -> DataFrame:
    """Puts copies back: a representative's list holds for all its copies, and each neighbour stands for its own.

    Of a neighbour's copies only the k + 1 smallest ids can be in a list of k, so only they are expanded.
    """
    # the k + 1 smallest ids of each set of copies, ranked in parts first so that a huge set is no single task
    part = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("rep").orderBy("id")
    few = members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("id", "rep")
    few = cut(few)
    others = top.join(few.select(F.col("id").alias("copy"), F.col("rep").alias("other")), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "similarity")
    short = others.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    # the lists of all copies of a representative, and the copies themselves at similarity 1
    lists = short.join(members.select(F.col("id").alias("copy"), F.col("rep").alias("id")), "id", "left").select(F.coalesce("copy", "id").alias("id"), "other", "similarity")
    same = members.join(few.select(F.col("id").alias("other"), "rep"), "rep").select("id", "other", F.lit(1.0).alias("similarity"))
    every = lists.unionByName(same).where("id != other").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, k: int = 10, min_similarity: float = 0.70, **names) -> DataFrame:
    """id_a, id_b (id_a < id_b): pairs of which either keeps the other among its k most similar."""
    kept = nearest(rows, k, min_similarity, **names)
    return kept.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall_report(rows: DataFrame, k: int = 10, min_similarity: float = 0.70, every: int = 20, id: str = "id", vector: str = "embedding", size: int = 128) -> DataFrame:
    """One row: queries, true_neighbours, missed, recall against brute force.

    The queries are all vectors whose id is divisible by ``every``; each is compared with every vector, in blocks,
    the queries going to the blocks (their number is counted before they are broadcast).
    """
    unit = cut(unit_vectors(rows, id, vector, size))
    asked = unit.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // 4096))
    found = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about 4096 vectors
        q_ids, q = part["id"].to_numpy(), _matrix(part["v"], size)

        def scan(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray = q_ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
                s = q @ x.T
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.empty((len(q), 0), np.int64)
                r, c = np.nonzero(np.take_along_axis(s, top, axis=1) >= min_similarity - 1e-6)
                yield pa.record_batch([pa.array(q_ids[r]), pa.array(ids[top[r, c]]), pa.array(s[r, top[r, c]].astype(np.float64))], ["id", "other", "similarity"])

        found.append(unit.mapInArrow(scan, "id long, other long, similarity double"))
    met = found[0]
    for x in found[1:]:
        met = met.unionByName(x)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    true = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "similarity")
    got = nearest(rows, k, min_similarity, id, vector, size).select("id", "other", F.col("similarity").alias("got")).where(F.col("id") % every == 0)
    # a neighbour as similar as the worst true one is as good
    worst = true.groupBy("id").agg(F.min("similarity").alias("worst"), F.count("*").alias("n"))
    good = got.join(worst, "id").where(F.col("got") >= F.col("worst") - 1e-6).groupBy("id").agg(F.count("*").alias("hits"))
    per = worst.join(good, "id", "left").select("n", F.least(F.coalesce("hits", F.lit(0)), F.col("n")).alias("hits"))
    return per.agg(F.count("*").alias("queries"), F.sum("n").alias("true_neighbours"), F.sum(F.col("n") - F.col("hits")).alias("missed"), (F.sum("hits") / F.sum("n")).alias("recall"))
