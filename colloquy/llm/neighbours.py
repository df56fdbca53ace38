"""Approximate nearest neighbours by cosine: an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own, trained
by k-means on a bounded sample; a pair of centroids is a cell, and every vector
is indexed in one.  A query takes the pairs in order of summed distance, from a
heap, until their cells hold a share of all vectors.  That share is calibrated
on the sample, against brute force, for the recall that is asked for: data
without structure needs a large share, clustered data a small one.  The entries
are reranked by exact cosine on the original vectors.

Cells are laid into blocks of about `block` vectors and a large cell is dealt to
several; queries are packed by their nearest cell and sent only to blocks that
one of them visits, where a matrix product ranks them: a block meets its packs
in a group, in several groups where there are very many queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import first_by_hash
from .storage import stage

ENTRY = "id long, cell int, query boolean, vector binary"
FOUND = "query_id long, vec_id long, score double"
TURN = 1 << 16  #: queries that meet a block of entries in one task


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors scaled by powers of two): those of `dims` finite components, not all zero."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(rows)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    top = np.abs(values).max(1, initial=0)
    good = np.isfinite(values).all(1) & (top > 0)
    values = values[good]
    return rows[good], np.ldexp(values, -np.frexp(top[good])[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(1)
        for c in range(len(centroids)):
            if (own := nearest == c).any():
                centroids[c] = x[own].mean(0)
    return centroids


@dataclass
class MultiIndex:
    dims: int
    books: tuple[np.ndarray, np.ndarray]
    share: float

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def halves(self, units: np.ndarray) -> list[np.ndarray]:
        cut = self.dims // 2
        return [_distances(h, b) for h, b in zip((units[:, :cut], units[:, cut:]), self.books, strict=True)]

    def cell(self, units: np.ndarray) -> np.ndarray:
        first, second = self.halves(units)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)

    def visits(self, units: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
        """(query, cell): whether the query visits the cell before it has seen `least` entries."""
        first, second = self.halves(units)
        out = np.zeros((len(units), self.cells), bool)
        n = len(self.books[1])
        for q in range(len(units)):
            a, b = np.argsort(first[q], kind="stable"), np.argsort(second[q], kind="stable")
            da, db = first[q][a], second[q][b]
            heap, seen = [(da[0] + db[0], 0, 0)], 0
            while heap and seen < least:
                _, i, j = heapq.heappop(heap)
                cell = a[i] * n + b[j]
                out[q, cell] = True
                seen += sizes[cell]
                if i + 1 < len(a):
                    heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
                if i == 0 and j + 1 < len(b):
                    heapq.heappush(heap, (da[0] + db[j + 1], 0, j + 1))
        return out


def fit(vectors: np.ndarray, dims: int, centroids: int, k: int, recall: float, queries: int = 200, seed: int = 5) -> MultiIndex:
    """Codebooks from a sample of usable vectors, and the share of entries at which `recall` of the sample's neighbours are found."""
    rng = np.random.default_rng(seed)
    units = unit(vectors)
    cut = dims // 2
    index = MultiIndex(dims, (_kmeans(units[:, :cut], centroids, 12, rng), _kmeans(units[:, cut:], centroids, 12, rng)), 1.0)
    asked = rng.choice(len(units), min(queries, len(units)), replace=False)
    near = units[asked] @ units.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, 1, kind="stable")[:, : min(k, len(units) - 1)]
    cell = index.cell(units)
    sizes = np.bincount(cell, minlength=index.cells)
    first, second = index.halves(units[asked])
    summed = (first[:, :, None] + second[:, None, :]).reshape(len(asked), -1)
    order = np.argsort(summed, 1, kind="stable")
    before = np.zeros_like(order)
    np.put_along_axis(before, order, np.cumsum(sizes[order], 1) - sizes[order], 1)
    needed = np.take_along_axis(before, cell[top], 1) / max(1, len(units))
    index.share = float(np.quantile(needed, recall)) if needed.size else 1.0
    return index


def _assigned(index: MultiIndex):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = usable(batch.column(2), index.dims)
            where = pa.array(rows)
            data = [v.tobytes() for v in vectors]
            cells = index.cell(unit(vectors)) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), pa.array(cells.astype(np.int32)), batch.column(1).take(where), pa.array(data, pa.binary())], ["id", "cell", "query", "vector"])

    return assign


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _laid_out(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: small cells in a row share a block, a large one has several to itself."""
    first, parts = np.zeros(len(sizes), np.int64), -(-sizes // block)
    number, room = -1, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > block:
            first[cell] = number + 1
            number, room = number + int(parts[cell]), 0
        elif n:
            if n > room:
                number, room = number + 1, block
            first[cell] = number
            room -= n
    return first, parts


def _cells_of(sizes: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """(block, 2): the first cell that a block has entries of, and the end of its cells, which lie in a row."""
    out = np.zeros((int((first + parts)[sizes > 0].max(initial=0)), 2), np.int64)
    for cell in np.flatnonzero(sizes)[::-1].tolist():
        own = out[first[cell] : first[cell] + parts[cell]]
        own[:, 0] = cell
        own[:, 1] = np.maximum(own[:, 1], cell + 1)
    return out


def _asking(index: MultiIndex, sizes: np.ndarray, first: np.ndarray, parts: np.ndarray, least: float, turns: int):
    """A pack of queries as a row for each block of entries that one of them visits, with which of the block's cells; cell c has the blocks from first[c] on, parts[c] of them."""
    cells = _cells_of(sizes, first, parts)

    def ask(group: pa.Table) -> pa.Table:
        ids, vectors = group.column("id").to_numpy(), _matrix(group.column("vector"), index.dims)
        visited = index.visits(unit(vectors), sizes, least)
        turn, out = sum(group.column("pack")[0].as_py().values()) % turns, []
        for block, (a, b) in enumerate(cells.tolist()):
            if (who := visited[:, a:b].any(1)).any():
                out.append((block, turn, ids[who].tobytes(), vectors[who].tobytes(), np.packbits(visited[who, a:b], axis=1).tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "turn", "q_ids", "q_vectors", "visited"])

    return ask


def _ranked(dims: int, k: int, cells: np.ndarray):
    def rank(packs: pa.Table, entries: pa.Table) -> pa.Table:
        """The k nearest of a block's entries to each query of all packs that visit it."""
        names, found = ["query_id", "vec_id", "score"], []
        if packs.num_rows and entries.num_rows:
            ids, own, vectors = entries.column("id").to_numpy(), entries.column("cell").to_numpy() - cells[entries.column("block")[0].as_py(), 0], _matrix(entries.column("vector"), dims)
            units = unit(vectors).T
        for row in packs.to_batches(max_chunksize=1) if entries.num_rows else []:
            q_ids, q_vectors, visited = (row.column(n)[0].as_buffer() for n in ("q_ids", "q_vectors", "visited"))
            asked, queries = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors, np.float64).reshape(-1, dims)
            seen = np.unpackbits(np.frombuffer(visited, np.uint8).reshape(len(asked), -1), axis=1)[:, own].view(bool)
            score = unit(queries) @ units
            score[~seen | (asked[:, None] == ids[None])] = -np.inf
            bound = np.partition(score, -k, 1)[:, -k] if len(ids) > k else np.full(len(asked), -np.inf)
            q, v = np.nonzero((score >= bound[:, None] - 1e-9) & np.isfinite(score))
            exact = (queries[q] * vectors[v]).sum(1) / (np.sqrt((queries[q] ** 2).sum(1)) * np.sqrt((vectors[v] ** 2).sum(1)))
            order = np.lexsort((ids[v], -exact, q))
            q, v, exact = q[order], v[order], exact[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append(pa.table([pa.array(asked[q[best]]), pa.array(ids[v[best]]), pa.array(exact[best])], names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)

    return rank


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.97,
    centroids: int | None = None, sample: int = 8192, block: int | None = None, pack: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every row for which `queries` holds.

    Candidates are all rows but those with the query's id; fewer than k of
    them are all returned.  Ties go to the smaller id.  Rows that share an id
    are candidates of their own, so an id can take several ranks; queries that
    share one are ranked together.  Each half has `centroids`, by default 32 or,
    for many rows, twice their fourth root, so that the vectors of a cell grow
    with the square root of the rows only; so does a `block`, as a query goes to
    every block that it visits.  The codebooks and the share to visit
    come from the `sample` vectors (64 a centroid at least) with the smallest id
    hashes; every vector is indexed.  Rows with a null id, and vectors that are null,
    zero, hold a null or non-finite component or have another number of
    components than most of the sample, take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL")
    n = vectors.count()
    centroids, block = centroids or max(32, round(2 * n**0.25)), block or max(2048, round(16 * n**0.5))
    sample = max(sample, 64 * centroids)
    taken = first_by_hash(rows.filter("vector IS NOT NULL"), "id", sample).select("vector").toArrow().column("vector").combine_chunks()
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(taken):
        return none
    lengths = np.array(taken.value_lengths())
    lengths = lengths[lengths > 1]
    dims = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    learnt = usable(taken, dims)[1] if dims else np.zeros((0, 0))
    if not len(learnt):
        return none
    index = fit(learnt, dims, centroids, k, recall)
    held = stage(rows.mapInArrow(_assigned(index), ENTRY), "vectors")
    sizes, asking = np.zeros(index.cells, np.int64), np.zeros(index.cells, np.int64)
    for r in held.df.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).collect():  # a row for each cell
        sizes[r.cell], asking[r.cell] = r.n, r.q
    least = max(index.share * sizes.sum(), k + 1)
    first, parts = _laid_out(sizes, block)  # numbers for each cell, of which there are as many as four times the root of the rows
    cells = np.flatnonzero(sizes)
    layout = vectors.sparkSession.createDataFrame(
        [(int(c), int(first[c]), int(parts[c]), max(1, -(-int(asking[c]) // pack))) for c in cells], "cell int, first long, parts int, packs int"
    )
    placed = held.df.join(F.broadcast(layout), "cell")  # a row for each cell, centroids ** 2 at most
    turns = max(1, -(-int(asking.sum()) // TURN))
    entries = placed.select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), "id", "cell", "vector")
    packed = placed.filter("query").withColumn("pack", F.struct("first", F.pmod(F.xxhash64("id", F.lit(1)), "packs").alias("part")))
    asked = packed.groupBy("pack").applyInArrow(_asking(index, sizes, first, parts, least, turns), "block long, turn long, q_ids binary, q_vectors binary, visited binary")
    # not a join: Spark takes what the queries become for as small as the queries, and would broadcast it through the driver
    found = asked.groupBy("block", "turn").cogroup(entries.groupBy("block", "turn")).applyInArrow(_ranked(dims, k, _cells_of(sizes, first, parts)), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
