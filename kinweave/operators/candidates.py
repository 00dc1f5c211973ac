"""Candidate entities of a query vector: the exact k nearest of a pool, by cells and the triangle inequality.

Each vector of the pool belongs to the nearest of a few pivots.  A task holds a span of the pool
and lets queries stream past it, each through the cells that are near it first; the distance of
its k-th partner so far bounds the rest: a cell is left out if its pivot is farther than that
bound and the cell's radius together, or if the plane between its pivot and the query's own is
farther than the bound.  Both rules are exact.  Products in single precision with their error
bound leave out the rest, double precision decides.  A pool of one span needs no shuffle of
partners: the rows of a query leave one task together, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Partners kept of a query; vectors of the pool for each pivot; the most pivots of a group, all of which each task holds; vectors of a cell that are compared at once.
TOP_K, CELL, MOST_PIVOTS, BLOCK = 200, 2048, 4096, 4096
#: Bytes of vectors of the pool that a task holds (as much again in single precision); queries searched at once; queries of a task, or fewer where that gives SPREAD tasks a group.
SPAN, CHUNK, QUERIES, SPREAD = 1 << 27, 1024, 1 << 15, 6
#: Slack of distances, for the rounding of their sums.
SLACK = 1e-6


def live_pool(entities: DataFrame, vector: str, nature: str | None = None, *more: str) -> DataFrame:
    """entity_id, nature, vector, ``more`` of the entities that can be linked: with a vector, not merged away, not deprecated."""
    pool = entities.where(F.col(vector).isNotNull() & F.coalesce(F.trim("canonical_entity_id"), F.lit("")).eqNullSafe("") & (F.coalesce("status", F.lit("")) != "deprecated"))
    return (pool.where(F.col("entity_nature") == nature) if nature else pool).select("entity_id", "entity_nature", F.col(vector).alias("vector"), *more)


def excluding(pool: DataFrame, excluded: DataFrame) -> DataFrame:
    return pool.join(excluded.select("entity_id"), "entity_id", "left_anti")


def _vectors(df: DataFrame, key: str, group: str | None, dim: int | None, more: tuple[str, ...]) -> DataFrame:
    """id, grp, n, raw, more: the usable vectors as bytes, single or double as they are, with their group, length and a struct of ``more`` columns."""
    kind = np.float32 if df.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0] if dim is None else lengths[lengths == dim]):
                rows = np.flatnonzero(lengths == n)
                v = batch.column(2).take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                length = np.linalg.norm(v, axis=1)
                good = np.isfinite(length) & (length > 0)
                at = pa.array(rows[good])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(at), n), pa.int32()), pa.array([u.tobytes() for u in v[good].astype(kind)], pa.binary()), batch.column(3).take(at)], names=["id", "grp", "n", "raw", "more"])

    rows = df.where("vector is not null").select(F.col(key).cast("string").alias("id"), (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")).alias("grp"), "vector", F.struct(F.lit(0).alias("_"), *more).alias("more"))
    return rows.mapInArrow(run, f"id string, grp string, n int, raw binary, more {rows.schema['more'].dataType.simpleString()}")


def _raw(vectors: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    values = vectors.to_pylist()
    joined = b"".join(values)
    return np.frombuffer(joined, np.float32 if len(joined) == 4 * n * len(values) else np.float64).reshape(len(values), n)


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _far(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0))


class _Cells:
    """The pivots of each group and length of vectors, and what is known of their cells; cells are numbered over all of them."""

    def __init__(self, pivots: dict[tuple[str, int], np.ndarray]):
        self.pivots, self.first, at = pivots, {}, 0
        for key in sorted(pivots):
            self.first[key] = at
            at += len(pivots[key])
        self.size, self.radius = np.zeros(at, np.int64), np.zeros(at)

    def home(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The rows of a batch that have a pool: row numbers, their cells, distances to the pivots of these."""
        keys = list(zip(batch.column("grp").to_pylist(), batch.column("n").to_pylist()))
        for key in sorted(set(keys) & set(self.pivots)):
            rows = np.array([i for i, k in enumerate(keys) if k == key])
            far = _far(_unit(_raw(batch.column("raw").take(pa.array(rows)), key[1])) @ self.pivots[key].T)
            yield rows, self.first[key] + far.argmin(axis=1), far.min(axis=1)

    def within(self, key: tuple[str, int], far: np.ndarray, cell: int, bound: np.ndarray) -> np.ndarray:
        """Whether a cell of ``key`` may hold a vector at most ``bound`` away from each row, given the distances to all pivots."""
        home, to, pivots = far.argmin(axis=1), far[:, cell], self.pivots[key]
        between = _far(pivots[home] @ pivots[cell])
        plane = np.divide(to**2 - far[np.arange(len(far)), home] ** 2, 2 * between, out=np.full(len(far), -1.0), where=between > SLACK)
        return np.maximum(to - self.radius[self.first[key] + cell], plane) <= bound + SLACK


def _cells(pool: DataFrame, sizes: dict[tuple[str, int], int], cell: int, most: int) -> _Cells:
    """The cells of the groups of a pool that ``sizes`` has."""
    pivots = {}
    for (grp, n), size in sizes.items():
        chosen = pool.where((F.col("grp") == grp) & (F.col("n") == n)).select("raw").orderBy(F.xxhash64("id"), "id").limit(int(min(most, -(-size // cell))))
        pivots[grp, n] = _unit(_raw(pa.array([bytes(x[0]) for x in chosen.collect()]), n))
    cells = _Cells(pivots)
    shared = pool.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, home, far in shared.value.home(batch):
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(far)], names=["cell", "far"])

    for r in pool.mapInArrow(run, "cell int, far double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # no more rows than there are pivots
        cells.size[r["cell"]], cells.radius[r["cell"]] = r["n"], r["far"]
    return cells


class _Span:
    """A span of a group's pool, held by a task, by cells; of equal cosines those of smaller ids come first."""

    def __init__(self, pool: pa.Table, key: tuple[str, int], cells: _Cells):
        self.key, self.cells = key, cells
        pool = pool.take(pa.compute.sort_indices(pool.column("id")))
        raw = _raw(pool.column("raw"), key[1])
        self.ids, self.more = pool.column("id").combine_chunks(), pool.column("facts").combine_chunks()
        steps = range(0, len(raw), BLOCK)
        home = np.concatenate([_far(_unit(raw[i : i + BLOCK]) @ cells.pivots[key].T).argmin(axis=1) for i in steps])
        self.place = np.argsort(home, kind="stable")  # of each row its place in the order of ids
        self.raw = raw[self.place]
        self.single = np.concatenate([_unit(self.raw[i : i + BLOCK]).astype(np.float32) for i in steps])
        found, first = np.unique(home[self.place], return_index=True)
        self.bounds = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(raw)])))
        #: Twice the bound of the error of a product in single precision.
        self.slack = np.float32(2 * (key[1] + 8) * 2.0**-23)

    def cosines(self, unit: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", unit[row[i : i + (1 << 16)]], _unit(self.raw[at[i : i + (1 << 16)]])) for i in range(0, len(row), 1 << 16)]
        return np.round(np.concatenate([np.empty(0), *parts]), 12)

    def best(self, unit: np.ndarray, k: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pairs by row, cosine and id, their ranks, of those that are among the k nearest, and their cosines."""
        cos = self.cosines(unit, row, at)
        order = np.lexsort((self.place[at], -cos, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        return order[rank < k], rank[rank < k] + 1, cos[order[rank < k]], order

    def search(self, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places by id, cosines and ranks of the k nearest to each of the unit vectors."""
        single, far = unit.astype(np.float32), _far(unit @ self.cells.pivots[self.key].T)
        least = np.full(len(unit), -np.inf, np.float32)  # below it nothing is among the k nearest
        held, fresh = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))], 0
        average = far.mean(axis=0)

        def settle() -> None:
            nonlocal fresh
            row, at, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((-s, row))
            row, at, s = row[order], at[order], s[order]
            start = np.searchsorted(row, np.arange(len(unit)))
            full = np.flatnonzero(np.diff([*start, len(row)]) >= k)
            least[full] = np.maximum(least[full], s[start[full] + k - 1] - self.slack)
            keep = s >= least[row]
            row, at, s = row[keep], at[keep], s[keep]
            if len(row) > 4 * k * len(unit):  # many at one distance
                some = self.best(unit, k, row, at)[0]
                row, at, s = row[some], at[some], s[some]
            held[:], fresh = [(row, at, s)], 0

        for cell in sorted(self.bounds, key=lambda c: average[c]):
            bound = np.where(np.isfinite(least), _far(np.where(np.isfinite(least), least, 0).astype(np.float64)), np.inf)
            rows = np.flatnonzero(self.cells.within(self.key, far, cell, bound))
            first, end = self.bounds[cell]
            for a in range(first, end, BLOCK) if len(rows) else ():
                s = single[rows] @ self.single[a : min(a + BLOCK, end)].T
                limit = least[rows]
                if s.shape[1] > k and not np.isfinite(limit).all():
                    limit = np.maximum(limit, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - self.slack)
                    least[rows] = limit
                row, col = np.divmod(np.flatnonzero(s >= limit[:, None]), s.shape[1])
                held.append((rows[row], a + col, s[row, col]))
                fresh += len(row)
                if fresh > k * len(unit):
                    settle()
        settle()
        row, at, _ = held[0]
        some, rank, cos, _ = self.best(unit, k, row, at)
        return row[some], self.place[at[some]], cos, rank


def _searched(asked: DataFrame, held: DataFrame, cells: _Cells, plan: list[tuple[str, int, int, int]], k: int) -> DataFrame:
    """query_id, entity_id, cosine, rank, asked, facts: the k nearest of each span of a group to each of its queries, by ``plan`` (group, length, turns, spans)."""
    spark = asked.sparkSession
    keys, shared, rows, tasks = [p[:2] for p in plan], spark.sparkContext.broadcast(cells), [], 0
    for i, (grp, n, turns, spans) in enumerate(plan):
        rows.append((grp, n, i, tasks, turns, spans))
        tasks += turns * spans
    dealt = F.broadcast(spark.createDataFrame(rows, "grp string, n int, place int, start int, turns int, spans int"))
    deal = lambda c, n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(c)
    each = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    kinds = [df.schema["more"].dataType.simpleString() for df in (asked, held)]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, cell, _ in shared.value.home(batch):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    near = asked.mapInArrow(home, f"id string, grp string, n int, raw binary, more {kinds[0]}, cell int")
    own = held.join(dealt, ["grp", "n"]).select("place", "start", "spans", deal("span", "spans"), each("turn", "turns"), F.lit(0).alias("cell"), F.lit(0).alias("asks"), "id", "raw", F.lit(None).cast(kinds[0]).alias("asked"), F.col("more").alias("facts"))
    guests = near.join(dealt, ["grp", "n"]).select("place", "start", "spans", each("span", "spans"), deal("turn", "turns"), "cell", F.lit(1).alias("asks"), "id", "raw", F.col("more").alias("asked"), F.lit(None).cast(kinds[1]).alias("facts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(rows: list[pa.RecordBatch], span: _Span) -> Iterator[pa.RecordBatch]:
            queries = pa.Table.from_batches(rows).combine_chunks()
            ids, more = queries.column("id").combine_chunks(), queries.column("asked").combine_chunks()
            row, place, cos, rank = span.search(_unit(_raw(queries.column("raw"), span.key[1])), k)
            for i in range(0, queries.num_rows, 64):
                a, b = np.searchsorted(row, (i, i + 64))
                r, p = pa.array(row[a:b]), pa.array(place[a:b])
                yield pa.RecordBatch.from_arrays([ids.take(r), span.ids.take(p), pa.array(cos[a:b]), pa.array(rank[a:b], pa.int32()), more.take(r), span.more.take(p)], names=["query_id", "entity_id", "cosine", "rank", "asked", "facts"])

        task, pool, span, waiting, count = None, [], None, [], 0
        for batch in batches:
            spots = np.stack([batch.column(c).to_numpy() for c in ("task", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1), len(spots)] if len(spots) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if spots[a][0] != task:
                    if waiting:
                        yield from answers(waiting, span)
                    task, pool, span, waiting, count = spots[a][0], [], None, [], 0
                if spots[a][1] == 0:
                    pool.append(batch.slice(a, b - a))
                    continue
                if span is None and not pool:
                    continue
                if span is None:  # the queries come after all of the span's vectors
                    span, pool = _Span(pa.Table.from_batches(pool), keys[batch.column("place")[a].as_py()], shared.value), []
                while a < b:
                    some = min(b - a, CHUNK - count)
                    waiting.append(batch.slice(a, some))
                    a, count = a + some, count + some
                    if count == CHUNK:
                        yield from answers(waiting, span)
                        waiting, count = [], 0
        if waiting:
            yield from answers(waiting, span)

    placed = own.unionByName(guests).withColumn("task", (F.col("start") + F.col("turn") * F.col("spans") + F.col("span")).cast("int"))
    placed = placed.drop("start", "spans", "span", "turn").repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "asks", "cell")
    return placed.mapInArrow(run, f"query_id string, entity_id string, cosine double, rank int, asked {kinds[0]}, facts {kinds[1]}")


def nearest(queries: DataFrame, pool: DataFrame, k: int = TOP_K, dim: int | None = None, group: str | None = None, scratch: Scratch | None = None, cell: int = CELL, most: int = MOST_PIVOTS, asked: tuple[str, ...] = (), facts: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """query_id, entity_id, cosine, rank, and the columns ``asked`` and ``facts``: the k entities of ``pool`` (entity_id, vector, facts) nearest to each query (query_id, vector, asked).

    With ``group``, a column of both sides, only within a group.  The cosine is the plain one; ties
    go to the smaller id.  Vectors of another length than ``dim`` (if given, else than the
    partner's), with NULLs, or zero match nothing.  Query ids are unique.  The rows of a query lie
    together in one partition, and no shuffle moves them but where a group's pool takes several spans.
    """
    scratch = scratch or Scratch(queries.sparkSession, "candidates")
    mine, held = scratch.save(_vectors(queries, "query_id", group, dim, asked), "queries"), scratch.save(_vectors(pool, "entity_id", group, dim, facts), "pool")
    counts = [{(r["grp"], r["n"]): r["count"] for r in df.groupBy("grp", "n").count().collect()} for df in (mine, held)]
    both = {key: counts[1][key] for key in sorted(counts[0].keys() & counts[1].keys())}
    double = pool.schema["vector"].dataType.elementType.simpleString() != "float"
    plan = [(*key, int(max(-(-counts[0][key] // QUERIES), min(SPREAD, -(-counts[0][key] // CHUNK)))), int(-(-size * key[1] * (8 if double else 4) // span))) for key, size in both.items()]
    flat = lambda df: df.select("query_id", "entity_id", "cosine", "rank", *(F.col("asked")[c].alias(c) for c in asked), *(F.col("facts")[c].alias(c) for c in facts))
    if not plan:
        none = queries.limit(0).select(F.lit("").alias("query_id"), F.lit("").alias("entity_id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"), *asked)
        return none.crossJoin(pool.limit(0).select(*facts)) if facts else none
    found = _searched(mine, held, _cells(held, both, cell, most), plan, k)
    if max(p[3] for p in plan) > 1:
        order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "entity_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return flat(found)
