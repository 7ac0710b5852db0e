"""Exact nearest neighbours by blocked matrix products.

Scores of a block of queries and a batch of records are one matrix product, and only the
best ``k`` of a query ever leave a task; the lists of the tasks are merged at the end. A
batch of records is skipped for the queries whose ``k``-th best score is above anything
that the ball around the batch can hold, so a table laid out by topic is mostly skipped.

Few queries (``MEMORY_QUERIES`` rows, ``MEMORY_VALUES`` numbers) are sent to the records,
which are read in place without a shuffle. More are met block by block: a lecture, or
everything in a global search, is a grid of blocks of queries and blocks of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that are sent to the records: at most so many, with at most so many numbers in all (64 MB).
MEMORY_QUERIES, MEMORY_VALUES = 1 << 14, 1 << 23
#: Rows of a block of the grid.
QUERY_ROWS, RECORD_ROWS = 1 << 12, 1 << 18
#: Records scored at a time.
PRODUCT_ROWS = 1 << 12
PLACES = 9


def vectors_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of every vector; a null vector, or one with a null in it, has length -1."""
    size = np.asarray(col.value_lengths().fill_null(-1)).astype(np.int64)
    flat = col.flatten()
    if flat.null_count:
        bad = np.flatnonzero(np.asarray(flat.is_null()))
        ends = np.cumsum(np.maximum(size, 0))
        broken = np.unique(np.searchsorted(ends, bad, side="right"))
        keep = np.repeat(~np.isin(np.arange(len(size)), broken), np.maximum(size, 0))
        size[broken] = -1
        return np.asarray(flat.fill_null(0.0))[keep], size
    return np.asarray(flat), size


def by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, row numbers, matrix`` for every length of vector in a column."""
    flat, size = vectors_of(col)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for d in np.unique(size):
        if d > 0:
            rows = np.flatnonzero(size == d)
            yield int(d), rows, (flat if len(rows) == len(size) else flat[(start[rows, None] + np.arange(d)).ravel()]).reshape(-1, d)


class Best:
    """The best ``k`` records so far of a block of queries of one length."""

    def __init__(self, ids: list, matrix: np.ndarray, k: int, normalized: bool):
        self.ids, self.k, self.normalized = ids, k, normalized
        self.matrix = np.ascontiguousarray(matrix, dtype=float)
        self.length = np.sqrt((self.matrix ** 2).sum(1))
        self.bar = np.full(len(ids), -np.inf)  # the k-th best score
        self.found: list[list[tuple]] = [[] for _ in ids]  # (-score, record, lecture), best first

    def reachable(self, records: np.ndarray) -> np.ndarray:
        """Queries that some vector in the ball around ``records`` might still serve."""
        centre = records.mean(0)
        radius = np.sqrt(((records - centre) ** 2).sum(1).max())
        if self.normalized:
            most = self.matrix @ centre + self.length * radius
        else:
            most = -np.maximum(np.sqrt(((self.matrix - centre) ** 2).sum(1)) - radius, 0.0) ** 2
        slack = 10.0 ** -PLACES * 2 + 1e-12 * np.abs(most)  # scores are rounded, bounds are not exact
        return np.flatnonzero(most + slack >= self.bar)

    def add(self, ids: list, lectures: list, records: np.ndarray) -> None:
        for at in range(0, len(records), PRODUCT_ROWS):
            part = records[at:at + PRODUCT_ROWS]
            todo = self.reachable(part)
            if not len(todo):
                continue
            q = self.matrix[todo]
            scores = q @ part.T
            if not self.normalized:
                scores = -np.maximum((q ** 2).sum(1)[:, None] + (part ** 2).sum(1) - 2 * scores, 0.0)
            # Nine places, so that equal vectors tie whatever the order of the summation.
            scores = np.round(scores, PLACES) + 0.0
            take = min(self.k, len(part))
            floor = np.maximum(np.partition(scores, -take, axis=1)[:, -take], self.bar[todo])
            for j in np.flatnonzero(scores.max(1) >= self.bar[todo]):
                hits = np.flatnonzero(scores[j] >= floor[j])
                rows = self.found[todo[j]] + [(-scores[j, h], ids[at + h], lectures[at + h]) for h in hits]
                rows.sort(key=lambda r: r[:2])
                del rows[self.k:]
                self.found[todo[j]] = rows
                if len(rows) == self.k:
                    self.bar[todo[j]] = -rows[-1][0]

    def rows(self) -> Iterator[list[list]]:
        """Columns ``query, lecture, record, score``, some queries at a time."""
        for at in range(0, len(self.ids), 256):
            got = [(q, lecture, r, -s) for q, f in zip(self.ids[at:at + 256], self.found[at:at + 256]) for s, r, lecture in f]
            yield [list(c) for c in zip(*got)] if got else [[], [], [], []]


def query_blocks(table: pa.Table, scoped: bool, k: int, normalized: bool) -> dict[tuple, Best]:
    """Queries by lecture (if the search keeps to it) and length of their vectors."""
    out: dict[tuple, list] = {}
    ids, lectures = table.column("query_id").to_pylist(), table.column("lecture_key").to_pylist()
    col = table.column("embedding").combine_chunks()
    for d, rows, matrix in by_length(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col):
        keys = [lectures[r] if scoped else None for r in rows]
        for key in dict.fromkeys(keys):
            if key is not None or not scoped:
                own = [i for i, x in enumerate(keys) if x == key]
                out[key, d] = Best([ids[rows[i]] for i in own], matrix[own], k, normalized)
    return out


def feed(blocks: dict[tuple, Best], scoped: bool, lectures: pa.Array, ids: pa.Array, vectors: pa.Array) -> None:
    """Score a batch of records against the queries of their lectures."""
    names, records = lectures.to_pylist(), ids.to_pylist()
    for d, rows, matrix in by_length(vectors):
        groups: dict = {}
        if scoped:
            for i, r in enumerate(rows):
                if (names[r], d) in blocks:
                    groups.setdefault(names[r], []).append(i)
        elif (None, d) in blocks:
            groups[None] = range(len(rows))
        for key, own in groups.items():
            part = matrix if len(own) == len(rows) else matrix[own]
            blocks[key, d].add([records[rows[i]] for i in own], [names[rows[i]] for i in own], part)


def nearest(queries: DataFrame, records: DataFrame, top_k: int, scoped: bool, normalized: bool) -> DataFrame:
    """``query_id, lecture_key, rec_id, score, rank``, the best ``top_k`` records of every query.

    Rows with a null vector, and pairs of vectors of different lengths, are no pairs; neither
    is a null lecture within lectures. An id that repeats is searched, or found, once a row.
    """
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    q = queries.select("query_id", "lecture_key", as_double)
    r = records.select("lecture_key", "rec_id", as_double)
    out = T.StructType([q.schema["query_id"], r.schema["lecture_key"], r.schema["rec_id"], T.StructField("score", T.DoubleType())])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    few = q.limit(MEMORY_QUERIES + 1).toArrow()
    values = few.column("embedding").combine_chunks()
    if len(few) <= MEMORY_QUERIES and len(values.flatten()) <= MEMORY_VALUES:
        lists = sent_to_records(few, r, out, top_k, scoped, normalized)
    else:
        lists = met_in_grid(q, r, out, top_k, scoped, normalized)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= top_k)


def batch_maker(out: T.StructType):
    types, names = [to_arrow_type(f.dataType) for f in out], out.fieldNames()
    return lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def sent_to_records(few: pa.Table, records: DataFrame, out: T.StructType, k: int, scoped: bool, normalized: bool) -> DataFrame:
    make = batch_maker(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = query_blocks(few, scoped, k, normalized)
        for b in batches:
            feed(blocks, scoped, b.column(0), b.column(1), b.column(2))
        for best in blocks.values():
            yield from map(make, best.rows())

    return records.mapInArrow(run, out)


def met_in_grid(q: DataFrame, r: DataFrame, out: T.StructType, k: int, scoped: bool, normalized: bool) -> DataFrame:
    """Blocks of queries and of records meet in cells; a cell reads its queries, then streams its records.

    A cell holds some ``QUERY_ROWS`` queries; how many records it streams bounds its time, not its memory.
    """
    key = F.col("lecture_key") if scoped else F.lit("")

    def sizes(df: DataFrame, rows: int, name: str) -> DataFrame:
        n = df.where("embedding IS NOT NULL").groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
        return n.select("_g", F.ceil(F.col("_c") / F.lit(rows)).alias(name))

    grid = sizes(q, QUERY_ROWS, "_nq").join(sizes(r, RECORD_ROWS, "_nr"), "_g")
    if scoped:
        # Lectures that one cell does not hold are few: at most rows / block of each side.
        several = grid.where("_nq > 1 OR _nr > 1")
        q, r = (df.withColumn("_g", key).join(several, "_g", "left").na.fill(1, ["_nq", "_nr"]) for df in (q, r))
    else:
        n = grid.first()
        nq, nr = (n["_nq"], n["_nr"]) if n else (1, 1)
        q, r = (df.withColumns({"_g": key, "_nq": F.lit(nq), "_nr": F.lit(nr)}) for df in (q, r))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))

    # A seed of its own, so that the cell of a row is not tied to the partition that it comes from.
    q = q.select("_g", F.pmod(F.xxhash64("query_id", F.lit("cell")), F.col("_nq").cast("long")).alias("_cq"), every("_nr").alias("_cr"),
                 F.lit(0).alias("_side"), "query_id", "lecture_key", F.lit(None).cast(out["rec_id"].dataType).alias("rec_id"), "embedding")
    r = r.withColumn("_cr", F.pmod(F.xxhash64("rec_id", F.lit("cell")), F.col("_nr").cast("long")))
    r = r.select("_g", every("_nq").alias("_cq"), "_cr", F.lit(1).alias("_side"),
                 F.lit(None).cast(out["query_id"].dataType).alias("query_id"), "lecture_key", "rec_id", "embedding")
    cells = q.unionByName(r).repartition("_g", "_cq", "_cr").sortWithinPartitions("_g", "_cq", "_cr", "_side")
    make = batch_maker(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, blocks = None, [], None

        def done():
            for best in (blocks or {}).values():
                yield from map(make, best.rows())

        for b in batches:
            marks = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]] + [len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                part, mark = b.slice(lo, hi - lo), marks[lo]
                if mark[:3] != cell:
                    yield from done()
                    cell, waiting, blocks = mark[:3], [], None
                if mark[3] == 0:
                    waiting.append(part.select(["query_id", "lecture_key", "embedding"]))
                elif waiting or blocks:
                    if blocks is None:
                        blocks, waiting = query_blocks(pa.Table.from_batches(waiting), scoped, k, normalized), []
                    feed(blocks, scoped, part.column("lecture_key"), part.column("rec_id"), part.column("embedding"))
        yield from done()

    return cells.mapInArrow(run, out)
