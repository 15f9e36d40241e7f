"""Approximate vector search: cells of a coarse quantizer with residual codes, stored as Parquet by cell.

Building: centroids and the codebooks of the residuals are fitted on a sample of at most SAMPLE vectors and SAMPLE_BYTES;
every vector is then given the cell of its nearest centroid and a code, one byte for each WIDTH dimensions of what is left.
Cells are folders of Parquet files; adaptive execution splits the files of a large cell, so no task writes a whole one.

Searching: a query asks the cells of its nearest centroids. Only the folders of cells that some query asks are read, and
of them the ids and codes, not the vectors; filters on other columns reach the files. A query that has fewer than
ef survivors goes on with as many cells again, twice as many each time, until it has them or has asked all cells, so
filters never cost rows. The vectors of the ef best are then read and scored exactly. How many cells are asked first is
measured when the index is built: so many that they hold RECALL of the nearest vectors of rows of the sample within the
sample. Vectors without clusters need a large share of the cells; the sample shows that, and recall is kept.

Exact searching: a row keeps how far its vector is from what its code stands for, a cell how far its rows are from its
centroid. Both bound a cosine from above and below, so the k-th best lower bound among the cells asked first tells which
cells and which rows can still be among the first k. These, however many they are, are scored by their vectors.

A task holds the best ef of each query of a block and one tile of scores, and gives no more than that.

The model is bounded (CELLS centroids, 256 code words a byte) and held on the driver; queries come in blocks of BLOCK.
Vectors of length zero are in the index and score 0. Null vectors are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.shared import shared_folder
from .search import BLOCK, CANDIDATES, Best, _sides, tiles, top

#: Vectors that the model is fitted on, and their bytes; cells; dimensions that one byte of a code stands for.
SAMPLE, SAMPLE_BYTES, CELLS, WIDTH = 65_536, 64 << 20, 4096, 2
#: Survivors whose vectors are read for each query; share of the nearest vectors that the cells asked first should hold.
EF, RECALL = 200, 0.95
STEPS = 12
#: What bounds of cosines are widened by, for sums in 32 bits.
SLACK = 1e-4


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The center at the least distance from each row, 4,096 rows at a time."""
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - rows[k : k + 4096] @ centers.T, axis=1) for k in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


def _centers(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n centers of rows by Lloyd's steps; one that loses all rows takes a row of its own."""
    rng = np.random.default_rng(seed)
    centers = rows[rng.choice(len(rows), n, replace=len(rows) < n)].copy()
    for _ in range(STEPS):
        at = _nearest(rows, centers)
        count = np.bincount(at, minlength=n)
        sums, some = np.zeros((n, rows.shape[1])), count > 0
        sums[some] = np.add.reduceat(rows[np.argsort(at, kind="stable")].astype(np.float64), (np.cumsum(count) - count)[some])
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rows[rng.integers(len(rows), size=n)])
    return centers.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))[:, None]
    return np.divide(rows, norms, out=np.zeros(rows.shape, np.float64), where=norms > 0).astype(np.float32)


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    if set(lists.value_lengths().to_pylist()) - {dimension}:
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


@dataclass
class Model:
    """centroids: cells x dimension; codebooks: bytes of a code x words x WIDTH; sizes: rows of each cell; probes: cells to ask first; radii: the farthest row of each cell."""

    centroids: np.ndarray
    codebooks: np.ndarray
    sizes: np.ndarray
    probes: int = 1
    radii: np.ndarray | None = None

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def _parts(self, rows: np.ndarray) -> np.ndarray:
        n = self.codebooks.shape[0]
        return np.pad(rows, ((0, 0), (0, n * WIDTH - self.dimension))).reshape(len(rows), n, WIDTH)

    def encoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The cell and the code of each row, how far it is from its centroid and from what the code stands for."""
        cell = _nearest(unit, self.centroids)
        parts = self._parts(unit - self.centroids[cell])
        codes = np.stack([_nearest(parts[:, k], words) for k, words in enumerate(self.codebooks)], axis=1).astype(np.uint8)
        return cell, codes, np.linalg.norm(unit - self.centroids[cell], axis=1), np.linalg.norm(unit - self.decoded(cell, codes), axis=1)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        words = self.codebooks[np.arange(codes.shape[1]), codes]
        return self.centroids[cell] + words.reshape(len(codes), -1)[:, : self.dimension]


def _sample(vectors: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE unit vectors by a hash of their ids; n: rows of vectors."""
    first = vectors.select(F.size("embedding").alias("d")).first()
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (4 * first["d"])))
    some = vectors if n <= most else vectors.where(F.pmod(F.xxhash64("file_id"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 1.1 * most / n)))
    lists = some.select(F.col("embedding").cast("array<float>").alias("embedding")).limit(most).toArrow().column(0).combine_chunks()
    return _unit(_matrix(lists, first["d"]))


def _fitted(sample: np.ndarray, cells: int) -> Model:
    centroids = _centers(sample, cells)
    bytes_of_code = -(-sample.shape[1] // WIDTH)
    model = Model(centroids, np.zeros((bytes_of_code, 1, WIDTH), np.float32), np.zeros(cells, np.int64))
    rest = model._parts(sample - centroids[_nearest(sample, centroids)])
    model.codebooks = np.stack([_centers(rest[:, k], min(256, len(rest)), k + 1) for k in range(bytes_of_code)])
    model.probes = _probes(sample, centroids)
    return model


def _probes(sample: np.ndarray, centroids: np.ndarray, asked: int = 512, k: int = 10) -> int:
    """How many cells, nearest first, hold RECALL of the k nearest others of some rows of the sample."""
    some, k = sample[:asked], min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argsort(-(some @ sample.T), axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(-(some @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(sample, centroids)[near], axis=1)[:, 1:].ravel())
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


@dataclass
class VectorIndex:
    """An index in a folder: rows by cell, and the model beside them."""

    spark: SparkSession
    path: str
    model: Model
    ef: int = EF

    def rows(self) -> DataFrame:
        """All rows of the index: the columns it was built of, with cell and code."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, rows: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        """(query_id, file_id, score, rank) among rows, which are rows() or a part of them that filters leave."""
        return self.searched(rows, queries, k)[0]

    def exact(self, rows: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        """The same without any of the k nearest missed."""
        return self.searched(rows, queries, k, exact=True)[0]

    def searched(self, rows: DataFrame, queries: DataFrame, k: int = CANDIDATES, exact: bool = False) -> tuple[DataFrame, DataFrame]:
        """What search() or exact() gives, and (query_id, cells, rows): how many cells each query asked and how many rows they hold."""
        ship(self.spark)
        d, q = _sides(rows, queries.where("vector is not null"))
        q = q.select("query_id", "project", "vector")
        kind = q.schema["query_id"].dataType.simpleString()
        blocks = max(1, -(-q.count() // BLOCK))
        asked = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        found, told = [], []
        for n in range(blocks):
            best, cost = self._block(d, asked.where(F.col("_block") == n).drop("_block").collect(), k, exact)
            found.append(best)
            told += cost
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return top(every.withColumn("query_id", F.col("query_id").cast(kind)), k), self.spark.createDataFrame(told, f"query_id {kind}, cells long, rows long")

    def _block(self, rows: DataFrame, queries: list, k: int, exact: bool) -> tuple[DataFrame, list[tuple]]:
        """(query_id, file_id, score) by vectors of those that can be among the first k, and what each query cost."""
        if any(len(r["vector"]) != self.model.dimension for r in queries):
            raise ValueError("vectors differ in length")
        nothing = self.spark.createDataFrame([], "q int, file_id long, cell int, near double")
        if not queries:
            return nothing.select(F.col("q").cast("long").alias("query_id"), "file_id", F.col("near").alias("score")), []
        most, weight = (k, -1) if exact else (max(self.ef, k), 0)
        unit, projects = _unit(np.array([r["vector"] for r in queries], np.float64)), [r["project"] for r in queries]
        likeness = unit @ self.model.centroids.T
        order = np.argsort(-likeness, axis=1, kind="stable").astype(np.int32)
        cells = order.shape[1]
        least, asked = 0, min(self.model.probes, cells)
        open_, upto, candidates = np.arange(len(unit)), np.zeros(len(unit), np.int64), None
        while len(open_):
            wanted = np.zeros((len(unit), cells), bool)
            wanted[open_[:, None], order[open_, least:asked]] = True
            near = self._kept(top(self._near(rows, unit, projects, wanted, weight, most), most, "near", "q").drop("rank"))
            candidates = near if candidates is None else candidates.unionByName(near)
            upto[open_] = asked
            got = np.zeros(len(unit), np.int64)
            for row in candidates.groupBy("q").count().collect():
                got[row["q"]] = row["count"]
            open_ = np.flatnonzero(got < most) if asked < cells else open_[:0]
            least, asked = asked, min(2 * asked, cells)
        best = top(candidates, most, "near", "q").select("q", "file_id", "cell", "near", "rank")
        wanted = np.zeros((len(unit), cells), bool)
        if exact:
            floor = np.full(len(unit), -np.inf)
            for row in best.where(F.col("rank") == k).collect():
                floor[row["q"]] = row["near"] - SLACK
            wanted = likeness + self.model.radii >= floor[:, None]
            best = self._kept(self._near(rows, unit, projects, wanted, 1, floor=floor))
        else:
            for i, n in enumerate(upto):
                wanted[i, order[i, :n]] = True
        cost = [(r["query_id"], int(w.sum()), int(self.model.sizes[w].sum())) for r, w in zip(queries, wanted, strict=True)]
        return self._scored(rows, best.select("q", "file_id", "cell"), queries, np.flatnonzero(wanted.any(axis=0)).tolist()), cost

    def _kept(self, near: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "near")
        near.write.parquet(path)
        return self.spark.read.schema(near.schema).parquet(path)

    def _near(self, rows: DataFrame, unit: np.ndarray, projects: list[str], wanted: np.ndarray, weight: int, most: int = 0, floor: np.ndarray | None = None) -> DataFrame:
        """(q, file_id, cell, near) of the cells that each query asks (wanted, queries x cells), by codes: the most best of each
        task, or all from floor on. near: the cosine with what the code stands for, and weight times the distance from it."""
        model, code_of = self.model, {p: n for n, p in enumerate(dict.fromkeys(projects))}
        bytes_of_code, own = model.codebooks.shape[0], np.array([code_of[p] for p in projects])
        askers = np.packbits(wanted.T, axis=1)

        def told(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for n in range(0, len(columns[0]) if columns else 0, 1 << 16):
                part = [c[n : n + (1 << 16)] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(part[k].astype(t)) for k, t in ((0, np.int32), (1, np.int64), (3, np.int32), (2, np.float64))], names=["q", "file_id", "cell", "near"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(unit), most)
            least = best.least if floor is None else floor
            for batch in batches:
                files, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                owners = np.array([code_of.get(p, -1) for p in batch.column(2).to_pylist()])
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, bytes_of_code)
                far = weight * batch.column(4).to_numpy()
                for cell in np.unique(cells):
                    of_cell = np.flatnonzero(np.unpackbits(askers[cell], count=len(unit)))
                    here = np.flatnonzero(cells == cell) if len(of_cell) else of_cell
                    for project in np.unique(owners[here]):
                        q, at = of_cell[own[of_cell] == project], here[owners[here] == project]
                        for part in tiles(len(at) if len(q) else 0):
                            rows = at[part]
                            decoded = model.decoded(cells[rows], codes[rows]).T
                            for some in tiles(len(q)):
                                scores = unit[q[some]] @ decoded + far[rows]
                                i, j = np.nonzero(scores >= least[q[some]][:, None])
                                found = [q[some][i].astype(np.int32), files[rows[j]], scores[i, j], cells[rows[j]]]
                                if floor is None:
                                    best.put(*found)
                                else:
                                    yield from told(found)
            yield from told(best.cut())

        used = rows.where(F.col("cell").isin(np.flatnonzero(wanted.any(axis=0)).tolist())).select("file_id", "cell", "project", "code", "far")
        return used.mapInArrow(run, "q int, file_id long, cell int, near double")

    def _scored(self, rows: DataFrame, best: DataFrame, queries: list, cells: list[int]) -> DataFrame:
        """(query_id, file_id, score): cosines of the vectors of best, read from the cells that were asked only."""
        kind = "string" if isinstance(queries[0]["query_id"], str) else "long"
        given = self.spark.createDataFrame([(i, r["query_id"], [float(x) for x in r["vector"]]) for i, r in enumerate(queries)], f"q int, query_id {kind}, vector array<double>")
        few = best.groupBy("cell", "file_id").agg(F.collect_list("q").alias("asked"))  # at most a block of queries each
        met = rows.where(F.col("cell").isin(cells)).select("cell", "file_id", F.col("embedding").cast("array<double>").alias("embedding")).join(few, ["cell", "file_id"])
        met = met.select("file_id", "embedding", F.explode("asked").alias("q")).join(F.broadcast(given), "q")
        return met.select("query_id", "file_id", _cosine(F.col("embedding"), F.col("vector")).alias("score"))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Writes an index of vectors (file_id, embedding, and columns that filters may use) to a new folder.

    cells: by default the square root of the number of vectors, at most CELLS.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.where("embedding is not null")
    n = vectors.count()
    if not n:
        raise ValueError("no vector to index")
    model = _fitted(_sample(vectors, n), cells or max(1, min(CELLS, round(n**0.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes, out, far = model.encoded(_unit(_matrix(batch.column(batch.schema.get_field_index("embedding")), model.dimension)))
            raw = pa.Array.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw, pa.array(far.astype(np.float32)), pa.array(out.astype(np.float32)), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "code", "far", "out", "cell"])

    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
    placed = rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code binary, far float, out float, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    model.sizes, model.radii = np.zeros(len(model.centroids), np.int64), np.zeros(len(model.centroids), np.float32)
    for row in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("out").alias("out")).collect():
        model.sizes[row["cell"]], model.radii[row["cell"]] = row["n"], row["out"]
    told = [("cell", k, c.tolist(), int(s)) for k, (c, s) in enumerate(zip(model.centroids, model.sizes, strict=True))]
    told += [("code", k, words.ravel().tolist(), 0) for k, words in enumerate(model.codebooks)]
    told += [("probes", model.probes, [], 0), ("radii", 0, model.radii.tolist(), 0)]
    spark.createDataFrame(told, "kind string, number int, vector array<float>, rows long").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(spark, path, model)


def opened(spark: SparkSession, path: str, ef: int = EF) -> VectorIndex:
    """The index that build() wrote to path."""
    told = spark.read.parquet(f"{path}/model").orderBy("number").collect()
    cells = [r for r in told if r["kind"] == "cell"]
    codes = np.array([np.reshape(r["vector"], (-1, WIDTH)) for r in told if r["kind"] == "code"], np.float32)
    probes = next(r["number"] for r in told if r["kind"] == "probes")
    radii = np.array(next(r["vector"] for r in told if r["kind"] == "radii"), np.float32)
    return VectorIndex(spark, path, Model(np.array([r["vector"] for r in cells], np.float32), codes, np.array([r["rows"] for r in cells], np.int64), probes, radii), ef)
