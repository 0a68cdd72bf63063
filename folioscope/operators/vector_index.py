"""A written vector index: rows in cells around centroids, product-quantised residuals, exact distances at the end.

Centroids and codebooks are fitted on at most TRAIN rows; every row is indexed. A row lies in the folder of its nearest
centroid's cell, with its vector and a code of one byte per subspace for what the centroid leaves over. A search

1. finds each query's nearest cells, and reads the codes of these folders only (they are partitions of the table);
2. scores codes by products of the queries with what the codes stand for, keeps `rerank` times k a query, and
3. reads the vectors of these and takes exact distances, as vector_search does.

`exact=True` gives the same rows as the exact search: cells are read until none is left whose distance to the query, less
the cell's radius, is within the k-th distance found. Distances are between unit vectors for the cosine metric.

How many cells are probed and how many codes kept is measured on the sample when the index is built (`effort`): so many that
TARGET of its rows' neighbours are found. Vectors without clusters need many cells, clustered ones few.

Defined results: rows without a vector, or of length zero for the cosine, are not indexed; fewer rows than k give what
there is; ties go by chunk id; an empty table gives no rows. Queries come in blocks as in vector_search.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from folioscope.functions.vectors import DISTANCES, as_doubles, norm, similarity
from folioscope.operators.ranking import top_k
from folioscope.operators.vector_search import QUERY_BLOCK
from folioscope.sources.places import written

#: Rows that centroids and codebooks are fitted on, cells at most, codes of a subspace, steps of a fit.
TRAIN, CELLS_MOST, CODES, STEPS = 50_000, 4096, 256, 10
#: Share of neighbours that the probed cells, and the codes kept, are each to hold; rows of the sample that ask, and their neighbours.
TARGET, ASKING, NEIGHBOURS = 0.98, 200, 10
#: Floating-point room for bounds.
ROOM = 1e-7


def lloyd(x: np.ndarray, k: int, seed: int, steps: int = STEPS) -> np.ndarray:
    """k means of a bounded sample; an empty one moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    means = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near, far = nearest(x, means)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(means))
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
        for i, row in zip(np.flatnonzero(n == 0), np.argsort(-far, kind="stable")):
            means[i] = x[row]
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the number of its nearest mean and the distance; a product of matrices, 4096 rows at a time."""
    which, far = np.empty(len(x), np.int64), np.empty(len(x))
    square = (means**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = square - 2 * part @ means.T
        which[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = np.sqrt(((part - means[which[at : at + 4096]]) ** 2).sum(1))
    return which, far


def effort(x: np.ndarray, cell: np.ndarray, coded: np.ndarray, means: np.ndarray, n: int, seed: int) -> tuple[int, int]:
    """Cells to probe and codes to keep for each wanted row so that, in a sample of n rows, TARGET of the neighbours of some of its
    rows are found. In all n rows neighbours are nearer than in the sample, and so in nearer cells; more codes are nearer too."""
    near, place = [], []
    for i in np.random.default_rng(seed).choice(len(x), min(ASKING, len(x)), replace=False):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        own = np.argsort(d, kind="stable")[: min(NEIGHBOURS, len(x) - 1)]
        cells = np.empty(len(means), int)
        cells[np.argsort(((means - x[i]) ** 2).sum(1), kind="stable")] = np.arange(len(means))
        near += cells[cell[own]].tolist()
        by_code = ((coded - x[i]) ** 2).sum(1)
        place += [int((by_code < by_code[j]).sum()) for j in own]
    if not near:
        return 1, 1
    probes, kept = (int(np.quantile(v, TARGET, method="higher")) + 1 for v in (near, place))
    return probes, math.ceil(kept * max(1, n / len(x)) / NEIGHBOURS)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def _usable(chunks: DataFrame, metric: str) -> DataFrame:
    rows = chunks.select("chunk_id", "doc_id", as_doubles(F.col("embedding")).alias("embedding")).filter(F.col("embedding").isNotNull())
    return rows.filter(norm(F.col("embedding")) > 0) if metric == "cosine" else rows


def build(chunks: DataFrame, path: str, *, metric: str = "cosine", cells: int | None = None, subspaces: int = 32, seed: int = 7) -> VectorIndex:
    """Write the index of (chunk_id, doc_id, embedding) rows under path."""
    spark = chunks.sparkSession
    rows = written(_usable(chunks, metric), "vector-rows")
    n = rows.count()
    if not n:
        raise ValueError("there is no vector to index")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}
    some = rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // TRAIN))) == 0).limit(TRAIN)
    sample = _unit(np.array([r.embedding for r in some.select("embedding").collect()] or [rows.first().embedding], float), metric)
    width = sample.shape[1]
    cells = min(cells or max(1, round(math.sqrt(n))), CELLS_MOST, len(sample))
    means = lloyd(sample, cells, seed)
    subspaces = min(subspaces, width)
    edges = np.linspace(0, width, subspaces + 1).astype(int).tolist()
    own_cell = nearest(sample, means)[0]
    rest = sample - means[own_cell]
    parts = spark.createDataFrame([(m, rest[:, a:b].astype("<f8").tobytes()) for m, (a, b) in enumerate(zip(edges, edges[1:]))], "m int, flat binary").repartition(subspaces, "m")

    def fit(batches):
        for b in batches:
            for m, flat in zip(b.column("m").to_pylist(), b.column("flat").to_pylist()):
                own = np.frombuffer(flat, "<f8").reshape(-1, edges[m + 1] - edges[m])
                yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int32()), "book": pa.array([lloyd(own, CODES, seed + m).tobytes()], pa.binary())})

    books = [np.frombuffer(r.book, "<f8").reshape(-1, edges[r.m + 1] - edges[r.m]) for r in sorted(parts.mapInArrow(fit, "m int, book binary").collect())]

    said = np.concatenate([book[nearest(rest[:, a:z], book)[0]] for a, z, book in zip(edges, edges[1:], books)], 1)
    probes, rerank = effort(sample, own_cell, said + means[own_cell], means, n, seed)

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_vectors(b.column("embedding"), width), metric)
            cell, far = nearest(x, means)
            left = x - means[cell]
            codes = np.stack([nearest(left[:, a:z], book)[0] for a, z, book in zip(edges, edges[1:], books)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("chunk_id", "doc_id", "embedding")], pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype("i4"))], names=["chunk_id", "doc_id", "embedding", "far", "code", "cell"])

    schema = f"chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, embedding array<double>, far double, code binary, cell int"
    coded = written(rows.mapInArrow(encode, schema), "vector-coded")
    # dealt by range of cell and id: a cell with many rows is several files
    coded.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.partitionBy("cell").parquet(f"{path}/vectors")
    found = {r.cell: (r.n, r.far) for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    centers = [(i, m.tolist(), *found.get(i, (0, 0.0))) for i, m in enumerate(means)]
    spark.createDataFrame(centers, "cell int, center array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/centers")
    listed = [(m, i, c.tolist()) for m, book in enumerate(books) for i, c in enumerate(book)]
    spark.createDataFrame(listed, "m int, code int, center array<double>").coalesce(1).write.parquet(f"{path}/books")
    # written last: it says that the index is whole
    spark.createDataFrame([(json.dumps({"metric": metric, "width": width, "edges": edges, "probes": probes, "rerank": rerank} | kinds),)], "facts string").coalesce(1).write.parquet(f"{path}/facts")
    return VectorIndex(spark, path)


class VectorIndex:
    """A written index. Centers and codebooks (at most CELLS_MOST and CODES rows a subspace) are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()[0])
        self.metric, self.width, self.edges = facts["metric"], facts["width"], facts["edges"]
        # an index of an earlier form does not say them
        self.probes, self.rerank = facts.get("probes", 16), facts.get("rerank", 10)
        self.kinds = {c: facts[c] for c in ("chunk_id", "doc_id")}
        centers = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
        self.centers, self.sizes, self.radii = np.array([r.center for r in centers]), np.array([r.n for r in centers]), np.array([r.radius for r in centers])
        books = spark.read.parquet(f"{path}/books").orderBy("m", "code").collect()
        self.books = [np.array([r.center for r in books if r.m == m]) for m in range(len(self.edges) - 1)]

    def rows(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: other folders are not read."""
        schema = f"chunk_id {self.kinds['chunk_id']}, doc_id {self.kinds['doc_id']}, embedding array<double>, far double, code binary, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors").filter(F.col("cell").isin(cells))

    def _coded(self, asked: list, kind: DataType, cells_of: list[np.ndarray], keep: int) -> DataFrame:
        """(query_id, chunk_id, cell) of the best codes of each query's cells."""
        q = _unit(np.array([r.q for r in asked], float), self.metric)
        askers: dict[int, list[int]] = {}
        for i, cells in enumerate(cells_of):
            for c in cells.tolist():
                askers.setdefault(c, []).append(i)
        centers, books, squares = self.centers, self.books, (q**2).sum(1)
        ids = pa.array([r.query_id for r in asked], to_arrow_type(kind))

        def score(batches):
            least = np.full(len(q), np.inf, "f4")  # a distance that `keep` rows of the task are within
            for b in batches:
                if not b.num_rows:
                    continue
                cell = b.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                said = np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], 1) + centers[cell]
                square = (said**2).sum(1)
                # in single precision: rows of the same code stay equal, whatever the product's shape
                d = np.full((len(q), b.num_rows), np.inf, "f4")
                for c in np.unique(cell).tolist():
                    who, at = askers.get(c, []), np.flatnonzero(cell == c)
                    if who:
                        d[np.ix_(who, at)] = squares[who][:, None] + square[at] - 2 * q[who] @ said[at].T
                if b.num_rows > keep:
                    least = np.minimum(least, np.partition(d, keep - 1, 1)[:, keep - 1])
                who, at = np.nonzero((d <= least[:, None]) & np.isfinite(d))
                for i in np.flatnonzero(np.bincount(who, minlength=len(q)) > keep):  # more at the same distance: by place, which is by id
                    own = np.flatnonzero(who == i)
                    some = np.delete(np.arange(len(who)), own[np.argsort(d[i, at[own]], kind="stable")[keep:]])
                    who, at = who[some], at[some]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), b.column("chunk_id").take(pa.array(at)), b.column("cell").take(pa.array(at)), pa.array(d[who, at].astype(float))], names=["query_id", "chunk_id", "cell", "d"])

        found = self.rows(sorted(askers)).select("chunk_id", "cell", "code").mapInArrow(score, f"query_id {kind.simpleString()}, chunk_id {self.kinds['chunk_id']}, cell int, d double")
        return top_k(found, keep, ("d", False), ("chunk_id", False)).select("query_id", "chunk_id", "cell")

    def _distances(self, rows: DataFrame, digits: int) -> DataFrame:
        """Exact distances of (query_id, q, embedding, ...) rows."""
        if self.metric == "cosine":
            d = DISTANCES["cosine"](F.col("q"), F.col("embedding"))
        else:
            d = DISTANCES["l2"](F.col("q"), F.col("embedding"))
        return rows.select("query_id", "chunk_id", "doc_id", F.round(d, digits).alias("distance"))

    def _reach(self, distance: float, digits: int) -> float:
        """A rounded distance as one between the vectors that the cells are made of, rounded up."""
        up = distance + 10.0**-digits
        return math.sqrt(max(2 * up if self.metric == "cosine" else up, 0)) + ROOM

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int | None = None, exact: bool = False, digits: int = 9) -> DataFrame:
        """query_id, chunk_id, doc_id, distance, similarity, rank (from 0), as vector_search.search gives them.

        queries: (query_id, vector), at most QUERY_BLOCK of them come to the driver at a time. Cells probed and codes kept
        are those that the build found to be needed, unless given."""
        probes, rerank = probes or self.probes, rerank or self.rerank
        asked = queries.select("query_id", as_doubles(F.col("vector")).alias("q")).limit(QUERY_BLOCK + 1).collect()
        if len(asked) > QUERY_BLOCK:
            blocks = -(-queries.count() // QUERY_BLOCK) * 2
            dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
            out = None
            for i in range(blocks):
                part = written(self.search(dealt.filter(F.col("_block") == i).drop("_block"), k, probes=probes, rerank=rerank, exact=exact, digits=digits), "vector-block")
                out = part if out is None else out.unionByName(part)
            return out
        if not asked:
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id {self.kinds['chunk_id']}, doc_id {self.kinds['doc_id']}, distance double, similarity double, rank int")
        sent = F.broadcast(self.spark.createDataFrame(asked, queries.select("query_id", as_doubles(F.col("vector")).alias("q")).schema))
        q = _unit(np.array([r.q for r in asked], float), self.metric)
        far = np.stack([np.sqrt(((self.centers - x) ** 2).sum(1)) for x in q])
        # cells without a row are not probed
        far[:, self.sizes == 0] = np.inf
        near = [np.argsort(d, kind="stable")[: min(probes, int(np.isfinite(d).sum()))] for d in far]
        if exact:
            pairs = self._pairs(asked, near)
            first = written(self._ranked(self._distances(self._of(pairs, near).join(sent, "query_id"), digits), k), "vector-first")
            reach = {r.query_id: self._reach(r.distance, digits) for r in first.filter(F.col("rank") == k - 1).collect()}
            more = [np.setdiff1d(np.flatnonzero(np.isfinite(d) & (d - self.radii <= reach.get(r.query_id, np.inf))), n) for r, d, n in zip(asked, far, near)]
            found = first.select("query_id", "chunk_id", "doc_id", "distance")
            if any(map(len, more)):
                found = found.unionByName(self._distances(self._of(self._pairs(asked, more), more).join(sent, "query_id"), digits))
        else:
            best = self._coded(asked, queries.schema["query_id"].dataType, near, k * rerank)
            cells = sorted({int(c) for n in near for c in n})
            found = self._distances(self.rows(cells).join(F.broadcast(best), ["cell", "chunk_id"]).join(sent, "query_id"), digits)
        return self._ranked(found, k).withColumn("similarity", similarity(F.col("distance"))).select("query_id", "chunk_id", "doc_id", "distance", "similarity", "rank")

    def _pairs(self, asked: list, cells_of: list[np.ndarray]) -> DataFrame:
        """(query_id, cell): at most a block of queries times the cells."""
        import pandas as pd

        ids = [r.query_id for r, cells in zip(asked, cells_of) for _ in range(len(cells))]
        return self.spark.createDataFrame(pd.DataFrame({"query_id": ids, "cell": np.concatenate([*cells_of, np.empty(0, int)]).astype("i4")}))

    def _of(self, pairs: DataFrame, cells_of: list[np.ndarray]) -> DataFrame:
        return self.rows(sorted({int(c) for cells in cells_of for c in cells})).join(F.broadcast(pairs), "cell")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        return top_k(found, k, ("distance", False), ("chunk_id", False))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found: how many of the exact search's chunks are there."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
