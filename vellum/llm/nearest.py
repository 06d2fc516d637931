"""Approximate nearest neighbours: inverted lists whose scans give up on candidates from partial distances.

Vectors are rotated at random, so that any columns of a difference say how long it is. A query first scans the lists
with the nearest centres, which sets its bar, the distance of the tenth best; then the other lists that it probes,
with that bar. After each block of columns a candidate's distance so far is tested against what a candidate within the
bar would show: if it is larger beyond chance, the candidate is abandoned. Survivors are measured exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

#: Vectors that centres are fitted on, at most, chosen by a hash of the id; every vector is indexed.
SAMPLE = 20_000
#: Vectors in a list, about, as far as the sample has vectors enough for so many centres; fewest lists; rounds.
LIST, FEWEST, ROUNDS = 1024, 16, 12
#: The lists probed are as many as held this share of the neighbours of queries within the sample, found by brute force.
WANTED, TRIALS = 0.97, 256
#: Lists that set a query's bar.
FIRST = 2
#: Width of a column block, and how many standard deviations the test allows.
COLUMNS, SLACK = 8, 1.2
#: Lists are scanned by blocks of about so many vectors and queries.
PART, QUERIES = 8192, 2048
NEIGHBOURS = 10


class Index:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        q, r = np.linalg.qr(rng.normal(size=(d, d)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float64)
        x = sample @ self.rotation
        self.scale = float(np.sqrt((x * x).sum(1).mean())) or 1.0
        distinct = np.unique(x, axis=0)
        k = max(1, min(lists, len(distinct)))
        centres = distinct[rng.permutation(len(distinct))[:k]]
        for _ in range(ROUNDS):
            own = self._nearest(x, centres, 1)[:, 0]
            n = np.bincount(own, minlength=k)
            sums = np.stack([np.bincount(own, x[:, j], k) for j in range(d)], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.centres = centres

    def probes(self, sample: np.ndarray, k: int, wanted: float = WANTED) -> int:
        """How many lists must be probed to find a share of the k nearest of TRIALS sampled vectors within the sample."""
        own = self.lists_of(sample, 1)[:, 0]
        ranks, norms = [], (sample * sample).sum(1)
        for i in range(0, len(sample), max(1, len(sample) // TRIALS)):
            d = norms - 2 * (sample @ sample[i])
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            place = np.empty(len(self.centres), np.int64)
            place[self.lists_of(sample[i : i + 1], len(self.centres))[0]] = np.arange(len(self.centres))
            ranks.append(place[own[near]])
        ranks = np.sort(np.concatenate(ranks)) if ranks else np.empty(0, np.int64)
        return 1 + int(ranks[min(len(ranks) - 1, int(np.ceil(wanted * len(ranks))) - 1)]) if len(ranks) else 1

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
        d = (centres**2).sum(1)[None] - 2 * (x @ centres.T)
        return np.argsort(d, 1, kind="stable")[:, :k]

    def lists_of(self, x: np.ndarray, k: int) -> np.ndarray:
        return self._nearest(x @ self.rotation, self.centres, min(k, len(self.centres)))


def scan(index: Index, rotated: np.ndarray, original: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, bar: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and distances of the k nearest of a list within ``bar``, ties to smaller ids, and how many values were read.

    ``rotated``: single precision, dimensions by candidates; ids ascending.
    """
    q = (query @ index.rotation).astype(np.float32)
    d, n = len(q), len(ids)
    at = np.flatnonzero(ids != query_id)
    best, near, read = np.empty(0, np.int64), np.empty(0), 0
    # without a bar the first candidates set one
    for s, e in ([(0, n)] if bar < np.inf else [(0, 4 * k), (4 * k, n)]):
        some = at[s:e]
        part = np.zeros(len(some), np.float32)
        for c in range(0, d, COLUMNS):
            z = min(d, c + COLUMNS)
            for j in range(c, z):
                diff = rotated[j, some] - q[j]
                part += diff * diff
            read += len(some) * (z - c)
            if bar == np.inf:
                continue
            if z < d:  # a candidate within the bar exceeds this by chance only
                limit = bar * np.sqrt(z / d) * (1 + SLACK / np.sqrt(z))
            else:
                limit = bar * (1 + 1e-5) + 1e-6 * index.scale
            stay = part <= limit * limit
            some, part = some[stay], part[stay]
            if not len(some):
                break
        diff = original[some] - query
        best, near = np.concatenate([best, some]), np.concatenate([near, np.sqrt(np.einsum("ij,ij->i", diff, diff))])
        order = np.lexsort((ids[best], near))[:k]
        best, near = best[order], near[order]
        if len(near) == k:
            bar = min(bar, near[-1])
    return ids[best], near, read


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (a column of ``id``) holds.

    Null, zero and non-finite vectors and null ids take no part, nor do vectors whose length isn't the commonest one.
    Rows repeated with one id are one: which of their vectors counts isn't defined if these differ. A query with fewer
    candidates than k gets all of them, however far their lists are. An empty table gives no rows. ``probes``: the
    lists that a query scans; as many as the sample calls for if not given.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("v") == d)
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) <= min(1.0, SAMPLE / n) * (1 << 20)).orderBy("id").limit(2 * SAMPLE).toArrow()
    sample = _matrix(some.column("v").combine_chunks())
    index = Index(sample, max(FEWEST, min(-(-n // LIST), len(sample) // FEWEST)))
    lists = len(index.centres)
    probes = min(lists, probes or max(FIRST, index.probes(sample, k)))
    shared = spark.sparkContext.broadcast(index)

    def assign(count: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    own = shared.value.lists_of(_matrix(b.column(1)), count)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(own.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v", "lists"])

        return run

    schema_in = "id bigint, v array<double>, lists array<int>"
    held = common.written(rows.mapInArrow(assign(1), schema_in).select("id", "v", F.col("lists")[0].alias("list")))
    parts = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row for each list
    held = held.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v")
    asked = common.written(rows.where(is_query(F.col("id"))).dropDuplicates(["id"]).mapInArrow(assign(lists), schema_in))

    def scan_part(key, queries_of, candidates):
        index = shared.value
        ids = candidates.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(ids) else order
        ids = ids[order]
        x = _matrix(candidates.column("v").combine_chunks())[order] if len(ids) else np.empty((0, d))
        rotated = np.ascontiguousarray((x @ index.rotation).astype(np.float32).T)
        out, read = ([], [], []), []
        if len(ids) and queries_of.num_rows:
            bars = queries_of.column("bar").to_pylist()
            for qid, q, bar in zip(queries_of.column("id").to_pylist(), _matrix(queries_of.column("v").combine_chunks()), bars, strict=True):
                found, near, values = scan(index, rotated, x, ids, q, qid, k, bar)
                out[0].extend([qid] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(near.tolist())
                read += [values] * len(found)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "read": pa.array(read, pa.int64())})

    def scanned(queries: DataFrame, first: int, count: int) -> DataFrame:
        """Blocks of a list's vectors and of the queries that probe it; ``queries`` have a bar, infinite at first."""
        queries = queries.select("id", "v", "bar", F.posexplode(F.slice("lists", first + 1, count)).alias("nth", "list"))
        many = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))  # a row for each list
        queries = queries.join(F.broadcast(many.join(F.broadcast(parts), "list")), "list").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int"))
        queries = queries.select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "share", "id", "v", "bar")
        vectors = held.join(F.broadcast(many), "list").select("list", "part", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "id", "v")
        keys = ("list", "part", "share")
        return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(scan_part, "query_id long, vec_id long, score double, read long")

    best = W.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows for each block that a query probes
    ranked = lambda rows: rows.drop("read").withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    found = common.written(ranked(scanned(asked.withColumn("bar", F.lit(float("inf"))), 0, FIRST)))
    bars = found.where(f"rank = {k}").select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    again = asked.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
    if probes > FIRST:
        found = common.written(ranked(found.drop("rank").unionByName(scanned(again, FIRST, probes - FIRST).drop("read"))))
    if max(FIRST, probes) < lists:  # queries whose lists hold fewer than k candidates get those of all other lists too
        enough = found.where(f"rank = {k}").select(F.col("query_id").alias("id"))
        short = common.written(again.join(enough, "id", "left_anti"))
        if not short.isEmpty():
            found = ranked(found.drop("rank").unionByName(scanned(short, max(FIRST, probes), lists).drop("read")))
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
