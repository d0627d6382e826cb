"""Exact top-k by inner product behind multi-resolution segment statistics.

A vector is cut into 1, 4, 16, 32 and 48 segments; each keeps its sum's share (mean) and its deviation. For two vectors,
sum over segments of length * (mean * mean + deviation * deviation) is at least the inner product (Cauchy-
Schwarz within each segment), which is the same as a lower bound on their distance. Each block of queries
first scores SEED candidates exactly, which sets its bars. Then it goes through the candidates block by block:
pairs whose coarse bound is under the query's k-th best so far go, the rest meets the next finer bound, and what survives
them all gets its exact score, in integers. Bounds are widened by a relative 1e-9, far over the rounding error of
doubles, so none is lost to it.

Queries are a stated set (here ids divisible by a number) and meet all rows in one scan, however many they are: they lie
in the shared folder in files of QUERY_BLOCK, and a task that has gathered HELD candidates goes through these
files one by one. So it holds one block of queries and HELD candidates at a time, and gives k rows a query for each HELD
candidates; a query's rows are merged behind that.

Components are floor(256 * x) with x as double. Defined results: rows whose vector is null or has a
null or non-finite component take no part, nor do rows without an id; vectors of different lengths don't
meet; an empty vector meets none; ties go to the smaller id; rows that repeat an id each take part as candidates
(but for the query's own id), and a query id is answered once, with its least vector that takes part. Scores beyond 64
bits end at the limits of long. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import new_path, ship

QUERY_BLOCK = 4096
#: Candidates that are scored exactly to begin with, that meet a bound at a time, and that a task holds.
SEED, CANDIDATES, HELD = 256, 1024, 131_072
LEVELS = (1, 4, 16, 32, 48)


def segments(x, pieces: int):  # noqa: ANN001, ANN201
    """Per row of x the segments' means and deviations, each times the root of the segment's length: their products sum to the bound."""
    import numpy as np

    cuts = np.linspace(0, x.shape[1], min(pieces, x.shape[1]) + 1).astype(int)
    sizes = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / sizes
    deviation = np.sqrt(np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, cuts[:-1], axis=1))
    return np.concatenate([mean * np.sqrt(sizes), deviation], axis=1)


class Best:
    """The k best candidates of each query so far: greater scores, then smaller ids."""

    def __init__(self, ids, x, k: int):  # noqa: ANN001
        import numpy as np

        self.ids, self.x, self.k = np.asarray(ids, np.int64), x, k
        self.f = x.astype(np.float64)
        self.stats = [segments(self.f, n) for n in LEVELS]
        self.norm = np.sqrt((self.f**2).sum(axis=1))
        #: Places that are still empty have the least score and the greatest id.
        self.scores = np.full((len(x), k), -(2**63), np.int64)
        self.found = np.full((len(x), k), 2**63 - 1, np.int64)
        self.filled = np.zeros(len(x), np.int64)

    def bars(self):  # noqa: ANN201
        """What a pair must reach: each query's k-th best so far."""
        import numpy as np

        return np.where(self.filled >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def survivors(self, ids, f):  # noqa: ANN001, ANN201
        """The pairs (query, candidate) whose bounds, coarse to fine, reach the query's bar."""
        import numpy as np

        slack = 1e-9 * self.norm.max(initial=0) * np.sqrt((f**2).sum(axis=1)).max(initial=0) + 1e-9
        bar = self.bars() - slack
        theirs = segments(f, LEVELS[0])
        alive = ~(self.stats[0] @ theirs.T < bar[:, None]) & (self.ids[:, None] != ids[None, :])
        for n, mine in zip(LEVELS[1:], self.stats[1:], strict=True):
            rows, columns = alive.any(axis=1), alive.any(axis=0)  # only what has a pair left meets the next bound
            if not rows.any():
                break
            bound = mine[rows] @ segments(f[columns], n).T
            alive[np.ix_(rows, columns)] &= ~(bound < bar[rows][:, None])
        return np.nonzero(alive)

    def take(self, ids, x) -> int:  # noqa: ANN001
        """Takes a block of candidates; returns how many pairs were scored exactly."""
        import numpy as np

        f = x.astype(np.float64)
        with np.errstate(all="ignore"):
            q, c = self.survivors(ids, f)
        scored = len(q)
        if not scored:
            return 0
        if x.dtype == object or self.x.dtype == object:
            pairs = zip(self.x[q].tolist(), x[c].tolist(), strict=True)
            score = np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in pairs], np.int64)
        elif scored * 16 < len(self.ids) * len(ids):
            score = np.einsum("ij,ij->i", self.f[q], f[c]).astype(np.int64)  # all sums are below 2^53
        else:
            score = (self.f @ f.T)[q, c].astype(np.int64)
        better = (self.filled[q] < self.k) | (score >= self.scores[q, -1])
        q, c, score = q[better], c[better], score[better]
        held = np.arange(self.k)[None, :] < self.filled[:, None]
        held[np.setdiff1d(np.arange(len(self.ids)), q)] = False  # queries without news stay as they are
        rows = np.concatenate([np.nonzero(held)[0], q])
        scores, found = np.concatenate([self.scores[held], score]), np.concatenate([self.found[held], ids[c]])
        order = np.lexsort((found, ~scores, rows))  # ~: in falling order, without overflow
        rows, scores, found = rows[order], scores[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        top = place < self.k
        self.scores[rows[top], place[top]], self.found[rows[top], place[top]] = scores[top], found[top]
        self.filled = np.maximum(self.filled, np.minimum(self.k, np.bincount(rows, minlength=len(self.ids))))
        return scored

    def rows(self):  # noqa: ANN201
        """(query ids, candidate ids, scores)."""
        import numpy as np

        held = np.arange(self.k)[None, :] < self.filled[:, None]
        return self.ids[np.nonzero(held)[0]], self.found[held], self.scores[held]


def _vectors(col):  # noqa: ANN001, ANN202
    """Per length, (row numbers, integers) of the vectors in an arrow list column that take part; object integers where doubles would not hold the scores."""
    import numpy as np

    flat = col.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
    sizes = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == size)[0]
        x = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        rows, x = rows[good], x[good]
        if not len(rows):
            continue
        big = np.abs(x).max() >= 2.0**17 / np.sqrt(size)  # 256 x under 2^25 / sqrt(size): products sum under 2^53
        if big:
            from fractions import Fraction

            v = np.array([[int(Fraction(float(c)) * 256 // 1) for c in r] for r in x], dtype=object)
        else:
            v = np.floor(256.0 * x).astype(np.int64)
        out[int(size)] = (rows, v)
    return out


def _taking_part(col):  # noqa: ANN001, ANN202
    """A condition: no null and only finite components."""
    good = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return col.isNotNull() & good


def _met(ids, vectors, files: list[str], k: int):  # noqa: ANN001, ANN202
    """(query ids, candidate ids, scores, pairs, pairs scored exactly) of candidates against all blocks of queries."""
    import pyarrow.parquet as pq

    from tesserae.llm.warc import opened

    for file in files:
        with opened(file) as f:
            asked = pq.read_table(f).combine_chunks()
        query_ids = asked.column("id").to_numpy()
        for size, (at, x) in _vectors(asked.column("v").combine_chunks()).items():
            if size not in vectors:
                continue
            own, y = vectors[size]
            best, scored = Best(query_ids[at], x, k), 0
            cuts = [0, *range(min(SEED, len(own)), len(own), CANDIDATES), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    scored += best.take(ids[own[lo:hi]], y[lo:hi])
            yield (*best.rows(), len(at) * len(own), scored)


def topk(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", hold: int = HELD) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for each id divisible by `every` its k best among all other ids."""
    found = _candidates(vectors, every, k, id_col, vector, hold).filter("score is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_share(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """The share of all pairs that no bound could spare an exact score."""
    pairs, scored = _candidates(vectors, every, k, id_col, vector, HELD).agg(F.sum("pairs"), F.sum("scored")).first()
    return scored / pairs if pairs else 0.0


def _candidates(vectors: DataFrame, every: int, k: int, id_col: str, vector: str, hold: int) -> DataFrame:
    """query_id, vec_id, score: for each `hold` candidates the k best of each query; and rows of (pairs, scored) with nulls there."""
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _taking_part(F.col("v")))
    path = new_path(spark, "queries")
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answered() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, seen, exact = t.column(0).to_numpy(), 0, 0
            for q, i, s, pairs, scored in _met(ids, _vectors(t.column(1).combine_chunks()), files, k):
                seen, exact = seen + pairs, exact + scored
                if len(q):
                    none = pa.nulls(len(q), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), none, none], names=names)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([seen]), pa.array([exact])], names=names)
            held.clear()

        names = ["query_id", "vec_id", "score", "pairs", "scored"]
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= hold:
                yield from answered()
        if held:
            yield from answered()

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, pairs bigint, scored bigint")
