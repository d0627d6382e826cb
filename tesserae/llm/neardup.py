"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a document's set holds its distinct
shingles of five words (fewer words: the whole sequence as one). Two documents are linked if
100 * intersection >= 85 * union (a parameter).

1. Each document gets its set's size, a 128-bit digest of the set (its class) and a SuperMinHash signature of
   24 bands of 6 components. In a signature each element has one pseudo-random permutation of the components and
   gives the j-th of them the value j + r, 0 <= r < 1; a component keeps the least value. All elements are taken
   level by level; once every component has a value no later level can lower one, so the loop ends.
2. Copies need no comparison: the least doc_id of a class stands for it. Band keys shared by two
   classes link them into clusters of candidates (distributed components). A pair at 0.85 shares no band with
   probability (1 - 0.85^6)^24 = 1.2e-5.
3. Within a cluster links are confirmed on full sets, rebuilt from the texts, behind an exact prefix filter:
   with elements ordered rare ones first, linked sets share an element among their first n - ceil(0.85 n) + 1.
   A cluster goes to one task while it is small; a larger one is cut into blocks, and each pair of blocks is a
   task's group, so memory is bounded at every size and no pair of blocks is left out. Within a group union-find
   skips pairs that are connected already, so what leaves a task is a forest, never all pairs.
4. Components of the confirmed links give component_id.

Defined results: a text that is null or without words has n_shingles 0 and is linked with nothing. Equal sets of
rows without doc_id have a null component_id and are all kept, unless a row with doc_id has the same set. Rows
that repeat a doc_id each give a row and count as one node, which links the sets of its texts; of them those without words
stand for themselves. Empty tables give empty results. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, ship, unused, written

WIDTH = 5
BANDS, ROWS = 24, 6
M = BANDS * ROWS
#: Clusters up to BLOCK classes are compared in one group. Larger ones are cut into up to SPREAD blocks of BLOCK
#: or more classes each, beyond that into blocks of MOST; a block holds about SHINGLES elements.
BLOCK, SPREAD, MOST, SHINGLES = 128, 32, 4096, 1_000_000
PIECE = 1 << 20


def _mix(x):  # noqa: ANN001, ANN202
    """The finalizer of splitmix64, on an array of unsigned 64-bit integers."""
    import numpy as np

    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str):  # noqa: ANN202
    import numpy as np
    from xxhash import xxh3_64_intdigest

    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        words = data.split()
        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    parts, rest = [], b""
    for lo in range(0, len(data), PIECE):
        piece = rest + data[lo : lo + PIECE]
        words = piece.split()
        rest = b""
        if lo + PIECE < len(data) and words and piece.endswith(words[-1]):
            rest = words.pop()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts)


def shingles(text: str | None, width: int = WIDTH):  # noqa: ANN201
    """The distinct shingles of a text as sorted 64-bit hashes; none for null or no words."""
    import numpy as np

    w = _word_hashes(text or "")
    if not len(w):
        return w
    short = len(w) < width
    k = min(width, len(w))
    n = len(w) - k + 1
    acc = np.full(n, np.uint64(0xA5A5 + len(w) if short else 0), np.uint64)
    c = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        acc = acc * c + w[j : j + n]
    return np.unique(_mix(acc))


def signatures(sets: list, m: int = M):  # noqa: ANN201
    """SuperMinHash of each set of 64-bit elements as a row of m integers, level << 32 | fraction."""
    import numpy as np

    full = np.iinfo(np.uint64).max
    sigs = np.full((len(sets), m), full, np.uint64)
    order = sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: len(sets[i]))
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and (hi == lo or total + len(sets[order[hi]]) <= 65_536):
            total += len(sets[order[hi]])
            hi += 1
        _fill(sigs, order[lo:hi], sets, m)
        lo = hi
    return sigs


def _fill(sigs, rows: list[int], sets: list, m: int) -> None:  # noqa: ANN001
    import numpy as np

    own = np.full(len(rows) * m, np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate([sets[i] for i in rows])
    doc = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    low32 = np.uint64(0xFFFFFFFF)
    perm = None
    for level in range(m):
        r = _mix(x ^ np.uint64((level + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
        k = (level + (((r >> np.uint64(32)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        at = np.arange(len(x))
        if level == 0:
            target, first = k, k
        else:
            if perm is None:  # the sets that are not full yet start their permutations, with the first swap
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                perm[at, first], perm[at, 0] = 0, first
            target = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, level]
            perm[at, level] = target
        np.minimum.at(own, doc * m + target, (r & low32) | np.uint64(level << 32))
        done = own.reshape(-1, m).max(axis=1) < np.uint64((level + 1) << 32)
        left = ~done[doc]
        if not left.any():
            break
        if left.sum() < 0.8 * len(x) or level == 0:
            x, doc, first = x[left], doc[left], first[left]
            perm = None if perm is None else perm[left]
    sigs[rows] = own.reshape(-1, m)


def band_keys(sigs, bands: int = BANDS):  # noqa: ANN001, ANN201
    """A 64-bit key for each band, which holds the band's number."""
    import numpy as np

    parts = sigs.reshape(len(sigs), bands, -1)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        acc = _mix(acc * np.uint64(0xD6E8FEB86659FD93) ^ parts[:, :, j])
    return acc.view(np.int64)


def signed(docs: DataFrame, width: int = WIDTH, percent: int = 85) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles long, cls binary (null: empty set), bands array<long>; no shuffle.

    A set that is too small to be linked with another than its equals has no bands.
    """
    import pyarrow as pa

    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingles(t.as_py(), width) for t in part.column(2)]
                keys = band_keys(signatures([s if len(s) >= least else s[:0] for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if len(s) >= least else k[:0] for s, k in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "cls", "bands"],
                )

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, cls binary, bands array<bigint>")


def links(ids: list[int], blocks: list[int], sets: list, across: bool, percent: int = 85) -> list[tuple[int, int]]:
    """A forest of confirmed links among sets; across: only between different blocks. Exact."""
    import numpy as np

    if len(sets) < 2:
        return []
    sizes = [len(s) for s in sets]
    _, inv, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ones = int((counts == 1).sum())
    ranked = np.split(rank[inv], np.cumsum(sizes)[:-1])
    heads: list[int] = list(range(len(sets)))

    def find(i: int) -> int:
        while heads[i] != i:
            heads[i] = heads[heads[i]]
            i = heads[i]
        return i

    posted: dict[int, list[int]] = {}
    out = []
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        n = sizes[i]
        if not n:
            continue
        mine = np.sort(ranked[i])
        prefix = mine[: n - -(-percent * n // 100) + 1]
        prefix = prefix[prefix >= ones].tolist()
        seen: set[int] = set()
        for p in prefix:
            seen.update(posted.get(p, ()))
        for j in sorted(seen):
            if 100 * sizes[j] < percent * n or (across and blocks[i] == blocks[j]) or find(i) == find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (n + sizes[j] - both):
                heads[find(i)] = find(j)
                out.append((ids[i], ids[j]))
        for p in prefix:
            posted.setdefault(p, []).append(i)
    return out


def _confirmed(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) within clusters (node, root, n_shingles)."""
    import pyarrow as pa

    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    rows = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("n") / SPREAD), F.lit(MOST)))
    cut = sizes.select(F.col("root").alias("r"), F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("weight") / SHINGLES)).cast("int").alias("nb"))
    cut = written(cut, "cut")  # a table, so that Spark can split a large cluster's side of the join
    placed = clusters.join(cut, F.col("root") == F.col("r")).select("node", "root", "nb", F.pmod(F.xxhash64("node", "root"), F.col("nb")).cast("int").alias("block"))
    dealt = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(placed, F.col("doc_id") == F.col("node"))
        .select("root", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"), "doc_id", "text")
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "text")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, blocks, sets = None, [], [], []

        def closed() -> Iterator[pa.RecordBatch]:
            if group is not None and (found := links(ids, blocks, sets, group[1] != group[2], percent)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            for key, block, d, t in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if key != group:
                    yield from closed()
                    group, ids, blocks, sets = key, [], [], []
                ids.append(d)
                blocks.append(block)
                sets.append(shingles(t.as_py(), width))
        yield from closed()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls, component_id, kept of each row of docs."""
    s = written(signed(docs, width, percent), "signatures")
    with_set = s.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = with_set.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min_by("bands", "doc_id").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select(F.col("key").alias("k"), "lo"), "bands")
    near = banded.join(shared, F.col("key") == F.col("k")).filter("rep != lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct()
    clusters = components(near)
    clusters = clusters.join(classes.groupBy(F.col("rep").alias("r")).agg(F.sum("n_shingles").alias("n_shingles")), F.col("node") == F.col("r")).select("node", "root", "n_shingles")
    links = _confirmed(docs, clusters, width, percent)
    # a doc_id that stands over several sets links them
    several = written(with_set.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select(F.col("doc_id").alias("d")), "several")
    if several.head(1):
        own = with_set.join(several, F.col("doc_id") == F.col("d")).select("d", F.col("cls").alias("c"))
        links = links.unionAll(own.join(classes, F.col("c") == F.col("cls")).select(F.col("d").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    to = classes.select(F.col("cls").alias("c"), "rep").join(found, F.col("rep") == F.col("node"), "left").select("c", F.coalesce("root", "rep").alias("root"))
    # rows without a set are spread by a key of their own
    key = F.coalesce("cls", F.xxhash64("doc_id", "text_hash").cast("string").cast("binary"))
    out = s.select("doc_id", "text_hash", "n_shingles", "cls", key.alias("key")).join(to, (F.col("key") == F.col("c")) & F.col("cls").isNotNull(), "left")
    out = out.select("doc_id", "text_hash", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles long, component_id long, kept boolean."""
    return _rows(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = 85) -> DataFrame:
    """docs with one row of each group, of its least doc_id; columns stay as they are.

    Of rows that repeat a doc_id one stays, if possible one with words; of rows without doc_id one of each set
    that no row with doc_id has stays, and all that have no words.
    """
    i, h, mine = unused(docs.columns, "kept_id", "kept_hash", "text_hash")
    flags = written(_rows(docs, width, percent).filter("kept").select("doc_id", "text_hash", "cls"), "kept")
    # by doc_id, or without one by set, or without either each by itself
    group = F.when(F.col("doc_id").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("doc_id").alias("n"), F.lit(b"").alias("c")))
    group = group.when(F.col("cls").isNotNull(), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.col("cls").alias("c")))
    group = group.otherwise(F.struct(F.lit(2).alias("kind"), F.col("text_hash").alias("n"), F.lit(b"").alias("c")))
    best = F.min(F.struct(F.col("cls").isNull().alias("empty"), F.col("text_hash").alias("text_hash"))).alias("best")
    stays = flags.groupBy(group.alias("g"), "doc_id").agg(best, F.count(F.lit(1)).alias("rows")).select(F.col("doc_id").alias(i), F.col("best.text_hash").alias(h), (F.col("rows") > 1).alias("more"), F.col("g.kind").alias("kind"))
    stays = written(stays, "stays")
    tagged = docs.withColumn(mine, F.xxhash64("text"))

    def at(side: DataFrame) -> Column:
        return F.col("doc_id").cast("bigint").eqNullSafe(side[i]) & (F.col(mine) == side[h])

    keys = stays.select(i, h)
    out = tagged.join(keys, at(keys), "left_semi")
    twice = stays.filter("more and kind < 2").select(i, h)
    if twice.head(1):  # several rows with the same doc_id and text: any one of them
        more = out.join(twice, at(twice), "left_semi").dropDuplicates(["doc_id", mine])
        out = out.join(twice, at(twice), "left_anti").unionAll(more)
    return out.drop(mine)
