"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become lower-case words (runs of letters and digits). On a diagonal (position in the document less position in
the item) words of a document and an item are equal or not. A document leaks an item of n words if at least `share` of
them are equal on one diagonal (replaced words are tolerated, and so is a passage that is cut off), or if runs
of RUN or more equal words, on whatever diagonals, cover at least that share of the item (the passage is broken
by insertions or deletions, or its parts stand apart). Of items with fewer than LEAST words all words must be there.

The masks 11 and 101 hash two equal words that are neighbours or have one word between them. If k of an item's n words
are equal, they have k - 1 gaps, of which at most (n - k) / 2 are wider than the masks. So a leak on a diagonal has at
least k - 1 - (n - k) / 2 hits, and the item's commonest windows, one fewer than that, need no search: one of the others
hits. If all windows of some RUN neighbouring words are among those, the rarest of them is searched nevertheless,
so that no run is missed. For shares so small that an item may have no hit (0.4 and less), single words are the seeds, by the same rule: of
the rarest n - k + 1 words of the item at least one is equal; items of one word have it as their seed. Either way no
leak is without a candidate. At each, the words of the whole item are compared with the document's. How common a word is is
counted in the benchmark; it bears on speed only.

Defined results: null or empty texts hold nothing; items without words or without item_id take no part; rows without
doc_id are searched like others and reported with a null doc_id; each row is judged by itself, and rows that repeat a
doc_id are reported as one document with the best of them; repeated item_ids count by their longest overlap. Other
columns, whatever their names, are not read.

The benchmark's side is broadcast only if it has at most BROADCAST_WORDS words (counted first), and candidates are then
compared where they arise; a larger one goes through shuffled joins.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import counted, unused, written

#: The fixed masks: two words at a distance of 1 and 2.
MASKS = ("11", "101")
SINGLE = ("1",)
#: Items of fewer words must be there as a whole.
LEAST = 10
RUN = 5
BROADCAST_WORDS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _under(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _places(column: str, mask: str) -> Column:
    """The first positions of a mask's windows."""
    last = F.size(column) - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _seed(column: str, m: int, mask: str, p: Column) -> Column:
    return F.xxhash64(F.lit(m), *[F.get(F.col(column), p + i) for i in _under(mask)])


def _seeded(df: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, seed, pos for each window of the array of word hashes h."""

    def of(m: int, mask: str) -> Column:
        return F.transform(_places("h", mask), lambda p: _seed("h", m, mask, p))

    return df.select(*keys, F.explode(F.array(*[of(m, mask) for m, mask in enumerate(masks)])).alias("of_mask")).select(*keys, F.posexplode("of_mask").alias("pos", "seed"))


def hits(n: int, share: float) -> int:
    """The least number of hits of MASKS in an item of n words of which `share` are equal."""
    k = math.ceil(share * n)
    return k - 1 - (n - k) // 2


def needed(n: Column, share: float) -> Column:
    """How many of an item's n words must be found."""
    return F.when(n < LEAST, n).otherwise(F.greatest(F.ceil(share * n), F.lit(1)))


def _searched(items: DataFrame, share: float, masks: tuple[str, ...], small) -> DataFrame:  # noqa: ANN001
    """item, item_pos, item_seed of the windows that every leak has a hit among: all but the commonest."""
    each = items.select("item", F.posexplode("h").alias("p", "w"))
    counts = each.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    counts = each.join(small(counts), F.col("w") == F.col("word")).groupBy(F.col("item").alias("i")).agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("cs"))

    def window(m: int, mask: str, p: Column) -> Column:
        common = reduce(mul, [F.get(F.col("cs"), p + i)["c"] for i in _under(mask)])
        return F.struct((-common).alias("rare"), p.cast("int").alias("item_pos"), _seed("h", m, mask, p).alias("item_seed"))

    def of(m: int, mask: str, places: Column) -> Column:
        return F.transform(places, lambda p: window(m, mask, p))

    n, k = F.size("h"), needed(F.size("h"), share)
    none = F.array().cast("array<int>")
    of_one = F.when(n == 1, _places("h", "1")).otherwise(none)
    windows = F.concat(*[of(m, mask, of_one if mask == "1" and masks != SINGLE else _places("h", mask)) for m, mask in enumerate(masks)])
    spare = F.greatest(k - 1 - (F.lit(0) if masks == SINGLE else F.floor((n - k) / 2) + 1), F.lit(0))
    ordered = F.sort_array(windows)
    kept = F.slice(ordered, (spare + 1).cast("int"), F.greatest(F.size(windows), F.lit(1)))
    # of a run's windows the rarest, where all of them are among those left out
    of_run = lambda p: F.greatest(*[window(m, mask, p + i) for m, mask in enumerate(masks) if mask != "1" or masks == SINGLE for i in range(RUN - len(mask) + 1)])
    runs = F.transform(F.when(n >= RUN, F.sequence(F.lit(0), n - RUN)).otherwise(none), of_run)
    all_kept = F.array_union(kept, F.filter(runs, lambda w: w < F.get(ordered, spare.cast("int"))))
    return items.join(small(counts), F.col("item") == F.col("i")).select("item", F.explode(all_kept).alias("s")).select("item", "s.item_pos", "s.item_seed")


def found(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, text_hash, item_id, doc_pos, n_match, n_item: one row for each item that a row of docs leaks, the row told by doc_id and xxhash64 of its text."""
    items = benchmark.select("item_id", hashes(F.col("text")).alias("h")).filter((F.size("h") > 0) & F.col("item_id").isNotNull())
    items = items.withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"])
    sizes = items.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)), F.coalesce(F.min(F.size("h")), F.lit(LEAST))).first()
    masks = SINGLE if any(hits(i, share) < 1 for i in range(LEAST, 100)) else MASKS + (SINGLE if sizes[1] == 1 else ())
    sides = items.select(F.col("item").alias("i"), "item_id", F.col("h").alias("item_h"))
    row = ["doc_id", "text_hash"]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter(F.col("text").isNotNull()).select(*row, hashes(F.col("text")).alias("h"))
    hit = F.col("seed") == F.col("item_seed")
    diagonal = (F.col("pos") - F.col("item_pos")).alias("d")
    if sizes[0] <= BROADCAST_WORDS:
        at = _seeded(hashed, [*row, "h"], masks).join(F.broadcast(_searched(items, share, masks, F.broadcast)), hit)
        both = at.select(*row, F.col("h").alias("doc_h"), "item", diagonal).join(F.broadcast(sides), F.col("item") == F.col("i"))
    else:
        at = _seeded(hashed, row, masks).join(_searched(items, share, masks, lambda df: written(df, "benchmark")), hit)
        at = counted(at.select(F.col("doc_id").alias("r"), F.col("text_hash").alias("rh"), "item", diagonal).distinct(), "hits")
        both = hashed.join(at, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("text_hash") == F.col("rh"))).select(*row, F.col("h").alias("doc_h"), "item", "d").join(sides, F.col("item") == F.col("i"))
    same = F.transform("item_h", lambda w, p: F.coalesce(F.when(p + F.col("d") >= 0, F.get(F.col("doc_h"), p + F.col("d"))) == w, F.lit(False)))
    both = both.select(*row, "item_id", F.size("item_h").cast("bigint").alias("n_item"), "d", F.explode(F.array(same)).alias("same"))  # an explode, so that it is worked out once
    places = F.filter(F.sequence(F.lit(0), F.size("same") - 1), lambda p: F.get(F.col("same"), p))
    both = both.select(*row, "item_id", "n_item", "d", "same", F.explode(F.array(places)).alias("places"))
    # a place is within a run if one of the RUN stretches around it is equal throughout
    within = F.filter("places", lambda p: reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.coalesce(F.when(p - o + i >= 0, F.get(F.col("same"), p - o + i)), F.lit(False)) for i in range(RUN)]) for o in range(RUN)]))
    n = F.size("places")
    parts = both.select(*row, "item_id", "n_item", F.struct(n.alias("n"), (-F.col("d")).alias("d")).alias("m"), within.alias("runs"))
    parts = parts.filter((F.col("m.n") >= needed(F.col("n_item"), share)) | (F.size("runs") > 0))
    placed = parts.select(*row, "item_id", "n_item", "m", F.explode(F.concat(F.array(F.lit(-1)), "runs")).alias("p")).groupBy(*row, "item_id", "n_item", "p").agg(F.max("m").alias("m"))
    whole = placed.groupBy(*row, "item_id", "n_item").agg(F.max("m").alias("m"), F.sum((F.col("p") >= 0).cast("int")).alias("covered"))
    return (
        whole.withColumn("n", F.greatest("m.n", "covered"))
        .filter(F.col("n") >= needed(F.col("n_item"), share))
        .select(*row, "item_id", (-F.col("m.d")).cast("bigint").alias("doc_pos"), F.col("n").cast("bigint").alias("n_match"), "n_item")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, doc_pos, n_match, n_item: one row for each leaked item of a document.

    doc_pos is the word at which the item would start on its best diagonal (below 0 if cut off), n_match the number of
    its words found, there or in runs.
    """
    best = F.max(F.struct("n_match", (-F.col("doc_pos")).alias("d"), "n_item")).alias("m")
    return found(docs, benchmark, share).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.d")).alias("doc_pos"), "m.n_match", "m.n_item")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """docs without the rows that leak an item, each judged by itself; columns stay as they are."""
    i, h, mine = unused(docs.columns, "bad_id", "bad_hash", "text_hash")
    bad = counted(found(docs, benchmark, share).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "leaks")
    tagged = docs.withColumn(mine, F.xxhash64("text"))
    return tagged.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(h)), "left_anti").drop(mine)


#: Every diagonal of every row and item, by joining equal words; runs are islands of neighbouring places.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT r, doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT i, item_id, len(w) AS n, CASE WHEN len(w) < 10 THEN len(w) ELSE ceil(0.5 * len(w)) END AS need, unnest(w) AS t, unnest(range(len(w))) AS p FROM b),
e AS (SELECT r, doc_id, i, item_id, n, need, dw.p - bw.p AS pos, bw.p AS p FROM dw JOIN bw USING (t)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY r, i, pos ORDER BY p) AS island FROM e),
u AS (SELECT *, count(*) OVER (PARTITION BY r, i, pos, island) >= 5 AS run FROM g),
m AS (SELECT r, doc_id, i, item_id, pos, max(n) AS n, max(need) AS need, count(*) AS c, bool_or(run) AS run FROM u GROUP BY ALL),
c AS (SELECT r, i, count(DISTINCT p) AS covered FROM u WHERE run GROUP BY ALL),
f AS (SELECT doc_id, item_id, pos, n, need, greatest(c, coalesce(covered, 0)) AS n_match, c FROM m LEFT JOIN c USING (r, i) WHERE c >= need OR (run AND covered >= need)
  QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY c DESC, pos) = 1)
SELECT doc_id, item_id, pos::BIGINT AS doc_pos, n_match::BIGINT AS n_match, n::BIGINT AS n_item FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_match DESC, pos, n DESC) = 1
"""
