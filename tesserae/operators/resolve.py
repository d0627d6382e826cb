"""Resolution of names to definitions by a cascade of strategies.

Each strategy is a join that proposes candidates with its rank and confidence; all candidates are aggregated by call
(how many a strategy has, and one of them), and the first strategy that decides wins. A strategy with more than one
candidate is passed over, or ends the search as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    """on: (column of calls, column of definitions) pairs that must be equal; each: the column of calls that is an array, any element of which may be."""

    method: str
    confidence: float
    on: tuple[tuple[str, str], ...]
    stop_on_ambiguous: bool = False
    each: str | None = None


#: From the surest to the least sure.
DEFAULT = (
    Strategy("scope", 1.0, (("file", "file"), ("container", "container"), ("name", "name"))),
    Strategy("same_file", 0.95, (("file", "file"), ("name", "name")), stop_on_ambiguous=True),
    Strategy("import", 0.90, (("import", "module"), ("name", "name"))),
    Strategy("global", 0.70, (("name", "name"),)),
)

#: For calls that have a qualifier (its last part, whether a type, a module's name in the file or a variable of known type) and the modules whose names a file takes in as a whole.
MEMBERS = (
    Strategy("self", 0.95, (("self_type", "container"), ("name", "name"))),
    Strategy("qualified", 0.95, (("qualifier", "container"), ("name", "name"))),
    Strategy("module_alias", 0.90, (("qualifier_module", "module"), ("name", "name"))),
    Strategy("receiver", 0.85, (("receiver_type", "container"), ("name", "name"))),
    Strategy("wildcard", 0.85, (("wildcards", "module"), ("name", "name")), each="wildcards"),
)
FULL = (DEFAULT[0], *MEMBERS[:4], *DEFAULT[1:3], MEMBERS[4], DEFAULT[3])


def resolved(calls: DataFrame, definitions: DataFrame, strategies: tuple[Strategy, ...] = DEFAULT, key: str = "call") -> DataFrame:
    """call, target, method, confidence, status (resolved, ambiguous or unresolved) for each row of calls.

    definitions has `target`. It is first counted by each strategy's key, so that a name with many definitions gives
    one row, not one for each pair; nothing is multiplied.
    """
    out = None
    for rank, s in enumerate(strategies):
        names = [d for _, d in s.on]
        found = definitions.filter(" and ".join(f"`{n}` is not null" for n in names)).groupBy(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
        on = [F.col(c) == F.col(f"k{i}") for i, (c, _) in enumerate(s.on)]
        cond = on[0]
        for x in on[1:]:
            cond = cond & x
        decides = (F.col("n") == 1) | F.lit(s.stop_on_ambiguous)
        # what doesn't decide comes after all that do
        rank_of, sure = F.when(decides, rank).otherwise(rank + len(strategies)), F.when(decides, s.confidence).otherwise(0.40)
        asked = calls.withColumn(s.each, F.explode(s.each)) if s.each else calls
        met = asked.join(found, cond)
        if s.each:  # what several elements find together
            met = met.groupBy(key).agg(F.sum("n").alias("n"), F.min("target").alias("target"))
        part = met.select(key, F.struct(rank_of.alias("rank"), F.lit(s.method).alias("method"), sure.alias("confidence"), "n", "target").alias("c"))
        out = part if out is None else out.unionAll(part)
    first = out.groupBy(key).agg(F.min("c").alias("c"))
    one = F.col("c.n") == 1
    return calls.select(key).join(first, key, "left").select(
        key, F.when(one, F.col("c.target")).alias("target"), F.col("c.method").alias("method"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("c").isNull(), "unresolved").when(one, "resolved").otherwise("ambiguous").alias("status")
    )


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "Exact").when(confidence >= 0.70, "Inferred").otherwise("Heuristic")


def unique_by_name(definitions: DataFrame) -> DataFrame:
    """name, target: null where the name is ambiguous."""
    return definitions.groupBy("name").agg(F.when(F.count(F.lit(1)) == 1, F.min("target")).alias("target"))


def stats(res: DataFrame) -> DataFrame:
    """status, method, n."""
    return res.groupBy("status", "method").agg(F.count(F.lit(1)).alias("n"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, rank: imports (src, target) joined with files (file, key) by the first of the target's keys that fits: the whole path, then its first part."""
    target = F.trim(F.regexp_replace("target", "^/+|/+$", ""))
    tries = imports.select("src", "target", F.posexplode(F.array(target, F.element_at(F.split(target, "/"), 1))).alias("rank", "key")).filter("key != ''")
    return _first(tries, files)


def _first(tries: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, rank of tries (src, target, rank, key): the files of the first key that fits; of several files that one with the least name."""
    fit = tries.join(files.select("key", "file").distinct(), "key").groupBy("src", "target").agg(F.min(F.struct("rank", "file")).alias("f"))
    return fit.groupBy("src", F.col("f.file").alias("dst")).agg(F.min("f.rank").alias("rank"))


# How a module's file may end.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_candidates(source: Column, module: Column, most_up: int = 32) -> Column:
    """The paths, in order, that an import of `module` in the file `source` may mean; none if it is neither relative nor an alias.

    A relative module is taken from the file's folder (. and .. are folded). One that starts with @ or ~ is looked for under
    src and then directly in each folder upwards, up to most_up of them.
    """
    clean = F.regexp_replace(module, "^['\"]+|['\"]+$", "")
    parts = F.split(source, "/")
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    step = lambda path, x: F.when(x.isin("", "."), path).when((x == "..") & (F.size(path) > 0), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(x)))
    relative = F.array(F.array_join(F.aggregate(F.split(clean, "/"), folder, step), "/"))
    name = F.regexp_replace(clean, "^@*~*/*", "")
    up = F.transform(F.sequence(F.lit(0), F.least(F.size(folder), F.lit(most_up))), lambda i: F.slice(folder, 1, F.size(folder) - i))
    join = lambda path, *tail: F.array_join(F.concat(path, F.array(*tail)), "/")
    alias = F.flatten(F.transform(up, lambda p: F.array(join(p, F.lit("src"), name), join(p, name))))
    bases = F.when(clean.startswith("."), relative).when(clean.rlike("^[@~]"), alias).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(s)) for s in SUFFIXES])))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, rank: imports (src, the importing file; target) joined with files (file) by the first candidate path that is one."""
    tries = imports.select("src", "target", F.posexplode(import_candidates(F.col("src"), F.col("target"))).alias("rank", "key"))
    return _first(tries, files.select(F.col("file").alias("key"), "file"))
