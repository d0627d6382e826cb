"""Snapshots and the ledger of reviews: what changed, what to rebuild, and the last state of each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as t

NOTE = "Re-evaluated by new analysis"


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, removed, same) of two snapshots (path, hash)."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def scope(changes: DataFrame, most_files: int = 10, most_ratio: float = 0.3) -> DataFrame:
    """One row n_changed, ratio, full: whether to rebuild everything."""
    n = F.coalesce(F.sum((F.col("change") != "same").cast("bigint")), F.lit(0))
    one = changes.agg(n.alias("n_changed"), F.when(F.count(F.lit(1)) > 0, n / F.count(F.lit(1))).otherwise(0.0).alias("ratio"))
    return one.withColumn("full", (F.col("n_changed") > most_files) | (F.col("ratio") > most_ratio))


def is_valid(cached: DataFrame, now: DataFrame) -> DataFrame:
    """One row valid: whether both hold the same (path, hash) rows."""
    odd = cached.select("path", "hash").exceptAll(now.select("path", "hash")).unionAll(now.select("path", "hash").exceptAll(cached.select("path", "hash")))
    return odd.agg((F.count(F.lit(1)) == 0).alias("valid"))


def outcome_id(project: Column, full_path: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("outcome_"), F.substring(F.sha2(F.concat_ws("::", project, full_path, name, line.cast("string")), 256), 1, 16))


def folded(mutations: DataFrame) -> DataFrame:
    """The last state of each id from mutations (id, at, seq, kind, confidence, note), in the order of (at, seq).

    kind `analyse` inserts an entry as Pending or resets it to Pending with a note; `remove`, `keep` and `false_positive`
    resolve it. As each kind sets the whole outcome, the last mutation decides, and the note of a reset depends on
    whether the one before it had resolved: both are maxima over structs, combined map-side, so that an id with most of
    the rows is no burden.
    """
    order = F.struct("at", "seq")
    is_analysis = F.col("kind") == "analyse"
    last = F.max(F.struct(order.alias("o"), "kind", "confidence", "note"))
    g = mutations.groupBy("id").agg(
        last.alias("last"), F.max(F.when(is_analysis, F.struct(order.alias("o"), "confidence"))).alias("analysis"), F.max(F.when(~is_analysis, F.struct(order.alias("o"), "kind"))).alias("resolution"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(is_analysis, 1).otherwise(0)).alias("n_analyses"),
    )
    outcome = F.when(F.col("last.kind") == "analyse", "Pending").when(F.col("last.kind") == "remove", "Removed").when(F.col("last.kind") == "keep", "Kept").otherwise("FalsePositive")
    note = F.when((F.col("last.kind") == "analyse") & F.col("resolution").isNotNull(), NOTE).otherwise(F.col("last.note"))
    return g.select("id", outcome.alias("outcome"), F.col("analysis.confidence").alias("confidence"), note.alias("notes"), F.when(outcome != "Pending", F.col("last.o.at")).alias("outcome_date"), F.col("n").alias("n_mutations"))


def upsert(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """ledger (id, outcome, confidence, notes, outcome_date) after new analyses (id, confidence): resolved entries go back to Pending."""
    i = incoming.groupBy("id").agg(F.max("confidence").alias("new"))
    out = ledger.join(i, "id", "full")
    hit, resolved = F.col("new").isNotNull(), F.col("outcome") != "Pending"
    return out.select(
        "id", F.when(hit, "Pending").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("new", "confidence").alias("confidence"), F.when(hit & resolved, NOTE).otherwise(F.col("notes")).alias("notes"),
        F.when(~hit, F.col("outcome_date")).alias("outcome_date"),
    )


def resolve_first(ledger: DataFrame, name: str, removed: bool, why: str | None, at: Column, order: str = "id") -> DataFrame:
    """The ledger (id, name, outcome, notes, outcome_date, ..) after one decision on the first pending entry by `order` whose name holds `name`.

    Removed, `why` is the commit; else the entry is kept as a false positive, for the reason `why`. Without such an entry
    nothing changes. One row is looked up and sent to all; ties in `order` go to the smaller id, and rows of a repeated id change together.
    """
    first = ledger.filter((F.col("outcome") == "Pending") & F.col("name").contains(name)).orderBy(order, "id").limit(1).select("id", F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False))
    note = "Removed by developer" if removed else f"False positive: {why or ''}"
    out = ledger.join(F.broadcast(first), "id", "left")
    changed = {"outcome": F.lit("Removed" if removed else "Kept"), "notes": F.lit(note), "outcome_date": at, **({"removed_commit": F.lit(why)} if "removed_commit" in ledger.columns and removed else {})}
    return out.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in changed.items()}).select(*[f"`{c}`" for c in ledger.columns])


def examples(ledger: DataFrame) -> DataFrame:
    """id, label, reason of the decisions that teach something: removed entries were dead, those kept as a false positive are alive."""
    label = F.when(F.col("outcome") == "Removed", "Dead").when((F.col("outcome") == "Kept") & F.col("notes").contains("false positive"), "Alive")
    reason = F.when(label == "Dead", "Removed by developer via dashboard").otherwise("Kept as false positive via dashboard")
    return ledger.select("id", label.alias("label"), reason.alias("reason"), "confidence").filter("label is not null")


def stats(ledger: DataFrame) -> DataFrame:
    """outcome, n, mean_confidence."""
    return ledger.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def activity(commits: DataFrame, now: Column) -> DataFrame:
    """file, n, score from commits (file, at): .7 of the commits' share of the greatest and .3 / (days since the last + 1)."""
    g = commits.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    most = g.agg(F.max("n")).first()[0] or 1
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last")) / 86400)
    return g.select("file", "n", (F.col("n") / most * 0.7 + 0.3 / (days + 1)).alias("score"))


def inverted(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """token, id: each token of a text once, the rows of an inverted index; grouping them into lists is left to the reader, as a token may be in most texts."""
    return df.select(F.explode(F.array_distinct(t.code_tokens(F.col(text)))).alias("token"), F.col(id_col).alias("id"))
