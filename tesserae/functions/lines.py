"""Texts about functions and files, put together from their facts by built-in expressions; absent facts leave their lines out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import djb2_hue

# Colours and descriptions of layers, and words of types that name no type of a project.
LAYERS = {
    "handler": ("#38bdf8", "Receives requests and kicks off the work"), "service": ("#10b981", "Business logic — the actual rules of the app"), "repository": ("#f59e0b", "Reads and writes data storage"),
    "middleware": ("#a855f7", "Runs on every request before it reaches handlers"), "config": ("#06b6d4", "Settings and environment setup"), "worker": ("#f97316", "Background jobs and scheduled tasks"),
    "blockchain": ("#f43f5e", "On-chain / smart contract interactions"), "observability": ("#ec4899", "Logging, metrics, tracing"), "auth": ("#e11d48", "Login, permissions, access control"),
    "utility": ("#64748b", "Shared helper functions"), "api": ("#6366f1", "External-facing interface"), "cli": ("#475569", "Command-line entry points"), "test": ("#d946ef", "Test code"),
    "core": ("#475569", "Core application code"), "root": ("#eab308", "Top-level project files"),
}
NO_TYPES = (
    "u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str string number boolean symbol bigint undefined null any unknown never void int float complex bytes list tuple dict set frozenset byte short long "
    "double rune error size_t ssize_t intptr_t uintptr_t String Number Boolean Object Array Function Promise Error Date RegExp mut const readonly self Self dyn impl typeof keyof extends implements"
).split()
# From which importance a function is marked, and how.
MARKS = ((0.7, " 🔥"), (0.3, " 📌"))


def _line(present: Column, *parts: Column | str) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(F.coalesce(present, F.lit(False)), text).otherwise("")


def _each(values: Column, head: str, before: str, after: str = "\n") -> Column:
    """The head and then each of the values between two texts; nothing without values."""
    return _line(F.size(values) > 0, head, F.array_join(F.transform(values, lambda x: F.concat(F.lit(before), x, F.lit(after))), ""))


def _some(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def compressed_function(name: Column, file: Column, line: Column, importance: Column, is_async: Column, doc: Column, params: Column, returns: Column, callees: Column) -> Column:
    """A function in the symbol notation: its name with marks, the first line of its documentation, place, input, output, calls."""
    high, some = MARKS
    mark = F.when(importance > high[0], high[1]).when(importance > some[0], some[1]).otherwise("")
    joined = lambda c, by: F.array_join(c, by)
    return F.concat(
        F.lit("ƒ "), name, mark, F.when(is_async, " ∂").otherwise(""), F.lit("\n"), _line(doc.isNotNull(), "  ", F.split_part(F.coalesce(doc, F.lit("")), F.lit("\n"), F.lit(1)), "\n"),
        F.lit("  📍 "), F.split_part(file, F.lit("/"), F.lit(-1)), F.lit(":"), line.cast("string"), F.lit("\n"),
        _line(F.size(params) > 0, "  📥 ", joined(params, ", "), "\n"), _line(F.size(returns) > 0, "  📤 ", joined(returns, ", "), "\n"), _line(F.size(callees) > 0, "  📞 ", joined(callees, " → "), "\n"), F.lit("\n"),
    )


def function_context(file: Column, line: Column, is_public: Column, is_async: Column, complexity: Column, params: Column, returns: Column, doc: Column, callees: Column, callers: Column) -> Column:
    """A function's facts and neighbours as a list for a chunk."""
    return F.concat(
        F.lit("- File: "), file, F.lit("\n- Line: "), line.cast("string"), F.lit("\n- Public: "), is_public.cast("string"), F.lit("\n- Async: "), is_async.cast("string"), F.lit("\n- Complexity: "), F.format_string("%.2f", complexity), F.lit("\n"),
        _each(_some(params), "- Parameters:\n", "  - "), _line(F.size(returns) > 0, "- Returns: ", F.array_join(returns, ", "), "\n"), _line(doc.isNotNull(), "- Documentation: ", doc, "\n"),
        _each(_some(callees), "- Calls:\n", "  - "), _each(_some(callers), "- Called by:\n", "  - "),
    )


def embedding_context(name: Column, file: Column, doc: Column, is_public: Column, is_async: Column, n_params: Column, returns: Column) -> Column:
    """A sentence about a function for an embedding model."""
    return F.concat(
        F.lit("Function "), name, F.lit(" in file "), file, F.lit(" "), _line(doc.isNotNull(), "with documentation: ", doc, " "), _line(is_public, "public "), _line(is_async, "async "),
        F.lit("with "), n_params.cast("string"), F.lit(" parameters "), _line(F.size(returns) > 0, "returning ", F.array_join(returns, ", ")),
    )


def skeleton_line(name: Column, params: Column, returns: Column, callees: Column) -> Column:
    """A function's signature and calls on one line of a file's skeleton."""
    return F.concat(F.lit("ƒ "), name, F.lit("("), F.array_join(_some(params), ", "), F.lit(")"), _line(returns.isNotNull(), "→", returns), F.lit(" {"), _line(F.size(callees) > 0, " 📞", F.array_join(callees, "→")), F.lit(" }"))


def signature_hash(name: Column, n_params: Column, n_returns: Column, is_public: Column, is_async: Column) -> Column:
    return F.sha2(F.concat(F.lit("sig:"), F.concat_ws("|", name, n_params.cast("string"), n_returns.cast("string"), is_public.cast("string"), is_async.cast("string"))), 256)


def type_names(of: Column) -> Column:
    """The distinct names in a type's text, sorted, less numbers and words that name no type of a project."""
    words = F.array_distinct(F.regexp_extract_all(of, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))
    return F.array_sort(F.filter(F.array_except(words, F.array(*map(F.lit, NO_TYPES))), lambda w: ~w.rlike("^[0-9]+$")))


def return_overlap(a: Column, b: Column) -> Column:
    """The share of the longer list that the first has in common with the second; 1 for two empty ones, repeats count."""
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(F.size(F.filter(a, lambda r: F.array_contains(b, r))) / F.greatest(F.size(a), F.size(b)))


def callee_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of callees; two functions without any have nothing in common."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def layer_colour(layer: Column) -> Column:
    """The layer's own colour, or one by the hash of its name."""
    out = None
    for name, (colour, _) in LAYERS.items():
        out = F.when(layer == name, colour) if out is None else out.when(layer == name, colour)
    return out.otherwise(F.concat(F.lit("hsl("), djb2_hue(layer).cast("string"), F.lit(", 70%, 54%)")))


def layer_description(layer: Column) -> Column:
    out = None
    for name, (_, text) in LAYERS.items():
        out = F.when(layer == name, text) if out is None else out.when(layer == name, text)
    return out.otherwise(F.concat(F.lit("Code under the `"), layer, F.lit("` module")))


def commit_time(commit: Column, known: Column) -> Column:
    """Seconds since 1970 for a commit that is written as a number (10 digits or more: as it stands), else the commit's known time.

    Shorter numbers can't be told from short hashes of digits but count as seconds; anything else without a known time is null.
    """
    number = F.when(commit.rlike("^[0-9]{1,18}$"), commit).cast("bigint")
    return F.coalesce(number, F.when(commit.rlike("^[0-9a-fA-F]{40}$"), known))


def shown_time(seconds: Column) -> Column:
    """The date of a time, as in `2024-01-31`; the session's zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def chunk_size(n_items: Column, workers: int, most: int = 1000) -> Column:
    """Items a chunk so that each worker gets two chunks, 1 at least and `most` at most."""
    return F.least(F.greatest(F.floor(n_items / (2 * workers)), F.lit(1)), F.lit(most))
