"""Small judgements about names, files, labels and verdicts, as expressions over tables of fixed values.

A table lists, in the order in which they are tried, texts and what a name that holds (or starts with) one of them is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.rules import ACCESSORS, BOILERPLATE, ends, holds, starts

# Roles by what a name holds, actions by how it starts, kinds of comments by what they hold.
ROLES = [
    ("EntryPoint", ("main", "entry")), ("Handler", ("handler", "controller")), ("Service", ("service", "domain")), ("Repository", ("repo", "repository", "dao")), ("Utility", ("util", "helper")),
    ("Validator", ("validate", "check")), ("Factory", ("factory", "create", "build")), ("Converter", ("convert", "transform", "map")), ("Middleware", ("middleware",)),
]
ACTIONS = [
    ("Gets", ("get",)), ("Sets", ("set",)), ("Creates", ("create", "build")), ("Updates", ("update", "modify")), ("Deletes", ("delete", "remove")), ("Validates", ("validate",)), ("Parses", ("parse",)),
    ("Converts", ("convert", "transform")), ("Handles", ("handle",)), ("Processes", ("process",)), ("Initializes", ("init", "initialize")),
]
COMMENTS = [("Todo", ("todo", "to do")), ("FIXME", ("fixme", "fix me")), ("HACK", ("hack", "workaround")), ("NOTE", ("note",)), ("Warning", ("warning", "caution"))]
ACTION_ITEMS = ("Todo", "FIXME", "HACK")
# Label sources from the surest to the least sure with training weight, confidence multiplier, priority.
LABEL_SOURCES = [
    ("ProductionVerified", 1.0, 1.0, 7), ("HumanVerified", 0.95, 0.98, 6), ("GitVerified", 0.85, 0.95, 5), ("DatasetVerified", 0.80, 0.92, 4), ("Silver", 0.30, 0.75, 3), ("StaticHeuristic", 0.0, 0.60, 2), ("Weak", 0.0, 0.40, 1),
]
VERIFIED = ("ProductionVerified", "HumanVerified", "GitVerified", "DatasetVerified")
# Names that a whitelist holds, and how others start.
WHITELIST = ("main", "async_main", "run", "start", "init", "default", "clone", "drop", "handleInvoke")
WHITELIST_STARTS = ("test_", "bench_")
SNIPPETS, GENERATORS, COMMANDS = ("snippet", "Snippet"), ("generate", "Generator", "generator", "create", "build"), ("command", "Command", "Action", "Handler")
TEST_NAMES = ("test_", "Test", "bench_", "Benchmark", "Example")
BINARY_PARTS = ("/bin/", "/benches/", "/cli/", "/cmd/")
INTEGRATION_PARTS = ("/generated/", "/examples/", "/extensions/", "/plugins/")
ENTRY_DOCS = ("#[tokio::main]", "#[async_std::main]", "entry point")
# Colours of nodes.
COLOURS = {"test": "#8e44ad", "trait": "#2ecc71", "dead": "#e74c3c", "public": "#3498db", "important": "#f39c12", "plain": "#95a5a6"}
NO_LAYER = "#475569"


def _first(text: Column, table: list[tuple[str, tuple[str, ...]]], fits, otherwise: str) -> Column:  # noqa: ANN001
    out = None
    for value, words in table:
        out = F.when(fits(text, *words), value) if out is None else out.when(fits(text, *words), value)
    return out.otherwise(otherwise)


def role(name: Column) -> Column:
    return _first(F.lower(name), ROLES, holds, "Unknown")


def action(name: Column) -> Column:
    return _first(F.lower(name), ACTIONS, starts, "Performs")


def subject(name: Column) -> Column:
    """The second part of a name in snake case, null without one."""
    return F.try_element_at(F.split(name, "_"), F.lit(2))


def purpose(name: Column, returns: Column) -> Column:
    """A sentence: what the name says that is done, to what, and what is returned."""
    said = F.concat_ws(" ", action(name), F.coalesce(subject(name), F.lit("data")))
    return F.when(returns.isNotNull(), F.concat(said, F.lit(" and returns "), returns)).otherwise(said)


def comment_kind(comment: Column) -> Column:
    return _first(F.lower(comment), COMMENTS, holds, "Line")


def whitelisted(name: Column, path: Column, more: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> Column:
    """By name, start of the name or build script; `more` and `without` change the list."""
    names = [n for n in (*WHITELIST, *more) if n not in without]
    return name.isin(*names) | starts(name, *WHITELIST_STARTS) | path.contains("build.rs")


def is_snippet(name: Column) -> Column:
    return holds(name, *SNIPPETS)


def is_generator(name: Column) -> Column:
    return holds(name, *GENERATORS) | name.endswith("Factory")


def is_command(name: Column) -> Column:
    return holds(name, *COMMANDS)


def is_test_name(name: Column) -> Column:
    return starts(name, *TEST_NAMES)


def is_binary_only(file: Column) -> Column:
    return holds(file, *BINARY_PARTS) | file.startswith("src/bin/") | file.endswith("main.rs")


def is_entry_point(fan_in: Column, file: Column, is_async: Column, doc: Column) -> Column:
    """Whether a function without callers is one by its file, for being asynchronous or by its documentation."""
    by_doc = F.coalesce(holds(doc, *ENTRY_DOCS), F.lit(False))
    return (fan_in == 0) & (file.contains("/bin/") | file.endswith("main.rs") | is_async | by_doc)


def protection_reason(level: Column, file: Column, name: Column, is_test: Column, trait_impl: Column, is_public: Column, fan_in: Column, fan_out: Column) -> Column:
    """Why a function is left out, null for a candidate."""
    kept = F.when(is_test, "test_function").when(trait_impl.isNotNull(), "trait_implementation").when(holds(file, *INTEGRATION_PARTS), "generated_or_integration_surface").otherwise("ffi_or_framework")
    alive = F.when(is_public, "public_api").when(fan_in > 0, "has_callers").when(fan_out > 0, "participates_in_call_flow").when(starts(name, "with_", "get_", "set_", "is_", "has_"), "conventional_api_shape").otherwise("protected_pattern")
    return F.when(level == "Protected", F.concat(F.lit("protected: "), kept)).when(level == "LikelyAlive", F.concat(F.lit("likely_alive: "), alive))


def is_never_dead(level: Column) -> Column:
    return level == "Protected"


def is_likely_alive(level: Column) -> Column:
    return level.isin("Protected", "LikelyAlive")


def is_actionable(level: Column) -> Column:
    return level == "Candidate"


def review_first(level: Column, is_public: Column, complexity: Column) -> Column:
    return is_actionable(level) & (is_public | (complexity > 10))


def _of_source(source: Column, at: int, otherwise) -> Column:  # noqa: ANN001
    out = F.lit(otherwise)
    for row in LABEL_SOURCES:
        out = F.when(source == row[0], row[at]).otherwise(out)
    return out


def training_weight(source: Column) -> Column:
    return _of_source(source, 1, 0.0)


def confidence_multiplier(source: Column) -> Column:
    return _of_source(source, 2, 0.0)


def label_priority(source: Column) -> Column:
    return _of_source(source, 3, 0)


def is_verified(source: Column) -> Column:
    return source.isin(*VERIFIED)


def is_trainable(source: Column, label: Column, silver: bool = False) -> Column:
    """Whether an example is fit for training: a known label of a verified source, or of the silver one if wanted."""
    return (label != "Unknown") & source.isin(*VERIFIED, *(("Silver",) if silver else ()))


def file_dead_confidence(file: Column, n_exports: Column) -> Column:
    test = holds(file, "/tests/", "/test/") | file.endswith("_test.rs")
    binary = file.contains("/bin/") | file.startswith("src/bin/")
    out = F.lit(0.8)
    for cond, factor in ((n_exports > 5, 0.9), (test, 0.5), (binary, 0.4), (file.endswith("lib.rs"), 0.7)):
        out = out * F.when(cond, factor).otherwise(1.0)
    return out


def type_dead_confidence(name: Column, depth: Column, has_subtypes: Column) -> Column:
    out = F.lit(0.7)
    for cond, change in ((holds(name, "test", "Test"), -0.2), (holds(name, "<", "["), 0.1), (depth > 0, -0.2), (has_subtypes, -0.2)):
        out = out + F.when(cond, change).otherwise(0.0)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def node_size(importance: Column, complexity: Column) -> Column:
    return (10 + F.floor(importance * 20) + F.floor(complexity / 5)).cast("int")


def node_colour(is_test: Column, trait_impl: Column, is_dead: Column, is_public: Column, importance: Column, layer_colour: Column) -> Column:
    c = COLOURS
    of_layer = (layer_colour != "") & (layer_colour != NO_LAYER)
    return F.when(is_test, c["test"]).when(trait_impl.isNotNull(), c["trait"]).when(is_dead, c["dead"]).when(is_public, c["public"]).when(importance > 0.7, c["important"]).when(of_layer, layer_colour).otherwise(c["plain"])


def advice(state: Column, overall_risk: Column) -> Column:
    """What to do, in a sentence."""
    dead = F.when(overall_risk == "Low", "Safe to remove: low risk, low impact").when(overall_risk == "Medium", "Consider removing: medium risk, review dependencies").when(overall_risk == "High", "Proceed with caution: high risk, requires careful review")
    dead = dead.otherwise("Do not remove without team review: critical function")
    return F.when(state.endswith("Dead"), dead).when(state.endswith("Alive"), "Function is alive: keep as is").otherwise("Unknown: investigate manually")


def is_duplicate_candidate(name: Column, n_lines: Column) -> Column:
    """Whether a duplicate is worth acting on: four lines or more and no boilerplate, accessor or builder."""
    return (n_lines >= 4) & ~name.isin(*BOILERPLATE) & ~starts(name, *ACCESSORS, "with_")


def ends_as_test(file: Column) -> Column:
    return holds(file, "/tests/", "/test/") | ends(file, "_test.rs", "_test.go", "_test.py", "test.js", "test.ts", "_test.dart", "Test.java")
