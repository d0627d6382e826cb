"""Rules about names and paths, as boolean expressions and first-match chains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and parts of paths.
BOILERPLATE = (
    "default", "clone", "fmt", "from", "into", "try_from", "try_into", "new", "len", "is_empty", "reset", "clear", "as_ref", "as_mut", "drop", "to_string", "to_json", "to_jsonl", "to_markdown",
    "to_feature_vector", "node_count", "edge_count", "iter_nodes", "iter_edges", "file_paths", "function_names", "file_count", "function_count", "call_edge_count",
)
ACCESSORS = ("get_", "set_", "is_", "has_", "push_")
ENTRY_POINTS = ("main", "async_main", "run", "start", "init", "setup")
TEST_PARTS = ("/test/", "/tests/")
TEST_ENDS = ("_test.dart", "_test.go", "_test.rs", "_test.py", ".test.js", ".test.ts", "_test.java", "Test.java", "_test.cs")
GENERATED_PARTS = (".gen.", "_gen.", ".g.", ".freezed.", ".gr.", "/generated/", "/gen/")
GENERATED_ENDS = (".g.dart", ".freezed.dart", ".gr.dart", ".reflectable.dart", ".part.dart", ".pb.go", "_pb2.py", ".gen.go")
EXAMPLE_PARTS, EXAMPLE_ENDS = ("/example/", "/examples/"), (".example.dart",)
BUILD_PARTS = ("/build/", "/.dart_tool/", "/.pub-cache/", "/node_modules/", "/target/", "/.cxx/", "/CMakeFiles/", "/android/app/build/", "/ios/Pods/", "/ios/DerivedData/")
FRAMEWORK_PARTS = (
    ".controller.", ".service.", ".module.", ".guard.", ".strategy.", ".interceptor.", ".pipe.", ".filter.", ".tsx", ".jsx", ".vue", ".svelte", "/components/", "/pages/", "/hooks/", "/composables/",
    "/providers/", "/contexts/", "/layouts/", "/tests/", "/test/", "/bench/", "/benches/", "/generated/", "/gen/", "/proto/", "/protobuf/", "/admin/", "/management/", "/migrations/", "/serializers/",
    "/permissions/", "/throttling/", "/traits/", "/trait/", "/impls/", "/derive/",
)
EXTENSION_PARTS = ("/extensions/", "/intellij/", "/vscode/", "/zed/", "/plugins/", "/.vscode/")
TEMPLATE_PARTS, TEMPLATE_ENDS = ("/templates/", "/bricks/"), (".template.dart", ".template.ts", ".template.js", ".template.java", ".template.kt")
CONSTANT_PARTS = ("DEFAULT_", "MAX_", "MIN_", "FILE_NAME", "VERSION", "TIMEOUT", "RETRY", "_FILE", "_PATH", "_NAME", "PUBSPEC", "ANALYSIS_OPTIONS", "_LOCK_FILE", "_VALUE", "_COUNT", "_DELAY", "_MS")
LANGUAGE_OF = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "dart": "dart", "php": "php", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "cpp", "cs": "csharp"}
LAYERS = {
    "handler": ("handlers", "handler", "controllers", "controller"), "service": ("services", "service"), "repository": ("repositories", "repository", "models", "model", "db"), "middleware": ("middleware", "middlewares"),
    "config": ("config", "configs", "settings"), "worker": ("workers", "worker", "jobs", "tasks"), "auth": ("auth",), "utility": ("utils", "util", "helpers", "common"), "api": ("api",), "cli": ("cli", "bin", "cmd"),
    "test": ("test", "tests"), "core": ("core",), "migration": ("migrations", "migration"), "routes": ("routes",),
}


def holds(c: Column, *parts: str) -> Column:
    """Whether c holds one of these texts."""
    return c.rlike("|".join(map(re.escape, parts)))


def ends(c: Column, *tails: str) -> Column:
    return c.rlike("(" + "|".join(map(re.escape, tails)) + ")$")


def starts(c: Column, *heads: str) -> Column:
    return c.rlike("^(" + "|".join(map(re.escape, heads)) + ")")


def is_test_file(f: Column) -> Column:
    return holds(f, *TEST_PARTS) | ends(f, *TEST_ENDS)


def is_generated(f: Column) -> Column:
    return holds(f, *GENERATED_PARTS, *BUILD_PARTS) | ends(f, *GENERATED_ENDS)


def is_example(f: Column) -> Column:
    return holds(f, *EXAMPLE_PARTS) | ends(f, *EXAMPLE_ENDS)


def is_template(f: Column) -> Column:
    return holds(f, *TEMPLATE_PARTS) | ends(f, *TEMPLATE_ENDS)


def is_extension(f: Column) -> Column:
    return holds(f, *EXTENSION_PARTS)


def is_framework_file(f: Column) -> Column:
    return holds(f, *FRAMEWORK_PARTS)


def is_constant_name(name: Column) -> Column:
    return name.rlike("^[\\p{Lu}_]+$") | holds(name, *CONSTANT_PARTS)


def language_of(f: Column) -> Column:
    ext = F.element_at(F.split(f, "\\."), -1)
    out = F.lit("unknown")
    for e, lang in LANGUAGE_OF.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def layer_of(f: Column) -> Column:
    """The layer that the parent directory names, else the directory itself."""
    parent = F.coalesce(F.try_element_at(F.split(f, "/"), F.lit(-2)), F.lit("root"))
    out = parent
    for layer, names in LAYERS.items():
        out = F.when(parent.isin(*names), layer).otherwise(out)
    return out


def false_positive(name: Column, trait_impl: Column, n_lines: Column, n_tokens: Column) -> Column:
    """Whether a duplicate is boilerplate: by name, as part of a trait, or for its shortness."""
    short_accessor = starts(name, *ACCESSORS) & ((n_lines <= 6) | (n_tokens <= 15))
    return name.isin(*BOILERPLATE) | trait_impl.isNotNull() | name.startswith("with_") | short_accessor | (n_lines < 5) | (n_tokens < 18)


def protection(name: Column, file: Column, is_test: Column, trait_impl: Column, is_public: Column, doc: Column) -> Column:
    """Protected, LikelyAlive or Candidate; the first rule that fits decides."""
    language = language_of(file)
    script = language.isin("javascript", "typescript")
    component = script & ends(file, ".tsx", ".jsx") & name.rlike("^\\p{Lu}")
    return (
        F.when(is_test | is_test_file(file), "Protected")
        .when(is_generated(file) | is_example(file) | is_template(file) | is_extension(file), "Protected")
        .when(trait_impl.isNotNull(), "Protected")
        .when(holds(F.concat_ws(" ", doc, name), "no_mangle", "extern", "#[export", "wasm_bindgen", "pyfunction", "ffi"), "Protected")
        .when(name.isin(*ENTRY_POINTS), "Protected")
        .when(is_framework_file(file), "Protected")
        .when((language == "python") & name.rlike("^__.*__$"), "Protected")
        .when(component | (script & name.rlike("^use\\p{Lu}")), "Protected")
        .when(script & starts(name, "handle", "on"), "LikelyAlive")
        .when(is_public & holds(file, "lib.rs", "mod.rs", "lib/", "src/"), "LikelyAlive")
        .when(name.isin(*BOILERPLATE) | starts(name, *ACCESSORS, "with_") | is_constant_name(name), "LikelyAlive")
        .otherwise("Candidate")
    )


def root_kind(is_test: Column, name: Column, file: Column, is_public: Column, doc: Column) -> Column:
    """test, ffi, framework, export or application; the first that fits, else null."""
    return (
        F.when(is_test | is_test_file(file) | starts(name, "test_", "bench_"), "test")
        .when(holds(F.concat_ws(" ", doc, name), "no_mangle", "extern", "ffi"), "ffi")
        .when(is_framework_file(file), "framework")
        .when(is_public, "export")
        .when(name.isin(*ENTRY_POINTS), "application")
    )
