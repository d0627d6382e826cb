"""The feature registry of the dead-code model: 224 named numbers of a function, as one projection of built-in expressions.

`registry()` lists the features in the order of the vector. Each is an expression over the columns of FACTS; a frame that
lacks some of them can be completed by `with_facts`. Anything null counts as absent: no source holds nothing, no decorators
match nothing, no callers are none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions.rules import ends
from tesserae.functions.vectors import LANGUAGES

#: The columns that features are made of, and their types.
FACTS = {
    "name": "string", "file": "string", "language": "string", "source": "string", "doc": "string", "container": "string", "trait_impl": "string", "params": "array<string>", "returns": "array<string>", "decorators": "array<string>",
    "fan_in": "double", "fan_out": "double", "depth": "double", "complexity": "double", "is_cycle": "boolean", "is_public": "boolean", "is_async": "boolean", "is_method": "boolean", "is_trait_method": "boolean",
}

# What names hold (in lower case), start with and end with.
NAME_HOLDS = (
    "use test init get set new create build parse validate handle process convert commit reveal submit upload download fetch verify audit main start run load save read write open close connect send receive delete update "
    "patch put post list find search filter map reduce clone copy move swap sort is has can should will do make take give call apply register unregister subscribe unsubscribe"
).split()
NAME_STARTS = "use test bench get set is has can should will on handle process parse create build make do apply".split()
NAME_ENDS = "test handler processor service repository controller manager factory builder validator converter mapper filter loader saver creator updater deleter finder parser renderer serializer".split()
DECORATORS = "route get post put delete patch override staticmethod classmethod property cached_property pytest fixture parametrize test".split()
# Ways in which a source shows a feature; of one way all texts must occur.
SOURCE_SHOWS = {
    "is_generator": [("yield",)],
    "is_flask_route": [("@app.route",), ("@router.route",)],
    "is_fastapi_route": [("@app.get",), ("@app.post",), ("@app.put",), ("@router.get",), ("@router.post",)],
    "is_express_route": [("app.get",), ("app.post",), ("app.put",), ("router.get",), ("router.post",)],
    "is_nextjs_route": [("export default", "Page"), ("export default", "Component")],
    "is_spring_controller": [("@RestController",), ("@Controller",), ("@GetMapping",), ("@PostMapping",)],
    "is_aspnet_controller": [("[ApiController]",), ("[HttpGet",), ("[HttpPost",)],
    "is_laravel_controller": [("use Illuminate\\Http\\Request", "class", "Controller")],
    "is_django_view": [("def ", "request"), ("def ", "HttpResponse")],
    "is_rails_action": [("def ", "render")],
    "is_go_goroutine": [("go ", "func(")],
    "is_rust_ffi": [('extern "C"',), ("#[no_mangle]",)],
    "has_generics": [("<", ">")],
    "has_type_annotation": [(":",)],
    "has_lifetime": [("'",)],
    "has_dynamic_call": [("getattr",), ("setattr",), ("hasattr",), ("importlib",), ("__import__",), ("reflect",), ("MethodByName",), ("call_user_func",)],
    "has_ffi": [("#[no_mangle]",), ("extern", "C"), ("ffi",)],
    "has_macro": [("macro_rules",), ("#[derive",), ("proc_macro",)],
    "has_closure": [("||",), ("lambda",), ("=>",)],
    "has_yield": [("yield",)],
    "has_await": [("await",)],
    "has_thread": [("tokio::spawn",), ("thread::spawn",), ("go ",), ("async_std::spawn",)],
    "has_try_catch": [("try", "catch"), ("try:", "except")],
    "has_throw": [("throw",), ("raise",)],
    "has_panic": [("unwrap",), ("expect",), ("panic",)],
    "has_question_mark": [("?",)],
    "has_error_propagation": [("?",), ("try!",), ("catch",)],
    "has_borrow": [("&",)],
    "has_mut_ref": [("&mut",)],
    "has_move": [("move",)],
    "has_clone": [("clone",), ("Clone",)],
    "has_channel": [("channel",), ("mpsc",), ("watch",)],
    "has_mutex": [("Mutex",), ("RwLock",)],
    "has_atomic": [("Atomic",), ("Ordering",)],
    "has_parallel": [("rayon",), ("par_iter",), ("parallel",)],
}
# Texts whose presence rules the feature out.
SOURCE_EXCLUDES = {"is_rails_action": "private", "has_type_annotation": "::", "has_borrow": "&mut"}
# What files hold and end with, by feature.
FILE_PARTS = {
    "is_in_test_file": (("/test/", "/tests/"), ("_test.rs", "_test.go", "_test.py", ".test.ts", ".test.js", "_test.dart", "Test.java")),
    "is_in_benches": (("/benches/",), ("_bench.rs", "_bench.go")),
    "is_in_meta": (("/.meta/",), ()),
    "is_in_examples": (("/examples/", "/example/"), ()),
    "is_generated": ((".gen.", "_gen.", ".generated.", ".pb.go", "_pb2.py"), (".g.dart", ".freezed.dart")),
    "is_in_lib": (("/lib/", "/src/lib"), ("lib.rs",)),
    "is_in_bin": (("/bin/", "/cmd/"), ("main.rs",)),
    "is_in_proto": (("/proto/", "/protobuf/"), (".proto", ".pb.go")),
    "is_in_migrations": (("/migrations/", "/db/migrate/"), ()),
    "is_in_fixtures": (("/fixtures/", "/testdata/"), ()),
}
# Features with a place in the vector that are always 0, and parts of a return type that may fail.
NEVER = {"Framework": ("is_vue_component", "is_svelte_component"), "Documentation": ("has_attr_doc",), "Pattern": tuple(f"pattern_{p}" for p in ("singleton", "factory", "builder", "observer", "strategy", "decorator"))}
FALLIBLE = ("Result", "Option", "Either", "?")
FLUTTER_STATE = ("initState", "dispose", "didUpdateWidget", "didChangeDependencies")
RECEIVERS = ("self", "&self", "&mut self")


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    value: Column


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _held(texts: Column, *parts: str) -> Column:
    return F.exists(texts, lambda x: _any([x.contains(p) for p in parts]))


def shows(source: Column, name: str) -> Column:
    """Whether a source shows the named feature of SOURCE_SHOWS."""
    ways = []
    for way in SOURCE_SHOWS[name]:
        cond = source.contains(way[0])
        for part in way[1:]:
            cond = cond & source.contains(part)
        ways.append(cond)
    out = _any(ways)
    return out & ~source.contains(SOURCE_EXCLUDES[name]) if name in SOURCE_EXCLUDES else out


def _in_file(file: Column, name: str) -> Column:
    parts, tails = FILE_PARTS[name]
    return _any([file.contains(p) for p in parts] + ([ends(file, *tails)] if tails else []))


def brace_depth(source: Column) -> Column:
    """The deepest nesting by lines: a line with an opening brace is one deeper, one with a closing brace one less, never under 0."""
    step = lambda at, line: at + line.contains("{").cast("int")
    down = lambda at, line: F.greatest(at - line.contains("}").cast("int"), F.lit(0))
    both = F.aggregate(t.lines(source), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda a, x: F.struct(down(step(a["at"], x), x).alias("at"), F.greatest(a["most"], down(step(a["at"], x), x)).alias("most")))
    return both["most"]


def registry() -> list[Feature]:
    """All features by place."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "file", "language", "source", "doc", "container")}
    name, file, source = text["name"], text["file"], text["source"]
    many = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("params", "returns", "decorators")}
    params, returns, decorators = many.values()
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_cycle", "is_public", "is_async", "is_method", "is_trait_method")}
    number = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("fan_in", "fan_out", "depth", "complexity")}
    in_trait = F.col("trait_impl").isNotNull()
    decorated = lambda *parts: _held(decorators, *parts)
    receives = F.exists(params, lambda p: p.isin(*RECEIVERS))
    out: list[Feature] = []

    def flags(category: str, **values: Column) -> None:
        out.extend(Feature(n, category, c.cast("double")) for n, c in values.items())

    def capped(category: str, most: float, **values: Column) -> None:
        out.extend(Feature(n, category, F.least(c / most, F.lit(1.0))) for n, c in values.items())

    def shown(category: str, *names: str) -> None:
        flags(category, **{n: shows(source, n) for n in names})

    def never(category: str, *names: str) -> None:
        flags(category, **{n: F.lit(False) for n in names})

    capped("Graph", 50.0, fan_in=number["fan_in"], fan_out=number["fan_out"])
    capped("Graph", 10.0, call_depth=number["depth"])
    flags("Graph", is_cycle=flag["is_cycle"])
    capped("Signature", 10.0, param_count=F.size(params))
    capped("Signature", 5.0, return_count=F.size(returns))
    flags("Signature", is_public=flag["is_public"], is_async=flag["is_async"])
    shown("Signature", "is_generator")
    flags("Signature", is_static=decorated("staticmethod", "classmethod") | name.contains("static"), is_abstract=decorated("abstract", "virtual") | flag["is_trait_method"], is_override=decorated("override") | in_trait | flag["is_trait_method"])
    capped("Complexity", 50.0, cyclomatic_complexity=number["complexity"])
    capped("Complexity", 20.0, cognitive_complexity=brace_depth(source))
    capped("Complexity", 100.0, line_count=F.size(t.lines(source)))
    capped("Complexity", 500.0, token_count=F.size(F.array_remove(F.split(source, "[ \t\n\r\f]+"), "")))
    lower = F.lower(name)
    flags("Name", **{f"contains_{w}": lower.contains(w) for w in NAME_HOLDS})
    flags("Name", **{f"starts_with_{w}": name.startswith(w) for w in NAME_STARTS})
    flags("Name", **{f"ends_with_{w}": name.endswith(w) for w in NAME_ENDS})
    capped("Name", 50.0, name_length=F.octet_length(name))
    flags("Language", **{f"is_{x}": text["language"] == x for x in LANGUAGES})
    shown("Framework", *[f"is_{x}" for x in ("flask_route", "fastapi_route", "express_route", "nextjs_route", "spring_controller", "aspnet_controller", "laravel_controller", "django_view", "rails_action")])
    flags("Framework", is_react_component=name.rlike(r"^\p{Lu}") & ends(file, ".tsx", ".jsx"), is_react_hook=name.rlike(r"^use\p{Lu}"))
    never("Framework", *NEVER["Framework"])
    dart, go = file.endswith(".dart"), file.endswith(".go")
    flags("Framework", is_flutter_widget=(name == "build") & dart & F.coalesce(F.col("trait_impl").contains("Widget"), F.lit(False)), is_flutter_state=name.isin(*FLUTTER_STATE) & dart, is_go_init=(name == "init") & go, is_go_interface=in_trait & go)
    shown("Framework", "is_go_goroutine")
    flags("Framework", is_rust_trait_impl=in_trait & file.endswith(".rs"))
    shown("Framework", "is_rust_ffi")
    flags("Type", is_method=flag["is_method"], is_trait_impl=F.col("container").isNotNull(), is_associated=in_trait)
    flags("Type", has_receiver=receives | (go & F.coalesce(F.try_element_at(params, F.lit(1)).contains("*"), F.lit(False))), has_self=receives | name.contains("self"))
    out.extend(Feature(n, "Type", F.octet_length(F.coalesce(F.col(c), F.lit(""))) / 20.0) for n, c in (("type_name_length", "container"), ("trait_name_length", "trait_impl")))
    flags("Type", type_and_trait_match=F.coalesce(F.col("container") == F.col("trait_impl"), F.lit(False)))
    shown("Generics", "has_generics")
    capped("Generics", 5.0, generic_count=t.count_of(source, "<"))
    shown("Type", "has_type_annotation", "has_lifetime")
    flags("File", **{n: _in_file(file, n) for n in FILE_PARTS})
    lowered = F.transform(decorators, F.lower)
    flags("Decorator", **{f"has_decorator_{w}": _held(lowered, w) for w in DECORATORS})
    shown("Dynamic", "has_dynamic_call", "has_ffi", "has_macro", "has_closure", "has_yield", "has_await")
    shown("Concurrency", "has_thread")
    shown("ErrorHandling", "has_try_catch")
    flags("ErrorHandling", has_result_type=_held(returns, *FALLIBLE))
    shown("ErrorHandling", "has_throw", "has_panic", "has_question_mark", "has_error_propagation")
    flags("Documentation", has_doc_comment=F.col("doc").isNotNull())
    capped("Documentation", 100.0, doc_comment_length=F.octet_length(text["doc"]))
    never("Documentation", *NEVER["Documentation"])
    never("Visibility", "vis_pub_crate", "vis_pub_super", "vis_pub_self")
    flags("Visibility", vis_private=~flag["is_public"], vis_protected=F.lit(False))
    shown("Ownership", "has_borrow", "has_mut_ref", "has_move", "has_clone")
    never("Pattern", *NEVER["Pattern"])
    shown("Concurrency", "has_channel", "has_mutex", "has_atomic", "has_parallel")
    return out


def with_facts(df: DataFrame) -> DataFrame:
    """df with each column of FACTS that it lacks as null, and those that it has in their types."""
    return df.withColumns({c: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind) for c, kind in FACTS.items()})


def feature_vector(registered: list[Feature] | None = None) -> Column:
    """The whole vector over the columns of FACTS."""
    return F.array(*[f.value for f in registered or registry()])


def names_hash(names: list[str]) -> str:
    """Identifies a list of feature names: 16 hexadecimal digits over all of them, a line each."""
    import hashlib

    return hashlib.sha256("".join(f"{n}\n" for n in names).encode()).hexdigest()[:16]


def incompatible(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """place, ours, theirs where two registries (place, name, category) differ, missing places included; empty if compatible."""
    a, b = (df.select("place", F.concat_ws(":", "name", "category").alias(n)) for df, n in ((ours, "ours"), (theirs, "theirs")))
    return a.join(b, "place", "full").filter(~F.col("ours").eqNullSafe(F.col("theirs")))
