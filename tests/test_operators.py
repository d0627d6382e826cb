"""Graph, resolution, duplicates, verdicts, learning and the ledger on hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import frameworks, rules, vectors
from tesserae.functions import text as t
from tesserae.operators import dedup, graph, hierarchy, learn, order, references, report, resolve, state, verdict
from tesserae.streaming import ledger


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def pairs(df):
    return sorted(map(tuple, df.collect()))


CHAIN = [("a", "b"), ("b", "c"), ("d", "e")]


def test_chain(spark):
    e, root = edges(spark, CHAIN), spark.createDataFrame([("a",), ("z",)], "node string")
    assert pairs(graph.depth(e, root)) == [("a", 0), ("b", 1), ("c", 2), ("z", 0)]
    assert pairs(graph.nodes(e).join(graph.reach(e, root), "node", "left_anti")) == [("d",), ("e",)]
    assert pairs(graph.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert pairs(graph.levels(e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 1)]
    assert pairs(graph.depth(e, root, most=1)) == [("a", 0), ("b", 1), ("z", 0)]


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("a", "b")])
    assert pairs(graph.fan(e)) == [("a", 1, 2), ("b", 2, 1), ("c", 1, 1)]
    assert pairs(graph.scc(e)) == [("a", "a"), ("b", "a")]  # a self edge is no component
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": None, "b": None, "c": None}
    assert graph.scc(edges(spark, CHAIN)).count() == 0
    assert graph.components(edges(spark, [])).count() == 0


def test_scc_against_closure(spark):
    rnd = random.Random(7)
    for size in (12, 30):
        ps = [(rnd.randrange(size), rnd.randrange(size)) for _ in range(int(size * 1.4))]
        reach = {n: {n} for n in range(size)}
        for _ in range(size):
            for a, b in ps:
                for n in reach:
                    if a in reach[n]:
                        reach[n] = reach[n] | reach[b]
        want = sorted((n, min(m for m in reach[n] if n in reach[m])) for n in reach if any(m != n and n in reach[m] for m in reach[n]))
        assert pairs(graph.scc(spark.createDataFrame(ps, "src long, dst long"))) == want


def test_cascade(spark):
    calls = spark.createDataFrame([("c1", "f", "K", "run", None), ("c2", "f", None, "once", None), ("c3", "f", None, "twice", None), ("c4", "f", None, "far", "m"), ("c5", "g", None, "lone", None), ("c6", "g", None, "many", None), ("c7", "g", None, "gone", None)], "call string, file string, container string, name string, import string")
    defs = spark.createDataFrame([("t1", "f", "K", "run", "x"), ("t1b", "f", None, "run", "x"), ("t2", "f", None, "once", "x"), ("t3", "f", "A", "twice", "x"), ("t4", "f", "B", "twice", "x"), ("t5", "h", None, "far", "m"), ("t5b", "k", None, "far", "n"), ("t6", "h", None, "lone", "m"), ("t7", "h", None, "many", "m"), ("t8", "k", None, "many", "n")], "target string, file string, container string, name string, module string")
    got = {r.call: (r.target, r.method, r.confidence, r.status) for r in resolve.resolved(calls, defs).collect()}
    assert got == {
        "c1": ("t1", "scope", 1.0, "resolved"), "c2": ("t2", "same_file", 0.95, "resolved"), "c3": (None, "same_file", 0.95, "ambiguous"), "c4": ("t5", "import", 0.9, "resolved"), "c5": ("t6", "global", 0.7, "resolved"),
        "c6": (None, "global", 0.4, "ambiguous"), "c7": (None, None, 0.0, "unresolved"),
    }
    assert pairs(resolve.unique_by_name(defs.filter("name in ('once', 'many')"))) == [("many", None), ("once", "t2")]
    assert one(spark, *[resolve.bucket(F.lit(x)) for x in (0.9, 0.89, 0.7, 0.69)]) == ("Exact", "Inferred", "Inferred", "Heuristic")


def test_states_in_order(spark):
    got = one(spark, *[vectors.state(F.lit(s), 0.92) for s in (0.95, 0.80, 0.50, 0.20, 0.10, 0.92, 0.15)])
    assert got == ("DefinitelyDead", "ProbablyDead", "Unknown", "ProbablyAlive", "DefinitelyAlive", "DefinitelyDead", "DefinitelyAlive")


def test_verdicts(spark):
    rows = [("dead", 0, 0, False, False, None, 3.0, None, False, None), ("called", 12, 0, True, True, None, 3.0, None, False, None), ("forced", 0, 0, False, False, None, 3.0, None, True, 0.9), ("torn", 0, 0, False, False, None, 3.0, None, False, 0.1), ("rich", 1, 0, True, False, "Display", 60.0, "doc", False, None)]
    f = spark.createDataFrame(rows, "node string, fan_in long, fan_out long, reachable boolean, is_public boolean, trait_impl string, complexity double, doc string, dynamic boolean, ml_dead double")
    got = {r.node: r for r in verdict.verdicts(f).collect()}
    assert (got["dead"].static_score, got["dead"].state, got["dead"].recommendation) == (1.0, "DefinitelyDead", "SafeToDelete")
    assert (got["called"].static_score, got["called"].state, got["called"].recommendation) == (pytest.approx(0.0, abs=1e-12), "DefinitelyAlive", "DoNotDelete")
    assert (got["forced"].dead_score, got["forced"].recommendation, [c.severity for c in got["forced"].conflicts]) == (0.1, "DoNotDelete", ["Critical"])
    assert got["torn"].dead_score == pytest.approx(0.64) and [c.severity for c in got["torn"].conflicts] == ["High"] and got["torn"].recommendation == "ReviewRequired"
    core = (-0.4 * 0.1 - 0.3 + 0.2) / 0.9
    assert got["rich"].static_score == pytest.approx((core + 1) / 2 - (0.15 + 0.1 + 0.1) / 0.75 * 0.5)
    assert [s.name for s in got["rich"].signals] == ["fan_in", "reachability", "is_public", "trait_impl", "complexity", "documentation"]
    assert verdict.stats(verdict.verdicts(f.limit(0))).first().dead_ratio == 0


def test_every_dead_function_has_a_place(spark):
    rows = [(i, (i * 7 % 450) / 500, "DefinitelyDead" if i % 3 else "ProbablyDead" if i % 2 else "Unknown") for i in range(900)]
    got = verdict.removal_order(spark.createDataFrame(rows, "node long, dead_score double, state string")).collect()
    want = sorted((r for r in rows if r[2] != "Unknown"), key=lambda r: (-r[1], r[0]))
    assert len(want) > 200 and {r.node: r.place for r in got} == {r[0]: i for i, r in enumerate(want, 1)}


def test_consensus_and_thresholds(spark):
    n = F.lit(None).cast("double")
    x = lambda *v: dedup.consensus(*[n if s is None else F.lit(float(s)) for s in v])
    assert one(spark, x(0.8, 0.8, 0.8, None), x(0.8, 0.8, 0.1, None), x(0.8, None, None, 0.75), x(None, None, 0.9, None), x(0.74, 0.74, 0.9, 0.1)) == (True, False, True, False, False)
    assert one(spark, *[dedup.adaptive_threshold(F.lit(v)) for v in (51.0, 50.0, 20.0)], dedup.adaptive_threshold(n)) == (0.80, 0.85, 0.88, 0.85)


def test_short_bodies_and_classes(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a  b(c) d"), (3, "a b"), (4, ""), (5, "x y z w v"), (6, "a b c d e")], "id long, s string")
    assert pairs(dedup.classes(df, "id", "s")) == [(1, 1), (2, 1), (5, 5), (6, 6)]
    assert {r.id for r in dedup.signatures(df, "id", "s").collect()} == {1, 2, 5, 6}
    got = pairs(dedup.clusters(df, "id", "s", 0.8))
    assert [g for g in got if g[0] in (1, 2)] == [(1, 1), (2, 1)]


def test_text_expressions(spark):
    got = one(spark, t.levenshtein_ratio(F.lit("Kitten"), F.lit("sitting")), t.levenshtein_ratio(F.lit(""), F.lit("")), t.token_estimate(F.lit("a(b)1;;; cd")), t.djb2_hue(F.lit("core")), t.purpose(F.lit("rebuild_get")), t.category(F.lit("is_x")), t.truncated(F.lit("ab\ncd\nefgh"), 2), t.json_in(F.lit('x ```json\n{"a": 1}\n``` y')), t.module_path(F.lit("x/src/a/mod.rs")), t.module_path(F.lit("src/main.rs")))
    hue = 5381
    for b in b"core":
        hue = (hue * 33 + b) % 2**32
    assert got == (pytest.approx(1 - 3 / 7), 1.0, 2 + 1, hue % 360, "construction", "validator", "ab\ncd", '{"a": 1}', "crate::a", "crate")
    c = one(spark, t.line_complexity(F.lit("if a {\n  for b {\n  }\n}")), t.line_complexity(F.lit("")))
    assert (c.c0.complexity, c.c0.cyclomatic, c.c0.nesting) == (pytest.approx(1 + 0.5 + 0.5 + 2 * 0.2), 3.0, 2)
    assert (c.c1.complexity, c.c1.cyclomatic, c.c1.nesting) == (1.0, 1.0, 0)


def test_rules(spark):
    p = lambda name, file, public=False, doc=None: rules.protection(F.lit(name), F.lit(file), F.lit(False), F.lit(None).cast("string"), F.lit(public), F.lit(doc).cast("string"))
    got = one(spark, p("x", "a/tests/b.rs"), p("x", "a/b.pb.go"), p("main", "a.rs"), p("UserCard", "a.tsx"), p("useUser", "x.ts"), p("handleX", "x.js"), p("f", "src/lib.rs", True), p("f", "q/a.rs"), p("get_x", "q/a.rs"), p("__init__", "a.py"))
    assert got == ("Protected", "Protected", "Protected", "Protected", "Protected", "LikelyAlive", "LikelyAlive", "Candidate", "LikelyAlive", "Protected")
    assert one(spark, rules.layer_of(F.lit("src/utils/x.rs")), rules.layer_of(F.lit("x.rs")), rules.language_of(F.lit("a/b.tsx"))) == ("utility", "root", "typescript")


def test_areas_by_hand(spark):
    rnd = random.Random(1)
    rows = [(i, round(rnd.random(), 2), int(rnd.random() < 0.4)) for i in range(300)]
    s = sorted(rows, key=lambda r: (-r[1], r[0]))
    pos = sum(r[2] for r in rows)
    tp = fp = 0
    pr = roc = 0.0
    last = (1.0, 0.0, 0.0)
    for i, (_, _, y) in enumerate(s):
        tp, fp = tp + y, fp + 1 - y
        now = (tp / (tp + fp), tp / pos, fp / (len(rows) - pos))
        if i:
            pr += (now[1] - last[1]) * (now[0] + last[0]) / 2
            roc += (now[2] - last[2]) * (now[1] + last[1]) / 2
        last = now
    df = spark.createDataFrame(rows, "id long, p double, y int")
    got = learn.auc(df).first()
    assert (got.pr_auc, got.roc_auc) == (pytest.approx(pr), pytest.approx(roc))
    assert learn.auc(df.filter("y = 0")).first()[:] == (0.0, 0.0)
    places = {r.id: r.place for r in learn.ranked(df).collect()}
    assert [places[r[0]] for r in s] == list(range(1, 301))
    bins = learn.equal_count_bins(df.filter("id < 23"), 10)
    assert [r.n for r in bins.orderBy("bin").collect()] == [2] * 9 + [5]
    iso = learn.isotonic_bins(bins)
    assert all(a[2] <= b[2] for a, b in zip(iso, iso[1:], strict=False))


def test_fit_separates(spark):
    rows = [(i, float(i % 10), int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    model = learn.fit(df, ["x"], steps=30)
    assert learn.confusion(df.select("id", "y", learn.predict(model, ["x"]).alias("p"))).first().accuracy == 1.0
    best = learn.best_threshold(learn.threshold_grid(df.select("id", "y", (F.col("x") / 10).alias("p")), [0.3, 0.45, 0.5, 0.8]), 0.9).first()
    assert best.threshold == 0.45 and best.f1 == 1.0


def test_ledger(spark):
    rows = [(1, 1, 1, "analyse", 0.9), (1, 2, 2, "remove", None), (1, 3, 3, "analyse", 0.8), (2, 1, 4, "analyse", 0.5), (2, 2, 5, "keep", None), (3, 1, 6, "false_positive", None)]
    m = spark.createDataFrame([(i, a, s, k, c, None) for i, a, s, k, c in rows], "id long, at long, seq long, kind string, confidence double, note string")
    got = {r.id: (r.outcome, r.confidence, r.notes, r.n_mutations) for r in state.folded(m).collect()}
    assert got == {1: ("Pending", 0.8, state.NOTE, 3), 2: ("Kept", 0.5, None, 2), 3: ("FalsePositive", None, None, 1)}
    ledger = state.folded(m).select("id", "outcome", "confidence", "notes", "outcome_date")
    after = {r.id: (r.outcome, r.confidence, r.notes) for r in state.upsert(ledger, spark.createDataFrame([(2, 0.7), (9, 0.6)], "id long, confidence double")).collect()}
    assert after == {1: ("Pending", 0.8, state.NOTE), 2: ("Pending", 0.7, state.NOTE), 3: ("FalsePositive", None, None), 9: ("Pending", 0.6, None)}


def test_snapshots(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, hash string")
    d = state.diff(a, b)
    assert pairs(d) == [("w", "added"), ("x", "same"), ("y", "changed"), ("z", "removed")]
    assert state.scope(d).first()[:] == (3, 0.75, True)
    assert state.is_valid(a, a).first().valid and not state.is_valid(a, b).first().valid


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    got = one(spark, vectors.cosine(a(1, 0), a(1, 1)), vectors.cosine(a(0, 0), a(1, 1)), vectors.euclid(a(1, 2), a(4, 6)), vectors.euclid(a(1), a(1, 2)), vectors.jaccard(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))), vectors.sigmoid(F.lit(50.0)), vectors.with_temperature(F.lit(0.8), 2.0), vectors.valid_vector(a(1, math.inf), 2))
    assert got == (pytest.approx(2**-0.5), 0.0, 5.0, 1.0, 0.5, pytest.approx(1 / (1 + math.exp(-20))), pytest.approx(2 / 3), False)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "id long, s string")
    assert [r.line for r in report.markdown(df, ["id", "s"]).collect()] == ["| 1 | a b c |", "| 2 |  |"]
    assert report.markdown_head(["id", "s"]) == "| id | s |\n| --- | --- |"
    report.write_jsonl(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_chunks_hold_the_whole_text(spark):
    rnd = random.Random(4)
    texts = ["", None, "a\n", "x" * 8, "x" * 9, "\nabcdefghijk\n", "é" * 20, *("".join(rnd.choice("ab \n") for _ in range(rnd.randrange(60))) for _ in range(100))]
    df = spark.createDataFrame([(i, s, "t") for i, s in enumerate(texts)], "id long, s string, tag string")
    got = {}
    for r in report.rag_chunks(df, "id", "s", ["tag"], most_tokens=2).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.content)
        assert r.chunk == len(got[r.id]) - 1
    for i, s in enumerate(texts):
        want, rest = [], s
        while rest is not None and len(rest) > 8:
            at = rest.rfind("\n", 1, 8)
            want.append(rest[: at if at > 0 else 8])
            rest = rest[at + 1 if at > 0 else 8 :]
        assert got[i] == [*want, rest] if rest or not want else got[i] == want


def test_frameworks_and_references(spark):
    lit = F.lit
    got = one(spark, frameworks.is_marked(lit("python"), lit("@app.route('/')")), frameworks.is_root(lit("python"), lit("a/x.py"), lit("manage.py")), frameworks.is_root(lit("rust"), lit(None).cast("string"), lit("f")), frameworks.is_dynamic(lit("go"), lit("go func() {}")), frameworks.is_marked(lit("java"), lit("@Override")), frameworks.is_callback(lit("_close")))
    assert got == (True, True, False, True, False, True)
    src = spark.createDataFrame([("a.py", "python", "getattr(x, 'go'); getattr(y, 'go'); import_module('p.q')"), ("b.rs", "rust", "fn f(x: Box<dyn Shape>) {}"), ("c.js", "javascript", "")], "path string, language string, source string")
    refs = references.found(src)
    assert sorted((r.file, r.kind, r.target, r.n) for r in refs.collect()) == [("a.py", "dynamic_import", "p.q", 1), ("a.py", "reflection", "go", 2), ("b.rs", "trait_object", "Shape", 1)]
    f = spark.createDataFrame([(1, "go"), (2, "q"), (3, "p")], "node long, name string")
    assert {r.node for r in references.matched(refs, f).collect()} == {1, 2} and {r.node for r in references.matched(refs, f, contained=True).collect()} == {1, 2, 3}


def test_hierarchies(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert pairs(hierarchy.inheritance_depth(e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert pairs(hierarchy.leaves(e)) == [("c",), ("d",)]
    assert pairs(hierarchy.circular(e)) == [("x", "x"), ("y", "x")]
    files = spark.createDataFrame([("a",), ("z",)], "file string")
    assert pairs(hierarchy.unimported(files, e)) == [("z",)]


def test_places_with_many_equal_scores(spark):
    rows = [(i, 0.5 if i % 3 else i / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p double")
    got = {r.id: r.place for r in order.placed(df, F.desc("p"), F.asc("id")).collect()}
    assert [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 301))
    assert order.placed(df.limit(0), F.asc("id")).count() == 0


def test_streams(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(i % 3, day + dt.timedelta(hours=7 * i), i, "analyse" if i % 2 else "remove", 0.1 * i, None) for i in range(20)]
    m = spark.createDataFrame(rows, ledger.MUTATION)
    for k in range(4):
        m.filter(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ledger.mutations(spark, str(tmp_path / "in"), files_a_batch=1)
    ledger.follow(s, str(tmp_path / "log"), str(tmp_path / "ledger"), str(tmp_path / "check")).awaitTermination()
    assert pairs(ledger.latest(spark, str(tmp_path / "ledger"))) == pairs(state.folded(m))
    q = ledger.counts(ledger.mutations(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.kind): r.n for r in spark.table("counts").collect()} == {(r.d, r.kind): r.n for r in m.groupBy(F.date_trunc("day", "at").alias("d"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
