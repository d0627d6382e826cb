"""Parsing source code into nested rows of functions, calls, imports and types.

Python goes through its own parser, other languages through a lexer that blanks comments and strings, matches braces
and finds definitions by pattern. Files are parsed in Arrow batches; a file that fails is one row with its error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.iterate import ship

FUNCTION = (
    "struct<name:string,container:string,line:bigint,end_line:bigint,is_public:boolean,is_async:boolean,is_test:boolean,trait_impl:string,params:array<string>,returns:array<string>,complexity:double,"
    "doc:string,decorators:array<string>,calls:array<struct<kind:string,qualifier:string,name:string,line:bigint>>,body:string>"
)
PARSED = f"path string, language string, functions array<{FUNCTION}>, imports array<struct<module:string,items:array<string>,line:bigint>>, types array<struct<name:string,kind:string,line:bigint,supers:array<string>>>, error string"


@dataclass(frozen=True)
class Grammar:
    function: str
    types: str
    imports: str
    line_comment: str = "//"


# How each language writes functions, types and imports.
C_LIKE = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|inline|const|synchronized|sealed|unsafe|extern)\s+)*)(?P<ret>[A-Za-z_][\w<>\[\],.?:*& ]*?[\s*&]+)(?P<name>~?[A-Za-z_]\w*)\s*\((?P<params>[^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const|noexcept|override|async|throws [\w, .]+|\s)*(?=\{|=>)"
JS = r"(?P<mods>(?:(?:export|default|async|public|private|protected|static)\s+)*)(?:function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<name2>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?P<mods2>async\s+)?(?:function\b\s*)?(?=\([^;]*?\)\s*(?::[^={]+)?(?:=>|\{))|(?<=[{};\n])\s*(?P<mods3>(?:async|static|public|private|protected)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?P<name3>[A-Za-z_$][\w$]*)(?=\([^;{}()]*\)\s*(?::[^={;]+)?\{))\s*(?:<[^>]*>)?\((?P<params>[^{}]*?)\)(?:\s*:\s*(?P<ret>[^={]+?))?\s*(?:=>)?\s*(?=\{|[^\s{])"
GRAMMARS = {
    "rust": Grammar(r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*)fn\s+(?P<name>\w+)\s*(?:<[^{(]*>)?\s*\((?P<params>[^{};]*?)\)\s*(?:->\s*(?P<ret>[^{;]+?))?\s*(?:where[^{]*)?(?=\{)", r"\b(?P<kind>struct|enum|trait|type|union)\s+(?P<name>\w+)(?P<supers>)", r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "go": Grammar(r"func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^{}]*?)\)\s*(?P<ret>[^{\n]*?)\s*(?P<mods>)(?=\{)", r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)(?P<supers>)", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$'),
    "javascript": Grammar(JS, r"\b(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<supers>[\w.]+))?", r"^\s*import\s+([^;]+?)\s*;?\s*$"),
    "java": Grammar(C_LIKE, r"\b(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+(?:extends|implements)\s+(?P<supers>[\w., <>]+?))?(?=\s*\{)", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "csharp": Grammar(C_LIKE, r"\b(?P<kind>class|interface|enum|struct|record)\s+(?P<name>\w+)(?:\s*:\s*(?P<supers>[\w., <>]+?))?(?=\s*\{)", r"^\s*using\s+([\w.]+)\s*;"),
    "cpp": Grammar(C_LIKE, r"\b(?P<kind>class|struct|enum|union)\s+(?P<name>\w+)(?:\s*:\s*(?P<supers>[\w:, <>]+?))?(?=\s*\{)", r"^\s*#include\s+[<\"]([^>\"]+)[>\"]"),
    "dart": Grammar(C_LIKE, r"\b(?P<kind>class|mixin|enum|extension)\s+(?P<name>\w+)(?:\s+(?:extends|implements|with)\s+(?P<supers>[\w., <>]+?))?(?=\s*\{)", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    "php": Grammar(r"(?P<mods>(?:(?:public|private|protected|static|final|abstract)\s+)*)function\s+&?(?P<name>\w+)\s*\((?P<params>[^{}]*?)\)\s*(?::\s*(?P<ret>[\w|?\\]+))?\s*(?=\{)", r"\b(?P<kind>class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+(?:extends|implements)\s+(?P<supers>[\w\\, ]+?))?(?=\s*\{)", r"^\s*use\s+([\w\\]+)"),
}
GRAMMARS["typescript"] = GRAMMARS["javascript"]
# Words before ( that aren't calls, and branches that count for complexity.
NOT_CALLS = {"if", "for", "while", "switch", "match", "return", "catch", "fn", "func", "function", "def", "class", "new", "sizeof", "typeof", "await", "in", "and", "or", "not", "else", "elif", "with", "except", "lambda", "foreach", "using", "lock", "assert", "print!"}
BRANCH = re.compile(r"\b(?:if|for|while|loop|case|catch|match|foreach|elif|except)\b|&&|\|\||\?(?=[^.?])")
CALL = re.compile(r"(?:(?P<q>[A-Za-z_$][\w$]*(?:(?:::|\.|->)[A-Za-z_$][\w$]*)*)(?P<op>::|\.|->))?(?P<name>[A-Za-z_$][\w$]*!?)\s*(?:::<[^>]*>)?\(")


def blanked(source: str, line_comment: str = "//") -> str:
    """source of the same length with comments and the insides of strings as spaces."""
    token = re.compile(r'/\*.*?(?:\*/|\Z)|' + re.escape(line_comment) + r"[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n]){2,}'(?!\w)|`(?:\\.|[^`\\])*`", re.DOTALL)
    keep = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" or m[0].startswith(line_comment) else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return token.sub(keep, source)


def closing(text: str, at: int) -> int:
    """The place behind the brace that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def calls_in(body: str, first_line: int) -> list[dict]:
    out = []
    for m in CALL.finditer(body):
        name, q, op = m["name"], m["q"], m["op"]
        if (name in NOT_CALLS and (q is None or name != "new")) or (q is None and re.search(r"\b(?:fn|func|function|def|class|new)\s+$", body[max(0, m.start() - 12) : m.start()])):
            continue
        kind = "Bare" if q is None else "SelfMethod" if q in ("self", "this", "cls", "$this") else "Qualified" if op == "::" or q[:1].isupper() else "Chained" if re.search(r"[.\-]", q) else "OnReceiver"
        out.append({"kind": kind, "qualifier": q, "name": name, "line": first_line + body.count("\n", 0, m.start())})
    return out


def doc_before(lines: list[str], at: int) -> tuple[str | None, list[str]]:
    """The doc comment and the attributes in the lines right before line `at` (0-based)."""
    docs, marks = [], []
    i = at - 1
    while i >= 0:
        s = lines[i].strip()
        if s.startswith(("///", "//!", "/**", "*", "*/", "//", "#'")):
            docs.append(s.lstrip("/*!# '").rstrip("*/ "))
        elif s.startswith(("#[", "@", "[")) and s:
            marks.append(s)
        else:
            break
        i -= 1
    return "\n".join(reversed([d for d in docs if d])) or None, marks[::-1]


def parse_generic(path: str, language: str, source: str) -> dict:
    g = GRAMMARS[language]
    text = blanked(source, g.line_comment)
    lines = source.split("\n")
    containers = []
    for m in re.finditer(r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:(?P<trait>[\w:]+(?:<[^{]*?>)?)\s+for\s+)?(?P<name>\w+)[^{;]*(?=\{)" if language == "rust" else r"\b(?:class|interface|struct|trait|enum|mixin|extension|record)\s+(?P<name>\w+)(?P<trait>)[^{;]*(?=\{)", text):
        start = text.index("{", m.end() - 0)
        containers.append((start, closing(text, start), m["name"], m["trait"] or None))
    functions = []
    for m in re.finditer(g.function, text):
        groups = m.groupdict()
        name = groups.get("name") or groups.get("name2") or groups.get("name3")
        if not name or (name in NOT_CALLS and not (name == "new" and language in ("rust", "go", "php"))) or (groups.get("ret") or "").strip() in ("new", "return", "else", "throw", "await"):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = closing(text, m.end()) if text[m.end() : m.end() + 1] == "{" else (text.find("\n", m.end()) + 1 or len(text))
        mods = " ".join(filter(None, (groups.get("mods"), groups.get("mods2"), groups.get("mods3"))))
        holder = max((c for c in containers if c[0] < start < c[1]), default=(0, 0, None, None))
        container = holder[2] or (re.sub(r"^\w+\s+\*?", "", groups["recv"]).strip() if groups.get("recv") else None)
        line = source.count("\n", 0, start)
        doc, marks = doc_before(lines, line)
        body = text[m.end() : end]
        public = {"rust": mods.startswith("pub"), "go": name[:1].isupper(), "javascript": "export" in mods, "typescript": "export" in mods, "dart": not name.startswith("_")}.get(language, "private" not in mods and "protected" not in mods)
        params = [p.strip() for p in re.split(r",(?![^<(\[]*[>)\]])", groups["params"] or "") if p.strip()]
        functions.append({
            "name": name, "container": container, "line": line + 1, "end_line": source.count("\n", 0, max(end - 1, 0)) + 1, "is_public": bool(public), "is_async": "async" in mods,
            "is_test": any("test" in x.lower() for x in marks) or bool(re.match(r"(test_|Test[A-Z_]|bench_)", name)), "trait_impl": holder[3], "params": params,
            "returns": [r for r in [(groups.get("ret") or "").strip()] if r and r != "void"], "complexity": 1.0 + len(BRANCH.findall(body)), "doc": doc, "decorators": marks,
            "calls": calls_in(body, source.count("\n", 0, m.end()) + 1), "body": source[m.end() : end],
        })
    kinds = [{"name": m["name"], "kind": m["kind"], "line": source.count("\n", 0, m.start()) + 1, "supers": [x.strip() for x in (m["supers"] or "").split(",") if x.strip()]} for m in re.finditer(g.types, text)]
    found = []
    for m in re.finditer(g.imports, re.sub(r"//[^\n]*", "", source), re.MULTILINE):
        for module, items in rust_uses(m[1]) if language == "rust" else [import_parts(m[1])]:
            found.append({"module": module, "items": items, "line": source.count("\n", 0, m.start()) + 1})
    return {"functions": functions, "imports": found, "types": kinds}


def import_parts(text: str) -> tuple[str, list[str]]:
    """(module, items) of an import; a from clause names the module."""
    m = re.match(r"(?s)(?P<items>.*?)\bfrom\s+['\"](?P<module>[^'\"]+)", text)
    if m:
        return m["module"], [x.strip() for x in re.sub(r"[{}]", "", m["items"]).split(",") if x.strip()]
    return text.strip().strip("'\""), []


def rust_uses(text: str) -> list[tuple[str, list[str]]]:
    """Flattens a use tree: nested braces, aliases (the alias counts) and globs (*)."""

    def parts(s: str) -> list[str]:
        out, depth, last = [], 0, 0
        for i, c in enumerate(s):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                out.append(s[last:i])
                last = i + 1
        return [p.strip() for p in [*out, s[last:]] if p.strip()]

    def walk(prefix: str, s: str) -> Iterator[tuple[str, str]]:
        m = re.match(r"(?s)((?:\w+::)*)\{(.*)\}$", s)
        if m:
            for p in parts(m[2]):
                yield from walk(prefix + m[1], p)
            return
        head, _, last = s.partition(" as ")[0].strip().rpartition("::")
        name = s.partition(" as ")[2].strip() or last
        if last == "self":
            yield (prefix + head).removesuffix("::"), s.partition(" as ")[2].strip() or (prefix + head).removesuffix("::").rpartition("::")[2]
        else:
            yield (prefix + head).removesuffix("::"), name

    grouped: dict[str, list[str]] = {}
    for module, item in walk("", re.sub(r"\s+", " ", text.strip()).replace(" ::", "::").replace(":: ", "::")):
        grouped.setdefault(module, []).append(item)
    return list(grouped.items())


def parse_python(path: str, source: str) -> dict:
    tree = ast.parse(source)
    functions, imports, types = [], [], []
    lines = source.split("\n")
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)

    def call(n: ast.Call) -> dict | None:
        f = n.func
        if isinstance(f, ast.Name):
            return {"kind": "Bare", "qualifier": None, "name": f.id, "line": n.lineno}
        if isinstance(f, ast.Attribute):
            q = ast.unparse(f.value)
            kind = "SelfMethod" if q in ("self", "cls") else "Chained" if not re.fullmatch(r"[\w.]+", q) else "Qualified" if q[:1].isupper() else "OnReceiver"
            return {"kind": kind, "qualifier": q, "name": f.attr, "line": n.lineno}
        return None

    def visit(node: ast.AST, container: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = list(ast.walk(n))
                a = n.args
                functions.append({
                    "name": n.name, "container": container, "line": n.lineno, "end_line": n.end_lineno, "is_public": not n.name.startswith("_"), "is_async": isinstance(n, ast.AsyncFunctionDef), "is_test": n.name.startswith("test_"),
                    "trait_impl": None, "params": [ast.unparse(x) for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]], "returns": [ast.unparse(n.returns)] if n.returns else [],
                    "complexity": 1.0 + sum(isinstance(x, branches) for x in inner) + sum(len(x.values) - 1 for x in inner if isinstance(x, ast.BoolOp)), "doc": ast.get_docstring(n),
                    "decorators": ["@" + ast.unparse(d) for d in n.decorator_list], "calls": [c for x in inner if isinstance(x, ast.Call) and (c := call(x))], "body": "\n".join(lines[n.body[0].lineno - 1 : n.end_lineno]),
                })
                visit(n, container)
            elif isinstance(n, ast.ClassDef):
                types.append({"name": n.name, "kind": "class", "line": n.lineno, "supers": [ast.unparse(b) for b in n.bases]})
                visit(n, n.name)
            elif isinstance(n, ast.Import):
                imports.extend({"module": x.name, "items": [], "line": n.lineno} for x in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports.append({"module": "." * n.level + (n.module or ""), "items": [x.asname or x.name for x in n.names], "line": n.lineno})
            else:
                visit(n, container)

    visit(tree, None)
    return {"functions": functions, "imports": imports, "types": types}


def parse(path: str, language: str, source: str) -> dict:
    """functions, imports, types and error of one file."""
    try:
        found = parse_python(path, source) if language == "python" else parse_generic(path, language, source)
        return {"path": path, "language": language, **found, "error": None}
    except (SyntaxError, ValueError, KeyError, RecursionError) as e:
        return {"path": path, "language": language, "functions": [], "imports": [], "types": [], "error": f"{type(e).__name__}: {e}"}


# How comments begin, by language; the rest writes // and /* */.
HASH_COMMENTS = ("python",)


HASH_LINE, HASH_BLOCK = "#([^\\n]*)", '(?s)"{3}(.*?)"{3}'
SLASH_LINE, SLASH_BLOCK = "//([^\\n]*)", "(?s)/\\*(.*?)\\*/"


def comments(files: DataFrame) -> DataFrame:
    """path, kind (line, block, doc), text of each comment of files (path, language, source); strings aren't told apart."""
    hashed = F.col("language").isin(*HASH_COMMENTS)
    found = lambda a, b: F.regexp_extract_all("source", F.when(hashed, F.lit(a)).otherwise(F.lit(b)), F.lit(1))
    row = lambda kind, x: F.struct(kind.alias("kind"), F.trim(x).alias("text"))
    line = F.transform(found(HASH_LINE, SLASH_LINE), lambda x: row(F.when(~hashed & x.rlike("^[/!]"), "doc").otherwise("line"), F.regexp_replace(x, "^[/!]+", "")))
    block = F.transform(found(HASH_BLOCK, SLASH_BLOCK), lambda x: row(F.when(hashed | x.startswith("*"), "doc").otherwise("block"), F.regexp_replace(x, "^[*]+", "")))
    return files.select("path", F.explode(F.concat(line, block)).alias("c")).select("path", "c.*")


def parsed(files: DataFrame) -> DataFrame:
    """files (path, language, source) as nested rows; one row a file."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = [parse(p, lang, s or "") for p, lang, s in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(files.sparkSession)
    return files.select("path", "language", "source").mapInArrow(run, PARSED)


def functions(p: DataFrame) -> DataFrame:
    """A row for each function: full_path (path::container::name), file, language and its fields."""
    f = p.select("path", "language", F.explode("functions").alias("f")).select("path", "language", "f.*")
    return f.withColumn("full_path", F.concat_ws("::", "path", "container", "name")).withColumnRenamed("path", "file")


def call_sites(f: DataFrame) -> DataFrame:
    """caller, file, container, ord, kind, qualifier, name, line."""
    return f.select(F.col("full_path").alias("caller"), "file", "container", F.posexplode("calls").alias("ord", "c")).select("caller", "file", "container", "ord", "c.*")


def imports(p: DataFrame) -> DataFrame:
    """file, module, item (null for a whole module), line."""
    return p.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.module", F.explode_outer("i.items").alias("item"), "i.line")


def types(p: DataFrame) -> DataFrame:
    return p.select(F.col("path").alias("file"), F.explode("types").alias("t")).select("file", "t.*")
