"""String expressions over source code and prose. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered replacements of the symbol notation.
SYMBOLS = [
    ("function ", "ƒ "), ("def ", "ƒ "), ("fn ", "ƒ "), ("func ", "ƒ "), ("class ", "∁ "), ("struct ", "∁ "), ("impl ", "⚡ "), ("return ", "⇐ "), ("import ", "↓ "), ("from ", "← "), ("export ", "↑ "),
    ("const ", "⊲ "), ("let ", "⊲ "), ("var ", "⊲ "), ("mut ", "♲ "), ("async ", "∂ "), ("await ", "∫ "), ("public ", "+ "), ("private ", "- "), ("protected ", "~ "), ("static ", "§ "), ("abstract ", "Δ "),
    ("interface ", "⊡ "), ("extends ", "→ "), ("implements ", "⊢ "), ("this.", "@"), ("self.", "@"), ("super.", "⋉"), ("new ", "★ "), ("throw ", "↑ "), ("catch ", "⚠ "), ("if ", "? "), ("else ", ": "),
    ("for ", "∀ "), ("while ", "∃ "), ("match ", "≋ "), ("switch ", "≋ "), ("case ", "▸ "), ("true", "⊤"), ("false", "⊥"), ("null", "∅"), ("None", "∅"), ("Option<", "?<"), ("Result<", "!<"), ("Vec<", "□<"),
    ("->", "→"), ("=>", "⇒"), ("::", "∷"), ("&&", "∧"), ("||", "∨"), ("==", "≡"), ("!=", "≠"), ("<=", "≤"), (">=", "≥"),
]
# A name's purpose by the first word that it holds.
PURPOSES = [
    ("validate", "validation"), ("build", "construction"), ("create", "creation"), ("update", "update"), ("get", "retrieval"), ("set", "assignment"), ("process", "processing"), ("handle", "handling"),
    ("parse", "parsing"), ("convert", "conversion"), ("init", "initialization"), ("close", "cleanup"), ("commit", "commit"), ("reveal", "reveal"), ("cancel", "cancel"), ("fetch", "fetch"),
    ("precompute", "precompute"), ("submit", "submit"), ("upload", "upload"), ("audit", "audit"), ("verify", "verify"), ("load", "io"), ("save", "io"), ("has", "check"), ("is", "check"),
]
# A name's category by its first letters.
CATEGORIES = [
    ("getter", ("get", "fetch", "find")), ("setter", ("set", "update", "put")), ("creator", ("new", "create", "build")), ("validator", ("is", "has", "validate", "check")),
    ("action", ("save", "load", "delete", "remove")), ("converter", ("to", "into", "from")), ("processor", ("process", "handle", "parse")),
]
# Words of the 13 text features.
CONTROL_FLOW = ("if", "else", "for", "while", "match", "switch")
ERRORS = ("unwrap", "expect", "?", "try!", "catch")
TYPES = ("Vec", "HashMap", "Result", "Option", "String", "Box", "Arc")
# Weights of what makes a line complex; a line counts each once.
LINE_WEIGHTS = [
    ("if", 0.5), ("else if", 0.3), ("for", 0.5), ("while", 0.5), ("loop", 0.3), ("match", 0.5), ("switch", 0.5), ("case", 0.2), ("&&", 0.2), ("||", 0.2), ("?", 0.3), ("catch", 0.3), ("try", 0.2),
    ("unwrap", 0.2), ("expect", 0.2),
]


def collapsed(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, "[ \t\n\r\f]+", " "))


def body_hash(s: Column, unique: Column | None = None, least: int = 0) -> Column:
    """Hash of a body up to white space; bodies of fewer than `least` characters get one of their own from `unique`."""
    h = F.sha2(F.concat(F.lit("body:"), collapsed(s)), 256)
    return h if unique is None else F.when(F.length(collapsed(s)) >= least, h).otherwise(F.sha2(F.concat(F.lit("unique:"), unique.cast("string")), 256))


def normalized(s: Column) -> Column:
    """Lower case, digits as #, punctuation dropped, white space collapsed."""
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(s), "[0-9]", "#"), "[.,;:!?'\"()\\[\\]{}|*%$&_-]", ""))


def code_tokens(s: Column) -> Column:
    """Lower-case tokens between white space and brackets, commas, semicolons."""
    return F.array_remove(F.split(F.lower(s), "[ \t\n\r\f(){}\\[\\];,]+"), "")


def hash31(s: Column) -> Column:
    """A 31-bit hash that other engines can compute: the first 8 hex digits of md5, modulo 2^31 - 1."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % 2147483647


def shingles(tokens: Column, width: int = 3) -> Column:
    """Runs of `width` tokens, none if there are fewer. tokens should be a plain column: the lambda reads it for each run."""
    last = F.size(tokens) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))


def hash_family(n: int = 32, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of n affine functions below 2^31, from a linear congruential generator."""
    out, x = [], seed
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % 2147483648
            pair.append(x)
        out.append((pair[0] | 1, pair[1]))
    return out


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in lower case; 1 for two empty strings."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def count_of(s: Column, what: str) -> Column:
    """Occurrences of a text in s that don't overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)).cast("bigint")


def counts_of(s: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + count_of(s, w)
    return total


def lines(s: Column) -> Column:
    """Lines as an iterator over lines sees them: none after the last line end, none in an empty text."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, "\r?\n$", ""), "\r?\n"))


def token_estimate(s: Column) -> Column:
    """A third of the punctuation and digits and a quarter of the letters and white space, each rounded down."""
    code = F.length(F.regexp_replace(s, "[^!-/0-9:-@\\[-`{-~]", ""))
    text = F.length(F.regexp_replace(s, "[^\\p{L}\\s]", ""))
    return (F.floor(code / 3) + F.floor(text / 4)).cast("bigint")


def token_reduction(before: Column, after: Column) -> Column:
    """Percent of tokens saved."""
    return F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)


def symbols(s: Column) -> Column:
    """s in symbol notation."""
    for word, sign in SYMBOLS:
        s = F.replace(s, F.lit(word), F.lit(sign))
    return s


def compressed(s: Column, dictionary: dict[str, str]) -> Column:
    """s with dictionary entries replaced, longest first."""
    for word in sorted(dictionary, key=lambda w: (-len(w), w)):
        s = F.replace(s, F.lit(word), F.lit(dictionary[word]))
    return s


def purpose(name: Column) -> Column:
    out = F.lit("unknown")
    for word, what in reversed(PURPOSES):
        out = F.when(F.lower(name).contains(word), what).otherwise(out)
    return out


def category(name: Column) -> Column:
    out = F.lit("other")
    for what, starts in reversed(CATEGORIES):
        out = F.when(F.lower(name).rlike("^(" + "|".join(starts) + ")"), what).otherwise(out)
    return out


def djb2_hue(s: Column) -> Column:
    """Hue 0 to 359 from the 32-bit hash h * 33 + byte over ASCII text, starting at 5381."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c) % 4294967296) % 360


def complexity_bucket(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "medium").when(c <= 20, "high").otherwise("very_high")


def line_complexity(s: Column) -> Column:
    """struct(complexity, cyclomatic, nesting) from the lines of a body; 1, 1, 0 for an empty one."""
    rows = F.transform(lines(s), lambda x: F.trim(x))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x.contains("{"), 1).otherwise(0)
        deepest = F.greatest(acc["deepest"], depth)
        weight, hits = acc["c"], acc["n"]
        for word, w in LINE_WEIGHTS:
            weight = weight + F.when(x.contains(word), w).otherwise(0.0)
            hits = hits + F.when(x.contains(word), 1.0).otherwise(0.0)
        return F.struct(weight.alias("c"), hits.alias("n"), F.greatest(depth - F.when(x.contains("}"), 1).otherwise(0), F.lit(0)).alias("depth"), deepest.alias("deepest"))

    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    done = lambda a: F.struct(F.least(a["c"] + a["deepest"] * 0.2, F.lit(50.0)).alias("complexity"), F.least(a["n"], F.lit(50.0)).alias("cyclomatic"), a["deepest"].alias("nesting"))
    return F.aggregate(rows, start, step, done)


def truncated(s: Column, tokens: int) -> Column:
    """The first tokens * 4 characters, cut back to the last line end among them."""
    cut = F.substring(s, 1, tokens * 4)
    whole = F.regexp_extract(cut, "(?s)^(.*)\n", 1)
    return F.when(F.length(s) <= tokens * 4, s).when(whole != "", whole).otherwise(cut)


def chunked(s: Column, tokens: int) -> Column:
    """The whole text as consecutive chunks of at most tokens * 4 characters, each cut back as `truncated` does; the line end of such a cut is left out."""
    n = tokens * 4
    found = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{n}}}\\z|.{{1,{n - 1}}}\n|.{{1,{n}}}"), F.lit(0))
    cut = F.transform(found, lambda c, i: F.when((i < F.size(found) - 1) & c.endswith("\n"), F.regexp_replace(c, "\n\\z", "")).otherwise(c))
    return F.when(s == "", F.array(F.lit(""))).otherwise(cut)


def plain_words(s: Column) -> Column:
    """The lower-case words (a-z, 0-9) of a text in order; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+"), "")


def word_runs(words: str, width: int) -> Column:
    """The runs of `width` words of a column of words, joined by blanks. A column, not an expression: each run reads it."""
    places = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, width), " "))


def stable_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and the first hex digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, digits))


def json_in(s: Column) -> Column:
    """The JSON in a fenced or braced text; empty if there is none."""
    fenced = F.regexp_extract(s, "(?s)```(?:json)?\\s*(\\{.*?\\}|\\[.*?\\])\\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(s, "(?s)\\{.*\\}", 0))


def module_of(path: Column) -> Column:
    """The last directory of a path; root for none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("root"))


def module_path(path: Column) -> Column:
    """crate::a::b for src/a/b.rs; main, lib and mod files stand for their directory."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "(?:^|/)src/(.*)$", 1), "\\.[A-Za-z]+$", ""), "(^|/)(mod|lib|main)$", "")
    return F.when(inner == "", "crate").otherwise(F.concat(F.lit("crate::"), F.regexp_replace(inner, "/", "::")))


def path_similarity(a: Column, b: Column) -> Column:
    """Equal components at equal places over the longer path's number of components."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))
    return same / F.greatest(F.size(x), F.size(y))
