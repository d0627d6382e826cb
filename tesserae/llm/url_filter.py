"""URL filtering by rules, spread over redirects and canonical links.

A rule such as block net/ or allow example.net/en/ fits its host and all subdomains, if the URL's path starts with
the rule's path; the longest fitting rule decides (equally long: allow). URLs are nodes of a graph whose edges are
redirects (a refresh in the page) and canonical links; its connected components, found by distributed label
spreading, are the aliases of one page. If a rule blocks any URL of a component, its aliases are blocked, too, but
for those that a rule allows by themselves: an explicit allow goes before a block that comes from an alias.
What no rule and no alias decides is allowed.

A node is a URL without its scheme and fragment. Targets of links count as nodes, whether or not a row has them. Links
count in a page's head only, outside comments, scripts and other elements with raw text; relative ones are resolved against
the page's base. Tags may be of any length.

Defined results: a null url, or one without ://, has an empty host and path and no rule, and is allowed unless an
alias is blocked (it has no aliases). Null or empty html has no links. Repeated rows each give a row. Other
columns, whatever their names, are not read. rules is a short list (each row tries all of them).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, ship

#: (action, host/path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
HEAD = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|iframe|xmp)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])|\Z)|<(/head|body)(?=[\s/>])|<(link|meta|base)(?=[\s/])((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
REFRESH = re.compile(r"[\d.\s]*+[;,]?\s*+url\s*+=\s*+(.+)", re.DOTALL | re.IGNORECASE)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, without the fragment's host being looked at; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The URL without scheme and fragment, its host in lower case; null without ://."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), query))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the rule that decides, its action); nulls without one."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        text, action = F.when(fits, rule).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


def targets(url: str, html: str) -> list[str]:
    """Where a page's redirects and canonical links lead, as whole URLs: those in the head, outside comments, scripts and the like."""
    found, base = [], url
    for m in HEAD.finditer(html):
        if m.group(2):
            break
        if not m.group(3):
            continue
        tag, attrs = m.group(3).lower(), {}
        for name, value in ATTR.findall(m.group(4)):
            attrs.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value).strip())
        to = None
        if tag == "base":
            base = _joined(url, attrs.get("href")) or base
        elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            to = attrs.get("href")
        elif tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh" and (r := REFRESH.match(attrs.get("content", ""))):
            to = r.group(1).strip("'\" \t\r\n")
        if to := _joined(base, to):
            found.append(to)
    return found


def _joined(base: str, to: str | None) -> str | None:
    try:
        return urljoin(base, to) if to else None
    except ValueError:  # no URL, such as http://[
        return None


def links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between a page's node and those of its redirects and canonical links."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1), strict=True) for t in targets(u, h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["a", "b"])

    ship(pages.sparkSession)
    linked = pages.select("url", "html").filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    return linked.mapInArrow(run, "a string, b string").select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).filter("a is not null and b is not null and a != b")


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """Per page page_id, host, path, rule, verdict, via_alias boolean. edges: further (a, b) of URLs, as from a crawl's redirects."""
    all_edges = links(pages)
    if edges is not None:
        all_edges = all_edges.unionAll(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    nodes = components(all_edges)
    as_url = F.concat(F.lit("//://"), F.col("node"))
    _, action = rule_of(host(as_url), path(as_url), rules)
    bad = nodes.filter(action == "block").select(F.col("root").alias("r")).distinct()
    blocked = nodes.join(bad, F.col("root") == F.col("r")).select(F.col("node").alias("alias"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    rows = rows.select("page_id", "host", "path", "node", text.alias("rule"), action.alias("action"))
    # rows without a node are spread by a key of their own
    key = F.coalesce("node", F.concat(F.lit("\0"), F.xxhash64("page_id", "host").cast("string")))
    out = rows.withColumn("key", key).join(blocked, (F.col("key") == F.col("alias")) & F.col("node").isNotNull(), "left")
    from_alias = F.col("action").isNull() & F.col("alias").isNotNull()
    verdict = F.coalesce(F.col("action"), F.when(F.col("alias").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), from_alias.alias("via_alias"))


#: The tables' pages have no redirects or canonical links, so the rules decide all of them; tests/llm has pages with links.
SQL = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict, false AS via_alias FROM r
"""
