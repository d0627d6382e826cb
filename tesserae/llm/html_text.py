"""The main text of web pages.

The words of a host's pages are laid one behind the other, their suffixes are sorted, and the longest common prefixes of
neighbours tell which strings of LEAST or more words stand on which pages. Pages are distinct if their words differ, so that
a repeated page isn't its own boilerplate. What counts as boilerplate depends on what a page says itself:

* A page that marks its article (`article`, `main`, role main, or else a class or id such as content) gives the
  marked part without what HTML or usual class names set apart (menus, headers, footers, sidebars, notices, adverts,
  forms, scripts, styles, reader comments). Articles share passages, so of that only strings go that stand on SHARE or
  more of a host's distinct pages, of which there must be PAGES or more: a notice that no mark tells from the article.
* For a page without such marks the suffix array decides alone: strings that stand on two distinct pages of the host
  without marks are removed, and the unique runs stay.

A host may hold a third of all pages, so its pages are dealt into chunks of about CHUNK words, each with its own
suffix array. For marked pages a string on SHARE of all pages is on half of the pages of at least one chunk: those are
the candidates, and how many pages hold them is counted over all pages. For the others each chunk tells the distinct
first LEAST words of its suffixes, with the least and greatest page; combined over all chunks (a map-side combined minimum
and maximum), those whose pages differ are repeated, within a chunk or across chunks, and each chunk gets back the ones it
holds. Neither result depends on the chunks.

Defined results: null or empty html gives an empty text; rows that repeat a page each give a row; a null url
has the host "". An end of the page inside a tag, comment or element ends all of them. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import counted, ship, written

LEAST = 8
CHUNK = 100_000
SHARE, PAGES = 0.9, 10
#: Pages that a task remembers, so as to send on one copy of each.
SEEN = 200_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?=[!?/a-zA-Z])(/?)([a-zA-Z][^\s/>]*)?((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.DOTALL)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names of HTML by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "select", "object", "video", "audio", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
APART = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
# Usual class names and ids of what is set apart.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social",
    "related", "recommended", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "footer", "masthead", "widget", "alert", "announcement", "adsbygoogle", "adslot", "adbox", "cookiebar", "cookiebanner",
}
# Names that set apart only outside an article, which may have a header of its own.
OUTSIDE = NAMES | {"header", "topbar", "logo"}
NOT = {"no", "has", "with", "without", "is"}
OF_ARTICLE = {"ad", "ads", "advert", "sponsored", "promo", "related", "recommended", "comment", "comments", "reply", "replies", "widget", "sidebar"}
# Usual class names and ids of what holds the article.
CONTENT = {"content", "article", "post", "entry", "story", "main", "body"}


def _holds_article(attrs: str) -> bool:
    """Whether a class name or id is a usual one of the article's element, such as content or post-content."""
    for key, value in ATTR.findall(attrs):
        if key.lower() in ("class", "id"):
            for name in value.strip("\"'").lower().split():
                parts = re.split("[-_]+", name)
                if parts[0] not in NOT and set(parts) <= CONTENT | {"page", "site", "text", "blog", "news"} and parts[-1] in CONTENT:
                    return True
    return False


def _named(attrs: str, names: set[str]) -> bool:
    for key, value in ATTR.findall(attrs):
        key = key.lower()
        if key in ("class", "id"):
            for name in entities.unescape(value.strip("\"'")).lower().split():
                parts = re.split("[-_]+", name)
                if name in names or (parts[0] not in NOT and (parts[0] in names or parts[-1] in names)):
                    return True
        elif key == "role" and value.strip("\"'").lower() in ROLES:
            return True
    return False


def blocks(html: str | None) -> tuple[list[str], bool]:
    """The blocks of a page's main text in order, and whether the page marks its article; if not, all blocks that aren't set apart."""
    if not html:
        return [], False
    #: Open elements: name, whether set apart, depth of articles, mains and elements named so, whether in an article's header.
    stack: list[tuple[str, bool, int, int, int, bool]] = []
    found: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    apart, article, main, named, head = False, 0, 0, 0, False
    pos, end = 0, len(html)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, article, main, named))
            parts.clear()

    def state() -> None:
        nonlocal apart, article, main, named, head
        _, apart, article, main, named, head = stack[-1] if stack else ("", False, 0, 0, 0, False)

    def close(depth: int) -> None:
        del stack[depth:]
        state()

    def text(lo: int, hi: int) -> None:
        if not apart and not head and hi > lo:
            s = html[lo:hi]
            parts.append(entities.unescape(s) if "&" in s else s)

    while pos < end:
        m = TAG.search(html, pos)
        if not m:
            text(pos, end)
            break
        text(pos, m.start())
        pos = m.end()
        closing, name, attrs = m.group(1), m.group(2), m.group(3)
        if not name:
            if m.group(0).startswith("<![CDATA[") and not apart and not head:
                parts.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW:
            if attrs.rstrip().endswith("/") and name == "svg":
                continue
            e = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, pos)
            pos = e.end() if e else end
            continue
        if name in VOID:
            continue
        if name in BLOCK:  # what a new block ends that has no end tag of its own
            if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                ends, within = {name, *(("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("tr", "td", "th") else ())}, {"ul", "ol", "dl", "table", "menu"}
            else:
                ends, within = {"p", *(HEADINGS if name in HEADINGS else ())}, BLOCK - HEADINGS - {"p"}
            cut = -1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    cut = i
                if stack[i][0] in within and stack[i][0] not in ends:
                    break
            if cut >= 0:
                close(cut)
        if name in ("article", "main"):  # these aren't part of a menu or a page's header, whose end tag is missing then
            for i, s in enumerate(stack):
                if s[0] in ("nav", "header", "footer"):
                    close(i)
                    break
            off = bool(attrs) and _named(attrs, OF_ARTICLE)
        else:
            off = name in APART or (name not in ("html", "body") and bool(attrs.strip()) and _named(attrs, NAMES if article else OUTSIDE))
        is_main = name == "main" or (bool(attrs) and "main" in attrs and bool(re.search(r"""role\s*=\s*["']?main\b""", attrs, re.IGNORECASE)))
        in_head = head
        if name == "header":
            if article:
                in_head = True
            else:
                off = True
        elif name in HEADINGS and head:
            in_head = False  # an article's own title
        is_named = name in ("div", "section", "td") and bool(attrs.strip()) and _holds_article(attrs)
        stack.append((name, apart or off, article + (name == "article"), main + is_main, named + is_named, in_head))
        state()
    flush()
    for at in (1, 2, 3):
        if chosen := [b[0] for b in found if b[at]]:
            return chosen, True
    return [b[0] for b in found], False


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*://([^/?#]*)", 1)), F.lit(""))


def suffix_array(stream):  # noqa: ANN001, ANN201
    """The order of all suffixes of an array of integers, by doubling, and the ranks by 1, 2, 4 and so on first words."""
    import numpy as np

    _, rank = np.unique(stream, return_inverse=True)
    ranks = [rank.astype(np.int64)]
    k, n = 1, len(rank)
    while True:
        key = ranks[-1] * (n + 1)
        key[:-k] += ranks[-1][k:] + 1  # 0: the suffix ends before
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if k >= n or fresh[order[-1]] == n - 1:
            return order, ranks
        ranks.append(fresh)
        k *= 2


def common_prefixes(order, ranks):  # noqa: ANN001, ANN201
    """For each suffix in order, but the first, the words it shares with the one before, from the ranks."""
    import numpy as np

    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = same.astype(np.int64) << level
        out, a, b = out + step, a + step, b + step
    return out


def _stream(pages: list[list[str]]):  # noqa: ANN202
    """Word hashes of pages one behind the other, each with an end of its own; the page and the words left of each place."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    ids, page, left = [], [], []
    for i, ws in enumerate(pages):
        ids += [xxh3_64_intdigest(w) >> 1 for w in ws]
        ids.append(i)
        page += [i] * (len(ws) + 1)
        left += range(len(ws), -1, -1)
    return np.array(ids, np.int64), np.array(page, np.int64), np.array(left, np.int64)


def _grams(ids, least: int):  # noqa: ANN001, ANN202
    import numpy as np

    acc = np.zeros(max(0, len(ids) - least + 1), np.uint64)
    for j in range(least):
        acc = (acc ^ ids[j : j + len(acc)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def repeats(pages: list[list[str]], least: int = LEAST):  # noqa: ANN201
    """The classes of suffixes that share `least` or more words, as (first words as a hash, class, page) of each suffix in order; classes are runs of the suffix array whose common prefixes are that long."""
    import numpy as np

    ids, page, left = _stream(pages)
    none = np.zeros(0, np.int64)
    if len(ids) < least:
        return none, none, none
    order, ranks = suffix_array(ids)
    shared = common_prefixes(order, ranks)
    # a page ends with a sign of its own, but where two pages end alike it may be one that another page has, too
    whole = left[order] >= least
    cls = np.concatenate([[0], np.cumsum((shared < least) | ~whole[1:] | ~whole[:-1])])
    return _grams(ids, least)[order[whole]], cls[whole], page[order[whole]]


def repeated_starts(pages: list[list[str]], keys: list[int], least: int = LEAST):  # noqa: ANN201
    """(first `least` words as a hash, least page key, greatest page key) for each class of suffixes that share them, from the suffix array."""
    import numpy as np

    grams, cls, page = repeats(pages, least)
    if not len(grams):
        return grams, grams, grams
    starts = np.concatenate([[0], np.nonzero(np.diff(cls))[0] + 1])
    of = np.asarray(keys, np.int64)[page]
    return grams[starts], np.minimum.reduceat(of, starts), np.maximum.reduceat(of, starts)


def on_pages(pages: list[list[str]], n: float, least: int = LEAST):  # noqa: ANN201
    """(first `least` words as a hash, number of pages) of the strings that stand on n or more of the pages."""
    import numpy as np

    grams, cls, page = repeats(pages, least)
    if not len(grams):
        return grams, grams
    pairs = np.unique(cls * len(pages) + page) // len(pages)
    of, on = np.unique(pairs, return_counts=True)
    first = grams[np.searchsorted(cls, of)]
    return first[on >= n], on[on >= n]


def unique_runs(page_blocks: list[str], repeated: set[int], least: int = LEAST) -> str:
    """The text of a page's blocks without the words that repeated runs cover."""
    import numpy as np

    ws = [w for b in page_blocks for w in b.split()]
    ids, _, _ = _stream([ws])
    covered = np.zeros(len(ws) + 1, np.int64)
    for i, g in enumerate(_grams(ids[:-1], least).tolist()):
        if g in repeated:
            covered[i] += 1
            covered[min(len(ws), i + least)] -= 1
    covered = np.cumsum(covered)
    return " ".join(w for w, c in zip(ws, covered.tolist()[:-1], strict=True) if not c)


def extracted(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK, share: float = SHARE, fewest: int = PAGES) -> DataFrame:
    """Per page page_id, url, text, n_chars."""
    import pyarrow as pa

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            found = [blocks(h.as_py()) for h in b.column(2)]
            texts = [" ".join(bs) for bs, _ in found]
            keys = [xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m for _, m in found], pa.bool_()), pa.array(texts, pa.string()), pa.array(keys, pa.int64()), pa.array([t.count(" ") + 1 for t in texts], pa.int64())],
                names=["page_id", "url", "marked", "text", "key", "n"],
            )

    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    #: Each page is parsed once: the words of its article, if it marks one, else of what isn't set apart.
    every = written(rows.mapInArrow(parsed, "page_id bigint, url string, marked boolean, text string, key bigint, n bigint"), "pages").withColumn("host", host_of(F.col("url")))
    out = _without(every.filter("marked"), _common(every.filter("marked"), least, chunk, share, fewest), least)
    open_pages = every.filter("not marked")
    return out.unionAll(_by_host(open_pages, least, chunk)) if open_pages.head(1) else out


def _chunks(pages: DataFrame, chunk: int) -> DataFrame:
    """h, pages, chunks of each host: its distinct pages and into how many chunks they are dealt."""
    each = pages.groupBy("host", "key").agg(F.max("n").alias("n")).groupBy(F.col("host").alias("h"))
    return each.agg(F.count(F.lit(1)).alias("pages"), F.greatest(F.ceil(F.sum("n") / chunk), F.lit(1)).alias("chunks"))


def _common(pages: DataFrame, least: int, chunk: int, share: float, fewest: int) -> DataFrame | None:
    """h, grams: by host the strings that stand on `share` of its distinct pages or more, as hashes of LEAST words; None if there are none."""
    import pyarrow as pa

    hosts = counted(_chunks(pages, chunk).filter(F.col("pages") >= fewest), "hosts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        packer = ZstdCompressor(level=6)
        seen: dict[int, None] = {}
        for b in batches:
            new = []
            for i, k in enumerate(b.column(1).to_pylist()):
                if k in seen:
                    del seen[k]  # the ones met last stay
                else:
                    new.append(i)
                seen[k] = None
                if len(seen) > SEEN:
                    del seen[next(iter(seen))]
            b = b.take(pa.array(new, pa.int64()))
            packed = [packer.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(2)]  # texts alone would take twice the disk
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["host", "key", "packed"])

    def told(key: tuple, t: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        texts = dict(zip(t["key"].to_pylist(), t["packed"].to_pylist(), strict=True))
        grams, on = on_pages([unpack(x).decode("utf-8", "surrogatepass").split(" ") for x in texts.values()], share * len(texts) / 2, least)
        n = len(grams)
        return pa.table({"host": pa.array([key[0].as_py()] * n, pa.string()), "gram": pa.array(grams, pa.int64()), "on": pa.array(on, pa.int64()), "of": pa.array([len(texts)] * n, pa.int64())})

    sent = pages.select("host", "key", "text").mapInArrow(once, "host string, key bigint, packed binary")
    dealt = sent.join(hosts, F.col("host") == F.col("h")).select("host", F.pmod("key", "chunks").alias("chunk"), "key", "packed")
    found = dealt.groupBy("host", "chunk").applyInArrow(told, "host string, gram bigint, `on` bigint, of bigint")
    found = written(found.groupBy("host", "gram").agg(F.sum("on").alias("on"), F.sum("of").alias("of")), "candidates")
    # chunks that don't tell a string have it on less than half of `share` of their pages
    found = found.join(hosts, F.col("host") == F.col("h")).filter(F.col("on") + share / 2 * (F.col("pages") - F.col("of")) >= share * F.col("pages")).select("host", "gram")
    if not found.head(1):
        return None

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, grams = [], [], []
            for host, key, text, wanted in zip(*b.columns, strict=True):
                mine = _present(text.as_py(), set(wanted.as_py()), least)
                hosts += [host.as_py()] * len(mine)
                keys += [key.as_py()] * len(mine)
                grams += mine
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(grams, pa.int64())], names=["host", "key", "gram"])

    # the candidates of a host are on over a third of its pages, so they are no more than three times the words of a page
    asked = counted(found.groupBy(F.col("host").alias("h")).agg(F.collect_set("gram").alias("grams")), "asked")
    on = pages.select("host", "key", "text").join(asked, F.col("host") == F.col("h")).select("host", "key", "text", "grams").mapInArrow(held, "host string, key bigint, gram bigint")
    on = on.distinct().groupBy("host", "gram").agg(F.count(F.lit(1)).alias("on"))
    most = on.join(hosts, F.col("host") == F.col("h")).filter(F.col("on") >= share * F.col("pages"))
    most = counted(most.groupBy("h").agg(F.collect_set("gram").alias("grams")), "common")
    return most if most.head(1) else None


def _present(text: str, wanted: set[int], least: int) -> list[int]:
    ids, _, _ = _stream([text.split(" ")])
    return list(wanted.intersection(_grams(ids[:-1], least).tolist()))


def _without(pages: DataFrame, common: DataFrame | None, least: int) -> DataFrame:
    """page_id, url, text, n_chars of pages without their host's common strings."""
    import pyarrow as pa

    if common is None:
        return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unique_runs([t], set(g), least) if g else t for t, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(common, F.col("host") == F.col("h"), "left").select("page_id", "url", "text", "grams")
    return joined.mapInArrow(cleaned, "page_id bigint, url string, text string, n_chars bigint")


def _by_host(open_pages: DataFrame, least: int, chunk: int) -> DataFrame:
    import pyarrow as pa

    chunks = counted(_chunks(open_pages, chunk), "chunks")
    dealt = open_pages.join(chunks, F.col("host") == F.col("h")).withColumn("chunk", F.pmod(F.xxhash64("key", "page_id"), F.col("chunks"))).select("page_id", "url", "host", "chunk", "text", "key")
    dealt = written(dealt, "chunks")

    def told(key: tuple, t: pa.Table) -> pa.Table:
        gram, lo, hi = repeated_starts([x.split() for x in t["text"].to_pylist()], t["key"].to_pylist(), least)
        n = len(gram)
        return pa.table({"host": pa.array([key[0].as_py()] * n, pa.string()), "chunk": pa.array([key[1].as_py()] * n, pa.int64()), "gram": pa.array(gram), "lo": pa.array(lo), "hi": pa.array(hi)})

    grams = written(dealt.groupBy("host", "chunk").applyInArrow(told, "host string, chunk bigint, gram bigint, lo bigint, hi bigint"), "starts")
    every = grams.groupBy("host", "gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select(F.col("host").alias("h"), F.col("gram").alias("g"))
    back = grams.join(every, (F.col("host") == F.col("h")) & (F.col("gram") == F.col("g"))).select("host", "chunk", "gram")

    def cleaned(t: pa.Table, r: pa.Table) -> pa.Table:
        repeated = set(r["gram"].to_pylist())
        texts = [unique_runs([x], repeated, least) for x in t["text"].to_pylist()]
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return dealt.groupBy("host", "chunk").cogroup(back.groupBy("host", "chunk")).applyInArrow(cleaned, "page_id bigint, url string, text string, n_chars bigint")
