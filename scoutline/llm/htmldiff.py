"""Main text of web pages by differencing against the page with the nearest URL.

A page is read into lines (blocks of text) that know what they stand in: page furniture (by element, class, id or role),
an article, or plain body, and whether they are prose (paragraph, heading, list item, cell). Pages of a host are put in
order of their URL paths and each is paired with the neighbour whose path has the longer beginning in common. The lines of
the pair are aligned by longest common subsequence. Shared lines are what the site repeats, and they are deleted. Prose
inside an article, which other pages may quote or copy, goes only if it is also a notice: a line that at least five and
half of the pages of the host have. If almost everything outside the furniture is shared, the two pages are copies, and
only notices go. Furniture goes in any case. The main text is what is left in articles, or, if the page has none, what is
left at all.

The order is a global range sort of small rows (host, path, line hashes), so a host with a third of all pages is cut into
many tasks; neighbours across the cuts are found by joining on consecutive positions. Only pages that lose lines by
differencing are joined back to their html, by a key of the whole row.

Null html is an empty page; a page without url, or alone on its host, is not differenced. Equal rows (id, url and html) are
one page in the order and each get the result. Paths that tie are ordered by row key. Other columns are ignored, null ids
carried. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import only

# The roles of HTML elements, and words in class, id or role that mark page furniture.
RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "select", "canvas", "head"}
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
CONTAINERS = set("article aside body blockquote button details dialog div dl fieldset figure footer form header main menu nav ol section span table ul".split())
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MARKS = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted
promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
_CELLS, _ROWS = {"td", "th"}, {"tr", "tbody", "tfoot", "thead"}
#: Blocks that are no containers -> the tags that end them besides their own end.
ENDED_BY = ({"p": BLOCK, "li": {"li"}, "tr": _ROWS, "option": {"option"}} | dict.fromkeys(("dt", "dd"), {"dt", "dd"}) | dict.fromkeys(_CELLS, _CELLS | _ROWS)
            | dict.fromkeys(("tbody", "tfoot", "thead"), _ROWS - {"tr"}) | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), {"h1", "h2", "h3", "h4", "h5", "h6"})
            | dict.fromkeys(("address", "caption", "center", "dir", "figcaption", "legend", "pre", "summary"), set()))
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar"}
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: What a name of furniture may have besides: a "share-bar" is one, a "sidebar-mini" page only has one.
PARTS = set("area bar block body box container content form inner item items link links list outer panel region section text top bottom wrap wrapper".split())
NEGATIONS = {"has", "with", "no", "without", "not"}
COPY_SHARE = 0.8  # of the characters outside the furniture
LEAST_PAGES = 5  # of a host that have a line, for it to be a notice and not a quotation
CHUNK = 256  # pages

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NOT_WORD = re.compile(r"[^a-z0-9]+")

Line = tuple[str, int, bool, bool]  # text, furniture depth, in an article, prose


# How an element is marked. WEAK: a word in a longer name ("sidebar-mini"); STRONG: a name of its own, a role, or a form.
WEAK, STRONG, TALK, ELEMENT = 1, 2, 3, 4


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """0, or how the element is marked as furniture."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return STRONG if tag == "form" else ELEMENT
    if not attributes:
        return 0
    names, role = [], ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            role = value
        else:
            names += [set(NOT_WORD.split(v)) - {""} for v in value.split()]
    found = set().union(*names)
    if tag in ("article", "main", "body", "header"):
        return TALK if found & COMMENTS else 0
    if role in ROLES:
        return STRONG
    marks = MARKS - {"header"} if in_article or tag not in CONTAINERS else MARKS
    if found & NEGATIONS or not found & marks:  # a container "with-sidebar" is not the sidebar
        return 0
    if any(n & COMMENTS and n <= marks | PARTS for n in names):
        return TALK
    return STRONG if any(n & marks and n <= marks | PARTS for n in names) else WEAK


def lines_of(page: str) -> list[Line]:
    """The blocks of text of a page in order, character references decoded, white space turned into single spaces."""
    out: list[tuple[str, tuple[int, ...], bool, bool, bool]] = []  # text, marked elements around, in an article, prose, list item
    stack: list[tuple[str, int]] = []  # open containers and marked blocks: name, and the number of a marked element or -1
    marked: list[tuple[int, bool]] = []  # how an element is marked, whether it stands in an article
    around: list[int] = []  # the open marked elements
    holds: dict[int, str] = {}  # marked element -> article or main inside
    buffer: list[str] = []
    articles = 0
    prose = item = False

    def flush() -> None:
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            buffer.clear()
            if text:
                out.append((text, tuple(around), articles > 0, prose, item))

    def close(depth: int) -> None:
        nonlocal articles
        for gone, number in stack[depth:]:
            if number >= 0:
                around.remove(number)
            articles -= gone in ("article", "main")
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                at = stop.end() if stop else end
                if tag == "head" or tag == "title":
                    flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            prose, item = tag in PROSE and not closing, tag == "li" and not closing
            while stack and tag in ENDED_BY.get(stack[-1][0], ()) and not (closing and stack[-1][0] != "p"):
                close(len(stack) - 1)
        if tag in CONTAINERS or tag in ENDED_BY:
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None and tag in ENDED_BY and any(s[0] in CONTAINERS and s[0] != "span" for s in stack[depth:]):
                    depth = None  # the end of an unmarked block further inside
                if depth is not None:
                    if tag == "span" and any(s[1] >= 0 for s in stack[depth:]):
                        flush()
                    close(depth)
            elif not attributes.endswith("/"):
                how = _furniture(tag, attributes, articles > 0)
                if how and tag == "span":
                    flush()
                if tag in ("article", "main"):
                    articles += 1
                    if not how:
                        holds |= {k: tag for k in around if holds.get(k) != "main"}
                if how:
                    around.append(len(marked))
                    marked.append((how, articles > 0))
                if how or tag in CONTAINERS:
                    stack.append((tag, len(marked) - 1 if how else -1))
    flush()
    spared = _spared(out, marked, holds) if marked else set()
    return [(text, sum(k not in spared for k in inside), article, is_prose) for text, inside, article, is_prose, _ in out]


def _spared(lines: list[tuple], marked: list[tuple[int, bool]], holds: dict[int, str]) -> set[int]:
    """The marked elements that are not furniture, since the page would lose its text with them.

    One that encloses a main, or an article without being named as furniture outright; if no article is left, all that
    enclose one; those with most of the text; and if nothing is left, all but menus and the like.
    """
    how = lambda k: marked[k][0]
    spared = {k for k, tag in holds.items() if how(k) != TALK and (tag == "main" or how(k) == WEAK)}
    left = lambda line: all(k in spared for k in line[1])
    if not any(line[2] and left(line) for line in lines):
        spared |= {k for k in holds if how(k) != TALK}
    has_article = any(line[2] and left(line) for line in lines)
    total, size = 0, dict.fromkeys(range(len(marked)), 0)
    for text, around, _, _, item in lines:
        if not item and not any(how(k) == ELEMENT and k not in spared for k in around):
            total += len(text)
            for k in around:
                size[k] += len(text)
    for k, n in size.items():
        if how(k) == WEAK and 2 * n > total and (marked[k][1] or not has_article):
            spared.add(k)
        elif how(k) == STRONG and 5 * n > 4 * total and not marked[k][1] and not has_article:
            spared.add(k)
    if not any(left(line) for line in lines):
        spared |= {k for k in size if how(k) != ELEMENT}
    return spared


def _deletable(line: Line) -> bool:
    """Whether a shared line goes: furniture goes anyway, and prose of an article only if the host repeats it."""
    return not line[1] and not (line[2] and line[3])


def line_hashes(lines: list[Line]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(line[0].encode("utf-8", "surrogatepass")) - 2**63 for line in lines]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of one longest common subsequence of a and b.

    The table of the usual dynamic programme is kept as one integer per row, a bit per column (set where the length does
    not grow), so n lines against m take n operations on m bits. Equal ends are taken off first.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    there = set(b[head:len(b) - tail])
    rows = [i for i in range(head, len(a) - tail) if a[i] in there]
    here = {a[i] for i in rows}
    columns = [x for x in b[head:len(b) - tail] if x in here]
    middle: list[int] = []
    if rows:
        where: dict[int, int] = {}
        for j, x in enumerate(columns):
            where[x] = where.get(x, 0) | (1 << j)
        full = (1 << len(columns)) - 1
        state, table = full, []
        for i in rows:
            u = state & where[a[i]]
            state = ((state + u) | (state - u)) & full
            table.append(state)
        i, j = len(rows), len(columns)
        while i and j:
            if table[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or table[i - 1] >> (j - 1) & 1:
                    middle.append(rows[i])
                    j -= 1
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def main_text(lines: list[Line], gone: set[int]) -> str:
    """What is left of the lines once furniture and the lines at positions `gone` are out."""
    left = [line for k, line in enumerate(lines) if not line[1] and k not in gone]
    inside = [line for line in left if line[2]]
    return "\n\n".join(line[0] for line in inside or left)


def to_delete(flags: list[int], shared: list[int], sizes: list[int], notices: set[int] = frozenset()) -> list[int]:
    """The shared positions that go. flags: 0 furniture, 1 prose of an article, 2 other; notices: positions of lines that the
    host repeats. Only these if the pages are copies; none if they are almost all there is, or all prose of the article."""
    body = sum(s for s, f in zip(sizes, flags, strict=True) if f)
    copies = sum(sizes[k] for k in shared if flags[k]) >= COPY_SHARE * body
    again = {k for k in shared if flags[k] and k in notices}
    if sum(sizes[k] for k in again) >= COPY_SHARE * body or not {k for k, f in enumerate(flags) if f == 1} - again:
        again = set()
    return [k for k in shared if k in again or (flags[k] == 2 and not copies)]


def keyed(pages: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return only(pages, "page_id", "url", "html").withColumn("key", F.unhex(F.md5(F.concat_ws("\1", text("page_id"), text("url"), text("html")))))


LINES = "key binary, host string, path string, hashes array<bigint>, flags array<tinyint>, sizes array<int>"


def page_lines(pages: DataFrame) -> DataFrame:
    """key, host, path and, per line, its hash, what it is, and its length, of the pages that have an url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [lines_of(h) for h in batch.pop("html")]
            yield batch.assign(hashes=[np.array(line_hashes(x), np.int64) for x in lines], sizes=[np.array([len(v[0]) for v in x], np.int32) for x in lines],
                               flags=[np.array([0 if v[1] else 2 if _deletable(v) else 1 for v in x], np.int8) for x in lines])

    url = F.col("url")
    return (keyed(pages).filter(url.isNotNull())
            .select("key", F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
                    F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
            .mapInPandas(run, LINES))


def in_order(lines: DataFrame) -> DataFrame:
    """Adds `at`, the position of each distinct page by (host, path, key). The driver sees one count per range partition."""
    placed = cut_lineage(lines.dropDuplicates(["key"]).repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
                         .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, total = {}, 0
    for p, n in sorted(placed.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()):
        before[p], total = total, total + n
    if not before:
        return placed.withColumn("at", F.col("place"))
    offsets = F.array(*[F.lit(before.get(p, 0)).cast("bigint") for p in range(max(before) + 1)])
    return placed.withColumn("at", F.col("place") - F.shiftleft(part, 33) + F.get(offsets, part.cast("int")))


def _begins_alike(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def repeated(placed: DataFrame) -> DataFrame:
    """(host, chunk, notices): hashes of the lines that stand in articles of the host as prose, on `LEAST_PAGES` pages or more
    and on half of its pages. A host has one row per `CHUNK` positions of its pages, so that a large one is not one key.
    """
    chunk = F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor(F.col("last") / CHUNK))).alias("chunk")
    hosts = (placed.groupBy("host").agg(F.count("*").alias("pages"), F.min("at").alias("first"), F.max("at").alias("last"))
             .filter(F.col("pages") >= LEAST_PAGES))
    prose = F.array_distinct(F.transform(F.filter(F.arrays_zip("hashes", "flags"), lambda x: x["flags"] == 1), lambda x: x["hashes"]))
    counts = (placed.select("host", F.floor(F.col("at") / CHUNK).alias("chunk"), prose.alias("prose"))
              .join(hosts.select("host", "pages", "first", "last", chunk), ["host", "chunk"])
              .select("host", "pages", "first", "last", F.explode("prose").alias("hash"))
              .groupBy("host", "hash").agg(F.count("*").alias("n"), F.first("pages").alias("pages"), F.first("first").alias("first"), F.first("last").alias("last"))
              .filter((F.col("n") >= LEAST_PAGES) & (2 * F.col("n") >= F.col("pages"))))
    # at most twice as many lines as an article of the host has on average
    return cut_lineage(counts.groupBy("host", "first", "last").agg(F.collect_list("hash").alias("notices")).select("host", chunk, "notices"))


def differences(pages: DataFrame) -> DataFrame:
    """(key, gone: positions of the lines that differencing deletes) of the pages that lose any."""
    placed = in_order(page_lines(pages))
    side = lambda step, name: placed.select((F.col("at") + step).alias("at"), "host", F.col("path").alias(f"{name}_path"), F.col("hashes").alias(f"{name}_hashes"))
    both = (placed.join(side(1, "last"), ["at", "host"], "left").join(side(-1, "next"), ["at", "host"], "left")
            .withColumn("chunk", F.floor(F.col("at") / CHUNK)).join(repeated(placed), ["host", "chunk"], "left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, gone = [], []
            for r in batch.itertuples(index=False):
                last, following = r.last_path is not None, r.next_path is not None
                if not last and not following:
                    continue
                # the nearest url: the longer common beginning, the following page on a tie
                take_last = last and (not following or _begins_alike(r.path, r.last_path) > _begins_alike(r.path, r.next_path))
                other = r.last_hashes if take_last else r.next_hashes
                hashes = r.hashes.tolist()
                notices = set() if r.notices is None else set(r.notices.tolist())
                cut = to_delete(r.flags.tolist(), common_lines(hashes, other.tolist()), r.sizes.tolist(), {k for k, h in enumerate(hashes) if h in notices})
                if cut:
                    keys.append(r.key), gone.append(np.array(cut, np.int32))
            if keys:
                yield pd.DataFrame({"key": keys, "gone": gone})

    return (both.select("key", "path", "hashes", "flags", "sizes", "last_path", "last_hashes", "next_path", "next_hashes", "notices")
            .mapInPandas(run, "key binary, gone array<int>"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    gone = cut_lineage(differences(pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(lines_of(h), set() if g is None else set(g.tolist())) for h, g in zip(batch["html"], batch["gone"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text})

    rows = keyed(pages).join(gone, "key", "left").select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), "gone")
    return rows.mapInPandas(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
