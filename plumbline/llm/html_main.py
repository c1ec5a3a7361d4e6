"""Main text of web pages: element subtrees that recur on many pages of a host are templates and go.

What goes is decided by counts over all pages: a subtree that recurs on its host; and an element whose name (its tag, classes
and id) mostly marks such subtrees, wherever it stands, so that what a host's few pages or changing contents hide goes too.
Markup's own statements (nav, footer, form, hidden, roles, and names such as `ad` or `comments`) stand in where neither can tell.
Everything else stays, inside an article or outside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, pieces, stored

#: A subtree is a template if so many different parts of its host have it, and as many as so large a share of the host's pages;
#: the share asks for MOST_PAGES at most, so that a template goes on hosts of every size.
LEAST_PAGES, LEAST_SHARE, MOST_PAGES = 5, 0.01, 100
#: A subtree without a name of its own recurs by chance if it has fewer words. Headings, paragraphs, items and cells without a
#: name are running text, which goes as part of a larger template only.
LEAST_WORDS = 3
#: A name marks templates if it stands at so many different subtrees and parts on so many hosts, this share of them templates.
NAME_COUNT, NAME_HOSTS, NAME_SHARE = 20, 3, 0.5
#: Pages of a host from which its counts speak for or against a name.
NAME_PAGES = 20
#: Templates that are broadcast, 8 bytes each; more of them are joined instead.
BROADCAST_MOST = 1_000_000
#: Elements may stand in so many others; deeper ones end where they begin, and their contents stay.
DEEPEST = 400

# Elements of HTML and words that pages name their parts by.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp"}
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "input"}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption", "caption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
# A class or id names a part that is no main text if it is one of these words, alone or with the affixes below.
PART = re.compile(
    r"(?:(?:site|page|main|top|bottom|global|user|reader|post|article|google|header|cookie|social|sticky|side)[-_]?)*"
    r"(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|related|replies|reply|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)"
    r"(?:[-_]?(?:list|area|section|bar|bars|box|block|slot|unit|container|wrapper|wrap|thread|form|links|buttons|banner|menu|message|left|right|top|bottom|inner|outer|posts|articles|\d+))*",
    re.I,
)
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"html", "body", "table", "ul", "ol", "dl", "div", "section", "article", "main", "td", "th", "blockquote", "form", "nav", "aside"}

# Possessive, so that a match that fails does so in one pass.
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
RAW_END = {x: re.compile(f"</{x}(?=[\\s/>])[^>]*+>", re.I) for x in RAW}
#: Tags whose quotes never end, after which quotes are taken for letters.
UNENDED = 20
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host in lower case; empty without one. Pages without a host share the empty one."""
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


class Node:
    """An element: what stands in it in order (texts and elements), whether its markup says it is no main text, or states the
    main part, and its name: tag, classes and id without digits, empty without class and id."""

    __slots__ = ("tag", "parts", "out", "main", "name")

    def __init__(self, tag: str, out: bool = False, main: bool = False, name: str = ""):
        self.tag, self.parts, self.out, self.main, self.name = tag, [], out, main, name


def parse(page: str) -> Node:
    """A tree of the page. Broken markup gives some tree and never raises; text of scripts, styles and their like is left out.

    Time is linear in the page but for DEEPEST: no match is tried again, and no open element is looked for that isn't there.
    """
    root = Node("")
    stack = [root]
    open_: dict[str, int] = {}  # how many elements of a tag are open
    at, n, unended = 0, len(page), 0
    last_end = page.rfind(">")

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    def close(tags: set[str], stop: set[str]) -> None:
        """Ends the innermost open element of `tags` that no element of `stop` stands between."""
        if any(open_.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return cut(i)
                if stack[i].tag in stop:
                    return None
        return None

    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end:
            stack[-1].parts.append(page[at:])
            break
        if begin > at:
            stack[-1].parts.append(page[at:begin])
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = NAME.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?"):
                at = page.find(">", at) + 1
            else:
                stack[-1].parts.append("<")
                at += 1
            continue
        q = QUOTED.match(page, m.end()) if unended < UNENDED else None
        if not q:
            unended += 1
        stop = q.end() if q else page.find(">", m.end()) + 1
        attributes = page[m.end() : stop - 1]
        at = stop
        tag = m[1].lower()
        if page[begin + 1] == "/":
            if open_.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], {"table", "ul", "ol", "dl", "select"} if tag != "li" else {"ul", "ol", "menu"})
        a = {x[0].lower(): x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(attributes)} if attributes else {}
        role = a.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article")
        names = f"{a.get('class', '')} {a.get('id', '')}".split()
        out = tag in NOT_TEXT or role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or (not main and tag not in ("html", "body") and any(PART.fullmatch(x) for x in names))
        if tag == "header" and not any(open_.get(x) for x in ("article", "main")) and not any(x.main for x in stack):
            out = True
        node = Node(tag, out, main, re.sub(r"\d+", "", f"{tag} {' '.join(sorted(names))}") if names else "")
        stack[-1].parts.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("use", "path")) and len(stack) < DEEPEST:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def tree_hash(root: Node, host: str) -> dict[int, tuple[int, int, int]]:
    """id(element) -> 64-bit hashes: of host, tags and texts of its subtree (0 if that is too short to tell); of the part it stands
    in; and of its name (0 without one).

    The part is the innermost stated article or main; without one, the smallest container of over half of the page's main text
    where the element is inside that; else the page. It is known by its longest paragraph outside the element, as copies of an
    article, with changes or not, share that: they are one part. Elements that are or hold a stated article or main have no
    entry: they never go.
    """
    order, todo = [], [(root, root)]
    while todo:
        x, part = todo.pop()
        order.append((x, part))
        part = x if x.main else part
        todo += [(p, part) for p in x.parts if isinstance(p, Node)]
    inner: dict[int, bytes] = {}
    size: dict[int, int] = {}  # characters of text that no markup says is no main text
    words: dict[int, int] = {}
    holds: set[int] = set()
    own: list[tuple[Node, Node]] = []
    for x, part in reversed(order):
        d = xxhash.xxh64(x.tag.encode(errors="replace") + b"<")
        chars = count = 0
        for p in x.parts:
            if isinstance(p, Node):
                d.update(inner[id(p)])
                chars += size[id(p)]
                count += words[id(p)]
            else:
                w = p.split()
                text = " ".join(w)
                d.update(text.encode(errors="replace") + b">")
                chars += len(text)
                count += len(w)
        inner[id(x)], size[id(x)], words[id(x)] = d.digest(), 0 if x.out else chars, count
        if x.main or any(isinstance(p, Node) and id(p) in holds for p in x.parts):
            holds.add(id(x))
        elif x.tag not in INLINE and x.tag not in VOID and x.tag not in ("", "html", "body", "head"):
            own.append((x, part))
    inside: set[int] = set()
    middle = root
    if not holds:
        while found := next((p for p in middle.parts if isinstance(p, Node) and not p.out and p.tag not in RUNNING and p.tag not in INLINE and 2 * size[id(p)] > size[id(root)]), None):
            middle = found
        todo = [middle]
        while todo:
            x = todo.pop()
            inside.add(id(x))
            todo += [p for p in x.parts if isinstance(p, Node)]
    longest: dict[int, list[tuple[int, bytes, int, int]]] = {}  # of a part: its paragraphs by length and their places in the order
    place = {id(x): i for i, (x, _) in enumerate(order)}
    reach: dict[int, int] = {}  # the last place inside an element: the order is depth first
    for x, _ in reversed(order):
        reach[id(x)] = max([place[id(x)], *(reach[id(p)] for p in x.parts if isinstance(p, Node))])
    out = {}
    for x, part in order:
        part = middle if middle is not root and x is not middle and id(x) in inside else part
        if x.tag in RUNNING and not x.out and size[id(x)]:
            for whole in {id(part), id(root)}:
                longest.setdefault(whole, []).append((-size[id(x)], inner[id(x)], place[id(x)], id(x)))
    for rows in longest.values():
        rows.sort()
    for x, part in own:
        if middle is not root and x is not middle and id(x) in inside:
            part = middle
        a, b = place[id(x)], reach[id(x)]
        mark = next((h for _, h, at, i in longest.get(id(part), ()) if not a <= at <= b and not at <= a <= reach[i]), inner[id(part)])
        short = not x.name and (x.tag in RUNNING or words[id(x)] < LEAST_WORDS and x.tag in ("div", "section"))
        h = 0 if short or x is middle else _hash(inner[id(x)] + host.encode(errors="replace"))
        out[id(x)] = (h, _hash(mark), _hash(b"name:" + x.name.encode(errors="replace")) if x.name else 0)
    return out


def main_text(root: Node, gone: set[int]) -> str:
    """Blocks of text in page order, joined by two line ends; elements in `gone` (by id) or said to be no main text are left out.
    White space is made single spaces."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                blocks.append(text)
            line.clear()

    work: list = [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            line.append(html.unescape(x))
        elif x is None:
            flush()
        elif x.tag == "br":
            line.append(" ")
        elif not (x.out or id(x) in gone):
            if x.tag in INLINE:
                work += reversed(x.parts)
            else:
                flush()
                work.append(None)
                work += reversed(x.parts)
    flush()
    return "\n\n".join(blocks)


def deleted(root: Node, host: str, known: set[int]) -> set[int]:
    """The ids of the elements whose subtree or name is among the known templates."""
    return {i for i, (h, _, name) in tree_hash(root, host).items() if h in known or name in known} if known else set()


def templates(pages: DataFrame, url: str = "url", text: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Hashes (h) of templates: of subtrees, host included, that recur in at least `least_pages` different parts and on
    `least_share` of their host's pages, or MOST_PAGES if that is fewer; and of names that mostly mark such subtrees.

    A part (see tree_hash) counts once for a subtree, equal parts count once: copies of an article recur as a whole. Pairs of
    subtree and part are dealt by both, then counted by subtree with partial sums before the shuffle, so a host with a third of
    all pages is no hot key; names are counted from those sums, on NAME_HOSTS hosts at least.
    """
    lean(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(iter([batch]), text):
                rows = []
                for u, t in zip(b.column(url).to_pylist(), b.column(text).to_pylist(), strict=True):
                    h = host_of(u)
                    rows += [(h, *x) for x in set(tree_hash(parse(t or ""), h).values()) if x[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "h", "part", "name"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host_of(u) for u in b.column(url).to_pylist()], pa.string())], names=["host"])

    pairs = pages.select(url, text).mapInArrow(run, "host string, h long, part long, name long").distinct()
    counts = stored(pairs.groupBy("host", "h", "name").agg(F.count("*").alias("n")), "subtrees")
    hosts = pages.select(url).mapInArrow(count, "host string").groupBy("host").agg(F.count("*").alias("pages"))
    many = counts.groupBy("host", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_pages)
    found = stored(many.join(hosts, "host").filter(F.col("n") >= F.least(least_share * F.col("pages"), F.lit(float(MOST_PAGES)))).select("host", "h"), "recurring")
    marked = counts.filter("name <> 0").join(hosts.filter(F.col("pages") >= NAME_PAGES), "host", "left_semi").join(found.withColumn("hit", F.lit(1)), ["host", "h"], "left")
    by_host = marked.groupBy("name", "host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("m"))
    names = by_host.groupBy("name").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum((F.col("m") > 0).cast("int")).alias("hosts"))
    names = names.filter((F.col("n") >= NAME_COUNT) & (F.col("hosts") >= NAME_HOSTS) & (F.col("m") >= NAME_SHARE * F.col("n")))
    return found.select("h").unionByName(names.select(F.col("name").alias("h"))).distinct()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_most: int = BROADCAST_MOST) -> DataFrame:
    """One row for each row: key, url, text, n_chars (code points of text).

    Deletes the host's templates, inside articles too, elements whose name marks templates, and what markup itself states to be
    menus, headers, footers, sidebars, notices, adverts, forms or comments; keeps all else. Null or empty html gives an empty text; a null url is the empty host; repeated rows give
    repeated results. Columns of pages other than these three are not read.
    """
    schema = _schema(pages, key, url)
    found = stored(templates(pages, url, text, least_pages, least_share), "templates")
    n = found.count()
    if n <= broadcast_most:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in found.collect()], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone = set(known.value.tolist())
            for batch in batches:
                for b in pieces(iter([batch]), text):
                    yield _extracted(b, [gone] * b.num_rows, schema.names)

        return pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(text).alias(text)).mapInArrow(run, schema)
    return _joined(pages, found, key, url, text)


def _schema(pages: DataFrame, key: str, url: str) -> T.StructType:
    return T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _extracted(b: pa.RecordBatch, gone: list[set[int]], names: list[str]) -> pa.RecordBatch:
    out = []
    for u, t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), gone, strict=True):
        root = parse(t or "")
        out.append(main_text(root, deleted(root, host_of(u), g)))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=names)


def _joined(pages: DataFrame, found: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """The same where templates are too many to broadcast: each page gets those of its own subtrees by two shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                d, hs = [], []
                for m, u, t in zip(*(b.column(c).to_pylist() for c in ("m", "u", "t")), strict=True):
                    own = {h for x in tree_hash(parse(t or ""), host_of(u)).values() for h in (x[0], x[2]) if h}
                    d += [m] * len(own)
                    hs += own
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(hs, pa.int64())], names=["m", "h"])

    schema = _schema(pages, key, url)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(text).alias("t"))
    mark = F.sha1(F.concat(F.coalesce(F.col("u"), F.lit("")), F.lit("\n"), F.coalesce(F.col("t"), F.lit(""))).cast("binary"))
    own = rows.select(mark.alias("m"), "u", "t").mapInArrow(run, "m string, h long").distinct().join(found, "h").groupBy("m").agg(F.collect_list("h").alias("hs"))
    joined = rows.withColumn("m", mark).join(own, "m", "left").select("k", "u", "t", "hs")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                yield _extracted(b, [set(x or ()) for x in b.column("hs").to_pylist()], schema.names)

    return joined.mapInArrow(last, schema)
