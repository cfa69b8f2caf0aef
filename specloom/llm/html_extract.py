"""Operator 2, HTML extraction by consensus host paths.

Every page's containers are scored by the text of their own that isn't linked; containers are known by a generalised
path of tags and classes, without numbers and positions. In Spark, the pages of a host vote on paths with the share
of their score. The winning paths are then extracted from all pages of the host; a page that has none of them falls
back to its own best container.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm.common import pick, ready, small
from specloom.llm.kernel import as_string
from specloom.session import table

#: A path wins besides the best one from this share of the best one's votes on.
RUNNER_UP = 0.5
#: A page's votes; integers, so that sums don't depend on their order. A path's share is rounded down to a 10**9th.
VOTES = 10**9
#: Containers that a path names at most, the innermost ones, and characters of one's classes that it holds in clear.
STEPS, STEP = 32, 200
#: Linked characters count so many times against a container.
LINK_COST = 2

#: Attributes up to the tag's end. Only an equals sign opens a quote, and a quote that isn't closed is an ordinary
#: character. Possessive, so a tag is read once.
_ATTRIBUTES = r"((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]|=)*+)>"
_NAME = r"(/?)([a-zA-Z][^\s/>]*+)"
_TAG = re.compile(_NAME + _ATTRIBUTES)
_PLAIN_TAG = re.compile(_NAME + r"([^>]*+)>")
_CLASS = re.compile(r"(?:^|\s|[\"'/])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("body div article section main td th center blockquote dd details figure nav aside header footer form table ul ol dl".split())
#: What is in these is none of a page's text, unless they are left open.
_DROPPED = frozenset("head nav aside footer button select option title".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li tr pre br hr dt address figcaption summary caption".split())
#: Tags that a head may hold; any other one ends it.
_IN_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Tags that hold raw text up to their own end.
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
#: Tags whose opening ends an open one of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_SCOPE = frozenset("table ul ol dl body article section main div td th".split())


class Container(NamedTuple):
    """Number of the container around it, generalised path, whether the text in it counts, and how many are around it."""

    parent: int
    path: str
    live: bool
    depth: int


def generalise(tag: str, attributes: str) -> str:
    """Tag with its classes, sorted, runs of digits as ``#``; a long list of classes is known by its hash."""
    m = _CLASS.search(attributes) if attributes else None
    names = sorted({re.sub(r"\d+", "#", c.lower().replace(">", "")) for c in (m[1] or m[2] or m[3] or "").split()}) if m else []
    step = ".".join([tag, *names])
    return step if len(step) <= STEP else f"{tag}.~{hashlib.md5(step.encode('utf-8', 'replace')).hexdigest()}"


def _path(outer: Container, step: str) -> str:
    """Path of a container inside ``outer``: its own step and those around it, the innermost ``STEPS``."""
    path = f"{outer.path}>{step}" if outer.path else step
    return path if outer.depth < STEPS else path.split(">", 1)[1]


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    attributes: str


def tags(page: str) -> list[Tag]:
    """Tags of a page in order, in time linear in its length; a piece that is no text (a comment, raw text) is a tag without a name.

    Comments and raw text that aren't closed run to the page's end. If a tag isn't closed because of its quotes,
    quotes count for nothing from there on; what follows the last tag is text, with ``<`` in it or not.
    """
    out, at, last = [], 0, page.rfind(">")
    pattern = _TAG
    while True:
        at = page.find("<", at)
        if at < 0:
            return out
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append(Tag(at, end, False, "", ""))
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
            out.append(Tag(at, end, False, "", ""))
        elif at > last:
            return out
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            out.append(Tag(at, end, False, "", ""))
        else:
            m = pattern.match(page, at + 1)
            if m is None and pattern is _TAG and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                pattern = _PLAIN_TAG
                m = pattern.match(page, at + 1)
            if m is None:
                at += 1
                continue
            end, name = m.end(), m[2].lower()
            raw = not m[1] and name in _RAW
            if raw and (name != "svg" or not m[3].endswith("/")):
                close = _RAW_END[name].search(page, end)
                end = close.end() if close else len(page)
            out.append(Tag(at, end, bool(m[1]), "" if raw else name, m[3]))
        at = end


def parse(page: str) -> tuple[list[Container], list[tuple[int, str | None, bool]]]:
    """Containers in order, and pieces of text: container, text (None for a block's edge), linked or not.

    Text outside of any container belongs to number 0, the page itself. Broken nesting is mended: an end tag without
    a beginning is skipped, one that ends several tags ends them all, a head ends where a tag begins that it can't
    hold, and a page's end ends everything. A dropped tag that no end tag of its own closes drops nothing. Line feeds
    in ``pre`` are edges; elsewhere they are white space.
    """
    found = tags(page)
    nodes, pieces, open_ = _build(page, found, frozenset())
    return (nodes, pieces) if not open_ else _build(page, found, open_)[:2]


def _build(page: str, found: list[Tag], harmless: frozenset[int]) -> tuple[list[Container], list[tuple[int, str | None, bool]], frozenset[int]]:
    """As ``parse``, and the dropped tags that were left open; those in ``harmless`` drop nothing."""
    nodes, pieces = [Container(-1, "", True, 0)], []
    stack: list[tuple[str, int, int, int, int]] = []  # tag, container, dropped, linked, number
    depth_of: dict[str, list[int]] = {}
    unclosed: set[int] = set()
    node = dropped = linked = pre = at = 0

    def text(raw: str) -> None:
        for k, line in enumerate(raw.split("\n") if pre else [raw.replace("\n", " ")]):
            if k:
                pieces.append((node, None, False))
            pieces.append((node, line, linked > 0))

    def cut(depth: int, own: bool) -> None:
        """End the tags from ``depth`` on; the first of them by its own end tag or not."""
        nonlocal node, dropped, linked, pre
        for d in range(len(stack) - 1, depth - 1, -1):
            name = stack[d][0]
            depth_of[name].pop()
            pre -= name == "pre"
            if name in _DROPPED and name not in ("head", "option") and not (own and d == depth):
                unclosed.add(stack[d][4])
        _, node, dropped, linked, _ = stack[depth]
        del stack[depth:]

    for i, t in enumerate(found):
        if t.start > at and not dropped:
            text(page[at : t.start])
        at = t.end
        tag = t.name
        if not tag:
            continue
        if not t.closing and depth_of.get("head") and tag not in _IN_HEAD:
            cut(depth_of["head"][-1], True)
        if tag in _BLOCK and not dropped:
            pieces.append((node, None, False))
        if t.closing:
            if depth_of.get(tag):
                cut(depth_of[tag][-1], True)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            floor = max((depth_of[x][-1] for x in _SCOPE if depth_of.get(x) and x not in _CLOSES[tag]), default=-1)
            inner = [depth_of[x][-1] for x in _CLOSES[tag] if depth_of.get(x) and depth_of[x][-1] > floor]
            if inner:
                cut(max(inner), True)
        if t.attributes.endswith("/") and tag not in _BLOCK:
            continue
        depth_of.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, dropped, linked, i))
        linked += tag == "a"
        pre += tag == "pre"
        dropped += tag in _DROPPED and i not in harmless
        if tag in _CONTAINER:
            nodes.append(Container(node, _path(nodes[node], generalise(tag, t.attributes)), not dropped, nodes[node].depth + 1))
            node = len(nodes) - 1
    if at < len(page) and not dropped:
        text(page[at:])
    unclosed |= {t[4] for t in stack if t[0] in _DROPPED and t[0] not in ("head", "option")}
    return nodes, pieces, frozenset(unclosed)


def scores(page: str) -> dict[str, int]:
    """Score of every path: characters of its containers' own text, linked ones against it."""
    nodes, pieces = parse(page)
    out: dict[str, int] = {}
    for node, text, linked in pieces:
        n = len("".join(text.split())) if text else 0
        if n:
            path = nodes[node].path
            out[path] = out.get(path, 0) + (-LINK_COST * n if linked else n)
    return out


def votes(page: str) -> dict[str, int]:
    """A page's votes by path, in proportion to the scores above 0."""
    good = {p: s for p, s in scores(page).items() if s > 0}
    total = sum(good.values())
    return {p: VOTES * s // total for p, s in good.items() if VOTES * s // total}


def clean(raw: str) -> str:
    """Entities decoded, white space made one space, a line for every block that isn't empty."""
    lines = (_SPACE.sub(" ", line).strip() for line in _html.unescape(raw).split("\n"))
    return "\n".join(line for line in lines if line)


def extract(page: str, paths: list[str] | None) -> tuple[str, str, bool]:
    """Text in containers of the winning paths, the first such path, and whether there was one."""
    nodes, pieces = parse(page)
    won = set(paths or ())
    inside, first = [False] * len(nodes), None
    for i, c in enumerate(nodes):
        own = c.path in won and c.live
        inside[i] = own or (c.parent >= 0 and inside[c.parent])
        if own and first is None:
            first = c.path
    found = first is not None
    if not found:
        ranked = sorted(scores(page).items(), key=lambda x: (-x[1], len(x[0]), x[0]))
        if not ranked or ranked[0][1] <= 0:
            return "", "", False
        first = ranked[0][0]
        for i, c in enumerate(nodes):
            inside[i] = c.path == first or (c.parent >= 0 and inside[c.parent])
    return clean("".join("\n" if t is None else t for n, t, _ in pieces if inside[n])), first, found


def host_of(url: F.Column) -> F.Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


_VOTE = pa.list_(pa.struct([("path", pa.string()), ("votes", pa.int64())]))
_TEXT = pa.struct([("text", pa.string()), ("path", pa.string()), ("consensus", pa.bool_())])


def _votes(page: F.Column) -> F.Column:
    @arrow_udf("array<struct<path string, votes bigint>>")
    def count(pages: pa.Array) -> pa.Array:
        return pa.array([[{"path": p, "votes": n} for p, n in votes(x).items()] for x in as_string(pages).to_pylist()], _VOTE)

    return count(page)


def _extract(page: F.Column, paths: F.Column) -> F.Column:
    @arrow_udf("struct<text string, path string, consensus boolean>")
    def text(pages: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("text", "path", "consensus"), extract(x, p))) for x, p in zip(as_string(pages).to_pylist(), paths.to_pylist())], _TEXT)

    return text(page, paths)


def winning_paths(pages: DataFrame, runner_up: float = RUNNER_UP) -> DataFrame:
    """``host`` and its winning ``paths``. Of equal votes the shorter path comes first, then the smaller."""
    p = pick(pages, "url", "html").select(host_of(F.col("url")).alias("host"), F.explode(_votes(F.col("html"))).alias("v"))
    total = p.groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.votes").alias("votes"))
    best = total.withColumn("top", F.max("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= F.col("top") * runner_up)
    ranked = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.length("path").alias("n"), "path"))).alias("p"))
    return ranked.select("host", F.col("p.path").alias("paths"))


def extract_pages(pages: DataFrame, runner_up: float = RUNNER_UP) -> DataFrame:
    """Main text of every page, with its host, the path that it is from, and whether the host agreed on that.

    NULL and empty pages, and pages without unlinked text, have an empty text and path. Pages without a host (NULL or
    relative URLs) vote as one host named ``''``. Rows with NULL ids and repeated rows are extracted, and vote, like
    all others. An empty table gives an empty one.
    """
    ready(pages)
    won = winning_paths(pages, runner_up).checkpoint()
    p = pick(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    joined = p.join(small(won.withColumnRenamed("host", "won_host")), F.col("host") == F.col("won_host"), "left")
    return joined.select("page_id", "host", _extract(F.col("html"), F.col("paths")).alias("x")).select("page_id", "host", "x.path", "x.consensus", "x.text")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
