"""Main text of web pages by site style trees.

All pages of a host are merged into one tree: an element is told by the path of its tags and
classes. For every element the tree has the different sequences of children it shows
(presentation), the different contents of its branch, how often each occurs, and how many
characters and places it takes on a page. The entropy of presentation and of content,
relative to the number of sightings, is its importance: a menu looks and reads alike on all
pages, an article doesn't. Content importance times characters is what a branch tells; its
share of what the whole page tells decides:

* The main branch is the deepest element that holds more than half. Beside it stay branches
  that hold OWN of the page (article and main elements: MAIN_OWN), unless their names speak
  against them. All other branches outside go.
* Inside, a branch of low importance and share goes where its content is common on the host,
  and so do branches whose names speak against them (navigation, adverts, forms, comments).

Scripts, styles and the like are never text. Pages of a host that have the same contents
outside branches whose names speak against them are one page in these counts, however many
copies there are. Counts of one host are mixed with the counts of all hosts, so that hosts
of few pages are judged by what is usual. A page without any of its host's main branches is
judged by its own characters.

Cases: a null or empty html gives an empty text and 0 characters; a null url is a host of its
own; unclosed and misnested tags are closed where their parent ends, however deep they are
nested; repeated rows give repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import fits, settled, slices

#: Importance (0 to 1) below which a branch is low. Pages that the counts of all hosts weigh beside a host's own.
LEAST, PRIOR = 0.35, 10
#: Shares of what a page tells: of the main branch, of other branches that stay outside it, of such article and main elements. Places on a page that a main branch may have on average.
MAIN_SHARE, OWN, MAIN_OWN, PLACES = 0.5, 0.2, 0.05, 1.5
MAX_BROADCAST = 32_000_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Never text.
FLOOR = frozenset("head script style noscript iframe template button select option textarea title svg math object canvas dialog".split())
#: Tags and parts of class, id and role names that speak against a branch.
DOUBTED = frozenset("nav header footer aside form menu".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|share|social|related|recommend\w*|comments?|replies|respond|disqus|reader-?\w*|login|search|widget|toolbar|pagination|pager|skip|legal|copyright|complementary|contentinfo|navigation)(?=$|[\s_-]|\d)", re.I)
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/><]*)((?:[^>\"'<]|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: A tag that opens closes these open siblings.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"br", "hr", "li", "dt", "dd", "tr", "td", "th", "html", "body"}}
ROOT = 0
#: Tags and paths that a worker remembers; longer tags aren't remembered.
REMEMBERED, LONGEST = 20_000, 200


@dataclass(slots=True)
class Node:
    tag: str
    style: str
    path: int  # hash of the styles from the root to here
    up: int  # the parent's place in the list of nodes
    above: int  # the parent's path
    doubted: bool = False
    children: list = field(default_factory=list)  # places of nodes, and texts
    texts: list = ()  # its own texts, white space as one space, from summed on
    content: int | None = None  # hash of the branch's texts in their order; None without text
    chars: int = 0  # of the branch


def digest(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def spaced(text: str) -> str:
    """White space as one space, trimmed."""
    return " ".join(text.split())


def tag_told(name: str, attributes: str) -> tuple[str, str, bool, bool]:
    """An opening tag's name, its style, whether it speaks against its branch, and whether it closes itself."""
    name = name.lower()
    values = {a.lower(): (x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = " ".join(values[a] for a in ("class", "id", "role") if values.get(a))
    style = name + ("." + re.sub(r"\d+", "0", values["class"]) if values.get("class") else "")
    doubted = name in DOUBTED or bool(names and NAMED.search(names)) and name not in ("html", "body", "article", "main") or "hidden" in attributes.lower().split() or values.get("aria-hidden") == "true"
    return name, style, doubted, attributes.rstrip().endswith("/")


told_again = lru_cache(REMEMBERED)(tag_told)


@lru_cache(REMEMBERED)
def path_of(above: int, style: str) -> int:
    return digest(f"{above}/{style}")


def parse(page: str, sums: bool = True) -> list[Node]:
    """The page's elements in their order, the root first: parents come before their children. Never fails, and takes time in proportion to the page. sums: with contents and characters of branches."""
    nodes = [Node("#root", "", ROOT, -1, -1)]
    stack, opened, endless, at, n = [0], Counter(), set(), 0, len(page)
    # places in the stack that a tag that opens can close or must stop at; only a few are ever passed
    marks: list[int] = []
    ends = {}

    def close(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]
        while marks and marks[-1] >= k:
            marks.pop()

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            nodes[stack[-1]].children.append(text)
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if opened[name]:
                k = len(stack) - 1
                while nodes[stack[k]].tag != name:
                    k -= 1
                close(k)
        elif m[2]:
            name, style, doubted, closed = (told_again if len(m[3]) <= LONGEST else tag_told)(m[2], m[3])
            if name in CLOSES:
                for k in reversed(marks):
                    tag = nodes[stack[k]].tag
                    if tag in CLOSES[name]:
                        close(k)
                        break
                    if tag in BLOCK and tag != "p":
                        break
            above = nodes[stack[-1]].path
            nodes.append(Node(name, style, (path_of if len(style) <= LONGEST else path_of.__wrapped__)(above, style), stack[-1], above, doubted))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            if name in RAW:
                end = None
                if name not in endless:
                    ends.setdefault(name, re.compile(rf"</{name}\s*>", re.I))
                    if not (end := ends[name].search(page, at)):
                        endless.add(name)
                if not end and name in ("script", "style", "title", "textarea"):
                    at = n
                elif end:
                    nodes[-1].children.append(page[at : end.start()])
                    at = end.end()
            elif name not in VOID and not closed:
                if name in BLOCK or name == "option":
                    marks.append(len(stack))
                stack.append(len(nodes) - 1)
                opened[name] += 1
    if sums:
        summed(nodes)
    return nodes


def summed(nodes: list[Node]) -> None:
    """Content and characters of every branch, children before parents."""
    for node in reversed(nodes):
        if node.tag in FLOOR:
            continue
        parts, texts, chars = [], [], 0
        for c in node.children:
            if isinstance(c, str):
                if own := spaced(c):
                    parts.append(own)
                    texts.append(own)
                    chars += len(own)
            elif nodes[c].content is not None:
                parts.append(f"\0{nodes[c].path}:{nodes[c].content}")
                chars += nodes[c].chars
        if parts:
            node.content, node.chars, node.texts = digest("\0".join(parts)), chars, texts


def observed(nodes: list[Node]) -> tuple[int, list[tuple[Node, int]]]:
    """A key of the page's contents outside doubted branches; and every element outside the floor with the hash of its presentation: its children's styles, runs as one."""
    seen, gone, doubted, texts = [], set(), set(), []
    for i, node in enumerate(nodes):
        if node.tag in FLOOR or node.up in gone:
            gone.add(i)
            continue
        if node.doubted or node.up in doubted:
            doubted.add(i)
        if i not in doubted:
            texts += [f"{node.path}:{own}" for own in node.texts]
        styles: list[str] = []
        for c in node.children:
            if not isinstance(c, str) and nodes[c].tag not in FLOOR and (not styles or styles[-1] != nodes[c].style):
                styles.append(nodes[c].style)
        seen.append((node, digest(",".join(styles)) if styles else 0))
    return digest("\0".join(texts)), seen


def alone(nodes: list[Node]) -> set[int]:
    """The main branch of a page by its own characters."""
    main = nodes[0]
    for node in nodes[1:]:
        if nodes[node.up] is main and node.tag not in FLOOR and node.chars > MAIN_SHARE * nodes[0].chars:
            main = node
    return {main.path}


def blocks(page: str, kept: set[int], common: set[tuple[int, int]]) -> list[str]:
    """Texts of the blocks that stay: white space as one space, trimmed, empty ones left out. kept: paths of the host's main branches; common: (path, content) of low branches."""
    nodes = parse(page, False)
    if not any(node.path in kept for node in nodes):
        summed(nodes)
        kept, common = alone(nodes), set()
    elif common:
        summed(nodes)
    out: list[str] = []
    part: list[str] = []

    def cut() -> None:
        if part:
            text = spaced(entities.unescape("".join(part)))
            part.clear()
            if text:
                out.append(text)

    # an element, its children that are still to come, and whether it lies in a main branch
    root = nodes[0]
    todo = [(root, iter(root.children), root.path in kept)]
    while todo:
        node, children, inside = todo[-1]
        c = next(children, None)
        if c is None:
            todo.pop()
            if node.tag in BLOCK:
                cut()
        elif isinstance(c, str):
            if inside:
                part.append(c)
        else:
            child = nodes[c]
            main = child.path in kept
            if child.tag in BLOCK:
                cut()
            if child.tag in FLOOR or not main and inside and (child.doubted or child.content is not None and (child.path, child.content) in common):
                continue
            todo.append((child, iter(child.children), inside or main))
    cut()
    return out


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


SEEN = "host string, page long, path long, up long, kind int, value long, none boolean, doubted boolean, main boolean, n long, chars long, places long, pages long"


def sightings(pages: DataFrame) -> DataFrame:
    """(host, path, up, kind, value, none, doubted, main, n, chars, places, pages): how often an element shows a presentation (kind 0) or content (1) on the distinct pages of a host, and in one of these rows what it takes of a page.

    Copies of a page are told by its key and counted once. Values of a page are counted in its
    task and go by page and value, so no host is a key; what a host's pages share is then summed
    inside the tasks, and only a host's distinct values travel.
    """
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in SEEN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                rows = []
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    key, seen = observed(parse(page or ""))
                    took: dict[int, list] = {}
                    for node, _ in seen:
                        t = took.setdefault(node.path, [node.above, False, node.tag in MAIN, 0, 0])
                        t[1], t[3], t[4] = t[1] or node.doubted, t[3] + node.chars, t[4] + 1
                    for (path, kind, value, none), n in Counter(x for node, look in seen for x in ((node.path, 0, look, look == 0), (node.path, 1, node.content or 0, node.content is None))).items():
                        up, doubted, main, chars, places = took[path]
                        first = kind == 0 and places > 0
                        rows.append((h, key, path, up, kind, value, none, doubted, main, n, chars * first, places * first, int(first)))
                        if first:
                            took[path][4] = 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    each = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, SEEN)
    keys, counts = ["host", "path", "up", "kind", "value", "none"], ["n", "chars", "places", "pages"]
    flags = [F.max(c).alias(c) for c in ("doubted", "main")]
    once = each.groupBy("page", *keys).agg(*(F.max(c).alias(c) for c in counts), *flags)
    return settled(once.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts), *flags))


def style_tree(counts: DataFrame) -> DataFrame:
    """(host, path, up, doubted, main, seen, importance, share, places) of every element of every host's tree, mixed with what is usual."""

    def told(keys: list[str], rows: DataFrame) -> DataFrame:
        # H / log m, from sums of n and n log n
        s = rows.groupBy(*keys, "kind").agg(
            F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum(F.when(F.col("none"), 0).otherwise(F.col("n"))).alias("t"),
            *(F.sum(c).alias(c) for c in ("chars", "places", "pages")), F.max("doubted").alias("doubted"), F.max("main").alias("main"), F.max("up").alias("up"),
        )
        h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return s.groupBy(*keys).agg(
            F.max("m").alias("m"), F.max(F.when(F.col("kind") == 0, h)).alias("look"), F.coalesce(F.max(F.when((F.col("kind") == 1) & (F.col("t") > 0), h)), F.lit(0.0)).alias("content"),
            *(F.max(c).alias(c) for c in ("chars", "places", "pages", "doubted", "main", "up")),
        )

    own = told(["host", "path"], counts)
    every = told(["path"], counts.groupBy("path", "up", "kind", "value", "none").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "places", "pages")), F.max("doubted").alias("doubted"), F.max("main").alias("main")))
    roots = own.where(F.col("path") == ROOT).select("host", F.greatest("chars", F.lit(1)).alias("whole"), F.col("pages").alias("of"))
    own = settled(own.join(roots, "host"))
    # what is usual of an element is taken over the hosts that have it
    usual = every.join(own.groupBy("path").agg(F.sum("whole").alias("w")), "path").select("path", F.greatest("look", "content").alias("g"), (F.col("content") * F.col("chars") / F.col("w")).alias("gs"), (F.col("places") / F.col("pages")).alias("gp"))
    mixed = lambda n, a, b: (F.col(n) * a + PRIOR * b) / (F.col(n) + PRIOR)
    return own.join(usual, "path").select(
        "host", "path", "up", "doubted", "main", F.col("m").alias("seen"), mixed("m", F.greatest("look", "content"), F.col("g")).alias("importance"),
        mixed("of", F.col("content") * F.col("chars") / F.col("whole"), F.col("gs")).alias("share"), mixed("of", F.col("places") / F.col("pages"), F.col("gp")).alias("places"),
    )


def main_branches(tree: DataFrame) -> DataFrame:
    """(host, path) of the branches that stay."""
    chain = tree.where((F.col("share") > MAIN_SHARE) & (F.col("places") <= PLACES)).select("host", "path", "up")
    above = chain.select("host", F.col("up").alias("path")).distinct()
    deepest = chain.join(above, ["host", "path"], "left_anti").select("host", "path")
    beside = tree.join(chain.select("host", "path"), ["host", "path"], "left_anti").join(above.withColumnRenamed("path", "up"), ["host", "up"], "left_semi")
    beside = beside.where(~F.col("doubted") & (F.col("share") > F.when(F.col("main"), MAIN_OWN).otherwise(OWN))).select("host", "path")
    return deepest.unionByName(beside)


def common_contents(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """(host, value): contents of low branches whose own information, relative to the sightings m, is below LEAST too. That leaves less than m ** LEAST of a path."""
    low = tree.where((F.col("importance") < LEAST) & (F.col("share") < OWN)).select("host", "path", "seen")
    told = counts.where("kind = 1 AND NOT none").join(low, ["host", "path"])
    return told.where((F.col("n") > 1) & (F.log(F.col("seen") / F.col("n")) < LEAST * F.log("seen"))).select("host", "path", "value")


def decisions(pages: DataFrame) -> DataFrame:
    """(host, kept, common): paths of the main branches and (path, content) pairs of common low branches of every host."""
    counts = sightings(pages)
    tree = settled(style_tree(counts))
    rows = main_branches(tree).select("host", F.col("path").alias("kept"), F.lit(None).cast("struct<path:long,value:long>").alias("common"))
    rows = rows.unionByName(common_contents(counts, tree).select("host", F.lit(None).cast("long").alias("kept"), F.struct("path", "value").alias("common")))
    return settled(rows.groupBy("host").agg(F.collect_set("kept").alias("kept"), F.collect_set("common").alias("common")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of every page and its length in code points."""
    made = decisions(pages)
    if fits(made, 64 + F.octet_length("host") + 8 * F.size("kept") + 24 * F.size("common"), MAX_BROADCAST):
        made = F.broadcast(made)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(made, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                found, of = [], {}
                for h, page, kept, common in zip(*(part.column(c).to_pylist() for c in ("host", "html", "kept", "common")), strict=True):
                    if h not in of:
                        of[h] = set(kept or ()), {(c["path"], c["value"]) for c in common or ()}
                    found.append("\n".join(blocks(page or "", *of[h])))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
