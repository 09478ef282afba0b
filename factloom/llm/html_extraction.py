"""Main text of web pages by consensus host paths (operator 1).

1. Each page is read into containers with generalised tag-class paths (digits become ``#``, ids are left out), in time
   linear in its length however deep it nests. A page's own containers are its outermost articles and mains where they hold
   half of its text or more, else the lowest container around all of its blocks that are text rather than links, the body
   included.
2. In Spark the pages of a host vote on paths. Votes are summed before they are shuffled by host, so a host with a third of all
   pages is a few rows per task. No path loses its votes.
3. Pages are read again: of the host's paths, in the order of their votes (ties: by path), the first whose containers
   cover the page's own ones gives all of its containers that are not mostly links; a page without such a path gives its own
   containers. The paths of a host with up to ``PATHS`` of them go to its pages as they are; the pages of other hosts look up
   the votes of their own covering paths, which is the same choice.

No part is left out for its size. Where the whole body is the container, links before the first and after the last
block of text are not part of it.

Menus, footers, sidebars, forms, scripts and styles are left out by element and role, headers outside of articles. A form around
the page (it holds an article, or most of the text and with it a block of ``PROSE`` characters that is no link) is a container like any other. A class
or id name is evidence only: a container that is called comments, a footer, an advert or the like (the last part of a name; of ambiguous words
like ``search``, ``share`` or ``notice`` a name of nothing else) goes unless it holds most of the page's text or an article; one whose name
merely contains such a word goes only if it is mostly links. Character references are decoded, white space inside a block becomes one blank, blocks are
joined in page order by one blank.

Defined results: null or empty html gives the empty text; null urls are one host of their own; pages without a
container give the text of their body; repeated rows, and rows with equal or missing ids, are each read; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

#: Paths of a host that its pages get whole; hosts up to which they are sent to all tasks; share of a vote for a page's further paths;
#: characters of a block that is prose.
PATHS, BROADCAST_HOSTS, SECOND, PROSE = 16, 20_000, 0.3, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CONTAINERS = frozenset("html body main article section div td center table tr tbody".split())
_LEFT_OUT = frozenset("head title nav footer aside form button select option menu dialog".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th hr address fieldset legend details summary header".split()) | _CONTAINERS | _LEFT_OUT
_VOID = frozenset("br hr img input meta link source area base col embed param track wbr".split())
#: Words that name what is not main text, and words that say nothing beside them.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead banner cookie cookies consent gdpr notice alert ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments "
    "disqus replies respond pagination pager toolbar skip".split()
)
#: Of these, words that also name articles about something: they count as the last part of a name only beside plain words.
_AMBIGUOUS = frozenset("navigation menu banner notice alert ad ads promo promotion subscribe signup login search share sharing social related recommended respond skip toolbar widget sponsor sponsored replies cookie cookies consent gdpr".split())
_PLAIN = frozenset("main site page header top bottom left right side box bar block list container wrapper wrap section area item items link links slot unit inner posts post stories buttons button media form thread".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[-_\s]+")


class _Node:
    __slots__ = ("first", "hard", "holds_article", "last", "links", "name", "noise", "own", "own_links", "parent", "path", "prose", "tag", "text")

    def __init__(self, tag: str, path: int, parent: "_Node | None", hard: bool, name: int, first: int):
        self.tag, self.path, self.parent, self.hard, self.name, self.first = tag, path, parent, hard, name, first
        self.last = first
        self.own = self.own_links = self.text = self.links = 0
        self.noise = self.holds_article = self.prose = False


class Page:
    """``blocks`` of main text candidates in page order, the ``nodes`` that hold them, the positions and holders of the blocks
    that are text rather than links (``dense``), and the ``root``."""

    def __init__(self) -> None:
        self.root = _Node("", 0, None, False, 0, 0)
        self.nodes: list[_Node] = []
        self.raw: list[tuple[str, _Node, int, int]] = []  # block, holder, characters of text and of links
        self.paths: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = [(0, "")]

    def path_of(self, n: _Node) -> str:
        parts, at = [], n.path
        while at:
            at, label = self.labels[at]
            parts.append(label)
        return "".join(f">{x}" for x in reversed(parts))

    def path_number(self, path: str) -> int | None:
        at: int | None = 0
        for label in path.split(">")[1:]:
            at = self.paths.get((at, label))
            if at is None:
                return None
        return at

    def _sum(self, rows) -> None:
        for n in (self.root, *self.nodes):
            n.text = n.links = 0
        for _, holder, size, links in rows:
            holder.text += size
            holder.links += links
        for n in reversed(self.nodes):  # parents come before their children
            n.parent.text += n.text
            n.parent.links += n.links

    def settle(self) -> None:
        """Decide which containers are noise, and keep the blocks of the others."""
        self._sum(self.raw)
        for text, holder, size, _ in self.raw:
            holder.prose = holder.prose or len(text) >= PROSE and 2 * size >= len(text)
        for n in reversed(self.nodes):
            if n.holds_article or n.tag in ("article", "main"):
                n.parent.holds_article = True
            if n.prose:
                n.parent.prose = True
        most = self.root.text
        for n in self.nodes:
            up = n.parent
            if n.tag in ("article", "main"):
                n.noise = up.noise and up.tag not in ("form", "header", "nav", "head")
            else:
                called = n.name == 2 and not n.holds_article and 2 * n.text <= most or n.name == 1 and n.links >= n.text
                around = n.tag == "form" and (n.holds_article or n.prose and 2 * n.text > most)
                n.noise = up.noise or n.hard and not around or called
        before, kept = [0], []
        for row in self.raw:
            if not row[1].noise:
                kept.append(row)
            before.append(len(kept))
        self._sum(kept)
        for n in (self.root, *self.nodes):
            n.first, n.last = before[n.first], before[n.last]
        self.nodes = [n for n in self.nodes if not n.noise]
        self.blocks = [r[0] for r in kept]
        self.dense = [(k, r[1]) for k, r in enumerate(kept) if 2 * r[2] >= len(r[0])]


def _attributes(text: str) -> tuple[list[str], str, str]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}
    return sorted(set(found.get("class", "").replace(">", "_").split())), found.get("id", ""), found.get("role", "").lower()


def _called_noise(names: list[str]) -> int:
    """2 if a name says that this is no main text, 1 if it contains such a word, else 0."""
    worst = 0
    for name in names:
        parts = [p for p in _PARTS.split(_DIGITS.sub("", name.lower())) if p]
        hits = [p in _NAMES for p in parts]
        if any(hits):
            sure = hits[-1] and parts[-1] not in _AMBIGUOUS or all(h or p in _PLAIN for h, p in zip(hits, parts))
            worst = max(worst, 2 if sure else 1)
    return worst


def read_page(page: str | None) -> Page:
    out = Page()
    stack, opened = [out.root], Counter()
    pieces: list[str] = []
    linked = in_link = held = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.raw.append((text, stack[-1], max(0, len(text) - linked), min(linked, len(text))))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal held
        close_block()
        while len(stack) > depth:
            n = stack.pop()
            n.last = len(out.raw)
            opened[n.tag] -= 1
            held -= n.tag in ("article", "main")

    def pop_tag(tag: str) -> None:
        if opened[tag] > 0:
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            pop_to(k)

    at, source = 0, page or ""
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            piece = source[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "a":
            in_link = 0 if m[2] else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in _BLOCKS:
            continue
        close_block()
        if m[2]:
            pop_tag(tag)
            continue
        if tag in _VOID or m[4].endswith("/"):
            continue
        if tag == "body":
            pop_tag("head")
        if tag == "td" and stack[-1].tag == "td":  # cells and rows end where the next one begins
            pop_to(len(stack) - 1)
        if tag == "tr":
            while stack[-1].tag in ("td", "tr"):
                pop_to(len(stack) - 1)
        names, ident, role = _attributes(m[4]) if m[4] else ([], "", "")
        whole = tag in ("html", "body", "article", "main")
        hard = not (tag in ("article", "main")) and (tag in _LEFT_OUT or tag == "header" and not held or role in _ROLES)
        name = _called_noise([*names, ident]) if (names or ident) and not whole else 0
        if tag in _CONTAINERS or hard or name:
            label = ".".join([tag, *(_DIGITS.sub("#", n) for n in names)])
            key = (stack[-1].path, label)
            path = out.paths.get(key)
            if path is None:
                path = out.paths[key] = len(out.labels)
                out.labels.append(key)
            node = _Node(tag, path, stack[-1], hard, name, len(out.raw))
            stack.append(node)
            out.nodes.append(node)
            opened[tag] += 1
            held += tag in ("article", "main")
    if at < len(source):
        pieces.append(source[at:])
    pop_to(1)
    close_block()
    out.root.last = len(out.raw)
    out.settle()
    return out


def own_containers(page: Page) -> list[_Node]:
    """The containers that hold a page's whole main text, in page order."""
    articles: list[_Node] = []
    for n in page.nodes:
        if n.tag in ("article", "main") and n.text and n.text >= n.links and not (articles and n.first < articles[-1].last):
            articles.append(n)
    if articles and 2 * sum(n.text for n in articles) >= page.root.text:
        return articles
    if not page.dense:
        return [page.root]
    lowest = page.dense[0][1]
    while lowest.last <= page.dense[-1][0]:
        lowest = lowest.parent
    return [lowest]


def _whole_page(n: _Node) -> bool:
    return n.tag in ("", "html", "body")


def _cover(nodes: list[_Node], own: list[_Node]) -> bool:
    """Whether each own container lies in one of ``nodes``; both in page order, neither nested in itself."""
    k = 0
    for o in own:
        while k < len(nodes) and nodes[k].last < o.last:
            k += 1
        if k == len(nodes) or nodes[k].first > o.first:
            return False
    return True


def extract(html: str | None, paths: list[str] | None = None) -> str:
    """Main text of a page under its host's paths, best first."""
    page = read_page(html)
    own = own_containers(page)
    blocks, dense = page.blocks, page.dense
    if _whole_page(own[0]):
        return " ".join(blocks[dense[0][0] : dense[-1][0] + 1] if dense else blocks)
    by_path, around = _around(page, own) if paths else ({}, {})
    chosen = own
    for number in map(page.path_number, paths or []):
        if number in around and _covers(by_path[number], own):
            chosen = by_path[number]
            break
    return " ".join(b for n in chosen for b in blocks[n.first : n.last])


def _around(page: Page, own: list[_Node]) -> tuple[dict[int, list[_Node]], dict[int, _Node]]:
    """The containers of each path that are not mostly links, in page order; the paths of those around the first of the page's own: only
    these can cover it."""
    by_path: dict[int, list[_Node]] = {}
    for n in page.nodes:
        if n.text and n.text >= n.links:
            by_path.setdefault(n.path, []).append(n)
    around, up = {}, own[0]
    while not _whole_page(up):
        if up.path in by_path:
            around.setdefault(up.path, up)
        up = up.parent
    return by_path, around


def _covers(nodes: list[_Node], own: list[_Node]) -> bool:
    return nodes[0].first <= own[0].first and nodes[0].last >= own[-1].last or _cover(nodes, own)


def _votes_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    hosts, paths, votes = [], [], []
    for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        read = read_page(page)
        for k, n in enumerate({n.path: n for n in own_containers(read) if n.path}.values()):
            hosts.append(host)
            paths.append(read.path_of(n))
            votes.append(SECOND if k else 1.0)
    return pa.RecordBatch.from_arrays([pa.array(hosts, type=pa.string()), pa.array(paths, type=pa.string()), pa.array(votes, type=pa.float64())], names=["host", "path", "vote"])


def _extract_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract(p, w) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url="url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[^:]*://([^/?#]*)", 1)), F.lit(""))


def _covering_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, host, html) -> (key, host, path) of the paths that cover a page's own containers."""
    rows = []
    for key, host, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
        page = read_page(html)
        own = own_containers(page)
        by_path, around = _around(page, own)
        rows += [(key, host, page.path_of(n)) for number, n in around.items() if _covers(by_path[number], own)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["key", "host", "path"])


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of the pages (host, html)."""
    votes = C.map_arrow(pages.select("host", "html"), _votes_batch, "host string, path string, vote double")
    return votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))


def _best(votes: DataFrame, key: str) -> DataFrame:
    """(key, paths): the paths of each key by falling votes, then by name."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return votes.groupBy(key).agg(F.transform(ordered, lambda p: p["path"]).alias("paths"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): all paths of each host, best first."""
    return _best(host_votes(pages), "host")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of())
    votes = C.stored(host_votes(rows))
    counts = votes.groupBy("host").agg(F.count("*").alias("n"))
    few, many = counts.where(F.col("n") <= PATHS), counts.where(F.col("n") > PATHS).select("host", F.lit(True).alias("many"))
    paths = _best(votes.join(few.select("host"), "host"), "host")
    if few.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)  # at most PATHS paths a host
    rich = many.count()
    if not rich:
        joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "paths")
        return C.map_arrow(joined, _extract_batch, "page_id long, url string, text string, n_chars long")
    many = F.broadcast(many) if rich <= BROADCAST_HOSTS else many
    told = rows.join(many, "host", "left").withColumn("key", F.xxhash64("host", "html"))
    plain = told.where("many is null").join(paths, "host", "left").select("page_id", "url", "html", "paths")
    # pages of hosts with many paths: equal pages of a host have one key and one choice
    own = C.map_arrow(told.where("many").select("key", "host", "html"), _covering_batch, "key long, host string, path string").distinct()
    chosen = C.stored(_best(own.join(votes, ["host", "path"]), "key"))  # the covering paths of one page
    looked = told.where("many").join(chosen, "key", "left").select("page_id", "url", "html", "paths")
    return C.map_arrow(plain.union(looked), _extract_batch, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(C.documents_of(spark, sf_dir, "pages"))
