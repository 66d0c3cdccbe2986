"""Operator 3: main text of web pages with site template removal by counted subtree hashes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.url_filters import with_host_and_path

# fixed values: element groups of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
NEVER_TEXT = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu "
    "audio video math".split()
)
CONTAINERS = frozenset("div section aside nav header footer form ul ol dl table figure details".split())
BLOCKS, LISTS = CLOSES_P - {"p"}, frozenset({"ul", "ol", "dl", "table", "select"})
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
# fixed values: words of class, id and role that mark what is not the article, words of layout among them, words that
# vouch for a heading, and words that make of a name a state of the element itself
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription comment comments disqus respond replies share sharing "
    "social related recommended recommendations widget widgets login signup search pagination pager toolbar".split()
)
LAYOUT = frozenset("sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead banner contentinfo complementary".split())
HEADING, VOUCHING = frozenset("header masthead banner".split()), frozenset("article post entry content story page title headline section".split())
STATE, STATE_ENDS = frozenset("has with no without is js".split()), frozenset("free less".split())
# fixed values: words that speak of reader comments, and words that say only where or how a block stands
COMMENTS = frozenset("comment comments disqus respond replies".split())
NEUTRAL = frozenset(
    "site page main block box wrap wrapper container inner outer area list item bar slot section unit top bottom left right panel content holder module "
    "group row col column primary secondary global fixed sticky small large wide text link links button buttons icon icons form".split()
)
#: a block whose name is in part of other things goes only if fewer words than these stand outside its links, or half its words in them
FEW_WORDS = 25
NAME_PARTS = re.compile(r"[a-z0-9]+")
#: a subtree is template if it stands on so many pages of its host with different main text, and on such a share of them
MIN_PAGES, MIN_SHARE = 5, 0.01
#: so many pages with different main text are enough whatever their share, so that a large host loses its templates too
ENOUGH_PAGES = 100
#: (host, subtree) pairs up to which the template table is broadcast (8 bytes each); beyond, it is joined by shuffle
BROADCAST_SUBTREES = 1_000_000


class Node:
    __slots__ = ("children", "hash", "has_main", "linked", "marked", "tag", "words")

    def __init__(self, tag: str, marked: int = 0, key: str = "") -> None:
        self.tag, self.marked, self.children, self.has_main = tag, marked, [], False
        self.hash, self.words, self.linked = key, 0, 0


def marks(tag: str, names: str) -> int:
    """How far class, id and role names say that an element is not the article: 2 for sure, 1 if it is little prose, 0 not.

    Page roots and main hold the article whatever they are called; an article is another one only by words that are not of
    layout, and for sure.  `has-sidebar` and `ad-free` speak of a state; `article-header` is the article's own.  A name all
    of whose words say so, beside those of place and form, is sure, and so is one of reader comments; `related-work` and
    `social-history` may be the names of sections.
    """
    if tag in ("html", "body", "main"):
        return 0
    most = 0
    for name in names.lower().split():
        parts = NAME_PARTS.findall(name)
        if not parts or parts[0] in STATE or parts[-1] in STATE_ENDS:
            continue
        said = set(parts)
        layout = bool(tag != "article" and said & LAYOUT and not (said & LAYOUT <= HEADING and said & VOUCHING))
        if said & NOT_ARTICLE or layout:
            sure = bool(said & COMMENTS) or said <= NOT_ARTICLE | LAYOUT | NEUTRAL
            most = max(most, 2 if sure else 1 if tag != "article" else 0)
    return most


def little_prose(node: Node) -> bool:
    """Whether fewer than FEW_WORDS words of an element stand outside its links, or half of all within them; hash_subtrees
    must have run."""
    return node.words - node.linked < FEW_WORDS or 2 * node.linked >= node.words


class TreeBuilder(HTMLParser):
    """A forgiving tree: unclosed p, li, td and so on end where the next one starts, head where the body starts; stray
    end tags do nothing.  The places of open tags are kept by tag, so the work is linear however deep a page nests."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}
        self.blocks = [0]  # places of open blocks but p

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        if tag not in HEAD_TAGS:
            self._close(("head",), ())
        if tag in CLOSES_P:
            self._close(("p",), BLOCKS)
        elif tag in SAME_CLOSES:
            self._close(SAME_CLOSES[tag], LISTS)
        own = [f"{k}={v}" for k, v in attrs if k in ("class", "id", "role") and v]
        said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        node = Node(tag, 2 if hidden else marks(tag, said) if said else 0, " ".join(own))
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            for up in reversed(stack):
                if up.has_main:
                    break
                up.has_main = True
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                self.blocks.append(len(stack))
            stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close((tag,), CLOSES_P if tag in INLINE else ())

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and data.strip():
            self._close(("head",), ())
        self.stack[-1].children.append(data)

    def _close(self, tags, until):
        """Close the innermost open element of these tags, with all in it, unless one of `until` is open inside it."""
        places = [self.open[t][-1] for t in tags if self.open.get(t)]
        if not places:
            return
        at = max(places)
        if until is BLOCKS or until is CLOSES_P:
            if self.blocks[-1] > at:
                return
            until = ("p",) if until is CLOSES_P else ()
        if all(self.open[t][-1] <= at for t in until if self.open.get(t)):
            for node in self.stack[at:]:
                self.open[node.tag].pop()
            while self.blocks[-1] >= at:
                self.blocks.pop()
            del self.stack[at:]


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def hash_subtrees(root: Node) -> list[tuple[int, Node]]:
    """(hash, element) of the elements that may be template; sets hash and numbers of words on every element.

    An element that holds the article (article or main), and prose inside it, is never a candidate: sites quote
    the same passage in many articles.
    """
    found: list[tuple[int, Node]] = []
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, done = todo.pop()
        if not done:
            todo.append((node, inside, True))
            below = inside or node.tag in ("article", "main")
            todo.extend((c, below, False) for c in node.children if isinstance(c, Node))
            continue
        parts = [node.tag, str(node.hash)]
        for c in node.children:
            if isinstance(c, Node):
                parts.append(str(c.hash))
                if c.tag not in NEVER_TEXT:
                    node.words, node.linked = node.words + c.words, node.linked + c.linked
            else:
                words = c.split()
                parts.append("t" + " ".join(words))
                node.words += len(words)
        if node.tag == "a":
            node.linked = node.words
        node.hash = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        main = node.has_main or node.tag in ("article", "main", "html", "body", "#root")
        if not main and (not inside or node.tag in CONTAINERS):
            found.append((node.hash, node))
    return found


def main_hash(root: Node) -> int:
    """Hash of what stands in article or main, else of the whole tree; hash_subtrees must have run."""
    todo, mains = [root], []
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            mains.append(str(node.hash))
        elif node.has_main:
            todo.extend(c for c in node.children if isinstance(c, Node))
    return xxhash.xxh3_64_intdigest(" ".join(mains)) - (1 << 63) if mains else root.hash


def text_of(root: Node, template: set[int] | frozenset[int] = frozenset()) -> str:
    """Text of the outermost articles and mains (else of the whole page) without template and marked parts."""
    todo: list[Node] = [root]
    starts: list[Node] = []
    while todo:
        node = todo.pop()
        if _dropped(node, template):
            continue
        if node.tag in ("article", "main"):
            starts.append(node)
        elif node.has_main:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    starts = starts or [root]
    known = set(map(id, starts))
    out: list[str] = []
    work: list[Node | str] = []
    for start in reversed(starts):
        work.append(start)
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag == "br":
            out.append(" ")
        elif id(item) in known or not _dropped(item, template):
            block = item.tag not in INLINE
            work.extend([" "] * block)
            work.extend(reversed(item.children))
            out.extend([" "] * block)
    return " ".join("".join(out).split())


def _dropped(node: Node, template) -> bool:
    return node.marked == 2 or node.tag in NEVER_TEXT or node.hash in template or (node.marked == 1 and little_prose(node))


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_subtrees: int = BROADCAST_SUBTREES,
    enough_pages: int = ENOUGH_PAGES,
) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html gives the empty text; a null url counts to the host ''.  Pages that repeat the same article
    count once, on both sides of the share, so copies of a page neither make a template nor hide one.  Repeated rows are
    extracted one by one; other columns are not read.  The table of all template subtrees is broadcast to the workers
    only after it was counted; else the subtrees of each page meet it by shuffle, and a page carries its own ones only.
    """
    common.small_batches(pages.sparkSession, 500)
    rows = with_host_and_path(pages.select("page_id", "url", "html")).drop("path")

    def subtrees(batches):
        for b in batches:
            hosts, hashes, sigs = [], [], []
            for host, html in zip(b.host, b.html, strict=True):
                root = parse(common.as_text(html))
                own = {h for h, _ in hash_subtrees(root)}
                sig = main_hash(root)
                hosts.extend([host] * (len(own) + 1))
                hashes.extend([None, *own])  # null stands for the page itself
                sigs.extend([sig] * (len(own) + 1))
            if hosts:
                yield pd.DataFrame({"host": hosts, "subtree": pd.array(hashes, "Int64"), "sig": np.array(sigs, np.int64)})

    seen = rows.select("host", "html").mapInPandas(subtrees, "host string, subtree long, sig long").distinct()
    counted = common.materialize(
        seen.groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(F.col("subtree").isNull() | (F.col("pages") >= min_pages)), "subtrees")
    different = counted.where("subtree IS NULL").select("host", F.col("pages").alias("articles"))
    often = counted.where("subtree IS NOT NULL").join(different, "host").where(
        (F.col("pages") >= min_share * F.col("articles")) | (F.col("pages") >= enough_pages))
    template = common.materialize(often.select("host", "subtree"), "templates")
    if template.count() <= broadcast_subtrees:
        table: dict[str, np.ndarray] = {}
        found = template.toArrow().to_pandas()
        for host, own in found.groupby("host", dropna=False)["subtree"]:
            table[host] = own.to_numpy(np.int64)
        shared = pages.sparkSession.sparkContext.broadcast(table)  # 8 bytes a subtree and an entry a host, counted above
        joined = rows
    else:
        shared = None
        # equal pages of a host have equal subtrees, so they share a key
        rows = rows.withColumn("key", F.xxhash64("html"))

        def keyed(batches):
            for b in batches:
                hosts, keys, hashes = [], [], []
                for host, key, html in zip(b.host, b.key, b.html, strict=True):
                    own = {h for h, _ in hash_subtrees(parse(common.as_text(html)))}
                    hosts.extend([host] * len(own))
                    keys.extend([key] * len(own))
                    hashes.extend(own)
                if hosts:
                    yield pd.DataFrame({"host": hosts, "key": np.array(keys, np.int64), "subtree": np.array(hashes, np.int64)})

        own = rows.select("host", "key", "html").mapInPandas(keyed, "host string, key long, subtree long")
        own = own.join(template, ["host", "subtree"], "left_semi").groupBy("host", "key").agg(F.collect_set("subtree").alias("template"))
        joined = rows.join(own, ["host", "key"], "left").select("page_id", "url", "html", "host", "template")

    def texts(batches):
        known: dict[str, frozenset] = {}

        def of_host(host):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset(shared.value[host].tolist()) if host in shared.value else frozenset()
            return known[host]

        def one(b):
            out = []
            given = [of_host(h) for h in b.host] if shared else [frozenset() if t is None else frozenset(map(int, t)) for t in b.template]
            for html, template in zip(b.html, given, strict=True):
                root = parse(common.as_text(html))
                hash_subtrees(root)
                out.append(text_of(root, template))
            return pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": out, "n_chars": [len(t) for t in out]})

        return common.frames(batches, one)

    columns = ["page_id", "url", "html", "host"] + ([] if shared else ["template"])
    return joined.select(*columns).mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, as a table of pages gives it."""
    return extract(common.table(spark, sf_dir, "pages"))
