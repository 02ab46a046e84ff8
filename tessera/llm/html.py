"""Main text of pages by a tree-structured graphical model.

The DOM's elements with text are nodes with a hidden state: around the article, content, or both below it. Potentials: features of a node given its state, and the
state of a child given its parent's. What classes, ids and roles mean is learned by word. Sum-product messages go up from the leaves and down from the root once; their product is each
node's exact marginal. The potentials are counted on labelled pages, which labelled_pages() makes from a grammar of page layouts.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIP = frozenset("script style head noscript template iframe select option textarea button title".split())
#: What can stand in a head; its end tag may be left out before anything else.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes: a paragraph ends before any block, an item before the next.
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, a, b in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"))}
#: An item does not end beyond these.
HOLDS = frozenset("div section article table ul ol dl".split())
#: Elements that say nothing about the one block of a page.
BARE = frozenset("#root #text html body div section center p".split())
#: A decimal character reference too long for int(); any of so many digits is out of range but for leading zeros.
LONG_REFERENCE = re.compile(r"&#0*([0-9]{8})[0-9]*|&#0{8,}([0-9]{0,7})(?![0-9])")
SPACE = re.compile("[\\x20\\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

#: Class, id and role names are cut into words at signs, digits and capitals.
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")


@lru_cache(maxsize=1 << 14)
def name_features(names: str) -> tuple[tuple[str, ...], ...]:
    """For each name in an element's class, id and role: the name whole, then its words."""
    return tuple((f"={name.lower()}", *dict.fromkeys(f"~{w.lower()}" for w in NAME_WORDS.findall(name))) for name in dict.fromkeys(names.split()))


class Node:
    __slots__ = ("tag", "names", "parent", "block", "text", "linked", "order")

    def __init__(self, tag, names, parent):
        self.tag, self.names, self.parent = tag, names, parent
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.text, self.linked, self.order = 0, 0, -1


class Tree(HTMLParser):
    """Elements with text, and blocks of text in page order: (node, text, linked characters).

    Each start and end tag costs what it opens and closes, however deep the page: the places of open elements are kept by tag.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[Node, str, int]] = []
        self.open: list[Node] = [Node("#root", "", None)]
        self.at: dict[str, list[int]] = {}  # places of the open elements of each tag
        self.block_at: list[int] = [0]  # those of block elements, and the root's
        self.pieces: list[str] = []
        self.links = self.skipped = 0
        self.block_links = 0

    def end_block(self):
        if self.pieces:
            text = SPACE.sub(" ", "".join(self.pieces)).strip(" ")
            if text:
                self.blocks.append((self.open[-1].block, text, self.block_links))
        self.pieces, self.block_links = [], 0

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown declaration is a comment up to the next >
            return self.parse_bogus_comment(i)

    def leave_head(self):
        """Closes a head that nothing is open in, whose end tag was left out; in a noscript of a head, too."""
        k = len(self.open) - 1
        k -= self.open[k].tag == "noscript"
        if self.open[k].tag == "head":
            self.cut(k)

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (tag not in HEAD and self.open[-1].tag == "head"):
            self.leave_head()
        if tag in BLOCKS or tag == "br" or tag in SKIP:
            if tag in BLOCKS:
                self.close_before(tag)
            if tag != "br":
                self.end_block()
        if tag == "br":
            self.pieces.append("\n")
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.block_at.append(len(self.open))
        self.open.append(Node(tag, names, self.open[-1]))
        if tag in SKIP:
            self.skipped += 1
        elif tag == "a":
            self.links += 1

    def close_before(self, tag):
        names, stop = CLOSES.get(tag, ((), ()))
        for j in range(len(self.block_at) - 1, 0, -1):
            k = self.block_at[j]
            t = self.open[k].tag
            if t == "p" or t in names:
                self.cut(k)
                if t == tag:
                    return
            elif t in stop or not names or t in HOLDS:
                return

    def cut(self, k):
        """Closes the open elements from the k-th on."""
        gone = self.open[k:]
        if any(n.tag in BLOCKS or n.tag in SKIP for n in gone):
            self.end_block()
        for n in reversed(gone):
            self.at[n.tag].pop()
            if n.tag in BLOCKS:
                self.block_at.pop()
            if n.tag in SKIP:
                self.skipped -= 1
            elif n.tag == "a":
                self.links -= 1
        del self.open[k:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.pieces.append("\n")
            return
        places = self.at.get(tag)
        if not places or (places[-1] < self.block_at[-1] and tag not in BLOCKS and tag not in SKIP):
            return  # nothing to close; an inline end tag does not close the block around it
        self.cut(places[-1])

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip(" \t\n\f\r"):
            self.leave_head()
        if not self.skipped:
            self.pieces.append(data)
            if self.links:
                self.block_links += len(data.strip())

    def handle_comment(self, data):
        pass

    def unknown_decl(self, data):
        pass


class Page:
    """The tree of the elements above the page's blocks, parents first, with their features."""

    def __init__(self, html: str):
        tree = Tree()
        tree.feed(LONG_REFERENCE.sub(lambda m: "&#" + (m[1] or m[2] or "0"), html))
        tree.close()
        tree.end_block()
        self.texts = [t for _, t, _ in tree.blocks]
        self.nodes: list[Node] = []
        self.at: list[int] = []
        for node, text, linked in tree.blocks:
            chain = []
            while node is not None and node.order < 0:
                chain.append(node)
                node = node.parent
            for n in reversed(chain):
                n.order = len(self.nodes)
                self.nodes.append(n)
        for node, text, linked in tree.blocks:
            # each block is a leaf of its own below its element, so an element may hold several
            leaf = Node("#text", "", node)
            leaf.order, leaf.text, leaf.linked = len(self.nodes), len(text), linked
            self.at.append(leaf.order)
            self.nodes.append(leaf)
        for node in reversed(self.nodes):  # children come after their parents
            if node.parent is not None:
                node.parent.text += node.text
                node.parent.linked += node.linked
        self.parent = [n.parent.order if n.parent is not None else -1 for n in self.nodes]
        self.contract()
        self.features = [features(n) for n in self.nodes]

    def contract(self):
        """Takes out what only wraps one other element without a name: however many there are, they tell nothing."""
        children = [0] * len(self.nodes)
        for p in self.parent[1:]:
            children[p] += 1
        stays, above, place = [], [-1] * len(self.nodes), {-1: -1}
        wraps = [False] * len(self.nodes)
        for k in range(len(self.nodes) - 1, 0, -1):
            p = self.parent[k]
            wraps[p] = children[p] == 1 and p > 0 and self.nodes[p].tag == "div" and not self.nodes[p].names and self.nodes[k].tag != "#text"
        for k, p in enumerate(self.parent):
            above[k] = above[p] if p >= 0 and wraps[p] else p
            if not wraps[k]:
                place[k] = len(stays)
                stays.append(k)
        self.nodes, self.parent, self.at = [self.nodes[k] for k in stays], [place[above[k]] for k in stays], [place[k] for k in self.at]


def features(node: Node) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(what a node is, from the most to the least told; what it is called). Of what it is and of each name the first that training knows decides."""
    share = 0 if not node.text else min(3, int(3 * node.linked / node.text) + (node.linked > 0))
    if node.tag == "#text":
        return (f"leaf:{share}:{(node.text > 60) + (node.text > 240)}", "leaf"), ()
    return (f"{node.tag}:{int(share >= 2)}", node.tag), name_features(node.names) if node.names else ()


#: States of a node: what surrounds the article, the article, an element that holds both.
AROUND, CONTENT, BOTH = 0, 1, 2
#: What a count of 0 counts for: names and kinds seldom stand where they don't belong.
FLOOR = 0.0001


class Model:
    """Log potentials: features given the state, states of children given the parent's, the root's, and what a name of no meaning says."""

    def __init__(self, node, edge, root, name):
        self.node, self.edge, self.root, self.name = node, edge, root, name

    def own(self, kinds, names) -> list[float]:
        """A node's log potential in each state; names that training has not seen say nothing."""
        x = y = z = 0.0
        for f in kinds:
            v = self.node.get(f)
            if v:
                x, y, z = v
                break
        for whole, *words in names:
            for v in (self.node.get(f) for f in ([whole] if whole in self.node else words)):
                if v:
                    x, y, z = x + v[0] - self.name[0], y + v[1] - self.name[1], z + v[2] - self.name[2]
        return [x, y, z]

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability to be content, by one upward and one downward pass of sum-product messages."""
        n = len(page.nodes)
        none, own = (0.0, 0.0, 0.0), [self.own(*f) for f in page.features]
        e, parent = self.edge, page.parent
        up = own  # a node's features and all messages from its children
        sent = [none] * n
        for k in range(n - 1, 0, -1):
            x, y, z = up[k]
            message = sent[k] = tuple(_sum(row[0] + x, row[1] + y, row[2] + z) for row in e)
            above = up[parent[k]]
            above[0] += message[0]
            above[1] += message[1]
            above[2] += message[2]
        belief = [none] * n
        for k in range(n):
            down = self.root
            if k:
                full, mine = belief[parent[k]], sent[k]
                x, y, z = full[0] - mine[0], full[1] - mine[1], full[2] - mine[2]  # without what this child said
                down = [_sum(x + e[0][s], y + e[1][s], z + e[2][s]) for s in range(3)]
            belief[k] = (down[0] + up[k][0], down[1] + up[k][1], down[2] + up[k][2])
        return [math.exp(b[CONTENT] - _sum(*b)) for b in belief]


def _sum(a: float, b: float, c: float) -> float:
    """log(exp(a) + exp(b) + exp(c))"""
    top = a if a >= b else b
    top = top if top >= c else c
    return top + math.log(math.exp(a - top) + math.exp(b - top) + math.exp(c - top))


def train(pages: list[tuple[str, list[str]]]) -> Model:
    """Counts potentials on (html, texts of its content blocks) with a little smoothing; a leaf's state is its label."""
    seen: dict[str, list[float]] = {}
    edge, states, called = [[0.1] * 3 for _ in range(3)], [1.0] * 3, [1.0] * 3
    top = [1.0] * 3
    for html, wanted in pages:
        page = Page(html)
        want = set(wanted)
        n = len(page.nodes)
        good, all_ = [0] * n, [0] * n
        for leaf, text in zip(page.at, page.texts, strict=True):
            k, is_good = leaf, text in want
            while k >= 0:
                good[k] += is_good
                all_[k] += 1
                k = page.parent[k]
        state = [CONTENT if good[k] == all_[k] else BOTH if good[k] else AROUND for k in range(n)]
        top[state[0]] += 1
        for k in range(n):
            states[state[k]] += 1
            kinds, names = page.features[k]
            for f in (*kinds, *{f for name in names for f in name}):
                seen.setdefault(f, [FLOOR] * 3)[state[k]] += 1
            called[state[k]] += bool(names)
            if k:
                edge[state[page.parent[k]]][state[k]] += 1
    node = {f: tuple(math.log(a / t) for a, t in zip(v, states, strict=True)) for f, v in seen.items()}
    return Model(node, [[math.log(x / sum(row)) for x in row] for row in edge], [math.log(x / sum(top)) for x in top], [math.log(a / t) for a, t in zip(called, states, strict=True)])


WORDS = "river stone winter letter garden window market evening mountain teacher silver paper bridge harbour morning question answer village meadow lantern".split()


#: Names that pages give to their parts; what they mean is learned from where the grammar puts them.
NAMES = {
    kind: names.split()
    for kind, names in {
        "nav": "nav navbar navigation menu main-menu top-nav site-nav nav-links breadcrumb breadcrumbs pagination pager paginator toolbar",
        "header": "header site-header masthead page-header topbar head branding logo",
        "footer": "footer site-footer foot colophon copyright legal footer-widgets imprint",
        "aside": "sidebar side widget widget-area related related-posts recommended recommendations rail aside secondary",
        "ad": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored ad-slot",
        "notice": "notice cookie cookies cookie-notice cookie-banner consent gdpr alert popup modal newsletter overlay message announcement",
        "form": "search search-form searchbox login signup signin register subscribe contact-form form",
        "comments": "comments comment comment-list commentlist reply replies response responses respond discussion disqus thread",
        "share": "share sharing social social-links share-buttons tags tag-list meta post-meta byline author-box",
        "content": "article content post entry story main text body article-body entry-content post-content post-body main-content single blog-post",
        "inner": "lead intro dropcap caption quote summary title heading first last text paragraph subtitle",
        "plain": "page wrapper container site layout row col column inner region box grid flex section block area wrap top left right large small primary",
    }.items()
}


def labelled_pages(count: int = 800, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, texts of the content blocks) from a grammar of layouts: where the article stands and what is around and inside it."""
    import random

    r = random.Random(seed)
    serial = iter(range(10**9))
    topic = lambda: r.choice([*WORDS, *sum(NAMES.values(), [])])

    def words(a, b):
        return " ".join([r.choice(WORDS) for _ in range(r.randint(a, b))] + [f"{next(serial)}."])

    def links(n, tag="li"):
        return "".join(f'<{tag}><a href="/x">{words(1, 2)}</a></{tag}>' for _ in range(n))

    def named(kind):
        """A class or an id from the kind's names, at times with other words, numbers or a second name of no meaning."""
        name = r.choice(NAMES[kind])
        if r.random() < 0.4:
            name = r.choice(["{}-{}", "{}_{}", "{1}-{0}"]).format(name, r.choice([*NAMES["plain"], str(r.randint(1, 999))]))
        elif r.random() < 0.1:
            name = name.title().replace("-", "")
        other = r.choice(["", "", f" {r.choice(NAMES['plain'])}", f" x{r.randint(1, 9999)}"])
        return f'{r.choice(["class", "class", "class", "id"])}="{name}{other}"'

    def extra(kind):
        say, many, n = words(*r.choice([(1, 6), (3, 25), (15, 60)])), r.randint(2, 7), lambda: named(kind)
        said = lambda tag, name: "".join(f"<{tag}{name}><p>{words(5, 30)}</p></{tag}>" for _ in range(r.randint(1, 4)))
        return {
            "nav": lambda: r.choice([f"<nav><ul>{links(many)}</ul></nav>", f"<nav>{words(1, 5)}</nav>", f"<nav {n()}>{links(many, 'span')}</nav>", f"<div {n()}><ul>{links(many)}</ul></div>", f"<ul {n()}>{links(many)}</ul>", f'<div role="navigation">{links(many, "span")}</div>']),
            "header": lambda: r.choice([f"<header><a href='/'>{words(1, 3)}</a><p>{say}</p></header>", f"<header {n()}><h1>{words(1, 4)}</h1></header>", f"<div {n()}><h1>{words(2, 5)}</h1><p>{say}</p></div>", f'<div role="banner"><p>{say}</p></div>']),
            "footer": lambda: r.choice([f"<footer>{say}</footer>", f"<footer {n()}><p>{say}</p><ul>{links(many)}</ul></footer>", f"<div {n()}><p>{say}</p></div>", f"<div {n()}>{say}</div>", f"<footer><ul><li>{say}</li><li>{words(1, 9)}</li></ul></footer>", f'<div role="contentinfo">{say}</div>']),
            "aside": lambda: r.choice([f"<aside><h3>{words(1, 3)}</h3><p>{say}</p></aside>", f"<aside {n()}><ul>{links(many)}</ul></aside>", f"<div {n()}><h4>{words(1, 3)}</h4><p>{say}</p><ul>{links(many)}</ul></div>", f"<div {n()}><p>{say}</p></div>", f'<div role="complementary"><p>{say}</p></div>']),
            "ad": lambda: r.choice([f"<div {n()}>{say}</div>", f"<div {n()}><p>{say}</p></div>", f"<section {n()}><p>{say}</p></section>", f"<p {n()}>{say}</p>"]),
            "notice": lambda: r.choice([f"<div {n()}><p>{say}</p><button>OK</button></div>", f"<div {n()}>{say}</div>", f'<div role="{r.choice(["alert", "dialog", "status"])}">{say}</div>', f"<p {n()}>{say}</p>", f"<dialog>{say}</dialog>"]),
            "form": lambda: r.choice([f"<form><label>{say}</label><input name='q'><p>{words(2, 6)}</p></form>", f"<div {n()}><form><p>{say}</p></form></div>", f"<div {n()}><p>{say}</p></div>", f"<form {n()}>{say}<select><option>{say}</select></form>", f'<div role="search">{say}</div>']),
            "comments": lambda: r.choice([f"<div {n()}>{said('div', ' ' + n())}</div>", f"<section {n()}><h2>{words(1, 2)}</h2>{said('article', ' ' + n())}</section>", f"<ol {n()}>{said('li', r.choice(['', ' ' + n()]))}</ol>", f"<ul {n()}>{said('li', r.choice(['', ' ' + n()]))}</ul>", f"<div {n()}>{said('div', '')}</div>"]),
            "share": lambda: r.choice([f"<div {n()}>{links(many, 'span')}</div>", f"<ul {n()}>{links(many)}</ul>", f"<p {n()}>{say}</p>"]),
            "script": lambda: f"<script>var x = '<p>{words(2, 4)}</p>';</script><style>p{{margin:0}}</style>",
        }[kind]()

    def article():
        wanted, html = [], []

        def add(tag, a, b, inside=None):
            text = words(a, b)
            wanted.append(text)
            shown = text
            if inside:
                cut = text.split(" ")
                cut[0] = f"<{inside}{' href=/y' if inside == 'a' else ''}>{cut[0]}</{inside}>"
                shown = " ".join(cut)
            html.append(f"<{tag}{r.choice([' ' + named('inner')] + [''] * 9)}>{shown}</{tag}>" if tag else shown)

        add(r.choice(["h1", "h1", "h2"]), 2, 9)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.7:
                add("p", *r.choice([(0, 3), (8, 60), (20, 90)]), r.choice([None, None, "b", "em", "a"]))
            elif kind < 0.78:
                add(r.choice(["h2", "h3"]), 1, 6)
            elif kind < 0.86:
                html.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    add("li", 2, 15)
                html.append("</ul>")
            elif kind < 0.92:
                add("blockquote", 5, 30)
            elif kind < 0.96:
                html.append("<table><tr>")
                for _ in range(2):
                    add("td", 1, 4)
                html.append("</tr></table>")
            elif kind < 0.97:
                add("pre", 3, 12)
            elif kind < 0.985:
                add("div", *r.choice([(2, 12), (8, 60)]))
            else:
                html.append("<figure><img src='a.png'>")
                add("figcaption", 3, 9)
                html.append("</figure>")
            if r.random() < 0.12:
                html.append(extra(r.choice(["ad", "aside", "share", "form", "notice"])))
        return "".join(html), wanted

    out = []
    for k in range(count):
        if k % 25 == 0:  # a text and nothing else
            text = words(2, 80)
            out.append((r.choice(["<div>{}</div>", "{}", "<p>{}", "<html><body>{}</body></html>", "<div><div>{}</div></div>", "<body><div>{}"]).format(text), [text]))
            continue
        inner, wanted = article()
        # what publishing systems write: a post's number, kind, section and tags stand on the article itself
        post = f'class="post-{r.randint(1, 9999)} post type-{r.choice(["post", "page"])} status-publish hentry category-{topic()} tag-{topic()} tag-{topic()}"'
        c = lambda: named("content")
        wrap = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", f"<article {post}>{{}}</article>", f"<article {post}>{{}}</article>", f"<main><article {c()}><div {c()}>{{}}</div></article></main>", f"<article {c()}>{{}}</article>", f"<div {c()}>{{}}</div>", f"<div {c()}>{{}}</div>", f"<section {c()}>{{}}</section>", "<div>{}</div>", "{}", f"<div {named('plain')}>{{}}</div>", f"<div {named('plain')}><div {c()}>{{}}</div></div>", "<article><div>{}</div></article>", '<div role="main">{}</div>'])
        before = [extra(k) for k in ("header", "nav", "ad", "notice", "form", "script") if r.random() < 0.45]
        after = [extra(k) for k in ("aside", "ad", "comments", "form", "share", "footer", "nav", "script") if r.random() < 0.45]
        r.shuffle(before)
        body = "".join(before) + wrap.format(inner) + "".join(after)
        if r.random() < 0.3:
            body = f"<div {named('plain')}>{body}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{body}</body></html>", wanted))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(html: str | None, model: Model) -> str:
    """The content blocks of a page joined by line feeds; a page of one block in plain elements is that block."""
    if not html:
        return ""
    page = Page(html)
    if not page.texts:
        return ""
    if len(page.texts) == 1 and all(n.tag in BARE and not n.names for n in page.nodes):
        return page.texts[0]  # nothing is around it
    p = model.marginals(page)
    return "\n".join(t for leaf, t in zip(page.at, page.texts, strict=True) if p[leaf] > 0.5)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row, from its whole html.

    Null, empty or text-free html gives an empty text. Each block (an element of block kind) has its white space turned into single
    blanks; br counts as white space. An unknown declaration is a comment up to its >, and a head ends where something stands that cannot
    be in it. Rows with equal ids are extracted each. Other columns are not read.
    """
    told = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                texts = [extract(x, told.value) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
