"""Operator 5, main text of HTML pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements and text blocks. Features of a node: its tag, learned weights of the tokens of its
class, id and role and of its ancestors', its ancestors' kinds, depth, text and link density of its subtree, and how it
compares with its siblings. Trees give each node the log odds that its subtree holds main text. Decoding takes the best
consistent choice for the whole tree: a dropped node drops all below it, and a kept node has a kept descendant or text; so
no ancestor contradicts a descendant.

Tokens are hashed, and their weights and the trees are fitted on generated pages (a fixed seed), whose parts are known:
pages with and without semantic tags, with usual, invented and no class names, in nested boxes, in table cells and bare.
Parsing and features take time in proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .common import slices

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>?", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag of usual length, quoted values being free.
REST = re.compile(r"""((?>[^>"']|"[^"]{0,500}"|'[^']{0,500}'){0,500}+)>""")
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements that are blocks, that have no content, whose content is no text, and whose content is skipped.
BLOCKS = set(
    "html body div p article section main nav aside header footer form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption address details summary hr center menu dialog".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
HIDDEN = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("noscript", "template")}
SKIPPED = set("head noscript template svg math select button canvas audio video datalist".split())
#: What may stand in a head, so that any other element ends it; HTML elements that end an open svg or math.
IN_HEAD = set("head html base basefont bgsound link meta title noscript noframes style script template".split())
ENDS_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main nav aside header footer form".split())
#: An open element that a start tag of these closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}}
TAGS = ["p", "h", "li", "div", "article", "section", "main", "nav", "aside", "header", "footer", "form", "table", "text", "quote", "cell"]
KIND = {"p": "p", "li": "li", "dd": "li", "dt": "li", "ul": "li", "ol": "li", "div": "div", "table": "table", "tr": "table", "td": "cell", "th": "cell", "tbody": "table", "blockquote": "quote", "pre": "quote", "#": "text"}
KIND |= {t: t for t in ("article", "section", "main", "nav", "aside", "header", "footer", "form")} | {f"h{i}": "h" for i in range(1, 7)} | {"fieldset": "form", "menu": "nav", "dialog": "aside"}
CODE = {t: i for i, t in enumerate(TAGS)}
KINDS = {t: CODE[k] for t, k in KIND.items()}
#: Buckets of attribute tokens.
TOKENS = 4096
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=20_000)
def read_attributes(attributes: str) -> tuple[bool, tuple[int, ...]]:
    """(hidden, hashed tokens of class, id and role) of a start tag."""
    hidden, tokens = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("hidden", "aria-hidden", "style"):
            hidden |= name == "hidden" or value.lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        else:
            tokens.update(t for t in SPLIT.split(CAMEL.sub(" ", value).lower()) if len(t) > 1)
    return hidden, tuple(sorted(zlib.crc32(t.encode()) % TOKENS for t in tokens))


class Tags:
    """The tags of a page, from any place on; in time linear in the page.

    A tag ends at the first `>` outside quotes, or at the first at all if there is none. A `<` after the last `>` is text.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.marks: list[int] | None = None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag, or, without a name, comment or declaration."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if m := NAME.match(source, at) if at < self.last else None:
                rest = REST.match(source, m.end()) if self.marks is None else None
                if end := rest.end() if rest else self._end(m.end()) + 1:
                    return at, end, m[1], m[2].lower(), source[m.end() : end - 1]
            elif m := COMMENT.match(source, at):
                return at, m.end(), "", "", ""
            at += 1
        return None

    def _end(self, at: int) -> int:
        """The `>` of a tag of unusual length. From the first of these on, all are looked up: they are found at once, from the page's end on."""
        if self.marks is None:
            self.marks = [m.start() for m in MARK.finditer(self.source)]
            self.ends = [-1] * (len(self.marks) + 1)  # of a tag whose rest begins before the mark, outside quotes
            after: dict[str, int] = {}  # the next quote of each kind
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.source[self.marks[k]]
                self.ends[k] = self.marks[k] if c == ">" else self.ends[after[c] + 1] if c in after else -1
                if c != ">":
                    after[c] = k
        end = self.ends[bisect_left(self.marks, at)]
        return end if end >= 0 else self.source.find(">", at)


class Page:
    """Nodes in page order: parent, kind, depth, end of the subtree, kinds above, tokens, and for text blocks the text and its characters in links."""

    def __init__(self, source: str):
        self.parent, self.kind, self.depth, self.end, self.over, self.hidden = [-1], [CODE["div"]], [0], [0], [0], [False]
        self.tokens: list[tuple[int, ...]] = [()]
        self.text, self.linked = [""], [0]
        self._stack: list[tuple[str, int]] = [("html", 0)]  # open blocks and their nodes
        self._open_tags: Counter[str] = Counter()
        self._parts: list[str] = []
        self._links, self._link_at = 0, 0  # characters in links; the depth of the stack at which a link began
        at, skip, depth, inner = 0, "", 0, 0  # inner: open elements of HTML inside an svg
        tags, unclosed = Tags(source), set()
        while tag := tags.next(at):
            start, stop, closing, name, attributes = tag
            if start > at and not skip:
                self._put(source[at:start])
            at = stop
            if not name:
                continue
            if skip:
                if name == skip:
                    depth += -1 if closing else 1
                    skip = skip if depth else ""
                    if closing or skip:
                        continue
                elif skip == "head" and name in HIDDEN and not closing and name not in unclosed:
                    if end := HIDDEN[name].search(source, at):
                        at = end.end()
                    else:
                        unclosed.add(name)
                    continue
                elif name == "foreignobject":
                    inner += -1 if closing else 1
                elif skip == "head" and (name not in IN_HEAD if not closing else name == "body"):
                    skip = ""
                elif not closing and not inner and (skip == "button" and name in BLOCKS or skip in ("svg", "math") and name in ENDS_FOREIGN):
                    skip = ""
            if skip and name not in RAW:
                continue
            if closing:
                self._close(name)
            elif name in RAW:
                end = RAW[name].search(source, at)
                at = end.end() if end else len(source)
            elif name in SKIPPED and not attributes.endswith("/"):
                skip, depth, inner = name, 1, 0
            else:
                self._open(name, attributes)
        if not skip:
            self._put(source[at:])
        self._flush()
        self._cut(0)

    def _put(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._link_at:
                self._links += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                node = self._node("#", False, ())
                self.text[-1], self.linked[-1], self.end[-1] = text, min(self._links, len(text)), node + 1
            self._parts, self._links = [], 0

    def _node(self, tag: str, hidden: bool, tokens: tuple[int, ...]) -> int:
        above = self._stack[-1][1]
        self.parent.append(above)
        self.kind.append(KINDS.get(tag, CODE["div"]))
        self.depth.append(self.depth[above] + 1)
        self.end.append(0)
        self.over.append(self.over[above] | 1 << self.kind[above] if above else 0)
        self.hidden.append(hidden or self.hidden[above])
        self.tokens.append(tokens)
        self.text.append("")
        self.linked.append(0)
        return len(self.parent) - 1

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
        elif name in BLOCKS:
            self._flush()
            if name in ("html", "body") and len(self._stack) == 1:
                self.hidden[0] |= read_attributes(attributes)[0]
                return
            self._end_implied(name)
            if name != "hr":
                self._stack.append((name, self._node(name, *read_attributes(attributes))))
                self._open_tags[name] += 1
        elif name == "a" and not attributes.endswith("/"):
            self._link_at = len(self._stack)

    def _end_implied(self, name: str) -> None:
        """Close what a start tag closes: a paragraph, and of lists and tables the item, cell or row before, within its list or table."""
        ended = CLOSES.get(name, set())
        if not self._open_tags["p"] and not any(self._open_tags[t] for t in ended):
            return
        bound = {"ul", "ol", "dl"} if name in ("li", "dt", "dd") else {"table"}
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i][0]
            if tag == "p" or tag in ended:
                self._cut(i)
                ended = ended if name in ("tr", "tbody") else set()
                if not any(self._open_tags[t] for t in ended):
                    return
            elif tag in bound or not any(self._open_tags[t] for t in ended):
                return

    def _close(self, name: str) -> None:
        if name == "a":
            self._link_at = 0
        elif name in BLOCKS:
            self._flush()
            if self._open_tags[name]:
                i = len(self._stack) - 1
                while self._stack[i][0] != name:
                    i -= 1
                self._cut(i)

    def _cut(self, i: int) -> None:
        for tag, node in self._stack[i:]:
            self.end[node] = len(self.parent)
            self._open_tags[tag] -= 1
        del self._stack[i:]
        if self._link_at > len(self._stack):
            self._link_at = 0


def features(pages: list[Page], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all nodes of all pages, first node of each page)."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    flat = lambda name, kind=np.int64: np.array([x for p in pages for x in getattr(p, name)], kind)
    parent, end = flat("parent") + first[page], flat("end") + first[page]
    root = np.zeros(len(page), bool)
    root[first] = True
    parent[root] = first
    kind, depth, over, hidden = flat("kind"), flat("depth"), flat("over"), flat("hidden")
    text = [t for p in pages for t in p.text]
    own = np.array([[len(t), t.count(".") + t.count("!") + t.count("?"), t.count(","), t.count("\xa9"), t.count("\xb7") + t.count("|") + t.count("\xbb")] for t in text], np.float64)
    own = np.column_stack([own, flat("linked"), np.ones(len(page)), own[:, 0] > 0])
    before = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    index = np.arange(len(page))
    sums = before[end] - before[index]  # a node's subtree follows it
    total = sums[first][page]
    size, sentence, comma, mark, bars, link, nodes, leaves = sums.T
    held = [t for p in pages for t in p.tokens]
    at = np.repeat(index, [len(t) for t in held])
    token = weights[np.array([x for t in held for x in t], np.int64)]
    score, low, high = np.bincount(at, token, len(page)), np.zeros(len(page)), np.zeros(len(page))
    np.minimum.at(low, at, token)
    np.maximum.at(high, at, token)
    above = np.zeros((len(page), 3))  # least and greatest weight of a token above, and the sum
    by_depth = np.argsort(depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]:
        up = parent[level]
        above[level, 0] = np.minimum(above[up, 0], low[up])
        above[level, 1] = np.maximum(above[up, 1], high[up])
        above[level, 2] = above[up, 2] + score[up]
    _, group, count = np.unique(parent * 64 + kind, return_inverse=True, return_counts=True)
    mean = np.bincount(group, size) / count
    fanout = np.bincount(parent[~root], minlength=len(page))
    paragraphs = np.bincount(parent[~root & (kind == CODE["p"])], minlength=len(page))
    # the largest part of the page that a paragraph's siblings, or the node's own children, make up
    prose = np.bincount(parent[~root & (kind == CODE["p"])], size[~root & (kind == CODE["p"])], len(page)) / (total[:, 0] + 1)
    columns = [kind == k for k in range(len(TAGS))] + [hidden, score, low, high, above[:, 0], above[:, 1], above[:, 2]]
    columns += [(over >> CODE[t]) & 1 for t in ("article", "main", "nav", "aside", "header", "footer", "form", "li", "cell", "section")]
    columns += [depth, np.log1p(size), link / (size + 1), size / nodes, sentence / (size + 1) * 100, comma / (size + 1) * 100, size / (total[:, 0] + 1), leaves, mark > 0, bars, np.minimum(sentence, 5)]
    columns += [count[group], np.log1p(mean[group]), size / (mean[group] + 1), fanout, fanout[parent], size[parent] / (total[:, 0] + 1), link[parent] / (size[parent] + 1), (index - first[page]) / sizes[page]]
    columns += [paragraphs, paragraphs[parent], prose, prose[parent], prose[parent[parent]], np.log1p(total[:, 0]), link[parent[parent]] / (size[parent[parent]] + 1), depth[parent] == 0]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1), first


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """Texts of the kept text blocks under the best consistent choice. A node's keeping adds its log odds."""
    gain = odds.tolist()
    best = [0.0] * len(gain)  # of kept descendants
    kept = [False] * len(gain)
    for i in range(len(gain) - 1, 0, -1):
        if (page.text[i] or best[i] > 0) and (value := gain[i] + best[i]) > 0:
            kept[i] = True
            best[page.parent[i]] += value
    kept[0] = True
    for i in range(1, len(gain)):
        kept[i] = kept[i] and kept[page.parent[i]]
    return [page.text[i] for i in range(1, len(gain)) if page.text[i] and kept[i]]


#: Names that pages give to their parts, from which the generated pages take class and id tokens.
NAMES = {
    "main": "content main article post entry-content article-body story post-content text single main-content articleBody entry body",
    "menu": "menu navbar navigation nav breadcrumb breadcrumbs main-menu topbar toolbar tabs nav-bar toc",
    "head": "header masthead banner site-header branding logo top page-header",
    "foot": "footer copyright colophon site-footer credits legal bottom footer-links",
    "side": "sidebar related widget side-bar recommended trending popular more aside widget-area complementary",
    "ad": "ad ads advert advert-banner advertisement sponsored promo sponsor promoted teaser ad-slot",
    "notice": "cookie-notice consent notice popup cookie alert modal overlay gdpr newsletter cookies banner-cookie",
    "talk": "comments comment-list discussion comment replies reply responses commentlist disqus",
    "form": "search newsletter subscribe login signup search-form contact",
    "share": "share social tags pagination sharing social-links pager",
}


def generated(seed: int, pages: int) -> list[tuple[str, list[str]]]:
    """(html, main text blocks) of pages of varying layout."""
    r = np.random.default_rng(seed)
    syllables = [a + b for a in "b c d f g h l m n p r s t v w th st ch".split() for b in "a e i o u en er on".split()]

    def pick(options):
        return options[int(r.integers(len(options)))]

    def upto(a: int, b: int) -> int:
        return int(r.integers(a, b))

    def words(n: int, shout: bool = False) -> str:
        w = ["".join(pick(syllables) for _ in range(upto(1, 4))) for _ in range(n)]
        s = " ".join(x + ("," if r.random() < 0.07 else "") for x in w).rstrip(",")
        return s.upper() if shout else s.capitalize()

    def prose(most: int = 60) -> str:
        odd = r.random()
        if odd < 0.06:
            return " ".join(words(1) + pick(["!!", "***", "###", "%%%"]) for _ in range(upto(3, most)))
        return " ".join(words(upto(3, 18), odd < 0.1) + pick([".", ".", ".", "?", "!"]) for _ in range(upto(1, max(2, most // 12))))

    def links(n: int) -> str:
        items = [f'<a href="/{words(1)}">{words(upto(1, 4))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else pick([" | ", " ", " &middot; ", "<br>"]).join(items)

    class Style:
        """How one page names and marks up its parts."""

        def __init__(self):
            self.naming = pick(["usual", "usual", "usual", "invented", "none"])
            self.semantic = r.random() < (0.6 if self.naming == "usual" else 0.35)
            self.own = {part: words(1).lower() + pick(["", "-" + words(1).lower()]) for part in NAMES}
            #: Without names or tags of their own, prose that isn't main text can't be told from it; such pages have little of it.
            self.blind = self.naming != "usual" and not self.semantic

        def attr(self, part: str, often: float = 0.9) -> str:
            if self.naming == "none" or r.random() > often:
                return f' class="{pick(["row", "col", "inner", "box", "x1", "clearfix", "wrap"])}"' if r.random() < 0.1 else ""
            token = self.own[part] if self.naming == "invented" else pick(NAMES[part].split())
            return f' {pick(["class", "class", "id"])}="{token}{pick(["", "", " x1", " clearfix", " wrap"])}"'

        def box(self, tag: str, part: str, inner: str) -> str:
            t = tag if self.semantic and r.random() < 0.8 else "div"
            return f"<{t}{self.attr(part, 0.4 if t != 'div' else 1)}>{inner}</{t}>"

    def article(style: Style) -> tuple[str, list[str]]:
        parts, texts = [], []
        if r.random() < 0.1:  # a title and a line
            title = words(upto(1, 10))
            line = pick([title, words(upto(1, 12)), prose(12)])
            return f"<h1>{title}</h1><p>{pick(['', '<b>'])}{line}{pick(['</p>', '<br>', ''])}", [" ".join(x.split()) for x in (title, line)]
        for k in range(upto(1, 16)):
            odd, t = r.random(), prose()
            if k == 0 and r.random() < 0.85:
                t = words(upto(1, 10))
                parts.append(f"<h1>{t}</h1>")
            elif odd < 0.68:
                parts.append(f"<p>{pick(['', '', '<b>', '<br>'])}{t}{pick(['</p>', '</p>', '', '<br>'])}")
            elif odd < 0.76:
                t = words(upto(1, 7))
                parts.append(f"<h{(n := upto(2, 5))}>{t}</h{n}>")
            elif odd < 0.86:
                items = [prose(24) for _ in range(upto(2, 6))]
                parts.append("<ul>" + "".join(f"<li>{x}" + pick(["</li>", ""]) for x in items) + "</ul>")
                texts += items
                continue
            elif odd < 0.9:
                parts.append(f"<blockquote>{t}</blockquote>")
            elif odd < 0.93:
                cells = [words(upto(1, 4)) for _ in range(4)]
                parts.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells[:2]) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in cells[2:]) + "</tr></table>")
                texts += cells
                continue
            elif odd < 0.96:
                w = t.split()
                parts.append(f'<p>{w[0]} <a href="/{k}">{" ".join(w[1:4])}</a> {" ".join(w[4:])}</p>')
            else:
                parts.append(f"<div>{t}</div>")
            texts.append(t)
            if r.random() < 0.04 and not style.blind:
                parts.append(f"<div{style.attr(pick(['ad', 'share', 'side']), 1)}>{words(6)}</div>")
        return "".join(parts), [" ".join(t.split()) for t in texts]

    made = []
    for _ in range(pages):
        style = Style()
        inner, texts = article(style)
        if r.random() < 0.02 and not style.blind:
            inner, texts = "", []
        layout = pick(["semantic", "semantic", "box", "box", "bare", "table"])
        few = style.blind
        menu = style.box("nav", "menu", links(upto(3, 9)))
        head = style.box("header", "head", f"<h2>{words(2)}</h2>" + (f"<p>{words(upto(3, 9))}</p>" if not few else ""))
        ad = f"<div{style.attr('ad', 1)}>{prose(30) if not few else words(upto(2, 6))}</div>"
        notice = style.box("aside", "notice", f"<p>{prose(30) if not few else words(upto(3, 8))}</p><button>{words(1)}</button>")
        side = style.box("aside", "side", f"<h3>{words(2)}</h3>" + (links(upto(2, 7)) if few or r.random() < 0.6 else f"<p>{prose(40)}</p>"))
        talk = style.box("section", "talk", f"<h3>{words(1)}</h3>" + "".join(f"<div{style.attr('talk')}><p>{prose(50)}</p></div>" for _ in range(upto(1, 6))))
        if style.semantic and r.random() < 0.4:
            talk = f'<section id="{pick(NAMES["talk"].split())}">' + "".join(f"<p>{prose(50)}</p>" for _ in range(upto(1, 6))) + "</section>"
        form = f"<form{style.attr('form')}><label>{words(2)}</label><input name=q><p>{words(upto(3, 12))}.</p><button>{words(1)}</button></form>"
        share = f"<div{style.attr('share', 1)}>{links(3)}</div>"
        foot = style.box("footer", "foot", f"&copy; {words(2)}" + pick([f" &middot; {prose(40)}", f" {upto(1990, 2030)}", f" &middot; {links(3)}"]))
        keep = lambda x, p: x if r.random() < p else ""
        before = keep(menu, 0.7) + keep(head, 0.35) + keep(ad, 0.4) + keep(notice, 0.25)
        after = keep(side, 0.35) + (keep(talk, 0.35) if not few else "") + keep(form, 0.25) + keep(share, 0.35)
        foot = keep(foot, 0.8)
        if layout == "semantic" and style.semantic:
            tag = pick(["article", "article", "main", "section"])
            main = f"<{tag}{style.attr('main', 0.3)}>{inner}</{tag}>"
            main = f"<main>{main}</main>" if r.random() < 0.2 and tag != "main" else main
        elif layout == "bare":
            main = inner
            if few or r.random() < 0.5:
                before, after, foot = keep(menu, 0.4), keep(share, 0.2), keep(foot, 0.5)
        elif layout == "table":
            cells = [f"<td>{links(upto(3, 9))}</td>"] * (r.random() < 0.8) + [f"<td{style.attr('main', 0.5)}>{inner}</td>"] + [f"<td>{side}</td>"] * (r.random() < 0.3)
            main = "<table><tr>" + "".join(cells) + "</tr></table>"
            before, after = keep(head, 0.4), ""
        else:
            main = f"<div{style.attr('main')}>{inner}</div>"
            main = f"<div{style.attr('main', 0.2)}>{main}{keep(side, 0.2)}</div>" if r.random() < 0.3 else main
        body = before + "<!-- x -->" + main + after + foot
        if layout != "bare" and r.random() < 0.25:
            body = f"<div{pick(['', ' id=page', ' class=wrapper'])}>{body}</div>"
        made.append((f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{body}" + pick(["</body></html>", "</body></html>", ""]), texts))
    return made


@dataclass
class Model:
    weights: np.ndarray  # of hashed tokens
    trees: Boosted


@cache
def model(seed: int = 42, pages: int = 1200) -> Model:
    """Weights of tokens, fitted on half of the generated pages, and trees, fitted on the others; a node's label is whether its subtree holds a main text block."""
    made = generated(seed, pages)
    parsed = [Page(source) for source, _ in made]
    labels = []
    for page, (_, texts) in zip(parsed, made):
        y, left = np.zeros(len(page.parent)), list(reversed(texts))
        for i, t in enumerate(page.text):
            if left and t == left[-1]:
                left.pop()
                while i >= 0 and not y[i]:
                    y[i] = 1
                    i = page.parent[i]
        labels.append(y)
    counts = np.zeros((2, TOKENS))
    for page, y in zip(parsed[::2], labels[::2]):
        for label, tokens in zip(y, page.tokens):
            counts[int(label), list(tokens)] += 1
    weights = np.log((counts[1] + 0.5) / (counts[0] + 0.5))
    weights[counts.sum(axis=0) < 5] = 0  # too rare to say anything
    x, _ = features(parsed[1::2], weights)
    return Model(weights, boost(x, np.concatenate(labels[1::2]), trees=45, depth=5))


def main_text(pages: list[str], own: Model) -> list[str]:
    parsed = [Page(p) for p in pages]
    x, first = features(parsed, own.weights)
    odds = own.trees.score(x)
    return ["\n".join(decode(p, odds[a : a + len(p.parent)])) for p, a in zip(parsed, first)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_chars) of every row: its main text, blocks joined by line feeds.

    Null and empty pages, and pages with no main text, give the empty text. A node with log odds of zero is dropped. Markup
    that does not end, unknown elements and unclosed tags are read as browsers do, roughly. Whole pages are read, in time
    proportional to their length; nothing is cut. Repeated rows get a row each; other columns are not read; an empty table
    gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    pages = pages.select(id_col, html_col)
    schema = pages.select(id_col, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, sources in slices(batch.column(1), 1 << 20):
                texts = main_text([(s or b"").decode() for s in sources], own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
