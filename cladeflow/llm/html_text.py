"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A forgiving parser turns a page into nodes (blocks, and inline elements with a class, id or role). A node is
described by its tag, the meaning of its attribute tokens and those of its ancestors, its depth and place
among siblings, and the text below it: amount, density against tags, share of links, sentence marks,
paragraphs and form controls. Gradient-boosted trees give each node the log-odds of being main text or
holding it. Decoding then picks the set of kept nodes with the greatest sum of log-odds, kept counted for
and dropped against, in which nothing is kept below a dropped node: one pass up the tree.

No labelled pages come with the tables, so the trees learn from pages that `specimens` writes: articles of
many shapes among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in
semantic and in plain markup, with telling and with meaningless class names. The seed is fixed, so the
model is the same everywhere.

Defined cases: null and empty html give the empty text, so do pages without main text; unclosed, misnested
and unknown tags never fail; pages are read whole; white space (no-break spaces too, and line breaks by <br>) becomes one
space inside a block; repeated rows have equal texts; other columns pass through.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.session import ship, table, trimmed

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
NAMED = re.compile(r"(?:\b(?:class|id|role|aria-label)|\bdata-[a-z-]*(?:type|role|component))\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object svg math canvas audio video map xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br input button select option optgroup textarea picture source".split())
CONTROLS = frozenset("input button select textarea option label".split())
#: Tags that a start tag closes, and the ancestors beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Start tags that leave an open head open.
IN_HEAD = frozenset("html head title meta link style script base noscript template".split())
ENDS_P = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())

#: What attribute tokens say, by group.
MEANING = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager paging tabs toc skip topics categories sitemap links hamburger",
    "head": "header masthead topbar toolbar banner logo branding hero",
    "foot": "footer foot copyright colophon legal credits imprint contentinfo",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular more teaser teasers complementary secondary",
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion dfp billboard outbrain taboola",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal dialog overlay paywall warning toast privacy announcement alertdialog",
    "form": "form search searchbox login signin signup register subscribe newsletter subscription poll survey contact input field",
    "talk": "comment comments commentlist discussion reply replies respond response responses disqus thread reactions feedback",
    "share": "share sharing social follow facebook twitter tweet buttons like print bookmark",
    "main": "article content contents post entry main story body text prose maincontent articlebody postcontent blog page",
    "hidden": "hidden invisible offscreen sr screenreader hide",
}
GROUPS = tuple(MEANING)
GROUP_OF = {w: i for i, words in enumerate(MEANING.values()) for w in words.split()}
KINDS = {
    "heading": "h1 h2 h3 h4 h5 h6", "paragraph": "p blockquote pre figcaption", "list": "ul ol dl menu", "item": "li dt dd", "box": "div section figure center details span",
    "article": "article main", "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside", "form": "form fieldset label button select dialog", "table": "table tbody thead tfoot tr td th",
}
KIND_OF = {t: i for i, tags in enumerate(KINDS.values()) for t in tags.split()}
#: Elements that hold blocks rather than text.
BOXES = frozenset("# div section article main center body details figure aside header footer nav form".split())
#: Kinds whose presence above a node tells something.
ABOVE = (5, 6, 7, 8, 9, 10)
NUMBERS = ("chars", "words", "link_share", "chars_per_tag", "words_per_block", "stops", "depth", "place", "siblings", "page_share", "parent_share", "paragraphs", "controls", "links", "own_chars", "position", "h1_inside", "long_paragraphs", "paragraphs_around", "long_paragraphs_around")
FEATURES = [*(f"tag_{k}" for k in KINDS), *(f"says_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS), *(f"above_tag_{i}" for i in ABOVE), *NUMBERS]


@functools.lru_cache(maxsize=20_000)
def meanings(attributes: str) -> tuple[int, ...]:
    """Groups that the class, id and role tokens of a tag belong to."""
    found = set()
    for m in NAMED.finditer(attributes):
        value = m[1].strip("\"'")
        words = [w.lower() for w in SPLIT.findall(value)]
        found.update(GROUP_OF[w] for w in [*words, *(re.sub("[^a-z]", "", x.lower()) for x in value.split())] if w in GROUP_OF)
    if re.search(r"\bhidden\b(?!-)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
        found.add(GROUPS.index("hidden"))
    return tuple(sorted(found))


class Page:
    """Nodes of a page in document order; node 0 is the root. `flow` lists texts and block borders."""

    __slots__ = ("tag", "groups", "parent", "flow", "loose")

    def __init__(self, source: str) -> None:
        self.tag, self.groups, self.parent = ["#"], [()], [-1]
        #: (node, text, inside a link) in order; text None is a block border.
        self.flow: list[tuple[int, str | None, bool]] = []
        #: The node of the loose text just read: text straight in a box is a node of its own.
        self.loose: tuple[int, int, int] = (-1, -1, -1)
        # Open elements: (tag, node, unseen, inside a link).
        stack: list[tuple[str, int, bool, bool]] = [("#", 0, False, False)]
        flow, at, size = self.flow, 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            begin = m.start() if m else size
            if begin > at and not stack[-1][2]:
                self._text(stack[-1][1], source[at:begin], stack[-1][3])
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<![CDATA[") and not stack[-1][2]:
                    self._text(stack[-1][1], entities.escape(m[0][9:-3]), stack[-1][3])
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._end(name, stack)
                continue
            attributes = m[3] or m[6] or ""
            self._start(name, attributes, stack)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(source, at)
                inner = source[at : close.start() if close else size]
                if name == "textarea" and not stack[-1][2]:
                    self._text(stack[-1][1], inner, stack[-1][3])
                at = close.end() if close else size
                self._end(name, stack)

    def _text(self, node: int, text: str, link: bool) -> None:
        if self.tag[node] in BOXES:
            at, own, upto = self.loose
            between = self.flow[upto:] if at == node else [(0, None, False)]
            if any(t is None for _, t, _ in between):
                if text.isspace():
                    self.flow.append((node, text, link))
                    return
                own = len(self.tag)
                self.tag.append("#text")
                self.groups.append(())
                self.parent.append(node)
            self.flow.append((own, text, link))
            self.loose = (node, own, len(self.flow))
        else:
            self.flow.append((node, text, link))

    def _start(self, name: str, attributes: str, stack: list) -> None:
        if name not in IN_HEAD and len(stack) > 1 and stack[1][0] == "head":
            self._close({"head"}, {"noscript", "template"}, stack)
        if name in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object", "blockquote", "div", "article", "section", "body"} - {name if name == "p" else ""}, stack)
        if name in CLOSES:
            self._close(*CLOSES[name], stack)
        top, node, unseen, link = stack[-1]
        if name in ("html", "body"):
            groups = meanings(attributes) if attributes else ()
            if name == "body" and groups:
                self.groups[0] = tuple(g for g in groups if g == GROUP_OF["main"])
            if name == "body":
                stack.append((name, 0, False, False))
            return
        inline = name in INLINE
        if not inline:
            self.flow.append((node, None, False))
        elif name == "br":
            self.flow.append((node, " ", False))
        if name in VOID:
            return
        groups = meanings(attributes) if attributes else ()
        if inline and not (groups and name != "a") and name not in ("button", "select", "textarea", "label"):
            own = node
        else:
            own = len(self.tag)
            self.tag.append(name)
            self.groups.append(groups)
            self.parent.append(node)
        stack.append((name, own, unseen or name in UNSEEN, link or name == "a"))

    def _end(self, name: str, stack: list) -> None:
        if name in ("html", "body"):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                self._pop(i, stack)
                return
            if name in INLINE and stack[i][0] not in INLINE:
                return  # a stray end tag of an inline element stays inside its block

    def _close(self, names: set, limits: set, stack: list) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                self._pop(i, stack)
                return
            if stack[i][0] in limits:
                return

    def _pop(self, i: int, stack: list) -> None:
        while len(stack) > i:
            name = stack.pop()[0]
            if name not in INLINE:
                self.flow.append((stack[-1][1], None, False))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, own, words, links, stops, blocks, paras, controls, anchors, tags, ones, longs = ([0] * n for _ in range(12))
        first = [-1] * n
        seen, last = 0, None
        for node, text, link in self.flow:
            if text is None:
                last = None
                continue
            size = len(text) - text.count(" ") if text else 0
            if not size or text.isspace():
                continue
            own[node] += size
            words[node] += len(text.split())
            stops[node] += text.count(". ") + text.count("? ") + text.count("! ") + text.count(", ") + (text.rstrip()[-1:] in ".!?")
            if link:
                links[node] += size
                anchors[node] += 1
            if node != last:
                blocks[node] += 1
                last = node
            if first[node] < 0:
                first[node] = seen
            seen += size
        parent, tag = self.parent, self.tag
        chars = own[:]
        long_own = [w >= 12 for w in words]
        for i in range(n - 1, -1, -1):
            t = tag[i]
            tags[i] += 1
            paras[i] += t == "p"
            longs[i] += t == "p" and long_own[i]
            controls[i] += t in CONTROLS or t == "form"
            ones[i] += t == "h1"
            p = parent[i]
            if p >= 0:
                for a in (chars, words, links, stops, blocks, paras, controls, anchors, tags, ones, longs):
                    a[p] += a[i]
                if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                    first[p] = first[i]
        depth, place, siblings = [0] * n, [0] * n, [0] * n
        above_groups, above_tags = [0] * n, [0] * n
        n_groups, n_kinds = len(GROUPS), len(KINDS)
        out = np.zeros((n, len(FEATURES)), np.float32)
        base = n_kinds
        total = max(1, chars[0])
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = siblings[p]
            siblings[p] += 1
            up = 0
            for g in self.groups[p]:
                up |= 1 << g
            above_groups[i] = above_groups[p] | up
            k = KIND_OF.get(tag[p], -1)
            above_tags[i] = above_tags[p] | (1 << k if k >= 0 else 0)
        cells_r, cells_c = [], []
        numbers = []
        for i in range(n):
            k = KIND_OF.get(tag[i], -1)
            if k >= 0:
                cells_r.append(i)
                cells_c.append(k)
            for g in self.groups[i]:
                cells_r.append(i)
                cells_c.append(base + g)
            if above_groups[i]:
                for g in range(n_groups):
                    if above_groups[i] >> g & 1:
                        cells_r.append(i)
                        cells_c.append(base + n_groups + g)
            if above_tags[i]:
                for j, k in enumerate(ABOVE):
                    if above_tags[i] >> k & 1:
                        cells_r.append(i)
                        cells_c.append(base + 2 * n_groups + j)
            c = chars[i]
            p = parent[i]
            numbers.append((
                c, words[i], links[i] / c if c else 0.0, c / tags[i], words[i] / blocks[i] if blocks[i] else 0.0, 100 * stops[i] / c if c else 0.0,
                depth[i], place[i] / max(1, siblings[p]) if p >= 0 else 0.0, siblings[p] if p >= 0 else 0, c / total, c / max(1, chars[p]) if p >= 0 else 1.0,
                paras[i], controls[i], anchors[i], own[i], max(0, first[i]) / total, ones[i], longs[i],
                paras[p] if p >= 0 else 0, longs[p] if p >= 0 else 0,
            ))
        out[cells_r, cells_c] = 1
        out[:, -len(NUMBERS) :] = numbers
        return out

    def kept(self, odds: np.ndarray) -> list[bool]:
        """The consistent choice with the greatest sum: nothing is kept below a dropped node."""
        n, parent = len(self.tag), self.parent
        own = np.clip(odds, -6, 6).tolist()
        below, keep = own[:], own[:]
        for i in range(n - 1, 0, -1):
            below[parent[i]] += below[i]
            keep[parent[i]] += max(keep[i], -below[i])
        out = [True] * n
        for i in range(1, n):
            out[i] = out[parent[i]] and keep[i] > -below[i]
        return out

    def text(self, kept: list[bool]) -> str:
        blocks, now = [], []
        for node, text, _ in self.flow:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif kept[node]:
                now.append(text)
        blocks.append("".join(now))
        clean = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.2, bins: int = 24, l2: float = 1.0, least: float = 1.0, share: float = 0.4, seed: int = 11) -> None:
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
        every = self._bins(x)
        d, width = every.shape[1], bins + 1
        p = y.mean()
        self.bias = float(np.log(p / (1 - p)))
        f = np.full(len(every), self.bias)
        offsets = (np.arange(d) * width)[None, :]
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(rounds):
            rows = np.flatnonzero(draw.random(len(every)) < share)
            b, n = every[rows], len(rows)
            s = 1 / (1 + np.exp(-f[rows]))
            g, h = s - y[rows], s * (1 - s)
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, 255, np.int32)
            gd, hd = np.repeat(g, d), np.repeat(h, d)
            for level in range(depth):
                nodes, start = 2**level, 2**level - 1
                slot = (at[:, None] * (d * width) + offsets + b).ravel()
                gs = np.bincount(slot, gd, nodes * d * width).reshape(nodes, d, width)
                hs = np.bincount(slot, hd, nodes * d * width).reshape(nodes, d, width)
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                ok = gain.reshape(nodes, -1).max(axis=1) > 1e-9
                feature[start : start + nodes] = np.where(ok, best // width, 0)
                cut[start : start + nodes] = np.where(ok, best % width, 255)
                at = at * 2 + (b[np.arange(n), feature[start + at]] > cut[start + at])
            leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
            self.trees.append((feature, cut, leaf))
            f += leaf[self._leaves(every, feature, cut)]

    def _leaves(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            node = at + (2**level - 1)
            at = at * 2 + (b[rows, feature[node]] > cut[node])
        return at

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        f = np.full(len(b), self.bias)
        for feature, cut, leaf in self.trees:
            f += leaf[self._leaves(b, feature, cut)]
        return f


MARK = "\x02"  # in a specimen: the text after it, up to the next "<", is main text


def specimens(count: int, seed: int) -> list[str]:
    """Pages to learn from; the pieces of main text begin with MARK."""
    r = random.Random(seed)
    pick = r.choice
    word = lambda: "".join(pick(("an", "re", "tion", "le", "os", "in", "er", "qu", "ch", "est", "a", "o", "um", "de", "th")) for _ in range(r.randint(1, 4)))

    def say(lo: int, hi: int) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            out.append(word() + pick(("", "", "", "", "", ",", ".", ".")))
        s = " ".join(out)
        return s[:1].upper() + s[1:] + pick((".", ".", ".", "", "!"))

    def rich(lo: int, hi: int) -> str:
        s = say(lo, hi)
        if r.random() < 0.3:
            w = s.split(" ")
            i = r.randrange(len(w))
            w[i] = pick(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<i>{}</i>", "<code>{}</code>", "{}<br>", '<span class="k">{}</span>')).format(w[i])
            s = " ".join(w)
        return s

    def attr(group: str, strength: float) -> str:
        """A class or id: telling, or meaningless, or none."""
        u = r.random()
        if u < strength:
            w = pick(MEANING[group].split())
            w = pick((w, w, f"{w}-{pick(('box', 'wrap', 'inner', 'area', 'block', 'container', 'list', 'top'))}", f"site-{w}", f"{w}{r.randint(1, 9)}", f"js-{w}", f"{w} {pick(('clearfix', 'row', 'dark'))}", f"page_{w}"))
            return f' {pick(("class", "class", "id"))}="{w}"'
        if u < strength + 0.15:
            return f' class="{pick(("css", "x", "col", "row", "c", "wrap"))}-{r.randint(1, 99)}"'
        return ""

    def marked(s: str) -> str:
        return re.sub(r"(^|>)([^<]+)", lambda m: m[1] + MARK + m[2] if m[2].strip() else m[0], s)

    def link_list(lo: int, hi: int, w: int = 2) -> str:
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, w)))}</a>' for _ in range(r.randint(lo, hi))]
        u = r.random()
        if u < 0.6:
            return f"<ul{attr('menu', 0.2)}>" + "".join(f"<li>{x}</li>" if r.random() < 0.95 else f"<li>{x}" for x in items) + "</ul>"
        return pick((" | ", " ", " &middot; ", "\n")).join(items)

    def control() -> str:
        return pick(('<input type="text" name="q">', '<input type="submit" value="Go">', f"<button>{word()}</button>", f"<label>{word()} <input></label>", f"<select><option>{word()}<option>{word()}</select>", f"<textarea>{say(1, 5)}</textarea>"))

    def chrome(kind: str) -> str:
        strong = 0.9
        if kind == "menu":
            return pick((f"<nav{attr('menu', 0.3)}>{link_list(3, 10)}</nav>", f"<nav>{link_list(3, 9)}</nav>", f"<div{attr('menu', strong)}>{link_list(3, 10)}</div>", f'<div role="navigation">{link_list(2, 8)}</div>', link_list(4, 12)))
        if kind == "head":
            inner = pick((f'<a href="/">{word()}</a>', f"<h1>{word()} {word()}</h1><p>{say(2, 6)}</p>", f"<p>{say(2, 8)}</p>", f"<div{attr('head', 0.6)}>{word()}</div>{link_list(2, 6)}", say(1, 5)))
            return pick((f"<header{attr('head', 0.3)}>{inner}</header>", f"<header>{inner}</header>", f"<div{attr('head', 1.0)}>{inner}</div>"))
        if kind == "foot":
            inner = pick((f"&copy; {r.randint(1990, 2030)} {say(1, 9)}", f"<p>&copy; {word()}.com &middot; {say(3, 12)}</p>", f"{link_list(2, 8)}<p>{say(2, 9)}</p>", f"<small>{say(2, 9)}</small>", f"<p>{say(5, 30)}</p><p>{say(2, 20)}</p>"))
            return pick((f"<footer{attr('foot', 0.3)}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{attr('foot', 1.0)}>{inner}</div>"))
        if kind == "side":
            inner = pick((f"<h3>{say(1, 4)}</h3>{link_list(3, 8, 6)}", f"<p>{say(5, 40)}</p>", f"<h2>{say(1, 3)}</h2><p>{say(5, 25)}</p>{link_list(1, 4, 5)}", f"<div{attr('side', 0.5)}><h4>{say(1, 3)}</h4><p>{say(4, 20)}</p></div>" * 2))
            return pick((f"<aside{attr('side', 0.5)}>{inner}</aside>", f"<aside>{inner}</aside>", f"<div{attr('side', 1.0)}>{inner}</div>", f"<section{attr('side', 1.0)}>{inner}</section>"))
        if kind == "ad":
            inner = pick((say(3, 15), say(8, 40), f"<p>{say(3, 25)}</p>", f'<a href="/buy">{say(2, 8)}</a>', f'<a href="/x"><img src="a.png"></a><p>{say(2, 10)}</p>'))
            return pick((f'<div class="ad">{inner}</div>', f"<div{attr('ad', 1.0)}>{inner}</div>", f"<div{attr('ad', 1.0)}>{inner}</div>", f"<aside{attr('ad', 0.9)}>{inner}</aside>", f"<section{attr('ad', 1.0)}>{inner}</section>", f"<p{attr('ad', 1.0)}>{inner if '<p>' not in inner else say(4, 9)}</p>"))
        if kind == "notice":
            inner = pick((say(5, 30), f"<p>{say(6, 40)}</p><button>{word()}</button>", f"<p>{say(5, 20)}</p>", f"<h2>{say(1, 4)}</h2><p>{say(6, 30)}</p><a href='#'>{word()}</a>"))
            return pick((f"<div{attr('notice', 1.0)}>{inner}</div>", f'<div role="{pick(("alert", "dialog", "alertdialog"))}">{inner}</div>', f"<dialog{attr('notice', 0.5)}>{inner}</dialog>", f"<section{attr('notice', 1.0)}>{inner}</section>", f"<aside{attr('notice', 0.9)}>{inner}</aside>", f"<p{attr('notice', 1.0)}>{say(5, 25)}</p>"))
        if kind == "form":
            inner = pick(("", f"<p>{say(2, 15)}</p>", f"<h3>{say(1, 5)}</h3>", say(2, 8), f"<fieldset><legend>{word()}</legend>{say(1, 9)}</fieldset>")) + "".join(control() for _ in range(r.randint(1, 5)))
            return pick((f'<form action="/s"{attr("form", 0.4)}>{inner}</form>', f"<form>{inner}</form>", f"<div{attr('form', 0.9)}><form>{inner}</form></div>", f"<div{attr('form', 1.0)}>{inner}</div>"))
        if kind == "talk":
            def one() -> str:
                body = pick((f"<p>{say(3, 60)}</p>", f"<b>{word()}</b>: {say(3, 40)}", f"<p>{word()} {r.randint(1, 9)} h</p><p>{say(5, 60)}</p><p>{say(5, 50)}</p>", f"<cite>{word()}</cite><blockquote>{say(4, 30)}</blockquote><p>{say(4, 30)}</p>", say(4, 40)))
                return pick((f"<div{attr('talk', 0.6)}>{body}</div>", f"<li{attr('talk', 0.5)}>{body}</li>", f"<article{attr('talk', 0.7)}>{body}</article>", body))
            inner = pick(("", f"<h2>{say(1, 3)}</h2>", f"<h3>{r.randint(1, 50)} {word()}</h3>")) + "".join(one() for _ in range(r.randint(1, 6))) + (chrome("form") if r.random() < 0.3 else "")
            return pick((f"<section{attr('talk', 1.0)}>{inner}</section>", f"<div{attr('talk', 1.0)}>{inner}</div>", f"<ol{attr('talk', 1.0)}>{inner}</ol>", f'<div id="comments">{inner}</div>', f'<section class="comments">{inner}</section>', f"<aside{attr('talk', 1.0)}>{inner}</aside>"))
        return f"<div{attr('share', 1.0)}>{link_list(2, 5)}</div>"

    def content() -> str:
        out = []
        if r.random() < 0.85:
            h = f"<h1>{marked(say(*pick(((1, 3), (2, 12)))))}</h1>"
            if r.random() < 0.2:
                h = f"<header{attr('head', 0.2)}>{h}{f'<p>{marked(say(4, 20))}</p>' if r.random() < 0.4 else ''}</header>"
            out.append(h)
        short = r.random() < 0.2
        for _ in range(r.randint(1, 2) if short else r.randint(1, 9)):
            u = r.random() * (0.62 if short else 1)
            p = marked(rich(1, 12)) if short else marked(rich(*pick(((8, 60), (8, 60), (1, 6), (30, 150), (2, 20)))))
            if u < 0.62:
                out.append(f"<p{attr('main', 0.08)}>{p}" + ("</p>" if r.random() < 0.9 else ""))
            elif u < 0.69:
                out.append(f"<h{pick('23')}>{marked(say(1, 7))}</h{'2'}>".replace("<h3", "<h2"))
            elif u < 0.82:
                kind, (few, many) = pick(("ul", "ul", "ol")), pick(((1, 4), (2, 8), (2, 20)))
                out.append(f"<{kind}>" + "".join(f"<li>{marked(rich(few, many))}" + pick(("</li>", "</li>", "")) for _ in range(r.randint(2, 6))) + f"</{kind}>")
            elif u < 0.86:
                out.append(f"<blockquote>{pick((p, f'<p>{p}</p>'))}</blockquote>")
            elif u < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{marked(say(1, 4))}<td>{marked(say(1, 5))}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif u < 0.93:
                out.append(f"<figure><img src='a.png'><figcaption>{marked(say(3, 14))}</figcaption></figure>")
            elif u < 0.96:
                out.append(f"<div>{p}</div>")
            else:
                out.append(f"<pre>{marked(say(3, 20))}</pre>")
            if r.random() < 0.1:
                out.append(chrome(pick(("ad", "share", "side", "form", "notice"))))
        inner = pick(("", "\n")).join(out)
        return pick((
            f"<article{attr('main', 0.3)}>{inner}</article>", f"<article>{inner}</article>", f"<main{attr('main', 0.3)}>{inner}</main>", f"<main><article>{inner}</article></main>",
            f"<div{attr('main', 0.9)}>{inner}</div>", f"<div{attr('main', 0.9)}>{inner}</div>", f"<div>{inner}</div>", f"<section{attr('main', 0.5)}>{inner}</section>", f'<div role="main">{inner}</div>', inner,
        ))

    pages = []
    for _ in range(count):
        before = [chrome(k) for k in ("head", "menu", "notice", "ad", "form", "side") if r.random() < 0.4]
        after = [chrome(k) for k in ("talk", "side", "share", "ad", "form", "menu", "notice") if r.random() < 0.35]
        if r.random() < 0.75:
            after.append(chrome("foot"))
        r.shuffle(before)
        bare = r.random()
        body = [*before, content(), *after] if bare > 0.08 else [content()] if bare > 0.04 else [marked(rich(*pick(((3, 10), (8, 80)))))]
        if r.random() < 0.3:
            cut = r.randint(0, len(before))
            body = [*body[:cut], f"<div{attr('main', 0.4)}>", *body[cut:], "</div>"]
        if r.random() < 0.2:
            body = [f"<div{pick((' id=page', ' class=wrapper', ' class=container', ''))}>", *body, "</div>"]
        if r.random() < 0.5:
            body.insert(r.randint(0, len(body)), f'<script>var t="</p>";f({r.randint(0, 9)});</script><!-- {word()} -->')
        pages.append(f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title><style>p{{}}</style></head><body>" + pick(("", "\n")).join(body) + pick(("</body></html>", "")))
    return pages


def examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of specimens: a node with main text below it is to be kept."""
    xs, ys = [], []
    for source in pages:
        marked = Page(source)
        keep = [False] * len(marked.tag)
        for node, text, _ in marked.flow:
            if text and MARK in text:
                keep[node] = True
        for i in range(len(keep) - 1, 0, -1):
            if keep[i]:
                keep[marked.parent[i]] = True
        x = Page(source.replace(MARK, "")).features()
        some = x[:, FEATURES.index("chars")] > 0
        some[0] = False
        xs.append(x[some])
        ys.append(np.array(keep)[some])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.lru_cache(maxsize=2)
def trained(count: int = 2000, seed: int = 7) -> Trees:
    return Trees(*examples(specimens(count, seed)))


def extract_texts(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    xs = [p.features() for p in pages if p]
    odds = trees.odds(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append(p.text(p.kept(odds[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text in place of the html."""
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(trained())
    rest = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    at = pages.columns.index(html_col)

    def run(batches):
        trees = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = extract_texts(part.column(at).to_pylist(), trees)
                cols = {f.name: part.column(j) for j, f in enumerate(b.schema) if f.name not in (html_col, text_col)}
                yield pa.record_batch(cols | {text_col: pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())})

    return pages.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField(text_col, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: main text of every page."""
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
