"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser walks the page once and yields its leaf blocks: runs of text without a block element's
border inside, each with the tags, class and id words of all elements around it. The field scores each
block as main text or not from these and from text features, and adjacent labels jointly; Viterbi gives
the best labelling of a page.

The field is trained on labelled pages from a seeded generator: articles in many kinds of containers
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Training is bounded
and repeatable, and needs no table.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

#: HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TELLING = frozenset("article aside footer form header main nav".split())
#: Elements whose text isn't shown on a page, or is part of a control.
SILENT = frozenset("head noscript template select button svg math iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: A start tag of the key closes open elements of the value, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body div article section".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What matters on the way to the end of a tag: its end, and quotes that hold a value.
STOP = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]++))?(?=[\s/]|\Z)""", re.I)
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Different (parent, element) pairs whose features a parser remembers, and the longest tag among them.
KEPT_PATHS, KEPT_TAG = 20_000, 300

STRUCTURE = SCOPES.union(*CLOSES.values())


class Node:
    """An open element with the features of all elements around it.

    ``block`` and ``near`` are the nearest block element and the nearest one that list items or cells may
    close or end at, each the element itself or one around it.
    """

    __slots__ = ("tag", "features", "silent", "link", "depth", "around", "block", "near")

    def __init__(self, tag: str, features: frozenset, silent: bool, link: bool, around: Node | None):
        self.tag, self.features, self.silent, self.link, self.around = tag, features, silent, link, around
        self.depth = around.depth + 1 if around else 0
        self.block = self if around is None or tag in BLOCKS else around.block
        self.near = self if around is None or tag in STRUCTURE else around.near


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``; -1 if the page ends before.

    A quote that no other of its kind (``last``: their last places) follows holds no value.
    """
    while m := STOP.search(page, at):
        quote = m.group(1)
        if quote is None:
            return m.start()
        at = page.index(quote, m.end()) + 1 if m.end() <= last[quote] else m.end()
    return -1


class Parser:
    """``known``: the features that count, if not all do; others aren't kept, however many a page invents."""

    def __init__(self, known: frozenset | None = None):
        self.known = known
        self.kept: dict[tuple, tuple] = {}

    def features_of(self, parent: Node, tag: str, attributes: str) -> tuple[frozenset, bool]:
        key = (parent.features, tag, attributes) if len(tag) + len(attributes) <= KEPT_TAG else None
        found = self.kept.get(key)
        if found is None:
            own, silent = {f"in:{tag}"}, False
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and INVISIBLE.search(value)):
                    silent = True
                elif name != "style":
                    own |= {f"name:{w.lower()}" for w in NAME_WORDS.findall(value)}
            # The nearest element that says what it holds counts beside all elements around.
            near = {f"near:{f.partition(':')[2]}" for f in own if f[:5] == "name:" or tag in TELLING}
            around = frozenset(f for f in parent.features if f[:5] != "near:") if near else parent.features
            if self.known is not None:
                own, near = own & self.known, near & self.known
            found = around | own | near, silent
            if key:
                if len(self.kept) >= KEPT_PATHS:
                    self.kept.clear()
                self.kept[key] = found
        return found

    def blocks(self, page: str) -> list[tuple[str, str, frozenset, float]]:
        """``(text, tag, features of the elements around, share of characters in links)`` in page order.

        One pass in linear time: no part of the page is scanned twice, whatever is left open. A tag
        without an end is markup up to the end of the page, as browsers have it.
        """
        out, stack, opened = [], [Node("", frozenset(), False, False, None)], Counter()
        text, linked, where, at, size = [], 0, None, 0, len(page)
        last = {quote: page.rfind(quote) for quote in "\"'"}

        def flush():
            nonlocal text, linked, where
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    out.append((joined, where.tag, where.features, min(1.0, linked / len(joined))))
                text, linked, where = [], 0, None

        def close(depth: int):
            """Take elements from the stack down to ``depth``."""
            while len(stack) > depth:
                opened[stack.pop().tag] -= 1

        while at < size:
            m = None
            if page[at] == "<":
                m = NAME.match(page, at)
                if m is None and page[at + 1 : at + 2] in ("!", "?", "/"):
                    comment = page.startswith("<!--", at)
                    end = page.find("-->", at + 4) if comment else page.find(">", at)
                    at = size if end < 0 else end + (3 if comment else 1)
                    continue
            if m is None:
                end = page.find("<", at + 1)
                end = size if end < 0 else end
                top = stack[-1]
                if not top.silent:
                    token = page[at:end]
                    plain = entities.unescape(token) if "&" in token else token
                    text.append(plain)
                    if where is None and not plain.isspace():
                        where = top.block
                    if top.link:
                        linked += len(plain)
                at = end
                continue
            end = tag_end(page, m.end(), last)
            if end < 0:
                break
            shuts, tag, attributes = page[at + 1] == "/", m.group(1).lower(), page[m.end() : end]
            at = end + 1
            if shuts:
                if opened[tag] > 0:
                    if tag in BLOCKS:
                        flush()
                    while stack[-1].tag != tag:
                        close(len(stack) - 1)
                    close(len(stack) - 1)
                continue
            if tag in RAW:
                ending = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = ending.start() if ending else size
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                if any(n.tag == "p" for n in stack[-12:]):
                    while stack[-1].tag != "p" and stack[-1].tag not in BLOCKS:
                        close(len(stack) - 1)
                    if stack[-1].tag == "p":
                        close(len(stack) - 1)
                if shut := CLOSES.get(tag):
                    found = stack[-1].near
                    while found.around and found.tag not in shut and found.tag not in SCOPES:
                        found = found.around.near
                    if found.tag in shut:
                        close(found.depth)
            if tag in VOID:
                continue
            features, hidden = self.features_of(stack[-1], tag, attributes)
            if not attributes.endswith("/") or tag in BLOCKS:
                opened[tag] += 1
                stack.append(Node(tag, features, hidden or stack[-1].silent or tag in SILENT, stack[-1].link or tag == "a", stack[-1]))
        flush()
        return out


def text_features(text: str, tag: str, links: float, place: float) -> tuple[str, ...]:
    words = text.count(" ") + 1
    return (
        f"tag:{tag}",
        f"words:{min(6, words.bit_length())}",
        f"links:{int(links * 4)}",
        f"end:{text[-1] if text[-1] in '.!?:,;' else 'letter' if text[-1].isalpha() else 'other'}",
        f"place:{int(place * 5)}",
        "mark" if any(c in text for c in "©®|»«") else "no mark",
    )


class Field:
    """Two labels; one weight per feature (for main text), start and transition scores."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.bias = 0.0
        self.sums: dict[frozenset, float] = {}

    def block_features(self, blocks: list) -> list[list[str]]:
        n = max(1, len(blocks) - 1)
        return [[*around, *text_features(text, tag, links, k / n)] for k, (text, tag, around, links) in enumerate(blocks)]

    def scores(self, blocks: list) -> list[float]:
        get, n, out = self.weights.get, max(1, len(blocks) - 1), []
        for k, (text, tag, around, links) in enumerate(blocks):
            base = self.sums.get(around)
            if base is None:
                if len(self.sums) >= KEPT_PATHS:
                    self.sums.clear()
                base = self.sums[around] = self.bias + sum(get(f, 0.0) for f in around)
            out.append(base + sum(get(f, 0.0) for f in text_features(text, tag, links, k / n)))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (a00, a01), (a10, a11) = self.moves.tolist()
        no, yes, back = float(self.start[0]), float(self.start[1]) + scores[0], []
        for s in scores[1:]:
            back.append((no < a10 - a00 + yes, yes >= no + a01 - a11))
            no, yes = max(no + a00, yes + a10), max(no + a01, yes + a11) + s
        label = int(yes > no)
        labels = [label]
        for from_no, from_yes in reversed(back):
            label = int(from_yes if label else from_no)
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list, list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> None:
        """Stochastic ascent of the conditional likelihood (AdaGrad), by forward and backward sums."""
        rng, seen = random.Random(seed), {}
        data = [(self.block_features(blocks), labels) for blocks, labels in pages if blocks]
        sq_moves, sq_start, sq_bias = np.full((2, 2), 1e-6), np.full(2, 1e-6), 1e-6
        for _ in range(epochs):
            rng.shuffle(data)
            for features, labels in data:
                n = len(labels)
                s = np.array([[0.0, self.bias + sum(self.weights.get(f, 0.0) for f in fs)] for fs in features])
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = self.start + s[0]
                for k in range(1, n):
                    fwd[k] = np.logaddexp(fwd[k - 1, 0] + self.moves[0], fwd[k - 1, 1] + self.moves[1]) + s[k]
                for k in range(n - 2, -1, -1):
                    step = self.moves + s[k + 1] + bwd[k + 1]
                    bwd[k] = np.logaddexp(step[:, 0], step[:, 1])
                total = np.logaddexp(*fwd[-1])
                p = np.exp(fwd + bwd - total)
                y = np.eye(2)[labels]
                g_moves = np.zeros((2, 2))
                if n > 1:
                    pair = np.exp(fwd[:-1, :, None] + self.moves + (s[1:] + bwd[1:])[:, None, :] - total)
                    g_moves = y[:-1].T @ y[1:] - pair.sum(0)
                gap = y[:, 1] - p[:, 1]
                sq_moves += g_moves**2
                self.moves += rate * g_moves / np.sqrt(sq_moves)
                g = y[0] - p[0]
                sq_start += g**2
                self.start += rate * g / np.sqrt(sq_start)
                sq_bias += gap.sum() ** 2
                self.bias += rate * gap.sum() / sq_bias**0.5
                grads: dict[str, float] = {}
                for fs, d in zip(features, gap.tolist()):
                    for f in fs:
                        grads[f] = grads.get(f, 0.0) + d
                for f, d in grads.items():
                    d -= decay * self.weights.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-6) + d * d
                    self.weights[f] = self.weights.get(f, 0.0) + rate * d / seen[f] ** 0.5
        self.sums.clear()


#: Usual names of containers on web pages, by what they hold.
NAMES = {
    "main": "content article post entry story body main text page-content post-content entry-content article-body story-body post-body main-content articleBody",
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu tabs pagination pager toc skip",
    "header": "header masthead site-header top topbar branding logo site-title page-header",
    "footer": "footer site-footer bottom copyright legal colophon page-footer credits",
    "sidebar": "sidebar side aside widget widgets rail related related-posts right-column recommended more-stories popular trending tags",
    "notice": "notice cookie cookies cookie-banner consent gdpr alert message banner-notice privacy-notice popup modal overlay",
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner ad-slot ad-container dfp teaser",
    "form": "form login signup search search-form newsletter subscribe subscription contact register",
    "comments": "comments comment comment-list discussion replies reply responses respond disqus user-comments reader-comments feedback thread",
    "share": "share social social-links sharing follow buttons toolbar",
}


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """``(html, texts of the main blocks)`` of made-up pages."""
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "ti", "es", "or", "ou", "ing", "ion", "é", "ch", "en", "la", "de", "ß", "ó"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))

    def sentence(a: int = 1, b: int = 18) -> str:
        words = [word() for _ in range(rng.randint(a, b))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", ".", "!", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))

    def named(kind: str) -> str:
        names = NAMES[kind].split()
        name = rng.choice(names)
        form = rng.random()
        name = name if form < 0.7 else f"{rng.choice(['site', 'x', 'js', 'c', 'block', 'wrap'])}-{name}" if form < 0.85 else f"{name}__{rng.choice(['inner', 'box', 'wrapper', 'item'])}"
        return f'{rng.choice(["class", "class", "id"])}="{name}"'

    links = lambda k: "".join(f'<li><a href="/{word()}">{sentence(1, 3)}</a></li>' for _ in range(k))

    def noise(kind: str) -> str:
        own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        tag, name = (own, "" if rng.random() < 0.5 else " " + named(kind)) if own and rng.random() < 0.55 else (rng.choice(["div", "div", "section", "ul"] if kind != "form" else ["div", "section"]), " " + named(kind))
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>" if tag != "ul" else links(rng.randint(2, 8))
        elif kind in ("header", "notice", "advert", "share"):
            inner = "".join(rng.choice([f"<p>{sentence()}</p>", f"<span>{sentence()}</span>", f'<a href="#">{sentence(1, 4)}</a>', paragraph(), f"<h2>{sentence(1, 5)}</h2>"]) for _ in range(rng.randint(1, 3)))
        elif kind == "footer":
            inner = rng.choice(["&copy; " + word() + ".example.com &middot; " + sentence(), f"<p>{sentence()}</p><p>&copy; {rng.randint(1999, 2030)} {word()}</p>", f"<ul>{links(4)}</ul>", paragraph()])
        elif kind == "sidebar":
            inner = f"<h3>{sentence(1, 4)}</h3>" + rng.choice([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{paragraph()}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>"])
        elif kind == "form":
            inner = f"<label>{sentence(1, 3)}</label><input name=q><p>{sentence()}</p><button>{word()}</button>"
        else:
            inner = f"<h3>{sentence(1, 3)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><b>{word()}</b><p>{paragraph()}</p></div>' for _ in range(rng.randint(1, 5)))
        return f"<{tag}{name}>{inner}</{tag}>"

    def article() -> tuple[str, list[str]]:
        out, main = [], []

        def keep(form: str, text: str):
            out.append(form.format(text))
            main.append(text)

        if rng.random() < 0.8:
            keep("<h1>{}</h1>", sentence(2, 10))
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.66:
                keep(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"]), paragraph())
            elif kind < 0.74:
                keep("<h2>{}</h2>", sentence(1, 6))
            elif kind < 0.8:
                out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    keep("<li>{}</li>", sentence())
                out.append("</ul>")
            elif kind < 0.85:
                keep(rng.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figure><img src=x><figcaption>{}</figcaption></figure>"]), paragraph())
            elif kind < 0.9:
                out.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    keep("<td>{}</td>", sentence(1, 4))
                out.append("</tr></table>")
            else:
                out.append(noise(rng.choice(["advert", "share", "sidebar", "form", "notice", "menu"])))
        if rng.random() < 0.2:
            out.append(noise("comments"))
        tag, name = rng.choice([("article", ""), ("article", " " + named("main")), ("main", ""), ("div", " " + named("main")), ("section", " " + named("main")), ("div", "")])
        return f"<{tag}{name}>{''.join(out)}</{tag}>", main

    pages = []
    for _ in range(n):
        text, main = article()
        before = [noise(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.45]
        after = [noise(k) for k in ("comments", "sidebar", "advert", "share", "form", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        if rng.random() < 0.2:
            text = f'<div class="{rng.choice(["wrapper", "container", "row", "layout", "page"])}">{"".join(before)}{text}{"".join(after)}</div>'
            before = after = []
        pages.append((f"<html><head><title>{sentence()}</title></head><body>{''.join(before)}{text}{''.join(after)}</body></html>", main))
    return pages


def labelled_blocks(pages: list[tuple[str, list[str]]]) -> list[tuple[list, list[int]]]:
    """Blocks of pages with labels: main blocks are matched in page order."""
    parser, out = Parser(), []
    for page, main in pages:
        blocks, left, labels = parser.blocks(page), [" ".join(t.split()) for t in main], []
        for text, *_ in blocks:
            hit = bool(left) and text == left[0]
            labels.append(int(hit))
            if hit:
                left.pop(0)
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 700) -> Field:
    """The field, trained on ``n`` labelled pages."""
    field = Field()
    field.fit(labelled_blocks(labelled_pages(n, seed=1)))
    return field


def main_text(page: str, field: Field, parser: Parser | None = None) -> str:
    blocks = (parser or Parser(frozenset(field.weights))).blocks(page)
    return "\n".join(b[0] for b, label in zip(blocks, field.viterbi(field.scores(blocks))) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row of ``pages``.

    Null and empty pages and pages without main text give an empty text; broken markup is read as far as
    it goes, in time linear in the page; an unfinished tag ends the page; nothing is cut, however long; repeated rows stay; other columns are not read.
    """

    def run(page_ids, urls, pages, field):
        parser = Parser(frozenset(field.weights))
        texts = [main_text(p, field, parser) for p in pages]
        return {"page_id": page_ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return map_batches(pages.select("page_id", "url", html), run, "page_id long,url string,text string,n_chars long", field or trained())
