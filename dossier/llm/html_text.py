r"""Main text of web pages by tree scoring.

A page's tags become a tree and its text blocks (runs of text between block-level tags). Each block of 25 characters or
more outside boilerplate passes points (one, one for each comma, one for each 100 characters up to three) to its
container, half to the next ancestor and less further up; a container's points are discounted by the share of its text
that is in links. The best container is taken with those siblings that score well or read like prose, or, where it lies in
an article or main element, that element. Of it, all blocks but boilerplate are kept, whatever their length.

Boilerplate are menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader
comments. Tags, roles and hidden styles are sure signs; the words of class and id are doubts, and names like has-sidebar,
no-ads or comments-open, which say how a page is laid out, are none. An element with a word of VAGUE alone is no boilerplate if
it holds more than half of the page's text outside links, or, with one of LINKY, if it reads like prose. One that is named like
boilerplate (WORDS) is the article if it has prose and the rest of the page hardly any, or, unless named like adverts or
comments, eight times less; then what lies within it is looked at in the same way. Inside a paragraph, boilerplate is left out
and the paragraph goes on.

Defined results: a null, empty or text-free page has an empty text; broken and cut-off markup is read as far as it goes
(after a tag whose quotes are never closed, quotes in tags mean nothing); time grows in proportion to the page; repeated
rows are extracted one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names of the HTML standard, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
DROPPED = set(
    "script style noscript template iframe object embed svg canvas nav footer aside form button select textarea input "
    "dialog menu head title audio video map datalist".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center details div fieldset html main section table tbody td tr ul ol dl".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag that ends an open element of these names, down to the nearest element of the last names.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of what an article never is, and of other boilerplate.
OTHERS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors comment comments commentlist disqus "
    "respond replies".split()
)
WORDS = OTHERS | set(
    "cookie cookies consent gdpr newsletter subscribe signup popup modal overlay sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs footer pagination pager login".split()
)
#: Words that may also be those of an article.
LINKY = set("related recommended recommendations social share sharing skip widget header foot aside reply".split())
VAGUE = LINKY | set("promo promoted promotion banner notice subscription masthead topbar toolbar hidden".split())
#: A name with one of these says how a page is laid out, not what the element is: has-sidebar, no-ads, comments-open.
MODIFIERS = set("has no not with without open opened closed enabled disabled enable disable is supports".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
QUOTE = re.compile("[>\"']")
COMMA = re.compile("[,،、，]")


KEPT, SURE, MAYBE = 0, 1, 2
#: What an element in doubt may be: boilerplate by a vague word, the same unless it reads like prose, boilerplate by its name, and
#: by one that no article has.
BY_SHARE, BY_PROSE, NAMED, NAMED_OTHER = 0, 1, 2, 3
#: Text that reads like prose has a block of so many characters; an element named like boilerplate is the article only if it
#: has prose and the rest of the page less than a block of it, or this many times less, shorter blocks (menus) not counted.
PROSE, TIMES, SHORT = 80, 8, 25


def boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[int, int]:
    """Whether an element is boilerplate by its tag, role or style (SURE) or may be one by its class and id (MAYBE), and how
    that doubt is settled."""
    if tag in DROPPED or tag == "header" and not in_article:
        return SURE, 0
    if not attributes or tag in ("html", "body", "main"):
        return KEPT, 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return SURE, 0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or found.get("role") in ROLES:
        return SURE, 0
    words = set()
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        own = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if MODIFIERS.isdisjoint(own):
            words |= own
    if not WORDS.isdisjoint(words):
        return MAYBE, NAMED if OTHERS.isdisjoint(words) else NAMED_OTHER
    vague = words & VAGUE
    return (MAYBE if vague else KEPT), BY_PROSE if vague and vague <= LINKY else BY_SHARE


class Page:
    """Elements (tag, parent, whether boilerplate or within) and text blocks (element, text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.in_article = ["html"], [-1], [KEPT], [False]
        self.block_of, self.doubt = [0], {}  # doubt: of elements that may be boilerplate, how that is settled
        self.aside = [False]  # of inline elements, whether they or an inline element around them are in doubt
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open_tags = [0], Counter()
        self._text, self._links = [], 0
        self._at = 0  # the element of the block's first text
        self._read(source)
        self._flush()
        self._decide()

    def _read(self, source: str):
        at, quotes, last_end, last_cdata = 0, True, source.rfind(">"), source.rfind("]]>")
        while at < len(source):
            start = source.find("<", at)
            self._add(source[at : start if start >= 0 else len(source)])
            if start < 0:
                return
            at = start + 1
            if source.startswith("!--", at):
                end = source.find("-->", at + 3)
                at = end + 3 if end >= 0 else len(source)
            elif source.startswith("![CDATA[", at) and at < last_cdata:
                end = source.find("]]>", at)
                self._add(source[at + 8 : end], False)
                at = end + 3
            elif source[at : at + 1] in ("!", "?"):
                at = source.find(">", at) + 1 if at < last_end else len(source)
            elif name := NAME.match(source, at):
                if at > last_end:  # a tag that is cut off; what looks like more of them is text
                    at = source.find("<", at)
                    if at < 0:
                        return
                    self._add(source[start:at])
                    continue
                end = self._tag_end(source, name.end()) if quotes else -1
                if end < 0:
                    quotes, end = False, source.find(">", name.end())
                tag, at = name[2].lower(), end + 1
                if name[1]:
                    self._close(tag)
                    continue
                self._open(tag, source[name.end() : end])
                if tag in RAW:
                    close = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                    at = close.start() if close else len(source)
            else:
                self._add("<")

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """The place of the `>` outside quotes, or -1 where there is none."""
        while m := QUOTE.search(source, at):
            if m[0] == ">":
                return m.start()
            at = source.find(m[0], m.end()) + 1
            if not at:
                return -1
        return -1

    def _add(self, text: str, decode: bool = True):
        top = self._stack[-1]
        if not text or self.dropped[top] == SURE:
            return
        if self.aside[top]:
            return  # inside a paragraph, a word is enough
        if not self._text:
            self._at = top
        self._text.append(html.unescape(text) if decode and "&" in text else text)
        if self._open_tags["a"]:
            self._links += len(text)

    def _flush(self):
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self.block_of[self._at], text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str):
        if tag == "br":
            self._add(" ")
        if tag in BLOCKS:
            self._flush()
        if tag in CLOSES_P and self._open_tags["p"]:
            self._end({"p"}, {"table", "td", "th", "button", "div", "article", "section"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("html", "body") and (tag == "html" or self._open_tags[tag]) or tag in VOID:
            return
        up, me = self._stack[-1], len(self.tags)
        in_article = self.in_article[up] or self.tags[up] in ("article", "main")
        own, how = boilerplate(tag, attributes, in_article)
        if own == MAYBE and tag in BLOCKS:
            self.doubt[me] = how
        self.aside.append(tag not in BLOCKS and (own == MAYBE or self.aside[up]))
        self.tags.append(tag)
        self.parents.append(up)
        self.in_article.append(in_article)
        self.dropped.append(SURE if SURE in (own, self.dropped[up]) else max(own, self.dropped[up]))
        self.block_of.append(me if tag in BLOCKS else self.block_of[up])
        if not attributes.endswith("/") or tag in BLOCKS:
            self._stack.append(me)
            self._open_tags[tag] += 1

    def _cut(self, k: int):
        for at in self._stack[k:]:
            self._open_tags[self.tags[at]] -= 1
        del self._stack[k:]

    def _end(self, names: set[str], until: set[str]):
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in names:
                return self._cut(k)
            if tag in until:
                return None

    def _close(self, tag: str):
        if tag in BLOCKS:
            self._flush()
        if not self._open_tags[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[k]] == tag:
                return self._cut(k)
            if tag not in BLOCKS and self.tags[self._stack[k]] in BLOCKS:
                return None  # a stray inline end tag doesn't end a block

    def _decide(self):
        """Keep or drop the elements in doubt, and their blocks with them; from the outermost inwards, each looked at once."""
        if not self.doubt:
            return
        near = [k if k in self.doubt else -1 for k in range(len(self.tags))]  # the nearest element in doubt around each
        inner: dict[int, list[int]] = {}
        for k in range(1, len(near)):
            around = near[self.parents[k]]
            if near[k] == k:
                inner.setdefault(around, []).append(k)
            else:
                near[k] = around
        plain, linked, prose, total = Counter(), Counter(), Counter(), 0
        alone = Counter()  # text of some length, without what lies in elements in doubt further in
        for at, text, links in self.blocks:
            own = len(text) - links
            total += own
            plain[near[at]] += own
            linked[near[at]] += links
            prose[near[at]] += own if own >= PROSE else 0
            alone[near[at]] += own if own >= SHORT else 0
        lean = {k: 2 * linked[k] <= plain[k] for k in self.doubt}
        for k in sorted(self.doubt, reverse=True):
            around = near[self.parents[k]]
            if around >= 0:
                for sums in (plain, linked, prose):
                    sums[around] += sums[k]
        kept, rest = {-1}, alone[-1]
        at = -1
        while at is not None:
            kept.add(at)
            named, todo = [], list(inner.get(at, ()))
            while todo:
                k = todo.pop()
                if self.doubt[k] >= NAMED:
                    named.append(k)
                elif plain[k] and (2 * plain[k] > total or self.doubt[k] == BY_PROSE and prose[k] and 3 * linked[k] < plain[k]):
                    kept.add(k)
                    rest += alone[k]
                    todo += inner.get(k, ())
            best = max(named, key=lambda k: (prose[k], -k), default=None)
            at = None
            if best is not None and prose[best] and lean[best]:
                if rest < PROSE or self.doubt[best] == NAMED and TIMES * rest < prose[best]:
                    at, rest = best, rest + alone[best]
        self.blocks = [b for b in self.blocks if near[b[0]] in kept]

    def lineage(self, at: int):
        while at >= 0:
            yield at
            at = self.parents[at]

    def chosen(self) -> set[int]:
        """Elements whose blocks, with those of their descendants, are the main text."""
        n = len(self.tags)
        points, length, links = [0.0] * n, [0] * n, [0] * n
        for at, text, in_links in self.blocks:
            length[at] += len(text)
            links[at] += in_links
            if len(text) >= SHORT:
                own = 1 + len(COMMA.findall(text)) + min(len(text) // 100, 3)
                up = at if self.tags[at] in CONTAINERS else self.parents[at]
                for level in range(5):
                    if up < 0:
                        break
                    points[up] += own / (1, 2, 6, 9, 12)[level]
                    up = self.parents[up]
        for at in range(n - 1, 0, -1):  # parents come before their children
            length[self.parents[at]] += length[at]
            links[self.parents[at]] += links[at]
        score = [p * (1 - k / size) if size else 0.0 for p, k, size in zip(points, links, length, strict=True)]
        best = max(range(n), key=lambda k: (score[k], -k))
        if not score[best]:
            first = [k for tag in ("article", "main", "body") for k in range(n) if self.tags[k] == tag and length[k]]
            return {first[0] if first else 0}
        for name in ("article", "main"):
            found = [k for k in self.lineage(best) if self.tags[k] == name]
            if found:
                return {found[-1]}
        out, least = {best}, max(10, 0.2 * score[best])
        for k in range(1, n):
            if self.parents[k] == self.parents[best] and k != best and length[k]:
                density = links[k] / length[k]
                prose = self.tags[k] in ("p", "blockquote", "pre", "h1", "h2", "h3")
                if score[k] >= least or prose and density < 0.25:
                    out.add(k)
        return out

    def text(self) -> str:
        chosen = self.chosen()
        inside = [False] * len(self.tags)
        for k in range(len(self.tags)):
            inside[k] = k in chosen or self.parents[k] >= 0 and inside[self.parents[k]]
        return "\n".join(text for at, text, _ in self.blocks if inside[at])


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
