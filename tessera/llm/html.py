"""Main text of web pages by tag-path ratios.

Each block of text hangs on a root-to-leaf path of tags and their classes. For each path of a page, text length,
punctuation and link text per block are aggregated, smoothed along the page, fused and held against a threshold: blocks of
paths that pass are content, and so are unlinked blocks among them under the same holder, such as headings, short
paragraphs and list items. Elements that are boilerplate by their kind (menus, forms, scripts) have no part in this.
A class, id or role that names boilerplate is evidence, not proof: it counts by the share of its words that do, and
gives way where the element holds what there is to read on the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import words as W

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PAIR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAYBE = re.compile(r"hidden|display", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "annotation", "annotation-xml", "object"))
#: Elements of formulas, which run on in the text around them.
FORMULA = frozenset("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd menclose".split())
INLINE = FORMULA | frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that are never article text, and words of class, id or role that mark such elements.
BOILERPLATE = frozenset(("nav", "footer", "aside", "form", "button", "select", "option", "head", "menu", "dialog", "header", "label", "fieldset", "audio", "video", "canvas", "map"))
COMMENTS = frozenset("comment comments commentlist commenter replies reply respond discussion disqus feedback".split())
MARKS = COMMENTS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager search complementary contentinfo navigation toolbar skip".split())
#: Words among these that are also what a section of an article may be about.
TOPICS = frozenset("discussion search related navigation menu notice notices sharing share social widget header toolbar alert login".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_CONTAINER = frozenset("html body div section article main center table tbody tr td".split()) | {""}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _hidden(attributes: str) -> bool:
    """Whether there is an attribute hidden, or a style that takes the element off the page."""
    if not _MAYBE.search(attributes):
        return False
    for name, *value in _PAIR.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "style" and _UNSEEN.search("".join(value))):
            return True
    return False


def _topic(tag: str, attributes: str) -> bool:
    """Whether all that speaks against a section is one word in its id that may as well be what it is about."""
    ids = ["".join(value).lower() for name, *value in _PAIR.findall(attributes) if name.lower() == "id"]
    others = ["".join(value).lower() for name, *value in _PAIR.findall(attributes) if name.lower() in ("class", "role", "aria-label")]
    return tag in ("section", "div") and len(ids) == 1 and ids[0] in TOPICS and not any(w in MARKS for o in others for w in re.split(r"[^a-z]+", o))


def _kind(tag: str, attributes: str) -> tuple[bool, float, str]:
    """Whether the element is boilerplate by its kind; how far its names say so: the share of a name's words that do (2 for comments), most of all names; and its names without digits."""
    if tag in BOILERPLATE or (attributes and _hidden(attributes)):
        return True, 0.0, ""
    if not attributes:
        return False, 0.0, ""
    most, names = 0.0, []
    for found in _ATTR.findall(attributes):
        for name in "".join(found).split():
            words = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
            names.append("-".join(words))
            if words and tag not in ("html", "body"):
                hits = sum(x in MARKS for x in words)
                most = max(most, 2.0 if 2 * sum(x in COMMENTS for x in words) >= len(words) else hits / len(words))
    return False, most, " ".join(names)


class Page:
    """Blocks of a page: text, element, share of link text; and elements: parent, path, whether they are boilerplate, and how far their own names say so."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.out, self.mark, self.topic = [-1], [""], [0], [False], [0.0], [False]
        self.paths: dict[tuple[int, str, str], int] = {}
        self.blocks: list[tuple[str, int, int]] = []  # text, element, characters in links
        self._stack, self._links, self._buffer, self._linked = [0], 0, [], 0
        lower, at, end = None, 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                self._close(name)
            elif name == "noscript" and self.tag[self._stack[-1]] == "p":
                continue  # a part of the sentence for whom the page is read without scripts
            elif name in RAW:
                if not attributes.endswith("/") or name != "svg":
                    lower = lower or source.lower()
                    stop = lower.find(f"</{name}", at) if len(lower) == end else -1
                    if stop < 0 and len(lower) != end:  # lower case changed the length
                        found = re.compile(f"</{name}", re.I).search(source, at)
                        stop = found.start() if found else -1
                    at = end if stop < 0 else stop
                    if name not in ("svg", "annotation", "annotation-xml", "noscript", "object"):
                        self._flush() if name in ("textarea", "iframe") else None
            else:
                self._open(name, attributes)
        self._flush()

    def _text(self, text: str) -> None:
        self._buffer.append(text)
        if self._links:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            if text:
                self.blocks.append((text, self._stack[-1], self._linked))
            self._buffer, self._linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name in INLINE and (name == "a" or not attributes or not any(_kind(name, attributes)[:2])):
            self._links += name == "a"
            return
        self._flush()
        if name == "br" or name in VOID:
            return
        if name in _CLOSES_P:
            self._pop("p", ("p",), _CLOSES_P - {"p"})
        if name in _SAME:
            self._pop(name, _SAME[name], _HOLDS[name])
        top = self._stack[-1]
        out, mark, names = _kind(name, attributes)
        self._stack.append(len(self.parent))
        self.parent.append(top)
        self.tag.append(name)
        self.path.append(self.paths.setdefault((self.path[top], name, names), len(self.paths) + 1))
        self.out.append(self.out[top] or (out and not (name == "header" and self._in_article())))
        self.mark.append(mark)
        self.topic.append(bool(mark) and _topic(name, attributes))
        self._links = 0

    def _in_article(self) -> bool:
        return any(self.tag[e] in ARTICLE for e in self._stack)

    def _pop(self, name: str, same: tuple, barrier) -> None:
        """Ends an open element that the new one implies the end of."""
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in same:
                del self._stack[k:]
                return
            if tag in barrier:
                return

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = 0
        if name in INLINE and self.tag[self._stack[-1]] != name:
            return
        if name in RAW:
            return
        self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag == name:
                del self._stack[k:]
                self._links = 0
                return
            if tag in ARTICLE and name not in ("body", "html"):
                return

    def _scores(self, blocks: list[tuple[str, int, int]], smooth: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether each block's path passes, and whether it is mostly links."""
        path = np.array([self.path[b[1]] for b in blocks])
        size = np.array([len(b[0]) for b in blocks], float)
        points = np.array([len(_PUNCTUATION.findall(b[0])) for b in blocks], float)
        links = np.array([min(b[2], len(b[0])) for b in blocks], float)
        _, which = np.unique(path, return_inverse=True)
        count = np.bincount(which)
        text, marks, linked = (np.bincount(which, x) for x in (size, points, links))
        fused = ((text - linked) / count * np.log1p(marks / count))[which]
        padded = np.pad(fused, smooth, mode="edge")
        fused = np.convolve(padded, np.ones(2 * smooth + 1) / (2 * smooth + 1), "valid")
        dense = links > 0.5 * size
        return (fused >= cut * fused.std()) & (fused > 0) & ~dense, dense

    def main_text(self, smooth: int = 1, cut: float = 0.25) -> str:
        blocks = [b for b in self.blocks if not self.out[b[1]]]
        if not blocks:
            return ""
        passed, dense = self._scores(blocks, smooth, cut)
        size = np.array([len(b[0]) for b in blocks], float)
        suspect = self._suspects(blocks, np.where(passed, size, 0))
        live = [k for k, b in enumerate(blocks) if not suspect[b[1]]]
        if not live:
            return ""
        blocks, passed, dense, size = [blocks[k] for k in live], passed[live], dense[live], size[live]
        weight = self._weights(blocks, np.where(passed, size, 0))
        if not weight[0]:
            passed = ~dense
            weight = self._weights(blocks, np.where(passed, size, 0))
        root, sure = self._holder(weight, suspect)
        inside = self._inside(root)
        if sure:  # articles side by side, alike in their names
            for e in range(1, len(weight)):
                if e != root and weight[e] > 0 and self.path[e] == self.path[root] and self.parent[e] == self.parent[root] and not suspect[e]:
                    inside |= self._inside(e)
        mine = np.array([inside[b[1]] for b in blocks])
        chosen = mine & (~dense | self._between(mine & ~dense & passed))
        for k in range(1, len(blocks)):  # a last sentence that is all link
            here, before = blocks[k], blocks[k - 1]
            if mine[k] and not chosen[k] and chosen[k - 1] and self.tag[here[1]] == self.tag[before[1]] == "p" and self.parent[here[1]] == self.parent[before[1]] and here[0][-1] in ".!?\u2026":
                chosen[k] = True
        if not sure:  # a heading or lead beside the holder
            chosen |= passed
            first = int(np.argmax(chosen)) if chosen.any() else 0
            while first and self.tag[blocks[first - 1][1]] in ("h1", "h2") and not dense[first - 1]:
                first -= 1
                chosen[first] = True
        return " ".join(b[0] for b, ok in zip(blocks, chosen, strict=True) if ok)

    @staticmethod
    def _between(known: np.ndarray) -> np.ndarray:
        """Whether known blocks stand on either side."""
        at = np.cumsum(known)
        return (at > 0) & (at < at[-1]) if len(at) else known

    def _weights(self, blocks: list[tuple[str, int, int]], sizes: np.ndarray) -> np.ndarray:
        """Of each element, the sizes of the blocks within."""
        weight = np.zeros(len(self.parent))
        for b, s in zip(blocks, sizes, strict=True):
            weight[b[1]] += s
        for e in range(len(weight) - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
        return weight

    def _inside(self, root: int) -> np.ndarray:
        inside = np.zeros(len(self.parent), bool)
        inside[root] = True
        for e in range(root + 1, len(inside)):
            inside[e] = inside[self.parent[e]]
        return inside

    def _suspects(self, blocks: list[tuple[str, int, int]], sizes: np.ndarray) -> np.ndarray:
        """Elements whose names are believed. A name gives way if beside the element there is next to nothing that passes (twenty times less; nothing at all if all its words name boilerplate), or, if no more than half of its words do, if the element stands among an article's blocks and passes like them. So does a section of an article whose id may be what it is about, if it has a heading and then prose that passes."""
        weight = self._weights(blocks, sizes)
        plain = self._weights(blocks, np.array([len(b[0]) for b in blocks], float))
        titled = self._titled_prose(blocks)
        suspect = np.zeros(len(self.parent), bool)
        article = [False] * len(self.parent)
        for e in range(1, len(self.parent)):
            up = self.parent[e]
            suspect[e], article[e] = suspect[up], article[up] or self.tag[e] in ARTICLE
            if self.mark[e] and not suspect[e]:
                rest = weight[0] - weight[e]
                holds = weight[e] > 0 and (rest * 20 <= weight[e] if self.mark[e] < 1 else rest == 0)
                among = self.mark[e] <= 0.5 and article[up] and weight[e] > 0.5 * plain[e] and weight[e] < 0.5 * weight[0]
                about = titled[e] and article[up] and weight[e] > 0.5 * plain[e]
                suspect[e] = not holds and not among and not about
        return suspect

    def _titled_prose(self, blocks: list[tuple[str, int, int]]) -> list[bool]:
        """Of sections whose id may be their topic: whether a heading comes first, and then paragraphs, with nothing in them that names boilerplate."""
        if not any(self.topic):
            return self.topic
        first: dict[int, str] = {}
        for _, e, _ in blocks:
            up = e
            while up > 0:
                if self.topic[up]:
                    first.setdefault(up, self.tag[e])
                up = self.parent[up]
        out = [first.get(e) in HEADINGS for e in range(len(self.parent))]
        for e in range(1, len(self.parent)):
            up = self.parent[e]
            while up > 0:
                if self.topic[up] and (self.mark[e] or self.tag[e] == "li"):
                    out[up] = False
                up = self.parent[up]
        return out

    def _holder(self, weight: np.ndarray, suspect: np.ndarray, share: float = 0.9) -> tuple[int, bool]:
        """The element of the article, and whether it is one by its tag: an article or main element with most of the weight (or with a heading of the first order and some), or else the deepest container with nearly all."""
        least = 0.5 * weight[0]
        titled = np.zeros(len(weight), bool)
        for e in range(len(weight) - 1, 0, -1):
            titled[e] |= self.tag[e] == "h1"
            titled[self.parent[e]] |= titled[e]
        marked = [e for e in range(len(weight)) if self.tag[e] in ARTICLE and not self.out[e] and not suspect[e] and weight[e] > 0]
        fit = [e for e in marked if weight[e] >= least or (titled[e] and weight[e] >= 0.15 * weight[0])]
        if fit:
            best = [e for e in fit if self.tag[e] == "article"] or fit
            return max(best, key=lambda e: (titled[e], weight[e], -e)), True
        at = 0
        for e in range(1, len(weight)):
            if self.parent[e] == at and self.tag[e] in _CONTAINER and weight[e] >= share * weight[0] > 0:
                at = e
        return at, False


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. A null or empty page, and one without text, has the empty text. Repeated rows each appear; an empty table gives no rows; other columns are ignored."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "html"):
            texts = [Page(b.decode("utf-8", "replace")).main_text() for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
