"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser sends events; nothing keeps a tree. Each block of text is one line with
its text-to-tag ratio: characters outside links by tags met since the line before. The ratios are
smoothed with a Gaussian; lines above the threshold (``THRESHOLD`` standard deviations) cluster into
content regions. A region stands for the element that holds it: an article or main element, else the
nearest block container. All lines of that element are content, so that short paragraphs stay.
Elements that are never content (scripts, menus ...) are told by tag and role and send no lines at all.
Navigation, forms and elements with the class words of notices, comments and the like send lines that are
dropped at the end of the page, unless such an element proves to be a wrapper: it holds most of the text in
articles, or most of all text (navigation only if its end tag is missing), or nothing else is left. The
regions then decide on its lines. Where other words stand in the class beside the listed one, the smoothed
ratio of each line decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.shared import slices

THRESHOLD = 0.5
# HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template button select textarea iframe object svg canvas audio video dialog menu title option datalist map".split())
AROUND = frozenset("nav footer aside".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
CLOSES_P = BLOCK - {"body", "html"}
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " sidebar menu nav navbar navigation topnav subnav breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing"
    " social newsletter subscribe subscription popup modal overlay related recommended widget pagination pager toolbar login signup search"
    " copyright dfp gpt adsense taboola outbrain rail".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
# Words that say where or how an element stands, not what it holds.
PLACES = frozenset("site page main primary secondary global top bottom left right inner outer wrapper wrap container box bar block section area list links link item items module panel group row col column content text form slot unit first last".split())
STATE_FIRST = frozenset("with without has have no not is show hide enable supports".split())  # "with-sidebar" names another element
STATE_LAST = frozenset("open closed enabled disabled on off result results".split())
JOINED = PLACES | {"bar", "thread", "form"}  # what stands behind a listed word written together with it
PEOPLE = frozenset("author user username avatar commenter reply vote votes upvote likes timestamp posted".split())  # who wrote a comment, and when
COMMENT_HEAD = re.compile(r"\b(?:comments?|replies|responses|discussion)\b", re.I)
COOKIES = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|policy|settings|use|uses|using)\b|\b(?:accept|agree|consent|use|uses|using)\b.*\bcookies?\b", re.I)
COMMENT_CHARS, LONG_LINE, NOTICE_CHARS, NOTICE_LINES = 1_000, 60, 300, 3
IN_HEAD = frozenset("title style script noscript template base link meta".split())
_WORD = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def _split_word(word: str) -> str:
    """The listed word of a compound such as ``commentlist``, else the word itself."""
    for i in range(2, len(word) - 2):
        if word[:i] in SKIP_WORDS and word[i:] in JOINED:
            return word[:i]
    return word


def _named(value: str) -> tuple[set[str], set[str]]:
    """The first and last word of each class but of those that tell a state, and the classes' words that say what an element holds."""
    ends: set[str] = set()
    others: set[str] = set()
    for name in value.lower().split():
        parts = [_split_word(w) for w in _WORD.findall(name) if not w.isdigit()]
        if "discussion" in parts[:-1] and parts[-1] in ("thread", "list"):
            parts = ["comments"]
        if parts and (len(parts) == 1 or parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST):
            ends.update((parts[0], parts[-1]))
            if {parts[0], parts[-1]} & (SKIP_WORDS | HEAD_WORDS):
                others.update(w for w in parts if w not in SKIP_WORDS and w not in HEAD_WORDS and w not in PLACES)
    return ends, others


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, container number, content element number, doubtful element number) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, skipped, container, article or main, doubtful element
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.doubtful: list[tuple[int, str, int]] = [(-1, "", -1)]  # the one around it, kind, the article or main around it
        self.ended: set[int] = set()  # doubtful elements whose end tag was met
        self.parent: dict[int, int] = {0: -1}
        self.named: dict[int, str] = {0: "body"}
        self.text: list[str] = []
        self.tags = self.links = self.in_link = self.made = 0
        self.elements: list[list] = [[-1, "", False]]  # of blocks: the one around it, tag and class, whether it names a person or time
        self.within: list[int] = []  # the block of each open element
        self.line_block: list[int] = []

    def _state(self) -> tuple[str, bool, int, int, int]:
        return self.open[-1] if self.open else ("", False, 0, -1, 0)

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, self.links, *self._state()[2:]))
                self.line_block.append(self.within[-1] if self.within else 0)
                self.tags = 0
            self.text = []
            self.links = 0

    def _pop(self, to: int) -> None:
        for tag, *_ in self.open[to:]:
            self.in_link -= tag == "a"
        del self.open[to:]
        del self.within[to:]

    def _skipped(self, tag: str, attrs: list[tuple[str, str | None]], content: int) -> tuple[bool, str]:
        """Whether an element is never content, else the kind of doubt about it, if any."""
        if tag in SKIP:
            return True, ""
        if tag in ("html", "body"):
            return False, ""
        words: set[str] = set()
        others: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id"):
                ends, more = _named(v or "")
                words |= ends
                others |= more
            elif k == "role" and (v or "").lower() in SKIP_ROLES or k == "hidden":
                return True, ""
            elif k == "aria-hidden" and v == "true" or k == "style" and "display:none" in (v or "").replace(" ", "").lower():
                return True, ""
        if words & COMMENT_WORDS if tag not in ("article", "main") else words & {"comment", "comments"}:
            return False, "comment"
        if tag in ("article", "main"):
            return False, ""
        if tag in AROUND or tag == "header" and content < 0:
            return False, "tag"
        if words & SKIP_WORDS or content < 0 and words & HEAD_WORDS:
            return False, "weak" if others else "word"
        return False, "form" if tag == "form" or ("role", "form") in attrs else ""

    def _close_head(self, body: bool) -> None:
        """Ends a head whose end tag was left out; ``body`` ends what is open in it, too."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "head":
                self._pop(i)
                return
            if not body and self.open[i][0] != "title":
                return

    def _doubt(self, i: int) -> None:
        """Makes a line a reader's comment."""
        *rest, content, at = self.lines[i]
        self.doubtful.append((at, "comment", content))
        self.lines[i] = (*rest, content, len(self.doubtful) - 1)

    def find_comments(self) -> None:
        """Like elements side by side, behind a long line, each naming a person or a time: comments of readers, whatever their class."""
        alike: dict[tuple[int, str], list[int]] = {}
        for e, (around, sign, marked) in enumerate(self.elements[1:], 1):
            if marked and not sign.startswith(("article.", "main.", "section.", "body.", "html.", "tr.", "td.", "p.")):
                alike.setdefault((around, sign), []).append(e)
        groups = {e: g for g, (_, own) in enumerate(alike.items()) if len(own) > 1 for e in own}
        if not groups:
            return
        lines: dict[int, list[int]] = {}
        for i, e in enumerate(self.line_block):
            while e > 0:
                if e in groups:
                    lines.setdefault(groups[e], []).append(i)
                e = self.elements[e][0]
        for own in lines.values():
            first, chars = own[0], sum(len(self.lines[i][0]) for i in own)
            before = [x for x in self.lines[:first] if len(x[0]) - x[2] >= LONG_LINE]
            if before and chars <= COMMENT_CHARS * len(own):
                if len(self.lines[first - 1][0]) <= 40 and COMMENT_HEAD.search(self.lines[first - 1][0]):
                    own = [first - 1, *own]
                for i in own:
                    self._doubt(i)

    def find_notices(self) -> None:
        """Short lines about cookies at the begin or the end of a page, outside articles."""
        n = len(self.lines)
        for i in {*range(min(NOTICE_LINES, n)), *range(max(0, n - NOTICE_LINES), n)}:
            text, content = self.lines[i][0], self.lines[i][4]
            if content < 0 and len(text) <= NOTICE_CHARS and COOKIES.search(text):
                self._doubt(i)

    def kept(self) -> list[tuple[str, int, int, int, int, bool]]:
        """The lines outside doubtful elements or in such ones as are mere wrappers, and whether the ratio must speak for each."""
        size, inner = [0] * len(self.doubtful), [0] * len(self.doubtful)
        everything, articles, forms = 0, 0, 0
        for text, _, links, _, content, at in self.lines:
            n, kinds = max(0, len(text) - links), set()
            while at > 0:
                around, kind, outer = self.doubtful[at]
                kinds.add(kind)
                size[at] += n
                inner[at] += n * (content != outer)
                at = around
            everything += n * ("comment" not in kinds)
            articles += n * (content >= 0)
            forms += n * ("form" in kinds and "comment" not in kinds)
        keep, weak = [True], [False]
        for i, (around, kind, _) in enumerate(self.doubtful[1:], 1):
            most = 2 * (forms if kind == "form" else size[i]) > everything and kind != "comment" and not (kind == "tag" and i in self.ended)
            wrapper = most or 2 * inner[i] > articles
            keep.append(keep[around] and (wrapper or kind == "weak"))
            weak.append(weak[around] or kind == "weak" and not wrapper)
        if not any(keep[x[5]] for x in self.lines):
            keep = [kind != "tag" for _, kind, _ in self.doubtful]
            for i, (around, _, _) in enumerate(self.doubtful[1:], 1):
                keep[i] = keep[i] and keep[around]
        out, tags = [], 0
        for text, own, links, container, content, at in self.lines:
            tags += own  # those of dropped lines count with the next line
            if keep[at]:
                out.append((text, tags, links, container, content, weak[at]))
                tags = 0
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in IN_HEAD and tag != "head":
            self._close_head(tag == "body")
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK and not self._state()[1]:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self._pop(i)
                    break
                if self.open[i][0] in CONTAINER or self.open[i][0] in ("li", "table"):
                    break
        if tag in ("li", "dt", "dd", "td", "th", "tr"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, (tag,))
            while self.open and self.open[-1][0] in same:
                self._pop(len(self.open) - 1)
        _, skipped, container, content, doubt = self._state()
        kind = ""
        if not skipped:
            skipped, kind = self._skipped(tag, attrs, content)
            if kind:
                self.flush()
                self.doubtful.append((doubt, kind, content))
                doubt = len(self.doubtful) - 1
        if tag in CONTAINER and not skipped:
            self.made += 1
            self.parent[self.made], self.named[self.made] = container, tag
            container = self.made
            if tag in ("article", "main") and not kind:
                content = self.made
        self.in_link += tag == "a"
        self.open.append((tag, skipped, container, content, doubt))
        block = self.within[-1] if self.within else 0
        named = dict(attrs).get("class") or ""
        if tag in BLOCK and not skipped:
            self.elements.append([block, f"{tag}.{named}", False])
            block = len(self.elements) - 1
        self.within.append(block)
        if tag in ("time", "cite") or PEOPLE & set(_WORD.findall(named.lower())):
            while block > 0 and not self.elements[block][2]:
                self.elements[block][2] = True
                block = self.elements[block][0]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                doubt = self.open[i][4] if self.open[i][4] != (self.open[i - 1][4] if i else 0) else 0
                if doubt or tag in BLOCK and not self.open[i][1] or self._state()[4] != self.open[i][4]:
                    self.flush()
                self.ended.add(doubt)
                self._pop(i)
                return
            if tag not in BLOCK and tag not in SKIP and self.open[i][0] in BLOCK:
                return  # a stray end of an inline element

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close_head(False)
        if not self._state()[1]:
            self.text.append(data)
            if self.in_link:
                self.links += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the kernel cut at twice ``sigma`` and renormalised at the ends."""
    r = max(1, int(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    at = slice(r, r + values.size)
    return np.convolve(values, k)[at] / np.convolve(np.ones(values.size), k)[at]


def dense(sizes: list[int], tags: list[int]) -> np.ndarray:
    """Which lines are content: those of ``sizes`` characters and ``tags`` tags whose smoothed ratio reaches the threshold."""
    ratio = np.array(sizes) / np.maximum(1, np.array(tags))
    return smoothed(ratio) >= THRESHOLD * ratio.std()


def main_text(html: str | None) -> str:
    """The main text of one page; blocks in page order joined by a blank line."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    page.find_comments()
    page.find_notices()
    lines = page.kept()
    if not lines:
        return ""
    sizes = [max(0, len(x[0]) - x[2]) for x in lines]
    content, ratio = dense(sizes, [x[1] for x in lines]), np.array(sizes)
    solid = content & (ratio > 0)
    use = [i for i, x in enumerate(lines) if solid[i] or not x[5]]
    lines, ratio, solid = [lines[i] for i in use], ratio[use], solid[use]
    roots = {lines[i][4] for i in np.flatnonzero(solid).tolist()} - {-1} or {x[4] for x in lines} - {-1}
    if roots:
        return "\n\n".join(x[0] for x in lines if x[4] in roots)
    held = {lines[i][3] for i in np.flatnonzero(solid).tolist()}

    def inside(container: int, own: bool) -> bool:
        if own and container in held:
            return True
        up = page.parent[container]
        while up > 0 and page.named[up] != "body":
            if up in held:
                return True
            up = page.parent[up]
        return False

    kept = [x[0] for x, r in zip(lines, ratio.tolist()) if inside(x[3], True) and (r > 0 or page.named[x[3]] != "body")]
    return "\n\n".join(kept or [x[0] for x, r in zip(lines, ratio.tolist()) if r > 0])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (code points) of every whole page.

    Null and empty pages, and pages without main text, give an empty text. Columns named ``text`` or
    ``n_chars`` are replaced; all others, nulls and repeated rows are kept.
    """
    rest = pages.drop("text", "n_chars") if html != "text" else pages.withColumnRenamed("text", "html").drop("n_chars")
    html = html if html != "text" else "html"
    rest = rest.select(html, *[c for c in rest.columns if c != html])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                texts = [main_text(h) for h in b.column(0).to_pylist()]
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[1:], "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[1:]]
    return rest.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``; nulls, empty pages and repeated rows as ``extract`` says."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
