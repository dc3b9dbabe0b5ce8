"""Main text of web pages by two-pass block rules.

Pass one labels blocks by place, link density, length and stop-word density (where a text's language has no list here, by
its sentences); pass two lets the ambiguous short blocks inherit the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text never belongs to an article.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe svg math object canvas dialog menu audio video".split())
#: Void elements open nothing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark other parts of a page.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning popup modal overlay"
    " sidebar sidenav side aside rail widget widgets menu menubar nav navbar navigation navigate breadcrumb breadcrumbs pagination pager toolbar tabs skip skiplink"
    " header masthead topbar footer bottombar colophon copyright legal related recommended recommendations more trending popular share sharing social follow subscribe subscription newsletter signup login search searchbox"
    " comment comments commentlist discussion respond reply replies disqus hidden noprint contentinfo complementary form".split()
)
#: Those that as a part of a longer class name also mark ordinary text: what stands there is judged by its density, and dropped unless it is long text.
WEAK_PARTS = frozenset("alert warning side rail form legal related recommended recommendations more trending popular share sharing social follow search discussion respond tabs header complementary".split())
#: Whole class names (in <main> outside <article> also ids) that mark other parts even within an article; all else there is left to the density rules.
CLEAR_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot ad-slot ad-container ad-banner sponsored sponsored-content promo cookie-notice cookie-banner cookie-consent"
    " sidebar sidenav navbar breadcrumb breadcrumbs pagination related-posts related-articles share-buttons sharing-buttons social-share newsletter newsletter-signup"
    " comments comment-list commentlist disqus disqus_thread".split()
)
#: Landmark roles that do so.
CLEAR_ROLES = frozenset("navigation complementary contentinfo banner search".split())
#: Elements that are part of an article's text when they stand in one.
CONTENT = frozenset(("math", "object"))
KEPT_WORDS = frozenset("article main content post entry story body".split())

#: The commonest function words of languages that part words by spaces.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as are was by be this an or at from not have has but which they his her you we he she"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er hat dass aus bei sie nach wird einer um am sind noch wie einem über so"
    " le la les de des et en un une du que est pour qui dans par sur pas plus au ne se ce il sont avec son elle ou mais aux cette"
    " el los las y en que del un una por con no para su al lo como más o pero sus le ha se es"
    " il di che è e la per un una non sono del della dei con ma si da nel alla gli lo come anche questo"
    " o os as que de e do da em um uma para com não por mais dos das na no se foi ao ele sua"
    " de het een en van is dat die in te op zijn niet met voor er aan om ook maar bij uit"
    " и в не на что я с он как это по но они к у из за то от так же для был о его она мы"
    " i w nie na z to się że do jest jak o ale po co tak od za przez był dla"
    " och att det i en är som på för av med inte den till har om ett men var jag"
    " ve bir bu da de için ile çok ne gibi daha olan olarak ama o kadar sonra en"
    " في من على أن إلى التي الذي عن مع هذا هذه كان ما لا هو هي أو ثم بعد قد و".split()
)
#: Characters of scripts that do not part words by spaces; each says about as much as three letters.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: What ends a sentence.
_SENTENCE = re.compile(r"[.!?…։؟۔।](?=[\s\"'”’»)\]]|$)|[。！？｡]")
SHORT, LONG = 70, 200
LINKS_MOST, STOPS_LEAST, STOPS_SURE = 0.5, 0.12, 0.25

#: Letters a sentence, at most, of text that has no known function words; and share of links in it.
SENTENCE_LETTERS, SENTENCE_LINKS = 400, 0.2

#: An article's tag loses its say if text outside it is so many times as long.
OUTWEIGHED = 2

_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>""", re.S)
_TORN = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: What stands in these is not markup; it ends at their own end tag.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_NO_SELF_CLOSE = frozenset(("article", "main", "body", "html", "p", "div", "section", "span", "a"))


class _Blocks:
    """The blocks of one page, from a scan over its tags that forgives unclosed and stray ones."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, dropped from here on, opens an article, doubtful from here on
        self.dropped = self.article = self.links = self.weak = 0
        self.blocks: list[tuple[str, str, int, bool, bool, bool]] = []  # tag, text, characters in links, dropped, article, doubtful
        self.parts: list[str] = []
        self.linked = 0
        self.tag = ""

    def read(self, html: str) -> None:
        at = seek = 0
        while (mark := html.find("<", seek)) >= 0:
            m = _TAG.match(html, mark)
            if not m:
                seek = mark + 1  # a bare < is text
                continue
            if mark > at:
                self.text(html[at:mark])
            at = seek = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            attrs = m[3] or ""
            self.start(tag, attrs)
            if attrs.endswith("/") and tag not in VOID and tag not in _NO_SELF_CLOSE:
                self.end(tag)
            elif tag in _RAW:
                close = _RAW[tag].search(html, at)
                at = seek = close.end() if close else len(html)
                self.end(tag)
        if at < len(html):
            rest = html[at:]
            cut = _TORN.search(rest)
            self.text(rest[: cut.start()] if cut else rest)
        self.cut("")

    def cut(self, tag: str) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.tag, text, self.linked, self.dropped > 0, self.article > 0, self.weak > 0))
            self.parts, self.linked = [], 0
        self.tag = tag

    def marked(self, tag: str, attrs: str) -> tuple[bool, bool]:
        """Whether an element is dropped, and whether it is doubtful."""
        if tag in DROPPED and not (self.article and tag in CONTENT) or tag == "header" and not self.article:
            return True, False
        if not attrs or tag in ("html", "body", "article", "main"):
            return False, False
        weak = False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
                return True, False
            if self.article:
                words = value.lower().split()
                if name == "role" and not CLEAR_ROLES.isdisjoint(words):
                    return True, False
                if (name == "class" or name == "id" and not self.in_article()) and not CLEAR_MARKS.isdisjoint(words):
                    return True, False
            elif name in ("class", "id", "role"):
                for word in value.lower().split():
                    parts = MARKS.intersection(_MARK.findall(word))
                    if parts and KEPT_WORDS.isdisjoint(_MARK.findall(word)):
                        if word in MARKS or not parts <= WEAK_PARTS:
                            return True, False
                        weak = True
        return False, weak

    def in_article(self) -> bool:
        return any(t == "article" for t, *_ in self.open)

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.cut(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ("article", "main"):
            while self.dropped:  # an unclosed part before the article
                self.close_last()
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.close_last()
        (drops, weak), article = self.marked(tag, attrs), tag in ("article", "main")
        self.open.append((tag, drops, article, weak))
        self.dropped += drops
        self.weak += weak
        self.article += article
        self.links += tag == "a"

    def close_last(self) -> None:
        tag, drops, article, weak = self.open.pop()
        if tag in BLOCK:
            self.cut("")
        self.dropped -= drops
        self.weak -= weak
        self.article -= article
        self.links -= tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut("")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.close_last()
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                return  # a stray end tag doesn't close the article

    def text(self, data: str) -> None:
        if "&" in data:
            data = unescape(data)
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def blocks_of(html: str) -> list[tuple[str, str, int, bool, bool, bool]]:
    page = _Blocks()
    page.read(html)
    return page.blocks


def _length(text: str) -> int:
    """Characters, those of dense scripts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _first_label(text: str, linked: int, dropped: bool, weak: bool) -> int:
    """1 main text, 0 another part, -1 ambiguous."""
    if dropped or linked > LINKS_MOST * len(text):
        return 0
    n = _length(text)
    if n < SHORT:
        return -1 + weak
    words = _WORD.findall(text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if n >= LONG and (stops >= STOPS_LEAST or linked <= SENTENCE_LINKS * len(text) and len(_SENTENCE.findall(text)) * SENTENCE_LETTERS >= n):
        return 1
    return 1 if stops >= STOPS_SURE and not weak else -1 + weak


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for a null, empty or text-less page.

    Where there is an article element, the text is looked for in it alone, unless what is plainly text outside is
    OUTWEIGHED times as long (a teaser is an article element too). An ambiguous block inside an article looks at neighbours inside it only,
    and is main text if none of them is decided; elsewhere it takes the label of the nearest decided block, the following one
    for a heading and for ties between two that disagree. Where no block is decided to be text, those count that are not short.
    """
    blocks = blocks_of(html or "")
    first = [_first_label(text, linked, dropped, weak) for _, text, linked, dropped, _, weak in blocks]
    within = [inside for *_, inside, _ in blocks]
    inner = sum(_length(b[1]) for b, f, w in zip(blocks, first, within, strict=True) if w and f)
    outer = sum(_length(b[1]) for b, f, w in zip(blocks, first, within, strict=True) if not w and f == 1)
    if outer > OUTWEIGHED * inner:
        within = [False] * len(blocks)
    any_article = any(within)
    if not any_article and 1 not in first:
        first = [1 if f < 0 and _length(b[1]) >= SHORT else f for b, f in zip(blocks, first, strict=True)]
    before: list[tuple[int, int] | None] = [None] * len(blocks)
    after: list[tuple[int, int] | None] = [None] * len(blocks)
    for order, into in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), after)):
        near: dict[bool, tuple[int, int]] = {}
        for i in order:
            inside = within[i]
            into[i] = near.get(inside)
            if first[i] >= 0 and not (inside and blocks[i][3]):
                near[inside] = (i, first[i])
    out = []
    for i, (tag, text, *_) in enumerate(blocks):
        label, inside = first[i], within[i]
        if any_article and not inside:
            label = 0
        elif label < 0:
            b, a = before[i], after[i]
            if not a and not b:
                label = int(inside)
            elif not a or not b:
                label = (a or b)[1]
            elif a[1] == b[1] or tag in HEADING:
                label = a[1]
            else:
                label = b[1] if i - b[0] < a[0] - i else a[1]
        if label == 1:
            out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html; other columns are left out).

    Whole pages are read, in Arrow batches, without a shuffle; a page's text depends on that page alone.
    Null or empty html gives an empty text; null ids and repeated rows come back as they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ids = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
