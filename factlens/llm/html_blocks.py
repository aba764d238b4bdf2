"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density, those of the
blocks before and after it, what its surroundings' tags and names say, and word count and link density of the element that
says so. A decision tree tells article blocks from the rest; it is grown from the blocks of a small table of labelled pages.
Names only weigh in: an element that holds the title or the article and most of the page's words is the page's frame,
whatever it is called; a name that holds other words than those of page parts is a topic, and blocks under it are kept or
dropped by counts and densities, as are those under names that articles' parts have as well.
Pages are independent rows: there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import read_table, tidy

TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAMING = frozenset("class id role".split())
HIDDEN = re.compile(r"""\shidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PART = re.compile(r"[a-z]+")
MAIN_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.I)

# HTML elements by role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
SKIP = frozenset("head template svg math object select button datalist canvas audio video map".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
SECTION = BOILER_TAGS | MAIN_TAGS | {"header", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark what isn't the article, by how telling they are: those of the second kind also name
#: what a long section of an article may be about, those of the third are names of parts of articles as well.
TELLING = {
    1.0: frozenset(
        "ad ads advert advertisement adverts breadcrumb breadcrumbs byline comment commentlist comments contentinfo copyright "
        "disclaimer discussion disqus footer gdpr masthead modal nav navbar newsletter popup promo responses sidebar signup skip sponsored toolbar".split()
    ),
    0.75: frozenset("banner banners consent cookie cookies menu navigation promotion sponsor subscribe subscription widget widgets".split()),
    0.5: frozenset("header login notice notices related replies reply respond search share sharing social".split()),
}
#: How telling a name is that holds other words besides, so that it names a topic.
TOPIC = 0.5
# Words of names of page parts that say nothing about what they hold, and words that turn a name around.
PLAIN = frozenset(
    "area article aside bar block body bottom box btn button card cell col column container content cta desktop div entry feed fixed form global "
    "google grid group head header html inline inner item items js left link links list main message mobile module new outer overlay page panel "
    "part post posts primary reader readers recent region right root row section secondary site slot small sticky story tab text thread top unit "
    "user view web wrap wrapper zone".split()
)
TURNED = frozenset("no non not without".split())
#: What a line about rights starts with.
RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)", re.I)

#: An element that holds the title or the article and this share of the page's words is its frame.
FRAME_SHARE = 0.5
#: A line about rights has no more words.
RIGHTS_WORDS = 40
#: Small labelled table: pages whose {n} stands for n words of the article and [n] for n words of anything else.
LABELLED = (
    # article elements between menus, adverts and footers
    "<nav><ul><li><a>[1]</a><li><a>[1]</a><li><a>[2]</a></ul></nav><div class=ad>[9]</div><article><h1>{9}</h1><p>{60}<p>{120}<p>{1}<p>{35}</article><footer>[12]</footer>",
    "<header>[3]<nav><a>[1]</a> <a>[1]</a></nav></header><article><h1>{1}</h1><p>{300}</p></article><div>[15]</div><footer>[2] <a>[2]</a></footer>",
    "<nav><a>[1]</a></nav><div class=ad>[4]</div><article><h1>{12}</h1><p>{14}<p>{1}</p></article><footer>[9]</footer>",
    "<nav><a>[1]</a></nav><div class=ad>[30]</div><article><h1>{3}</h1><p>{2}</p></article><footer>[30]</footer>",
    "<nav><a>[1]</a><a>[1]</a></nav><div class=advert>[110]</div><article><h1>{4}</h1><p>{8}<p>{25}<p>{5}</article><footer>[6]</footer>",
    "<article><h1>{5}</h1><p>{30}<p>{4}<p>{1}<p>{60}<p>{3}<p>{2}<p>{1}<p>{4}</article>", "<article><h1>{2}</h1><p>{1}<p>{2}<p>{3}<p>{1}<p>{1}</article>",
    "<article><h1>{8}</h1><p>{2}<p>{5}<p>{2}<p>{1}<p>{18}<p>{4}<p>{2}<p>{9}<p>{3}<p>{1}<p>{400}<p>{1}<p>{2}<p>{70}<p>{4}<p>{25}<p>{2}</article><footer>[40]</footer>",
    "<article><h1>{20}</h1><p>{3}<p>{1}<p>{4}<p>{4}<p>{2}<p>{14}<p>{1}<p>{12}<p>{4}<p>{1}</article>", "<main><h1>{1}</h1><p>{4}<h2>{1}</h2><p>{2}<h2>{2}</h2><p>{1}<p>{4}</main><footer>[1]</footer>",
    "<article><p>{1}</p></article>", "<div class=ad>[12]</div><article><p>{6}</p></article>",
    # lists, quotes and links within articles; lists of links at their ends
    "<main><h1>{6}</h1><p>{50}<ul><li>{2}<li>{3}<li>{10}</ul><p>{14} <a>{9}</a> {20}<h2>{3}</h2><p>{40}<ul><li><a>{7}</a><li><a>{6}</a><li><a>{9}</a></ul><p>{30}</main>",
    "<article><h1>{7}</h1><p>{90}<blockquote>{12}</blockquote><p>{70}<p><a>{6}</a><p>{80}<ul><li><a>[1]</a><li><a>[2]</a><li><a>[2]</a><li><a>[1]</a></ul></article>",
    "<article><ul><li><a>[1]</a><li><a>[2]</a><li><a>[2]</a></ul><h1>{8}</h1><p>{45}<p>{60}<p><a>[2]</a><p><a>[2]</a><p><a>[1]</a></article>",
    # linked titles and headings, people and sources
    "<nav><a>[1]</a><a>[2]</a></nav><article><h1><a>{2}</a></h1><p>{60}<h2><a>{2}</a></h2><p>{90}<h2><a>{5}</a></h2><p>{30}<p><a>{5}</a><p>{45}</article><footer>[9]</footer>",
    "<article><h1><a>{7}</a></h1><p>{25}<h3><a>{1}</a></h3><p>{40}<p><a>{2}</a> {2}<p>{70}<p><a>{3}</a> {1}<p><a>{4}</a> {9}<h2>{1}</h2><ul><li><a>{2}</a><li><a>{2}</a><li><a>{3}</a></ul></article>",
    "<main><h1><a>{4}</a></h1><p><a>{1}</a><p>{12}<p><a>{8}</a><p>{50}<h2><a>{3}</a></h2><ol><li><a>{5}</a><li><a>{2}</a> {4}<li>{2}</ol></main><div><a>[2]</a> <a>[1]</a></div>",
    "<div class=menu><a>[1]</a> <a>[1]</a></div><h1><a>{6}</a></h1><p>{70}<p>{25}<h2><a>{2}</a></h2><p>{40}<p>{60}<div class=footer>[10]</div>",
    # topics by the name of page parts, and the parts themselves
    "<article><h1>{6}</h1><p>{40}<section id=public-comments-on-rules><h2>{4}</h2><p>{60}<p>{12}<p>{90}</section><section id=modal-verbs><h2>{2}</h2><p>{70}<p>{30}</section><p class=share>{30}</article>",
    "<main><h1>{3}</h1><section id=history-of-ads><h2>{4}</h2><p>{25}<p>{45}</section><section id=footer-notes-explained><p>{14}<p>{20}</section><div class=related>[2] <a>[5]</a></div></main>",
    "<main><h1>{5}</h1><p>{60}<p>{45}<div id=responses><h3>[2]</h3><p>[40]<p>[12]<p>[70]</div></main>", "<main><article><h1>{5}</h1><p>{60}</article><div class=reader-responses><p>[30]<p>[9]<p>[110]</div></main>",
    # rights
    "<article><h1>{5}</h1><p>{60}<p>{20}</article><div>© [6]</div>", "<main><h1>{5}</h1><p>{60}<p>{90}<p>© [4]</main>", "<h1>{4}</h1><p>{70}<p>{30}<p>{9}<div>© [12]</div>",
    "<main><h1>{5}</h1><p>{30}<div>© [9]</div></main><div>[4]</div>", "<p>{20}<p>{45}<p>© [3]",
    # notices and titles beside an article
    "<div>[18]</div><article><h1>{6}</h1><p>{60}<p>{30}</article><div>[25]</div>", "<div>[40]</div><div>[9]</div><article><p>{90}<p>{30}</article>",
    "<div>[18]</div><article><p>{26}<p>{50}</article><div>[110]</div><div>[3]</div>", "<p>[12]</p><article><p>{45}</article>", "<div><p>[70]</p></div><article><h1>{5}</h1><p>{200}</article>",
    "<nav><a>[1]</a><a>[1]</a></nav><h1>{7}</h1><article><p>{60}<p>{30}</article><h2>[2]</h2><p>[25]</p>", "<h1>{9}</h1><article><p>{90}<p>{45}</article><h3>[3]</h3><div><a>[6]</a></div>",
    # boilerplate within articles
    "<article><h1>{5}</h1><p>{70}<div class=ad>[20]</div><p>{80}<div class=newsletter><h3>[3]</h3><p>[12]</p></div><p>{40}<div class=comments><h2>[1]</h2><p>[9]<p>[45]<p>[30]<p>[12]</div></article>",
    "<article><h1>{9}</h1><p>{55}<p>{45}<aside>[18]</aside><p>{60}<form>[4]</form><div class=cookie>[25]</div><div class=comment>[60]</div><div class=comment>[4]</div></article>",
    "<article><h1>{5}</h1><p>{45}<div class=share><a>[2]</a> <a>[2]</a></div><p>{70}<div class=related><h3>[2]</h3><ul><li><a>[6]</a><li><a>[7]</a></ul></div></article>",
    "<article><div class=header><a>[1]</a> <a>[1]</a></div><h1>{5}</h1><p>{24}<p>{45}<div class=related><h3>[3]</h3><ul><li><a>[4]</a></ul></div></article>",
    "<article><h1>{5}</h1><div class=share><ul><li><a>[1]</a><li><a>[1]</a></ul></div><p>{80}<p>{45}<div class=search>[1]</div><div class=notice>[2]</div></article>",
    "<article><h1>{6}</h1><p>{60}<p>{90}<div class=comments><h3>[2]</h3><p>[60]<p>[12]<p>[80]<p>[45]<p>[150]<p>[9]<p>[30]<p>[110]<p>[4]<p>[22]<p>[70]<p>[18]</div></article>",
    "<article><h1>{6}</h1><p>{120}</article><section class=comments><p>[90]<p>[140]<p>[25]<p>[100]<p>[8]</section><aside><p>[180]<p>[60]</aside><div class=cookies>[300]</div><footer>[200]</footer>",
    "<h1>{6}</h1><p>{120}<p>{60}<div id=disqus><p>[90]<p>[16]<p>[25]<p>[100]<p>[8]<p>[60]</div><div class=newsletter>[160]</div><div class=promo><p>[100]<p>[90]</div>",
    "<article><h1>{6}</h1><p>{60}<p>{90}<div class=comments><p>[95]<p>[120]</div></article>", "<article><h1>{4}</h1><p>{90}<div class=promo>[100]</div><p>{70}<div class=banner>[15]</div><p>{70}</article>",
    # parts of articles under such names
    "<article><div class=header><h1>{4}</h1></div><p>{24}<section id=search><h2>{3}</h2><p>{24}<p>{2}<p>{26}</section><h2 id=related>{2}</h2><p>{25}<section id=social><p>{30}</section></article>",
    "<article><h1>{4}</h1><p>{25}<p>{20}<section id=social><p>{24}</p></section><div class=share><a>[1]</a> <a>[2]</a></div></article>", "<article><p>{50}<p class=notice>{20}<div class=reply>{16}</div></article>",
    "<article><h1>{6}</h1><p>{90}<p class=share>{9}<p class=notice>{30}<h2 id=search>{4}</h2><p>{60}<div class=related><p>{45}<p>{60}</div></article>",
    "<article><h1>{6}</h1><section id=widgets><h2>{3}</h2><p>{90}<p>{120}<p>{75}</section><section id=navigation><h2>{3}</h2><p>{85}<p>{110}</section></article>",
    "<article><h1>{6}</h1><section id=cookies><h2>{2}</h2><p>{100}<p>{80}</section><p>{60}<p class=share>{14}<p>{40}</article>",
    # frames
    "<div class=sidebar><article><h1>{5}</h1><p>{60}<p>{12}</article><aside>[20]</aside></div>", "<form><nav><a>[1]</a></nav><article><h1>{6}</h1><p>{70}<p>{9}</article></form>",
    "<div class=comments><nav><a>[1]</a><a>[1]</a></nav><h1>{6}</h1><p>{70}<p>{60}<p>{50}<div class=footer>[9]</div></div>",
    # no article element
    "<div class=menu><a>[1]</a> <a>[1]</a></div><h1>{6}</h1><p>{70}<p>{25}<p>{12}<p>{6}<p>{40}<p>{3}<p>{60}<div class=footer>[10]</div>",
    "<ul><li><a>[1]</a><li><a>[1]</a><li><a>[2]</a></ul><h1>{7}</h1><p>{55}<p>{12}<p>{140} <a>{4}</a><h2>{4}</h2><p>{70}<ul><li><a>[3]</a><li><a>[2]</a><li><a>[3]</a></ul><p>[6]</p>",
    "<header><a>[2]</a></header><div><h1>{5}</h1><div>{90}</div><div>{18} <a>{4}</a></div><div>{40}</div></div><div><a>[7]</a> [2] <a>[8]</a></div><div><a>[9]</a></div><footer>[5]</footer>",
    "<div><a>[1]</a></div><div><a>[2]</a></div><p>{30}</p><div><a>[1]</a></div>", "<p>{20}</p>", "<div>{15}</div><div>{9}</div><div>{22}</div>", "<h1>{4}</h1><p>{5}</p><p>{9}</p>",
    "<div><a>[2]</a></div><div><a>[9]</a> [4]</div><div><a>[6]</a> [1]</div><div><a>[3]</a></div>", "<h3>[3]</h3><div><a>[2]</a></div><div><a>[4]</a></div><div>[4]</div><div><a>[1]</a></div>",
    "<div class=header><h1>{6}</h1></div><p>{60}<p>{9}<div class=search>[1]</div><div class=related><h3>[2]</h3><a>[7]</a></div><div class=comments><p>[40]<p>[12]</div>",
    "<h1>{5}</h1><p>{45}<p>{60}<div class=sidebar><h3>[2]</h3><p>[25]</p><p>[9]</p></div><div class=sponsored>[30]</div><aside><p>[60]</p></aside>",
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (share,) at a leaf, else (feature, threshold, left, right)."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= t
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
            best = min(best, (impurity, k, float(t)))
    if not np.isfinite(best[0]):
        return (float(y.mean()),)
    _, k, t = best
    left = x[:, k] <= t
    return k, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


KNOWN = PLAIN.union(*TELLING.values())


def strength(name: str) -> float:
    """How tellingly one name marks boilerplate: less if it has words of its own, not at all if one turns it around."""
    words = PART.findall(name.lower())
    found = max(0.0 if names.isdisjoint(words) else telling for telling, names in TELLING.items())
    if not found or not TURNED.isdisjoint(words):
        return 0.0
    return min(found, TOPIC) if any(len(w) > 2 and w not in KNOWN for w in words) else found


def marked(attributes: str) -> float:
    """How tellingly a class, id or role marks boilerplate (0: not at all)."""
    names = (x for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in NAMING for x in "".join(values).split())
    return max(map(strength, names), default=0.0)


@dataclass
class Mark:
    """An element whose tag or name may say what it is: how telling that is, and what it holds."""

    telling: float
    above: int
    words: int = 0
    linked: int = 0
    holds: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    mark: int
    main: bool
    level: int


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """Flat text blocks in page order, with the innermost mark that each stands under (0: none), and the marks."""
    out: list[Block] = []
    marks = [Mark(0.0, 0)]
    stack: list[tuple[str, int, bool, bool]] = []  # element, mark, in the article, skipped
    parts: list[str] = []
    linked, links, level = 0, 0, 0
    mark, main, skip = 0, False, False

    def flush() -> None:
        nonlocal parts, linked, level
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), mark, main, level))
                marks[mark].words += len(words)
                marks[mark].linked += out[-1].linked
                marks[mark].holds |= level == 1
        parts, linked, level = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skip:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.split())

    def pop_to(depth: int) -> None:
        nonlocal mark, main, skip, links
        links -= sum(s[0] == "a" for s in stack[depth:])
        del stack[depth:]
        mark, main, skip = stack[-1][1:] if stack else (0, False, False)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        block = tag in BLOCK
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if block:
                        flush()
                    pop_to(depth)
                    break
                if stack[depth][0] in SECTION and tag not in SECTION and tag not in ("html", "body"):
                    break
            if block:
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            for depth in range(len(stack) - 1, -1, -1):  # a paragraph ends where the next block begins, an item where its sibling does
                if stack[depth][0] == "p" or stack[depth][0] in CLOSED_BY_SIBLING.get(tag, ()):
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        article = tag in MAIN_TAGS or bool(attributes and MAIN_ROLE.search(attributes))
        telling = 1.0 if tag in BOILER_TAGS or (tag == "header" and not main) else 0.0
        if attributes and tag not in ("html", "body") and not article:
            telling = max(telling, 1.0 if HIDDEN.search(attributes) else marked(attributes))
        if telling:
            marks.append(Mark(telling, mark))
            mark = len(marks) - 1
        if article:
            marks[mark].holds = True
        main = main or article
        skip = skip or tag in SKIP
        stack.append((tag, mark, main, skip))
        links += tag == "a"
        if tag in HEADINGS:
            level = int(tag[1])
    flush()
    for m in reversed(marks[1:]):  # an element comes after those around it
        above = marks[m.above]
        above.words, above.linked, above.holds = above.words + m.words, above.linked + m.linked, above.holds or m.holds
    return out, marks


def features(found: list[Block], marks: list[Mark]) -> list[tuple[float, ...]]:
    """Words and link density of each block, of the one before and the one after; what the most telling element around it
    that isn't the page's frame says, its words and link density; whether it stands in the article (a half if the page
    has none); whether it is the title (a half: another heading); whether it is a line about rights; whether a heading leads to it, with
    nothing but links between."""
    total = marks[0].words
    telling = list(range(len(marks)))  # by mark, the most telling one that it stands under
    for k, m in enumerate(marks[1:], 1):
        frame = m.holds and m.words >= FRAME_SHARE * total
        telling[k] = telling[m.above] if frame or marks[telling[m.above]].telling >= m.telling else k
    has_main = any(b.main and marks[telling[b.mark]].telling < 1 for b in found)
    sizes = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    out, led = [], 0.0
    for k, b in enumerate(found):
        m = marks[telling[b.mark]]
        around = (m.telling, m.words if m.telling else 0, m.linked / m.words if m.telling and m.words else 0.0)
        place = (1.0 if b.main else 0.0) if has_main else 0.5
        rights = float(b.words <= RIGHTS_WORDS and RIGHTS.search(b.text) is not None)
        out.append((*sizes[k + 1], *sizes[k], *sizes[k + 2], *around, place, 1.0 if b.level == 1 else 0.5 if b.level else 0.0, rights, led))
        if b.level or 2 * b.linked < b.words:
            led = 1.0 if b.level else 0.0
    return out


def labelled_rows(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    x, y = [], []
    for page in pages:
        for sign, word in (("{}", "yes "), ("[]", "no ")):
            page = re.sub(rf"\{sign[0]}(\d+)\{sign[1]}", lambda m, word=word: word * int(m[1]), page)
        found, marks = blocks(page)
        x += features(found, marks)
        y += [b.text.startswith("yes") for b in found]
    return np.array(x, float), np.array(y, float)


def trained(pages: tuple[str, ...] = LABELLED) -> tuple:
    """The decision tree."""
    return grow(*labelled_rows(pages), depth=12)


def main_text(page: str | None, tree: tuple) -> str:
    found, marks = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found, marks), strict=True) if decide(tree, row))


def extract(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    A null or empty page, or one without an article, has an empty text. Null ids and urls are carried along, repeated
    rows come back as often as they are there, and an empty table gives an empty result. Other columns are not looked at.
    """
    tree = trained(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their main text."""
    return extract(read_table(spark, sf_dir, "pages"))
