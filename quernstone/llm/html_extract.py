"""Main text of web pages: the best-scoring contiguous run of tokens.

A page becomes a sequence of words and tags. A word scores by the element that it stands in and by
whether that is inside the page's article, if it has one; a tag by its kind. The weights are learned from
labelled pages by an averaged structured perceptron: each page's best run is compared with the
labelled one, and the weights move by the tokens in which they differ. One linear scan
finds the run with the greatest sum, and that run is the text, made up to whole blocks at its two ends.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by
their elements. Each counts as one cut, with a weight of its own, and its words are left out.
A name alone can mislead (a wrapper called ``layout sidebar-left``), and a form can hold a whole page: an element that only its
class, id or role marks, or a form, is kept if the best run of the page read without such names lies wholly inside it.

A page is one row of a map: nothing is shuffled. Reading takes time linear in the page.

Cases: null or empty html, or a page without content, gives an empty text. Broken
markup is read as far as it goes: an unfinished tag at the end is dropped, unclosed elements
end with the page. Repeated rows are each extracted. An empty table gives an empty result. Columns other than the three
named are not read.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h2", "h3", "h4", "h5", "h6"))
#: Elements that are never main text.
FOREIGN = frozenset("nav footer aside menu dialog button head fieldset search".split())
#: Names that mark foreign elements for good, and names that may be those of a page's frame. A class, an id or a role counts word by word: all its parts must be names or NEUTRAL.
ALWAYS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions promoted cookie cookies consent gdpr popup popups newsletter subscribe subscription signup login paywall comment comments commentlist reply replies respond disqus outbrain taboola alertdialog contentinfo".split())
FRAME = frozenset("banner notice notices alert alerts modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars side rail widget widgets aside complementary footer foot masthead topbar toolbar header disclaimer social share sharing related recommended recommendations trending form skip hidden dialog".split())
#: Parts that say where or what kind of box it is; and those of an article, whose header is its own.
NEUTRAL = frozenset("bar box block list lists wrap wrapper container area section left right top bottom main inner outer item items link links slot unit units panel site page pages sticky fixed floating mobile desktop small large first last center group col column row button buttons icon icons title global local primary secondary google dfp gpt network space zone placeholder label privacy policy email thread tree children author meta count to up in out".split())
ARTICLE_PARTS = frozenset("article articles entry entries post posts story stories content".split())
_SIZE = re.compile(r"\d+(?:x\d+)?")
#: Elements of running text, whose ids are places to link to.
_RUNNING = frozenset("p span a b i em strong small li td th h1 h2 h3 h4 h5 h6 blockquote dd dt".split())
#: Names of elements that hold an article: a header in them is the article's own.
ARTICLE_NAMES = re.compile(r"(?<![a-z])(?:article|articlebody|blogpost|post|entry|story)(?![a-z-])|(?<![a-z])(?:article|entry|post|story)-(?:body|content|text|main)(?![a-z])")
#: What p ends at, what ends which open element, and what an end tag does not reach over.
_ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TABLE = frozenset("table tbody thead tfoot tr td th body html".split())
#: Where a word stands: the innermost of these elements.
_PLACES = {"a": "link", "p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "li": "item", "dd": "item", "dt": "item", "td": "cell", "th": "cell", "h1": "title"} | dict.fromkeys(HEADINGS, "heading")
_PRINT = re.compile(r"©|&copy;|&#169;|\ball rights reserved\b|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)

FEATURES = ("link", "title", "heading", "paragraph", "item", "cell", "bare", "print", "in", "off", "tag-title", "tag-heading", "tag-paragraph", "tag-item", "tag-block", "tag-inline", "tag-break", "tag-in", "cut")
_NUMBER = {f: k for k, f in enumerate(FEATURES)}
WORDS = frozenset(("link", "title", "heading", "paragraph", "item", "cell", "bare"))


@dataclass
class Element:
    tag: str
    parent: int
    begin: int  # number of the first token in it
    hard: bool  # foreign by its element or for good
    named: bool  # foreign by a name that may mislead, or as a form
    article: bool
    end: int = 0


@dataclass
class Page:
    """Tokens in order: kind (a place of words, or of a tag), text, block number, element number."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(foreign for good, foreign by a name, named like an article) of an element."""
    hard = tag in FOREIGN or tag == "header" and not in_article
    frame, named, like = tag in ("body", "html", "main", "article"), tag == "form", tag in ("article", "main")
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hard = True
            elif name in ("class", "id", "role", "itemprop"):
                value = value.replace("_", "-")
                if name == "id" and tag in _RUNNING:
                    continue
                like = like or name != "id" and bool(ARTICLE_NAMES.search(value)) or name == "role" and value == "main"
                if name != "itemprop" and (not frame or "comment" in value):
                    for_good, by_name = _named(value)
                    hard, named = hard or for_good, named or by_name
    return hard, named, like


@functools.lru_cache(maxsize=4096)
def _named(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role holds a word that marks a foreign element for good, and one that may be a frame's."""
    hard = named = False
    for word in value.split():
        parts = {p for p in word.split("-") if p and not _SIZE.fullmatch(p)}
        if parts - ALWAYS - FRAME - NEUTRAL - ARTICLE_PARTS:
            continue
        own = parts & FRAME
        if "header" in own and parts & (ARTICLE_PARTS | {"section"}):
            own = own - {"header"}
        hard, named = hard or bool(parts & ALWAYS), named or bool(own)
    return hard, named


def read(page: str) -> Page:
    """The tokens and elements of a page, each tag handled in constant time (amortised)."""
    out = Page()
    elements = out.elements
    elements.append(Element("", -1, 0, False, False, False))
    stack = [0]  # open elements
    places: dict[str, list[int]] = {}  # of each tag, its places in the stack
    blocks_at, cells_at, place_at, like_at = [], [], [], []  # places in the stack of blocks, cells, elements that name a place, and elements like articles
    gone: set[int] = set()  # inline elements that ended below blocks still open
    block = 0

    def pop() -> None:
        at = len(stack) - 1
        e = elements[stack.pop()]
        e.end = len(out.kinds)
        if at in gone:
            gone.discard(at)
        else:
            places[e.tag].pop()
        for held in (blocks_at, cells_at, place_at, like_at):
            if held and held[-1] == at:
                held.pop()

    def pop_to(at: int) -> None:
        while len(stack) > at:
            pop()

    def put(kind: str, text: str) -> None:
        out.kinds.append(kind)
        out.texts.append(text)
        out.blocks.append(block)
        out.owners.append(stack[-1])

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                while place_at and place_at[-1] in gone:
                    place_at.pop()
                kind = "link" if places.get("a") else _PLACES[elements[stack[place_at[-1]]].tag] if place_at else "bare"
                if not text.isspace():
                    put(kind, text)
                elif out.texts:
                    put("space", text)
            continue
        tag, ending = tag.lower(), bool(m[2] or m[5])
        is_block = tag in BLOCKS
        if ending:
            at = places[tag][-1] if places.get(tag) else -1
            if at >= 0:
                if is_block:
                    if tag in _TABLE or not cells_at or at > cells_at[-1]:
                        pop_to(at)
                elif not blocks_at or at > blocks_at[-1]:
                    pop_to(at)
                else:  # an inline element ends, the blocks opened in it go on
                    gone.add(at)
                    places[tag].pop()
        else:
            ends = _ENDS.get(tag)
            while ends and blocks_at and elements[stack[blocks_at[-1]]].tag in ends:
                pop_to(blocks_at[-1])
            if tag in _ENDS_P and blocks_at and elements[stack[blocks_at[-1]]].tag == "p":
                pop_to(blocks_at[-1])
            attrs = m[4] or m[7] or ""
            if tag not in VOID and not attrs.endswith("/"):
                hard, named, like = _marks(tag, attrs, bool(like_at))
                if tag == "button" and places.get("p"):  # in a sentence
                    hard = named
                elements.append(Element(tag, stack[-1], len(out.kinds), hard, named, tag in ("article", "main")))
                at = len(stack)
                stack.append(len(elements) - 1)
                places.setdefault(tag, []).append(at)
                if is_block:
                    blocks_at.append(at)
                if tag in ("td", "th"):
                    cells_at.append(at)
                if tag in _PLACES:
                    place_at.append(at)
                if like:
                    like_at.append(at)
        block += is_block
        if tag == "br":
            put("tag-break", " ")
        elif tag != "wbr":
            put("tag-" + ("block" if tag in ("td", "th") else p if (p := _PLACES.get(tag)) in ("title", "heading", "paragraph", "item") else "block" if is_block else "inline"), "")
    pop_to(1)
    elements[0].end = len(out.kinds)
    return out


def foreign_and_article(page: Page, kept: frozenset[int] | None) -> tuple[list[bool], list[bool]]:
    """Of each element, whether it is left out, and whether it is an article or in one. kept: elements whose names do not count; None: no name counts."""
    foreign, article = [], []
    for k, e in enumerate(page.elements):
        above = e.parent >= 0
        foreign.append(above and foreign[e.parent] or e.hard or kept is not None and e.named and k not in kept)
        article.append(above and article[e.parent] or e.article and not foreign[k])
    return foreign, article


def features(page: Page, foreign: list[bool], article: list[bool]) -> list[tuple[tuple[int, int], ...]]:
    """For each token (feature, amount) pairs; of foreign tokens in a row only the first has one, a cut."""
    any_article, out, before = any(article), [], False
    for kind, text, owner in zip(page.kinds, page.texts, page.owners, strict=True):
        if foreign[owner]:
            out.append(() if before else ((_NUMBER["cut"], 1),))
            before = True
            continue
        before = False
        if kind in WORDS:
            n = len(text.split())
            found = [(_NUMBER[kind], n)]
            if any_article:
                found.append((_NUMBER["in" if article[owner] else "off"], n))
            if _PRINT.search(text):
                found.append((_NUMBER["print"], n))
            out.append(tuple(found))
        else:
            out.append(((_NUMBER[kind], 1), *(((_NUMBER["tag-in"], 1),) if article[owner] else ())) if kind in _NUMBER else ())
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the first run with the greatest positive sum; (0, 0) if there is none."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, low, high = total, start, k + 1
    return low, high


# ---- labelled pages and weights


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """(html, its main text) of a page built by rule: a frame of some kind around a content of some kind."""
    vocabulary = "so it was that the long road by the river came to an end in a town of old houses where people met and spoke of all they had seen".split()
    lines: list[str] = []

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(low, high)))

    def said(text: str, plain: str | None = None) -> str:
        lines.append(plain if plain is not None else text)
        return text

    def links(n: int, apart: str = " ") -> str:
        return apart.join(f'<a href="/{k}">{words(1, 3)}</a>' for k in range(n))

    def paragraph(low: int, high: int) -> str:
        a, b, c = words(low, high), words(1, 3), words(1, 8)
        how = rng.randrange(5)
        if how == 0:
            return "<p>" + said(f'{a} <a href="/x">{b}</a> {c}', f"{a} {b} {c}") + "</p>"
        if how == 1:
            return "<p>" + said(f"{a} <b>{b}</b><br>{c}", f"{a} {b} {c}") + "</p>"
        return "<p>" + said(a) + rng.choice(("</p>", "</p>\n", ""))

    def content(place: str) -> str:
        parts = []
        if place != "cell" and rng.random() < 0.8:
            title = f"<h1>{said(words(1, 8))}</h1>"
            parts.append(rng.choice((title, title, f'<div class="article-header">{title}</div>')))
        for k in range(rng.randint(1, 6)):
            how = rng.random()
            if how < 0.7 or k == 0:
                parts.append(paragraph(1, 3) if rng.random() < 0.2 else paragraph(6, 50))
            elif how < 0.8:
                parts.append("<ul>" + "".join(f"<li>{said(words(2, 12))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif how < 0.9:
                parts.append(f"<h2>{said(words(1, 4))}</h2>")
            else:
                parts.append(rng.choice((f'<div class="ad">{words(5, 30)}</div>', f"<aside>{words(3, 20)}</aside>", f'<div class="share">{links(3)}</div>')))
        parts.append(paragraph(1, 3) if rng.random() < 0.3 else paragraph(8, 40))
        if place in ("article", "main"):  # all of an article is text, whatever its markup
            if rng.random() < 0.3:
                parts[:0] = [rng.choice(("<header>%s</header>", "<div>%s</div>", "<div><span>%s</span></div>")) % words(1, 3)]
                lines[:0] = [re.sub("<[^>]*>", "", parts[0])]
            if rng.random() < 0.3:
                parts.append(rng.choice(("<div>%s</div>", "<div><small>%s</small></div>")) % said(words(1, 4)))
            elif rng.random() < 0.3:
                parts.append("<ul>" + "".join(f'<li><a href="/r">{said(words(1, 4))}</a></li>' for _ in range(rng.randint(1, 4))) + "</ul>")
        if place in ("div", "section") and rng.random() < 0.2:
            return "".join(p.replace("<p>", "<div>").replace("</p>", "</div>") for p in parts)
        return "".join(parts)

    def frame(before: bool) -> str:
        parts = []
        for _ in range(rng.randint(0, 3)):
            how = rng.randrange(7)
            parts.append(
                f"<nav><ul>{''.join(f'<li>{links(1)}</li>' for _ in range(5))}</ul></nav>" if how == 0
                else f'<div class="top"><ul>{"".join(f"<li>{links(1)}</li>" for _ in range(rng.randint(3, 8)))}</ul></div>' if how == 1
                else f"<div>{links(rng.randint(3, 6), ' | ')}</div>" if how == 2
                else (f"<header>{links(2)}</header>" if before else f"<footer>{words(3, 12)} {links(2)}</footer>") if how == 3
                else f"<div><h3>{words(1, 2)}</h3><ul>{''.join(f'<li>{links(1)}</li>' for _ in range(rng.randint(2, 5)))}</ul></div>" if how == 4
                else f'<div class="sidebar"><p>{words(10, 40)}</p></div>' if how == 5
                else (f"<div><span>{words(1, 2)}</span> <span>{words(1, 2)}</span></div>" if before else f"<div>&copy; 2020 {words(1, 6)}. All rights reserved. {links(2)}</div>")
            )
        return "".join(parts)

    place = rng.choice(("article", "article", "main", "div", "div", "section", "cell", "body"))
    head = frame(True)
    if place in ("article", "main") and rng.random() < 0.5:
        head += f"<p>{words(3, 30)}</p>"
    inner = content(place)
    inner = {"article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "div": f'<div class="text">{inner}</div>', "section": f"<section>{inner}</section>", "cell": f"<table><tr><td>{links(4, '<br>')}</td><td>{inner}</td></tr></table>", "body": inner}[place]
    tail = (f"<p>{words(3, 30)}</p>" if place in ("article", "main") and rng.random() < 0.3 else "") + frame(False)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p {{margin: 0}}</style></head><body>{head}{inner}{tail}</body></html>", "\n".join(lines)


@functools.lru_cache(maxsize=2)
def weights(pages: int = 400, rounds: int = 12, seed: int = 8, margin: float = 1.0) -> tuple[float, ...]:
    """The weights of FEATURES, by an averaged structured perceptron over labelled pages.

    A run that leaves the label gains ``margin`` for each word outside it, so that labelled runs win by some distance.
    """
    rng = random.Random(seed)
    examples = []
    for _ in range(pages):
        html, text = labelled_page(rng)
        page = read(html)
        foreign, article = foreign_and_article(page, frozenset())
        found = features(page, foreign, article)
        # the labelled words, in order, are a run of the page's own words but for cuts
        own = [(k, w) for k, (kind, t, o) in enumerate(zip(page.kinds, page.texts, page.owners, strict=True)) if kind in WORDS and not foreign[o] for w in _html.unescape(t).split()]
        wanted = text.split()
        at = next(a for a in range(len(own) - len(wanted), -1, -1) if [w for _, w in own[a : a + len(wanted)]] == wanted)
        examples.append((found, own[at][0], own[at + len(wanted) - 1][0] + 1))
    w = [0.0] * len(FEATURES)
    for f in WORDS:
        w[_NUMBER[f]] = 1.0
    total, steps = [0.0] * len(w), 0
    for _ in range(rounds):
        rng.shuffle(examples)
        for found, begin, end in examples:
            scores = [sum(w[f] * n for f, n in token) + (margin if token and not begin <= k < end and FEATURES[token[0][0]] in WORDS else 0.0) for k, token in enumerate(found)]
            low, high = best_run(scores)
            for sign, a, b in ((1, begin, end), (-1, low, high)):
                for token in found[a:b]:
                    for f, n in token:
                        w[f] += 0.02 * sign * n
            total = [a + b for a, b in zip(total, w, strict=True)]
            steps += 1
    return tuple(x / steps for x in total)


# ---- text


def _scores(page: Page, kept: frozenset[int] | None, w: tuple[float, ...]) -> tuple[list[float], list[bool]]:
    foreign, article = foreign_and_article(page, kept)
    return [sum(w[f] * n for f, n in token) for token in features(page, foreign, article)], foreign


def extract(html: str | None, learned: tuple[float, ...] | None = None) -> str:
    """The main text of one page; ``learned``: the weights, by default those of ``weights``."""
    if not html:
        return ""
    w = weights() if learned is None else learned
    page = read(html)
    kept: frozenset[int] = frozenset()
    if any(e.named and not e.hard for e in page.elements):
        low, high = best_run(_scores(page, None, w)[0])
        kept = frozenset(k for k, e in enumerate(page.elements) if e.named and e.begin <= low < high <= e.end)
    scores, foreign = _scores(page, kept, w)
    low, high = best_run(scores)
    if low == high:
        return ""
    first, last = page.blocks[low], page.blocks[high - 1]
    while low and page.blocks[low - 1] == first:
        low -= 1
    while high < len(scores) and page.blocks[high] == last:
        high += 1
    parts, now, at = [], [], None
    for text, block, owner in zip(page.texts[low:high], page.blocks[low:high], page.owners[low:high], strict=True):
        if foreign[owner] or not text:
            continue
        if block != at:
            parts.append(now)
            now, at = [], block
        now.append(text)
    parts.append(now)
    lines = (_SPACE.sub(" ", _html.unescape("".join(p))).strip() for p in parts)
    return "\n".join(x for x in lines if x)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    learned = weights()  # once, on the driver

    @F.arrow_udf("string")
    def text_of(pages):
        import pyarrow as pa

        return pa.array([extract(p, learned) for p in pages.to_pylist()], pa.string())

    rows = df.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), text_of(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLE: dict[str, str] = {}
