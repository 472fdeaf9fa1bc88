"""Main-text extraction from HTML by two passes of block rules.

Pass one cuts a page into text blocks and decides by link density, length and stop-word density which are main text and
which are not; names of elements and classes are evidence beside that.  Pass two lets the ambiguous short blocks inherit
the label of their nearest decided neighbours, those of the same container first; the edges of a page count as not main.
Reading a page takes time in proportion to its length.  Pages are independent of each other, so the work needs no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|[="'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WHITE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "svg", "canvas", "annotation", "annotation-xml", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
MAIN = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = OUTSIDE | MAIN | HEADING | {"html", "body", "div", "p", "section", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "center", "legend", "label", "option"}
#: An open element of these closes when another of its group starts.
IMPLIED = {"p": {"p"} | HEADING, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
CLOSES_P = BLOCK - {"label", "option", "legend"}
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead footer foot comment comments commentlist reply replies respond discussion disqus related recommended recommendations widget toolbar pagination pager copyright legal search skip hidden".split())
#: A class name with one of these says what a layout has or leaves out, or names content: its other words are no hints.
LAYOUT = frozenset("has no with without layout article post entry content story result results main page body text".split())
#: Words that may stand beside a hint in a class name without making it another thing, as in comment-list or ad-box.
NEUTRAL = frozenset("list lists box bar block blocks section area container wrapper wrap inner outer item items group row col column panel pane slot unit zone buttons button links link icons icon media tools form field top bottom left right center first last site user users reader readers global small large wide mobile desktop sticky fixed more posts articles stories message policy card cards level".split())
#: Elements with text of their own; inside an article all their class names must be hints, not one of several.
CONTENT = HEADING | {"p", "table", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "caption", "li", "dl", "dt", "dd", "span", "b", "i", "em", "strong"}
#: Elements that are hints only, as they may wrap whole pages.
WRAPPERS = {"form", "fieldset"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for on with as was it by be at this are or an from not have he his but they which "
    "de la le et les des du un une en que qui dans pour par sur au est pas plus ne se ce il avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es aus werden "
    "el los las del por con para una su al lo como más sus y o".split()
)
#: Blocks of these belong to the container around the element.
LEAVES = HEADING | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "tr"}
SHORT, LONG_WORDS, LINKS, STOP_LOW, STOP_HIGH = 10, 25, 0.5, 0.05, 0.2


@dataclass
class Block:
    text: str
    heading: bool
    outside: bool
    hinted: int  # number of the innermost element around it that looks outside by a hint, 0 for none
    region: int  # number of the article or main element around it, 0 for none
    article: int  # number of the article element around it, 0 for none
    linked: int  # characters inside links
    group: int  # number of the container
    beside: bool = False  # in a container without the article, though the page has one
    label: str = ""


def _hints(name: str, value: str, within: bool) -> bool:
    """Whether class names or ids look like something outside the main text.

    One word of a name is enough outside an article.  Within one a whole name has to say so, and of elements with text of
    their own every name: `legal-history`, `social-history` and a table of `share prices` are content.
    """
    names = [{w for w in re.split(r"[^a-z]+" if within else r"[^a-z0-9]+", c) if len(w) > 1} for c in value.split()]
    looks = [bool(words & (HINTS | {"header"})) and not words & LAYOUT and (not within or words <= HINTS | NEUTRAL | {"header"}) for words in names]
    return all(looks) and bool(looks) if within and name in CONTENT else any(looks)


def _outside(name: str, attributes: str, within: bool = False) -> str:
    """'hard' for elements that are never main text, 'hint' for those that only look so (`within` an article or not), else ''."""
    if name in OUTSIDE and name not in WRAPPERS:
        return "hard"
    found = "hint" if name in WRAPPERS else ""
    if not attributes:
        return found
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key in ("class", "id"):
            if name not in ("html", "body") and name not in MAIN and _hints(name, value, within):
                found = "hint"
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return "hard"
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return "hard"
    return "hard" if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes, re.I) else found


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; entities are decoded, white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, int, int]] = []  # open elements: name, outside, hinted, region, article, group
    open_: Counter[str] = Counter()
    around: list[tuple[int, set[str]]] = [(0, set())]  # of each hinted element: the hinted one around it; which of article and main are in it
    parts: list[str] = []
    parents = [0]  # of each container: the one around it
    held = {"main": [0], "article": [0]}  # of each main and article element: the container around it
    linked = links = 0
    heading = False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                outside, hinted, region, article, group = stack[-1][1:] if stack else (False, 0, 0, 0, 0)
                out.append(Block(text, heading, outside, hinted, region, article, linked, group))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(k: int) -> None:
        flush()
        open_.subtract(s[0] for s in stack[k:])
        del stack[k:]

    def last_open(name: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, ending = m[2].lower(), m[1] == "/"
        if name in RAW:
            if not ending and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            links = max(0, links - 1) if ending else 1
        elif name == "br":
            add(" ")
        elif name in BLOCK or not ending and name not in VOID and m[3] and _outside(name, m[3], bool(stack) and stack[-1][3] > 0):
            links = 0
            if ending:
                if open_[name] > 0:
                    close(last_open(name))
                else:
                    flush()
            else:
                flush()
                if name not in VOID:
                    if stack and (name in IMPLIED.get(stack[-1][0], ()) or stack[-1][0] == "p" and name in CLOSES_P):
                        close(len(stack) - 1)
                    outside, hinted, region, article, group = stack[-1][1:] if stack else (False, 0, 0, 0, 0)
                    how = _outside(name, m[3], region > 0)
                    if how == "hint":
                        around.append((hinted, set()))
                        hinted = len(around) - 1
                    if name in MAIN and not outside:
                        around[hinted][1].add(name)
                    if name in MAIN and not region:
                        held["main"].append(group)
                        region = len(held["main"]) - 1
                    if name == "article" and not article:
                        held["article"].append(group)
                        article = len(held["article"]) - 1
                    if name not in LEAVES:
                        parents.append(group)
                        group = len(parents) - 1
                    stack.append((name, outside or how == "hard", hinted, region, article, group))
                    open_[name] += 1
            heading = bool(stack) and stack[-1][0] in HEADING
        elif ending and open_[name] > 0:
            close(last_open(name))
    flush()
    settle(out, around)
    mark_beside(out, parents, held)
    return out


def prose(b: Block, least: int) -> bool:
    """At least so many words, few of them linked, and a fair share of stop words."""
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    return not b.heading and b.linked <= LINKS * len(b.text) and len(words) >= least and (stop >= STOP_HIGH or len(words) >= LONG_WORDS and stop >= STOP_LOW)


def looks_good(b: Block) -> bool:
    """Prose by length, stop words and links; in an article the length will do."""
    if b.region and not b.heading and b.linked <= LINKS * len(b.text) and len(b.text.split()) >= SHORT:
        return True
    return prose(b, SHORT)


def settle(blocks: list[Block], around: list[tuple[int, set[str]]]) -> None:
    """Decide which hinted elements are outside: not those that hold a main element or most of the page's prose.

    Prose in an article without hints makes the other hints hold, as comments and related articles are prose too; without
    it, prose in articles counts before other prose, and with no prose at all an article clears what is around it.
    """
    if len(around) == 1:
        return
    good = [b for b in blocks if not b.outside and looks_good(b)]
    good = [b for b in good if b.region] or good
    held = [0] * len(around)
    for b in good:
        held[b.hinted] += len(b.text)
    for k in range(len(around) - 1, 0, -1):
        parent, names = around[k]
        held[parent] += held[k]
        around[parent][1].update(names)

    def inside(cleared: list[bool]) -> list[bool]:
        out = [True]
        for (parent, _), ok in zip(around[1:], cleared[1:]):
            out.append(ok and out[parent])
        return out

    cleared = ["main" in names for _, names in around]
    fine = inside(cleared)
    if not any(b.region and fine[b.hinted] for b in good):
        fine = inside([c or h * 2 > held[0] or not held[0] and bool(names) for c, h, (_, names) in zip(cleared, held, around)])
    for b in blocks:
        b.outside = b.outside or not fine[b.hinted]


def mark_beside(blocks: list[Block], parents: list[int], held: dict[str, list[int]]) -> None:
    """Mark blocks in containers that hold no article, on pages with an article (else with a main element).

    Each container is passed once, so the work is linear.
    """
    name = "article" if any(b.article and not b.outside for b in blocks) else "region"
    around = held["article" if name == "article" else "main"]
    numbers = {n for b in blocks if not b.outside and (n := getattr(b, name))}
    if not numbers:
        return
    holds = {0}
    for n in numbers:
        group = around[n]
        while group not in holds:
            holds.add(group)
            group = parents[group]
    for b in blocks:
        b.beside = not getattr(b, name) and b.group not in holds


def drops_links(b: Block, linked: Counter[int], size: Counter[int]) -> bool:
    """Whether a block is bad by its links: never in an article; headings and blocks of a main element by their container."""
    if b.linked <= LINKS * len(b.text) or b.article:
        return False
    return not (b.heading or b.region) or linked[b.group] > LINKS * size[b.group]


def decide(blocks: list[Block]) -> None:
    """Pass one: label blocks 'good' or 'bad'; headings, short blocks and prose without stop words stay ambiguous.

    So do linked blocks of an article, which may be a title or its sources, and prose of middle length that is alone in its
    container, as notices are.  Around an article only long prose counts, in a container without the article only if it
    has no less of it than the articles, as comments are prose too.  With no good block at all the container with most of
    the other text is main, one of several blocks first.
    """
    article = any(b.region and not b.outside for b in blocks)
    together = Counter(b.group for b in blocks)
    linked, size, aside = Counter(), Counter(), Counter()
    told = 0
    for b in blocks:
        linked[b.group] += b.linked
        size[b.group] += len(b.text)
        if not b.outside and b.beside and prose(b, LONG_WORDS):
            aside[b.group] += len(b.text)
        elif not b.outside and not b.beside and b.region and looks_good(b):
            told += len(b.text)
    for b in blocks:
        if b.outside or drops_links(b, linked, size):
            b.label = "bad"
        elif article and (not b.region or b.beside):
            b.label = "good" if prose(b, LONG_WORDS) and (not b.beside or aside[b.group] >= told) else "bad"
        elif looks_good(b) and (b.region or together[b.group] > 1 or prose(b, LONG_WORDS)):
            b.label = "good"
    if not article and not any(b.label == "good" for b in blocks):
        size: Counter[int] = Counter()
        for b in blocks:
            if not b.label:
                size[b.group] += len(b.text)
        if size:
            most = max(size, key=lambda g: (together[g] > 1, size[g], -g))
            for b in blocks:
                b.label = b.label or ("good" if b.group == most else "")


def nearest(labels: list[str], keys: list[int]) -> list[tuple]:
    """For each block the (distance, label) of the decided blocks of its key before and after it, None where there is none."""
    before, after, last = [], [None] * len(labels), {}
    for i, (label, key) in enumerate(zip(labels, keys)):
        before.append((i - last[key][0], last[key][1]) if key in last else None)
        if label:
            last[key] = (i, label)
    last = {}
    for i in range(len(labels) - 1, -1, -1):
        key = keys[i]
        after[i] = (last[key][0] - i, last[key][1]) if key in last else None
        if labels[i]:
            last[key] = (i, labels[i])
    return list(zip(before, after))


def inherit(blocks: list[Block]) -> None:
    """Pass two: ambiguous blocks take the label of the nearest decided block; a heading looks ahead first.

    Blocks of the same container come first, then those of the same article, without what is outside by its element or name,
    then all, with the page's edges as bad.  At
    equal distances main text wins inside a container or article and loses outside.  In an article without any decided
    block all are main text.
    """
    first = [b.label for b in blocks]
    inner = ["" if b.outside else b.label for b in blocks]
    group, region = (nearest(inner, keys) for keys in ([b.group for b in blocks], [b.region for b in blocks]))
    all_ = nearest(first, [0] * len(blocks))
    for i, b in enumerate(blocks):
        if first[i]:
            continue
        left, right = group[i]
        if not (left or right) and b.region:
            left, right = region[i]
        inside = bool(left or right)
        if not inside and b.region:
            b.label = "good"
            continue
        if not inside:
            left, right = all_[i]
            left, right = left or (i + 1, "bad"), right or (len(blocks) - i, "bad")
        if b.heading and right:
            b.label = right[1]
        elif left and right and left[0] == right[0]:
            b.label = ("good" if "good" in (left[1], right[1]) else "bad") if inside else "good" if left[1] == right[1] == "good" else "bad"
        else:
            b.label = min(x for x in (left, right) if x)[1]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    decide(blocks)
    inherit(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Null html counts as empty, and a page without main text gives an empty text.  Broken markup is read as far as it can
    be: unclosed elements end with their parent, an unclosed script, comment or tag ends with the page.  Buttons and other
    controls count as forms.  In an article neither links nor a word of a class name drop a block by themselves.  Repeated rows are all
    returned; other columns are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def extract(texts, batch):
        found = [main_text(t) for t in texts]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

    return map_texts(rows, "html", "page_id long, url string, text string, n_chars long", extract)
