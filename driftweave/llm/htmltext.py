"""Main text of web pages by the maximum-scoring subsequence of their tokens.

Words score positive and tags negative, with weights that are log odds of being main text, learnt from labelled pages. A
linear scan finds the run of blocks of tokens with the largest sum. Blocks inside that run that stand in a marked side container
(menu, advert, form, comments, ...) are left out. Such words score a little below zero, so that a run may cross them but
never begins or ends in them.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, text_batches

#: The least share of a page's words that its articles hold where words outside them count as such.
ARTICLE_SHARE = 0.25
#: What stands in a tag behind its name. A quote that does not end before white space, a slash or the tag's end is a stray
#: one, so that the tag ends at the first '>'.
_REST = r"""(?:[^>"']|"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*(?:["'][^>]*)?"""
#: A comment, the raw text elements with their content, any other declaration, or a tag with its attributes.
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|title|iframe)\b{_REST}(?:>|\Z).*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})(?:>|\Z)""", re.S | re.I)
#: An attribute, whatever its name, with its value; quoted text without a name is passed over.
_ATTR = re.compile(r"""(?:"[^"]*"|'[^']*'|([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?)""")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
#: Elements that hold no main text and end at their own end tag; without one, or closed in themselves, they hold nothing.
_CLOSED = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("svg", "math", "object", "select", "template")}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr caption thead tbody tfoot blockquote pre section article header footer nav aside figure figcaption hr main body html address details summary form fieldset center head menu dialog".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements that hold no main text.
SIDE = frozenset("nav footer aside form button menu dialog label input head option".split())
#: Words in class, id or role that mark a side container wherever they stand in a name.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation topbar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr popup newsletter subscribe subscription signup signin login comment comments disqus pagination tagcloud complementary contentinfo outbrain taboola teaser".split()
)
#: Words that mark one only in a name made of such words and of `_BUILT`: a "share-price" or "related-work" speaks of something else.
_UNSURE = frozenset("banner menu notice notices share sharing social related recommended recommendations reply replies toolbar pager tags copyright modal overlay promotion search skip form dialog".split())
#: Words that mark one as `_UNSURE` do, but not inside an article, where they are more often its subject.
_TOPICS = frozenset("side alert legal discussion trending popular respond responses header head top".split())
#: Words that say how a container is built or where it stands.
_BUILT = frozenset(
    "box list widget block section posts post articles article stories story links link container wrapper wrap area module bar items item content main site page left right bottom global primary secondary inner outer region panel row col column group card cards buttons button icons media news inline mobile desktop slot unit sticky fixed title heading more also read entry toggle dropdown mega user holder first last latest new small large big dark light full half md lg sm xs strip rail zone layer drawer trigger info meta theme default custom".split()
)
_CERTAIN, _NAMES = SIDE_WORDS, SIDE_WORDS | _UNSURE | _TOPICS | _BUILT
#: Classes, ids and roles that mark one as a whole; as part of a longer name they say how a container looks or was built.
_WHOLE = frozenset("hidden visually-hidden widget".split())
#: Words that keep the page's head words from marking a container.
_OWN_WORDS = frozenset("article entry post story content main body text title page".split())
#: Words that turn a mark round: a class like "with-sidebar" or "no-ads" speaks of something else.
_ABOUT = frozenset("with without has have no not show hide is js".split())
#: A start tag closes open elements of these names, up to the nearest open element that bounds it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
_CELL = ("table", "td", "th", "caption")
_BOUNDS = {"li": ("ul", "ol", "menu", *_CELL), "dt": ("dl", *_CELL), "dd": ("dl", *_CELL), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: End tags of these reach over the cells of a table; others end at them.
_OVER_CELLS = frozenset("table tr td th thead tbody tfoot caption body html article main section".split())


def _side(tag: str, attrs: str, in_article: bool, lenient: bool = False) -> bool:
    if tag in SIDE and not (lenient and tag == "form") or (tag == "header" and not in_article and not lenient):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and not value.lower() == "until-found":
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html", "main") and not lenient:
            for part in value.split():
                if part.lower() in _WHOLE:
                    return True
                words = {x.lower() for x in _WORDS.findall(part)}
                if words & _ABOUT:
                    continue
                if words & _CERTAIN:
                    return True
                if words <= _NAMES and (words & _UNSURE or not in_article and words & _TOPICS and not (words & _OWN_WORDS or tag in ("h1", "h2"))):
                    return True
    return False


class _Open:
    """The open elements of a page. Every step takes constant time, or takes an element away."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool]] = []  # name, kind of side container ('', 'block' or 'inline'), article or main
        self.at: dict[str, list[int]] = {}
        self.block_side = self.inline_side = self.links = self.articles = 0

    def _count(self, entry: tuple[str, str, bool], by: int) -> None:
        name, side, own = entry
        self.block_side += by * (side == "block")
        self.inline_side += by * (side == "inline")
        self.links += by * (name == "a")
        self.articles += by * own

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, side: str, own: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.at.setdefault("*", []).append(len(self.stack))
        self.stack.append((name, side, own))
        self._count(self.stack[-1], 1)

    def pop(self) -> None:
        entry = self.stack.pop()
        if entry[0]:
            self.at[entry[0]].pop()
            if entry[0] in BLOCK:
                self.at["*"].pop()
            self._count(entry, -1)

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            self.pop()

    def start(self, name: str) -> None:
        """Closes what the start tag of an element closes: its like, and a paragraph before any block."""
        if name in _CLOSES and (i := self.last(*_CLOSES[name])) > self.last(*_BOUNDS[name]):
            self.pop_to(i)
        if name in BLOCK and (i := self.last("p")) > self.last(*_CELL, "button", "object"):
            self.pop_to(i)
        if name == "a" and (i := self.last("a")) > self.last("*"):
            self.pop_to(i)

    def end(self, name: str) -> None:
        i = self.last(name)
        if i < 0 or name not in _OVER_CELLS and self.last(*_CELL) > i:
            return
        if name not in BLOCK and self.last("*") > i:  # blocks inside an inline element stay open
            self.at[name].pop()
            self._count(self.stack[i], -1)
            self.stack[i] = ("", "", False)
        else:
            self.pop_to(i)


def tokens(page: str, lenient: bool = False) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, text, mark, inside): kind is 'tag:<name>' or a kind of words; mark is 'block' or 'inline' where a side container
    of that kind holds the token, and inside tells whether an article does.

    `lenient` takes only elements that are side containers by name, not forms, headers or what attributes say.
    """
    held = _Open()
    at = 0

    def mark() -> str:
        return "block" if held.block_side else "inline" if held.inline_side else ""

    def words(raw: str) -> tuple[str, str, str, bool]:
        m = mark()
        return ("word:side" if m else "word:link" if held.links else "word:text"), _html.unescape(raw), m, held.articles > 0

    unclosed: set[str] = set()  # elements without an end tag in the rest of the page
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield words(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _CLOSED and not m[2]:
            if _SELF_CLOSED.search(m[4]):
                continue
            end = None if tag in unclosed else _CLOSED[tag].search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
        if m[2]:
            was, inside = mark(), held.articles > 0  # the end of a side container belongs to it
            held.end(tag)
            yield f"tag:{tag}", "", was, inside
            continue
        held.start(tag)
        own = tag in ("article", "main")
        side = _side(tag, m[4] or "", held.articles > 0, lenient)
        if own and not side and not held.articles:
            while held.block_side or held.inline_side:  # an unclosed advert or menu before the article does not hold it
                held.pop()
        if tag not in VOID and not _SELF_CLOSED.search(m[4]):
            held.push(tag, ("block" if tag in BLOCK else "inline") if side else "", own)
        yield f"tag:{tag}", "", mark(), held.articles > 0
    if at < len(page):
        yield words(page[at:])


def blocks(page: str, weights: dict[str, float] | None = None, lenient: bool = False) -> list[tuple[str, float, bool, Counter]]:
    """The page's blocks in order: text, score, marked, and counts of its kinds of tokens.

    Words of an inline side element are left out of their block, which goes on behind it. Where articles hold a fair share
    of the page's words, words outside them are of a kind of their own.
    """
    held: list[tuple[str, bool, bool, Counter]] = []
    parts: list[str] = []
    kinds: Counter = Counter()
    was = within = False

    def close() -> None:
        nonlocal parts, kinds
        text = " ".join("".join(parts).split())
        if text or kinds:
            held.append((text, was, within, kinds))
        parts, kinds = [], Counter()

    for kind, text, mark, inside in tokens(page, lenient):
        marked = mark == "block" or mark == "inline" and was
        if kind[:4] == "tag:" and kind[4:] in BLOCK:
            close()
            was, within = mark != "", inside
        elif marked != was:
            close()
            was, within = marked, inside
        if kind[:4] == "tag:":
            if kind in ("tag:br", "tag:td", "tag:th", "tag:option"):
                parts.append(" ")
            kinds[kind] += 1
        else:
            if was or not mark:
                parts.append(text)
            kinds[kind] += len(text.split())
    close()

    count = [0, 0]
    for _, marked, inside, own in held:
        count[inside] += 0 if marked else own["word:text"]
    out = []
    for text, marked, inside, own in held:
        if not inside and ARTICLE_SHARE * sum(count) <= count[1] > 0 and own["word:text"]:
            own["word:outside"] = own.pop("word:text")
        # in a side container only words count, so that its tags do not cut the text around it in two
        score = sum((weights.get(k, weights["tag:*"] if k[:4] == "tag:" else -0.5)) * n for k, n in own.items() if not marked or k[:4] != "tag:") if weights else 0.0
        out.append((text, score, marked, own))
    return out


def fit_weights(pages: list[tuple[str, str]]) -> dict[str, float]:
    """Log odds of each kind of token of being main text, from pages with their main text; words are at most 1, tags at most 0."""
    inside, outside = Counter(), Counter()
    for page, main in pages:
        own = set(main.split("\n\n"))
        found = blocks(page)
        hits = [i for i, (text, _, marked, _) in enumerate(found) if text in own and not marked]
        for i, (text, _, marked, kinds) in enumerate(found):
            # blocks without text between those of the main text are tags that belong to it
            within = hits and hits[0] <= i <= hits[-1] and not marked and (not text or text in own)
            (inside if within else outside).update(kinds)
    kinds = set(inside) | set(outside)
    a, b = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    odds = {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in kinds}
    weights = {k: max(-3.0, min(1.0 if k[:5] == "word:" else 0.0, v)) for k, v in odds.items()}
    weights["word:text"] = max(0.5, weights.get("word:text", 1.0))
    weights["word:side"] = -0.05  # a run may cross a side container
    weights["tag:*"] = -0.5  # tags of no labelled page
    return {k: v / 4 if k[:4] == "tag:" else v for k, v in weights.items()}


def labelled_pages(first: int = 0, count: int = 24) -> list[tuple[str, str]]:
    """Pages of a few common layouts, made from a rule, with their main text: what the default weights are learnt from.

    Pages of other numbers than the first 24 are there for tests.
    """
    def words(n: int, seed: int) -> str:
        x, out = seed * 7919 + 17, []
        for _ in range(n):
            x = (x * 1103515245 + 12345) % 2**31
            out.append("".join("bcdfghklmnprst"[(x >> 7 + 3 * i) % 14] + "aeiou"[(x >> 5 + 2 * i) % 5] for i in range(1 + x % 3)))
        return " ".join(out)

    inline = ("em", "strong", "b", "i", "code", "span", "sup", "sub", "small", "cite", "q", "mark", "abbr", "time", "u", "a")
    out = []
    for seed in range(first, first + count):
        title, paras = words(6, seed), [words(4 + (seed * 13 + i * 29) % 60, 100 * seed + i) + "." for i in range(3 + seed % 6)]
        menu = "".join(f'<li><a href="/{i}">{words(2, seed + i)}</a></li>' for i in range(5 + seed % 7))
        body, main = f"<h1>{title}</h1>", [title]
        for i, p in enumerate(paras):
            head, _, tail = p.partition(" ")
            mark = inline[(seed + 3 * i) % len(inline)]
            if i % 2 == 0:
                said, _, tail = tail.partition(" ")
                tail = f"<a href=x>{said}</a> {tail}"
            body += f"<p><{mark}>{head}</{mark}> {tail}</p>"
            main.append(p)
            part = [words(3 + (seed + i + j) % 9, 1000 * seed + 10 * i + j) for j in range(3)]
            match (seed + i) % 7:
                case 0:
                    body += "<ul>" + "".join(f"<li>{x}</li>" for x in part) + "</ul>"
                    main += part
                case 1:
                    body += f"<h2>{part[0]}</h2><blockquote><p>{part[1]}</p></blockquote>"
                    main += part[:2]
                case 2:
                    rows = [f"{seed + j} {7 * j + i} {part[j].split()[0]}" for j in range(3)]
                    body += "<table><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r.split()) + "</tr>" for r in rows) + "</tbody></table>"
                    main += rows
                case 3:
                    body += f"<figure><img src=x><figcaption>{part[0]}</figcaption></figure><h3>{part[1]}</h3><pre>{part[2]}</pre>"
                    main += part
                case 4:
                    body += f"<ol><li>{part[0]}</li></ol><dl><dt>{part[1]}</dt><dd>{part[2]}</dd></dl><hr>"
                    main += part
        body += f"<p>{words(9, seed + 5)}.</p>"
        main.append(words(9, seed + 5) + ".")
        ad, foot = f'<div class="ad">{words(9, seed + 1)}.</div>', f"<footer>&copy; {words(5, seed + 2)}</footer>"
        aside = f"<aside><h3>{words(2, seed)}</h3><ul>{menu}</ul></aside>"
        stray = f"<div>{words(25, seed + 3)}.</div>"
        comments = '<section id="comments">' + "".join(f'<div class="comment"><p>{words(14, seed + i)}.</p></div>' for i in range(4)) + "</section>"
        page = [
            f"<nav><ul>{menu}</ul></nav>{ad}<article>{body}</article>{stray}{foot}",
            f'<header><a href="/">{words(3, seed)}</a></header><div id="menu"><ul>{menu}</ul></div><main>{body}</main>{aside}{foot}',
            f'<div><ul>{menu}</ul></div><div class="content">{body}</div><div><ul>{menu}</ul></div>{foot}',
            f"<nav>{menu}</nav>{stray}<article>{body}</article>{comments}<form><input name=q><button>{words(1, seed)}</button></form>{foot}",
        ][seed % 4]
        out.append((f"<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>", "\n\n".join(main)))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and end of the run of scores with the largest sum above zero, the first and then shortest of equal ones; (0, 0) without any."""
    best = total = 0.0
    start = first = end = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str, weights: dict[str, float]) -> str:
    """Main text of one page; '' where no token scores above zero, also if only side containers by name count."""
    for lenient in (False, True):
        found = blocks(page, weights, lenient)
        first, end = best_run([score for _, score, _, _ in found])
        if text := "\n\n".join(text for text, _, marked, _ in found[first:end] if text and not marked):
            return text
    return ""


def extract(pages: DataFrame, weights: dict[str, float] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page.

    A null or empty page, or one without main text, has the text ''; repeated rows stay, an empty table gives an empty
    table, extra columns are left out whatever their names, and pages of any length are read whole in one pass.
    """
    weights = weights or fit_weights(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([main_text(x, weights) for x in texts], pa.string())], names=["page_id", "url", "text"])

    slim = narrow(pages, page_id=page_id, url=url, html=html)
    return slim.mapInArrow(run, slim.withColumnRenamed("html", "text").schema)
