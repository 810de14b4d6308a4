"""Main text of web pages by tag-path ratios.

The page is cut into text nodes, each under its root-to-leaf path of open tags, with a mark where a
tag's class, id or role names boilerplate (whole names only). Per path, text length and punctuation are summed; a path's
ratio is its characters per node, raised by its punctuation. Ratios are smoothed over neighbouring nodes
of the page and fused with the ratio of the container that the path belongs to. Nodes of paths over a
share of the page's best ratio are content; short parts of the chosen containers (lists, tables, headings)
and a heading at their head stay with them.
Nodes under boilerplate tags never count, but a tag that holds article or main, or a form with most of the
text, is none; a mark lowers ratios to LOWERED, and counts on no tag of these kinds nor on one with most of
the text. Reader comments never count, whatever their share: what stands below a tag named so (unless it
holds article or main) or after a heading that counts or asks for comments; on a page without any other
text they are its text. Each page is worked on alone, in one pass.

Defined cases: a null, empty or text-free page gives an empty text; unclosed and stray tags are
tolerated as browsers do for paragraphs, list items and table cells; unknown character references stay;
page_id and url pass through, repeated rows keep one result each; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the best fused ratio that content needs, and the smoothing weights of the neighbours on either side.
SHARE, SMOOTHING = 0.25, (0.25, 0.5, 0.25)
#: Tags (fixed by the HTML standard) without content, that start a block, never close, or hold no article text.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form button select option label menu head dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of classes, ids and roles that mark boilerplate: alone, with each other, or after a word for the whole page.
_MARK = (r"(?:nav\w*|menu\w*|foot\w*|head(?:er)?|banner|side\w*|ad|ads|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|alert|"
         r"comment\w*|repl(?:y|ies)|disqus|share|sharing|social|related|recommend\w*|breadcrumb\w*|subscri\w*|newsletter|popup|modal|login|"
         r"search\w*|pagination|pager|tags?|toolbar|widget\w*|copyright|legal|byline|meta|skip\w*|hidden)")
MARKS = re.compile(rf"(?<!\S)(?:(?:site|page|global|main)[_-])?{_MARK}(?:[_-]{_MARK})*(?!\S)".replace(r"\w", "[^\\W_]"), re.I)
#: Names of reader comments: a comment word alone, with a part of a list of comments, or with further words, but not the word for whether comments are open.
COMMENTS = re.compile(r"(?<!\S)(?:(?:users?|readers?|visitors?|post|article|blog|page|entry|fb|facebook|wp|div|li|view)[_-])?"
                      r"(?:comments?(?:area|list|body|text|box|block|section|thread|wrap|form)?|disqus|repl(?:y|ies)|respond|responses)"
                      r"(?![_-](?:open|closed|enabled|disabled|allowed|on|off)(?!\S))(?:[_-]\S*|\d+)?(?!\S)", re.I)
#: Headings over reader comments without names: how many there are, or the call for one.
COMMENT_HEADING = re.compile(r"\d[\d.,]*\s+(?:reader\s+|user\s+)?(?:comments?|responses?|repl(?:y|ies)|thoughts?\s+on)\b|(?:leave|post|add|write)\s+(?:a|your)\s+(?:comment|reply)\b", re.I)
#: What a mark leaves of a ratio, and the share of the page's text that is most of it.
LOWERED, MOST = 0.2, 0.75
CONTENT = frozenset({"article", "main"})
#: An end tag or a start tag closes open paragraphs and items of these kinds.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section main div nav aside header footer form body blockquote td th".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；！？]")


class Element:
    """An open tag: whether it is outside the content, by its tag or hidden, or marked, or reader comments; and what text it holds."""

    __slots__ = ("tag", "outside", "hidden", "marked", "comment", "chars", "content")

    def __init__(self, tag: str, outside: bool, hidden: bool, marked: bool, comment: bool) -> None:
        self.tag, self.outside, self.hidden, self.marked, self.comment, self.chars = tag, outside, hidden, marked, comment, 0
        self.content = tag in CONTENT and not comment


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    outside: bool
    marked: bool
    chain: tuple[Element, ...]


def text_blocks(page: str) -> list[Block]:
    """The blocks of text in page order; inline tags join the block around them."""
    found: list[tuple[tuple[Element, ...], str]] = []
    stack: list[Element] = []
    held: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                found.append((tuple(stack), text))
                hidden = any(e.hidden for e in stack)
                content = False
                for e in reversed(stack):
                    e.chars += 0 if hidden else len(text)
                    content = e.content = e.content or content
            held.clear()

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag == "br":
                held.append(" ")
            elif any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            closing = CLOSES.get(tag) or {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in closing:
                    del stack[k:]
                    break
                if stack[k].tag in FENCES:
                    break
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m[3]))
        outside = tag in OUTSIDE and not (tag == "header" and any(e.tag in CONTENT for e in stack))
        if not m[3].endswith("/"):
            stack.append(Element(tag, outside, bool(_HIDDEN.search(m[3])) and tag not in ("html", "body"), bool(MARKS.search(named)),
                                 tag not in ("html", "body") and bool(COMMENTS.search(named))))
    flush()
    total = sum(len(t) for chain, t in found if not any(e.hidden for e in chain))

    def most(e: Element) -> bool:
        return e.content or e.chars >= MOST * total

    blocks = [Block(tuple(e.tag for e in chain if e.tag in BLOCKS), text,
                    any(e.hidden or e.outside and not (e.content or e.tag == "form" and most(e)) for e in chain),
                    any(e.marked and e.tag not in ("html", "body") and not most(e) for e in chain),
                    tuple(e for e in chain if e.tag in BLOCKS)) for chain, text in found]
    said = _comments([chain for chain, _ in found], blocks)
    # where nothing else is on the page, what is named like comments is its text
    if all(s or b.outside or b.marked for s, b in zip(said, blocks, strict=True)):
        return blocks
    return [b._replace(outside=b.outside or s) for b, s in zip(blocks, said, strict=True)]


def _comments(chains: list[tuple[Element, ...]], blocks: list[Block]) -> list[bool]:
    """Which blocks are reader comments: below a tag so named, or after a heading that counts or asks for them, up to the next heading of its kind."""
    found = []
    under, level = None, ""
    for chain, block in zip(chains, blocks, strict=True):
        heading = block.path[-1] if block.path and block.path[-1] in HEADINGS else ""
        if under is not None and (under not in chain or heading and heading <= level):
            under = None
        if under is None and heading and len(block.chain) > 1 and COMMENT_HEADING.match(block.text):
            under, level = block.chain[-2], heading
        found.append(under is not None or any(e.comment and not e.content for e in chain))
    return found


def _short_parts(blocks: list[Block], chosen: np.ndarray) -> list[int]:
    """Blocks in the containers of the chosen ones, without article or main to tell; in a bare body, those between them."""
    ids = np.flatnonzero(chosen)
    if not len(ids) or any(CONTENT & set(blocks[i].path) for i in ids):
        return []
    size: Counter = Counter()
    parents, depth = set(), {}
    for i in ids:
        around = [e for e in blocks[i].chain[:-1] if e.tag not in ("html", "body")]
        parents.update(around[-1:])
        for k, e in enumerate(around):
            size[e] += len(blocks[i].text)
            depth[e] = k
    total = sum(len(blocks[i].text) for i in ids)
    whole = max((e for e in size if 2 * size[e] > total), key=depth.__getitem__, default=None)
    homes = {e for e in parents if 2 * size[e] >= e.chars} | ({whole} if whole else set())
    marked = any(blocks[i].marked for i in ids)
    return [i for i, b in enumerate(blocks) if not b.outside and (marked or not b.marked)
            and (not homes.isdisjoint(b.chain) or whole is None and ids[0] < i < ids[-1])]


def content_blocks(blocks: list[Block], share: float = SHARE) -> list[bool]:
    """Which blocks are content, by fused and smoothed tag-path ratios."""
    n = len(blocks)
    chars = np.array([0 if b.outside else len(b.text) for b in blocks], dtype=float)
    marks = np.array([0 if b.outside else len(_PUNCTUATION.findall(b.text)) for b in blocks], dtype=float)
    if not chars.sum():
        return [False] * n
    weight = np.array([LOWERED if b.marked else 1.0 for b in blocks])
    paths: dict[tuple, list[int]] = defaultdict(list)
    holders: dict[tuple, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        if not b.outside:
            paths[b.path, b.marked].append(i)
            holders[b.path[:-1], b.marked].append(i)

    def ratio(ids: list[int]) -> float:
        return chars[ids].sum() / len(ids) * (1 + np.log1p(marks[ids].sum() / len(ids)))

    own, held = np.zeros(n), np.zeros(n)
    for ids in paths.values():
        own[ids] = ratio(ids)
    for (path, _), ids in holders.items():
        # a container weighs by all its text; one that is the article by its tag weighs double
        held[ids] = ratio(ids) * np.sqrt(chars[ids].sum()) * (2 if CONTENT & set(path) else 1)
    own, held = own * weight, held * weight
    padded = np.pad(own, 1, mode="edge")
    smooth = SMOOTHING[0] * padded[:-2] + SMOOTHING[1] * padded[1:-1] + SMOOTHING[2] * padded[2:]
    fused = (0.5 * smooth / max(smooth.max(), 1e-9) + 0.5 * held / max(held.max(), 1e-9)) * weight
    inside = chars > 0
    by_path = np.zeros(n)
    for ids in paths.values():
        by_path[ids] = fused[ids].max()
    limit = share * by_path[inside].max()
    chosen = inside & (by_path >= limit)
    if any(CONTENT & set(blocks[i].path) for i in np.flatnonzero(chosen)):
        chosen &= np.array([bool(CONTENT & set(b.path)) for b in blocks])
    chosen[_short_parts(blocks, chosen)] = True
    # short parts of the chosen containers (headings, list items, last lines) belong to the text
    homes = {(blocks[i].path[:-1], blocks[i].marked) for i in np.flatnonzero(chosen)}
    for i, (path, _, outside, marked, _) in enumerate(blocks):
        if not outside and not chosen[i]:
            chosen[i] = any(path[:len(h)] == h for h, k in homes if k == marked and CONTENT & set(h)) or (
                path[-1:] and path[-1] in HEADINGS and (path[:-1], marked) in homes)
        # a heading right before a chosen block, outside its container
        if chosen[i] and i and blocks[i - 1].path[-1:] and blocks[i - 1].path[-1] in HEADINGS and not blocks[i - 1].outside and not (blocks[i - 1].marked and not marked):
            chosen[i - 1] = True
    return chosen.tolist()


def main_text(page: str | None) -> str:
    blocks = text_blocks(page or "")
    return "\n\n".join(b.text for b, c in zip(blocks, content_blocks(blocks), strict=True) if c)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars, the text's code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
