"""Main text of web pages: block features, then two passes of block rules.

Markup is cut into blocks.  Pass one decides the clear cases from stop-word density, length,
link density and the containers a block stands in; short blocks that could be either stay open.
Pass two gives every open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he in is it not of on or she that the they this to was we were which with you
    au aux avec ce ces dans de des du elle en est et il la le les leur ne on ou par pas pour qu que qui se sur un une
    aber als am auf aus bei das dem den der des die ein eine er es für hat im in ist mit nicht sich sie sind und von wie zu
    al como con de del el en es la las lo los más no o para pero por que se sin su un una y
    """.split()
)
# Elements that never hold main text, elements that end a block, and words in
# class, id or role that name furniture of a page.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas head title select textarea audio video map".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul
    """.split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = frozenset(
    """
    ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo
    promoted promotion related replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe
    tags toolbar widget widgets
    """.split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

# A quote only counts after an equals sign; what is open at the end of the page ends there, so no place is read twice.
INSIDE = r"""(?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|svg|iframe|textarea|title)\b{INSIDE}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+)({INSIDE})(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
# First parts of names that tell what an element is about or has beside it, not what it is; words that also
# name the layout around an article.
TELLING, LAYOUT = frozenset("has with tag category".split()), frozenset("sidebar sidebars".split())
# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han, Yi.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    """Text of one block and where it stands."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    furniture: bool = False
    article: int = 0
    heading: bool = False
    label: str = ""

    def close(self) -> Block:
        self.text = " ".join("".join(self.parts).split())
        self.words = self.text.split()
        return self


def is_hidden(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and UNSHOWN.search(value):
            return True
    return False


def is_furniture(tag: str, attributes: str, in_article: bool) -> int:
    """Does this element hold menus, adverts, notices, forms, sidebars or comments?  1 if it may only be the layout around an article."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return 2
    if tag in ("html", "body", "article", "main") or not attributes:
        return 0
    if is_hidden(attributes):
        return 2
    mark = 0
    for name, *values in NAMES.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return 2
        else:
            for word in value.split():
                parts = [p.lower() for p in PARTS.findall(word)]
                named = NAMED.intersection(parts)
                if named and parts[0] not in TELLING:
                    mark = max(mark, 1 if len(parts) > 1 and named <= LAYOUT else 2)
    return mark


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; an element that is never closed ends with its parent."""
    stack: list[tuple[str, int, bool]] = []  # tag, furniture so far, link
    out, now, last, article, articles = [], Block(), 0, 0, 0

    def text(upto: int) -> None:
        if upto > last:
            piece = html.unescape(page[last:upto])
            now.parts.append(piece)
            if any(link for _, _, link in stack):
                now.linked += len(piece.split())

    def flush() -> None:
        nonlocal now
        now.close()
        if now.words:
            out.append(now)
        top = stack[-1] if stack else ("", 0, False)
        inside = any(t in ("article", "main") for t, _, _ in stack)
        now = Block(furniture=top[1] > 0, article=article if inside else 0, heading=any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, _, _ in stack))

    for m in TOKEN.finditer(page):
        text(m.start())
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                del stack[depth:]
        elif tag not in EMPTY and not m[4].endswith("/"):
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and any(t == tag for t, _, _ in stack[-3:]):
                # an open paragraph or item ends where the next one begins, with the inline elements in it
                depth = max(i for i, (t, _, _) in enumerate(stack) if t == tag)
                if all(t not in BLOCKS for t, _, _ in stack[depth + 1 :]):
                    del stack[depth:]
            before = stack[-1][1] if stack else 0
            inside = any(t in ("article", "main") for t, _, _ in stack)
            if tag in ("article", "main") and not inside and before == 1:
                before = 0  # it stands in what only the page's layout is named by
            stack.append((tag, 2 if tag in UNSEEN else max(before, is_furniture(tag, m[4], inside)), tag == "a"))
            if tag in ("article", "main") and not inside:
                articles += 1
                article = articles
        if tag in BLOCKS:
            flush()
    text(len(page))
    flush()
    return out


def classify(found: list[Block], short: int = 12, long: int = 25, low: float = 0.12, high: float = 0.25, links: float = 0.5) -> list[Block]:
    """Set every block's label to ``good`` or ``bad`` by the two passes.

    Where the page's unlinked text has less than half of ``low`` stop words, its language has no
    list, and length and link density decide; two characters of an unspaced script are a word.
    """
    counts = [sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in b.words) for b in found]
    free = [(c, len(b.words)) for b, c in zip(found, counts) if not b.furniture and 2 * b.linked <= len(b.words)]
    unlisted = sum(c for c, _ in free) < low / 2 * sum(n for _, n in free)
    for b, count in zip(found, counts):
        n = len(b.words)
        stops = count / n
        linked = b.linked / n
        if b.furniture:
            b.label = "bad"
        elif b.article:  # inside the article's own container only link lists are furniture
            b.label = "bad" if linked > links and n > 3 and stops < low else "good" if n >= short or b.heading else ""
        elif linked > links:
            b.label = "bad"
        elif unlisted:
            size = max(n, len(UNSPACED.findall(b.text)) // 2)
            b.label = "good" if size >= long or size >= short and linked <= links / 2 else ""
        elif n >= long and stops >= low or n >= short and stops >= high:
            b.label = "good"
        elif n >= short and stops < low:
            b.label = "bad"
    contained = any(b.article and not b.furniture for b in found)
    decided = [b.label for b in found]
    places: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.label and not b.furniture:
            places.setdefault(b.article, []).append(i)
    for i, b in enumerate(found):
        if contained and not b.article:
            b.label = "bad"  # the page names its article: text beside it is not part of it
        elif not decided[i]:
            same = places.get(b.article, [])
            at = bisect(same, i)
            near = sorted(same[max(0, at - 2) : at + 2], key=lambda j: (abs(j - i), j))[:2]
            votes = {decided[j] for j in near}
            if not near:
                b.label = "good" if b.article else "bad"
            elif len(votes) == 1 or abs(near[0] - i) < abs(near[1] - i):
                b.label = decided[near[0]]
            else:
                b.label = "good"
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    Cases: null or empty html, and pages with no main text, give an empty text; null ids and urls
    stay null; repeated rows are extracted as often as they occur; other columns are ignored; an
    empty table gives no rows.  Whole pages are read, however long.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
