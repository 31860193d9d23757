"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels each block from its own features: link density (share of
its characters inside links), length and stop-word density, with the page's boilerplate containers (menus, headers,
footers, sidebars, forms, adverts, notices, comments; scripts and styles) left out whole, and the article container
(``article``, ``main``) as the place of the main text. Pass two gives every ambiguous block (short ones) the label of
its nearest decided neighbours. Good blocks, joined in page order by one line feed, are the main text.

Pages are independent: one task parses the pages of its partition, without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that end a block, containers that are never main text, and boilerplate words in class/id/role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP_TAGS = frozenset(
    "aside button canvas dialog footer form head header iframe input nav noscript object script select style svg "
    "template textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|menu|"
    r"nav|navbar|newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsored|subscribe|widget)"
    r"(?:$|[\s_-])", re.I)
# Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or our she that the their
they this to was we were which with you
aber als am an auch auf aus bei bin bis das dass dem den der des die dir du ein eine einen er es für hat ich ihr im
in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou par pas pour
qu que qui sa se ses son sur un une vous
al como con de del el en es esta este la las lo los más mi no o para pero por que se sin su sus un una y ya
""".split())
WORD = re.compile(r"\w+")
TAG_START = re.compile(r"<[A-Za-z/!?]")

#: Pass-one thresholds: a block this long (characters) is judged alone, shorter ones are ambiguous.
SHORT = 40
#: Link density above which a block is a menu or link list.
LINKS = 0.5
#: Stop-word density from which a block reads as running text.
STOPS = 0.15


class Blocks(HTMLParser):
    """Blocks of one page outside boilerplate containers: [text, link characters, tag, inside article]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.stack: list[tuple[str, bool, bool]] = []   # (tag, skips, is main)
        self.skip = 0
        self.main = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.tag = ""

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append([text, min(self.linked, len(text)), self.tag, self.main > 0])
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.flush()
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        skips = tag in SKIP_TAGS or (tag not in MAIN_TAGS and tag != "body" and bool(BOILERPLATE.search(named)))
        if tag in BLOCK_TAGS or skips:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
                self.tag = tag
                return                       # often left open: no stack entry, the next block tag ends them
            self.stack.append((tag, skips, tag in MAIN_TAGS))
            self.skip += skips
            self.main += tag in MAIN_TAGS
            self.tag = tag
        elif tag == "a":
            self.links += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag in BLOCK_TAGS or tag in SKIP_TAGS:
            self.flush()
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == tag:
                    for _, skips, main in self.stack[at:]:
                        self.skip -= skips
                        self.main -= main
                    del self.stack[at:]
                    break

    def handle_data(self, data):
        if self.skip:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def handle_comment(self, data):
        pass


def label(text: str, linked: int, tag: str, main: bool, has_main: bool) -> str | None:
    """Pass one: 'good', 'bad' or None (ambiguous) from a block's own features."""
    if "©" in text and len(text) < 200:
        return "bad"
    if linked / len(text) > LINKS:
        return "bad"
    if has_main and not main:
        words = WORD.findall(text.lower())
        dense = words and sum(w in STOP_WORDS for w in words) / len(words) >= 2 * STOPS
        return "good" if dense and len(text) >= 400 and not linked else "bad"
    if len(text) < SHORT:
        return None
    words = WORD.findall(text.lower())
    if main:
        return "good"
    return "good" if words and sum(w in STOP_WORDS for w in words) / len(words) >= STOPS else "bad"


def main_text(html: str | None) -> str:
    """The page's main text: good blocks in page order, one line feed between blocks. Empty or null html: ''."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and TAG_START.match(html, cut):
        html = html[:cut]                    # a page cut inside a tag: the unfinished tag is markup
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    has_main = any(b[3] for b in blocks)
    labels = [label(b[0], b[1], b[2], b[3], has_main) for b in blocks]
    decided = list(labels)
    # Pass two: an ambiguous block takes the label its nearest decided neighbours agree on; a heading belongs to what
    # follows; otherwise the nearer one decides, in the same container first, and a tie keeps article text.
    before, after = [None] * len(blocks), [None] * len(blocks)
    last = None
    for at, x in enumerate(labels):
        before[at] = last
        if x is not None:
            last = (at, x)
    last = None
    for at in range(len(labels) - 1, -1, -1):
        after[at] = last
        if labels[at] is not None:
            last = (at, labels[at])
    for at, x in enumerate(labels):
        if x is not None:
            continue
        near = [n for n in (before[at], after[at]) if n is not None]
        if not near:
            decided[at] = "good" if blocks[at][3] or not has_main else "bad"
        elif len(near) == 1 or near[0][1] == near[1][1]:
            decided[at] = near[0][1]
        elif blocks[at][2] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            decided[at] = after[at][1]
        else:
            same = [n for n in near if blocks[n[0]][3] == blocks[at][3]]
            pool = same or near
            gap = min(abs(n[0] - at) for n in pool)
            closest = {n[1] for n in pool if abs(n[0] - at) == gap}
            decided[at] = closest.pop() if len(closest) == 1 else ("good" if blocks[at][3] else "bad")
    return "\n".join(b[0] for b, x in zip(blocks, decided) if x == "good")


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none), n_chars (its code points).

    ``pages`` has page_id, url and html; other columns are ignored and every row gives one row, repeated and null ones
    too. Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
    by one line feed. A null or empty page, or one without main text, gives ''. Unclosed tags end at the next block tag;
    script and style content, comments and markup never reach the text.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = rows.mapInArrow(extract_batches, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
