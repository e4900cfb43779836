"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at its block-level tags. Each block is described by its words and link density,
by those of the two blocks before and the two after it, and by one mark: whether the page itself says that the block
belongs to its article, that it doesn't, or nothing. The tree is grown from a small labelled table of blocks of real and
hand-made pages. Each of these pages counts with its marks, without them, and without each run of its boilerplate, so
that pages which mark nothing are decided by words and links alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

# Names of the HTML standard, and words by which pages mark what is no part of an article.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea template noscript iframe object svg math canvas audio video noframes xmp".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select datalist search label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets rail footer foot header masthead topbar toolbar copyright legal disclaimer "
    "comment comments reply replies respond disqus discussion share sharing social follow subscribe subscription newsletter signup login related recommended recommendations "
    "form search skip hidden".split()
)
SURE_WORDS = frozenset("ad ads advert advertisement sponsored promo cookie cookies notice comment comments reply replies share newsletter related".split())
MAIN_WORDS = frozenset("article content post entry story main maincontent articlebody body-text".split())
#: An open tag that one of these closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    noise: bool


def _marks(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element begins an article, and whether it is no part of one."""
    main, noise = tag in ("article", "main"), tag in NOISE_TAGS or tag == "header" and not inside
    if attrs:
        found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
        names = set()
        for value in (found.get("class", ""), found.get("id", "")):
            names.update(w.lower() for part in value.split() for w in WORD_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower()) if w)
        main = main or bool(names & MAIN_WORDS) or found.get("role", "").lower() in ("main", "article")
        noise = noise or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        marked = names & NOISE_WORDS
        if inside or names & MAIN_WORDS:
            marked -= {"header", "head"}  # an article's own
        if marked and tag not in ("html", "body"):
            # on headings, paragraphs and articles themselves only what can't be meant otherwise counts
            noise = noise or tag not in ("h1", "h2", "p", "header", "article", "main") or bool(marked & SURE_WORDS) or not (inside or main)
            main = main and not noise
    return main, noise


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space as single spaces; none is empty."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside an article, noise
    text: list[str] = []
    links: list[str] = []
    inside = noise = False
    link = 0

    def close():
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, len(whole.split()), len(" ".join(unescape(x) for x in links).split()), inside, noise))
            text.clear()
            links.clear()

    def pop(to: int):
        nonlocal inside, noise, link
        link -= sum(t == "a" for t, _, _ in stack[to:])
        del stack[to:]
        inside, noise = stack[-1][1:] if stack else (False, False)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            text.append(m["text"])
            if link:
                links.append(m["text"])
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag in RAW_TAGS:
            if not end and not attrs.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else n
            text.append(" ") if text else None
            continue
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        if tag in VOID_TAGS:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                # an inline end tag doesn't close blocks
                if tag not in BLOCK_TAGS and stack[i][0] in BLOCK_TAGS:
                    break
            continue
        if tag in BLOCK_TAGS:
            # a block closes an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        main, bad = _marks(tag, attrs, inside)
        inside, noise = inside or main, noise or bad
        stack.append((tag, inside, noise))
        link += tag == "a"
    close()
    return out


REACH = 2
FEATURES = (*(f"{what}{d:+d}" for d in range(-REACH, REACH + 1) for what in ("words", "links")), "mark")

#: The labelled table, a page a line, a block an entry. Words, ~ and words in links if there are any; a: inside
#: what the page calls its article, n: inside what it marks as no part of one; !: not main text. Pages from the 12th on
#: are hand-made; those after the gap have readers' comments or adverts in prose, which only marks tell from an article.
LABELLED = """
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 8n! 10a 51a 8a 11a 36a 32a 52a 25n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 8n! 9a 12a 9a 39a 8a 20a 8a 8n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 5n! 2a 2a 11n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 8n! 11a 17a 143a 31a 189a 43a 51a 22a 11n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 8n! 8a 8a 45a 1a 30a 37a 47a 2a 1a 15a 3a 8a 14n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 9n! 7a 968a 9a 7n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 4n! 6a 6a 10a 15n!
1~1n! 1~1n! 1~1n! 1~1n! 12n! 11a 149a 46a 1a 76a 9n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 6n! 8a 12a 8a 3a 38a 36a 28a 6a 25a 32a 13n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 10n! 4a 4a 47a 75a 43a 95a 11a 49a 178a 10n!
1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 1~1n! 7n! 5a 5a 15n!
2~2! 1~1! 2~2! 1~1! 9 41 66~3 38 71 2~2! 55 4 60~8 48 3~3! 5~5! 4~4! 2~2! 2~2!
3~3! 3~3! 2~2! 6 30 30 2 30 2~2! 1~1!
2 1 1 3 12 9 14 7 80 3 46
7a 64a 12~5a 5~5a 44a 3~3a! 2~2a! 4~4a! 2~2a! 6~6a!
5 90 1~1 70 38~20 52 4~4! 6~6! 9~9! 3~3! 8n!
6a
2a 7a
10
9a 30a 4a
1~1! 1~1! 25~22! 18~16! 21~20! 30~27! 16~15! 1~1!
120 40 7 15
8a 35a 2~2a! 38a 3~3a! 44a 9a 50a 1~1a! 1~1a!

5n! 9n! 3~3n! 2~2n! 10a 45a 88~4a 4a 52a 3n! 30n! 25n! 61n! 4~4n! 12n!
6a 70a 40a 5n! 15n! 33a 58a 2n! 44n! 1~1n! 27n! 7n!
12! 3~3n! 9a 55a 5~5a 62a 20n! 41! 60! 8n!
3n! 2a 1a 1a 7a 9~9n! 4a 18n!
"""


#: How often a page counts with its marks, for once without them.
MARKED = 2


@dataclass
class Labelled:
    words: int
    linked: int
    mark: int
    main: bool


def described(sizes: list[tuple[int, int]], marks: list[int]) -> list[tuple]:
    """A row of FEATURES for each block; beyond a page's ends 0 words and density -1."""
    flat = [x for words, linked in sizes for x in (words, min(1.0, linked / max(1, words)))]
    flat = [0, -1.0] * REACH + flat + [0, -1.0] * REACH
    return [(*flat[2 * i : 2 * i + 4 * REACH + 2], mark) for i, mark in enumerate(marks)]


def labelled_rows(table: str = LABELLED) -> list[tuple]:
    """Rows of FEATURES and a label, 1 for main text."""
    rows = []
    for part, lines in enumerate(table.strip().split("\n\n")):
        for line in lines.splitlines():
            page = []
            for words, linked, mark, other in re.findall(r"(\d+)(?:~(\d+))?([an]?)(!?)", line):
                page.append(Labelled(int(words), int(linked or 0), {"a": 1, "n": -1, "": 0}[mark], not other))
            if any(b.mark > 0 for b in page):
                page = [Labelled(b.words, b.linked, b.mark or -1, b.main) for b in page]
            kinds = [0 if b.main else 1 + bool(b.linked) for b in page]
            runs = [i + (kinds[i] == 0) * 1000 for i in range(len(page)) if i == 0 or kinds[i] != kinds[i - 1]]
            ends = [*(r % 1000 for r in runs[1:]), len(page)]
            versions = [page, *(page[:a] + page[b:] for a, b in zip(runs, ends, strict=True) if a < 1000)]
            for blocks_ in versions:
                sizes, main = [(b.words, b.linked) for b in blocks_], [int(b.main) for b in blocks_]
                rows += [(*r, y) for r, y in zip(described(sizes, [b.mark for b in blocks_]), main, strict=True)] * MARKED
                if not part:
                    rows += [(*r, y) for r, y in zip(described(sizes, [0] * len(main)), main, strict=True)]
    return rows


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 8):
    """A tree of (feature, threshold, at most, above), or a label: splits of least Gini impurity, both sides ``least`` rows or
    more, until leaves are pure."""
    best = None
    for f in range(rows.shape[1]) if 0 < labels.sum() < len(labels) else ():
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(len(x) * (1 - np.mean(x) ** 2 - np.mean(1 - x) ** 2) for x in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return int(labels.mean() >= 0.5) if len(labels) else 1
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least)


def labelled_tree(least: int = 8):
    """The tree of the labelled table."""
    table = np.array(labelled_rows())
    return grow(table[:, :-1], table[:, -1].astype(int), least)


def decide(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree, marked: bool = True) -> str:
    """The blocks of main text; not ``marked``: as if the page marked nothing, by words and links alone."""
    found = blocks(html) if html else []
    article = any(b.inside for b in found)
    marks = [0] * len(found) if not marked else [-1 if b.noise or article and not b.inside else int(b.inside) for b in found]
    rows = described([(b.words, b.linked) for b in found], marks)
    return "\n\n".join(b.text for b, row in zip(found, rows, strict=True) if decide(tree, row))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` of pages (of them html), with text and n_chars.

    Null or empty html, and pages without main text, give the empty text. Every row gets one row, repeated rows too; an
    empty table gives none. Kept columns of the names text and n_chars are replaced. Markup that is cut off or not closed is
    read as far as it goes. A block on which no leaf of the tree is of one mind goes with the leaf's majority, ties to main.
    """
    C.batches(pages.sparkSession)
    keep = [k for k in keep if k.lower() not in ("text", "n_chars")]
    rows = pages.select(*(pages[f"`{k}`"].alias(f"__keep{i}") for i, k in enumerate(keep)), pages["html"].cast("string").alias("__html"))
    tree = labelled_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    found = C.dealt(rows).mapInArrow(run, ", ".join([*(f"__keep{i} {pages.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)), "text string, n_chars long"]))
    return found.select(*(F.col(f"__keep{i}").alias(k) for i, k in enumerate(keep)), "text", "n_chars")


def op10(pages: DataFrame) -> DataFrame:
    return extract(C.pick(pages, page_id="long", url="string", html="string"))
