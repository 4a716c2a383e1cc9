"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags. The first pass classes a block by its length,
its density of stop words and its density of link text: good, near good, short or bad. The
second lets the ambiguous ones take the label of their nearest decided neighbours.

Where the markup speaks, its word counts. Scripts, styles, menus, footers and other parts that
their tags name are never blocks. A class, id or role that says advert, menu, comments and the
like drops an element, unless that element is what holds the article. Blocks inside an
<article> or <main> element start from a better prior: they bear more links, their lack of
stop words makes them ambiguous rather than bad, and the ends of the element count as good
neighbours.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name

#: Fixed thresholds of the block rules, lengths in code points.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS_HIGH = 0.2
#: Share of link text that a block inside the article element bears.
LINKS_INSIDE = 0.5
HEADING_REACH = 200

#: Fixed word lists: frequent function words by language.
STOP_WORDS = frozenset((
    # English
    "the of and to in a is that it for was on are as with be by he this at from or an have not but they his her she which you we their one were all been has had will would there can if more when who so what its them some into than other could time these two may then do no my about out up only me your such where after also any new most our how should because each just those over between".split()
    # German
    + "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines wo jetzt was diese".split()
    # French
    + "le la les de des du un une et en à dans que qui est pour par sur pas plus ne ce se il elle ils sont au aux avec son sa ses ou mais comme on nous vous leur tout cette été être fait avait était sans même ces entre deux aussi après bien peut donc si très où y d l s n c qu j m".split()
    # Spanish
    + "el la los las de del un una y en a que es por para con no se su al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre ser también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué".split()
))
#: Fixed tag lists.
BLOCK_TAGS = frozenset("address article aside blockquote body canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol optgroup option p pre section summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg math select object xmp noframes canvas audio video".split())
TO_THE_END = frozenset("script style textarea title xmp".split())
DROPPED_TAGS = frozenset("head nav footer aside button dialog menu fieldset label datalist applet map".split())
#: An optional end tag: opening the key closes an open element of the value.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Fixed names, in class, id or role, of what is not the article ...
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|outbrain|taboola|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|toolbar|"
    r"masthead|topbar|footer|colophon|sidebar\w*|widget\w*|related|recommend\w*|trending|comments?|commentlist|respond|replies|disqus\w*|reader-comments|"
    r"cookies?|consent|gdpr|notices?|notification\w*|alert|disclaimer|popup|modal|newsletter|subscribe|signup|login|share|sharing|skip-link|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: ... and of what is rarely the article where it stands outside of one.
DOUBTED_NAMES = re.compile(r"(?:^|[\s_-])(?:header|foot|copyright|side|aside|rail|popular|discussion|reply|overlay|social|search|form)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


class _Block:
    __slots__ = ("text", "linked", "heading", "node", "filled")

    def __init__(self, heading: bool, node: int):
        self.text, self.linked, self.heading, self.node, self.filled = [], 0, heading, node, False


class _Node:
    """An open or closed element: its parent, what it is, and the code points in it."""

    __slots__ = ("parent", "tag", "dropped", "named", "doubted", "main", "size", "mains")

    def __init__(self, parent: int, tag: str, dropped: bool = False, named: bool = False, doubted: bool = False, main: bool = False):
        self.parent, self.tag, self.dropped, self.named, self.doubted, self.main, self.size, self.mains = parent, tag, dropped, named, doubted, main, 0, 0


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of a raw tag ends, by where its start tag ends; one that is never closed has no entry."""
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def _blocks(page: str) -> tuple[list[_Block], list[_Node]]:
    """The blocks of a page outside what its tags drop, and its elements."""
    done: list[_Block] = []
    nodes = [_Node(-1, "")]
    open_ = [0]
    block = _Block(False, 0)
    dropped = links = mains = 0
    heading = False
    raw_ends: dict[str, dict[int, int]] = {}

    def close() -> None:
        nonlocal block
        if block.filled:
            done.append(block)
        block = _Block(heading, open_[-1])

    def pop(n: int) -> None:
        nonlocal dropped, links, mains
        for i in open_[n:]:
            dropped -= nodes[i].dropped
            mains -= nodes[i].main
            links -= nodes[i].tag == "a"
        del open_[n:]

    def say(raw: str) -> None:
        if raw and not dropped:
            text = _html.unescape(raw)
            if not block.filled and not text.isspace():
                block.node, block.filled = open_[-1], True
            block.text.append(text)
            size = len(_SPACE.sub(" ", text).strip())
            nodes[open_[-1]].size += size
            if links:
                block.linked += size

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        ends, rest = m[1] == "/", m[3] or ""
        if not ends and tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                close()
            if not rest.rstrip("> \n").endswith("/"):
                if tag in TO_THE_END:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else size
                else:
                    if tag not in raw_ends:
                        raw_ends[tag] = _ends(page, tag)
                    at = max(at, raw_ends[tag].get(at, at))
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            if tag in HEADINGS:
                if ends:
                    close()
                heading = not ends
            else:
                heading = False
            close()
        if tag in VOID_TAGS:
            continue
        if ends:
            for i in range(len(open_) - 1, 0, -1):
                if nodes[open_[i]].tag == tag:
                    pop(i)
                    break
                if nodes[open_[i]].tag in ("article", "main", "body", "nav", "footer", "aside", "form") and tag not in BLOCK_TAGS:
                    break
        else:
            for i in range(len(open_) - 1, 0, -1):
                if nodes[open_[i]].tag in IMPLIED_END.get(tag, ()):
                    pop(i)
                    break
                if nodes[open_[i]].tag in ("ul", "ol", "dl", "table", "select", "article", "body"):
                    break
            names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest))
            whole = tag in ("body", "html")
            named = not whole and bool(names and DROPPED_NAMES.search(names) or rest and _HIDDEN.search(rest))
            own = tag in ("article", "main") and not (names and re.search(r"(?:^|[\s_-])(?:comments?|reply|related|teaser|promo\w*)(?:$|[\s_-])", names, re.I))
            drop = tag in DROPPED_TAGS or tag == "header" and not mains or tag == "article" and not own
            nodes.append(_Node(open_[-1], tag, drop, named and not own or tag == "form", not whole and bool(names and DOUBTED_NAMES.search(names)), own))
            open_.append(len(nodes) - 1)
            dropped += drop
            mains += own
            links += tag == "a"
        if tag in ("article", "main"):
            close()
    close()
    return done, nodes


def _kept(blocks: list[_Block], nodes: list[_Node]) -> tuple[list[bool], list[int], list[bool]]:
    """For every element whether its text counts, the article element around it (0: none), and whether
    its name speaks against it."""
    for i in range(len(nodes) - 1, 0, -1):  # an element comes after its parent
        n = nodes[i]
        if not n.dropped:
            nodes[n.parent].size += n.size
            nodes[n.parent].mains += n.mains + (n.main and n.size > 0)
    under = [False] * len(nodes)  # inside an element that a name drops
    for i, n in enumerate(nodes[1:], 1):
        under[i] = under[n.parent] or n.named
    free = any(n.main and n.size and not under[i] for i, n in enumerate(nodes))  # there is an article outside of all such
    keep, main, doubted = [True] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        main[i] = i if n.main else main[n.parent]
        doubted[i] = not main[i] and (doubted[n.parent] or n.doubted)
        around = main[n.parent]
        if not n.named:
            spared = True
        elif around:  # part of an article: what holds most of it is the article
            spared = 2 * n.size > nodes[around].size
        elif n.tag == "form" and n.mains:
            spared = True
        else:
            spared = not free and (n.mains > 0 or 2 * n.size > nodes[0].size)
        keep[i] = keep[n.parent] and not n.dropped and spared
    return keep, main, doubted


def classify(blocks: list[tuple[str, int, bool, int, bool]]) -> list[bool]:
    """Which blocks (text, code points in links, heading, number of the article element or 0,
    doubted by name) are main text. First pass: each by itself; second: the ambiguous by their
    neighbours."""
    labels = []
    for text, linked, heading, inside, doubted in blocks:
        n = len(text)
        words = [w.lower() for w in _WORD.findall(text)]
        stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if linked > (LINKS_INSIDE if inside else LINKS_HIGH) * n:
            label = "bad"
        elif n < LENGTH_LOW:
            label = "short" if inside or not linked else "bad"
        elif stop >= STOP_HIGH:
            label = "good" if n > LENGTH_HIGH else "near"
        else:
            label = "near" if stop >= STOP_LOW else "bad"
        if inside and label in ("near", "bad") and linked <= LINKS_INSIDE * n:
            label = "good" if label == "near" else "near"  # the prior of an article
        elif doubted and label != "good":
            label = "bad"
        labels.append(label)

    def sweep(seq: list[tuple[str, int]], stops: tuple[str, ...]) -> list[str]:
        """For each block the last label before it that is in ``stops``; an article begins
        with a good one, what is around it with a bad one."""
        found, met, at = [], "bad", 0
        for label, inside in seq:
            if inside != at:
                met = "good" if inside else "bad"
                at = inside
            found.append(met)
            met = label if label in stops else met
        return found
    own = [b[3] for b in blocks]
    seq = list(zip(labels, own))
    decided, longer = ("good", "bad"), ("good", "bad", "near")
    before, after = sweep(seq, decided), sweep(seq[::-1], decided)[::-1]
    before_long, after_long = sweep(seq, longer), sweep(seq[::-1], longer)[::-1]
    final = []
    for i, label in enumerate(labels):
        if label == "short":
            if before[i] == after[i]:
                label = before[i]
            elif own[i]:  # inside an article one good side is enough
                label = "good"
            else:  # between good and bad: good next to a near-good block
                label = "good" if (after_long if after[i] == "bad" else before_long)[i] == "near" else "bad"
        elif label == "near":
            label = "bad" if before[i] == after[i] == "bad" else "good"
        final.append(label)
    room = 0  # code points to the next good block after i
    for i in range(len(blocks) - 1, -1, -1):
        if final[i] == "good":
            room = HEADING_REACH
        elif blocks[i][2] and labels[i] == "short" and room > 0:
            final[i] = "good"
        room -= len(blocks[i][0]) if final[i] != "good" else 0
    return [x == "good" for x in final]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by newlines; white space and <br> inside a block are
    one space."""
    found, nodes = _blocks(page or "")
    keep, main, doubted = _kept(found, nodes)
    blocks = []
    for b in found:
        text = _SPACE.sub(" ", "".join(b.text)).strip()
        if text and keep[b.node]:
            blocks.append((text, b.linked, b.heading, main[b.node], doubted[b.node]))
    return "\n".join(t for (t, *_), good in zip(blocks, classify(blocks)) if good)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html column, named ``out_col`` (underscores
    added if taken).

    Null and empty pages, and pages without main text, give the empty string. Cut-off
    markup is read as far as it goes; of elements that hold no text of the page, such as <svg>, an unclosed
    one is passed over alone, but an unclosed script or style runs to the end. A page is handled whole in one row; equal rows give
    equal results, and no rows give none.
    """
    name = free_name(pages.columns, out_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)
    kept = pages.select(*[column(pages, c) for c in pages.columns if c != html_col], column(pages, html_col).alias(name))
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])  # any name can be a column's
    return plain.mapInArrow(run, plain.schema).toDF(*kept.columns)
