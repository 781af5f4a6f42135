"""Main text of web pages by block rules in two passes.

A page becomes a sequence of text blocks. The first pass decides each block by its length,
its share of stop words and its share of link text: good, bad, or short. The second pass
decides ambiguous short blocks by their nearest decided neighbours. Regions that are never
main text (navigation, forms, scripts, comments by readers and the like) are marked while
the page is read, from element names and from the words of class and id.
"""

import html
import re
from collections import Counter, namedtuple

import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm.columns import slices

#: Text bytes that are worked on at a time.
BLOCK_BYTES = 4 << 20

#: Function words of the languages of the corpus, fixed values.
STOP_WORDS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was were will with which not have has had they he she we you
au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous ou par pas pour qu que qui sa se son sur un une vous
aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer es für haben hat ich im ist mit
nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur
al como con de del el ella en entre era es esta este ha la las lo los más mi no nos o para pero por que se sin su sus un una y ya
""".split())

#: A block with fewer characters than this is short; one with more than the second is long. Characters.
SHORT, LONG = 70, 200
#: Shares of stop words among the words: below the first a block has none, from the second on it reads as prose.
FEW_STOPS, MANY_STOPS = 0.05, 0.20
#: Words of a page from which function words are learned at least, their greatest length and number.
LEAST_WORDS, SHORT_WORD, FUNCTION_WORDS = 40, 4, 30
#: A block with a larger share of link characters is bad.
LINKED = 0.5

#: Elements whose whole content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map head "
                   "select option optgroup datalist textarea button title label".split())
#: Elements whose content is not main text.
ASIDE = frozenset("nav header footer aside menu dialog".split())
#: Elements that are evidence against their content, as marks are: a whole page may stand in one.
WEAK = {"form": "form element", "fieldset": "fieldset element"}
#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same set: a new paragraph or item closes the last.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that end an open paragraph, beside those that close one by CLOSES.
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hr main menu nav ol pre section table ul".split())
#: First or last words of a class, id or role that mark a region as no main text.
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner nav navbar navigation
menu menubar menus breadcrumb breadcrumbs pagination pager sidebar aside complementary related recommended recommendations teaser teasers
share sharing social comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert
modal popup overlay newsletter subscribe subscription signup login search footer header masthead toolbar widget widgets copyright disclaimer
contentinfo form dialog hidden
""".split())
#: Marks of texts by readers, which may be longer than the page's own.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: A mark beside other words is overruled where its regions hold more than this share of the page's good text.
MOST = 0.5
#: First words that say something about a region's surroundings.
_ABOUT = frozenset("has with without no is".split())
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Regions that hold the main text, where they occur.
MAIN = frozenset(["article", "main"])
#: Elements that stand for the whole page or its text, whatever their class says.
UNMARKED = frozenset(["html", "body", "main"])

#: A quote begins a string only right after an equals sign; anywhere else it is a character like others.
_VALUE = r"""=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z)"""
_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    rf"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0\s]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts that are written without spaces: Han, Kana, Thai, Lao, Khmer, Burmese.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_UNSPACED_RUN = re.compile(_UNSPACED.pattern + "+")
_HEADING = re.compile(r"h[1-6]$")

#: ``aside``: within a hidden region or one whose element is no main text; ``marks``: those of the regions around it; ``main``: number of the outermost article or main element around it, or 0;
#: ``stops`` and ``size``: share of function words, and length in characters of spaced scripts, once they are known.
Block = namedtuple("Block", "text heading links aside main marks stops size", defaults=[0.0, 0])


def _marked(attributes):
    """Whether a start tag hides its region, and the names by which it says that it is no main text."""
    hides, names = False, []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _NAME_WORD.findall(token)]
                if words and words[0] not in _ABOUT and (words[0] in MARKS or words[-1] in MARKS):
                    names.append(" ".join(words))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hides = True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hides = True
    return hides, names


class _Reader:
    """Collects the blocks of a page; open elements are (name, kind of region, marks).

    Work per tag does not depend on the depth: names open since the last element that breaks
    a block are counted, and an end tag without a partner is known at once.
    """

    def __init__(self):
        self.blocks, self.open = [], []
        self.parts, self.linked = [], 0
        self.asides = self.mains = self.anchors = self.headings = self.main = 0
        self.marks, self.around = Counter(), frozenset()
        self.names = Counter()
        self.levels = [(-1, Counter())]  # depth of each open element that breaks a block, and the inline names open in it

    def text(self, data):
        if data:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(_SPACE.sub("", data))

    def end_block(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                if self.around is None:
                    self.around = frozenset(self.marks)
                self.blocks.append(Block(text, self.headings > 0, self.linked, self.asides > 0, self.main if self.mains else 0, self.around))
        self.parts, self.linked = [], 0

    def start(self, name, attributes):
        if name == "br":  # white space; two in a row end a block
            if self.parts and self.parts[-1] == "\n":
                self.end_block()
            else:
                self.parts.append("\n")
            return
        if name not in INLINE:
            self.end_block()
            if name in CLOSES:
                self._close_sibling(CLOSES[name])
            elif name in BREAKS_P:
                self._close_sibling(CLOSES["p"])
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE | BREAKS_P:
            return
        hides, marks = _marked(attributes) if name not in UNMARKED and attributes.strip() else (False, [])
        if name in WEAK:
            marks = [*marks, WEAK[name]]
        aside = name in ASIDE or hides
        if name in INLINE:
            self.levels[-1][1][name] += 1
        else:
            self.levels.append((len(self.open), Counter()))
        self.open.append((name, aside, marks))
        self.names[name] += 1
        if marks:
            self.marks.update(marks)
            self.around = None
        self.asides += aside
        self.main += name in MAIN and not self.mains
        self.mains += name in MAIN
        self.anchors += name == "a"
        self.headings += bool(_HEADING.match(name))

    def _close_sibling(self, names):
        depth = self.levels[-1][0]
        if depth >= 0 and self.open[depth][0] in names:
            self._close_to(depth)

    def end(self, name):
        if name not in INLINE:
            self.end_block()
        if not (self.levels[-1][1] if name in INLINE else self.names)[name]:
            return
        depth = len(self.open) - 1
        while self.open[depth][0] != name:
            depth -= 1
        self._close_to(depth)

    def _close_to(self, depth):
        for name, aside, marks in self.open[depth:]:
            self.asides -= aside
            if marks:
                self.marks.subtract(marks)
                self.marks += Counter()
                self.around = None
            self.mains -= name in MAIN
            self.anchors -= name == "a"
            self.headings -= bool(_HEADING.match(name))
            self.names[name] -= 1
            if name in INLINE and self.levels[-1][0] < depth:
                self.levels[-1][1][name] -= 1
        del self.open[depth:]
        while self.levels[-1][0] >= depth:
            self.levels.pop()


def blocks(page):
    """The text blocks of a page in order."""
    reader, at, end, unclosed = _Reader(), 0, len(page), set()
    while at < end:
        tag = _TAG.search(page, at)
        if not tag:
            reader.text(html.unescape(page[at:]))
            break
        if tag.start() > at:
            reader.text(html.unescape(page[at:tag.start()]))
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            reader.end(name)
        elif name in SILENT:
            if name not in INLINE:
                reader.end_block()
            if name not in VOID and not tag[3].rstrip().endswith("/"):
                # What has no end tag from here on has none further on.
                closing = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if closing:
                    at = closing.end()
                else:
                    unclosed.add(name)
                if not closing and name in ("script", "style", "textarea"):
                    at = end
        else:
            reader.start(name, tag[3])
    reader.end_block()
    return reader.blocks


GOOD, BAD, SHORT_BLOCK, NEAR = "good", "bad", "short", "near"


def _learned(found):
    """Function words of a page that has few of the known ones: its most frequent short words, or characters.

    Scripts without spaces are read by characters. Short pages, and pages in known languages, have none.
    """
    words = [w for b in found if not b.aside and b.links <= LINKED * len(b.text) for w in _words(b.text)]
    if len(words) < LEAST_WORDS or sum(w in STOP_WORDS for w in words) >= FEW_STOPS * len(words):
        return frozenset()
    counts = Counter(w for w in words if len(w) <= SHORT_WORD)
    return frozenset(w for w, n in counts.most_common(FUNCTION_WORDS) if n >= 3)


def _words(text):
    """Words in lower case; of scripts without spaces, the characters."""
    if _UNSPACED.search(text):
        return [c for w in _WORD.findall(text) for c in (w if _UNSPACED.match(w) else [w.lower()])]
    return [w.lower() for w in _WORD.findall(text)]


def measured(found):
    """The blocks with their shares of function words and their sizes."""
    stops, out = STOP_WORDS | _learned(found), []
    for b in found:
        words = _words(b.text)
        # A character of a script without spaces says about as much as two or three others.
        size = len(b.text) + sum(len(m) for m in _UNSPACED_RUN.findall(b.text)) * 3 // 2
        out.append(b._replace(stops=sum(w in stops for w in words) / max(1, len(words)), size=size))
    return out


def first_pass(block):
    """Good, bad, or undecided: short, or near good without being sure of it."""
    letters = len(block.text.replace(" ", ""))
    if block.aside:
        return BAD
    if block.links > LINKED * letters:
        # Prose that is one link, in an article: its neighbours decide.
        return NEAR if block.main and block.size >= SHORT and block.stops >= MANY_STOPS else BAD
    if block.size < SHORT:
        return BAD if block.links and not block.main else SHORT_BLOCK
    if block.stops >= MANY_STOPS:
        return GOOD if block.size > LONG else NEAR
    if block.stops >= FEW_STOPS:
        return NEAR
    # Without function words it may be a list or a table; inside an article its neighbours decide.
    return NEAR if block.main else BAD


def _with_prose(found, first):
    """Numbers of the article and main elements that hold more prose than one short block has."""
    prose = {}
    for b, k in zip(found, first):
        if b.main and k in (GOOD, NEAR) and b.stops >= MANY_STOPS:
            prose[b.main] = prose.get(b.main, 0) + b.size
    return {number for number, length in prose.items() if length > LONG}


def _judged(found):
    """Blocks whose ``aside`` also says whether a mark around them holds, without those that are overruled.

    A mark is evidence. One beside other words, as in ``sidebar-right`` or ``elementor-widget``,
    is overruled where its regions hold most of the good text of the page, or any of it when
    nothing unmarked reads as prose. One of mark words only, or of texts by readers, is overruled
    where all text lies in its regions.
    """
    if not any(b.marks for b in found):
        return found
    first = [first_pass(b) for b in found]
    good, held, around = 0, {}, {}
    text = [i for i, k in enumerate(first) if k != BAD]
    for i in text:
        length = found[i].size * (first[i] == GOOD)
        good += length
        for mark in found[i].marks:
            held[mark] = held.get(mark, 0) + length
            around[mark] = around.get(mark, 0) + 1
    bare = any(not found[i].marks and first[i] in (GOOD, NEAR) for i in text)
    overruled = set()
    for mark, length in held.items():
        words = set(mark.split())
        if words <= MARKS or words & READERS:
            if around[mark] == len(text):
                overruled.add(mark)
        elif length > MOST * good or length and not bare:
            overruled.add(mark)
    return [b._replace(aside=b.aside or bool(b.marks - overruled)) for b in found]


def labels(found):
    """Whether each block is main text.

    Undecided blocks take the label of the nearest decided block: with good on both sides
    good, with bad on both sides bad, and between them that of the nearer one, good when
    both are equally near. An article or main element with prose is evidence: its undecided
    blocks have their neighbours within it, not among its marked regions, and are text
    where it has none; undecided blocks outside need good prose outside. Without any good
    block, the undecided ones are the text, those of article and main elements first.
    """
    found = _judged(measured(found))
    first = [first_pass(b) for b in found]
    trusted = _with_prose(found, first)
    if not trusted and GOOD not in first:  # nothing reads as prose: undecided blocks are all there is
        inside = any(b.main and k != BAD for b, k in zip(found, first))
        return [k != BAD and (b.main > 0 or not inside) for b, k in zip(found, first)]
    out, places = [False] * len(found), {}
    for i, b in enumerate(found):
        if b.main not in trusted:
            places.setdefault(0, []).append(i)
        elif not b.aside:
            places.setdefault(b.main, []).append(i)
    for number, own in places.items():
        for i, keep in zip(own, _second_pass([first[i] for i in own], number > 0)):
            out[i] = keep
    return out


def _second_pass(first, is_main):
    """Whether each block of one place is text, by its own label or that of its decided neighbours."""
    if GOOD not in first:
        return [is_main and k != BAD for k in first]
    decided = [k if k in (GOOD, BAD) else None for k in first]
    left, last = [], (None, None)
    for i, k in enumerate(decided):
        last = (k, i) if k else last
        left.append(last)
    right, last = [None] * len(first), (None, None)
    for i in range(len(first) - 1, -1, -1):
        last = (decided[i], i) if decided[i] else last
        right[i] = last
    out = []
    for i in range(len(first)):
        if decided[i]:
            out.append(decided[i] == GOOD)
            continue
        (a, x), (b, y) = left[i], right[i]
        if a == b or b is None or a is None:
            out.append((a or b) == GOOD)
        else:
            nearer = a if i - x < y - i else b if y - i < i - x else GOOD
            out.append(nearer == GOOD)
    return out


def main_text(page):
    """The main text of a page: its kept blocks, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages, id_col="page_id", url_col="url", html_col="html"):
    """Main text of every page: id and url columns, ``text``, ``n_chars`` in code points.

    A null page is empty and has the empty text. Every row gives one row, repeated ones
    too; other columns are not read.
    """
    def run(batches):
        for part in slices(batches, 2, BLOCK_BYTES):
            texts = [main_text(p) if p else "" for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema][:2]
    return source.mapInArrow(run, ", ".join([*kinds, "text string, n_chars bigint"]))
