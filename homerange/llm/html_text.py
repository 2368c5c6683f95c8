"""Main text of web pages: maximum-scoring subsequence of words and tags.

A page is read once into blocks of text with the elements they stand in. Words score
positive or negative by those elements, tags score negative; one linear scan finds
the contiguous region of highest sum, which is the content. Menus, adverts, notices,
forms, comments and other furniture, told by element, role or a class that says nothing
else, are taken out first: inside the region they cost little, so they do not cut an
article in two. A class or id that only may name furniture gives its words a negative
score; it never takes out an article, a main part, a heading or what holds most of the
page's words.

The weights of tags and of the words in them come from labelled pages: pages that
mark their content themselves (``article``, ``main``, ``role="main"``,
``itemprop="articleBody"``) label each of their words and tags. A mark is believed only
where a marked element holds twice the words of the best region outside; else it is a
small bonus, so a page's longest story wins over marked teasers. ``sample_pages``
pages at most, drawn by a hash of the html, are used; without any, tags cost 1 and
words score 1.

Defined results. A null or empty html gives an empty text, n_chars 0; so does a page
without content. Repeated rows are read one by one; an empty table gives an empty
table. Markup may be broken: unclosed elements end with their parent, unknown end
tags are skipped, an unclosed comment ends with the page. Columns other than the html
are passed on (one named like a result column is replaced).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import append_columns, read

# Elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg video audio canvas xmp annotation".split())
# those that reach to the end of the page if they are not closed
ENDLESS = frozenset("script style textarea title".split())
# parts of formulas and embedded objects: neither costs anything
FREE = frozenset(
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mtable mtr mtd mstyle mspace munder mover "
    "munderover mpadded mphantom menclose mmultiscripts mprescripts semantics object param annotation".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav aside footer form button select dialog menu head fieldset legend datalist".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
# words of class and id attributes that name furniture
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot adsense sponsor sponsored sponsors promo "
    "promos promoted promotion banner banners cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup modal overlay newsletter subscribe subscription signup login signin register paywall sidebar "
    "sidebars aside rail widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager "
    "footer footers masthead topbar toolbar share sharing social related recommended recommendations trending popular "
    "comment comments commentlist commentary disqus discussion reply replies respond responses feedback search "
    "searchform searchbox skip copyright legal disclaimer".split()
)
# those of them that are also used of content: they only lower the score of its words
DOUBTFUL = frozenset(
    "notice notices alert alerts discussion search navigation navi popular trending social legal disclaimer copyright "
    "response responses respond feedback commentary reply replies skip register subscription promotion "
    "recommendations rail".split()
)
# words of a class that say nothing about what the element holds
NEUTRAL = frozenset(
    "area bar block bottom box button buttons col column container content field form group icon icons inner item "
    "items left link links list module outer panel right row section slot the top unit wrap wrapper".split()
)
# a class that begins so tells something about the element, not what it is
STATES = frozenset("has no not with without is hide show category cat tag tagged".split())
# these name furniture only outside the content: an article's own header holds its title
OUTER_NAMES = frozenset("header head".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3".split())
# elements that no class or id alone makes furniture
SAFE = CONTENT | frozenset("html body h1 h2 h3 h4 h5 h6".split())
# from so many words on, text outside marked content may be a story
MANY_WORDS = 50
# what the start of one element ends
CLOSES = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
ENDS_P = BLOCK - {"body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset("html body table td th article section div main aside nav footer header form ul ol dl".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-zA-Z][^>]*>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open element: its name, the element around it, whether it is the outermost of its
    name, and whether it is a heading or stands in one. Blocks share these links, so what a
    block stands in costs nothing to keep, however deep it is."""

    __slots__ = ("name", "parent", "outermost", "heading", "number")

    def __init__(self, name: str, parent: Element | None, outermost: bool, number: int):
        self.name, self.parent, self.outermost, self.number = name, parent, outermost, number
        self.heading = name in HEADINGS or (parent is not None and parent.heading)


@dataclass
class Block:
    """A run of text. ``tags``: names of the tags since the block before; ``inside``:
    the innermost element it stands in; ``content``: inside an element that marks content.
    ``doubt``: 1 inside an element whose name may be one of furniture, 2 if that element
    holds most of the page's words. ``marked``: number of the outermost element of each
    content mark (1 and 2) around it, 0 for none."""

    text: str
    n_words: int
    tags: list[str]
    inside: Element | None
    content: int
    furniture: bool
    doubt: int = 0
    marked: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Weights:
    """``tags``: score of a tag (negative); ``words``: score of a word in an element."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    tag: float = -1.0
    word: float = 1.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _named(value: str, is_id: bool) -> int:
    """2 if a class (or the id) names furniture and nothing else, 1 if it may, else 0."""
    found = 0
    for token in [value] if is_id else value.split():
        words = NAME_WORD.findall(HUMP.sub(" ", token).lower())
        telling = [x for x in words if x not in NEUTRAL]
        if not telling or telling[-1] not in NAMES or words[0] in STATES and words[0] != telling[-1]:
            continue
        alone = all(x in NAMES for x in telling)
        sure = telling[-1] not in DOUBTFUL or alone and not DOUBTFUL.issuperset(telling)
        found = max(found, 2 if sure and (alone or not is_id) else 1)
    return found


def _kind(name: str, raw: str, in_content: bool) -> tuple[bool, int, int]:
    """(furniture, content mark: 2 for an article, 1 for a wider main part, how sure its
    class or id names furniture: 0 to 2) of an element."""
    a = _attributes(raw) if raw.strip() else {}
    role = a.get("role", "").lower()
    style = a.get("style", "").replace(" ", "").lower()
    body = a.get("itemprop", "").lower() == "articlebody"
    safe = name in SAFE or role == "main" or body
    named = 0
    if a and not safe:
        named = max(_named(a.get("class", ""), False), _named(a.get("id", ""), True))
        if not in_content and not named:
            words = set(NAME_WORD.findall(HUMP.sub(" ", f"{a.get('class', '')} {a.get('id', '')}").lower()))
            named = int(bool(words & OUTER_NAMES))
        if in_content and named == 1:
            named = 0
    furniture = (
        name in FURNITURE
        or role in ROLES
        or "hidden" in a
        or a.get("aria-hidden") == "true"
        or "display:none" in style
        or "visibility:hidden" in style
        or (not in_content and name == "header")
    )
    content = 0
    if not furniture:
        content = 2 if name == "article" or body else 1 if name == "main" or role == "main" else 0
    return furniture, content, named


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    # name, in furniture, content mark, innermost named element (its place in ``named``, or
    # -1), outermost marked elements, element
    stack: list[tuple[str, bool, int, int, tuple[int, int], Element | None]] = []
    outside = ("", False, 0, -1, (0, 0), None)
    # open elements by name: all, and those since each open SCOPE element (with its name)
    count: dict[str, int] = {}
    frames: list[tuple[str, dict[str, int]]] = [("", {})]
    n_marked = n_elements = 0
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    # named elements: how sure its name is one of furniture, its words, the named one around
    named: list[list[int]] = []
    around: list[int] = []  # innermost named element around each block
    held: list[str] = []
    tags: list[str] = []
    page = page or ""

    def end_block() -> None:
        if held:
            words = html_lib.unescape("".join(held)).split()
            held.clear()
            if words:
                top = stack[-1] if stack else outside
                out.append(Block(" ".join(words), len(words), tags.copy(), top[5], top[2], top[1], 0, top[4]))
                around.append(top[3])
                if not top[1] and top[3] >= 0:
                    named[top[3]][1] += len(words)
                tags.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            count[name] -= 1
            if name in SCOPE:
                frames.pop()
            else:
                frames[-1][1][name] -= 1

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                held.append(t)
            elif t.startswith("<![CDATA["):
                held.append(t[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        block = name in BLOCK
        if m[1]:  # an end tag: of an element since the last SCOPE element, or of one of those
            if (count if name in SCOPE else frames[-1][1]).get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if block or any(x[0] in BLOCK for x in stack[k:]):
                    end_block()
                if name not in FREE:
                    tags.append(name)
                pop_to(k)
            elif name in ("p", "br") and len(frames) == 1:
                held.append(" ")
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            held.append(" ")
            if close or name in ENDLESS:
                at = close.end() if close else size
            else:
                unclosed.add(name)
            continue
        if block:
            end_block()
        elif name == "br":
            held.append(" ")
        if name not in FREE:
            tags.append(name)
        if name in VOID:
            continue
        # the element that this start tag ends
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if ends and (frames[-1][0] in ends or any(frames[-1][1].get(e) for e in ends)):
            k = len(stack) - 1
            while stack[k][0] not in ends:
                k -= 1
            pop_to(k)
        if m[3].rstrip().endswith("/") and not block:
            continue
        _, in_furniture, mark, inner, marked, parent = stack[-1] if stack else outside
        furniture, content, sure = (True, 0, 0) if in_furniture else _kind(name, m[3], mark > 0)
        if sure:
            named.append([sure, 0, inner])
            inner = len(named) - 1
        if content > mark:
            n_marked += 1
            marked = (marked[0] or n_marked, n_marked if content == 2 else 0)
        element = Element(name, parent, not count.get(name), n_elements)
        n_elements += 1
        stack.append((name, furniture, max(mark, content), inner, marked, element))
        count[name] = count.get(name, 0) + 1
        if name in SCOPE:
            frames.append((name, {}))
        else:
            frames[-1][1][name] = frames[-1][1].get(name, 0) + 1
    end_block()
    half = sum(b.n_words for b in out if not b.furniture) / 2
    # an element comes after the one around it: words go up from the last, doubts down from the first
    for _, n_words, outer in reversed(named):
        if outer >= 0:
            named[outer][1] += n_words
    told: list[tuple[bool, int]] = []
    for sure, n_words, outer in named:
        furniture, doubt = told[outer] if outer >= 0 else (False, 0)
        if n_words > half:
            doubt = 2
        elif sure == 2:
            furniture = True
        else:
            doubt = max(doubt, 1)
        told.append((furniture, doubt))
    for b, inner in zip(out, around, strict=True):
        if inner >= 0:
            furniture, b.doubt = told[inner]
            b.furniture = b.furniture or furniture
    return out


def _least(parts: list[Block], weights: dict[str, float]) -> list[float | None]:
    """Of each block the least weight of the elements around it; each element is looked at
    once."""
    known: dict[int, float | None] = {}
    out = []
    for b in parts:
        path, e = [], b.inside
        while e is not None and e.number not in known:
            path.append(e)
            e = e.parent
        least = known[e.number] if e is not None else None
        for e in reversed(path):
            own = weights.get(e.name) if e.name not in ("html", "body", "div") else None
            least = own if least is None else least if own is None else min(least, own)
            known[e.number] = least
        out.append(least)
    return out


def _words_inside(parts: list[tuple[int, Block]]) -> dict[str, list[int]]:
    """{element name: words of the blocks in such elements, by side}; a block counts once for
    every name around it, that is at the outermost element of the name."""
    total: dict[int, list[int]] = {}
    elements: dict[int, Element] = {}
    for side, b in parts:
        if b.inside is not None:
            total.setdefault(b.inside.number, [0, 0])[side] += b.n_words
            e = b.inside
            while e is not None and e.number not in elements:
                elements[e.number] = e
                e = e.parent
    got: dict[str, list[int]] = {}
    for number in sorted(elements, reverse=True):  # an element's number is above its parent's
        e, held = elements[number], total.get(number, [0, 0])
        if e.outermost:
            mine = got.setdefault(e.name, [0, 0])
            mine[0] += held[0]
            mine[1] += held[1]
        if e.parent is not None:
            up = total.setdefault(e.parent.number, [0, 0])
            up[0] += held[0]
            up[1] += held[1]
    return got


def plain(parts: list[Block], w: Weights, trusted: int = 0, bonus: float = 0.25) -> list[tuple[float, float]]:
    """(tags before it, words) of each block, by the elements it stands in: the weight of
    a word is the least of theirs, and more by ``bonus`` where the page marks content.
    Words of a doubt above ``trusted`` count against a region."""
    out = []
    for b, least in zip(parts, _least(parts, w.words), strict=True):
        cost = sum(w.tags.get(t, w.tag) for t in b.tags)
        if b.furniture:
            out.append((max(cost, -2.0), 0.0))
        elif b.doubt > trusted:
            out.append((cost, -0.5 * b.n_words))
        else:
            each = w.word if least is None else least
            out.append((cost, b.n_words * (each + bonus if b.content else each)))
    return out


def label(parts: list[Block], w: Weights, trusted: int = 0) -> int:
    """The strongest content mark that a page can be believed in: one of its elements
    holds at least twice the words of the best region without such a mark (a teaser card
    beside the story does not). 0: none, so the page has no labels."""
    for mark in (2, 1):
        held: dict[int, int] = {}
        for b in parts:
            if b.content >= mark and not b.furniture:
                held[b.marked[mark - 1]] = held.get(b.marked[mark - 1], 0) + b.n_words
        if not held:
            continue
        values = [(-math.inf, 0.0) if b.content >= mark else v for b, v in zip(parts, plain(parts, w, trusted, 0.0), strict=True)]
        first, end = best_region(values)
        if max(held.values()) >= 2 * sum(b.n_words for b in parts[first:end] if not b.furniture):
            return mark
    return 0


def counts(page: str | None) -> list[tuple[str, int, int]]:
    """(feature, inside content, outside) of one labelled page: ``t:`` a tag, ``w:``
    words in an element; nothing for a page without labels."""
    parts = blocks(page)
    mark = label(parts, Weights())
    got: dict[str, list[int]] = {}
    if mark:
        sides = [(0 if b.content >= mark and not b.furniture else 1, b) for b in parts]
        for side, b in sides:
            for t in b.tags:
                got.setdefault(f"t:{t}", [0, 0])[side] += 1
            got.setdefault("w:", [0, 0])[side] += b.n_words
        got |= {f"w:{e}": n for e, n in _words_inside(sides).items() if e not in CONTENT}
    return [(k, a, b) for k, (a, b) in got.items()]


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = 2000, max_features: int = 2000) -> Weights:
    """Weights from the labelled ones of at most ``sample_pages`` pages (about)."""
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).filter(F.col("html").isNotNull())
    n = rows.count()
    if n > sample_pages:
        rows = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) <= int(sample_pages / n * (1 << 30)))
    one = T.StructType(
        [T.StructField("k", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]
    )
    schema = T.StructType([T.StructField("c", T.ArrayType(one))])

    def make():
        return lambda texts: [[[{"k": k, "a": a, "b": b} for k, a, b in counts(t)] for t in texts]]

    each = append_columns(rows, F.col("html"), make, schema).select(F.explode("c").alias("c")).select("c.*")
    total = each.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = total.orderBy(F.desc(F.col("a") + F.col("b")), "k").limit(max_features).collect()
    if not found:
        return Weights()
    base = next(((r["a"], r["b"]) for r in found if r["k"] == "w:"), (1, 1))
    usual = math.log((base[0] + 1) / (base[1] + 1))
    tags, words = {}, {}
    for r in found:
        odds = math.log((r["a"] + 1) / (r["b"] + 1)) - usual
        if r["k"].startswith("t:"):  # at best a tag costs little, at worst three words
            tags[r["k"][2:]] = min(max(odds - 0.5, -3.0), -0.1)
        elif r["k"] != "w:":
            words[r["k"][2:]] = min(max(1.0 + odds, -1.0), 2.0)
    return Weights(tags=tags, words=words)


def scores(parts: list[Block], w: Weights, mark: int, trusted: int = 0) -> list[tuple[float, float]]:
    """(tags before it, words) of each block. On a page whose content mark is believed,
    words outside it count against a region; elsewhere see :func:`plain`."""
    out = plain(parts, w, trusted)
    if mark:
        for i, b in enumerate(parts):
            if not b.furniture and b.doubt <= trusted:
                out[i] = (out[i][0] * 0.1, b.n_words * (2.0 if b.content >= mark else 0.2 if b.content else -2.0))
    return out


def best_region(values: list[tuple[float, float]]) -> tuple[int, int]:
    """(first, end) of the contiguous run of highest sum, which begins and ends with
    words; (0, 0) if none is positive. The leftmost of equal runs."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tags, words) in enumerate(values):
        if total + tags <= 0:
            total, start = 0.0, i
        else:
            total += tags
        total += words
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, w: Weights) -> str:
    """The blocks of the best region, without furniture, two line ends between."""
    parts = blocks(page)
    total = sum(b.n_words for b in parts if not b.furniture)
    doubted = sum(b.n_words for b in parts if b.doubt and not b.furniture)
    mark = first = end = 0
    for trusted in (0, 2):
        mark = label(parts, w, trusted)
        first, end = best_region(scores(parts, w, mark, trusted))
        # names that leave less than a quarter of the words are not believed, unless they
        # are a few words beside marked content
        found = sum(b.n_words for b in parts[first:end] if not b.furniture)
        if 4 * found >= total or not doubted or (mark and found and doubted < MANY_WORDS):
            break
    if mark:  # all of the marked content, and what the region holds between and before
        wanted = [b.content >= mark or first <= i < end for i, b in enumerate(parts)]
    else:
        # a heading of few words may not earn its tags; right before the region it is its title
        while 0 < first < end and not parts[first - 1].furniture and parts[first - 1].inside and parts[first - 1].inside.heading:
            first -= 1
        wanted = [first <= i < end for i in range(len(parts))]
    return "\n\n".join(b.text for b, yes in zip(parts, wanted, strict=True) if yes and not b.furniture)


@lru_cache(maxsize=1)
def _worker_weights(tags: tuple, words: tuple) -> Weights:
    return Weights(dict(tags), dict(words))


def extract(
    pages: DataFrame, weights: Weights, html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """``pages`` (its columns ``keep``, if given) with text and n_chars (code points)."""
    tags, words = tuple(sorted(weights.tags.items())), tuple(sorted(weights.words.items()))

    def make():
        w = _worker_weights(tags, words)
        return lambda texts: [[main_text(t, w) for t in texts]]

    schema = T.StructType([T.StructField("text", T.StringType())])
    out = append_columns(pages, F.col(f"`{html_col}`").cast("string"), make, schema, keep)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, learn(pages), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
