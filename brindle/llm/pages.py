"""Main text of web pages by equivalence-class template deduction.

Every page is read as a sequence of tokens: a block element is its path (names, classes and roles from the root), a block
of text is its element's path and its words. Over the pages of a host a token has an occurrence vector, how often it
stands on each page; tokens with the same vector form an equivalence class. A class that is frequent enough and hangs
together (its topmost elements have one parent; else it is split by parent) is valid if the class it hangs in is, so
valid classes nest into the host's template. An element's token stands for its start and end tag, so that tokens nest or
are apart and their order needs no test. A text in the class of its own element is the host's own: the same words wherever
that markup stands.

What is not template is slots. The main slot is the deepest element of the template that stands once on its pages and
holds at least ``MAIN`` of what slots there hold over all of them, in characters that are not links or the host's own. A
page's main text is what its main slot holds, less the host's own texts and blocks that say that they are no article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, by element name or whole
class, id or role). Such marks also break ties: text that says it is no article doesn't count for a slot, a main slot
within an element that is marked as article grows to it, one without a heading to the nearest element around it that has
one, and paragraphs, headings and the like within a marked article are never taken for the host's own.

A page alone shows no template: where a host has fewer than ``LEAST`` pages, or a page lacks its host's main slot, marks
decide: what articles hold if it is most of the text, else all that doesn't say it is something else, less
containers that are mostly links.

Vectors are compared by sums (pages, occurrences, two halves of a hash of page and count, modulo 2^64) that combine before
the shuffle, so a host with a third of all pages is never gathered. A host's template is made of the tokens on ``SUPPORT``
of its pages, so of about as many as a few pages have.

Defined results: null html counts as empty and gives empty text; broken markup is read as far as it goes; very long
pages are read whole, one at a time; repeated rows get repeated results and count as pages of their own; ties between
main slots go to the one that stands first; an empty table gives an empty table; columns other than id, url and html are
not read.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows, written
from brindle.llm.links import whole_groups

#: Share of a host's pages, and number of pages, on which a template stands at least, and on which its texts do.
SUPPORT, LEAST, TEXTS = 0.3, 3, 10
#: The share of the slots' text that the main slot holds at least.
MAIN = 0.5
#: A host is large with one page in so many, so there are no more large hosts than this.
LARGE = 1000
#: Containers whose text is links to this share or more are menus.
LINKED = 0.5
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|</?[a-zA-Z][^>]*(?:>|$)""", re.DOTALL)
MARK = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+")
RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: What a start tag closes if it is open, up to what.
CLOSES = {n: ("p",) for n in "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold an article's own words.
WRITTEN = HEADINGS | frozenset("p blockquote pre li td th dd dt figcaption".split())
#: Elements that say that their text is not the article.
OTHER = frozenset("head nav footer aside form menu button select input dialog noscript template iframe svg script style textarea title object".split())
#: Names of containers that say so too, as a whole class, id or role, or as the first or last part of one.
CONTAINER = "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|masthead|topbar|footer|cookie|cookies|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comment|comments|disqus|widget|widgets|toolbar|pagination|pager|popup|modal|overlay"
ALONE = f"adsense|adsbygoogle|adbox|adslot|commentlist|respond|replies|skip-link|search|search-form|notice|notices|alert|copyright|disclaimer|contentinfo|complementary|legal|{CONTAINER}"
HOLDER = "area|bar|block|box|button|buttons|container|content|form|holder|inner|item|items|links|list|message|notice|outer|panel|row|section|slot|thread|unit|widget|wrap|wrapper"
PLACE = "bottom|footer|global|left|main|mobile|page|primary|reader|right|secondary|side|site|sticky|sub|top|user"
NAMED = re.compile(rf"(?:{ALONE})|(?:{CONTAINER}|header)(?:-(?:{HOLDER}|{CONTAINER}))+|(?:{PLACE})-(?:{CONTAINER}|header|notice|search)(?:-(?:{HOLDER}))?")
#: Inside an article a header holds its title, not the site's; flags of elements.
INNER_HEADER = re.compile(rf"header(?:-(?:{HOLDER}))*")
IS_OTHER, IS_ARTICLE, IS_HEADING, IS_WRITTEN = 1, 2, 4, 8


def says_other(name: str, marks: list[tuple[str, str]], article: bool) -> bool:
    """Whether an element says that its text is not the article's. The ids of headings and paragraphs name what they say."""
    if name in OTHER or name == "header" and not article:
        return True
    if name in ("html", "body", "article", "main"):  # a page's own classes say how it looks, not what it is
        return False
    for kind, value in marks:
        if kind == "id" and name in WRITTEN:
            continue
        for word in value.split():
            word = HUMP.sub("-", word).lower()
            if NAMED.fullmatch(word) and not (article and INNER_HEADER.fullmatch(word)) or word == "header" and not article:
                return True
    return False


class Element(NamedTuple):
    path: int
    above: int  # its parent's place in the list, -1 for the root's children
    flags: int


class Block(NamedTuple):
    element: int  # place of its element in the list
    text: str
    links: int  # characters in links


class Page:
    """A page's block elements in order, and its blocks of text."""

    def __init__(self, source: str | None) -> None:
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int]] = [("", -1)]  # name, place of the nearest block element
        self.open: dict[str, int] = {}
        self.words: list[str] = []
        self.links = 0
        self.read(source or "")
        self.flush()

    def flush(self) -> None:
        if self.words:
            text = " ".join(entities.unescape("".join(self.words)).split())
            if text:
                self.blocks.append(Block(self.at, text, min(self.links, len(text))))
            self.words, self.links = [], 0

    def text(self, raw: str) -> None:
        if not self.words:
            if not raw.strip():
                return
            self.at = self.stack[-1][1]
        self.words.append(raw)
        if self.open.get("a"):
            self.links += len(raw)

    def pop(self, at: int) -> None:
        if any(x[0] not in INLINE for x in self.stack[at:]):
            self.flush()
        for name, _ in self.stack[at:]:
            self.open[name] -= 1
        del self.stack[at:]

    def close(self, names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        if any(self.open.get(n) for n in names):
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] in names:
                    return self.pop(at)
                if self.stack[at][0] in scope:
                    return None
        return None

    def start(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            self.close(CLOSES[name], SCOPE.get(name, ()))
        if name not in INLINE:
            self.flush()
        if name in VOID:
            return
        above = self.stack[-1][1]
        self.open[name] = self.open.get(name, 0) + 1
        if name in INLINE:  # inline elements belong to the block around them
            self.stack.append((name, above))
            return
        marks = [(k.lower(), v.strip("\"'")) for k, v in MARK.findall(attributes) if k.lower() in ("class", "id", "role")] if attributes else []
        _, _, flags = self.elements[above] if above >= 0 else (0, -1, 0)
        flags &= IS_OTHER | IS_ARTICLE
        if says_other(name, marks, bool(flags & IS_ARTICLE)):
            flags |= IS_OTHER
        if name in ("article", "main") or ("role", "main") in marks or ("role", "article") in marks:
            flags |= IS_ARTICLE
        flags |= IS_HEADING * (name in HEADINGS) | IS_WRITTEN * (name in WRITTEN)
        label = "".join(f"/{k}={v}" for k, v in marks if k != "id")
        path = xxhash.xxh64_intdigest(f"{self.elements[above].path if above >= 0 else 0}/{name}{label}/{flags}") >> 1
        self.stack.append((name, len(self.elements)))
        self.elements.append(Element(path, above, flags))

    def read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.close((name,))
                if name not in INLINE:
                    self.flush()
                continue
            self.start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                end = RAW[name].search(source, at)
                self.close((name,))
                at = end.end() if end else len(source)
        if at < len(source):
            self.text(source[at:])

    def flags(self, block: Block) -> int:
        return self.elements[block.element].flags if block.element >= 0 else 0

    def held(self) -> list[int]:
        """What each element holds, in characters that are not links, of blocks that don't say they are no article."""
        sums = [0] * (len(self.elements) + 1)
        for b in self.blocks:
            if not self.flags(b) & IS_OTHER:
                sums[b.element] += len(b.text) - b.links
        for at in range(len(self.elements) - 1, -1, -1):  # parents stand before their children; the last place is the root's
            sums[self.elements[at].above] += sums[at]
        return sums

    def inside(self, at: int) -> list[Block]:
        """The blocks of an element and of what it holds."""
        within = {at}
        for i in range(at + 1, len(self.elements)):
            if self.elements[i].above in within:
                within.add(i)
        return [b for b in self.blocks if b.element in within]


class Template(NamedTuple):
    """A host's main slots, deepest first, with the element that each stands for, and the hashes of the host's own texts."""

    slots: dict[int, int]
    own: frozenset[int]


def token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=path & 0xFFFFFFFF) >> 1


def unlinked(page: Page, blocks: list[Block]) -> list[Block]:
    """The blocks but those of elements, by path, that hold mostly links; marked articles may hold what they like."""
    chars: dict[int, list[int]] = {}
    for b in blocks:
        have = chars.setdefault(page.elements[b.element].path if b.element >= 0 else 0, [0, 0])
        have[0] += len(b.text)
        have[1] += b.links
    mostly = {path for path, (n, links) in chars.items() if links >= LINKED * n}
    return [b for b in blocks if page.flags(b) & IS_ARTICLE or (page.elements[b.element].path if b.element >= 0 else 0) not in mostly]


def main_blocks(source: str | None, template: Template | None = None) -> list[str]:
    """The blocks of the main text, in page order."""
    page = Page(source)
    if template is not None and template.slots:
        places: dict[int, list[int]] = {}
        for at, e in enumerate(page.elements):
            places.setdefault(e.path, []).append(at)
        found = next((places[target][0] for slot, target in template.slots.items() if slot in places and len(places.get(target, ())) == 1), None)
        if found is not None:
            blocks = [b for b in page.inside(found) if not page.flags(b) & IS_OTHER]
            safe = IS_ARTICLE | IS_WRITTEN
            left = [b for b in blocks if page.flags(b) & safe == safe or token(page.elements[b.element].path, b.text) not in template.own]
            return [b.text for b in unlinked(page, left or blocks)]
    rest = [b for b in page.blocks if not page.flags(b) & IS_OTHER]
    marked = [b for b in rest if page.flags(b) & IS_ARTICLE]
    if sum(len(b.text) for b in marked) >= MAIN * sum(len(b.text) for b in rest):
        return [b.text for b in marked or rest]
    return [b.text for b in unlinked(page, rest)]


class Seen(NamedTuple):
    """A token of a host: what its pages sum up to, and what it is (for a text: its element's path and its characters)."""

    pages: int
    n: int
    low: int
    high: int
    held: int  # characters that an element holds, over all pages
    whole: int  # characters that its pages hold
    above: int  # path of the parent, for a text of its element
    depth: int
    first: int  # least place among its page's elements
    flags: int
    chars: int  # of a text, else 0


def nested(tokens: dict[int, Seen], all_: int) -> dict[int, int]:
    """The class of each token of the host's template: classes by vector, split by the parent of their topmost elements, of
    those that hang in a valid class or at the root."""
    kept = {t: s for t, s in tokens.items() if s.pages >= max(LEAST, SUPPORT * all_)}
    names: dict[tuple, int] = {}
    found: dict[int, int] = {}
    for t, s in sorted(kept.items(), key=lambda x: (x[1].chars > 0, x[1].depth, x[1].first, x[0])):  # parents first
        vector = (s.pages, s.n, s.low, s.high)
        if s.above and s.above not in found:
            continue  # its parent's class is not valid
        inherits = s.above in kept and (kept[s.above].pages, kept[s.above].n, kept[s.above].low, kept[s.above].high) == vector
        found[t] = found[s.above] if inherits else names.setdefault((vector, s.above), len(names))
    return found


def deduced(tokens: dict[int, Seen], all_: int) -> Template:
    """The template of a host's ``all_`` pages."""
    classes = nested(tokens, all_)
    elements = {t: tokens[t] for t in classes if not tokens[t].chars}
    own = {t for t in classes if tokens[t].chars and tokens[t].pages >= TEXTS and classes.get(tokens[t].above) == classes[t]}
    held = {t: s.held for t, s in elements.items()}
    lost: dict[int, int] = {}
    for t in own:  # the host's own texts are no slots: neither they nor what is around them may gain by them
        s, at = tokens[t], tokens[t].above
        if elements[at].flags & IS_OTHER:
            continue
        while at in held:
            lost[at] = lost.get(at, 0) + s.n * s.chars
            at = elements[at].above
    root = sum(n for at, n in lost.items() if not elements[at].above)
    headed = set()
    for t, s in elements.items():
        at = s.above if s.flags & IS_HEADING and not s.flags & IS_OTHER else 0
        while at in elements:
            headed.add(at)
            at = elements[at].above
    slots = {}
    once = lambda t: t in elements and elements[t].n == elements[t].pages and not elements[t].flags & IS_OTHER
    for t, s in sorted(elements.items(), key=lambda x: (-x[1].depth, x[1].first, x[0])):
        mine = held[t] - lost.get(t, 0)
        if not once(t) or mine <= 0 or mine < MAIN * (s.whole - root * s.pages / all_):
            continue
        around, at = [], t
        while at in elements:
            around.append(at)
            at = elements[at].above
        target = t
        if s.flags & IS_ARTICLE:
            target = max((a for a in around if elements[a].flags & IS_ARTICLE and once(a)), key=around.index)
        elif t not in headed:
            target = next((a for a in around if a in headed and once(a)), t)
        slots[t] = target
    return Template(slots, frozenset(own))


def counted(pages: list[tuple[int, str | None]]) -> dict[int, Seen]:
    """The tokens of some pages of a host, each page a key (a hash of what it is) and its html; at -1 the pages themselves."""
    sums: dict[int, list[int]] = {-1: [len(pages), len(pages), *[0] * 9]}
    for key, source in pages:
        page = Page(source)
        held = page.held()
        mine: dict[int, list[int]] = {}
        depth = []
        for at, (path, above, flags) in enumerate(page.elements):
            depth.append(depth[above] + 1 if above >= 0 else 1)
            have = mine.setdefault(path, [0, 0, page.elements[above].path if above >= 0 else 0, depth[at], at, flags, 0])
            have[0] += 1
            have[1] += held[at]
        for element, text, _ in page.blocks:
            if element >= 0:
                path = page.elements[element].path
                mine.setdefault(token(path, text), [0, 0, path, depth[element] + 1, element, 0, len(text)])[0] += 1
        for t, (n, chars, *what) in mine.items():
            vector = xxhash.xxh64_intdigest(f"{key}:{n}")
            new = [1, n, vector & 0x7FFFFFFF, vector >> 33, chars, held[-1]]
            have = sums.get(t)
            if have is None:
                sums[t] = new + what
            else:
                for i, x in enumerate(new):
                    have[i] += x
                have[8] = min(have[8], what[2])
    return {t: Seen(*v) for t, v in sums.items()}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(_host, all, slots, targets, own): for every host of ``LEAST`` pages or more, how many it has and its template.
    ``pages``: _host, _key, html."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("_host", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("token", *Seen._fields))])
    lists = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField("_host", T.StringType()), T.StructField("all", T.LongType()), *(T.StructField(n, lists) for n in ("slots", "targets", "own"))])

    def occurrences(batches):
        for part in arrow_rows(batches, 256):
            by: dict[str, list] = {}
            for where, key, source in zip(*(part.column(c).to_pylist() for c in ("_host", "_key", "html")), strict=True):
                by.setdefault(where, []).append((key, source))
            rows = [(where, t, *s) for where, own in by.items() for t, s in counted(own).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(1, len(schema)))], names=schema.names)

    def deduce(batches):
        for part in whole_groups(batches, ["_host"]):
            by: dict[str, dict[int, Seen]] = {}
            for where, t, *s in zip(*(part.column(c).to_pylist() for c in ("_host", "token", *Seen._fields)), strict=True):
                by.setdefault(where, {})[t] = Seen(*s)
            rows = [(where, tokens.pop(-1).pages, tokens) for where, tokens in by.items()]
            found = [(where, n, deduced(tokens, n)) for where, n, tokens in rows]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())]
            for pick in (lambda t: list(t.slots), lambda t: list(t.slots.values()), lambda t: sorted(t.own)):
                columns.append(pa.array([pick(f[2]) for f in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    most = {"above", "depth", "flags", "chars"}
    seen = pages.where("_host <> ''").mapInArrow(occurrences, schema)
    seen = seen.groupBy("_host", "token").agg(*[(F.max(c) if c in most else F.min(c) if c == "first" else F.sum(c)).alias(c) for c in Seen._fields])
    seen = written(seen.where(f"pages >= {LEAST}"), "occurrences")
    sizes = seen.where("token = -1").select("_host", F.col("pages").alias("_all"))
    kept = seen.join(sizes, "_host").where(F.col("pages") >= SUPPORT * F.col("_all")).drop("_all")
    # about the tokens of a few pages a host, however many pages it has; dealt by a hash of the host, for by the host itself
    # the join may have dealt them already, and split what was too much for a task
    return kept.repartition(F.xxhash64("_host")).sortWithinPartitions("_host").mapInArrow(deduce, made)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars."""
    import pyarrow as pa

    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("html"))
    keyed = own.select("_host", F.xxhash64("_id", "_url", "html").alias("_key"), "html")
    found = written(templates(keyed), "templates")
    kept = ("slots", "targets", "own")
    # hosts with a thousandth of all pages or more, a thousand at most, are broadcast and their pages stay where they
    # are; so do pages without a host. No other host has more than a thousandth of what the join deals by host.
    large = found.where(F.col("all") * LARGE >= pages.count()).select("_host", *kept, F.lit(True).alias("_large"))
    large = large.union(pages.sparkSession.createDataFrame([("", None, None, None, True)], large.schema))
    marked = own.join(F.broadcast(large), "_host", "left")
    small = marked.where("_large IS NULL").drop(*kept, "_large").join(found.select("_host", *kept), "_host", "left")
    columns = ("_id", "_url", "html", *kept)
    whole = marked.where("_large").select(*columns).union(small.select(*columns))
    schema = T.StructType([T.StructField("_id", pages.schema[id_col].dataType), T.StructField("_url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for part in arrow_rows(batches, 128):
            texts = []
            for source, slots, targets, texts_ in zip(*(part.column(c).to_pylist() for c in range(2, 6)), strict=True):
                template = Template(dict(zip(slots, targets, strict=True)), frozenset(texts_)) if slots else None
                texts.append(" ".join(main_blocks(source, template)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return whole.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
