"""Main text of pages by wrapper induction over the pages of a host.

Each page becomes a tree of labelled elements in which neighbours of one label are folded into
one slot.  A host's commonest tree is its reference; every page's tree is aligned with it by
simple tree matching.  A slot whose text is the same on nearly all of the host's different
pages is template; slots that vary are content, but for elements that are named as menus,
notices, adverts, forms or comments.  Names such as ``related`` or ``share`` count only on hosts of few pages.  A block's text is its own and that of the inline elements in
it.  Within a marked article a slot is template only from more pages and a share near 1, and only
where the page has that text; so is a single block (a notice among the paragraphs that were folded
with it) that nearly all of the host's different pages repeat, wherever it stands.  Headings are kept there, and so is an
article of which nothing else would remain.  The text of the page's article (or main element, or
body) is what remains, block by block.

Trees and text hashes leave the pages in one pass and are small; per host only counts are
aggregated, so a hot host costs no more than its rows.  A second pass extracts.

Cases: null html: empty; null url: pages without a host share one; repeated rows are extracted
one by one but counted once for the template; a host of few pages has no constant slots; an
empty table gives an empty result; markup that is cut off ends open elements; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, saved

#: A slot is template from so many different pages, and from such a share with one text.
PAGES, SHARE = 5, 0.9
#: The same for slots of a marked article, and for single blocks.
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.95
#: Cells of a table of two lists of children, and weights, that are kept at a time; nothing but memory depends on it.
CELLS = 250_000
#: Elements of a tree deeper than this are dissolved into their ancestor there, but for those that decide what is main text.
DEPTH = 200

#: What begins with a bracket; most tags end before the next one and are read at once.
_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)(?:([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+)>)?")
_MARK = re.compile("[>\"']")
_ODD = re.compile(r"[^\w:-]")
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and name words of what isn't main text, whatever the host's other pages hold.
APART = frozenset("nav footer aside form button select head dialog object audio video canvas".split()) | RAW
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu nav navbar "
    "navigation newsletter notice notices promo promotion sidebar sponsor sponsored".split()
)
#: Name words that count only where a host has too few pages for slots to tell.
WEAK_WORDS = frozenset("banner contentinfo disclaimer masthead modal popup related search share sharing social subscribe toolbar widget".split())


class Node:
    __slots__ = ("label", "tag", "words", "children")

    def __init__(self, tag: str, words: tuple[str, ...]):
        self.tag, self.words, self.children = tag, words, []
        self.label = ".".join((_ODD.sub("_", tag), *words))  # without the signs that skeletons are written with


@functools.lru_cache(4096)
def _named(attributes: str) -> tuple[str, ...]:
    words = []
    for _, a, b, c in _NAME.findall(attributes):
        words += _WORD.findall((a or b or c).lower())
    return tuple(sorted(set(words)))


class Tags:
    """Finds tags, comments and declarations by position; each place of the page is looked at a bounded number of times.

    A tag whose quotes or whose end are missing is text.  Places where a tag's attributes are known not to end are kept, so that
    many unclosed tags don't each search the rest of the page.
    """

    def __init__(self, page: str):
        self.page, self.dead, self.first = page, set(), (0, -1)

    def end(self, at: int) -> int:
        """Place behind the tag whose attributes begin at ``at``, or -1."""
        page, path = self.page, []
        while True:
            if not path and self.first[0] <= at <= self.first[1]:
                mark = self.first[1]
            else:
                m = _MARK.search(page, at)
                mark = m.start() if m else len(page)
                if not path:
                    self.first = at, mark
            if mark == len(page) or mark in self.dead:
                break
            path.append(mark)
            if page[mark] == ">":
                return mark + 1
            close = page.find(page[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(path)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str | None, str]:
        """(start, end, slash, name, attributes) of what comes first from ``at``; start is the page's length if nothing does."""
        page, n = self.page, len(self.page)
        while m := _OPEN.search(page, at):
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else n, "", None, ""
            if m[2] is None:
                end = page.find(">", m.end())
                return m.start(), end + 1 if end >= 0 else n, "", None, ""
            if m[3] is not None:
                return m.start(), m.end(), m[1], m[2], m[3]
            end = self.end(m.end())
            if end >= 0:
                return m.start(), end, m[1], m[2], page[m.end() : end - 1]
            # Tags that begin within this one's name have the same end, so only a comment can stand there.
            inner = min((k for sign in ("<!", "<?") if (k := page.find(sign, m.start() + 1, m.end())) >= 0), default=m.end())
            at = inner
        return n, n, "", None, ""


def parse(page: str) -> Node:
    """Tree of elements and strings; raw elements keep no text."""
    root = Node("root", ())
    stack: list[tuple[str, Node]] = [("root", root)]  # open elements, and the node that takes what is in them
    apart_at = article_at = 1 << 60  # below these heights of the stack lie an element apart, and an article
    at, n, tags, opened = 0, len(page), Tags(page), Counter()

    def close(k: int) -> None:
        nonlocal apart_at, article_at
        opened.subtract(tag for tag, _ in stack[k:])
        for tag, _ in stack[max(k, DEPTH) :]:
            if tag not in INLINE:
                stack[k - 1][1].children.append(Node("br", ()))
                break
        del stack[k:]
        apart_at = apart_at if apart_at < len(stack) else 1 << 60
        article_at = article_at if article_at < len(stack) else 1 << 60

    while at < n:
        start, end, slash, name, attributes = tags.after(at)
        if start > at:
            stack[-1][1].children.append(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        closing = {"p"} if name in CLOSES_P else SIBLINGS.get(name)
        if closing and any(opened[tag] > 0 for tag in closing):
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k][0]
                if tag in closing:
                    close(k)
                    break
                if tag not in INLINE and not (closing & {"td"} and tag in ("td", "th")):
                    break
        node = Node(name, _named(attributes) if attributes else ())
        parent = stack[-1][1]
        inner = len(stack)
        if inner >= DEPTH:
            apart, article = _apart(node, False), name in ("article", "main") or not {"article", "main"}.isdisjoint(node.words)
            if apart and apart_at > inner or article and min(apart_at, article_at) > inner or name in RAW or name in VOID:
                apart_at, article_at = (inner if apart and apart_at > inner else apart_at), (inner if article and article_at > inner else article_at)
            else:
                if name not in INLINE:
                    parent.children.append(Node("br", ()))
                node = None
        if node is not None:
            parent.children.append(node)
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            gone = page.find(">", end.end()) if end else -1
            at = gone + 1 if gone >= 0 else n
        elif name not in VOID and not attributes.endswith("/"):
            stack.append((name, node or parent))
            opened[name] += 1
    return root


def folded(nodes: list[Node]) -> tuple:
    """((label, children), ...) of the nodes' element children, equal neighbours folded."""
    runs: list[list] = []
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node):
                if runs and runs[-1][0] == c.label:
                    runs[-1][1].append(c)
                else:
                    runs.append([c.label, [c]])
    return tuple((label, group) for label, group in runs)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _own(node: Node) -> str:
    """A block's text: its strings and those of the inline elements in it."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag in INLINE and not _apart(c, False):
                walk(c)

    walk(node)
    return " ".join("".join(out).split())


def block_hash(node: Node) -> str:
    """Hash of a block's label and text; empty without text, and for inline elements."""
    own = "" if node.tag in INLINE else _own(node)
    return _digest(f"{node.label} {own}") if own else ""


def skeleton(root: Node) -> tuple[str, list[str]]:
    """The folded tree as text, and for each slot, in preorder, the hashes of its blocks."""
    hashes: list[str] = []

    def walk(nodes: list[Node]) -> str:
        out = []
        for label, group in folded(nodes):
            hashes.append(" ".join(h for g in group if (h := block_hash(g))))
            out.append(f"{label}({walk(group)})")
        return " ".join(out)

    return walk([root]), hashes


@functools.lru_cache(2048)
def _read(text: str) -> tuple:
    """A skeleton's text as nested (label, place, children, shape); equal subtrees have one shape."""
    stack, place, label = [[]], 0, ""
    names = []
    for token in re.findall(r"[^() ]+|[()]", text):
        if token == "(":
            names.append((label, place))
            place += 1
            stack.append([])
        elif token == ")":
            children = tuple(stack.pop())
            name, own = names.pop()
            stack[-1].append((name, own, children, _digest(f"{name}({' '.join(c[3] for c in children)})")))
        else:
            label = token
    return tuple(stack[0])


def _ends(a: tuple, b: tuple) -> tuple[int, int]:
    """How many trees at the beginning, and at the end behind them, are equal: nothing else could match more of them."""
    first = last = 0
    while first < min(len(a), len(b)) and a[first][3] == b[first][3]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last][3] == b[-1 - last][3]:
        last += 1
    return first, last


@functools.lru_cache(8192)
def aligned(page: str, reference: str) -> dict[int, int]:
    """Simple tree matching: the reference's slot for each matched slot of the page.

    Two lists of children have one largest matching whatever their lengths.  Of their table's rows, blocks are kept one at a time, with
    the row before each; the way back makes a block again.  Weights are known by shape and forgotten when they are many, so memory
    stays bounded; time grows with the product of the lists' lengths.
    """
    known: dict[tuple[str, str], int] = {}

    def weight(x: tuple, y: tuple) -> int:
        """Matched places of two trees."""
        if x[0] != y[0]:
            return 0
        if not x[2] or not y[2]:
            return 1
        key = x[3], y[3]
        if key not in known:
            w = 1 + total(x[2], y[2])
            if len(known) >= CELLS:
                known.clear()
            known[key] = w
            return w
        return known[key]

    def total(a: tuple, b: tuple) -> int:
        first, last = _ends(a, b)
        out = sum(weight(x, x) for x in (*a[:first], *a[len(a) - last :]))
        a, b = a[first : len(a) - last], b[first : len(b) - last]
        if not a or not b:
            return out
        for row in rows(a, b, np.zeros(len(b) + 1, dtype=np.int32)):
            pass
        return out + int(row[-1])

    def rows(a: tuple, b: tuple, row: np.ndarray):
        """The table's rows for the trees of a, each from the one before; a row holds the largest weight up to each place of b."""
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y[0], []).append(j)
        made: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        cells = 0
        for x in a:
            if x[0] in places:
                if x[3] not in made:
                    at = places[x[0]]
                    if cells > CELLS:
                        made.clear()
                        cells = 0
                    made[x[3]] = np.array(at), np.array([weight(x, b[j]) for j in at], dtype=np.int32)
                    cells += len(at)
                at, w = made[x[3]]
                now = row.copy()
                now[at + 1] = np.maximum(now[at + 1], row[at] + w)
                row = np.maximum.accumulate(now)
            yield row

    def pairs(a: tuple, b: tuple) -> list[tuple]:
        first, last = _ends(a, b)
        out = [*zip(a[:first], b[:first]), *zip(a[len(a) - last :], b[len(b) - last :])]
        a, b = a[first : len(a) - last], b[first : len(b) - last]
        j = len(b)
        if not a or not b:
            return out
        block = max(CELLS // (j + 1), math.isqrt(len(a)) + 1)
        before = [np.zeros(j + 1, dtype=np.int32)]
        for i in range(0, len(a) - block, block):
            for row in rows(a[i : i + block], b, before[-1]):
                pass
            before.append(row)
        for k in reversed(range(len(before))):
            part = a[k * block : (k + 1) * block]
            table = [before[k], *rows(part, b, before[k])]
            i = len(part)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    out.append((part[i - 1], b[j - 1]))
                    i, j = i - 1, j - 1
        return out

    out: dict[int, int] = {}
    todo = pairs(_read(page), _read(reference))
    while todo:
        x, y = todo.pop()
        out[x[1]] = y[1]
        todo += pairs(x[2], y[2])
    return out


def _apart(node: Node, in_article: bool, induced: bool = False) -> bool:
    """Whether an element isn't main text by its names; ``induced``: the host's slots tell the rest."""
    return node.tag in APART or (node.tag == "header" and not in_article) or not APART_WORDS.isdisjoint(node.words) or not induced and not WEAK_WORDS.isdisjoint(node.words)


def main_text(root: Node, constant: frozenset[int], repeated: frozenset[str] = frozenset(), induced: bool = False) -> str:
    """Blocks of the article in page order; ``induced``: the host has pages enough for slots to tell.

    ``constant`` slots (by place) are left out but in a marked article; ``repeated`` blocks (by hash, or
    as a slot's place and the hash of its blocks) anywhere but headings.
    """
    place, wanted = 0, []
    skip: set[int] = set()
    common: set[int] = set()

    def slots(nodes: list[Node]) -> None:
        nonlocal place
        for _, group in folded(nodes):
            if place in constant:
                skip.update(map(id, group))
            if repeated and group[0].tag not in HEADINGS:
                own = [block_hash(g) for g in group]
                if _slot(place, " ".join(filter(None, own))) in repeated:
                    common.update(map(id, group))
                common.update(id(g) for g, h in zip(group, own) if h in repeated)
            place += 1
            slots(group)

    if constant or repeated:
        slots([root])

    def find(node: Node, tags: tuple[str, ...]) -> None:
        for c in node.children:
            if isinstance(c, Node) and not _apart(c, False, induced):
                if c.tag in tags or any(w in ("article", "main") for w in c.words) and "main" in tags and c.tag != "body":
                    wanted.append(c)
                else:
                    find(c, tags)

    for tags in (("article",), ("main",), ("body",)):
        find(root, tags)
        if wanted:
            break
    blocks: list[str] = []
    line: list[str] = []
    content = False

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    def take(node: Node, within: bool, own: bool, heading: bool) -> None:
        nonlocal content
        for c in node.children:
            if isinstance(c, str):
                if own:
                    line.append(c)
                    content = content or not heading and not c.isspace()
            elif not _apart(c, within, induced):
                if c.tag in INLINE:
                    # Words within a line follow their block.
                    take(c, within, own, heading)
                else:
                    flush()
                    take(c, within, kept(c, within), heading or c.tag in HEADINGS)
                    flush()

    def kept(node: Node, within: bool) -> bool:
        return id(node) not in common and (within or id(node) not in skip)

    def read() -> None:
        for node in wanted or [root]:
            within = bool(wanted) and node.tag != "body"
            take(node, within, kept(node, within), False)
            flush()

    read()
    if common and not content and wanted and wanted[0].tag != "body":
        # An article that its host repeats as a whole is no template.
        common.clear()
        blocks.clear()
        read()
    return " ".join(blocks)


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def _slot(place: int, blocks: str) -> str:
    """A slot of the reference with the hash of its blocks."""
    return f"{place} {_digest(blocks)}" if blocks else ""


def templates(trees: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """host, reference, induced (whether slots tell), constant (its places) and repeated (places with their text, and
    blocks), for trees (host, tree, hashes)."""
    different = trees.groupBy("host", "tree", "hashes").agg(F.count("*").alias("copies"))
    counts = different.groupBy("host", "tree").agg(F.count("*").alias("n"))
    reference = saved(counts.groupBy("host").agg(F.min(F.struct(-F.col("n"), "tree"))["tree"].alias("reference")), "html-references")
    paired = different.join(reference, "host")

    def align(batches):
        for batch in batches:
            hosts, places, hashes = [], [], []
            for host, tree, own, ref in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for a, b in aligned(tree, ref).items():
                    if own[a]:
                        hosts.append(host), places.append(b), hashes.append(_digest(own[a]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(places, pa.int32()), pa.array(hashes, pa.string())], names=["host", "place", "hash"])

    filled = paired.select("host", "tree", "hashes", "reference").mapInArrow(align, "host string, place int, hash string")
    texts = filled.groupBy("host", "place", "hash").agg(F.count("*").alias("n"))
    slots = texts.groupBy("host", "place").agg(F.sum("n").alias("pages"), F.max_by("hash", F.struct("n", "hash")).alias("hash"), F.max("n").alias("most"))
    fixed = slots.where((F.col("pages") >= pages) & (F.col("most") >= share * F.col("pages"))).groupBy("host").agg(F.array_sort(F.collect_set("place")).alias("constant"))
    strict = (F.col("pages") >= ARTICLE_PAGES) & (F.col("most") >= ARTICLE_SHARE * F.col("pages"))
    places = slots.where(strict).select("host", F.concat_ws(" ", "place", "hash").alias("block"))
    total = counts.groupBy("host").agg(F.sum("n").alias("pages")).where(F.col("pages") >= ARTICLE_PAGES)
    blocks = different.select("host", F.explode(F.array_distinct(F.split(F.array_join("hashes", " "), " +"))).alias("block")).where("block <> ''")
    often = blocks.groupBy("host", "block").agg(F.count("*").alias("most")).where(F.col("most") >= ARTICLE_SHARE * ARTICLE_PAGES)
    single = often.join(total, "host").where(strict).select("host", "block")
    repeated = places.union(single).groupBy("host").agg(F.array_sort(F.collect_set("block")).alias("repeated"))
    induced = counts.groupBy("host").agg((F.sum("n") >= ARTICLE_PAGES).alias("induced"))
    return reference.join(induced, "host").join(fixed.join(repeated, "host", "full"), "host", "left")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    df = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", _host(F.col("url")))

    def trees(batches):
        for batch in batches:
            made = [skeleton(parse(h.as_py() or "")) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=["host", "tree", "hashes"])

    found = saved(df.select("host", "html").mapInArrow(trees, "host string, tree string, hashes array<string>"), "html-trees")
    wrapper = saved(templates(found), "html-templates")

    def extract(batches):
        for batch in batches:
            texts = []
            for page, ref, induced, places, blocks in zip(batch["html"], *(batch[k].to_pylist() for k in ("reference", "induced", "constant", "repeated"))):
                root = parse(page.as_py() or "")
                constant, repeated = frozenset(), frozenset(x for x in blocks or () if " " not in x)
                if ref is not None:
                    slots = dict(x.split(" ") for x in blocks or () if " " in x)
                    back = aligned(skeleton(root)[0], ref) if places or slots else {}
                    constant = frozenset(a for a, b in back.items() if b in set(places or ()))
                    repeated |= {f"{a} {slots[str(b)]}" for a, b in back.items() if str(b) in slots}
                texts.append(main_text(root, constant, repeated, bool(induced)))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = df.join(wrapper, "host", "left").select("page_id", "url", "html", "reference", "induced", "constant", "repeated")
    return joined.mapInArrow(extract, "page_id long, url string, text string")
