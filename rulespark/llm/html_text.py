"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulespark.llm.common import stored, taken_name
from rulespark.session import fits_broadcast

CONSTANT = 0.5  # share of a host's pages that must agree with the reference page for a slot to be template
LINKED = 0.6  # share of link characters from which a slot is a menu
LEAST_PAGES = 3  # pages that must speak about a slot; a smaller host's pages go by their markup alone
REFERENCES = 3  # pages of least hash among which a host's reference, one with blocks, is taken
SALTS = 64  # parts of a host's pages where its row cannot be broadcast
DEEP = 200  # levels of elements that tell slots apart; text below is kept like any other

_LEFT = r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])[^>]*(?:>|\Z).*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)"
# A tag's quoted values may hold anything. Where a quote or tag is never closed, the match ends before it without a `>`,
# and from there on tags are read without regard to quotes.
_TOKEN = re.compile(_LEFT + r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|(?=["'])|\Z)|[^<]+|<""", re.S | re.I)
_PLAIN_TOKEN = re.compile(_LEFT + r"|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|[^<]+|<", re.S | re.I)
# Elements left out with all that is in them if their own end tag follows; without one the tag alone is left out.
_WHOLE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("noscript", "template", "svg", "iframe", "select")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROP = frozenset("nav footer aside form head menu dialog button label fieldset object canvas audio video map".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Names that rule an element out, and names that do so only for blocks that are mostly links or that the host repeats.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|menu|nav|navbar|navigation|topbar|sidebar|footer|masthead|cookies?|consent|gdpr|"
    r"notices?|comments?|disqus|respond|replies|sharing|breadcrumbs?|pagination|pager|newsletter|subscribe|popup|modal)(?:$|[\s_-])",
    re.I,
)
_WEAK_HINT = re.compile(r"(?:^|[\s_-])(?:promo\w*|alert|share|social|related|widget|login|search)(?:$|[\s_-])", re.I)
# Elements that are told apart by their place among siblings of one label; repeats of others, such as paragraphs, are one slot.
_NUMBERED = frozenset("div section article main aside header footer nav table ul ol dl form blockquote figure".split())
_DIGITS = re.compile(r"\d{2,}")


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Class label of a tag, whether the attributes mark it as no content, and whether they only hint at it."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    label = " ".join(sorted(_DIGITS.sub("0", found.get("class", "")).split()))
    marked = hidden or found.get("role", "").lower() in _ROLES or bool(names and _HINT.search(names))
    return label, marked, bool(names and _WEAK_HINT.search(names))


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    links: int  # characters of it inside links
    dropped: bool  # its markup rules it out
    inside: bool  # article or main
    hinted: bool  # its markup hints that it is none


def blocks(page: str | None) -> list[Block]:
    """The text blocks in page order.

    The path holds the labels (tag and classes) of the block elements around it, DEEP of them; siblings of one label are
    numbered if they hold other blocks, so paths are the nodes of the page's tree with repeated paragraphs and items folded.
    """
    out = []
    stack = [("", (), False, False, False, {})]  # tag, path, excluded, inside, hinted, labels of children
    text: list[str] = []
    links = 0
    inline: list[str] = []
    until = 0  # end of the element that is being left out
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, path, dropped, inside, hinted, _ = stack[-1]
                out.append(Block(path, joined, min(links, len(joined)), dropped, inside, hinted))
            text.clear()
        links = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    for m in _tokens(page or ""):
        if m.start() < until:
            continue
        raw = m[0]
        name = m[3]
        if name is None:
            if raw[0] != "<" or raw == "<":
                piece = html.unescape(raw) if "&" in raw else raw
                text.append(piece)
                if "a" in inline:
                    links += len(piece.strip())
            elif m[1] and m[1].lower() == "textarea":
                text.append(" ")
            continue
        name = name.lower()
        if name in _WHOLE:
            if name in ("svg", "iframe", "select"):
                text.append(" ")
            if not m[2] and not (name == "svg" and raw.endswith("/>")) and name not in unclosed:
                end = _WHOLE[name].search(page, m.end())
                if end:
                    until = end.end()
                else:
                    unclosed.add(name)
            continue
        if m[2]:
            if name in _INLINE:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name):]
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    inline.clear()
                    break
                if name in ("p", "li") and stack[depth][0] in ("article", "main", "section", "div", "td", "ul", "ol"):
                    break
            continue
        if name in _INLINE:
            if not raw.endswith("/>"):
                inline.append(name)
            continue
        if name in _VOID:
            text.append(" ")
            if name == "hr":
                flush()
            continue
        if name in _CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag == "p" and name in _CLOSES_P or tag == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                    close(depth)
                    break
                if tag in ("ul", "ol", "table", "div", "article", "main", "section", "body", "td", "blockquote"):
                    break
        flush()
        inline.clear()
        label, marked, weak = _attributes(m[4]) if m[4] else ("", False, False)
        _, path, dropped, inside, hinted, children = stack[-1]
        core, page_wide = name in ("article", "main"), name in ("html", "body")
        dropped = dropped or name in _DROP or (marked and not page_wide) or (name == "header" and not inside)
        step = f"{name}.{label}" if label else name
        if name in _NUMBERED:
            children[step] = children.get(step, 0) + 1
            if children[step] > 1:
                step = f"{step}#{children[step]}"
        stack.append((name, (*path, step) if len(path) < DEEP else path, dropped, inside or core, hinted or (weak and not page_wide), {}))
    flush()
    return out


def _tokens(page: str) -> Iterator[re.Match]:
    at = 0
    for m in _TOKEN.finditer(page):
        if m[3] is not None and page[m.end() - 1] != ">":
            break
        yield m
        at = m.end()
    if at < len(page):
        yield from _PLAIN_TOKEN.finditer(page, at)


def _digest(parts: list[str]) -> int:
    return zlib.crc32("\n".join(parts).encode("utf-8", "surrogatepass"))


def slots(found: list) -> dict[tuple[str, ...], tuple[int, int, int, bool]]:
    """path -> (digest of its texts, characters, link characters, excluded by its markup)."""
    parts: dict[tuple[str, ...], list] = {}
    for path, text, links, dropped, *_ in found:
        slot = parts.setdefault(path, [[], 0, True])
        slot[0].append(text)
        slot[1] += links
        slot[2] &= dropped
    return {p: (_digest(t), sum(map(len, t)), n, d) for p, (t, n, d) in parts.items()}


def _tree(paths) -> dict:
    root: dict = {}
    for path in paths:
        node = root
        for label in path:
            node = node.setdefault(label, {})
    return root


def match(a: dict, b: dict) -> tuple[int, list[tuple[str, str, list]]]:
    """Simple tree matching of two forests in order: the most nodes matched, and the pairs with the pairs below them."""
    left, right = list(a.items()), list(b.items())
    below = {}
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, (x, xs) in enumerate(left, 1):
        for j, (y, ys) in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if x.split("#")[0] == y.split("#")[0]:
                below[i, j] = match(xs, ys) if xs and ys else (0, [])
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + 1 + below[i, j][0])
    i, j, pairs = len(left), len(right), []
    while i and j:
        if (i, j) in below and best[i][j] == best[i - 1][j - 1] + 1 + below[i, j][0]:
            pairs.append((left[i - 1][0], right[j - 1][0], below[i, j][1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def aligned(reference: dict, page: dict) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Paths of the page and the reference's nodes that simple tree matching puts them on (labels along both are equal)."""
    out = {}

    def walk(pairs, theirs, own):
        for there, here, below in pairs:
            out[(*own, here)] = (*theirs, there)
            walk(below, (*theirs, there), (*own, here))

    walk(match(reference, page)[1], (), ())
    return out


def reference_of(page: str | None) -> str:
    """A page's slots as text: what the host's other pages are aligned with."""
    return json.dumps([[list(p), *v] for p, v in slots(blocks(page)).items()])


def _read(reference: str | None) -> dict[tuple[str, ...], tuple]:
    return {tuple(p): tuple(v) for p, *v in json.loads(reference)} if reference else {}


class Aligner:
    """Aligns pages with a host's reference; remembers alignments of equal shapes."""

    def __init__(self):
        self.known: dict = {}
        self.read: dict = {}

    def reference(self, text: str) -> tuple[dict, dict]:
        if text not in self.read:
            if len(self.read) > 2000:
                self.read.clear()
            own = _read(text)
            self.read[text] = (own, _tree(own))
        return self.read[text]

    def paths(self, text: str, page: dict) -> dict:
        key = (text, tuple(page))
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = aligned(self.reference(text)[1], _tree(page))
        return self.known[key]


def _votes(own: dict, reference: dict, paths: dict) -> Iterator[tuple[str, int, int, int]]:
    """(reference slot, 1 if equal to the reference, characters, link characters) of aligned slots.

    A page whose longest free slot is the reference's is a copy of it and says nothing about the template.
    """
    free = [p for p, v in own.items() if not v[3]]
    if free:
        longest = paths.get(max(free, key=lambda p: own[p][1]))
        if longest in reference and any(own[p][0] == reference[longest][0] for p in free if paths.get(p) == longest):
            return
    for p in own:
        there = paths.get(p)
        if there in reference:
            yield json.dumps(there), int(own[p][0] == reference[there][0]), own[p][1], own[p][2]


def _mostly_links(block: Block) -> bool:
    return block.links >= LINKED * len(block.text)


def main_text(found: list[Block], template: set[tuple[str, ...]] = frozenset(), menus: set[tuple[str, ...]] = frozenset()) -> str:
    """Blocks that are no template, menu or marked boilerplate; only those within article or main where they hold most of them.

    `template` are the page's own slots whose text is the host's constant. In a menu's slot, and where markup only hints, a block goes if
    it is mostly links itself; within article or main a menu's slot is no reason.
    """
    def goes(b: Block) -> bool:
        return b.dropped or b.path in template or (b.path in menus and not b.inside and _mostly_links(b)) or (b.hinted and _mostly_links(b))

    free = [b for b in found if not goes(b)]
    inside = [b for b in free if b.inside]
    size = lambda some: sum(len(b.text) for b in some)
    return "\n\n".join(b.text for b in (inside if 2 * size(inside) >= size(free) else free))


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _told(pages: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """pages joined to the one row of their host: by a broadcast whose size is checked, or else salted, as a host may hold a third of all pages."""
    if fits_broadcast(hosts):
        return pages.join(F.broadcast(hosts), "host", how)
    salt, own = taken_name(pages, "salt", "own_salt")
    spread = pages.withColumn(salt, F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)))
    copies = hosts.withColumn(own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("host", "host_")
    return spread.join(copies, (F.col("host") == F.col("host_")) & (F.col(salt) == F.col(own)), how).drop(salt, own, "host_")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row of df, from the whole html.

    Wrapper induction by host: of the pages with the smallest hashes the first with blocks is the host's reference; every page is
    aligned with it by simple tree matching and says of each slot whether its text is the reference's. Sums per (host, slot),
    taken in each task first, decide: slots that mostly agree are template, link lists are menus, varying slots are content. A page
    loses what is aligned with a template slot and has its text; another text in the same slot stays. Slots that the reference
    lacks, and hosts of up to LEAST_PAGES pages, go by element names, roles and class names, which also rule out what varies
    and still is no article (advert, menu, footer, form, comment). A host is never gathered: its reference and verdict are
    one row, joined to its pages. Null html gives an empty text, a null or odd url is no host; repeated rows each get a
    row; an empty table gives an empty result.
    """
    spark = df.sparkSession
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    draw = F.xxhash64("url", "html")
    hosted = pages.where("host <> '' and html is not null")
    # a page without a character between tags has no block
    drawn = hosted.where(F.col("html").rlike(r"(?:^|>)\s*[^<>\s]")).select("host", draw.alias("draw"))
    large = drawn.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(f"n > {LEAST_PAGES}").select("host")
    place = F.row_number().over(Window.partitionBy("host").orderBy("draw"))
    first = drawn.groupBy("host", "draw").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where(F.col("place") <= REFERENCES)
    least = stored(first.join(large, "host", "left_semi").select("host", "draw", "place"), "hosts")
    chosen = hosted.withColumn("draw", draw).join(least, ["host", "draw"]).dropDuplicates(["host", "draw"])

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reference_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(2)], names=["host", "reference", "place"])

    read_pages = chosen.select("host", "html", "place").mapInArrow(refer, "host string, reference string, place int").where("reference <> '[]'")
    references = stored(read_pages.groupBy("host").agg(F.min_by("reference", "place").alias("reference")), "references")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        sums: dict = {}
        for batch in batches:
            for host, page, text in zip(*batch.columns):
                host, text = host.as_py(), text.as_py()
                own = slots(blocks(page.as_py()))
                for slot, same, chars, links in _votes(own, aligner.reference(text)[0], aligner.paths(text, own)):
                    total = sums.setdefault((host, slot), [0, 0, 0, 0])
                    for i, x in enumerate((1, same, chars, links)):
                        total[i] += x
            if len(sums) > 100_000:
                yield summed(sums)
                sums = {}
        if sums:
            yield summed(sums)

    def summed(sums: dict) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["host", "slot", "n", "same", "chars", "links"])

    votes = _told(hosted, references, "inner").select("host", "html", "reference").mapInArrow(vote, "host string, slot string, n bigint, same bigint, chars bigint, links bigint")
    judged = votes.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "same", "chars", "links")]).where(f"n >= {LEAST_PAGES}")
    verdict = judged.select(
        "host", "slot", (F.col("same") >= CONSTANT * F.col("n")).alias("constant"), (F.col("links") >= LINKED * F.greatest("chars", F.lit(1))).alias("menu")
    ).where("constant or menu")
    wrappers = stored(verdict.groupBy("host").agg(
        F.collect_list(F.when(F.col("constant"), F.col("slot"))).alias("constant"), F.collect_list(F.when(F.col("menu"), F.col("slot"))).alias("menu")
    ), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        slots_of = lambda c: {tuple(json.loads(s)) for s in c or ()}
        for batch in batches:
            texts, known = [], {}
            for page, constant, menu, reference in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                found, constant, menu = blocks(page.as_py()), constant.as_py(), menu.as_py()
                if not (constant or menu):
                    texts.append(main_text(found))
                    continue
                key = (tuple(constant or ()), tuple(menu or ()))
                if key not in known:
                    known[key] = (slots_of(constant), slots_of(menu))
                own, (theirs, _) = slots(found), aligner.reference(reference.as_py())
                paths = aligner.paths(reference.as_py(), own)
                there = {p: paths[p] for p in own if p in paths}
                template = {p for p, t in there.items() if t in known[key][0] and own[p][0] == theirs[t][0]}
                texts.append(main_text(found, template, {p for p, t in there.items() if t in known[key][1]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    wrappers = stored(wrappers.join(references, "host"), "told")
    told = _told(pages, wrappers, "left").select("id", "url", "html", "constant", "menu", "reference")
    out = told.mapInArrow(read, f"id {df.schema[id_col].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
