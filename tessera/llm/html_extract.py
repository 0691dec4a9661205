"""Main text of web pages: differencing against the nearest URL of the host, confirmed by structure.

A page is cut into lines, its blocks (paragraphs, headings, list items ...), with the containers they
stand in. Every page is paired by URL path with a page of its host, the lines of both are aligned by
longest common subsequence, and the shared lines are deleted. Structure follows as a check in both
directions. Lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments go
although no other page has them, told by element, role, and whole tokens of class and id; scripts,
styles and markup are no text. If the page names its article (article, main or role=main, outside such
parts), its text is the lines inside it, shared ones too: pages quote the same passages, and a copy
under a near URL would delete the whole article.

Pairing: the levels of a page are its host and each longer run of path segments but the last. Of the
pages of a level CANDIDATES at most stand for it, the one with the smallest digest of its lines in each
part of the digests (aggregated map-side, so a host with a third of all pages is no hot group). A
page takes the first candidate of its deepest level, and further ones up to the host, as long as it is
refused: pages of equal lines are, and, where no article is named, pages that share NEARLY of the
text left by structure, which are copies and would delete it. Lines travel as hashes. The candidates'
hashes go to the tasks as a broadcast if they are at most NUMBERS, and by a join beyond it; texts do not
move in the first case and move once in the second.

Defined results: null html has an empty text; a null url makes a host of its own; a page without partner
loses nothing by differencing; equal pages under different ids and repeated rows are no partners of each
other. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, written
from tessera.llm.textarrays import mixed
from tessera.session import table

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|[!?/][^>]*+(?:>|\Z))""", re.DOTALL)
#: One whole attribute, so that a name is never looked for inside another name or a value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]++))?""")
WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes template svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var object math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mfenced semantics annotation".split())
CELL = frozenset("td th br img wbr".split())
GONE = frozenset("nav header footer aside menu dialog button select option fieldset noscript head audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead banner cookie cookies consent gdpr notice notices notification notifications alert comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe signup login search popup modal toolbar pagination pager".split()
)
#: Words that may stand beside one of NAMES in a compound such as share-bar; with any other word (entry-header, no-sidebar) it is no known compound.
PARTS = frozenset("bar box area list wrapper wrap container section block widget widgets link links button buttons form site top bottom main primary secondary global inner item items slot unit panel icon icons overlay body meta posts articles stories".split())
#: The same for header, which names titles too.
SITE = frozenset("site global top main bar wrapper wrap inner container".split())
#: Parts that list other articles: an article in them is not the page's.
AREAS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments commentlist disqus reply replies respond related recommended newsletter".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; any other tag closes it.
HEAD = frozenset("html head title meta link style script base noscript template".split())
NESTED = frozenset(("svg", "template"))
UNCLOSED = re.compile("<(?=[a-zA-Z/!?])")
#: How firmly an element is no content: by a word or as a form (an article or main in it is content still), by a word of AREAS (only main is), by element, role or hidden.
WORDED, AREA, FIRM = 1, 2, 3
#: Bits that an alignment's rows may hold; longer alignments are split.
ALIGN_BITS = 1 << 28
#: Pages that stand for a level; the share of a page's text that makes a partner its copy; line hashes that may be broadcast.
CANDIDATES, NEARLY, NUMBERS = 4, 0.9, 1 << 20


def _worded(value: str, inside: bool) -> int:
    """Whether a whole token of class or id names a part that is no content."""
    level = 0
    for token in value.split():
        said = set(WORD.findall(token))
        names = said & NAMES
        if names and not (inside and "header" in names):
            beside = SITE if "header" in names else PARTS
            if all(x in names or x in beside or x[0].isdigit() for x in said):
                level = max(level, WORDED if names.isdisjoint(AREAS) else AREA)
    return level


def _dropped(tag: str, rest: str, inside: bool, nested: bool) -> tuple[int, bool]:
    """How firmly an element is no content, and whether it names the article. Within the article, a header is its heading and headings stay whatever their class; words drop no main, and articles only if nested in an article."""
    if tag in GONE and not (tag == "header" and inside):
        return FIRM, False
    main, level = tag in MAIN, WORDED if tag == "form" else 0
    if len(rest) > 3:
        for name, value in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                if value in ROLES:
                    return FIRM, False
                main = main or value == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return FIRM, False
            elif name in ("class", "id") and tag not in ("body", "html"):
                level = max(level, _worded(value, inside))
    if (main and not (tag == "article" and nested)) or (inside and tag in HEADINGS):
        level = 0
    return level, main and not level


class _Open:
    """The open elements: (name, how firmly no content, inside the named article), with where each name and each element that is not inline stands, so that no tag looks through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.where: dict[str, list[int]] = {}
        self.solid = [0]

    def push(self, tag: str, gone: int, inside: bool) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((tag, gone, inside))

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.where[tag].pop()
            if tag not in INLINE:
                self.solid.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that name, 0 if there is none."""
        return (self.where.get(tag) or [0])[-1]


def _raw_end(html: str, tag: str, at: int, stop: int) -> int:
    """Where the text behind an element without content begins: svg and template nest, the others end at their first end tag."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])([^>]*)>", re.IGNORECASE).finditer(html, at, stop):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif tag in NESTED and not m[2].endswith("/"):
            depth += 1
    return len(html)


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, content, inside the named article) of each block in page order, in time linear in the page."""
    out: list[tuple[str, bool, bool]] = []
    opened = _Open()
    stack = opened.stack
    pieces: list[str] = []
    at, n = 0, len(html)
    stop = html.rfind(">") + 1  # no tag ends behind it

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, not stack[-1][1], stack[-1][2]))
            pieces.clear()

    def leave_head() -> None:
        flush()
        opened.cut(opened.last("head"))

    while at < n:
        m = TAG.search(html, at, stop) if at < stop else None
        cut = None if m else UNCLOSED.search(html, at)
        end = m.start() if m else cut.start() if cut else n
        if end > at:
            text = html[at:end]
            if stack[-1][0] == "head" and not text.isspace():
                leave_head()
            pieces.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break  # an unclosed tag is markup to the end of the page
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = m[2].lower()
        if m[1]:
            place = opened.last(tag)
            if tag in RAW or tag in VOID or not place:
                if tag in ("p", "br"):
                    flush()
                continue
            if tag in INLINE and not stack[-1][1]:
                if place > opened.solid[-1]:
                    opened.cut(place)
                continue
            if tag not in CELL:
                flush()
            opened.cut(place)
            if tag in CELL:
                pieces.append(" ")
            continue
        if tag not in HEAD and opened.last("head"):
            leave_head()
        if tag in RAW:
            at = at if m[3].endswith("/>") else _raw_end(html, tag, at, stop)
            continue
        if tag in CELL:
            pieces.append(" ")
        elif tag not in INLINE:
            flush()
            k = opened.solid[-1]
            if stack[k][0] == "p" or (stack[k][0] == tag and tag in ("li", "dt", "dd", "tr", "option")):
                opened.cut(k)
        if tag in VOID:
            continue
        outer = stack[-1][1]
        gone, main = _dropped(tag, m[3], stack[-1][2], tag == "article" and bool(opened.last("article")))
        if main and outer and outer <= (WORDED if tag == "article" else AREA):
            outer = 0
        if gone and not outer:
            flush()
        opened.push(tag, max(outer, gone), stack[-1][2] or main)
    flush()
    return out


def line_hash(text: str) -> int:
    raw = np.frombuffer(text.encode().ljust((len(text.encode()) + 7) // 8 * 8, b"\0"), np.uint64)
    with np.errstate(over="ignore"):
        return int(mixed((mixed(raw ^ np.arange(1, len(raw) + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of a with each prefix of b, by bit vectors."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for bit in format(v, f"0{len(b)}b")[::-1] if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(a: list, b: list) -> list[bool]:
    """For each element of a whether it is in one longest common subsequence of a and b. Memory stays below ALIGN_BITS: longer pairs are halved at the best cut."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y:
        middle = [False] * len(x)
    elif len(x) > 1 and len(x) * len(y) > ALIGN_BITS:
        half = len(x) // 2
        first, second = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: first[j] + second[len(y) - j])
        middle = shared_lines(x[:half], y[:cut]) + shared_lines(x[half:], y[cut:])
    else:
        where: dict = {}
        for j, e in enumerate(y):
            where[e] = where.get(e, 0) | (1 << j)
        full, v, seen = (1 << len(y)) - 1, (1 << len(y)) - 1, []
        for e in x:
            u = v & where.get(e, 0)
            v = ((v + u) | (v - u)) & full
            seen.append(v)
        middle, j = [False] * len(x), len(y)
        for i in range(len(x) - 1, -1, -1):
            # the zeros of a row are the places where its subsequence grows; row i matters if it has one more than the row above
            below = full if i == 0 else seen[i - 1]
            row = ~seen[i] & ((1 << j) - 1)
            if not row:
                break
            if (~below & ((1 << j) - 1)).bit_count() < row.bit_count():
                middle[i] = True
                # the match is the last place of x[i] in y[:j] at or before which the row above has one less
                m = where[x[i]] & ((1 << j) - 1)
                need = row.bit_count() - 1
                while m:
                    k = m.bit_length() - 1
                    if (~below & ((1 << k) - 1)).bit_count() == need:
                        break
                    m &= ~(1 << k)
                j = k
    return [True] * lo + middle + [True] * hi


def url_levels(url: str | None) -> list[bytes]:
    """Digests of the host, then of the host with one more path segment each, without the last segment."""
    if url is None:
        return [b"\0" * 16]
    try:
        parts = urlsplit(url)
        host, path = (parts.netloc or "").lower(), parts.path
    except ValueError:
        host, path = url, ""
    segments = [x for x in path.split("/") if x]
    made = hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=16)
    out = [made.digest()]
    for x in segments[:-1]:
        made.update(b"/" + x.encode("utf-8", "replace"))
        out.append(made.digest())
    return out


#: flags: for each hash 0 if structure drops the line, 1 if it stays unless differencing deletes it, 2 if it stays; lines: those of the last two.
PARSED = "page_id bigint, url string, named boolean, lines array<string>, flags array<tinyint>, hashes array<bigint>, digest binary, levels array<binary>"
RESULT = "page_id bigint, url string, text string, n_chars bigint, named boolean, n_shared bigint, n_restored bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
    for batch in batches:
        rows = []
        for url, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = blocks(raw or "")
            has = any(content and main for _, content, main in found)
            flags = [0 if not content or (has and not main) else 2 if has else 1 for _, content, main in found]
            hashes = [line_hash(text) for text, _, _ in found]
            digest = hashlib.blake2b(np.array(hashes, np.int64).tobytes(), digest_size=16).digest()
            rows.append((has, [x[0] for x, f in zip(found, flags, strict=True) if f], flags, hashes, digest, url_levels(url)))
        made = zip(*rows, strict=True) if rows else ([] for _ in kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names)


def difference(lines: list[str], flags: list[int], hashes: list[int], digest: bytes, others: Iterable[tuple[bytes, list[int]]]) -> tuple[list[str], int, int]:
    """(lines that stay, number of shared lines deleted, of shared lines that structure restores) by the first of others (digest, hashes; nearest first) that is no copy."""
    same = [False] * len(hashes)
    total = sum(map(len, lines))
    for their_digest, their_hashes in others:
        if their_digest == digest:
            continue
        same = shared_lines(hashes, their_hashes)
        kept = iter(lines)
        alike = sum(len(next(kept)) * s for f, s in zip(flags, same, strict=True) if f == 1)
        if not alike or alike < NEARLY * total:
            break
        same = [False] * len(hashes)
    kept = iter(lines)
    return [x for x, f, s in ((next(kept), f, s) for f, s in zip(flags, same, strict=True) if f) if f == 2 or not s], sum(s and f != 2 for f, s in zip(flags, same, strict=True)), sum(s and f == 2 for f, s in zip(flags, same, strict=True))


def _difference(held: Broadcast | None):
    """RESULT from PARSED rows; candidates by level from a broadcast, or else from a further column others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            made = []
            for k, levels in enumerate(column["levels"]):
                others = [o for level in reversed(levels) for o in held.value.get(level, ())] if held else [(o["digest"], o["hashes"]) for o in column["others"][k] or ()]
                lines, n_shared, n_restored = difference(*(column[c][k] for c in ("lines", "flags", "hashes", "digest")), others)
                text = "\n\n".join(lines)
                made.append((column["page_id"][k], column["url"][k], text, len(text), column["named"][k], n_shared, n_restored))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else ([] for _ in kinds), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def candidates(parsed: DataFrame) -> DataFrame:
    """(level, digest, hashes): at most CANDIDATES pages of different lines for each level, the smallest digest in each part of them."""
    part = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") % CANDIDATES
    rows = parsed.select(F.explode("levels").alias("level"), part.alias("part"), F.struct("digest", "hashes").alias("page"))
    return rows.groupBy("level", "part").agg(F.min("page").alias("page")).select("level", "page.digest", "page.hashes")


def extract(spark: SparkSession, pages: DataFrame, numbers: int = NUMBERS) -> DataFrame:
    """RESULT: text, n_chars, named (whether the page names its article) n_shared (lines that differencing deletes) and n_restored (shared lines of the article, which structure restores); a row for each page."""
    small_batches(spark)
    made = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(_parse, PARSED)
    parsed = written(spark, made, "pages")
    met = written(spark, candidates(parsed), "pages-candidates")
    if (met.agg(F.sum(F.size("hashes") + 16)).first()[0] or 0) <= numbers:
        by_level: dict[bytes, list[tuple[bytes, list[int]]]] = {}
        for r in sorted(met.toArrow().to_pylist(), key=lambda r: (r["level"], r["digest"])):
            by_level.setdefault(r["level"], []).append((r["digest"], r["hashes"]))
        return parsed.mapInArrow(_difference(spark.sparkContext.broadcast(by_level)), RESULT)
    keyed = written(spark, parsed.select(F.monotonically_increasing_id().alias("rid"), "*"), "pages-keyed")
    asked = keyed.select("rid", F.posexplode("levels").alias("depth", "level")).join(met, "level")
    others = asked.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("up"), "digest", "hashes"))), lambda o: F.struct(o["digest"].alias("digest"), o["hashes"].alias("hashes"))).alias("others"))
    return keyed.join(others, "rid", "left").drop("rid").mapInArrow(_difference(None), RESULT)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
