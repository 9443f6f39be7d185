"""Main text of web pages by nearest-URL page differencing, ties broken by markup.

A page is cut into text lines, each with a standing that markup gives it: in
the article, doubtful (in the article, but in a box whose name hints at
boilerplate), open (outside any article), or nothing at all (menus, forms,
adverts, scripts, ...). Pages are sorted by host and URL path; each is paired
with the nearest page of its host that has other lines, by the longer shared
path prefix, and all their lines are aligned by longest common subsequence.
Shared lines are template: open and doubtful ones are deleted. Only where an
article element vouches for a shared line does it stay, as two articles may
well share a line.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import hash64, load, materialise, parts

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
DROPPED = frozenset("head nav aside footer form button dialog menu".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder q s samp semantics small span strike strong sub sup time tt u var wbr".split())
#: Elements that are text themselves: inside an article no name makes them boilerplate.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table thead tbody tr td th dl dt dd li".split()) | INLINE
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


def _parts(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])", re.I)


#: Words in class and id that name boilerplate, by whole parts of those names.
CERTAIN = _parts("ad ads adbox advert adverts advertisement advertising sponsor sponsored comment comments commentlist reply replies respond disqus newsletter subscribe share sharing social cookie cookies consent gdpr pagination pager breadcrumb breadcrumbs")
HINTS = _parts("banner promo nav navbar navigation menu sidebar side widget related recommended footer header masthead notice alert popup modal signup login toolbar skip copyright")
TEASERS = _parts("teaser card preview related recommended promo comment comments reply")
ATTRIBUTE = re.compile(r"\s(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
OPEN, ARTICLE, DOUBT, TEASER = 0, 1, 2, 3
#: Bits of the table of one alignment (rows times columns); longer pages are halved first.
TABLE_BITS = 1 << 27


def _judged(tag: str, name: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate for certain, and whether its name hints at it."""
    if name in DROPPED or (name == "header" and not inside):
        return True, False
    hint = False
    if " " in tag or "\n" in tag or "\t" in tag:
        for key, *values in ATTRIBUTE.findall(tag):
            value, key = "".join(values), key.lower()
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES and not (inside and name in PROSE)):
                return True, False
            if key in ("class", "id") and name not in ("html", "body", "main") and not (inside and name in PROSE):
                if name == "article":
                    hint = hint or bool(TEASERS.search(value))
                elif not inside and (CERTAIN.search(value) or HINTS.search(value)):
                    return True, False
                elif inside and key == "class" and CERTAIN.search(value):
                    return True, False
                elif inside and (CERTAIN.search(value) or HINTS.search(value)):
                    hint = True
    return (inside and hint and name == "article", hint)


def lines_of(html: str) -> list[tuple[int, str]]:
    """(standing, text) of each non-empty block in page order, boilerplate left out.

    An end tag closes the nearest open element of its name and what stands in
    it, so unclosed inline and paragraph tags don't swallow what follows;
    every element is opened and closed once, whatever the depth. A form around
    a whole article isn't a form of the article.
    """
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, what it adds to ``skip``, form, hint, kind of article
    at_of: dict[str, list[int]] = {}
    skip = forms = hints = article = teaser = 0

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((TEASER if teaser else DOUBT if article and hints else ARTICLE if article else OPEN, text))

    def pop() -> None:
        nonlocal skip, forms, hints, article, teaser
        name, unwanted, form, hint, own = stack.pop()
        at_of[name].pop()
        skip -= unwanted
        forms -= form
        hints -= hint
        article -= own > 0
        teaser -= own == 2

    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        seen = not skip and (article or not forms)
        if seen:
            buffer.append(html[at : found.start() if found else end])
        if not found:
            break
        at, tag = found.end(), found[0]
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name not in INLINE and seen:
                flush()
            if places := at_of.get(name):
                while len(stack) > places[-1] + 1:
                    pop()
                pop()
            continue
        if name == "br" and seen:
            buffer.append(" ")
        elif name not in INLINE and seen:
            flush()
        if name in VOID or tag.endswith("/>"):
            continue
        if name in RAW:  # its content isn't markup
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name and not stack[-1][1]:
            pop()
        unwanted, hint = _judged(tag, name, article > 0)
        form = name == "form" and not article
        own = 0 if unwanted or name not in ("article", "main") else 2 if hint and name == "article" else 1
        at_of.setdefault(name, []).append(len(stack))
        stack.append((name, int(unwanted and not form), form, hint and not own, own))
        skip += unwanted and not form
        forms += form
        hints += hint and not own
        article += own > 0
        teaser += own == 2
    flush()
    return out


def candidates(html: str) -> list[tuple[int, str]]:
    """Lines that may be main text: those of the article where a page marks one (of teasers only where it marks no other), else all open ones."""
    lines = lines_of(html)
    inside = [x for x in lines if x[0] in (ARTICLE, DOUBT)]
    return inside or [x for x in lines if x[0] == TEASER] or lines


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit-parallel rows of the table of common subsequences: zeros up to a bit count the longest one."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Longest common subsequences of ``a`` with every prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; memory stays at TABLE_BITS whatever the lengths."""
    common = set(a) & set(b)
    places, b = [i for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    return [places[i] for i in _aligned([a[i] for i in places], b)]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    full = (1 << len(b)) - 1
    rows = list(_rows(a, b))
    found, j = [], len(b)
    zeros = lambda r, n: n - (r & ((1 << n) - 1)).bit_count()
    for i in range(len(a) - 1, -1, -1):
        if (target := zeros(rows[i], j)) > zeros(rows[i - 1] if i else full, j):  # this element was needed for the prefix of b up to j
            found.append(i)
            while j and zeros(rows[i], j - 1) == target:
                j -= 1
            j -= 1
    return found[::-1]


def address(url: str | None) -> tuple[str, str]:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    return (found[1].lower(), found[2]) if found else ("", url or "")


LINES = "page_id long, url string, _row string, _host string, _path string, _digest string, _needs boolean, _yields boolean, _standing array<tinyint>, _hashes array<long>, _texts array<string>"


def page_lines(pages: DataFrame) -> DataFrame:
    """Each page parsed once: its lines, their hashes and standings, and a digest that tells other lines apart."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.string()))
    names = [f.split()[0] for f in LINES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "html", 4 << 20):
            rows = []
            for page_id, url, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                lines = candidates(page or "")
                hashes = [hash64(t) - 2**63 for _, t in lines]
                digest = hashlib.blake2b(np.array(hashes, np.int64).tobytes(), digest_size=16).hexdigest()
                standing = [s for s, _ in lines]
                rows.append((page_id, url, f"{page_id}|{hash64(url or '')}|{digest}", *address(url), digest, bool(lines), any(s not in (ARTICLE, TEASER) for s in standing), standing, hashes, [t for _, t in lines]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select("page_id", "url", "html").mapInArrow(run, LINES)


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def neighbours(lines: DataFrame) -> DataFrame:
    """_row, _digest, _other: for each page with lines, the digest of the nearest page of its host with other lines.

    Narrow rows are sorted by ranges of (host, path, id), so a hot host
    spreads over tasks, and walked once by runs of equal digests. What a
    range can't tell, the neighbour of its first or last run, follows from
    four rows a range, on the driver.
    """
    keys = ["_host", "_path", "page_id", "_row"]
    names = ["kind", "part", "_row", "_digest", "_other", "common", "_host", "_path"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []
        run: list[tuple] = []  # rows of the run that need a neighbour
        now = before = first = None  # (host, path, digest) of the last row, of the run before's last row, of the first row
        single = True

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held.clear()
            return made

        for b in batches:
            for host, path, _, row, digest, needs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                here = (host, path, digest)
                if now is None:
                    first = here
                    held.append((3, part, "", digest, None, None, host, path))
                elif now[0] != host or now[2] != digest:
                    if now[0] == host:  # the run's rows meet this one
                        held.extend((0, None, r, d, digest, 2 * _common(p, path), None, None) for r, d, p in run)
                    if single:
                        held.append((4, part, "", digest, None, None, host, path))
                    before, single, run = now, False, []
                if needs:
                    if before is not None and before[0] == host:
                        held.append((0, None, row, digest, before[2], 2 * _common(path, before[1]) + 1, None, None))
                    elif single:
                        held.append((1, part, row, digest, None, None, host, path))
                    run.append((row, digest, path))
                now = here
            if held:
                yield table()
        if first is not None:
            held.extend((2, part, r, d, None, None, now[0], p) for r, d, p in run)
            held.append((6, part, "", now[2], None, None, now[0], now[1]))
            if before is not None:
                held.append((5, part, "", before[2], None, None, before[0], before[1]))
            yield table()

    ordered = lines.select(*keys, "_digest", "_needs").repartitionByRange(*keys).sortWithinPartitions(*keys)
    walked = materialise(ordered.mapInArrow(walk, "kind int, part int, _row string, _digest string, _other string, common int, _host string, _path string"), "neighbours")
    ends: dict[int, dict[int, tuple[str, str, str]]] = {}
    for r in walked.where("kind >= 3").select("part", "kind", "_host", "_digest", "_path").collect():  # four rows a range at most
        ends.setdefault(r["part"], {})[r["kind"]] = (r["_host"], r["_digest"], r["_path"])
    beyond = []  # part, kind of row to meet, digest and path to meet

    def look(order: list[int], kind: int, edge: int, near: int, inner: int) -> None:
        """For the run at one edge of each range, the first other run of its host in the ranges before it in ``order``."""
        for k, part in enumerate(order):
            host, digest, _ = ends[part][edge]
            for other in order[k - 1 :: -1] if k else ():
                found = next((x for c in (near, inner) if (x := ends[other].get(c)) and (x[0] != host or x[1] != digest)), None)
                if found:
                    if found[0] == host:
                        beyond.append((part, kind, found[1], found[2]))
                    break

    order = sorted(ends)
    look(order, 1, 3, 6, 5)
    look(order[::-1], 2, 6, 3, 4)
    met = lines.sparkSession.createDataFrame(beyond, "part int, kind int, _met string, _way string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, digest, other, path, way, kind = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([2 * _common(p, w) + (k == 1) for p, w, k in zip(path, way, kind, strict=True)], pa.int32())], names=["_row", "_digest", "_other", "common"])

    across = walked.where("kind IN (1, 2)").join(F.broadcast(met), ["part", "kind"]).select("_row", "_digest", "_met", "_path", "_way", "kind")  # two rows a range
    found = walked.where("kind = 0").select("_row", "_digest", "_other", "common").unionAll(across.mapInArrow(measure, "_row string, _digest string, _other string, common int"))
    return found.groupBy("_row").agg(F.max_by(F.struct("_digest", "_other"), F.struct("common", "_other")).alias("x")).select("_row", "x.*")


def template(lines: DataFrame) -> DataFrame:
    """_row and the places of its lines that the nearest page with other lines shares; each pair of contents is aligned once."""
    paired = materialise(neighbours(lines), "pairs")
    pairs = paired.select("_digest", "_other").distinct()
    wanted = pairs.select("_digest").unionAll(pairs.select("_other")).distinct()
    contents = lines.select("_digest", "_hashes").join(wanted, "_digest", "left_semi").groupBy("_digest").agg(F.first("_hashes").alias("_hashes"))
    both = pairs.join(contents, "_digest").join(contents.select(F.col("_digest").alias("_other"), F.col("_hashes").alias("_others")), "_other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared_places(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["_digest", "_other", "_shared"])

    aligned = both.select("_digest", "_other", "_hashes", "_others").mapInArrow(align, "_digest string, _other string, _shared array<int>")
    return paired.join(aligned.where(F.size("_shared") > 0), ["_digest", "_other"]).select("_row", "_shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null html gives an empty text, a null URL stands in a host of its own
    with other null URLs, a null page_id stays null, repeated rows return as
    often as they occur, whole pages are read however long, other columns are
    ignored, and an empty table gives no rows. Where deleting shared lines
    would leave nothing (a page that only repeats another's lines), all lines
    stay. Every page with lines is aligned with its nearest other page, whatever
    its markup.
    """
    lines = materialise(page_lines(pages), "lines")
    found = materialise(template(lines), "template")  # every page is aligned before what can't change a text is left out
    deleted = materialise(found.join(lines.where("_yields").select("_row").distinct(), "_row", "left_semi"), "deleted")  # known to be small where it is, so that texts aren't shuffled
    told = lines.select("page_id", "url", "_row", "_standing", "_texts").join(deleted, "_row", "left")
    stays = lambda t, i: F.get("_standing", i).isin(ARTICLE, TEASER) | ~F.coalesce(F.array_contains("_shared", i), F.lit(False))
    kept = F.filter("_texts", stays)
    result = told.select("page_id", "url", F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.col("_texts")), "\n").alias("text"))
    return result.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
