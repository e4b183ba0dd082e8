"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path; each page is compared with its neighbour of the longest
common path, their text lines (blocks) are aligned by longest common subsequence, and shared lines
are deleted: they belong to the template.  Markup settles the rest: what lies in navigation, headers,
footers, sidebars, forms, scripts, styles, notices, adverts and comments is never main text, and
where a page marks its article (``article`` or ``main``), the main text lies there, and a line inside
goes only if all different neighbours in reach share it, two at least, and only such lines part it from the
article's beginning or end, since pages quote each other.  A neighbour with the
same lines (a copy), with all lines of the page, or with most of its marked article proves no template,
and the next different page of the host is compared instead.

Pages are parsed once.  One narrow shuffle sorts (host, path, page) to learn the ranges of the sort; a
second one moves each page's compressed lines to its range.  A range holds a bounded share of the pages
whatever its host, so a hot host is spread over many tasks; the different pages next to a range are sent
to it too, over any number of ranges full of copies.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, single

LOOK = 4  # different pages on each side that a page may be compared with

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|[!?/])")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_QUOTES = re.compile(r"""[>"']""")
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template textarea title svg iframe object select".split()}
_SPACE = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+|"[^"]*+"?|'[^']*+'?""")
# names of elements that hold no main text; a name of several parts counts if all its parts are here or in _PLACES
_BOILERPLATE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs banner footer sidebar aside related recommended ad ads advert advertisement "
    "advertising promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share "
    "sharing social comment comments reply replies disqus respond login search contentinfo complementary pagination pager skip toolbar "
    "widget".split())
_HEADER = frozenset(["header", "masthead"])  # outside an article
# of an article itself, and of what cannot hold a whole part of a page (_SMALL) inside one
_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement advertising promo sponsored related".split())
_SMALL = frozenset("p span a b i em strong small h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption cite q".split())
_PLACES = frozenset(
    "site page main global top bottom left right inner outer primary secondary box bar list item items block wrapper wrap container section "
    "area slot unit panel link links form button buttons post posts article articles story content rail col column row group body".split())
_OUT = frozenset("nav header footer aside form button menu dialog noscript input label fieldset".split())
_MAIN = frozenset(["article", "main"])
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"html", "head", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "legend", "summary", "dd", "dt", "li"}
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}


def _boilerplate(tag: str, names: str, in_article: bool) -> bool:
    """Whether one of the class names, ids or roles says that the element holds no main text."""
    if tag in ("html", "body", "main"):
        return False
    if tag == "article" or in_article and tag in _SMALL:
        words = _ARTICLE
    else:
        words = _BOILERPLATE if in_article else _BOILERPLATE | _HEADER
    for name in names.lower().split():
        parts = set(name.replace("_", "-").split("-")) - {""}
        if parts & words and parts <= words | _PLACES:
            return True
    return False


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _closes(html: str) -> tuple[list[int], list[int]]:
    """Places of all quotes and ``>``; per place, where a tag ends that is open and outside quotes before it (-1: nowhere)."""
    places = [m.start() for m in _QUOTES.finditer(html)]
    close, following = [-1] * (len(places) + 1), {}
    for k in range(len(places) - 1, -1, -1):
        mark = html[places[k]]
        if mark == ">":
            close[k] = places[k]
        else:
            close[k] = close[following[mark] + 1] if mark in following else -1
            following[mark] = k
    return places, close


def tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup in page order: start, end, tag (None: a comment, a declaration or an element whose text is no text
    of the page), whether it is an end tag, and its attributes.

    A tag ends at the first ``>`` outside quotes, without one at the first ``>``, and is text where none follows.
    What a comment or a raw element opens and nothing closes lasts to the end.  One scan forwards, however
    broken the markup.
    """
    at, table = 0, None
    last = html.rfind(">")
    while m := _OPEN.search(html, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            yield start, at, None, False, ""
        elif at > last:
            at = html.find("<!--", at)
            if at < 0:
                return
        elif m[3] is None:
            at = html.index(">", at) + 1
            yield start, at, None, False, ""
        else:
            if table is None:
                rest = _REST.match(html, at)
                if rest:
                    end, own = rest.end() - 1, rest[1]
                else:
                    table = _closes(html)
            if table is not None:
                end = table[1][bisect_left(table[0], at)]
                if end < 0:
                    end = html.index(">", at)
                own = html[at:end]
            at, tag = end + 1, m[3].lower()
            if tag in _RAW and not m[2]:
                raw = _RAW[tag].search(html, at)
                at, tag = raw.end() if raw else len(html), None
            yield start, at, tag, bool(m[2]), own


def blocks(html: str) -> tuple[list[tuple[str, bool]], bool]:
    """Text blocks outside boilerplate elements, each with whether a marked article holds it; and
    whether the page marks an article at all."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside boilerplate, inside article
    depth: Counter = Counter()  # open elements by tag
    text: list[str] = []
    marked = False

    def flush():
        if text:
            line = _SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if line and not (stack and stack[-1][1]):
                out.append((line, bool(stack and stack[-1][2])))

    def close(tag: str):
        while True:
            last = stack.pop()[0]
            depth[last] -= 1
            if last == tag:
                return

    at = 0
    for start, end, tag, ends, own in tags(html):
        if start > at:
            text.append(html[at:start])
        at = end
        if tag is None:
            continue
        if tag in _VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        is_block = tag in _BLOCK
        if ends:
            if is_block:
                flush()
            if depth[tag]:
                close(tag)
            continue
        if is_block or tag in _OUT:
            flush()
            if tag in _ENDS_P and depth["p"]:
                close("p")
            if stack and stack[-1][0] in _SAME_ENDS.get(tag, ()):
                close(stack[-1][0])
        out_here, main_here = stack[-1][1:] if stack else (False, False)
        has = attributes(own) if own else {}
        bad = (tag in _OUT and not (tag == "header" and main_here)) or tag == "head"
        if has:
            bad = bad or "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true"
            bad = bad or _boilerplate(tag, " ".join(has.get(x, "") for x in ("class", "id", "role")), main_here)
        good = tag in _MAIN and not out_here and not bad
        marked = marked or good
        if own.rstrip().endswith("/") and not is_block:
            continue
        inside = (out_here or bad, main_here or good)
        if inside != (out_here, main_here):
            flush()
        stack.append((tag, *inside))
        depth[tag] += 1
    text.append(html[at:])
    flush()
    return out, marked


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64)


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own`` are on a longest common subsequence with ``other``.

    Hunt-Szymanski over the positions of equal lines: n log n for pages that share few repeated lines.
    Common ends are taken first, so a page against its copy costs one pass.
    """
    hit = np.zeros(len(own), dtype=bool)
    n = min(len(own), len(other))
    same = own[:n] == other[:n]
    head = n if same.all() else int(np.argmin(same))
    same = own[len(own) - n:][::-1] == other[len(other) - n:][::-1]
    tail = min(n if same.all() else int(np.argmin(same)), n - head)
    hit[:head] = True
    hit[len(own) - tail:] = True
    where: dict[int, list[int]] = {}
    for j in range(len(other) - tail - 1, head - 1, -1):
        where.setdefault(int(other[j]), []).append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i in range(head, len(own) - tail):
        for j in where.get(int(own[i]), ()):
            k = bisect_right(ends, j - 1)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        hit[node[0]] = True
        node = node[1]
    return hit


def main_lines(lines: list[tuple[str, bool]], marked: bool, others: Iterator[np.ndarray]) -> list[str]:
    """The page's lines (of its marked article, if it has one) without those of the template.

    ``others``: the line hashes of the different pages near by, nearest first.  Without a marked article,
    one of them decides: its shared lines go.  One that holds every line of the page may quote it whole: it
    proves no template, and the next one is compared.  In a marked article, a line goes only if
    every one of them shares it, two at least, and it stands at the article's beginning or end, where templates put
    theirs, with nothing but such lines between: pages quote each other.  A page that shares half of the article's
    characters or more is a version of the article and has no say.
    """
    own = line_hashes([x for x, _ in lines])
    if marked:
        size = np.array([len(x) if inside else 0 for x, inside in lines], dtype=np.int64)
        kept = [x for x, inside in lines if inside]
        common, pages = size > 0, 0
        for other in others:
            shared = shared_lines(own, other)
            if 2 * size[shared].sum() < size.sum():
                common, pages = common & shared, pages + 1
                if not common.any():
                    return kept
        if pages < 2:
            return kept
        common = common[size > 0].tolist()
        head = common.index(False)  # a page that shares them all is a version
        tail = common[::-1].index(False)
        return kept[head:len(kept) - tail]
    for other in others:
        shared = shared_lines(own, other)
        if not shared.all():
            return [x for (x, _), drop in zip(lines, shared) if not drop]
    return [x for x, _ in lines]


def _host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    return host, F.regexp_replace(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"[?#].*$", "")


def _parse():
    """Each page with its packed lines; ``digest`` is of the lines, so copies have the same."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            digest, body, n, inside, marked = [], [], [], [], []
            for html in batch.column("html").to_pylist():
                lines, has_article = blocks(html or "")
                text = "\x00".join(x.replace("\x00", " ") for x, _ in lines).encode("utf-8", "surrogatepass")
                digest.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                body.append(pack(text))
                n.append(len(lines))
                inside.append(np.packbits(np.array([i for _, i in lines], dtype=np.uint8)).tobytes())
                marked.append(has_article)
            yield pa.RecordBatch.from_arrays(
                [*(single(batch.column(c)) for c in ("host", "path", "page", "url")), pa.array(digest, pa.int64()), pa.array(body, pa.binary()),
                 pa.array(n, pa.int32()), pa.array(inside, pa.binary()), pa.array(marked, pa.bool_())], _PAGE)
    return run


_PAGE = ["host", "path", "page", "url", "digest", "body", "n", "inside", "marked"]
_PAGE_SCHEMA = "host string, path string, page long, url string, digest long, body binary, n int, inside binary, marked boolean"


def _edges():
    """Rows sorted by (host, path, page, digest) -> the first pages of the partition's first runs of equal pages
    (``end`` 0) and the last pages of its last runs (``end`` 1), ``LOOK + 1`` of each."""
    def run(batches):
        first, last, before = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            host, digest = single(batch.column("host")), single(batch.column("digest"))
            new = pc.or_(pc.not_equal(host[1:], host[:-1]), pc.not_equal(digest[1:], digest[:-1])).to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.flatnonzero(new) + 1]).tolist()
            stop = [x - 1 for x in start[1:]] + [batch.num_rows - 1]
            here = (host[0].as_py(), digest[0].as_py())
            if here == before:
                start, last = start[1:], last[:-1]
            first += [batch.slice(x, 1).to_pylist()[0] for x in start[:LOOK + 1 - len(first)]]
            last = (last + [batch.slice(x, 1).to_pylist()[0] for x in stop[-LOOK - 1:]])[-LOOK - 1:]
            before = (host[batch.num_rows - 1].as_py(), digest[batch.num_rows - 1].as_py())
        if first:
            yield pa.RecordBatch.from_pylist([r | {"end": e} for e, rows in ((0, first), (1, last)) for r in rows], _ENDS)
    return run


_ENDS = pa.schema([("host", pa.string()), ("path", pa.string()), ("page", pa.int64()), ("digest", pa.int64()), ("end", pa.int32())])


def _key(host, path, page, digest) -> tuple:
    return (host.encode(), path.encode(), page is not None, page or 0, digest)


def ranges(rows: list[tuple]) -> tuple[list[tuple], dict[tuple, set[int]]]:
    """The first key of each range, and the ranges besides its own that a page goes to: each range gets the
    nearest ``LOOK`` different pages of its first host before it and of its last host after it."""
    parts: list[tuple[list, list]] = []
    for *row, end in rows:
        if not end and (not parts or parts[-1][1]):
            parts.append(([], []))
        parts[-1][end].append(row)
    sent: dict[tuple, set[int]] = {}
    for i, (first, last) in enumerate(parts):
        for here, way in ((first[0], range(i - 1, -1, -1)), (last[-1], range(i + 1, len(parts)))):
            host, digest, found = here[0], here[3], 0
            for row in (r for j in way for r in (parts[j][1][::-1] if j < i else parts[j][0])):
                if row[0] != host or found == LOOK:
                    break
                if row[3] != digest:
                    sent.setdefault(_key(*row), set()).add(i)
                    digest, found = row[3], found + 1
    return [_key(*first[0]) for first, _ in parts], sent


def _ranged(bounds: list[tuple], sent: dict[tuple, set[int]]):
    """Each page with its range, and once more for each other range it is sent to."""
    def run(batches):
        for batch in batches:
            at, part, own = [], [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page", "digest")))):
                key = _key(*row)
                home = max(bisect_right(bounds, key) - 1, 0)
                for p in (home, *sorted(sent.get(key, set()) - {home})):
                    at.append(i)
                    part.append(p)
                    own.append(p == home)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part, pa.int32()), pa.array(own, pa.bool_())], [*_PAGE, "part", "own"])
    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Run:
    """Pages of one host with equal lines that follow each other: the lines once, and the part's own pages."""

    def __init__(self, row: dict):
        self.at = (row["part"], row["host"])
        self.digest, self.body, self.n = row["digest"], row["body"], row["n"]
        self.first, self.own, self.known = row["path"], [], None
        self.add(row)

    def add(self, row: dict):
        self.last = row["path"]
        if row["own"]:
            self.own.append(tuple(row[c] for c in ("page", "url", "path", "inside", "marked")))

    def lines(self) -> list[str]:
        if not self.n:
            return []
        return zstandard.ZstdDecompressor().decompress(self.body).decode("utf-8", "surrogatepass").split("\x00")

    def hashes(self) -> np.ndarray:
        if self.known is None:
            self.known = line_hashes(self.lines())
        return self.known


def _texts(run: _Run, before: list[_Run], after: list[_Run]) -> Iterator[tuple]:
    """The main text of the run's pages; ``before`` and ``after``: the runs on both sides, nearest first."""
    lines, known = run.lines(), {}
    for page, url, path, inside, marked in run.own:
        # step by step away from the page; of two as far, the longer common path, of equals the one before
        near = []
        for pair in zip_longest(before, after):
            ends = [(x, x.first if i else x.last) for i, x in enumerate(pair) if x is not None]
            near += [x for x, _ in sorted(ends, key=lambda x: -_common(x[1], path))]
        near = [x for x in {x.digest: x for x in reversed(near)}.values() if x.n and x.digest != run.digest][::-1]
        key = (inside, marked, tuple(x.digest for x in near))
        if key not in known:
            mark = np.unpackbits(np.frombuffer(inside, dtype=np.uint8))[:run.n].astype(bool)
            known[key] = "\n\n".join(main_lines(list(zip(lines, mark.tolist())), marked, (x.hashes() for x in near)))
        yield page, url, known[key], len(known[key])


def _difference():
    """Pages sorted by (part, host, path, page) -> main text of the part's own pages."""
    def run(batches: Iterator[pa.RecordBatch]):
        runs: list[_Run] = []  # of one part and host: up to LOOK before ``done``, and those from there
        done = 0

        def texts(end: int):
            """Texts of the runs from ``done`` to ``end``; then only the runs still needed are kept."""
            nonlocal done
            for k in range(done, end):
                yield from _texts(runs[k], runs[max(0, k - LOOK):k][::-1], runs[k + 1:k + 1 + LOOK])
                runs[k].own = []
            gone = max(0, end - LOOK)
            del runs[:gone]
            done = end - gone

        def all_texts():
            nonlocal done
            for batch in batches:
                for row in batch.to_pylist():
                    if runs and runs[-1].at != (row["part"], row["host"]):
                        yield from texts(len(runs))
                        runs.clear()
                        done = 0
                    if runs and runs[-1].digest == row["digest"]:
                        runs[-1].add(row)
                    else:
                        runs.append(_Run(row))
                        yield from texts(max(done, len(runs) - 1 - LOOK))
            yield from texts(len(runs))

        held, size = [], 0
        for row in all_texts():
            held.append(row)
            size += row[3]
            if size > 1 << 22 or len(held) >= 2000:
                yield _result(held)
                held, size = [], 0
        yield _result(held)
    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                      ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page: the main text's blocks, joined by two newlines.

    Character references are decoded, white space inside a block becomes one space.  A null or empty
    html has the empty text.  A null or odd URL belongs to a host by the empty name and is sorted among
    its pages; equal URLs are ordered by page id, then content.  Repeated rows are each returned (a copy
    is no evidence of a template, nor is a page that holds all lines of another).  A null id is returned as null.
    Other columns are not read.  An empty table gives an empty result.  A very long page is one unit of work, in time
    and memory proportional to it, however broken its markup.  NUL characters in a text become blanks.  A page is
    compared with at most ``LOOK`` different pages on each side: a template that lies beyond that many versions of a
    page stays.
    """
    host, path = _host_path(F.col(url_col))
    rows = pages.select(host.alias("host"), path.alias("path"), F.col(id_col).cast("long").alias("page"),
                        F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page", "digest"]
    parsed = materialize(arrow_map(rows, _parse(), _PAGE_SCHEMA))
    # the ends of the ranges: a few rows per task, whatever the number of pages
    ends = arrow_map(parsed.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order), _edges(),
                     "host string, path string, page long, digest long, end int").collect()
    moved = (arrow_map(parsed, _ranged(*ranges(ends)), _PAGE_SCHEMA + ", part int, own boolean")
             .repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order))
    return arrow_map(moved, _difference(), "page_id long, url string, text string, n_chars long")
