"""Main text of web pages by consensus host paths (problem 1).

A page here is lines without tags, so a container's generalised path is read off its lines: the zone it
stands in (before, between or after the running text), its kind of entry (numbered, bulleted, plain, a row
with a separator) and the line's own words with dates and digits generalised. Three steps:

1. ``path_votes``: every page scores its lines; short lines, entries of rows and first parts of longer lines vote, per
   host, for their generalised path, with what stands above and below them. Batches combine their votes before anything is
   shuffled; a vote is a 64-bit key and six counts.
2. ``winning_paths``: a path wins on a host when enough of its pages have it and clearly more than pages of other hosts do;
   over all hosts as an edge of pages when running text stands on one side of it only, as the heading of a box when entries
   follow it nearly always, as a notice when lines of two or more parts open with it on many unlike pages.
3. ``extract``: pages are read again with the winners of their host, and containers are rebuilt: menus, path
   lines, notices, boxes with their entries, tool and sharing lines, change dates, footers.

No word of any language is known beforehand: what a line means is left to the votes. A box has at most ``BOX_ENTRIES``
entries that are no winners themselves.

Defined results: null, empty and blank texts give no lines; the only line of a page is main text; a row whose
source is null or names no host (no dot) is no web page and is main text throughout; equal rows give equal
results; a row's result depends on its own text and the winners only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.textform import form
from quillspark.runtime import broadcast_if_small, materialize, small


_DATE = re.compile(r"\d+ [^\W\d_]+ (?:19|20)\d\d")
DATED = re.compile(r"^\d{1,2} [A-Z]\w+ \d{4}: ")
MARK = re.compile(r"^(?:(\d{1,2})[.)]|([*•·\-–]))\s+")
SEPARATOR = re.compile(r" (?:\||·|::|»|>|/|-) |  +")
_DIGITS = re.compile(r"\d+")
STOP = ".?!。？！…"
LONG = 72
"""A line of at least so many characters, or one with sentence marks, is running text."""
PROSE = 200
"""A line has running text before or after it if so many bytes of running text stand on that side."""
MIN_PAGES, MIN_SHARE, OVER_OTHERS = 3, 0.03, 2.5
"""A host path wins with so many different pages, that share of the host's pages and that multiple of its share elsewhere."""
DIFFERENT = 0.4
"""Of the first 32 pages with a host path, so large a share must have different bodies."""
ALL_PAGES, ALL_SHARE, ALL_HOSTS = 8, 2e-4, 3
"""A path may win over all hosts with so many pages, that share of all pages, and so many hosts."""
ONE_SIDED, IN_RUN, FOLLOWED = 0.3, 0.8, 0.9
"""It wins as an edge of pages if at most the share ONE_SIDED of its pages have running text on its far side (above the text also:
if at least the share IN_RUN of them continue with short lines), and as the heading of a box if at least the share FOLLOWED of
them have two or more entries right below it."""
ABOVE, BELOW, HEAD, NOTICE = 1, 2, 3, 4
"""Kinds of winners: edges above and below the text, headings of boxes, first parts of notices; 0 for a path that wins on its host only."""
NOTICE_SIZE, NOTICE_PART, NOTICE_SHARE = 22, 12, 0.25
"""A notice is a line of two or more parts and so many bytes, whose first part, which has won, has so many bytes when dates are
levelled and at least that share of the line."""
BOX_ENTRIES = 5
"""A box has at most so many entries below its heading; a parameter of the method, as nothing but the count tells the last entry
from a title or list of the page's own right below it."""
RUN = 3
"""So many short lines of one kind in a row are a list that may be a menu."""

SHAPED = 4
"""So many short entries without a number, at the top of a page, are a menu by their shape alone."""

WEB = r"\."
"""A source with a dot names a host."""


def _key(text: str) -> int:
    """Paths of lines and entries are odd, those of first parts even."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) | 1) - (1 << 63)


ENDS = 144
"""A longer line's path is so many characters of it, half of them at each end."""


class Line:
    """What a line shows by itself."""

    __slots__ = ("text", "mark", "_cells", "long", "sentence", "low", "_key", "_first", "short", "remark")

    def __init__(self, text: str):
        m = MARK.match(text) if text[0] in "0123456789*•·-–" else None
        self.mark = "" if m is None else "1" if m[1] else "*"
        bare = (text[m.end() :] or text) if m else text
        self.text = bare
        parts = ". " in bare or "? " in bare or "! " in bare or "。" in bare[:-1]
        self.sentence = parts or bare[-1] in STOP
        self.remark = self.sentence and not parts
        self.long = len(bare) >= LONG or self.sentence
        self.short = len(bare) <= 32 and not self.sentence
        self.low = bare.lower()
        self._cells = self._key = self._first = None

    def cells(self) -> list[str]:
        """The entries of a row, or the line as its only one."""
        if self._cells is None:
            low = self.low
            if " " in low and SEPARATOR.search(low):
                self._cells = [c for c in SEPARATOR.split(low) if c]
            else:
                self._cells = [low]
        return self._cells

    def size(self) -> int:
        """Bytes, of which scripts that say more in a character have more."""
        return len(self.text) if self.text.isascii() else len(self.text.encode("utf-8", "surrogatepass"))

    def key(self) -> int:
        """The generalised path of the line: its words with dates and digits levelled; of a long one, those of its beginning and end."""
        if self._key is None:
            low = self.low
            self._key = _key(_level(low if len(low) <= ENDS else low[: ENDS // 2] + "…" + low[-ENDS // 2 :]))
        return self._key

    def first(self) -> int:
        """The generalised path of the line's first part, up to a sentence mark, dash, bracket or colon; 0 if the line can be no notice."""
        if self._first is None:
            self._first = 0
            low = self.low
            if len(low) >= NOTICE_SIZE or self.size() >= NOTICE_SIZE:
                m = _PART.search(low)
                if m is not None and m.start() >= NOTICE_SHARE * len(low) and m.end() < len(low):
                    part = _level(low[: m.start()])
                    if len(part.encode("utf-8", "surrogatepass")) >= NOTICE_PART:
                        self._first = _key(part) - 1
        return self._first

    def plain(self) -> bool:
        return _DIGITS.search(self.low) is None


_PART = re.compile(r"[.!?](?= |$)|[。！？]|(?<=...) (?=[\[|–-])|: ")
_HOST = re.compile(r"\w[\w-]*(?:\.[\w-]+)+")


def _level(low: str) -> str:
    """``low`` with dates, numbers and host names levelled."""
    if (dots := low.count(".")) and dots > low.count(". ") + (low[-1] == "."):
        low = _HOST.sub("H", low)
    return _DIGITS.sub("0", _DATE.sub("D", low)) if _DIGITS.search(low) else low


_SEEN: dict[str, Line] = {}


def _line(text: str) -> Line:
    """Short lines recur on page after page, so what they show is kept, for a bounded number of them."""
    if len(text) > 60:
        return Line(text)
    x = _SEEN.get(text)
    if x is None:
        if len(_SEEN) > 100_000:
            _SEEN.clear()
        x = _SEEN[text] = Line(text)
    return x


def _shown(text: str) -> str:
    """The form of ``text`` with as many lines."""
    shown = form(text)
    if "\r" in text and shown.count("\n") != text.count("\n"):
        shown = "\n".join(form(x.rstrip("\r").replace("\r", " ")) for x in text.split("\n"))
    return shown


def lines_of(shown: str) -> list[Line | None]:
    """One entry per line of a text in its form, which are separated by ``\n``; None for a blank one."""
    return [_line(s) if (s := x.strip()) else None for x in shown.split("\n")]


def _goes_on(x: Line, before: Line) -> bool:
    """Whether ``x`` may go on with the paragraph of the line right above it."""
    return x.text[0].islower() and not x.mark and len(before.text) >= 40 and before.text[-1] not in STOP


def _enters(x: Line) -> bool:
    return not x.sentence and len(x.text) <= 100 and not x.long


BEFORE, AFTER, IN, ONE, TWO = 1, 2, 4, 8, 16
"""What a vote tells of its line: running text before it, after it, a run of entries around it, one and two entries right below it."""


def _page(rows: list[Line], at: list[int], vote) -> None:
    """The votes of one page of two or more lines ``rows`` at the line numbers ``at``: ``vote(path, flags)`` of each different path."""
    n = len(rows)
    body = [k for k, x in enumerate(rows) if x.long and not (x.sentence and len(x.text) < 45)]
    first, last = (body[0], body[-1]) if body else (n, -1)
    # From which line on, and up to which, PROSE bytes of running text stand above and below.
    above, size = n, 0
    for k in body:
        size += rows[k].size()
        if size >= PROSE:
            above = k + 1
            break
    below, size = -1, 0
    for k in reversed(body):
        size += rows[k].size()
        if size >= PROSE:
            below = k - 1
            break
    seen = set()
    add = seen.add
    start = 0  # of the run of short lines with one mark
    before = None
    for k, x in enumerate(rows):
        above_it, before = before, x
        if above_it is not None:
            if not x.short or x.mark != above_it.mark or not above_it.short:
                start = k
            if at[k] - at[k - 1] == 1 and _goes_on(x, above_it):
                continue
        sides = (BEFORE if k >= above else 0) | (AFTER if k <= below else 0)
        if (key := x.first()) and key not in seen:
            add(key)
            vote(key, sides)
        size = len(x.text)
        if first < k < last and size > 50 and (size > LONG or above_it.long or rows[k + 1].long):
            continue  # inside running text
        if (key := x.key()) not in seen:
            add(key)
            flags = sides
            plain = x.plain()
            if k + 1 < n and at[k + 1] - at[k] == 1 and _enters(rows[k + 1]):
                flags |= ONE
                if plain and not x.sentence and k + 2 < n and at[k + 2] - at[k] == 2 and _enters(rows[k + 2]):
                    flags |= TWO
            if plain and x.short and (k - start >= RUN - 1 or (k + 2 < n and rows[k + 1].short and rows[k + 2].short and rows[k + 1].mark == rows[k + 2].mark == x.mark)):
                flags |= IN
            vote(key, flags)
        if (k < above or k > below) and not x.long and len(c := x.cells()) > 1:
            flags = sides | (IN if len(c) >= RUN and not c[-1].isdigit() else 0)
            for j, y in enumerate(c):
                if 1 < len(y) <= 32 and (key := _key(y)) not in seen:
                    add(key)
                    vote(key, flags | ONE | TWO if j == 0 and len(c) > RUN else flags)


def _votes(texts: Iterable[tuple[str, str]]) -> pa.RecordBatch:
    """One row for each host and path of ``(host, text)``: the pages with it, how many of them have what the flags tell, and a
    bitmap of the bodies it came with, so that copies of a page count once. Path 0 stands for the page itself."""
    names: dict[str, int] = {}
    hosts, counts, bodies = [], [], []
    paths: list[int] = []
    flags: list[int] = []
    add_path, add_flags = paths.append, flags.append

    def vote(path: int, what: int) -> None:
        add_path(path)
        add_flags(what)

    for host, text in texts:
        every = lines_of(_shown(text))
        at = [k for k, x in enumerate(every) if x is not None]
        if len(at) < 2:
            continue
        rows = [every[k] for k in at]
        before = len(paths)
        vote(0, 0)
        _page(rows, at, vote)
        hosts.append(names.setdefault(host, len(names)))
        counts.append(len(paths) - before)
        bodies.append(1 << (_body(" ".join([x.low for x in rows if x.long and not (x.sentence and len(x.text) < 45)]) or text) & 63))
    host = np.repeat(np.array(hosts, np.int32), counts)
    body = np.repeat(np.array(bodies, np.uint64), counts)
    path, what = np.array(paths, np.int64), np.array(flags, np.int32)
    order = np.lexsort((path, host))
    host, path, what, body = host[order], path[order], what[order], body[order]
    if len(path):
        starts = np.flatnonzero(np.concatenate(([True], (host[1:] != host[:-1]) | (path[1:] != path[:-1]))))
        sums = [np.diff(np.append(starts, len(path)))] + [np.add.reduceat((what & f) != 0, starts, dtype=np.int32) for f in (BEFORE, AFTER, IN, ONE, TWO)]
        host, path, body = host[starts], path[starts], np.bitwise_or.reduceat(body, starts)
    else:
        sums = [np.zeros(0, np.int32)] * 6
    said = pa.array(list(names), pa.string()).take(pa.array(host))
    return pa.RecordBatch.from_arrays([said, pa.array(path), *(pa.array(x.astype(np.int32)) for x in sums), pa.array(body.view(np.int64))], names=["host", "path", *COUNTS, "bodies"])


_PAIR = re.compile(rb"[^ ]{7,} [^ ]+")
"""A long word and the next one, in UTF-8."""


def _body(text: str) -> int:
    """A hash that copies of a text mostly share, small edits, order and line breaks aside: the least over pairs of
    words, or over sentences in a script without blanks."""
    data = text.encode("utf-8", "surrogatepass")
    parts = data.split("。".encode()) if "。" in text else _PAIR.findall(data)
    return min(map(crc32, parts), default=crc32(data)) * 0x9E3779B1 >> 7


COUNTS = ("pages", "before", "after", "run", "one", "two")


def path_votes(pages: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Votes of all pages: ``(host, path, pages, before, after, run, one, two, bodies)``; path 0 counts the pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _votes((h, t) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and h)

    votes = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).filter(F.col("host").rlike(WEB) & F.col("text").isNotNull())
    votes = votes.mapInArrow(run, "host string, path long, " + "".join(f"{c} int, " for c in COUNTS) + "bodies long")
    return votes.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in COUNTS), F.bit_or("bodies").alias("bodies"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """Paths that won: ``(host, path, kind)``; host ``*`` stands for all hosts.

    The winners of one host are at most ``lines of a page / MIN_SHARE``, those over all hosts at most ``lines of a
    page / ALL_SHARE``, so both lists have a size bound however many pages there are. Votes whose bodies are few count as that many: copies of one page don't elect.
    """
    votes = materialize(votes)
    hosts = votes.filter("path = 0").select("host", F.col("pages").alias("host_pages"))
    every = votes.filter("path <> 0").groupBy("path").agg(
        *(F.sum(c).alias(f"all_{c}") for c in COUNTS), F.count("*").alias("all_hosts"), F.bit_or("bodies").alias("all_bodies")
    )
    every = materialize(every.filter(f"all_pages >= {MIN_PAGES} AND bit_count(all_bodies) >= {MIN_PAGES}"))
    total = hosts.agg(F.sum("host_pages")).first()[0] or 0
    over = every.filter(f"all_hosts >= {ALL_HOSTS} AND all_pages >= {max(ALL_PAGES, ALL_SHARE * total)} AND bit_count(all_bodies) >= {ALL_PAGES}")
    sides = "(all_before + all_after)"
    kind = (
        f"CASE WHEN path % 2 = 0 THEN {NOTICE} WHEN all_two >= {FOLLOWED} * all_pages AND all_before > {ONE_SIDED} * {sides} THEN {HEAD} "
        f"WHEN all_after <= {ONE_SIDED} * {sides} AND {sides} >= {ONE_SIDED} * all_pages THEN {BELOW} "
        f"WHEN all_before <= {ONE_SIDED} * {sides} AND greatest(all_run, all_one) >= {IN_RUN} * all_pages THEN {ABOVE} END"
    )
    over = over.select(F.lit("*").alias("host"), "path", F.expr(kind).cast("int").alias("kind")).filter("kind IS NOT NULL")
    own = votes.filter(f"path <> 0 AND pages >= {MIN_PAGES} AND bit_count(bodies) >= {MIN_PAGES}")
    own = own.join(broadcast_if_small(every.select("path", "all_pages"), 200_000), "path").join(broadcast_if_small(hosts, 200_000), "host")
    bits = F.bit_count("bodies")
    # The number of different bodies behind a bitmap, as long as it is far from full.
    bodies = F.when(bits < 50, -64 * F.log(1 - bits / 64)).otherwise(F.col("pages"))
    share = F.least(F.col("pages"), bodies) / F.col("host_pages")
    elsewhere = (F.col("all_pages") - F.col("pages")) / F.greatest(F.lit(total) - F.col("host_pages"), F.lit(1))
    own = own.filter((share >= MIN_SHARE) & (share >= OVER_OTHERS * elsewhere) & (bits >= DIFFERENT * F.least(F.col("pages"), F.lit(32))))
    both = F.col("before") + F.col("after")
    edge = (F.col("after") <= ONE_SIDED * both) & (both >= ONE_SIDED * F.col("pages"))
    return own.select("host", "path", F.when(F.col("path") % 2 == 0, NOTICE).when(edge, BELOW).otherwise(0).alias("kind")).unionByName(over)


def _entry(x: Line, following: Line | None, adjacent: bool, edge) -> bool:
    """Whether ``x`` looks like an entry of a box: a title or a menu word, maybe after a date."""
    t = x.text
    if x.mark or x.sentence or len(t) > 100 or edge(x):
        return False
    if DATED.match(t):
        rest = t[t.index(": ") + 2 :]
        return not rest[:1].islower()
    if len(t) > 80 or t[:1].islower() or t[:1].isdigit() or t[-1:].isdigit() or " | " in t:
        return False
    if not adjacent or following is None or edge(following) or DATED.match(following.text):
        return True
    # A wrapped line of running text goes on in lower case, or in a sentence on a line about as wide.
    return not (len(t) >= 40 and following.text[:1].islower() or len(t) >= 52 and following.sentence and 45 <= len(following.text) <= len(t) + 15)


class Won:
    """The winners of one host and of all hosts, as a page of that host meets them."""

    __slots__ = ("paths", "above", "below", "heads", "notices")

    def __init__(self, paths=frozenset(), above=frozenset(), below=frozenset(), heads=frozenset(), notices=frozenset()):
        self.paths, self.above, self.below, self.heads, self.notices = paths, above, below, heads, notices

    def and_of(self, kinds: Iterable[tuple[int, int]]) -> Won:
        """These winners and more ``(path, kind)``."""
        by: tuple[set[int], ...] = (set(), set(), set(), set(), set())
        for path, kind in kinds:
            by[kind].add(path)
        return Won(self.paths.union(*by[:NOTICE]), self.above | by[ABOVE], self.below | by[BELOW], self.heads | by[HEAD], self.notices | by[NOTICE])


NONE_WON = Won()


def other_lines(text: str, won: Won, shown: str | None = None) -> list[int]:
    """Numbers of the non-blank lines of a page that are not its main text; ``won`` are the winners of its host."""
    every = lines_of(_shown(text) if shown is None else shown)
    at = [k for k, x in enumerate(every) if x is not None]
    n = len(at)
    if n < 2:
        return []
    rows = [every[k] for k in at]
    off = [False] * n
    paths, above, below, heads, notices = won.paths, won.above, won.below, won.heads, won.notices
    prose = [False] * n

    def known(x: Line) -> bool:
        """A menu entry, site name or footer line by vote."""
        return not (x.long and x.sentence) and x.key() in paths

    def edge(x: Line) -> bool:
        """A line that by vote stands below the text only, or heads a box, or is a notice."""
        k = x.key()
        return k in heads or notice(x) or (k in below and not x.remark)

    def notice(x: Line) -> bool:
        return x.first() in notices

    def row(x: Line) -> bool:
        """A row of entries, most of them by vote."""
        c = x.cells()
        return len(c) > 1 and 2 * sum(_key(y) in paths for y in c) >= len(c)

    # Containers by vote, anywhere on the page; the path line tells the title.
    title = None
    boxes = []
    content = False
    if len(c := rows[0].cells()) > 1 and _key(c[0]) in paths and any(rows[j].low == c[-1] for j in range(1, min(n, 16))):
        off[0] = True  # the site's name and the title
    k = 0
    while k < n:
        x = rows[k]
        if k and at[k] - at[k - 1] == 1 and _goes_on(x, rows[k - 1]):
            prose[k] = x.long  # such lines do not vote
            content = content or x.long
        elif x.key() in heads:
            off[k] = True
            boxes.append((k, content))
        elif notice(x) or (not x.remark and (x.key() in above or x.key() in below)):  # one plain sentence may be the page's own
            off[k] = True
        elif len(x.cells()) > 1 and _key(x.cells()[0]) in heads:
            off[k] = True  # a box in one row
        elif not content and len(c := x.cells()) > 1:
            lead = c[0][c[0].rfind(": ") + 2 :] if ": " in c[0] else c[0]  # a path line may open with a word of its own
            if x.sentence and lead is c[0]:
                pass
            elif row(x) and not (x.key() in paths):
                off[k] = True
                if _key(c[-1]) not in paths and _key(lead) in paths:
                    title = c[-1]
            elif _key(lead) in paths and _key(c[-1]) not in paths and (lead is not c[0] or c[-1] == "page" or any(rows[j].low == c[-1] for j in range(k + 1, min(n, k + 14)))):
                off[k] = True
                title = c[-1]
        if x.long and not prose[k] and not off[k] and not row(x):
            prose[k] = content = True
        k += 1

    body = [k for k in range(n) if prose[k]]
    first, last = (body[0], body[-1]) if body else (n, -1)

    def menu_run(k: int) -> int:
        """The end of a list of short lines of one kind that starts at ``k``, if most are menu entries; else ``k``."""
        e = k
        while e < n and rows[e].short and rows[e].mark == rows[k].mark and not off[e] and (e == k or at[e] - at[e - 1] == 1):
            e += 1
        if not rows[k].mark:
            # A plain list may touch the title below it: it ends with its last entry by vote.
            while e > k and not known(rows[e - 1]):
                e -= 1
        good = sum(known(rows[j]) for j in range(k, e))
        if e > k and good > 0 and 2 * good >= e - k:
            return e
        # Without votes, as on hosts with few pages: the list that opens a page, by its shape alone.
        if rows[k].mark and e - k >= SHAPED and all(off[:k]) and not any(_DIGITS.search(rows[j].text) for j in range(k, e)):
            return e
        return k

    # Menus, tools and names above the text.
    k = 0
    while k < min(n, first + 1):
        x = rows[k]
        if off[k]:
            if any(b == k for b, _ in boxes):
                e = _box_end(rows, at, off, k, title, False, known, edge)
                for j in range(k, e):
                    off[j] = True
                k = e
                continue
            k += 1
        elif (e := menu_run(k)) > k:
            for j in range(k, e):
                off[j] = True
            k = e
        elif known(x) or (not x.sentence and (row(x) or (all(off[:k]) and len(x.cells()) >= SHAPED and not _DIGITS.search(x.text) and max(map(len, x.cells())) <= 24))):
            off[k] = True
            k += 1
        elif (x.short or k == 0) and all(off[:k]) and k + 1 < n and not off[k + 1] and (menu_run(k + 1) - k > RUN or (row(rows[k + 1]) and len(rows[k + 1].cells()) >= RUN)):
            off[k] = True  # a name above the menu
            k += 1
        else:
            break

    # Footers, tools and names below the text, upwards.
    k = n - 1
    while k > last:
        x = rows[k]
        if off[k] or known(x) or row(x) or (x.short and not x.mark and k + 1 < n and off[k + 1] and any(c.isdigit() for c in rows[k + 1].text) and at[k + 1] - at[k] == 1 and _name(x)):
            off[k] = True
            k -= 1
        else:
            break

    # Boxes within and below the text.
    for b, inside in boxes:
        e = _box_end(rows, at, off, b, title, inside or any(not off[j] for j in range(b)), known, edge)
        for j in range(b, e):
            off[j] = True

    # Menu entries by vote between containers, and rows that stand beside the text.
    for k in range(n):
        if not off[k] and (k == 0 or off[k - 1]) and (k + 1 == n or off[k + 1]) and (k < first or k > last) and known(rows[k]):
            off[k] = True
    return [at[k] for k in range(n) if off[k]]


def _name(x: Line) -> bool:
    return x.text[:1].isupper() and len(x.text) <= 40 and all(w[:1].isupper() or w in ("of", "de", "für") for w in x.text.split())


def _box_end(rows: list[Line], at: list[int], off: list[bool], b: int, title: str | None, content: bool, known, edge) -> int:
    """The row after the box whose heading is row ``b``.

    ``content``: whether a line of the page's own came before. If not, and no path line tells the title, an
    undated last entry right above the text is taken for the title, provided two entries remain.
    """
    n = len(rows)
    e = b + 1
    while e < n and e - b <= BOX_ENTRIES + (0 if content else 1) and at[e] - at[e - 1] == 1:
        x = rows[e]
        if title and x.low == title and not content:
            break
        if off[e] and edge(x):
            break
        after = rows[e + 1] if e + 1 < n else None
        adjacent = after is not None and at[e + 1] - at[e] == 1
        if not known(x) and not _entry(x, after, adjacent, edge):
            break
        if adjacent and not known(x) and not DATED.match(x.text) and any(c.isdigit() for c in x.text) and _listed(after):
            break  # the first of a list of the page's own
        e += 1
    if not content and e - b - 1 > BOX_ENTRIES:
        e = b + BOX_ENTRIES + 1
    elif not content and title is None and e - b - 1 >= 3 and e < n and not known(rows[e - 1]) and not DATED.match(rows[e - 1].text):
        below = rows[e]
        if at[e] - at[e - 1] == 1 or below.long or below.mark:
            e -= 1
    return e


def _listed(x: Line | None) -> bool:
    """An entry of a list of the page's own: lower-case or ending in a number."""
    return x is not None and not x.long and (x.text[:1].islower() or x.text[-1:].isdigit() or " | " in x.text)


class Winners:
    """Winners by host, as the workers use them; what a host's pages meet is kept for a bounded number of hosts."""

    def __init__(self, rows: Iterable[tuple[str, int, int]]):
        self.by: dict[str, list[tuple[int, int]]] = {}
        for h, p, kind in rows:
            self.by.setdefault(h, []).append((p, kind))
        self.all = NONE_WON.and_of(self.by.pop("*", ()))
        self.kept: dict[str, Won] = {}

    def of(self, host: str) -> Won:
        won = self.kept.get(host)
        if won is None:
            if len(self.kept) > 2_000:
                self.kept.clear()
            own = self.by.get(host)
            won = self.kept[host] = self.all if own is None else self.all.and_of(own)
        return won


BROADCAST_ROWS = 400_000
"""Winners are broadcast up to so many rows (16 bytes each besides the hosts' names); beyond, they join by host."""


def over_pages(pages: DataFrame, winners: DataFrame, fn, schema: str, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``fn(ids, texts, wons)`` over Arrow batches of all rows, which returns a record batch of ``schema``.

    ``wons`` has the winners of each row's host, or None for a row that is no web page. Whole texts go in.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.when(F.col(host).rlike(WEB), F.col(host)).alias("host"))
    if small(winners, BROADCAST_ROWS):
        won = winners.toArrow()
        shared = spark.sparkContext.broadcast([won.column(c).to_pylist() for c in ("host", "path", "kind")])

        def run(batches):
            w = Winners(zip(*shared.value))
            for b in batches:
                yield fn(b.column(0).to_pylist(), b.column(1).to_pylist(), [None if h is None else w.of(h) for h in b.column(2).to_pylist()])

        return rows.mapInArrow(run, schema)
    # Many hosts: a host's list is bounded, so one row a host joins, and AQE splits hosts that hold many pages. Rows that are no
    # web pages need no winners and stay where they are. The winners over all hosts are at most lines of a page / ALL_SHARE.
    over = spark.sparkContext.broadcast([(r.path, r.kind) for r in winners.filter("host = '*'").select("path", "kind").collect()])
    own = winners.filter("host <> '*'").groupBy("host").agg(F.collect_list("path").alias("paths"), F.collect_list("kind").alias("kinds"))
    joined = rows.filter("host IS NOT NULL").join(own, "host", "left").select("id", "text", "host", "paths", "kinds")

    def run_joined(batches):
        every = NONE_WON.and_of(over.value)
        kept: dict[str, Won] = {}
        for b in batches:
            hosts, wons = b.column(2).to_pylist(), []
            for k, h in enumerate(hosts):
                if h not in kept:
                    if len(kept) > 2_000:
                        kept.clear()
                    kept[h] = every.and_of(zip(b.column(3)[k].as_py() or (), b.column(4)[k].as_py() or ()))
                wons.append(kept[h])
            yield fn(b.column(0).to_pylist(), b.column(1).to_pylist(), wons)

    def run_others(batches):
        for b in batches:
            yield fn(b.column(0).to_pylist(), b.column(1).to_pylist(), [None] * len(b))

    return joined.mapInArrow(run_joined, schema).unionByName(rows.filter("host IS NULL").mapInArrow(run_others, schema))


def main_lines(text: str, won: Won | None) -> str:
    """The main text of a page, its lines as they stand; ``won`` None: no web page."""
    off = set(other_lines(text, won)) if won is not None else ()
    return text if not off else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in off)


def main_form(text: str, won: Won | None) -> str:
    """The main text of a page in its form."""
    shown = _shown(text)
    off = set(other_lines(text, won, shown)) if won is not None else ()
    return shown if not off else "\n".join(x for k, x in enumerate(shown.split("\n")) if k not in off)


def host_winners(pages: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Votes and elects: the written table of winners of all hosts of ``pages``."""
    return materialize(winning_paths(path_votes(pages, text, host)))


def boilerplate_lines(pages: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, line_no)`` of every non-blank line that is not main text; lines count from 0, blank ones included."""

    def run(ids, texts, wons):
        out_id, out_no = [], []
        for i, t, w in zip(ids, texts, wons):
            if t and w is not None:
                off = other_lines(t, w)
                out_id += [i] * len(off)
                out_no += off
        return pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_no, pa.int32())], names=["doc_id", "line_no"])

    return over_pages(pages, host_winners(pages, text, host), run, "doc_id long, line_no int", id_column, text, host)


def main_text(pages: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, main_text)`` of every row; null stays null, a text that is no page's stays as it is."""

    def run(ids, texts, wons):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([None if t is None else main_lines(t, w) for t, w in zip(texts, wons)], pa.string())], names=["doc_id", "main_text"]
        )

    return over_pages(pages, host_winners(pages, text, host), run, "doc_id long, main_text string", id_column, text, host)
