"""Main-text extraction by wrappers that are inferred host by host.

A wrapper is a union-free regular expression over markup tokens: a sequence of tags, text
slots, optional groups and repeated groups.  It begins as one page's token stream and is
aligned with the streams of the host's other pages in turn.  A mismatch is resolved as a
repetition if one side repeats what stands before it, or else as optional groups.  A
wrapper's text slots are classed by the regions that they lie in, and each page's main
text is what its alignment with the wrapper puts into the slots of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import slices, written

SALTS = 16
#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
BOILER = frozenset("nav header footer aside form button select dialog menu head title script style noscript template textarea iframe svg".split())
MAIN = frozenset(("article", "main"))
FLOW = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th blockquote pre figure figcaption option hr".split())
#: Names in class, id or role that mark what is not main text; also the
#: first or last part of a compound name, but after one of NOT, or of a text's own header.
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal nav navbar "
    "navigation newsletter notice popup promo related reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
NOT = frozenset("has no with without".split())
MAIN_NAMES = frozenset("article articlebody content main post story entry".split())
#: A quote opens an attribute's value only after its "="; elsewhere it is a character.
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|[^<]+|<", re.S)
_CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


def tokenise(page: str):
    """(kind, name, text) of each token: open and close tags with their class names, and
    texts (decoded).  Comments, declarations and the content of raw elements are left out.
    A tag after which no ">" follows is no text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m[0] == "<":
            after = page[at + 1 : at + 2]
            if after == "/" or after.isascii() and after.isalpha():
                if (end := page.find(">", at)) < 0:  # a tag that never ends
                    return
                m = _CUT.match(page, at)
                if m is None:  # no name: a comment, as in HTML
                    at = end + 1
                    continue
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            marks = " ".join(sorted({w for g in _NAME.findall(m[3]) for x in g for w in x.lower().split()})) if "=" in m[3] else ""
            yield "open", name, marks
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                yield "close", name, ""
        elif page[m.start()] != "<":
            yield "text", "", html.unescape(m[0])
        elif m[0] == "<":
            yield "text", "", "<"


def shape(page: str) -> tuple[list[str], list[list[str]]]:
    """A page's markup tokens and the texts at each of its text tokens.

    Inline markup is part of the text around it.  A token is "<name marks", ">name" or
    "#" (a text), and after "@" the container that it stands in, so that only tokens of
    like places are aligned; adjacent texts between block tags are one."""
    tokens: list[str] = []
    texts: list[list[str]] = []
    inside: list[tuple[str, str]] = []
    open_text = False

    def add(token: str):
        tokens.append(f"{token}@{inside[-1][1]}" if inside else token)

    for kind, name, value in tokenise(page):
        if kind == "text":
            if open_text:
                texts[-1].append(value)
            elif value.strip():
                add("#")
                texts.append([value])
                open_text = True
        elif name in INLINE:
            continue
        elif name == "br":  # white space inside a block
            if open_text:
                texts[-1].append(" ")
        elif name not in VOID or name == "hr":
            open_text = False
            name = name.replace("@", "")
            label = name + (" " + value.replace("@", "") if value else "")
            if kind == "open":
                add("<" + label)
                if name not in FLOW:
                    inside.append((name, label))
            else:
                if any(n == name for n, _ in inside):
                    while inside.pop()[0] != name:
                        pass
                add(">" + name)
    return tokens, texts


# A wrapper is a tuple of items: a token, ("?", items) or ("+", items).

def fold(items: tuple, longest: int = 12) -> tuple:
    """Folds stretches that repeat side by side into repeated groups (shortest first)."""
    changed = True
    while changed:
        changed = False
        for size in range(1, longest + 1):
            out, i = [], 0
            while i < len(items):
                unit = items[i : i + size]
                if len(unit) == size and items[i + size : i + 2 * size] == unit and not (size == 1 and unit[0][0] in "?+"):
                    j = i + size
                    while items[j : j + size] == unit:
                        j += size
                    out.append(("+", unit))
                    i, changed = j, True
                elif i + size < len(items) and len(unit) == size and items[i + size] == ("+", unit):
                    out.append(("+", unit))  # unit unit+ is unit+
                    i, changed = i + size + 1, True
                elif type(items[i]) is tuple and items[i][0] == "+" and items[i + 1 : i + 1 + len(items[i][1])] == items[i][1]:
                    out.append(items[i])
                    i, changed = i + 1 + len(items[i][1]), True
                else:
                    out.append(items[i])
                    i += 1
            items = tuple(out)
    return items


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of both: equal items stay, a repeated group takes in a single one of its
    kind, and what only one side has becomes optional."""
    n, m = len(a), len(b)
    if a == b:
        return a
    # what both begin and end with needs no table
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[lead : n - tail], b[lead : m - tail]
    # an item whose first token the other side has not can have no partner
    heads = [_head(v) for v in x], [_head(v) for v in y]
    common = set(heads[0]) & set(heads[1])
    own, other = ([i for i, h in enumerate(hs) if h in common] for hs in heads)
    cost = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
    for i in range(len(own) - 1, -1, -1):
        u, row, below = x[own[i]], cost[i], cost[i + 1]
        for j in range(len(other) - 1, -1, -1):
            v = y[other[j]]
            fits = u == v or not (type(u) is str and type(v) is str) and unify(u, v) is not None
            row[j] = max(below[j], row[j + 1], 2 + below[j + 1] if fits else 0)
    out, i, j, p, q = [], 0, 0, 0, 0
    while i < len(own) and j < len(other):
        both = unify(x[own[i]], y[other[j]])
        if both is not None and cost[i][j] == 2 + cost[i + 1][j + 1]:
            out += [optional(z) for z in (*x[p : own[i]], *y[q : other[j]])]
            out.append(both)
            p, q, i, j = own[i] + 1, other[j] + 1, i + 1, j + 1
        elif cost[i + 1][j] >= cost[i][j + 1]:
            i += 1
        else:
            j += 1
    out += [optional(z) for z in (*x[p:], *y[q:])]
    return a[:lead] + tuple(_merge_optionals(out)) + a[n - tail :]


def _head(item) -> str:
    while type(item) is tuple:
        item = item[1][0]
    return item


def optional(item):
    return item if type(item) is tuple and item[0] == "?" else ("?", (item,))


def _merge_optionals(items: list) -> list:
    """Neighbouring optional groups that are equal are one."""
    out: list = []
    for x in items:
        if not (out and type(x) is tuple and x[0] == "?" and out[-1] == x):
            out.append(x)
    return out


def unify(a, b):
    """The item that stands for both, or None."""
    if a == b:
        return a
    if type(a) is str and type(b) is str:
        return None
    inner = lambda x: x[1] if type(x) is tuple else (x,)
    kinds = {x[0] if type(x) is tuple else "" for x in (a, b)}
    if "?" in kinds:
        x = a[1] if type(a) is tuple and a[0] == "?" else (a,)
        y = b[1] if type(b) is tuple and b[0] == "?" else (b,)
        if len(x) == len(y) == 1 and (both := unify(x[0], y[0])) is not None:
            return ("?", (both,))
        return ("?", x) if x == y else None
    if inner(a)[0] != inner(b)[0]:
        return None
    if "" in kinds:  # a single token and a group of more than that token
        return ("+", inner(a)) if inner(a) == inner(b) else None
    return ("+", align(inner(a), inner(b)))


def infer(wrapper: tuple | None, tokens: list[str]) -> tuple:
    folded = fold(tuple(tokens))
    return folded if wrapper is None else fold(align(wrapper, folded))


def _names(token: str) -> tuple[str, set[str]]:
    name, *marks = token[1:].partition("@")[0].split(" ")
    return name, set(marks)


def _parts(mark: str) -> list[str]:
    return [w for w in re.split(r"[_-]+", mark) if w]


def boiler(token: str) -> int:
    """2 for boilerplate by its element or a whole name; 1 for what may hold a main region
    that a class names: a form, or by a part of a name; else 0.  Not html or body."""
    name, marks = _names(token)
    if name in ("html", "body"):
        return 0
    if name in BOILER and name != "form" or marks & BOILER_NAMES:
        return 2
    for parts in map(_parts, marks):
        if parts and parts[0] not in NOT and (parts[0] in BOILER_NAMES or parts[-1] in BOILER_NAMES and (parts[-1] != "header" or parts[0] not in MAIN_NAMES)):
            return 1
    return int(name == "form")


def is_main(token: str) -> bool:
    """An article or main element (not one of a comment, an advert and the like), or a
    container that a part of a name marks (article-header or post-comments do not)."""
    name, marks = _names(token)
    by_name = any(not {p[0], p[-1]} & BOILER_NAMES and not MAIN_NAMES.isdisjoint(p) for p in map(_parts, marks) if p)
    if name in MAIN:
        return by_name or not marks & BOILER_NAMES
    return by_name and name in ("div", "section", "td")


def places(steps: list[int]) -> list[tuple[int, int]]:
    """Two names of each slot: its step and which one of the step's texts it is on the page,
    counted from the first (above zero) and from the last (below), as a repeated group
    has one step for all its texts."""
    many = Counter(steps)
    seen: Counter = Counter()
    out = []
    for step in steps:
        seen[step] += 1
        out.append(((step << 24) + seen[step], -((step << 24) + many[step] + 1 - seen[step])))
    return out


class Matcher:
    """A wrapper as an automaton over tokens, with the role of each step.

    A text is main if it lies in a main region and in no boilerplate, as the steps that
    its page takes nest; for a page whose steps cross no main region outside boilerplate,
    the whole body is the region.  An article or main element ends the boilerplate around
    it, and a region that a class names that of ``boiler`` 1."""

    def __init__(self, wrapper: tuple):
        self.steps: list[str] = []
        self.empty: dict[int, list[int]] = {}
        self._add(wrapper)
        self.roles = [(t[0], _names(t)[0], boiler(t), is_main(t)) for t in self.steps]
        self.reach = [self._close(i) for i in range(len(self.steps) + 1)]

    def _add(self, items: tuple):
        for x in items:
            if type(x) is str:
                self.steps.append(x)
                continue
            first = len(self.steps)
            self._add(x[1])
            if x[0] == "?":
                self.empty.setdefault(first, []).append(len(self.steps))
            else:
                self.empty.setdefault(len(self.steps), []).append(first)

    def _close(self, state: int) -> list[int]:
        seen, todo = {state: None}, [state]
        while todo:
            for s in self.empty.get(todo.pop(), ()):
                if s not in seen:
                    seen[s] = None
                    todo.append(s)
        return list(seen)

    def path(self, tokens: list[str]) -> list[int] | None:
        """The step that consumes each token, or None if the wrapper does not accept them
        (all paths at once, so no backtracking; of several one through earlier steps)."""
        live, back = dict.fromkeys(self.reach[0]), []
        for t in tokens:
            came: dict[int, int] = {}
            for s in sorted(live):
                if s < len(self.steps) and self.steps[s] == t:
                    for r in self.reach[s + 1]:
                        came.setdefault(r, s)
            if not came:
                return None
            back.append(came)
            live = came
        state = len(self.steps)
        if state not in live:
            return None
        out = []
        for came in reversed(back):
            state = came[state]
            out.append(state)
        return out[::-1]

    def blocks(self, tokens: list[str], texts: list[list[str]], template=frozenset()) -> list[str] | None:
        """The main blocks of a page in page order, or None if it is not accepted.  On a page
        without a marked main region the texts at places of ``template`` are none, if others are."""
        path = self.path(tokens)
        if path is None:
            return None
        slots: list[tuple[bool, bool]] = []  # of each text: outside boilerplate, in a main region
        stack: list[tuple[str, int, bool]] = []
        marked = False
        for kind, name, own, main in map(self.roles.__getitem__, path):
            out, region = stack[-1][1:] if stack else (0, False)
            if kind == "#":
                slots.append((not out, region))
            elif kind == "<" and name not in VOID:
                if main and (name in MAIN or max(out, own) < 2):
                    out = 0
                elif name not in MAIN:
                    out = max(out, own)
                marked = marked or main and not out
                stack.append((name, out, region or main))
            elif kind == ">" and any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
        steps = [step for step in path if self.roles[step][0] == "#"]
        lines = [_SPACE.sub(" ", "".join(x)).strip() for x in texts]
        found = [(x, at) for x, at, (clear, region) in zip(lines, places(steps), slots, strict=True) if x and clear and (region or not marked)]
        data = found if marked or not template else [(x, at) for x, at in found if template.isdisjoint(at)]
        return [x for x, _ in data or found]


def _encode(wrapper) -> str:
    import json

    return json.dumps(wrapper)


def _decode(text: str):
    import json

    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return tuples(json.loads(text))


#: A slot is template if its text is the same on at least half of a host's pages without a
#: marked main region, of which there are so many different ones.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Bytes of token streams that a task holds before it passes them on.
STREAM_BYTES = 8 << 20
_PARTIAL = "host string, wrapper string, stream string, n long, low array<long>, high array<long>, pages array<long>"


class _Slots:
    """The texts in the slots of one host's token stream: least and greatest hash of each,
    number of pages, and the hashes of the pages."""

    def __init__(self, size: int):
        self.n, self.low, self.high, self.pages = 0, np.full(size, 2**63 - 1), np.full(size, -(2**63)), set()

    def add(self, page: str, texts: list[list[str]]):
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(_SPACE.sub(" ", "".join(x)).strip()) for x in texts], np.uint64).view(np.int64)
        self.n += 1
        self.low, self.high = np.minimum(self.low, h), np.maximum(self.high, h)
        self.pages.add(int(np.uint64(xxhash.xxh64_intdigest(page)).astype(np.int64)))


def templates(partial: DataFrame, found: DataFrame) -> DataFrame:
    """host and the places (see ``places``) of its wrapper whose text is template.  ``partial`` has the text slots
    of the pages without a marked main region, stream by stream; a stream's path through
    the wrapper says which step each slot is, so slots of different streams meet."""
    own = partial.filter(F.col("stream").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("stream", "low"), F.lit(SALTS)))
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    laid = own.drop("wrapper").join(many, ["host", "salt"]).select("host", "wrapper", "stream", "n", "low", "high")

    def steps(batches):
        known: dict[str, Matcher] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["wrapper"] not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[r["wrapper"]] = Matcher(_decode(r["wrapper"]))
                path = known[r["wrapper"]].path(r["stream"].split("\x00"))
                if path is None:
                    continue
                at = places([step for step in path if known[r["wrapper"]].roles[step][0] == "#"])
                if at:
                    both = [x for one in at for x in one]
                    yield pa.RecordBatch.from_arrays([pa.array([r["host"]] * len(both)), pa.array(both, pa.int64()), pa.array([r["n"]] * len(both), pa.int64()),
                                                      pa.array(np.repeat(r["low"], 2)), pa.array(np.repeat(r["high"], 2))], names=["host", "place", "n", "low", "high"])

    slots = laid.mapInArrow(steps, "host string, place long, n long, low long, high long").groupBy("host", "place").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high")
    pages = own.select("host", F.explode("pages").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("different"))
    sizes = own.groupBy("host").agg(F.sum("n").alias("pages")).join(pages.filter(F.col("different") >= LEAST_PAGES), "host")
    same = slots.join(sizes, "host").filter(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return same.groupBy("host").agg(F.array_sort(F.collect_list("place")).alias("template"))


def wrappers(pages: DataFrame, host: str = "host", page: str = "html") -> DataFrame:
    """host, wrapper and template (places whose text is the host's, not the page's; see
    ``templates``) of every host.  Each task aligns distinct streams as it reads and
    sends on one partial wrapper for each host; partial wrappers are aligned in two more
    steps (host and salt, then host), so a host with a third of all pages is never in
    one task: what travels is one bounded expression for each task and host."""

    arrow = to_arrow_schema(StructType.fromDDL(_PARTIAL))

    def read(batches):
        made: dict[str, tuple] = {}
        seen: set[tuple] = set()
        slots: dict[tuple[str, str], _Slots] = {}
        regions: dict[str, bool] = {}
        held = 0

        def passed_on():
            names = list(slots)
            columns = [[s[0] for s in names], [None] * len(names), [s[1] for s in names], [s.n for s in slots.values()], [s.low.tolist() for s in slots.values()],
                       [s.high.tolist() for s in slots.values()], [list(s.pages) for s in slots.values()]]
            slots.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            for part in slices(b, page):
                for h, p in zip(part.column(host).to_pylist(), part.column(page).to_pylist(), strict=True):
                    tokens, texts = shape(p)
                    new = [t for t in set(tokens) if t not in regions]
                    regions.update((t, is_main(t)) for t in new)
                    if not any(map(regions.__getitem__, tokens)):
                        name = (h, "\x00".join(tokens))
                        if name not in slots:
                            slots[name] = _Slots(len(texts))
                            held += len(name[1]) + 32 * len(texts)
                        slots[name].add(p, texts)
                        held += 40
                        if held > STREAM_BYTES:
                            yield from passed_on()
                            held = 0
                    if len(regions) > 100_000:
                        regions.clear()
                    key = (h, fold(tuple(tokens)))
                    if key in seen:
                        continue
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(key)
                    made[h] = key[1] if h not in made else fold(align(made[h], key[1]))
        yield from passed_on()
        nothing = [pa.nulls(len(made), f.type) for f in list(arrow)[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(map(_encode, made.values())), pa.string()), *nothing], schema=arrow)

    def merge(batches):
        host, wrapper = None, None
        for b in batches:
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if wrapper is not None and h != host:
                    yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([_encode(wrapper)])], names=["host", "wrapper"])
                    wrapper = None
                host, wrapper = h, _decode(w) if wrapper is None else fold(align(wrapper, _decode(w)))
        if wrapper is not None:
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([_encode(wrapper)])], names=["host", "wrapper"])

    partial = written(pages.select(host, page).mapInArrow(read, _PARTIAL), "wrapper-parts")
    rows = partial.filter(F.col("wrapper").isNotNull()).select("host", "wrapper").distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    part = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(merge, "host string, wrapper string")
    found = written(part.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, "host string, wrapper string"), "wrappers")
    return found.join(templates(partial, found), "host", "left")


def main_text(pages: DataFrame, keep: dict[str, str] | None = None, page: str = "html", url: str = "url") -> DataFrame:
    """The columns of ``keep`` (page_id and url by default), text and n_chars (its code
    points): the blocks of main text, joined by a line feed, empty if there are none.

    What the alignment of a host's pages shows decides for pages without a marked main
    region: a slot whose text is the same on most of them is left out.

    A null page is an empty one; repeated rows give repeated results, an empty table none; pages without a host share the empty host.  Pages are
    compressed before they are dealt out to their host's wrapper, and salted, since a
    host may have a third of them.  A page that its host's wrapper does not accept (an
    alignment that folds repetitions differently) is aligned with it once more."""
    keep = keep or {"page_id": "page_id", "url": "url"}
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()],
                        F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("__llm_host"),
                        F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("__llm_page"))
    found = written(wrappers(rows, "__llm_host", "__llm_page"), "wrapper-slots")
    packed_schema = rows.drop("__llm_page").withColumn("__llm_packed", F.lit(b"")).schema

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for part in slices(b, "__llm_page"):
                packed = pa.array([squeeze(p.encode()) for p in part.column("__llm_page").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=packed_schema.names)

    salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS))
    packed = rows.mapInArrow(pack, packed_schema).withColumn("__llm_salt", salt)
    many = found.select(F.col("host").alias("__llm_host"), "wrapper", "template").withColumn("__llm_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = packed.join(many, ["__llm_host", "__llm_salt"]).select(*keep, "__llm_packed", F.col("wrapper").alias("__llm_wrapper"), F.col("template").alias("__llm_template"))
    schema = joined.drop("__llm_packed", "__llm_wrapper", "__llm_template").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def extract(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[str, Matcher] = {}
        for b in batches:
            out = []
            for p, w, t in zip(*(b.column(c).to_pylist() for c in ("__llm_packed", "__llm_wrapper", "__llm_template")), strict=True):
                if w not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[w] = Matcher(_decode(w))
                tokens, texts = shape(unpack(p).decode())
                found = known[w].blocks(tokens, texts, frozenset(t or ()))
                if found is None:
                    found = Matcher(align(_decode(w), tuple(tokens))).blocks(tokens, texts)
                out.append("\n".join(found))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=schema.names)

    return joined.mapInArrow(extract, schema)
