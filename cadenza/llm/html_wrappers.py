"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page's block elements are a token stream; neighbours of one kind (element and class words, numbers in these left
out) fold into a repeated group. Same-host streams are aligned one after another (``align``): what both have is
required, what one lacks becomes optional, what repeats in either becomes repeated, and text becomes a slot. The
result is a regular expression without unions, the host's wrapper. Pages fold into few distinct streams before
the shuffle, and partial wrappers align like pages do, in rounds of ``FAN``, so that no task folds a large host.

Each page is then matched against its host's wrapper, which gives each text block its slot, a place in the wrapper. What
a slot holds over the host's pages, and where it stands in the wrapper, decides (``content_slots``): see there.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import slices

FAN = 64
LEAST = 3  # pages that differ elsewhere, for a text that stays the same to be the template's
DEEP = 100  # elements nested deeper share a node with the one that holds them
PLAIN = 40_000  # products of lengths up to which streams are aligned with the most pairs
WIDE = 1 << 20  # products of lengths up to which the fewest blocks without a slot are searched for
BROADCAST = 32 << 20  # bytes of a table of wrappers that is broadcast; a larger one is joined
# Fixed values of HTML: elements by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section select summary svg table tbody td template tfoot th thead tr ul caption head noscript option legend".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
APART = set("nav header footer aside form menu dialog head button select svg template noscript".split())
WORDS_APART = set("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
STATES = set("no not non has have with without is are hide hides show shows free open opened closed on off enabled disabled active".split())  # beside a word of these, a name tells of a state
ROLES_APART = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CENTRE = {"article", "main"}
WHOLE = CENTRE | {"html", "body"}  # their class words speak of the page, not of the element
NUMBERED = re.compile(r"(?<=[._-])[^/._-]*[0-9][^/._-]*")  # a part of a class word that is a number or an id
MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]*")
PARTS = re.compile(r"[^a-z0-9]+")
INSIDE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def named_apart(names: set[str]) -> bool:
    """Do class words or an id name something apart: by their parts (site-footer, cookie_notice), but no-sidebar and comments-open tell of states."""
    return any(set(parts) & WORDS_APART and not set(parts) & STATES for parts in map(PARTS.split, names))


class Source:
    """A page's text and searches in it, each of which fails once at most, so that no markup makes reading quadratic."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def close(self, name: str, at: int) -> int:
        """The end of the element's end tag, or -1."""
        if name in self.gone:
            return -1
        found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.text, at)
        if found is None:
            self.gone.add(name)
            return -1
        return found.end()

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes hide one, if they are closed and one follows."""
        first = self.find(">", at)
        here = at
        while first >= 0:
            m = INSIDE.search(self.text, here)
            if m is None:
                return first
            if m.group() == ">":
                return m.start()
            shut = self.find(m.group(), m.end())
            if shut < 0 or self.find(">", shut) < 0:
                return first
            here = shut + 1
        return first


def read(source: str) -> list:
    """The page as a tree: nodes [kind, child, ...], text blocks ["#", text, characters in links].

    A kind is the element's name with its class words; ! before it says that the element itself is named as something apart,
    and * that it is an article or main.
    """
    root = [""]
    stack = [("", root)]
    words: list[str] = []
    linked, link = 0, False
    src, at, n = Source(source), 0, len(source)

    def flush():
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                stack[-1][1].append(["#", text, min(linked, len(text))])
        linked = 0

    def close(depth):
        flush()
        del stack[depth:]

    def say(text):
        nonlocal linked
        if text:
            text = html.unescape(text)
            words.append(text)
            linked += len(text) * link

    while at < n:
        m = MARKUP.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        here = m.start()
        if m.group() == "<!--":
            end = src.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        end = src.tag_end(m.end())
        if end < 0:  # no tag ends any more
            say(source[here:])
            break
        at = end + 1
        if m.group()[1] in "!?":
            continue
        closing = m.group()[1] == "/"
        name = NAME.match(source, here + 1 + closing, end).group().lower()
        if name in RAW:
            if not closing and source[end - 1] != "/":
                stop = src.close(name, at)
                at = stop if stop >= 0 else n if name in ("script", "style") else at
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in BLOCK:
            if name == "a":
                link = not closing
            elif name == "button" and not closing:
                stop = src.close(name, at)
                at = stop if stop >= 0 else at
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                close(depth)
            else:
                flush()
            continue
        flush()
        if stack[-1][0] == "p" or name in CLOSES:
            ends = CLOSES.get(name, ())
            depth = len(stack)
            while depth > 1 and (stack[depth - 1][0] == "p" or stack[depth - 1][0] in ends):
                depth -= 1
            close(depth)
        kind, tokens, roles = name, set(), set()
        tail = source[here + 1 + len(name) : end]
        if "=" in tail:
            for what, a, b, c in ATTRIBUTE.findall(tail):
                value = (a or b or c).lower()
                if what.lower() == "role":
                    roles.add(value.strip())
                else:
                    tokens.update(value.split())
                    if what.lower() == "class" and value.split():
                        kind = NUMBERED.sub("0", f"{name}.{'.'.join(sorted(value.split()))}")
        centre = name in CENTRE or bool(roles & {"main", "article"})
        apart = bool(roles & ROLES_APART) or name in APART or (name not in WHOLE and not centre and named_apart(tokens))
        if name == "header" and any(node[0].startswith("*") for _, node in stack):
            apart = False  # an article's own header: its headline and byline
        if apart:
            kind = "!" + kind
        elif centre:
            kind = "*" + kind
        node = stack[-1][1]
        if len(stack) < DEEP:
            node.append([kind])
            node = node[-1]
        elif kind[0] == "!" and node[0][:1] != "!":  # too deep for a node, but not for its text to be left out
            node.append([kind])
            node = node[-1]
        stack.append((name, node))
    close(1)
    return root


def fold(node: list) -> list:
    """The stream of a page's tree, [kind, mark, children]: neighbours of one kind as one repeated group, text as slots."""
    if node[0] == "#":
        return ["#", "", []]
    out: list = []
    for child in node[1:]:
        child = fold(child)
        if out and out[-1][0] == child[0]:
            both = align(out[-1], child)
            out[-1] = both if child[0] == "#" else [both[0], joined_mark(both[1], "+"), both[2]]
        else:
            out.append(child)
    return [node[0], "", out]


def joined_mark(a: str, b: str) -> str:
    both = set(a + b)
    if both & {"*"} or {"?", "+"} <= both:
        return "*"
    return "".join(both)


def paired(x: list, y: list) -> list[tuple[int, int]]:
    """Pairs of places of equal kinds, in order: as many as can be, or, for long lists, each with the next that is free."""
    n, m = len(x), len(y)
    if n * m > PLAIN:
        places: dict[str, list[int]] = {}
        for i in range(n - 1, -1, -1):
            places.setdefault(x[i][0], []).append(i)
        out, last = [], -1
        for j in range(m):
            own = places.get(y[j][0], [])
            while own and own[-1] <= last:
                own.pop()
            if own and own[-1] - last <= FAN:
                last = own.pop()
                out.append((last, j))
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i][0] == y[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The least wrapper of two of one kind: equal kinds pair up in order, what is left over is optional."""
    x, y = a[2], b[2]
    out: list = []

    def put(node):
        if out and out[-1][0] == node[0]:  # two of a kind side by side are a repetition
            both = align(out[-1], node)
            mark = "*" if "?" in out[-1][1] + node[1] else joined_mark(both[1], "+")
            out[-1] = [both[0], "" if node[0] == "#" else mark, both[2]]
        else:
            out.append(node)

    i = j = 0
    for k, m in [*paired(x, y), (len(x), len(y))]:
        for node in [*x[i:k], *y[j:m]]:
            put([node[0], joined_mark(node[1], "?"), node[2]])
        if k < len(x):
            put(align(x[k], y[m]))
        i, j = k + 1, m + 1
    return [a[0], joined_mark(a[1], b[1]), out]


def expression(node: list) -> str:
    """A wrapper as text: <kind>...</kind>, # for a slot, (...)? (...)+ (...)* for marks."""
    inside = "".join(map(expression, node[2]))
    own = "#" if node[0] == "#" else f"<{node[0]}>{inside}</{node[0]}>" if node[0] else inside
    return f"({own}){node[1]}" if node[1] else own


class Wrapper:
    """A host's wrapper with its nodes numbered in order."""

    def __init__(self, tree: list):
        self.tree = tree
        self.kind, self.parent, self.optional, self.children = [], [], [], []
        self._number(tree, -1)
        self.is_apart = [self.apart(k) for k in range(len(self.kind))]

    def _number(self, node: list, parent: int) -> int:
        own = len(self.kind)
        self.kind.append(node[0])
        self.parent.append(parent)
        self.optional.append(bool(node[1]) and node[1] in "?*")
        self.children.append([])
        self.children[own] = [self._number(child, own) for child in node[2]]
        return own

    def slots(self, page: list) -> list[tuple[int, str, int]]:
        """The page's blocks in order, each with its slot: a page is a word of its host's wrapper, so each has one; -1 only for a page that is not.

        Children are matched in order, each with the first node of its kind that is left; where that leaves a block without a slot, as the node that a page
        was aligned with can be a later one of the kind, with the nodes that leave the fewest.
        """
        out = self._matched(page, lambda node, own: self._first(node, own))
        if all(slot >= 0 for slot, _, _ in out):
            return out
        known: dict[tuple[int, int], tuple[int, list[int]]] = {}
        return self._matched(page, lambda node, own: self._best(node, own, known)[1])

    def _matched(self, page: list, places) -> list[tuple[int, str, int]]:
        out: list[tuple[int, str, int]] = []

        def match(node, own):
            for child, place in zip(node[1:], places(node, own), strict=True):
                if child[0] == "#":
                    out.append((place, child[1], child[2]))
                else:
                    match(child, place)

        match(page, 0)
        return out

    def _first(self, node: list, own: int) -> list[int]:
        kinds = self.children[own] if own >= 0 else []
        at, out = 0, []
        for child in node[1:]:
            found = next((k for k in range(at, len(kinds)) if self.kind[kinds[k]] == child[0]), -1)
            if found >= 0:
                at = found  # it may come again: neighbours of one kind are one node of the wrapper
            out.append(kinds[found] if found >= 0 else -1)
        return out

    def _best(self, node: list, own: int, known: dict) -> tuple[int, list[int]]:
        """How many blocks stay without a slot at least, and the places of the children that leave so few."""
        if (id(node), own) in known:
            return known[id(node), own]
        kinds = self.children[own] if own >= 0 else []
        blocks = lambda x: 1 if x[0] == "#" else sum(map(blocks, x[1:]))
        if (len(node) - 1) * len(kinds) > WIDE:
            known[id(node), own] = self._near(node, kinds, known, blocks)
            return known[id(node), own]
        least, back = [0] * (len(kinds) + 1), []  # the least over places up to k; one more, the first, for none yet
        for child in node[1:]:
            lost = blocks(child)
            new, step = [least[0] + lost], [(0, -1)]
            for k, place in enumerate(kinds, 1):
                without = least[k] + lost, (k, -1)
                here = (least[k] + (0 if child[0] == "#" else self._best(child, place, known)[0]), (k, place)) if self.kind[place] == child[0] else without
                left = new[-1], step[-1]
                cost, how = min(here, without, left, key=lambda x: x[0])
                new.append(cost)
                step.append(how)
            least = new
            back.append(step)
        k, places = len(kinds), []
        for step in reversed(back):
            k, place = step[k]
            places.append(place)
        known[id(node), own] = least[-1], places[::-1]
        return known[id(node), own]

    def _near(self, node: list, kinds: list[int], known: dict, blocks) -> tuple[int, list[int]]:
        """The same for long lists, in line: each child takes the best of the next FAN nodes of the list, so that some blocks may stay without a slot (-1 counts as content)."""
        at, places, total = 0, [], 0
        for child in node[1:]:
            found = [k for k in range(at, min(at + FAN, len(kinds))) if self.kind[kinds[k]] == child[0]]
            costs = [0 if child[0] == "#" else self._best(child, kinds[k], known)[0] for k in found]
            lost = min(costs, default=blocks(child))
            total += lost
            places.append(kinds[found[costs.index(lost)]] if found else -1)
            at = found[costs.index(lost)] if found else at
        return total, places

    def above(self, slot: int):
        while slot >= 0:
            yield slot
            slot = self.parent[slot]

    def apart(self, slot: int) -> bool:
        return any(self.kind[k].startswith("!") for k in self.above(slot))

    def centre(self, slot: int) -> bool:
        return any(self.kind[k].startswith("*") for k in self.above(slot))

    def required(self, slot: int) -> bool:
        return not any(self.optional[k] for k in self.above(slot))


def content_slots(wrapper: Wrapper, held: dict[int, tuple[bool, float]]) -> tuple[set[int], set[int]]:
    """Slots of main text: those in article or main, and those that count on a page which has none of the first. A block without a slot (-1) counts in either.

    held tells of each slot whether its text stays the same over LEAST pages or more that differ elsewhere, and the share of its text that lies in links.
    An element that is named as a menu, header, footer, sidebar, notice, advert, form or comments takes no part, in either. Of the others, a slot counts if its
    text varies and is not mostly links; in article or main that is enough, but if no slot there passes, all of them count. Elsewhere it must also be required, or
    optional within the smallest element that holds the elements of all required ones.
    """
    slots = [k for k, kind in enumerate(wrapper.kind) if kind == "#" and not wrapper.apart(k)]
    inside = {k for k in slots if wrapper.centre(k)}
    varied = [k for k in slots if not held.get(k, (False, 0.0))[0] and held.get(k, (False, 0.0))[1] <= 0.5]
    centre = inside.intersection(varied) or inside
    varied = [k for k in varied if k not in inside]
    required = [k for k in varied if wrapper.required(k)]
    if not required:
        return centre | {-1}, {*varied, -1}
    shared = set(wrapper.above(required[0]))
    for k in required[1:]:
        shared &= set(wrapper.above(k))
    region = max(shared - set(required) - {wrapper.parent[k] for k in required}, default=0)  # nodes are numbered from the root down
    return centre | {-1}, {k for k in varied if region in wrapper.above(k)} | {-1}


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


PAGES = "host string, tree string"
STREAMS = "host string, stream string, n long"
SLOTS = "host string, slot int, page long, low long, high long, chars long, linked long"


def dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, tree (``read`` as JSON), stream (``fold`` as JSON), from one reading of the html."""
    kinds = [(c, pages.schema[c].dataType.simpleString()) for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                trees = [read(source or "") for source in part.column("html").to_pylist()]
                columns = [pa.array([dumped(f(t)).encode("utf-8", "replace") for t in trees], pa.binary()).cast(pa.string()) for f in (lambda t: t, fold)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), *columns], names=["page_id", "url", "host", "tree", "stream"])

    return pages.select("page_id", "url", host().alias("host"), "html").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds) + ", host string, tree string, stream string")


def wrappers(read_pages: DataFrame) -> DataFrame:
    """(host, wrapper, n): a host's wrapper as JSON and its pages, from parsed pages. Null and empty pages are empty streams."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("stream").to_pylist(), table.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        wrapper = None
        for stream, _ in rows:
            node = json.loads(stream)
            wrapper = node if wrapper is None else align(wrapper, node)
        return pa.table({"host": [table.column("host")[0].as_py()], "stream": [dumped(wrapper)], "n": pa.array([sum(n for _, n in rows)], pa.int64())})

    parts = X.written(read_pages.groupBy("host", "stream").agg(F.count("*").alias("n")), "streams")
    while True:
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / FAN).cast("long").alias("parts"))
        most = sizes.agg(F.max("parts")).first()[0] or 1
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")))
        parts = X.written(dealt.select("host", "part", "stream", "n").groupBy("host", "part").applyInArrow(run, STREAMS), "wrappers")
        if most == 1:
            return parts.withColumnRenamed("stream", "wrapper")


def joined(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows with what a written table of hosts says: the table is broadcast if it is small, else both are shuffled and a large host is split by Spark."""
    size = X.size_of(hosts)
    return rows.join(F.broadcast(hosts) if size is not None and size <= BROADCAST else hosts, "host")


class Hosts:
    """Wrappers and content slots of the hosts that a task has met last."""

    def __init__(self, limit: int = 200):
        self.kept: dict[str, object] = {}
        self.limit = limit

    def get(self, told: str, make):
        if told not in self.kept:
            if len(self.kept) >= self.limit:
                self.kept.clear()
            self.kept[told] = make(told)
        return self.kept[told]


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def held(read_pages: DataFrame) -> DataFrame:
    """What each slot of each host holds over all pages, from parsed pages with their wrapper: (host, slot, constant, linked).

    constant: the same text on all its pages, LEAST of which differ elsewhere (in what is not apart); pages that are copies of each other count as one.
    """

    def run(batches):
        hosts = Hosts()
        for batch in batches:
            for part in slices(batch, "tree"):
                total: dict[tuple, list[int]] = {}
                least: dict[tuple, list[int]] = {}
                for name, tree, told in zip(*(part.column(c).to_pylist() for c in ("host", "tree", "wrapper")), strict=True):
                    wrapper = hosts.get(told, lambda t: Wrapper(json.loads(t)))
                    own: dict[int, list] = {}
                    for slot, text, linked in wrapper.slots(json.loads(tree)):
                        if slot < 0 or not wrapper.is_apart[slot]:
                            own.setdefault(slot, [[], 0])[0].append(text)
                            own[slot][1] += linked
                    page = hash_of(repr(own))
                    for slot, (texts, linked) in own.items():
                        text = "\n".join(texts)
                        h = hash_of(text)
                        t = total.setdefault((name, slot), [h, h, 0, 0])
                        t[0], t[1], t[2], t[3] = min(t[0], h), max(t[1], h), t[2] + len(text), t[3] + linked
                        few = least.setdefault((name, slot), [])
                        if page not in few and len(few) < LEAST:
                            few.append(page)
                rows = [(*key, page, low, high, chars if k == 0 else 0, linked if k == 0 else 0) for key, (low, high, chars, linked) in total.items() for k, page in enumerate(least[key])]
                columns = [*zip(*rows, strict=True)] if rows else [()] * 7
                types = [pa.string(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "slot", "page", "low", "high", "chars", "linked"])

    folded = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    rows = read_pages.select("host", "tree", "wrapper").mapInArrow(run, SLOTS)
    rows = rows.groupBy("host", "slot", "page").agg(*folded).groupBy("host", "slot").agg(*folded, F.count("*").alias("copies"))
    return rows.select("host", "slot", ((F.col("low") == F.col("high")) & (F.col("copies") >= LEAST)).alias("constant"), (F.col("linked") / F.greatest("chars", F.lit(1))).alias("linked"))


def main_text(wrapper: Wrapper, slots: tuple[set[int], set[int]], tree: list) -> str:
    """A page's blocks in the wrapper's slots of main text; a page with none in article or main gives its other ones."""
    blocks = wrapper.slots(tree)
    for chosen in slots:
        texts = [text for slot, text, _ in blocks if slot in chosen]
        if texts:
            return "\n".join(texts)
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Null or empty html, and pages without content, have an empty text.

    A page that has text in article or main gives that, but for slots that the host's pages show to be its template's or mostly links; another its other content slots, see ``content_slots``.
    Elements named by a word of WORDS_APART, as class word or id, are left out with all they hold, but not html, body, article or main.
    Equal rows give equal rows; other columns are ignored.
    """
    trees = X.written(parsed(pages), "pages")
    known = wrappers(trees).select("host", "wrapper")
    rows = joined(trees.select("page_id", "url", "host", "tree"), known)
    stats = held(rows).groupBy("host").agg(F.collect_list(F.struct("slot", "constant", "linked")).alias("held"))
    told = X.written(known.join(stats, "host", "left").select("host", F.to_json(F.struct("wrapper", "held")).alias("told")), "hosts")
    rows = joined(trees.select("page_id", "url", "host", "tree"), told)

    def made(told: str):
        x = json.loads(told)
        wrapper = Wrapper(json.loads(x["wrapper"]))
        return wrapper, content_slots(wrapper, {h["slot"]: (h["constant"], h["linked"]) for h in x.get("held") or ()})

    def run(batches):
        hosts = Hosts()
        for batch in batches:
            for part in slices(batch, "tree"):
                texts = [main_text(*hosts.get(told, made), json.loads(tree)) for tree, told in zip(part.column("tree").to_pylist(), part.column("told").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "tree", "told").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
