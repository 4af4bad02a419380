"""HTML extraction by wrapper induction.

Pages of one host are made by one template. One page of each host is its wrapper; the whole tree of
each page is aligned with it by simple tree matching: two nodes match if their tags are equal, and
their children so that most nodes match in order, and of such matchings most say the same.

What the pages of a host have in common is then counted on the wrapper's tree. A text leaf that says
the same as the leaf it is aligned with votes that this leaf is constant: leaves constant on most
different pages are template. All other text fills a varying slot: the deepest element of the
wrapper that holds it. The article is where the varying slots of all pages have most of their text
(htmltext.region); markup only refines that: what a page says is no article goes. A page in which
nothing is aligned with the article, being of another make, is judged by itself in the same way.

Alignment works page by page against a wrapper of one page, so a host may have any number of pages;
votes and text are counted with partial sums, and pages that say the same have one vote together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _spark, htmltext
from tabulith.llm.htmltext import Node, ordered, parse

#: Share of a host's different pages that have to agree on a leaf, and the fewest that can decide.
CONSTANT, FEWEST = 0.8, 5
#: Bytes of all hosts' wrapper pages up to which they are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 16 << 20
#: Pairs of children up to which their table is held whole; beyond, it is divided, with the same result.
GRID = 4_000_000
#: What a matched node weighs against a leaf that says the same.
NODE = 1 << 24


class Matcher:
    """Simple tree matching. Weights depend on shapes alone, so they are kept from page to page; texts decide between equal ones."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.forms: list[tuple] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> None:
        """Number every subtree by its shape (in place), and hash what it says (said) with its number of leaves."""
        todo = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if not ready and node.children:
                todo.append((node, True))
                todo += [(c, False) for c in node.children]
                continue
            form = (node.tag, *[c.place for c in node.children])
            number = self.shapes.get(form)
            if number is None:
                number = self.shapes[form] = len(self.forms)
                self.forms.append(form)
                self.sizes.append(1 + sum(self.sizes[c.place] for c in node.children))
            node.place = number
            below = [c.said for c in node.children]
            node.said = hash((node.tag, node.text, *[x[0] for x in below])), sum(x[1] for x in below) + (node.tag == "#text")

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        return 0 if self.forms[a][0] != self.forms[b][0] else self.weights.get((a, b))

    def weight(self, a: int, b: int) -> int:
        """The most nodes that two shapes match. Pairs of shapes below that are not known come first, so depth has no limit."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if self._known(*pair) is not None:
                todo.pop()
                continue
            x, y = (self.forms[s][1:] for s in pair)
            head, tail = self._ends(x, y)
            middle = x[head : len(x) - tail], y[head : len(y) - tail]
            open_ = [(s, t) for s in set(middle[0]) for t in set(middle[1]) if self._known(s, t) is None]
            if open_:
                todo += open_
                continue
            total = 1 + sum(self.sizes[s] for s in x[:head]) + sum(self.sizes[s] for s in x[len(x) - tail :])
            if middle[0] and middle[1]:
                total += int(self._last(*(tuple((s,) for s in m) for m in middle))[-1]) // NODE
            self.weights[pair] = total
            todo.pop()
        return self._known(a, b)

    @staticmethod
    def _ends(x: tuple, y: tuple) -> tuple[int, int]:
        """How many equal items both begin with, and how many more both end with: some best matching has them."""
        n = min(len(x), len(y))
        head = next((i for i in range(n) if x[i] != y[i]), n)
        tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
        return head, tail

    def _rows(self, a: tuple, b: tuple) -> Iterator[np.ndarray]:
        """The weights of each of a with all of b; items: (shape,) or (shape, what it says, its leaves)."""
        kinds = {s: np.array([self.weight(s, y[0]) for y in b], np.int64) * NODE for s in {x[0] for x in a}}
        said = np.array([y[1] for y in b], np.int64) if len(b[0]) > 1 else None
        for x in a:
            yield kinds[x[0]] if said is None else kinds[x[0]] + (said == x[1]) * x[2]

    def _last(self, a: tuple, b: tuple) -> np.ndarray:
        """The weights of all of a with each beginning of b."""
        row = np.zeros(len(b) + 1, np.int64)
        for w in self._rows(a, b):
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
        return row

    def _pairs(self, a: tuple, b: tuple) -> list[tuple[int, int]]:
        """The pairs of a best matching in order."""
        if not a or not b:
            return []
        if len(a) > 1 and len(a) * len(b) > GRID:
            half = len(a) // 2
            k = int(np.argmax(self._last(a[:half], b) + self._last(a[half:][::-1], b[::-1])[::-1]))
            return self._pairs(a[:half], b[:k]) + [(half + i, k + j) for i, j in self._pairs(a[half:], b[k:])]
        rows = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i, w in enumerate(self._rows(a, b)):
            np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + w), out=rows[i + 1, 1:])
        i, j, found = len(a), len(b), []
        while i and j:
            if rows[i, j] == rows[i - 1, j]:
                i -= 1
            elif rows[i, j] == rows[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]

    def aligned(self, page: Node, wrapper: Node) -> Iterator[tuple[Node, Node]]:
        """Pairs of aligned nodes, each after the one above it."""
        todo = [(page, wrapper)]
        while todo:
            a, b = todo.pop()
            yield a, b
            if a.tag == "#text":
                continue
            x, y = (tuple((c.place, *c.said) for c in n.children) for n in (a, b))
            head, tail = self._ends(x, y)
            pairs = [(head + i, head + j) for i, j in self._pairs(x[head : len(x) - tail], y[head : len(y) - tail])]
            pairs += [(i, i) for i in range(head)] + [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]
            todo += [(a.children[i], b.children[j]) for i, j in pairs]

    def forget(self) -> None:
        if len(self.forms) > 100_000 or len(self.weights) > 200_000:
            self.__init__()


#: Marks of a leaf: markup says that it is no article; it is in a likely article; it is mostly a link; and in a list of such,
#: outside of likely articles; the page by itself takes it.
DROPPED, LIKELY, LINKED, LISTED, OWN = 1, 2, 4, 8, 16


class Wrapper:
    """A host's wrapper page: its tree, and the place of each node in page order."""

    def __init__(self, html: str, matcher: Matcher):
        self.tree = parse(html)
        matcher.shape(self.tree)
        self.nodes = ordered(self.tree)
        self.place = {id(x): k for k, x in enumerate(self.nodes)}
        self.made_by = matcher.forms


def read(html: str, wrapper: Wrapper, matcher: Matcher) -> list[tuple[str, int, int, int]]:
    """The text leaves of a page in page order: (text, slot, same, marks).

    slot: the place of the wrapper's deepest element that is aligned with one around the leaf; same: the
    place of the wrapper's leaf aligned with it if that says the same, else -1.
    """
    page = parse(html)
    matcher.shape(page)
    with_: dict[int, Node] = {id(a): b for a, b in matcher.aligned(page, wrapper.tree)}
    nodes = ordered(page)
    gone = htmltext.said_to_go(nodes)
    mass = htmltext.own_mass(nodes, gone)
    likely = htmltext.articles(nodes, mass)
    spans, roots = htmltext.region(nodes, mass)
    slot: dict[int, int] = {}
    out = []
    for k, x in enumerate(nodes):
        b = with_.get(id(x))
        if x.tag != "#text":
            slot[id(x)] = wrapper.place[id(b)] if b is not None else slot[id(x.above)]
            continue
        inside = any(i <= k <= j for i, j in spans) and (not roots or id(x) in likely)
        marks = DROPPED * (id(x) in gone) | LIKELY * (id(x) in likely) | LINKED * (x.linked > len(x.text) / 2) | LISTED * (htmltext.listed(x) and not x.above.rooted) | OWN * inside
        out.append((x.text, slot[id(x.above)], wrapper.place[id(b)] if b is not None and b.text == x.text else -1, marks))
    return out


def induced(wrapper: Wrapper, counts: list[tuple[int, int, int, float]], pages: int) -> tuple[list[tuple[int, int]], bool, list[int]]:
    """(spans, likely, template) of a host.

    counts: (slot, same, pages, text) summed over its different pages. template: places of the wrapper's leaves that are constant;
    spans: where on the wrapper the article is; likely: whether only likely articles count there.
    """
    votes: dict[int, int] = {}
    for _, same, n, _ in counts:
        if same >= 0:
            votes[same] = votes.get(same, 0) + n
    template = {x for x, n in votes.items() if n >= CONSTANT * pages} if pages >= FEWEST else set()
    mass: dict[int, float] = {}
    for slot, same, _, text in counts:
        if same not in template and text:
            x = wrapper.nodes[slot]
            mass[id(x)] = mass.get(id(x), 0.0) + text
    spans, likely = htmltext.region(wrapper.nodes, mass)
    return spans, likely, sorted(template)


SCHEMA = "page_id long, url string, host string, mark long, leaves array<struct<text:string,slot:int,same:int,marks:int>>"
DECIDED = "host string, spans array<struct<low:int,high:int>>, likely boolean, template array<int>"


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    text: the article's blocks in page order, joined by two line feeds; character references are
    decoded, white space within a block is one space. Menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, comments of readers and what the host's template repeats are
    left out, nothing else is; an element with more than half of the page's text is never left out for
    its markup. A null or empty html, or one without text, gives an empty text. A null url is a host of
    its own name ''. Repeated rows stay, and vote once. Whole pages are read, nested as deep as they may be.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    first = pages.where("html is not null and html <> ''").groupBy("host").agg(F.min(F.struct("page_id", "html")).alias("w"))
    first = _spark.stored(first.select("host", F.col("w.html").alias("wrapper")), "wrappers")
    size = first.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    small = size <= broadcast_bytes
    sent = spark.sparkContext.broadcast({r.host: r.wrapper for r in first.collect()} if small else None)
    joined = pages if small else pages.join(first, "host", "left").select("page_id", "url", "html", "host", "wrapper")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known, of_host = Matcher(), {}, sent.value
        kind = pa.list_(pa.struct([("text", pa.string()), ("slot", pa.int32()), ("same", pa.int32()), ("marks", pa.int32())]))
        for batch in batches:
            marks, found = [], []
            hosts = batch.column("host").to_pylist()
            wrappers = [of_host.get(h) for h in hosts] if of_host is not None else batch.column("wrapper").to_pylist()
            for html, wrapper in zip(batch.column("html").to_pylist(), wrappers, strict=True):
                got: list[tuple[str, int, int, int]] = []
                if html:
                    made = known.get(wrapper)
                    if made is None or made.made_by is not matcher.forms:
                        if len(known) > 64:
                            known.clear()
                        made = known[wrapper] = Wrapper(wrapper, matcher)
                    got = read(html, made, matcher)
                digest = hashlib.blake2b("\n\n".join(x[0] for x in got if x[3] & OWN).encode("utf-8", "replace"), digest_size=8).digest()
                marks.append(int.from_bytes(digest, "little", signed=True))
                found.append([dict(zip(("text", "slot", "same", "marks"), x, strict=True)) for x in got])
                matcher.forget()
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(marks, pa.int64()), pa.array(found, kind)], names=["page_id", "url", "host", "mark", "leaves"])

    got = _spark.stored(_spark.arrow_map(joined, align, SCHEMA), "leaves")
    plain = lambda x: F.when(x.marks.bitwiseAND(DROPPED | LINKED) == 0, F.length(x.text) * F.when(x.marks.bitwiseAND(LIKELY) > 0, htmltext.ROOTED).otherwise(1.0)).otherwise(0.0)
    brief = F.transform("leaves", lambda x: F.struct(x.slot.alias("slot"), x.same.alias("same"), plain(x).alias("text")))
    votes = got.where(F.size("leaves") > 0).groupBy("host", "mark").agg(F.min(brief).alias("leaves"))
    each = votes.select("host", "mark", F.explode("leaves").alias("x")).select("host", "x.*")
    counts = each.groupBy("host", "slot", "same").agg(F.count("*").alias("n"), F.sum("text").alias("text"))
    summed = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "same", "n", "text")).alias("counts"))  # as many as the wrapper page has nodes
    number = got.where(F.size("leaves") > 0).groupBy("host").agg(F.count_distinct("mark").alias("pages"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                spans, likely, template = induced(Wrapper(row["wrapper"], Matcher()), [tuple(x.values()) for x in row["counts"]], row["pages"])
                rows.append((row["host"], [{"low": a, "high": b} for a, b in spans], likely, template))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), kind, pa.bool_(), pa.list_(pa.int32())), strict=True)], names=["host", "spans", "likely", "template"])

    decided = _spark.stored(_spark.arrow_map(summed.join(number, "host").join(first, "host").select("host", "wrapper", "counts", "pages"), decide, DECIDED), "decided")
    if _spark.plan_bytes(decided) <= broadcast_bytes:  # the written table's size
        decided = F.broadcast(decided)
    is_ = lambda x, mark: x.marks.bitwiseAND(mark) > 0
    there = lambda x: F.exists("spans", lambda s: (x.slot >= s.low) & (x.slot <= s.high)) & (~F.col("likely") | is_(x, LIKELY)) & ~is_(x, DROPPED | LISTED) & ~F.array_contains("template", x.same)
    ours = F.filter("leaves", there)
    alone = F.filter("leaves", lambda x: is_(x, OWN) & ~is_(x, DROPPED | LISTED) & ~F.array_contains("template", x.same))
    kept = F.when(F.exists(ours, lambda x: ~is_(x, LINKED)), ours).otherwise(alone)
    text = F.coalesce(F.array_join(F.transform(kept, lambda x: x.text), "\n\n"), F.lit(""))
    return got.join(decided, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
