"""HTML pages as nodes: one array per page in document order, so that what a node contains is a slice of it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<node:int,parent:int,last:int,depth:int,tag:string,css:string,attrs:map<string,string>,text:string>"
TEXT = "#text"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
_CELLS = {"td", "th", "caption", "table", "button"}
#: Start tags that end an element whose end tag is missing: which ones, and the elements beyond which they do not look.
ENDS = {tag: ({"p"}, _CELLS) for tag in _BLOCKS.split()} | {
    "li": ({"li"}, {"ul", "ol"} | _CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | _CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | _CELLS),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


class _Nodes(HTMLParser):
    """Numbers elements and texts as they begin. An end tag ends the nearest open element of its name and all within; one without such an element does not count."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def add(self, tag: str, attrs: list, text: str | None) -> int:
        names = {}
        for k, v in attrs:
            names.setdefault(k, v or "")
        n = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        self.nodes.append({"node": n, "parent": parent, "last": n, "depth": len(self.open), "tag": tag, "css": names.get("class", ""), "attrs": list(names.items()), "text": text})
        return n

    def shut(self, k: int) -> None:
        """Ends the k-th open element and those within."""
        for n in self.open[k:]:
            self.nodes[n]["last"] = len(self.nodes) - 1
        del self.open[k:]

    def nearest(self, tags: set, beyond: set) -> int | None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]]["tag"]
            if tag in tags:
                return k
            if tag in beyond:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            if (k := self.nearest(*ENDS[tag])) is not None:
                self.shut(k)
            if tag == "tr" and (k := self.nearest({"tr"}, {"table"})) is not None:
                self.shut(k)
        n = self.add(tag, attrs, None)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if (k := self.nearest({tag}, set())) is not None:
            self.shut(k)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.nodes[self.open[-1]]["tag"] in HIDDEN) and (text := " ".join(data.split())):
            self.add(TEXT, [], text)


def nodes_of(html: str | None) -> list[dict]:
    parser = _Nodes()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # a broken declaration: what stands before it is kept
        pass
    parser.shut(0)
    return parser.nodes


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, nodes) of every page: its elements and texts in document order (``NODE``).

    Node k of a page is the k-th of its array and contains the nodes up to its ``last``. Texts have the tag ``#text`` and white space collapsed; comments, scripts and
    styles are left out. Missing end tags of paragraphs, list items and table cells are supplied as browsers do. Null and empty pages have no nodes.
    """
    struct = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("css", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def columns(of_pages: list[list[dict]]) -> pa.ListArray:
        """The nodes of pages, put together column by column: Arrow takes far longer for dictionaries."""
        flat, attrs = [n for nodes in of_pages for n in nodes], [n["attrs"] for nodes in of_pages for n in nodes]
        starts = lambda lists: pa.array([0, *accumulate(map(len, lists))], pa.int32())
        maps = pa.MapArray.from_arrays(starts(attrs), pa.array([k for a in attrs for k, _ in a], pa.string()), pa.array([v for a in attrs for _, v in a], pa.string()))
        parts = [maps if f.name == "attrs" else pa.array([n[f.name] for n in flat], f.type) for f in struct]
        return pa.ListArray.from_arrays(starts(of_pages), pa.StructArray.from_arrays(parts, fields=list(struct)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):  # nodes take more room than their page
                part = b.slice(k, 64)
                nodes = columns([nodes_of(h) for h in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), nodes], ["page_id", "url", "nodes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, nodes array<{NODE}>")


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per node of every page: (page_id, url, node, parent, last, depth, tag, css, attrs, text). What contains what is a matter of positions: ``a.node < b.node and b.node <= a.last``."""
    return parsed(pages, html).select("page_id", "url", F.inline("nodes"))
