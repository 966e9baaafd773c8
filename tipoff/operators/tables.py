"""Tables inside whole pages: found by id, else by a data-stat of their cells, and read as rows of cells.

One scan over a page's tags keeps a stack of open tables. A table inside a cell is a table of its own; cells, rows, parts and tables that are
never closed end where the next one begins or the outer one ends. Comments, scripts and styles hold no tables. Of equal ids and of equal
data-stats the first table counts. Null and empty pages, and pages without such a table, have no rows.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)(table|thead|tbody|tfoot|tr|td|th)\b((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S | re.I)
_OTHER = re.compile(r"</?[a-zA-Z][^>]*>")
_PARTS = {"thead": "head", "tbody": "body", "tfoot": "foot"}


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""(?:^|\s){name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag, re.I)
    return None if m is None else markup.unescape(next(g for g in m.groups()[1:] if g is not None))


@dataclass
class Table:
    id: str | None
    part: str = ""
    rows: list[dict] = field(default_factory=list)
    row: dict | None = None
    cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            text = markup.unescape(_OTHER.sub("", "".join(self.cell)))
            self.row["cells"][-1]["text"] = " ".join(text.split())
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        self.row = None

    def begin(self, name: str, tag: str) -> None:
        if name in _PARTS:
            self.end_row()
            self.part = _PARTS[name]
        elif name == "tr":
            self.end_row()
            self.row = {"part": self.part, "kind": _attribute(tag, "class"), "cells": []}
            self.rows.append(self.row)
        else:
            self.end_cell()
            if self.row is None:
                self.begin("tr", "")
            self.row["cells"].append({"stat": _attribute(tag, "data-stat"), "text": ""})
            self.cell = []

    def end(self, name: str) -> None:
        if name in ("td", "th"):
            self.end_cell()
        else:
            self.end_row()
            if name in _PARTS:
                self.part = ""


def tables(page: str) -> list[Table]:
    """All tables of a page in the order in which they begin."""
    found: list[Table] = []
    open_: list[Table] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if open_ and open_[-1].cell is not None:
            open_[-1].cell.append(page[at : m.start()])
        at = m.end()
        if m.group(3) is None:
            continue
        closing, name, tag = m.group(2), m.group(3).lower(), m.group(4)
        if name == "table" and not closing:
            found.append(Table(_attribute(tag, "id")))
            open_.append(found[-1])
        elif name == "table":
            if open_:
                open_.pop().end_row()
        elif open_:
            open_[-1].end(name) if closing else open_[-1].begin(name, tag)
    if open_ and open_[-1].cell is not None:
        open_[-1].cell.append(page[at:])
    for t in open_:
        t.end_row()
    return found


def located(page: str | None, table_id: str | None, stat: str | None) -> list[dict]:
    every = tables(page or "")
    by_id = (t for t in every if table_id is not None and t.id == table_id)
    by_stat = (t for t in every if stat is not None and any(c["stat"] == stat for r in t.rows for c in r["cells"]))
    hit = next(by_id, None) or next(by_stat, None)
    return [] if hit is None else hit.rows


def table_rows(pages: DataFrame, table_id: Column, stat: str | None = None, key: str = "page_id", text: str = "html") -> DataFrame:
    """pages -> key, place (from 0), part (head, body, foot or empty), kind (the row's class), cells (stat, text) of the table of that id,
    else of the first that has a cell of that data-stat. A page is read in one piece, in its own task's batch."""
    kind = pages.schema[key].dataType.simpleString()
    asked = pages.select(key, F.col(text).alias("html"), table_id.cast("string").alias("asked"))
    cells = pa.list_(pa.struct([("stat", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                of, rows = [], []
                for k, (page, want) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for place, r in enumerate(located(page, want, stat)):
                        of.append(k)
                        rows.append((place, r["part"], r["kind"], r["cells"]))
                if rows:
                    place, parts, kinds, found = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(place, pa.int32()), pa.array(parts), pa.array(kinds, pa.string()), pa.array(found, cells)], [key, "place", "part", "kind", "cells"])

    return asked.mapInArrow(run, f"`{key}` {kind}, place int, part string, kind string, cells array<struct<stat:string,text:string>>")


def body_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of the table's body; of a table without one, all rows."""
    some = rows.groupBy(key).agg(F.max(F.col("part") == "body").alias("_body"))
    return rows.join(some, key).filter((F.col("part") == "body") | ~F.col("_body")).drop("_body")


def by_stat(cells: Column) -> Column:
    """Map of the cells by data-stat; the last of equal names."""
    named = F.filter(cells, lambda c: c["stat"].isNotNull())
    last = F.aggregate(named, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, c: F.map_concat(F.map_filter(m, lambda k, v: k != c["stat"]), F.create_map(c["stat"], c["text"])))
    return last
