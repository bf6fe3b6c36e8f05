"""The whole way of a page: element tree, reading order over blocks and containers, recognised texts, XML and text.

Nothing here sees two pages together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .blocks import element_xml, written
from .cuts import xy_cuts
from .order import NOTE, sort_page

#: Elements whose values are Python objects at a time; at least one page.
ELEMENTS = 50_000


def _places(lists: list[pa.Array], smooth: bool, diagonal: float) -> tuple[np.ndarray, np.ndarray]:
    """(ord, line_pos) of each element of some pages, given in the order of emission; -1 for none."""
    counts = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
    flat = [c.flatten() for c in lists]
    ends = np.cumsum(counts)
    section, pos, x, y, w, h = (flat[k].to_numpy(zero_copy_only=False) for k in (0, 1, 4, 5, 6, 7))
    is_line, is_block = (pc.equal(flat[2], t).to_numpy(zero_copy_only=False) for t in ("LINE", "TEXTBLOCK"))
    head = np.ones(len(section), bool)
    head[1:] = (section[1:] != section[:-1]) | (pos[1:] != pos[:-1])
    head[(ends - counts)[counts > 0]] = True
    ord_, line_pos = np.full(len(section), -1, np.int64), np.full(len(section), -1, np.int64)
    page = np.repeat(np.arange(len(counts)), counts)
    ord_[is_line] = xy_cuts(np.stack([x, y, x + w, y + h], axis=1)[is_line], np.bincount(page[is_line], minlength=len(counts)))
    note = pc.fill_null(pc.equal(flat[3], NOTE), False).to_pylist()
    conf = [None if c is None or c != c else c for c in flat[8].to_pylist()]
    columns = [v.tolist() for v in (head, is_line, is_block, np.maximum(ord_, 0), x, y, w, h)]
    begin = 0
    for end in ends.tolist():
        nodes: list[dict] = []
        holder: dict = {}
        for k, first, line, block, order, a, b, c, d in zip(range(begin, end), *(v[begin:end] for v in columns)):
            if first and not line:
                holder = {"kind": "block" if block else "container", "children": [], "x": a, "y": b, "w": c, "h": d}
                if block:
                    nodes.append(holder)
                continue
            row = {"kind": "line", "i": k, "x": a, "y": b, "w": c, "h": d, "conf": conf[k], "type": NOTE if note[k] else "", "order": order}
            if first:
                nodes.append(row)
                continue
            if not holder["children"] and holder["kind"] == "container":  # without lines a container has no part in the order
                nodes.append(holder)
            holder["children"].append(row)
        for k, row in enumerate(sort_page(nodes, smooth, diagonal)):
            line_pos[row["i"]] = k
        begin = end
    return ord_, line_pos


def placed(lists: DataFrame, width: int, height: int, smooth: bool = True) -> DataFrame:
    """``lists`` (page_id, elements; see :func:`blocks.element_lists`) with ``places``, an (ord, line_pos) for each element.

    ``ord`` is the XY-cut rank of each LINE in document order; ``line_pos`` its place after sorting
    within blocks and on the page, null for lines that were duplicates. Other elements have neither. A page is one row of
    lists, so a batch of Python's holds many pages; nothing is shuffled or sorted.
    """
    ship(lists.sparkSession)
    diagonal = math.hypot(width, height) or 1.0

    @F.arrow_udf("array<struct<ord:int,line_pos:int>>")
    def run(section: pa.Array, pos: pa.Array, tag: pa.Array, kind: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array, conf: pa.Array) -> pa.Array:
        every = [section, pos, tag, kind, x, y, w, h, conf]
        counts = pc.list_value_length(section).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        found, k = [], 0
        while k < len(counts):
            size = max(1, int(np.searchsorted(ends[k:], (ends[k - 1] if k else 0) + ELEMENTS, "right")))
            found.append(_places([c.slice(k, size) for c in every], smooth, diagonal))
            k += size
        values = [np.concatenate([f[i] for f in found]).astype(np.int32) if found else np.zeros(0, np.int32) for i in (0, 1)]
        each = pa.StructArray.from_arrays([pa.array(v, pa.int32(), mask=v < 0) for v in values], ["ord", "line_pos"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each)

    # Told to be nondeterministic, so that filters on its result aren't moved below it with all that it is made from.
    return lists.select("page_id", "elements", run.asNondeterministic()(*[F.col("elements")[c] for c in ("section", "pos", "tag", "type", "x", "y", "w", "h", "conf")]).alias("places"))


def ordered_lists(lists: DataFrame, width: int, height: int, smooth: bool = True) -> DataFrame:
    """The elements of ``lists`` with ``ord`` and ``line_pos`` (see :func:`placed`), a row each."""
    each = placed(lists, width, height, smooth).select("page_id", F.inline(F.arrays_zip("elements", "places")))
    return each.select("page_id", "elements.*", "places.*")


def ordered(elements: DataFrame, width: int, height: int, smooth: bool = True) -> DataFrame:
    """:func:`ordered_lists` for ``elements`` of :func:`blocks.page_elements`; those that are partitioned by page already aren't shuffled."""
    return ordered_lists(_sorted_lists(elements), width, height, smooth).select(*elements.columns, "ord", "line_pos")


def with_strings(tree: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """``string`` of each LINE from (page_id, det_idx, string), or from the column the elements carry; lines without area have ''."""
    named = tree if strings is None else tree.join(strings.select("page_id", "det_idx", "string"), ["page_id", "det_idx"], "left")
    return named.withColumn("string", F.when(F.col("tag") == "LINE", _string(F.col)))


def _string(e: Callable[[str], Column]) -> Column:
    return F.when((e("w") <= 0) | (e("h") <= 0), F.lit("")).otherwise(e("string"))


def _sorted_lists(tree: DataFrame) -> DataFrame:
    """The rows of a page as one list ``elements``, in the order of emission."""
    first = ["section", "pos", "child"]
    row = F.struct(*first, *[c for c in tree.columns if c not in ("page_id", *first)])
    return tree.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("elements"))


def _named(pages: DataFrame) -> DataFrame:
    """``elements`` of :func:`placed` with their places and, of each LINE, the ``string`` that the elements carry."""
    fields = [f.name for f in pages.schema["elements"].dataType.elementType if f.name != "string"]

    def row(v: Column) -> Column:
        e, p = v["elements"], v["places"]
        return F.struct(*[e[c].alias(c) for c in fields], p["ord"].alias("ord"), p["line_pos"].alias("line_pos"), F.when(e["tag"] == "LINE", _string(lambda c: e[c])).alias("string"))

    return pages.select("page_id", F.transform(F.arrays_zip("elements", "places"), row).alias("elements"))


def _texts(lists: DataFrame) -> DataFrame:
    with_place = F.filter("elements", lambda e: e["line_pos"].isNotNull())
    lines = F.sort_array(F.transform(with_place, lambda e: F.struct(e["line_pos"].alias("line_pos"), F.coalesce(e["string"], F.lit("")).alias("s"))))
    return lists.select("page_id", lines.alias("l")).select("page_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text"), F.size("l").alias("n_lines"))


def page_texts(tree: DataFrame) -> DataFrame:
    """One row for each page with lines: text (lines in reading order) and number of lines."""
    return _texts(_sorted_lists(tree.where("line_pos is not null").select("page_id", "section", "pos", "child", "line_pos", "string")))


def placed_texts(pages: DataFrame) -> DataFrame:
    """:func:`page_texts` for pages of :func:`placed` whose elements carry a ``string``; no page is taken apart."""
    return _texts(_named(pages.where(F.exists("places", lambda p: p["line_pos"].isNotNull()))))


def sorted_xml(tree: DataFrame, width: int, height: int) -> DataFrame:
    """One XML text for each page: blocks and lines in reading order with ORDER and STRING, then containers as emitted."""
    return _xml(_sorted_lists(tree), width, height)


def placed_xml(pages: DataFrame, width: int, height: int) -> DataFrame:
    """:func:`sorted_xml` for pages of :func:`placed` whose elements carry a ``string``; no page is taken apart."""
    return _xml(_named(pages.where(F.size("places") > 0)), width, height)


def _xml(lists: DataFrame, width: int, height: int) -> DataFrame:
    """The XML of lists that have an element at least. The lines of an element follow it, up to the next element."""
    none = F.array().cast("array<string>")

    def row(e: Column) -> Column:
        line = e["tag"] == "LINE"
        attrs, shape = written(lambda c: e[c], {"ORDER": F.when(line, e["ord"]), "STRING": F.when(line, e["string"])})
        return F.struct(*[e[c].alias(c) for c in ("section", "pos", "child", "tag")], attrs.alias("attrs"), shape.alias("shape"), e["line_pos"].alias("order"))

    heads = F.filter(F.transform("rows", lambda e, i: F.when(e["child"] == 0, i)), lambda i: i.isNotNull())

    def node(i: Column, k: Column) -> Column:
        # By single places: a slice would copy the whole list for each element.
        last = F.coalesce(F.get("heads", k + 1), F.size("rows")) - 1
        inner = F.when(last > i, F.transform(F.sequence(i + 1, last), lambda j: F.get("rows", j))).otherwise(F.filter(F.array(F.get("rows", i)), lambda e: F.lit(False)))
        lines = F.transform(F.filter(inner, lambda e: e["order"].isNotNull()), lambda e: F.struct(e["order"].alias("order"), element_xml(F.lit("LINE"), e["attrs"], none, 2).alias("xml")))
        return F.struct(F.get("rows", i).alias("head"), F.sort_array(lines).alias("lines"))

    def part(n: Column) -> Column:
        head, lines = n["head"], n["lines"]
        tag, first, block = head["tag"], head["order"], head["tag"] == "BLOCK"
        begin = F.when(tag == "LINE", first).otherwise(F.coalesce(F.get(lines, F.lit(0))["order"], F.lit(-1)))
        # Single lines that were duplicates have no place; elements without lines come first, in the order of emission.
        place = F.when((tag != "LINE") | first.isNotNull(), F.struct(block.alias("last"), F.when(block, 0).otherwise(begin).alias("begin"), head["section"].alias("section"), head["pos"].alias("pos")))
        shapes = F.when(head["shape"].isNotNull(), F.array(head["shape"])).otherwise(none)
        return F.struct(place.alias("place"), head.alias("head"), F.concat(F.transform(lines, lambda v: v["xml"]), shapes).alias("inner"))

    nodes = lists.select("page_id", F.transform("elements", row).alias("rows")).select("page_id", "rows", heads.alias("heads")).select("page_id", F.transform("heads", node).alias("nodes"))
    # sort_array compares natively, array_sort by a lambda function.
    kept = F.sort_array(F.filter(F.transform("nodes", part), lambda p: p["place"].isNotNull()))
    parts = nodes.select("page_id", F.transform(kept, lambda p: element_xml(p["head"]["tag"], p["head"]["attrs"], p["inner"], 1)).alias("parts"))
    return parts.select("page_id", element_xml(F.lit("PAGE"), F.lit(f' WIDTH="{width}" HEIGHT="{height}"'), F.col("parts")).alias("xml"))
