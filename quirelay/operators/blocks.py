"""Page assembly: text-block merging and the page's element table, and its XML form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed3_text, quoted_attribute
from ..sources.dims import CLASSES
from .containment import PRIORITY
from .detections import LINE_CLASSES


def merge_blocks(blocks: Column, reach: int = 50, own: str | None = None) -> Column:
    """An array of text blocks (det_idx, x1, y1, x2, y2, alive, members) after merging; built-in functions alone.

    ``members`` are (class_idx, det_idx) of lines and of merged blocks (class 0), or whatever the field ``own`` of a block holds. Children are
    taken in order; the first living parent within reach gets the child's members, or a marker for the child if it has none, and the
    child dies.
    """
    fields = ("det_idx", "x1", "y1", "x2", "y2") + ((own,) if own else ())

    def step(state: Column, k: Column) -> Column:
        c = F.get(state, k)

        def takes(j: Column) -> Column:
            p = F.get(state, j)
            dx = F.greatest(F.lit(0), p["x1"] - c["x1"], c["x2"] - p["x2"])
            dy = F.greatest(F.lit(0), p["y1"] - c["y1"], c["y2"] - p["y2"])
            return (j != k) & p["alive"] & (dx * dx + dy * dy <= reach * reach)

        marker = c[own] if own else F.struct(F.lit(0).cast("long").alias("class_idx"), c["det_idx"].alias("det_idx"))
        gift = F.when(F.size(c["members"]) > 0, c["members"]).otherwise(F.array(marker))
        none = F.slice(c["members"], 1, 0)

        def with_members(v: Column, alive: bool, members: Column) -> Column:
            return F.struct(*[v[n].alias(n) for n in fields], F.lit(alive).alias("alive"), members.alias("members"))

        def given(t: Column) -> Column:
            return F.transform(state, lambda v, j: F.when(j == t, with_members(v, True, F.concat(v["members"], gift))).when(t.isNotNull() & (j == k), with_members(v, False, none)).otherwise(v))

        # A list of one binds the parent's place, so it is looked for once for each child.
        parent = F.get(F.filter(F.sequence(F.lit(0), F.size(state) - 1), takes), F.lit(0))
        return F.get(F.transform(F.array(parent), given), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), blocks, step)


def page_boxes(det: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page: ``boxes``, all its detections in order, as (class_idx, det_idx, x, y, w, h, conf) and the columns ``carry``."""
    place = [F.col(c).cast("long").alias(n) for c, n in (("x1", "x"), ("y1", "y"), ("w", "w"), ("h", "h"))]
    box = F.struct(F.col("class_idx").cast("long").alias("class_idx"), F.col("det_idx").cast("long").alias("det_idx"), *place, F.col("conf").cast("double").alias("conf"), *carry)
    return det.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def _with_containers(pages: DataFrame, least: float) -> DataFrame:
    """``held``: the lines with enough score with their first container ``c`` (prio, det_idx), null outside of all; by class and detection order."""
    prio = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    of_class = lambda b, classes: b["class_idx"].isin(list(classes))
    containers = F.transform(F.filter("boxes", lambda b: of_class(b, PRIORITY)), lambda b: F.struct(prio[b["class_idx"].cast("int")].alias("prio"), b["det_idx"].alias("det_idx"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))

    def first(b: Column) -> Column:
        # Doubled, so that the centre is whole.
        x, y = 2 * b["x"] + b["w"], 2 * b["y"] + b["h"]
        inside = F.filter("containers", lambda c: x.between(2 * c["x"], 2 * (c["x"] + c["w"])) & y.between(2 * c["y"], 2 * (c["y"] + c["h"])))
        return F.array_min(F.transform(inside, lambda c: F.struct(c["prio"].alias("prio"), c["det_idx"].alias("det_idx"))))

    lines = F.filter("boxes", lambda b: of_class(b, LINE_CLASSES) & (b["conf"] >= least))
    return pages.withColumn("containers", containers).withColumn("held", F.transform(lines, lambda b: F.struct(b.alias("line"), first(b).alias("c"))))


def _merged(pages: DataFrame, side: int) -> DataFrame:
    """``blocks``: the page's text blocks after merging (see :func:`merge_blocks`); members that are markers alone count as none."""
    own = lambda b: F.transform(F.filter("held", lambda v: (v["c"]["prio"] == 1) & (v["c"]["det_idx"] == b["det_idx"])), lambda v: v["line"])
    place = lambda b: [v.cast("double").alias(n) for n, v in (("x1", b["x"]), ("y1", b["y"]), ("x2", b["x"] + b["w"]), ("y2", b["y"] + b["h"]))]
    tiny = lambda b: (b["w"] < side) & (b["h"] < side)
    blocks = F.transform(F.filter("boxes", lambda b: (b["class_idx"] == 0) & ~tiny(b)), lambda b: F.struct(b["det_idx"].alias("det_idx"), *place(b), b.alias("own"), F.lit(True).alias("alive"), own(b).alias("members")))
    listed = pages.withColumn("blocks", blocks)
    return listed.withColumn("blocks", F.when(F.size("blocks") > 0, merge_blocks(F.col("blocks"), own="own")).otherwise(F.col("blocks")))


def _lines_of(members: Column) -> Column:
    return F.when(F.exists(members, lambda m: m["class_idx"] != 0), members).otherwise(F.slice(members, 1, 0))


def merged_blocks(det: DataFrame, least: float = 0.1, side: int = 5) -> DataFrame:
    """One row for each text block of a page: det_idx, alive, members array<struct<class_idx, det_idx>>; markers alone count as none."""
    pages = _merged(_with_containers(page_boxes(det), least), side)
    rows = pages.select("page_id", F.explode("blocks").alias("b"))
    members = F.transform(_lines_of(F.col("b.members")), lambda m: F.struct(m["class_idx"].alias("class_idx"), m["det_idx"].alias("det_idx")))
    return rows.select("page_id", "b.det_idx", "b.alive", members.alias("members"))


def element_lists(det: DataFrame, least: float = 0.1, side: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page: ``elements``, the array of its elements in emission order. One scan and one shuffle by page.

    Sections: 0 tables, 1 advertisements, 2 text blocks, 3 independent lines, 4 other blocks. ``child`` is 0 for the
    element itself and counts its lines. A text block without members gets one line of its own place without
    a confidence. Advertisements are written again in section 4, as the page format has it.
    """
    names = F.create_map(*[F.lit(v) for i, (_, o) in enumerate(CLASSES) for v in (i, o)])
    label = lambda b: names[b["class_idx"].cast("int")]
    main = F.lit(CLASSES[1][1])

    def row(b: Column, section: int, pos: Column, child: Column, tag: str, kind: Column, conf: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"), pos.cast("int").alias("pos"), child.cast("int").alias("child"), F.lit(tag).alias("tag"), kind.alias("type"), *[b[n].alias(n) for n in "xywh"],
            (b["conf"] if conf is None else conf).alias("conf"), b["det_idx"].alias("det_idx"), *[b[n].alias(n) for n in carry],
        )

    def children(lines: Column, section: int, pos: Column, kind) -> Column:
        # Fields come in the order of sorting: class, detection.
        return F.transform(F.array_sort(lines), lambda b, k: row(b, section, pos, k + 1, "LINE", kind(b)))

    zero = F.lit(0)

    def container(section: int, class_idx: int) -> Column:
        def lines_in(h: Column) -> Column:
            return F.transform(F.filter("held", lambda v: (v["c"]["prio"] == PRIORITY[class_idx]) & (v["c"]["det_idx"] == h["det_idx"])), lambda v: v["line"])

        def whole(h: Column, p: Column) -> Column:
            return F.concat(F.array(row(h, section, p, zero, "BLOCK", label(h))), children(lines_in(h), section, p, label))

        return F.flatten(F.transform(F.filter("boxes", lambda b: b["class_idx"] == class_idx), whole))

    parts = [container(0, 15), container(1, 7)]

    def text_block(b: Column, p: Column) -> Column:
        own, lines = b["own"], _lines_of(b["members"])
        head = F.array(row(own, 2, p, zero, "TEXTBLOCK", F.lit(None).cast("string")))
        alone = F.array(row(own, 2, p, F.lit(1), "LINE", main, F.lit(None).cast("double")))
        # A merged block stands as a line of text.
        inner = children(lines, 2, p, lambda m: F.when(m["class_idx"] == 0, main).otherwise(label(m)))
        return F.concat(head, F.when(F.size(lines) > 0, inner).when((own["w"] >= side) & (own["h"] >= side), alone).otherwise(F.slice(alone, 1, 0)))

    parts.append(F.flatten(F.transform(F.filter("blocks", lambda b: b["alive"]), text_block)))
    free = F.array_sort(F.transform(F.filter("held", lambda v: v["c"].isNull()), lambda v: v["line"]))
    parts.append(F.transform(free, lambda b, p: row(b, 3, p, zero, "LINE", label(b))))
    others = [i for i, (n, _) in enumerate(CLASSES) if n.startswith("block_") and n != "block_table"]
    rest = F.array_sort(F.filter("boxes", lambda b: b["class_idx"].isin(others) & (b["conf"] >= least)))
    parts.append(F.transform(rest, lambda b, p: row(b, 4, p, zero, "BLOCK", label(b))))
    pages = _merged(_with_containers(page_boxes(det, carry), least), side)
    return pages.select("page_id", F.concat(*parts).alias("elements"))


def page_elements(det: DataFrame, least: float = 0.1, side: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The elements of every page (see :func:`element_lists`), a row each; ``carry`` names further columns of ``det`` that they keep."""
    return element_lists(det, least, side, carry).select("page_id", F.inline("elements"))


def element_xml(tag: Column, attrs: Column, children: Column, indent: int = 0) -> Column:
    """An element with two blanks of indent, always with an end tag; ``children`` are the texts of elements, one to a line."""
    pad = "  " * indent
    inner = F.when(F.size(children) > 0, F.concat(F.lit("\n"), F.array_join(children, "\n"), F.lit("\n" + pad))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{pad}<"), tag, attrs, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))


#: Attributes whose values are numbers: nothing in them is escaped.
NUMBERS = ("X", "Y", "WIDTH", "HEIGHT", "CONF", "ORDER")


def attributes(values: dict[str, Column]) -> Column:
    """`` NAME="value"`` for each value that isn't null, escaped, in the given order."""
    quoted = lambda k, v: F.concat(F.lit('"'), v, F.lit('"')) if k in NUMBERS else quoted_attribute(v)
    return F.concat(*[F.coalesce(F.concat(F.lit(f" {k}="), quoted(k, v.cast("string"))), F.lit("")) for k, v in values.items()])


def written(e: Callable[[str], Column], more: dict[str, Column]) -> tuple[Column, Column]:
    """(attributes, shape) of an element with the fields ``e``; ``more`` are attributes after the common ones. Only text blocks have a shape."""
    x, y, w, h = (e(c) for c in "xywh")
    common = {"TYPE": e("type"), "X": x, "Y": y, "WIDTH": w, "HEIGHT": h, "CONF": fixed3_text(e("conf")), **more}
    attrs = F.when(e("tag") == "TEXTBLOCK", attributes({"CONF": common["CONF"]})).otherwise(attributes(common))
    points = F.concat_ws(",", *[c.cast("string") for c in (x, y, x + w, y, x + w, y + h, x, y + h)])
    none = F.array().cast("array<string>")
    polygon = element_xml(F.lit("POLYGON"), F.concat(F.lit(' POINTS="'), points, F.lit('"')), none, 3)
    return attrs, F.when(e("tag") == "TEXTBLOCK", element_xml(F.lit("SHAPE"), F.lit(""), F.array(polygon), 2))


def assembled_xml(elements: DataFrame, width: int, height: int, more: dict[str, Column], order: Column, place: Column, shape_last: bool = False) -> DataFrame:
    """One XML text for each page.

    ``more`` are attributes after the common ones, ``order`` sorts the lines of an element and drops those where it is null,
    ``place`` sorts the elements of a page by their ``head`` and their ``lines`` and drops those where it is null. ``elements``
    should be partitioned by page, as :func:`page_elements` leaves them: then nothing is shuffled. A page is the largest group.
    """
    attrs, shape = written(F.col, more)
    none = F.array().cast("array<string>")
    rows = elements.select("page_id", "section", "pos", "child", "tag", attrs.alias("attrs"), shape.alias("shape"), order.alias("order"))
    nodes = rows.groupBy("page_id", "section", "pos").agg(
        F.max(F.when(F.col("child") == 0, F.struct("tag", "attrs", "shape", "order"))).alias("head"),
        F.array_sort(F.collect_list(F.when((F.col("child") > 0) & F.col("order").isNotNull(), F.struct("order", element_xml(F.lit("LINE"), F.col("attrs"), none, 2).alias("xml"))))).alias("lines"),
    )
    shapes, lines = F.when(F.col("head.shape").isNotNull(), F.array("head.shape")).otherwise(none), F.transform("lines", lambda v: v["xml"])
    part = element_xml(F.col("head.tag"), F.col("head.attrs"), F.concat(lines, shapes) if shape_last else F.concat(shapes, lines), 1)
    parts = nodes.withColumn("place", place).groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", part.alias("xml"))))).alias("parts"))
    return parts.select("page_id", element_xml(F.lit("PAGE"), F.lit(f' WIDTH="{width}" HEIGHT="{height}"'), F.transform("parts", lambda v: v["xml"])).alias("xml"))


def page_xml(elements: DataFrame, width: int, height: int) -> DataFrame:
    """One XML text for each page, elements as emitted."""
    return assembled_xml(elements, width, height, {}, F.col("child"), F.struct("section", "pos"))


def line_elements(lists: DataFrame) -> DataFrame:
    """All LINE elements of :func:`element_lists` in document order (the order of a search through the tree), with their number and ``parent``.

    The parent is the detection of the element a line stands in, null for a line of the page itself. All is told within the page's list.
    """
    heads = F.map_from_entries(F.transform(F.filter("elements", lambda e: e["child"] == 0), lambda e: F.struct(F.struct(e["section"], e["pos"]), e["det_idx"])))
    lines = F.filter("elements", lambda e: e["tag"] == "LINE")
    with_heads = lists.select("page_id", heads.alias("heads"), lines.alias("lines"))
    parent = lambda e: F.when(e["child"] > 0, F.element_at("heads", F.struct(e["section"], e["pos"])))
    numbered = F.transform("lines", lambda e, k: F.struct(k.cast("int").alias("line_no"), parent(e).alias("parent"), e.alias("e")))
    return with_heads.select("page_id", F.inline(numbered)).select("page_id", "line_no", "parent", "e.*")
