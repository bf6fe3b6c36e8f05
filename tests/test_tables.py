"""Rule and settings stores, streaming jobs, post-processing, SQL functions, and registered queries."""

import json

import pytest
from pyspark.sql import functions as F
from quirelay.functions import sql
from quirelay.functions.text import Rule
from quirelay.operators import blocks as B
from quirelay.operators import detections as D
from quirelay.operators import rules as U
from quirelay.schemas import RAW_DETECTIONS, RULES
from quirelay.sources import dims, stores
from quirelay.streaming import jobs


def test_rules_round_trip(spark, tmp_path):
    seeds = dims.seed_rules(spark)
    stores.save(seeds, f"{tmp_path}/rules")
    again = stores.rules(spark, f"{tmp_path}/rules")
    assert sorted(again.collect()) == sorted(seeds.collect()) and U.enabled(again).count() == 0
    text = U.to_json(again).first()[0]
    assert [r["pattern"] for r in json.loads(text)] == [r[1] for r in dims.SEED_RULES]
    back = spark.createDataFrame([(text,)], "t string").select(F.explode(U.from_json(F.col("t"))).alias("r")).select("r.*")
    assert back.count() == 4
    on = spark.createDataFrame([(0, "a", "x", None, "b", "g", "c", True), (1, "d", "y", None, "c", "", "d", True)], RULES)
    assert U.dry_run(on, "abbc") == "adcc"


def test_upsert_and_edits(spark):
    old = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], "name string, pos long, pattern string")
    new = spark.createDataFrame([("b", 0, "9"), ("c", 1, "3"), ("c", 2, "4")], "name string, pos long, pattern string")
    got = {r["name"]: (r["pattern"], r["kept_pos"], r["new_pos"], r["imported"]) for r in U.upsert(old, new, ["pattern"]).collect()}
    assert got == {"a": ("1", 0, None, False), "b": ("9", 1, 0, True), "c": ("4", None, 1, True)}
    rows = spark.createDataFrame([(i, i) for i in range(3)], "id long, pos long")
    order = lambda d: [r["id"] for r in d.orderBy("pos").collect()]
    assert order(U.move(rows, 0, 1)) == [1, 0, 2] and order(U.move(rows, 0, -1)) == [0, 1, 2] and order(U.delete(rows, [1])) == [0, 2]
    assert order(U.append(rows, spark.createDataFrame([(9,)], "id long"))) == [0, 1, 2, 9]


def test_edits_of_a_long_list(spark):
    """Every row is numbered, over bins and groups of bins, and no window over all rows stands in the plan."""
    n = 5000
    rows = spark.range(n).select("id", F.when(F.col("id") == 77, None).otherwise(F.col("id") * 3).alias("pos"))
    assert [tuple(r) for r in U.renumbered(rows, 7).orderBy("pos").collect()] == [(i, k) for k, i in enumerate([77, *range(77), *range(78, n)])]
    rows = spark.range(n).select("id", F.col("id").alias("pos"))
    edited = U.delete(U.move(rows, 4, 1), [10, 4999])
    wanted = [0, 1, 2, 3, 5, 4, *range(6, 10), *range(11, 4999)]
    assert [tuple(r) for r in edited.orderBy("pos").collect()] == [(i, k) for k, i in enumerate(wanted)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = edited._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "row_number" in plan and not [x for x in plan.split("\n") if "row_number" in x and "Window" in x and "__bin" not in x]


def test_settings_and_presets(spark, tmp_path):
    stores.save(spark.createDataFrame([(False,)], stores.SETTINGS), f"{tmp_path}/s")
    assert stores.settings(spark, f"{tmp_path}/s").first()[0] is False
    assert stores.settings(spark, f"{tmp_path}/s").limit(0).count() == 0
    wanted = spark.createDataFrame([("j1", "default", None), ("j2", "unknown", "own.onnx")], "job_id string, preset_id string, own_detector_url string")
    got = {r["job_id"]: r["detector_url"] for r in stores.preset(dims.presets(spark), wanted).collect()}
    assert got == {"j1": "detector.onnx", "j2": "own.onnx"}
    assert spark.range(1).select(stores.filled(F.lit("$2 of $1"), [F.lit(3), F.lit("x")])).first()[0] == "x of 3"


def test_stream(spark, tmp_path):
    events = [("a", 1, "progress", {"phase": "detect", "current": 1, "total": 4, "lang": "en"}), (None, 2, "progress", {"phase": "warm"}), ("b", 3, "error", {"error": "bad"}), ("a", 4, "result", {"text": "done"})]
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "e.json", "w") as f:
        for job, seq, kind, p in events:
            f.write(json.dumps({"job_id": job, "seq": seq, "ts": f"2024-01-01T00:0{seq}:00Z", "type": kind, "payload": json.dumps(p)}) + "\n")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    relayed = jobs.relayed(jobs.arriving(spark, f"{tmp_path}/in"))
    texts = jobs.localised(relayed, stores.messages(spark, [("en", "detect", "Finding text")]))
    got = jobs.run_once(texts, "texts").where("type = 'progress'").collect()
    assert [(r["message"], r["pct"]) for r in got] == [("Finding text (1/4)", 25)]
    state = {r["job_id"]: (r["ended"], r["last_type"], r["result"], r["error"]) for r in jobs.run_once(jobs.job_state(relayed), "state", "complete").collect()}
    assert state == {"a": (True, "result", "done", None), "b": (True, "error", None, "bad")}


def test_runner():
    r = jobs.Runner()
    with pytest.raises(jobs.NotConfigured):
        r.ensure(str)
    r.configure("x")
    assert r.ensure(str.upper) == "X" and r.ensure(str.upper) == "X" and r.loads == 1


def test_postprocess(spark):
    raw = spark.createDataFrame([("i", 0, 2, [10.0, 20.0, 30.0, 40.5], 0.9, None), ("i", 1, 40, [0.0] * 4, 0.5, 3), ("i", 2, 1, [0.0] * 4, 0.25, 1)], RAW_DETECTIONS)
    images = spark.createDataFrame([("i", 1000, 1600)], "image_id string, width int, height int")
    got = D.postprocess(raw, images, dims.classes(spark), 800).orderBy("det_idx").collect()
    assert [(r["class_name"], r["x1"], r["y2"], r["pred_char_cnt"]) for r in got] == [("line_main", 20, 81, 0), ("class_39", 0, 0, 3)]


def test_elements(spark):
    rows = [(1, 0, 0, 0.9, 100, 100, 400, 300), (1, 1, 1, 0.9, 120, 120, 300, 20), (1, 2, 1, 0.05, 120, 150, 300, 20), (1, 3, 15, 0.9, 600, 600, 200, 200), (1, 4, 1, 0.9, 610, 650, 100, 20), (1, 5, 0, 0.9, 0, 0, 2, 2), (1, 6, 16, 0.9, 900, 10, 50, 20), (1, 7, 7, 0.9, 0, 900, 80, 80), (1, 8, 0, 0.8, 300, 800, 60, 60)]
    det = spark.createDataFrame(rows, "page_id long, det_idx long, class_idx long, conf double, x1 long, y1 long, w long, h long")
    got = [(r["section"], r["pos"], r["child"], r["tag"], r["type"], r["det_idx"]) for r in B.page_elements(det).orderBy("section", "pos", "child").collect()]
    assert got == [
        (0, 0, 0, "BLOCK", "表組", 3), (0, 0, 1, "LINE", "本文", 4), (1, 0, 0, "BLOCK", "広告", 7), (2, 0, 0, "TEXTBLOCK", None, 0), (2, 0, 1, "LINE", "本文", 1),
        (2, 1, 0, "TEXTBLOCK", None, 8), (2, 1, 1, "LINE", "本文", 8), (3, 0, 0, "LINE", "タイトル本文", 6), (4, 0, 0, "BLOCK", "広告", 7),
    ]
    xml = B.page_xml(B.page_elements(det), 1000, 1400).first()["xml"]
    assert xml.startswith("<PAGE") and xml.count("<LINE") == 4 and 'POINTS="100,100,500,100,500,400,100,400"' in xml


def test_sql_functions(spark):
    from quirelay.functions.text import clean
    from quirelay.ship import ship

    ship(spark)
    rows = ["cat", "売 上\u3000高", "the theme 'x' \\ $", "aab", None, ""]
    frame = spark.createDataFrame([(r,) for r in rows], "text string")
    for rules in (
        [Rule("a", "b")], [Rule("the", "[$&]"), Rule("(a)(b)", "$2$$")], [Rule(r"\s+", "_", "g")], [Rule("the", "'\\\\'", "")], [Rule("[", "x"), Rule("T", "q", "gi")], [Rule("a", "", "gy")], [Rule("x", "y", "g", False)], [],
    ):
        sql.register(spark, rules)
        frame.createOrReplaceTempView("cleaned")
        want = [r[0] for r in frame.select(clean(spark, F.col("text"), rules)).collect()]
        assert [r[0] for r in spark.sql("select clean_text(text) from cleaned").collect()] == want, rules
    spark.createDataFrame([(1, 0, 10, 100, 200, 130), (1, 1, 10, 10, 200, 40)], "page_id long, det_idx long, x0 long, y0 long, x1 long, y1 long").createOrReplaceTempView("boxes")
    got = spark.sql("select det_idx, ord from xy_cut(TABLE(boxes) PARTITION BY page_id) order by det_idx").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0)]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 55


def test_page_chain(spark):
    """Two lines in a text block, a table with a line, a free line and a duplicate of it: order, text and XML of the page."""
    from quirelay.operators import blocks as B
    from quirelay.operators import page as P

    rows = [
        (1, 0, 0, 0.9, 100, 100, 400, 300), (1, 1, 1, 0.9, 110, 200, 300, 30), (1, 2, 1, 0.8, 110, 120, 300, 30), (1, 3, 15, 0.9, 100, 600, 400, 200), (1, 4, 1, 0.7, 120, 650, 200, 30),
        (1, 5, 1, 0.6, 100, 20, 300, 30), (1, 6, 1, 0.5, 101, 21, 298, 29),
    ]
    det = spark.createDataFrame(rows, "page_id long, det_idx long, class_idx long, conf double, x1 long, y1 long, w long, h long")
    tree = P.ordered(B.page_elements(det), 1000, 1400)
    place = {r["det_idx"]: r["line_pos"] for r in tree.where("tag = 'LINE'").collect()}
    assert sorted(place) == [1, 2, 4, 5, 6] and place[6] is None
    assert sorted((k for k in place if place[k] is not None), key=place.get) == [5, 2, 1, 4]  # the line above, the block's from above, the table's last
    assert tree.where("tag = 'LINE' and ord is null").count() == 0
    strings = spark.createDataFrame([(1, k, f"text {k}") for k in (1, 2, 5, 6)], "page_id long, det_idx long, string string")
    named = P.with_strings(tree, strings)
    assert [tuple(r) for r in P.page_texts(named).collect()] == [(1, "text 5\ntext 2\ntext 1\n", 4)]
    xml = P.sorted_xml(named, 1000, 1400).first()["xml"]
    at = [xml.index(x) for x in ('STRING="text 5"', 'STRING="text 2"', 'STRING="text 1"', "<BLOCK")]
    assert at == sorted(at) and "text 6" not in xml and xml.count("ORDER=") == 4 and xml.count("<LINE") == 4


def test_rule_constructor_numbers_and_polygons(spark):
    from quirelay.functions import geometry as G
    from quirelay.functions import text as T
    from quirelay.operators.rules import new_rule

    r = spark.range(1).select(new_rule(F.lit("7"), F.lit("n")).alias("r")).first()["r"].asDict()
    assert r == {"id": "7", "name": "n", "comment": "", "pattern": "", "flags": "g", "replacement": "", "enabled": True}
    texts = [("12px", 12), (" -3.9", -3), ("\u3000+4", 4), ("px", None), ("", None), (None, None), ("9" * 30, None)]
    assert [x[0] for x in spark.createDataFrame(texts, "t string, want long").select(T.parse_int(F.col("t"))).collect()] == [w for _, w in texts]
    shape = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    points = [((5.0, 1.0), 1.0), ((5.0, 8.0), -(4.5**0.5)), ((-3.0, -4.0), -5.0), ((5.0, 5.0), 0.0)]
    got = [spark.range(1).select(G.polygon_distance(F.lit(x), F.lit(y), shape)).first()[0] for (x, y), _ in points]
    assert all(abs(g - w) < 1e-9 for g, (_, w) in zip(got, points))


def test_containers_over_cells_of_the_page(spark):
    """Boxes at and over the borders of cells, negative places, equal boxes; the same as every line with every container."""
    import random

    from quirelay.operators import containment as C

    rng = random.Random(3)
    rows = [(p, k, rng.choice([0, 7, 15, 1, 2, 4]), rng.choice([0.05, 0.5]), rng.randrange(-60, 60), rng.randrange(-60, 60), rng.choice([0, 1, 7, 40, 90]), rng.choice([0, 3, 30, -2])) for p in range(4) for k in range(60)]
    det = spark.createDataFrame(rows, "page_id long, det_idx long, class_idx long, conf double, x1 long, y1 long, w long, h long")
    want = []
    for p, k, c, conf, x, y, w, h in rows:
        if c not in (0, 7, 15) and conf >= 0.1:
            cx, cy = x + w / 2, y + h / 2
            found = [(C.PRIORITY[b[2]], b[1]) for b in rows if b[0] == p and b[2] in C.PRIORITY and b[4] <= cx <= b[4] + b[6] and b[5] <= cy <= b[5] + b[7]]
            if found:
                want.append((p, k, c, *min(found)))
    for cell in (1, 16, 512):
        assert sorted(map(tuple, C.first_container(det, 0.1, cell).collect())) == sorted(want)


def test_one_page_of_many_boxes(spark):
    """A hundred thousand boxes on one page: lines meet the containers of their cell alone."""
    from quirelay.operators import containment as C

    n = 100_000
    at = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("det_idx"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).cast("long").alias("class_idx"), F.lit(0.9).alias("conf"), (F.floor(F.col("id") / 5) % 100 * 500).alias("x1"), (F.floor(F.col("id") / 500) * 500).alias("y1"))
    det = at.withColumn("w", F.when(F.col("class_idx") == 0, 499).otherwise(20).cast("long")).withColumn("h", F.col("w"))
    got = C.first_container(det)
    assert got.count() == n * 4 // 5 and got.where("block_idx != floor(det_idx / 5) * 5").count() == 0
