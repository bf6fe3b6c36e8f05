"""Queries of rule tables, chunks, trees and job states, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import query, read

#: Lists of rules by language (list, pos, pattern, replacement, flags, enabled); German has none.
LISTS = [
    ("en", 0, "(th)(e)", "$2$1", "gi", True), ("en", 1, "[invalid", "x", "g", True), ("en", 2, "([a-z]+), ([a-z]+)", "$2; $1", "", True), ("en", 3, "off", "x", "g", False), ("en", 4, "[A-Z]", "_", "gy", True),
    ("fr", 0, "[éèê]", "e", "g", True), ("fr", 1, r"^(\S+) ", "<$1> ", "gm", True), ("fr", 2, "", "x", "g", True), ("es", 1, "o", "[$&]", "", True), ("es", 0, "(?<a>c)(?:ión)", "$<a>$$", "g", True),
]


def lists(spark):
    return spark.createDataFrame(LISTS, "lang string, pos int, pattern string, replacement string, flags string, enabled boolean")


@query(
    rf"""SELECT doc_id, lang, CASE lang
  WHEN 'en' THEN regexp_replace(regexp_replace(regexp_replace(text, '(?i)(th)(e)', '\2\1', 'g'), '([a-z]+), ([a-z]+)', '\2; \1'), '\A[A-Z]+', repeat('_', length(regexp_extract(regexp_replace(regexp_replace(text, '(?i)(th)(e)', '\2\1', 'g'), '([a-z]+), ([a-z]+)', '\2; \1'), '\A[A-Z]+'))))
  WHEN 'fr' THEN regexp_replace(regexp_replace(text, '[éèê]', 'e', 'g'), '(?m)^([^{T.WHITE}]+) ', '<\1> ', 'g')
  WHEN 'es' THEN regexp_replace(regexp_replace(text, '(c)(?:ión)', '\1$', 'g'), 'o', '[\0]')
  ELSE text END AS text_clean FROM documents"""
)
def clean_by_list(spark, sf_dir):
    """T1, F28, U1 with rules in a table: a list for each language, all lists in one pass."""
    from ..operators.rules import cleaned_by

    return cleaned_by(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), lists(spark), "lang").select("doc_id", "lang", "text_clean")


@query(
    "SELECT p_brand AS list, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, (p_size % 5) <> 0 AS valid, p_size % 7 <> 0 AND p_size % 5 <> 0 AS used FROM part"
)
def rule_validity(spark, sf_dir):
    """T1, R8, D6s: rules of every part, told apart by whether their pattern compiles; every fifth size opens a bracket that nothing closes."""
    from ..operators.rules import compiled

    part = read(spark, sf_dir, "part")
    pattern = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("["), "p_name")).otherwise(F.concat(F.lit(r"\b"), F.col("p_name"), F.lit("+?")))
    rules = part.select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("id"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("pos"), pattern.alias("pattern"), F.lit("").alias("replacement"), F.lit("gi").alias("flags"), (F.col("p_size") % 7 != 0).alias("enabled"))
    return compiled(rules).select("list", "id", "pos", "valid", (F.col("enabled") & F.col("valid")).alias("used"))


@query("SELECT id, row_number() OVER (ORDER BY k, id) - 1 AS pos FROM (SELECT p_partkey AS id, p_partkey - 1 AS k FROM part UNION ALL SELECT 1000000000 + s_suppkey, 2147483647 FROM supplier)")
def rule_append(spark, sf_dir):
    """The rules of all suppliers behind those of all parts."""
    from ..operators.rules import append

    old = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("pos"))
    return append(old, read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"))).select("id", "pos")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS n, CASE WHEN p_size % 3 = 1 THEN p_name END AS pattern FROM part")
def rule_store(spark, sf_dir):
    """Stored lists of rules; what isn't an array is an empty list."""
    from ..operators.rules import stored

    one = F.to_json(F.struct(F.col("p_name").alias("pattern"), F.lit("g").alias("flags")))
    text = F.when(F.col("p_size") % 3 == 0, one).when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.lit("no list"))
    found = stored(text)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.size(found).alias("n"), F.get(found, F.lit(0))["pattern"].alias("pattern"))


CHUNK = 700


def page_files(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.encode("html", "UTF-8").alias("content"))


@query(f"SELECT 'page-' || page_id AS name, 'ok' AS status, octet_length(encode(html)) AS n_bytes, md5(html) AS digest FROM pages WHERE page_id % 3 > 0 OR octet_length(encode(html)) <= {CHUNK} UNION ALL SELECT 'page-' || page_id, 'missing', NULL, NULL FROM pages WHERE page_id % 3 = 0 AND octet_length(encode(html)) > {CHUNK}")
def chunk_assembly(spark, sf_dir):
    """Every page's bytes in chunks that come twice and in any order, put together again; of every third page the second chunk never comes."""
    from ..sources.chunks import assembled, chunked

    parts = chunked(page_files(spark, sf_dir), CHUNK)
    lost = (F.substring_index("name", "-", -1).cast("long") % 3 == 0) & (F.col("pos") == 1)
    came = parts.where(~lost)
    return assembled(came.unionByName(came)).select("name", "status", F.octet_length("content").cast("long").alias("n_bytes"), "digest")


@query(
    f"SELECT 'page-' || page_id AS name, pos, least(n, (pos + 1) * {CHUNK}) AS loaded, n AS total, CAST(floor(100.0 * least(n, (pos + 1) * {CHUNK}) / n + 0.5) AS BIGINT) AS pct FROM (SELECT page_id, n, unnest(range(0, CAST(ceil(n / {CHUNK}.0) AS BIGINT))) AS pos FROM (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages))"
)
def chunk_progress(spark, sf_dir):
    """D1s: bytes loaded with each chunk of every page."""
    from ..sources.chunks import chunked, progress

    return progress(chunked(page_files(spark, sf_dir), CHUNK))


#: A tree for each user: event k hangs on event (k - 1) / 2, the later child before the earlier one.
_NODES = "SELECT user_id AS tree, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id, event_type AS tag, value FROM events"
_WALK = f"""WITH RECURSIVE node AS MATERIALIZED (SELECT tree, id, CASE WHEN id > 0 THEN (id - 1) // 2 END AS parent, -id AS pos, tag, value FROM ({_NODES})), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree, parent ORDER BY pos) AS place FROM node
), down AS (
  SELECT tree, id, 0 AS level, [place] AS path FROM placed WHERE parent IS NULL
  UNION ALL
  SELECT n.tree, n.id, level + 1, list_append(path, n.place) FROM down d JOIN placed n ON n.tree = d.tree AND n.parent = d.id
)
"""


def walk(spark, sf_dir):
    from ..operators.trees import walked

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nodes = read(spark, sf_dir, "events").select(F.col("user_id").alias("tree"), (F.row_number().over(w) - 1).cast("long").alias("id"), F.col("event_type").alias("tag"), "value")
    return walked(nodes.withColumn("parent", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).cast("long")).withColumn("pos", -F.col("id")))


@query(
    _WALK + "SELECT d.tree, d.id, d.level, CAST(row_number() OVER (PARTITION BY d.tree ORDER BY d.path) - 1 AS INTEGER) AS number, u.tag AS parent_tag FROM down d JOIN node n USING (tree, id) JOIN node u ON u.tree = d.tree AND u.id = n.parent WHERE n.tag = 'click' AND d.level > 0"
)
def tree_search(spark, sf_dir):
    """All nodes of a tag in document order, with their parent's tag, in trees of any depth."""
    from ..operators.trees import find_all, with_parent

    return find_all(with_parent(walk(spark, sf_dir), ["tag"]), F.col("tag") == "click").select("tree", "id", "level", "number", "parent_tag")


@query(_WALK + "SELECT a.tree, a.id, count(*) AS size, CAST(sum(CAST(round(n.value * 100) AS BIGINT)) AS BIGINT) AS total FROM down a JOIN down b ON b.tree = a.tree AND b.path[1:len(a.path)] = a.path JOIN node n ON n.tree = b.tree AND n.id = b.id GROUP BY a.tree, a.id")
def tree_sums(spark, sf_dir):
    """What hangs on each node of a tree, summed up to the root."""
    from ..operators.trees import rolled_up

    return rolled_up(walk(spark, sf_dir), F.round(F.col("value") * 100).cast("long"))


@query(
    """WITH e AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events
), ended AS (
  SELECT user_id, count(*) AS n, min(CASE WHEN event_type IN ('error', 'purchase') THEN seq END) AS e FROM e GROUP BY user_id
)
SELECT CAST(ended.user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status, coalesce(ended.e, n - 1) AS last_seq,
  CASE WHEN event_type = 'error' THEN 'stopped at ' || seq END AS error, CASE WHEN event_type = 'purchase' THEN 'bought at ' || seq END AS result, coalesce(ended.e + 1, n) AS n_events, n - coalesce(ended.e + 1, n) AS n_ignored
FROM ended JOIN e ON e.user_id = ended.user_id AND e.seq = coalesce(ended.e, n - 1)"""
)
def job_states(spark, sf_dir):
    """D3s, J13, D4s: the state of each job, users being the jobs; an error or a purchase ends one, and what follows is ignored."""
    from ..streaming.jobs import job_states

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq, kind = (F.row_number().over(w) - 1).cast("long"), F.col("event_type")
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), seq.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "error", "error").when(kind == "purchase", "result").otherwise("progress").alias("type"))
    e = e.select("*", F.col("seq").alias("current"), F.lit(None).cast("long").alias("total"), F.concat(F.lit("bought at "), F.col("seq").cast("string")).alias("text"), F.concat(F.lit("stopped at "), F.col("seq").cast("string")).alias("error"))
    return job_states(e, keep_s=10**8, silent_s=10**8).select("job_id", "status", "last_seq", "error", "result", "n_events", "n_ignored")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type = 'error' AS failed FROM events")
def parse_or_error(spark, sf_dir):
    """D6s, M10: JSON parsed, or an error for the row; the texts of errors are cut short, so that they aren't JSON."""
    from ..operators.errors import parsed

    text = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    got = parsed(read(spark, sf_dir, "events").withColumn("t", text), "t", "struct<k:bigint>", "found")
    whole = F.get_json_object("props", "$.k")
    return got.select("event_id", F.when(F.col("error").isNull(), F.col("found.k").cast("string")).otherwise(whole).alias("k"), F.col("error").isNotNull().alias("failed"))


@query("SELECT CAST(conv_id % 50 AS VARCHAR) AS job_id, string_agg(coalesce(text, ''), chr(10) ORDER BY conv_id, turn) AS text, CAST(count(*) AS INTEGER) AS n_lines FROM conversations GROUP BY conv_id % 50")
def job_texts(spark, sf_dir):
    """The texts of jobs, pages and lines in order; conversations are pages, turns are lines."""
    from ..sources.sinks import texts

    c = read(spark, sf_dir, "conversations")
    return texts(c.select((F.col("conv_id") % 50).cast("string").alias("job_id"), F.col("conv_id").alias("page_id"), F.col("turn").alias("line_pos"), "text"))


@query(
    """WITH page AS (SELECT l_orderkey // 8 AS page_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem WHERE l_linenumber > 1), ids AS (SELECT DISTINCT l_orderkey // 8 AS page_id FROM lineitem)
SELECT ids.page_id, 1000 AS width, (SELECT count(*) FROM page p WHERE p.page_id = ids.page_id AND l_partkey % 2 = 0) AS n_lines, (SELECT count(*) FROM page p WHERE p.page_id = ids.page_id AND l_partkey % 2 = 1) AS n_detections,
  coalesce((SELECT string_agg('s' || l_suppkey, ' ' ORDER BY l_orderkey * 10 + l_linenumber, l_partkey % 1000, l_suppkey % 1400, CAST(l_quantity AS INTEGER)) FROM page p WHERE p.page_id = ids.page_id AND l_partkey % 2 = 0), '') AS text
FROM ids"""
)
def structured_pages(spark, sf_dir):
    """K8: pages with their lines in order and their detections, pages without any too; rows of orders stand for both."""
    from ..sources.sinks import structured

    line = read(spark, sf_dir, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / 8).cast("long"))
    rows = line.where("l_linenumber > 1")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x, y, w = F.col("l_partkey") % 1000, F.col("l_suppkey") % 1400, F.col("l_quantity").cast("int")
    lines = rows.where("l_partkey % 2 = 0").select("page_id", pos.alias("line_pos"), x.alias("x"), y.alias("y"), w.alias("w"), F.lit(20).alias("h"), F.col("l_discount").alias("conf"), F.concat(F.lit("s"), "l_suppkey").alias("text"))
    found = rows.where("l_partkey % 2 = 1").select("page_id", pos.alias("det_idx"), (F.col("l_partkey") % 17).alias("class_idx"), F.col("l_discount").alias("conf"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + 20).alias("y2"))
    got = structured(line.select("page_id", F.lit(1000).alias("width")).distinct(), lines, found)
    return got.select("page_id", "width", F.size("lines").cast("long").alias("n_lines"), F.size("detections").cast("long").alias("n_detections"), F.array_join(F.transform("lines", lambda v: v["text"]), " ").alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN length(text) || ' characters copied' ELSE 'no text found' END AS notice FROM documents")
def notices(spark, sf_dir):
    """K7: the notice for each text, with notices on."""
    from ..sources.stores import notified

    on = spark.createDataFrame([(True,)], "show_result_alert boolean")
    return notified(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), on).select("doc_id", "notice")


#: A catalogue (lang, key, template) of two languages; the phases of other events have no phrase.
PHRASES = [("en", "click", "Reading lines"), ("en", "view", "Finding text"), ("fr", "click", "Lecture"), ("fr", "signup", "Modèle prêt")]


@query(
    f"""SELECT event_id, coalesce(t, event_type) || CASE WHEN n > 0 THEN ' (' || user_id || '/' || n || ')' ELSE '' END AS message, CASE WHEN n > 0 THEN CAST(floor(100.0 * user_id / n + 0.5) AS BIGINT) END AS pct
FROM (SELECT *, event_id % 3 * 40 AS n, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'fr' END AS l FROM events) LEFT JOIN (VALUES {', '.join(str(p) for p in PHRASES)}) p(pl, k, t) ON pl = l AND k = event_type"""
)
def progress_texts(spark, sf_dir):
    """S13, D9s, T11: progress by language, with the catalogue's phrase or the phase's name."""
    from ..sources.stores import messages
    from ..streaming.jobs import localised

    e = read(spark, sf_dir, "events")
    lang = F.when(F.col("event_id") % 2 == 0, "en").otherwise("fr")
    events = e.select(F.col("event_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.lit("progress").alias("type"), F.col("event_type").alias("phase"), F.col("user_id").alias("current"), (F.col("event_id") % 3 * 40).alias("total"), lang.alias("lang"))
    return localised(events, messages(spark, PHRASES)).select(F.col("seq").alias("event_id"), "message", F.col("pct").cast("long").alias("pct"))


@query(
    "SELECT c_custkey AS job_id, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'own-' || c_custkey END, CASE c_mktsegment WHEN 'BUILDING' THEN 'b.onnx' WHEN 'MACHINERY' THEN 'm.onnx' ELSE 'detector.onnx' END) AS detector_url, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'b2.onnx' WHEN 'MACHINERY' THEN 'm2.onnx' ELSE 'recogniser.onnx' END AS recogniser_url FROM customer"
)
def preset_lookup(spark, sf_dir):
    """Each customer's preset by segment, the default one for unknown segments, and addresses that override it."""
    from ..sources.dims import presets
    from ..sources.stores import preset

    c = read(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("preset_id"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("own-"), F.col("c_custkey").cast("string"))).alias("own_detector_url"))
    return preset(presets(spark, [("BUILDING", "B", "b.onnx", "b2.onnx"), ("MACHINERY", "M", "m.onnx", "m2.onnx")]), wanted).select("job_id", "detector_url", "recogniser_url")


@query("SELECT p_brand AS list, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_name AS name, p_type AS pattern, p_size % 2 = 0 AS enabled FROM part")
def rule_export(spark, sf_dir):
    """Every brand's list exported as JSON and imported again."""
    from ..operators.rules import exported, from_json

    part = read(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    rules = part.select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("pos"), text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("c").alias("comment"), F.col("p_type").alias("pattern"), F.lit("g").alias("flags"), F.lit("").alias("replacement"), (F.col("p_size") % 2 == 0).alias("enabled"))
    back = exported(rules, "list").select("list", F.posexplode(from_json(F.col("json"))).alias("pos", "r"))
    return back.select("list", F.col("r.id").cast("long").alias("id"), "pos", "r.name", "r.pattern", "r.enabled")


@query("SELECT s_suppkey AS id, regexp_replace(regexp_replace(s_name, '0+', '0', 'g'), 'S', '[\\0]') AS shown FROM supplier")
def rule_dry_run(spark, sf_dir):
    """Rules tried on test inputs, here the suppliers' names."""
    from ..operators.rules import tried_on

    rules = spark.createDataFrame([(0, "0+", "0", "g", True), (1, "[", "x", "g", True), (2, "S", "[$&]", "", True), (3, "u", "x", "g", False)], "pos int, pattern string, replacement string, flags string, enabled boolean")
    return tried_on(rules, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))).select("id", F.col("text_clean").alias("shown"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([ぁ-んァ-ヶ一-龥])[" + T.WHITE + r"]+([ぁ-んァ-ヶ一-龥])', '\1\2', 'g'), '[,，]', '', 'g'), '\n{2,}', chr(10), 'g'), '\n', '', 'g') AS text_clean FROM documents")
def seed_rules(spark, sf_dir):
    """T4: the rules installed first, switched on."""
    from ..operators.rules import tried_on
    from ..sources.dims import seed_rules

    return tried_on(seed_rules(spark).withColumn("enabled", F.lit(True)), read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_clean")


@query("SELECT conv_id AS paste_id, min(turn) AS pos, min_by(text, turn) AS content, 'image/png' AS mime FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def pasted_pictures(spark, sf_dir):
    """The first item of each paste that is a picture; turns are items, and those of one role stand for pictures."""
    from ..sources.images import pasted

    mime = F.when(F.col("role") == "assistant", "image/png").otherwise("text/plain")
    items = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paste_id"), F.col("turn").alias("pos"), mime.alias("mime"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return pasted(items).select("paste_id", "pos", F.decode("content", "UTF-8").alias("content"), "mime")
