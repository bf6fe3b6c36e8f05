"""Small dimension tables: element classes, seed rules, model presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Detector classes by index, with the labels written to the page tree.
CLASSES = [
    ("text_block", "本文ブロック"), ("line_main", "本文"), ("line_caption", "キャプション"), ("line_ad", "広告文字"), ("line_note", "割注"), ("line_note_tochu", "頭注"), ("block_fig", "図版"), ("block_ad", "広告"),
    ("block_pillar", "柱"), ("block_folio", "ノンブル"), ("block_rubi", "ルビ"), ("block_chart", "組織図"), ("block_eqn", "数式"), ("block_cfm", "化学式"), ("block_eng", "欧文"), ("block_table", "表組"), ("line_title", "タイトル本文"),
]
TEXT_BLOCK, LINE_NOTE, BLOCK_AD, BLOCK_TABLE = 0, 4, 7, 15

# The rules installed when there are none; all disabled.
SEED_RULES = [
    ("space between Japanese letters", r"([ぁ-んァ-ヶ一-龥])\s+([ぁ-んァ-ヶ一-龥])", "g", "$1$2"),
    ("commas", "[,，]", "g", ""),
    ("blank lines", r"\n{2,}", "g", "\n"),
    ("line breaks", r"\n", "g", ""),
]

# Input shapes of the detector and the recogniser, and the score below or at which a detection is dropped.
DETECTOR_SIDE, RECOGNISER_SHAPE, MIN_SCORE = 800, (768, 16), 0.25


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, o) for i, (n, o) in enumerate(CLASSES)], "class_idx int, class_name string, org_name string")


def charset(spark: SparkSession, path: str) -> DataFrame:
    """The recogniser's signs (idx from 1, sign) from a text file that holds them one after another; a sign is a code point."""
    whole = spark.read.text(path, wholetext=True)
    signs = F.regexp_extract_all(F.regexp_replace("value", r"[\r\n]+\z", ""), F.lit("(?s)."), F.lit(0))
    return whole.select(F.posexplode(signs).alias("pos", "sign")).select((F.col("pos") + 1).alias("idx"), "sign")


def seed_rules(spark: SparkSession) -> DataFrame:
    from ..schemas import RULES

    return spark.createDataFrame([(i, f"seed{i}", n, None, p, f, r, False) for i, (n, p, f, r) in enumerate(SEED_RULES)], RULES)


def presets(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    """Model presets (id, label, detector url, recogniser url); ``rows`` overlay or extend the default one."""
    base = {"default": ("default", "Detector and recogniser", "detector.onnx", "recogniser.onnx")}
    base |= {r[0]: tuple(r) for r in rows}
    return spark.createDataFrame(list(base.values()), "id string, label string, detector_url string, recogniser_url string")
