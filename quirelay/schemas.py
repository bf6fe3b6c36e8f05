"""Schemas of the engine's tables (DDL text)."""

from __future__ import annotations

RECT = "struct<x:double,y:double,width:double,height:double>"
IMAGES = "image_id string, path string, width int, height int, content binary"
SELECTIONS = f"job_id string, image_id string, rect {RECT}, dpr double"
RAW_DETECTIONS = "image_id string, det_idx int, label bigint, box array<float>, score float, char_count bigint"
DETECTIONS = "page_id bigint, det_idx int, class_idx int, class_name string, conf double, x1 int, y1 int, x2 int, y2 int, pred_char_cnt bigint"
ELEMENTS = "page_id bigint, node_id int, parent_id int, child_pos int, tag string, type string, x int, y int, w int, h int, conf double, ord int"
LINES = "page_id bigint, line_pos int, x int, y int, w int, h int, conf double, text string"
RULES = "pos int, id string, name string, comment string, pattern string, flags string, replacement string, enabled boolean"
RULE_JSON = "array<struct<id:string,name:string,comment:string,pattern:string,flags:string,replacement:string,enabled:boolean>>"
MESSAGES = "lang string, key string, template string"
JOB_EVENTS = "job_id string, seq bigint, ts timestamp, type string, payload string"
