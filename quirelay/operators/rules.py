"""Cleaning-rule tables: upsert by name, edits, JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jvm_form
from ..schemas import RULE_JSON
from ..ship import ship


def upsert(existing: DataFrame, imported: DataFrame, values: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """Imported values replace those of the same name; new names have no ``kept_pos`` and follow in import order.

    Of one name imported more than once the last values win.
    """
    last = imported.groupBy(name).agg(F.max_by(F.struct(*values), pos).alias("new"), F.min(pos).alias("new_pos"))
    both = existing.join(last, name, "full_outer")
    merged = [F.when(F.col("new").isNotNull(), F.col("new")[v]).otherwise(F.col(v)).alias(v) for v in values]
    return both.select(name, *merged, F.col(pos).alias("kept_pos"), "new_pos", F.col("new").isNotNull().alias("imported"))


def renumbered(rules: DataFrame, per_bin: int = 1024) -> DataFrame:
    """Positions 0, 1, ... in order, for lists of any length. ``rules`` is read twice.

    Rows are counted by bins of old positions and the counts are summed up in two levels; a task sorts the rows of
    one bin together. Rows of equal position are in one bin.
    """
    part = lambda c: F.coalesce(F.floor(F.col(c) / F.lit(per_bin)), F.lit(-(2**63)))
    counts = rules.groupBy(part("pos").alias("__bin")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__high", part("__bin"))
    highs = counts.groupBy("__high").agg(F.sum("__n").alias("__all"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    highs = highs.select("__high", before(Window.orderBy("__high"), "__all").alias("__before"))
    low = before(Window.partitionBy("__high").orderBy("__bin"), "__n")
    starts = counts.withColumn("__low", low).join(highs, "__high").select("__bin", (F.col("__before") + F.col("__low")).alias("__start"))
    row = F.row_number().over(Window.partitionBy("__bin").orderBy("pos", "id")) - 1
    numbered = rules.withColumn("__bin", part("pos")).withColumn("__row", row).join(starts, "__bin")
    return numbered.withColumn("pos", F.col("__start") + F.col("__row")).select(*rules.columns)


def new_rule(id: Column, name: Column) -> Column:
    """A rule as it is created: empty pattern and replacement, all matches, switched on."""
    return F.struct(id.alias("id"), name.alias("name"), F.lit("").alias("comment"), F.lit("").alias("pattern"), F.lit("g").alias("flags"), F.lit("").alias("replacement"), F.lit(True).alias("enabled"))


def delete(rules: DataFrame, ids: list) -> DataFrame:
    return renumbered(rules.where(~F.col("id").isin(ids)))


def append(rules: DataFrame, new: DataFrame) -> DataFrame:
    return renumbered(rules.unionByName(new.withColumn("pos", F.lit(2**31 - 1)), allowMissingColumns=True))


def move(rules: DataFrame, pos: int, by: int) -> DataFrame:
    """Swap the rule at ``pos`` with its neighbour; nothing happens at the ends."""
    p = F.col("pos")
    there = rules.agg(F.max("pos").alias("most"))
    inside = (F.lit(pos + by) >= 0) & (F.lit(pos + by) <= F.col("most"))
    # One row.
    return rules.crossJoin(F.broadcast(there)).withColumn("pos", F.when(inside & (p == pos), pos + by).when(inside & (p == pos + by), pos).otherwise(p)).drop("most")


def _listed() -> Column:
    """A list's rules in order, as an aggregate."""
    fields = ["id", "name", "comment", "pattern", "flags", "replacement", "enabled"]
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))), lambda x: x["r"])


def to_json(rules: DataFrame) -> DataFrame:
    """One row with the list in order, indented."""
    return rules.agg(F.to_json(_listed(), {"pretty": "true"}).alias("json"))


def exported(rules: DataFrame, list_col: str) -> DataFrame:
    """(list, json) for every list; the largest group is one list."""
    return rules.groupBy(list_col).agg(F.to_json(_listed(), {"pretty": "true"}).alias("json"))


def from_json(text: Column) -> Column:
    """The rules of an export; anything but an array raises."""
    return F.from_json(text, RULE_JSON, {"mode": "FAILFAST"})


def stored(text: Column) -> Column:
    """The rules of a stored list; what isn't an array (or isn't JSON) is an empty list."""
    found = F.from_json(text, RULE_JSON, {"mode": "PERMISSIVE"})
    return F.when(F.ltrim(text).startswith("["), F.coalesce(found, F.array().cast(RULE_JSON))).otherwise(F.array().cast(RULE_JSON))


def _translated():
    """A column function: the JVM's forms of the pattern by itself, of pattern and of replacement with the flags; null if there is none."""

    def one(p: str | None, r: str | None, f: str | None) -> tuple:
        try:
            plain, _ = jvm_form(p or "", "", "g")
            return plain, *jvm_form(p or "", r or "", f or "")
        except ValueError:
            return None, None, None

    @F.pandas_udf("struct<body:string,pattern:string,replacement:string>")
    def run(pattern: pd.Series, replacement: pd.Series, flags: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(pattern, replacement, flags)], columns=["body", "pattern", "replacement"])

    return run


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` with ``jvm_pattern``, ``jvm_replacement`` and ``valid``: whether the JVM compiles the pattern by itself."""
    ship(rules.sparkSession)
    compile_ = lambda p: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull()
    parts = rules.withColumn("__jvm", _translated()("pattern", "replacement", "flags"))
    # A missing translation is null, which no pattern is.
    ok = F.coalesce(F.col("__jvm.body").isNotNull() & compile_(F.coalesce("__jvm.body", F.lit("["))) & compile_(F.coalesce("__jvm.pattern", F.lit("["))), F.lit(False))
    return parts.select(*rules.columns, F.col("__jvm.pattern").alias("jvm_pattern"), F.col("__jvm.replacement").alias("jvm_replacement"), ok.alias("valid"))


def cleaned_by(texts: DataFrame, rules: DataFrame, list_col: str, text_col: str = "text", out: str = "text_clean") -> DataFrame:
    """``texts`` with the rules of each text's list folded over it, in the lists' order; all lists in one pass.

    ``rules`` has ``list_col``, pos, pattern, replacement, flags, enabled. Disabled and invalid rules and empty patterns are left
    out; a text without a list (or with a null one) stays as it is, a null text null. The largest group is one list.
    """
    wanted = compiled(enabled(rules)).where("valid")
    rule = F.struct("pos", F.col("jvm_pattern").alias("p"), F.col("jvm_replacement").alias("r"))
    lists = wanted.groupBy(F.col(list_col).alias("__list")).agg(F.array_sort(F.collect_list(rule)).alias("__rules"))
    joined = texts.join(lists, texts[list_col] == F.col("__list"), "left")
    none = F.slice(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("p"), F.lit("").alias("r"))), 1, 0)
    kind = "array<struct<pos:bigint,p:string,r:string>>"
    folded = F.aggregate(F.coalesce(F.col("__rules").cast(kind), none.cast(kind)), F.col(text_col), lambda t, r: F.regexp_replace(t, r["p"], r["r"]))
    return joined.withColumn(out, folded).drop("__list", "__rules")


def enabled(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("enabled") & (F.col("pattern") != ""))


def tried_on(rules: DataFrame, texts: DataFrame, text_col: str = "text", out: str = "text_clean") -> DataFrame:
    """``texts`` with one list of rules applied to every text."""
    one = texts.withColumn("__one", F.lit(0))
    return cleaned_by(one, rules.withColumn("__one", F.lit(0)), "__one", text_col, out).drop("__one")


def dry_run(rules: DataFrame, text: str) -> str:
    """The rules applied to one test input."""
    return tried_on(rules, rules.sparkSession.range(1).select(F.lit(text).alias("text"))).first()["text_clean"]
