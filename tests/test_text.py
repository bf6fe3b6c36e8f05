"""Cleaning rules, trims and decoding, on fixed vectors."""

import pytest
from pyspark.sql import functions as F
from quirelay.functions.text import Rule, argmax, clean, decode_ids, fixed3, percent, trim_lines, utf16_length

JP = r"([ぁ-んァ-ヶ一-龥])\s+([ぁ-んァ-ヶ一-龥])"
CASES = [
    ([Rule(",")], "1,234,567", "1234567"),
    ([Rule("[,，]"), Rule(r"\s+", " ")], "1,234，567  abc", "1234567 abc"),
    ([Rule(",", enabled=False)], "1,234", "1,234"),
    ([Rule("")], "hello", "hello"),
    ([Rule("[invalid", "x")], "hello", "hello"),
    ([Rule("abc", "X", "gi")], "ABC abc Abc", "X X X"),
    ([Rule(JP, "$1$2")], "売 上 高", "売上 高"),
    ([Rule(r"\n{2,}", "\n")], "a\n\n\nb\n\nc", "a\nb\nc"),
    ([Rule(",", "", "")], "a,b,c", "ab,c"),
    ([Rule("(b)(c)", "$2$1", "")], "abcabc", "acbabc"),
    ([Rule(r"\s+", "_")], "a　\n b", "a_b"),
    ([Rule("a", "$$")], "cab", "c$b"),
    ([Rule("a", "[$&]")], "cab", "c[a]b"),
    ([Rule("a", "[$&]", "")], "caba", "c[a]ba"),
    ([Rule("(a)", "$1\\n")], "a", "a\\n"),
    ([Rule(r"^\d+\s*", "", "gm")], "1 a\n22 b", "a\nb"),
    ([Rule("a", "x", "gy")], "aaba", "xxba"),
    ([Rule(r"[\s,]+", "-")], "a, 　b", "a-b"),
    ([Rule("(?<y>a)b", "$<y>")], "abab", "aa"),
    ([Rule("(?<y>a)b", "[$<z>$<y>]")], "ab", "[a]"),
    ([Rule("a", "$<y>")], "ab", "$<y>b"),
    ([Rule("a", "[$&$$]", "gy")], "aaba", "[a$][a$]ba"),
    ([Rule("(?<y>a)", "$<y>$<y>", "y")], "aab", "aaab"),
    ([Rule("[a", "x", "gy"), Rule("b", "c")], "ab", "ac"),
    ([Rule("A", "x", "giy"), Rule("\\u{61", "y")], "aba", "xba"),
    ([Rule("^b", "x", "gmy")], "b\nb", "x\nb"),
    ([Rule(r"[(]\((?:x)(?=y)(?<!z)", "$1")], "((xy", "$1y"),
    # The sample rules of the help text.
    ([Rule(r"\s+")], " a　b\n c ", "abc"),
    ([Rule("([ぁ-んァ-ヶ一-龥]) ([ぁ-んァ-ヶ一-龥])", "$1$2")], "漢 字 か a", "漢字 か a"),
    ([Rule("ー+", "ー")], "スーーパーーー", "スーパー"),
    ([Rule(r"^\d+\s*", "", "gm")], "12 a\n3\u3000b\nc 4", "a\nb\nc 4"),
]


@pytest.mark.parametrize("rules,given,wanted", CASES)
def test_rules(spark, rules, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(clean(spark, F.col("t"), rules)).first()[0] == wanted


def test_null_and_trims(spark):
    rows = spark.createDataFrame([(None,), ("  a \t\r\n b　\n\n",), ("",)], "t string").select(trim_lines(F.col("t")), clean(spark, F.col("t"), [Rule("a")])).collect()
    assert [r[0] for r in rows] == [None, "a\n b", ""] and rows[0][1] is None


def test_scalars(spark):
    row = spark.range(1).select(utf16_length(F.lit("𠮷x")), fixed3(F.lit(1.0005)), percent(F.lit(1), F.lit(3)), percent(F.lit(1), F.lit(0)))
    assert list(row.first()) == [3, 1.001, 33, None]
    chars = F.array(*[F.lit(c) for c in "あ𠮷b"])
    got = spark.range(1).select(decode_ids(F.array(*map(F.lit, [2, 1, 9, 3, 0, 1])), chars), decode_ids(F.array(*map(F.lit, [3])), chars), decode_ids(F.array(*map(F.lit, [0, 1])), chars)).first()
    assert list(got) == ["𠮷あb", "b", ""]
    nan = float("nan")
    best = [spark.range(1).select(argmax(F.array(*map(F.lit, v)))).first()[0] for v in ([0.1, 0.9, 0.2], [1.0, 1.0], [-3.0, -1.0], [nan, 1.0], [nan, nan])]
    assert best == [1, 0, 1, 1, 0]


def test_lists_of_rules_as_a_table(spark):
    """Every case above in one pass, each with a list of its own; texts without a list stay."""
    from quirelay.operators.rules import cleaned_by, compiled

    rows = [(str(k), pos, r.pattern, r.replacement, r.flags, r.enabled) for k, (rules, _, _) in enumerate(CASES) for pos, r in enumerate(rules)]
    rules = spark.createDataFrame(rows, "list string, pos int, pattern string, replacement string, flags string, enabled boolean")
    texts = spark.createDataFrame([(str(k), given, wanted) for k, (_, given, wanted) in enumerate(CASES)] + [("none", "a", "a"), (None, "a", "a"), ("0", None, None)], "list string, text string, wanted string")
    got = cleaned_by(texts, rules, "list")
    assert got.columns == ["list", "text", "wanted", "text_clean"]
    assert [(r["list"], r["text_clean"]) for r in got.collect() if r["text_clean"] != r["wanted"]] == []
    assert got.count() == len(CASES) + 3 and cleaned_by(texts, rules.limit(0), "list").where("text_clean is distinct from text").count() == 0
    bad = spark.createDataFrame([("[a", "g"), ("a)(b", ""), ("\\u{61", "g"), ("(", "y"), ("a", "g"), (None, "g")], "pattern string, flags string").withColumn("replacement", F.lit(""))
    assert [r["valid"] for r in compiled(bad).collect()] == [False, False, False, False, True, True]


def test_stored_lists(spark):
    from quirelay.operators.rules import stored

    given = ['[{"id":"1","pattern":"a","flags":"g","enabled":true}]', '{"id":"1"}', "no json", "", None, "[]", ' [{"id":"2"},{"id":"3"}]']
    assert [len(r[0]) for r in spark.createDataFrame([(g,) for g in given], "t string").select(stored(F.col("t"))).collect()] == [1, 0, 0, 0, 0, 0, 2]
