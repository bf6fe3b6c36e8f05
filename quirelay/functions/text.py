"""Text cleaning: user rules translated to the JVM's regular expressions, trims, decoding, formats.

Rules are written in the ECMAScript dialect. A rule list is compiled on the driver to one chain of
``regexp_replace`` (one projection, no Python at run time), or kept in a table and folded over the texts
(``operators.rules.cleaned_by``). A pattern that is invalid is left out, whatever its flags. A sticky rule with the flag g
ends at its first empty match.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what ``\\s`` and trimming mean in the rules' dialect, as a class body with and without the line feed.
WHITE_NO_LF = r" \t\r\x0B\f\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE = WHITE_NO_LF + r"\n"
#: The same signs themselves.
BLANKS = "\t\r\x0b\x0c \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str = ""
    flags: str = "g"
    enabled: bool = True
    name: str = ""


def translate_pattern(pattern: str) -> str:
    """``\\s`` and ``\\S`` become explicit classes, also inside brackets; a bare ``[`` inside brackets is escaped."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                # Printable ASCII is told off first: most signs are, and the ranges cost more.
                out.append(WHITE if inside else f"[[^!-~]&&[{WHITE}]]")
            elif n == "S":
                out.append(f"[^{WHITE}]")
            elif n == "u" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(r"\x{" + pattern[i + 3 : end] + "}")
                i = end - 1
            else:
                out.append(c + n)
            i += 2
            continue
        if inside and c in "[&":
            out.append("\\" + c)
        else:
            inside = (c == "[") or (inside and c != "]")
            out.append(c)
        i += 1
    return "".join(out)


def groups_of(pattern: str) -> tuple[int, list[str]]:
    """(number of capturing groups, their names) of a pattern."""
    count, names, inside, i = 0, [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            named = pattern[i + 1 : i + 3] == "?<" and pattern[i + 3 : i + 4] not in ("=", "!")
            if named:
                names.append(pattern[i + 3 :].split(">")[0])
            count += named or pattern[i + 1 : i + 2] != "?"
        i += 1
    return count, names


def translate_replacement(text: str, groups: int, shift: int = 0, names: Iterable[str] = ()) -> str:
    """``$1 $& $$ $<n>`` to the JVM's form; with ``shift`` two groups of our own come first.

    ``$<n>`` is plain text for a pattern without named groups and nothing for an unknown name.
    """
    out, i = [], 0
    while i < len(text):
        c, n = text[i], text[i + 1 : i + 2]
        if c == "\\":
            out.append("\\\\")
        elif c == "$" and n == "$":
            out.append("\\$")
            i += 1
        elif c == "$" and n == "&":
            out.append("$2" if shift else "$0")
            i += 1
        elif c == "$" and n.isdigit():
            two = text[i + 1 : i + 3]
            number = two if len(two) == 2 and two.isdigit() and 0 < int(two) <= groups else n
            if 0 < int(number) <= groups:
                out.append(f"${int(number) + 2 * shift}")
                follow = text[i + 1 + len(number) : i + 2 + len(number)]
                if follow.isdigit():
                    out.append("\\" + follow)
                    i += 1
            else:
                out.append("\\$" + number)
            i += len(number)
        elif c == "$" and n == "<" and names and ">" in text[i:]:
            end = text.index(">", i)
            out.append("${" + text[i + 2 : end] + "}" if text[i + 2 : end] in names else "")
            i = end
        elif c == "$":
            out.append("\\$")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def jvm_form(pattern: str, replacement: str, flags: str) -> tuple[str, str]:
    """(pattern, replacement) for ``regexp_replace``, which replaces all matches; the pattern need not be valid."""
    body = translate_pattern(pattern)
    inline = ("i" if "i" in flags else "") + ("dm" if "m" in flags else "") + ("s" if "s" in flags else "")
    flagged = f"(?{inline})" if inline else ""
    groups, names = groups_of(pattern)
    if "y" in flags:
        # Each match begins where the last one ended; without g the only one begins the text.
        return flagged + (r"\G" if "g" in flags else r"\A") + f"(?:{body})", translate_replacement(replacement, groups, 0, names)
    if "g" in flags:
        return flagged + body, translate_replacement(replacement, groups, 0, names)
    # The first match alone: everything before it is a group of its own, the match another.
    first = r"\A([\s\S]*?)(" + (f"(?{inline}:{body})" if inline else body) + ")"
    return first, "$1" + translate_replacement(replacement, groups, 1, names)


def replacing(spark: SparkSession, rule: Rule) -> tuple[str, str] | None:
    """(pattern, replacement) for ``regexp_replace``, or None for a pattern that is invalid by itself."""
    try:
        parts = jvm_form(rule.pattern, rule.replacement, rule.flags)
        compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
        compile_(translate_pattern(rule.pattern))
        compile_(parts[0])
        return parts
    except Exception as error:  # the JVM's PatternSyntaxException, or an open brace
        logging.getLogger(__name__).warning("rule left out: %s", (str(error).splitlines() or ["?"])[0])
        return None


def apply_rule(spark: SparkSession, text: Column, rule: Rule) -> Column:
    if not rule.enabled or not rule.pattern:
        return text
    parts = replacing(spark, rule)
    return text if parts is None else F.regexp_replace(text, F.lit(parts[0]), F.lit(parts[1]))


def clean(spark: SparkSession, text: Column, rules: Iterable[Rule]) -> Column:
    """The enabled rules one after another."""
    for rule in rules:
        text = apply_rule(spark, text, rule)
    return text


def trim_lines(text: Column) -> Column:
    """White space off the end of every line, then off both ends."""
    lines = F.transform(F.split(text, F.lit("\n"), -1), lambda line: F.rtrim(line, F.lit(BLANKS)))
    return F.btrim(F.array_join(lines, "\n"), F.lit(BLANKS + "\n"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def fixed3(x: Column) -> Column:
    """Three decimals, halves up, as a number."""
    return F.floor(x * 1000 + 0.5) / 1000


def fixed3_text(x: Column) -> Column:
    """Three decimals of the exact binary value as a text, halves up in magnitude; for magnitudes below 2^20."""
    size = F.abs(x.cast("double"))
    # The high part has 20 binary places, so its thousandfold is exact; the low part decides whether a half is reached.
    high = F.floor(size * 2**20) / 2**20
    shifted = high * 1000 + 0.5
    whole = F.floor(shifted)
    n = whole + F.when((size - high) * 1000 >= 1 - (shifted - whole), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def quoted_attribute(text: Column) -> Column:
    """An XML attribute's value in quotation marks: single ones if it holds double ones alone."""
    double, single = F.lit('"'), F.lit("'")
    plain = F.concat(double, text, double), ~F.rlike(text, F.lit('[&<>\n\r\t"]'))  # most values, for which the many replacements are left out
    for sign, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.when(plain[1], plain[0]).when(F.contains(text, double) & ~F.contains(text, single), F.concat(single, text, single)).otherwise(F.concat(double, F.replace(text, double, F.lit("&quot;")), double))


def parse_int(text: Column) -> Column:
    """The whole number that opens a text after white space; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"^[{WHITE}]*([+-]?[0-9]+)", 1), F.lit("")).try_cast("long")


def progress_text(phase: Column, current: Column, total: Column) -> Column:
    return F.format_string("%s (%d/%d)", phase, current, total)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5))


def decode_ids(ids: Column, charset: Column) -> Column:
    """Stop at the first 0; id i is the i-th sign of ``charset`` (an array); other ids are skipped."""
    zero = F.array_position(ids, 0).cast("int")
    upto = F.slice(ids, F.lit(1), F.when(zero > 0, zero - 1).otherwise(F.size(ids)))
    valid = F.filter(upto, lambda i: (i > 0) & (i <= F.size(charset)))
    return F.array_join(F.transform(valid, lambda i: F.element_at(charset, i.cast("int"))), "")


def argmax(values: Column) -> Column:
    """0-based place of the first largest number; NaN never wins; 0 if there is none."""
    best = F.array_max(F.filter(values, lambda v: ~F.isnan(v)))
    return F.coalesce(F.array_position(values, best) - 1, F.lit(0).cast("long"))
