"""Text expressions with code-point offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that never belong to a value's core.
EDGE = ".,-/:;()[]_ \t\n"
MATCH = "array<struct<start:int,end:int,txt:string>>"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points; empty where end is not after start."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches with offsets; the pattern must never match the empty string.

    The text between matches and the matches themselves alternate, so offsets are their
    running lengths.
    """
    return located(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def located(text: Column, pattern: str, found: Column) -> Column:
    """Offsets of the matches that were found."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["m"])).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).cast("int").alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).cast("int").alias("end"), x["m"].alias("txt")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(MATCH))

    return let(found, walk)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def core(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))


def digit_count(text: Column) -> Column:
    return F.length(digits(text))


def has_core(text: Column) -> Column:
    return alnum_count(core(text)) >= 2


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), ACCENTED, PLAIN)


def normal_context(text: Column) -> Column:
    """Folded words joined by one space; 0, 1 and 5 read as o, l and s in words that are mostly letters."""
    words = F.filter(F.split(fold(text), r"(?U)\s+", -1), lambda w: w != "")
    letters = lambda w: F.length(F.regexp_replace(w, r"\P{L}", ""))
    fixed = F.transform(
        words, lambda w: F.when((letters(w) >= F.greatest(F.lit(2), F.floor(F.length(w) / 2))) & F.regexp_like(w, F.lit("[015]")), F.translate(w, "015", "ols")).otherwise(w)
    )
    return F.array_join(fixed, " ")


def distance_before_end(text: Column, key: str) -> Column:
    """Characters after the last occurrence of key; null if there is none."""
    at = F.position(F.lit(key[::-1]), F.reverse(text))
    return F.nullif(at, F.lit(0)) - 1


def line_start(text: Column, at: Column) -> Column:
    back = F.position(F.lit("\n"), F.reverse(F.substring(text, F.lit(1), at)))
    return F.when(back > 0, at - back + 1).otherwise(F.lit(0))


def line_end(text: Column, at: Column) -> Column:
    ahead = F.position(F.lit("\n"), F.substring(text, at + 1, F.length(text)))
    return F.when(ahead > 0, at + ahead - 1).otherwise(F.length(text))


def caps_line(line: Column) -> Column:
    """At least two words of two letters, six letters, and seven in ten letters capital."""
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    return (F.regexp_count(line, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{2,}")) >= 2) & (letters >= 6) & (capitals / F.greatest(F.lit(1), letters) >= 0.70)


def mask(text: Column) -> Column:
    """All stars up to four characters, else the first and last two stay."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))
