"""Text spans: a line that matches, the comments above it, and where its block, indented body or declaration ends.

Everything is worked out inside a row, on the array of a text's lines (0-based line numbers), so no line is ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import names as N

#: Comments, quoted strings (all may run over lines; the last may lack its end), then what counts: braces, semicolons, line ends.
TOKENS = r"""(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|#[^\n]*+|'(?:[^'\\]++|\\.)*+(?:\\?\z|')|"(?:[^"\\]++|\\.)*+(?:\\?\z|")|`(?:[^`\\]++|\\.)*+(?:\\?\z|`)|[{};\n]"""


#: All white space of Unicode.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(text, F.lit(_BLANKS))


def lines_of(column: str = "text") -> Column:
    return F.split(column, "\n")


def from_line(lines: Column, start: Column, most: int | Column) -> Column:
    """At most ``most`` lines from line ``start`` on."""
    return F.slice(lines, start.cast("int") + 1, F.lit(most) if isinstance(most, int) else most)


def first_match(lines: Column, pattern: Column, near: bool) -> Column:
    """Number of the first line whose trimmed text contains, or starts with, the pattern; -1 if there is none."""
    test = F.transform(lines, lambda x: F.contains(trim(x), pattern) if near else F.startswith(trim(x), pattern))
    return F.array_position(test, True).cast("long") - 1


def _starts(text: Column, *signs: str) -> Column:
    return reduce(lambda found, sign: found | F.startswith(text, F.lit(sign)), signs[1:], F.startswith(text, F.lit(signs[0])))


# Tests of a trimmed line.
def _comment(t: Column) -> Column:
    return _starts(t, "//", "/*", "*", "#")


def _attachment(t: Column) -> Column:
    return _starts(t, "//", "/*", "*", "#", "@")


def _intro(t: Column) -> Column:
    return F.endswith(t, F.lit(":")) & _starts(t, "def ", "class ", "async def ")


def is_comment(line: Column) -> Column:
    return _comment(trim(line))


def is_attachment(line: Column) -> Column:
    """A comment, or an annotation."""
    return _attachment(trim(line))


def is_blank(line: Column) -> Column:
    return trim(line) == ""


def is_intro(line: Column) -> Column:
    """Opens a block that is told by its indentation."""
    return _intro(trim(line))


def indent(line: Column) -> Column:
    """Width of leading blanks, a tab being four."""
    lead = F.left(line, F.length(line) - F.length(F.ltrim(line, F.lit(" \t"))))
    return F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))


def extend(lines: Column, at: Column) -> Column:
    """An anchor on a comment or annotation moves up over those directly above it."""
    above = F.transform(F.slice(lines, 1, at.cast("int")), lambda x, i: F.when(~is_attachment(x), i))
    return F.when(is_attachment(F.get(lines, at.cast("int"))), F.coalesce(F.array_max(above), F.lit(-1)) + 1).otherwise(at).cast("long")


def structure(lines: Column) -> Column:
    """For each line, its braces, semicolons as struct(opens, closes, semis), outside comments and strings."""
    line = lambda o, c, s: F.struct(o.alias("opens"), c.alias("closes"), s.alias("semis"))
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<struct<opens:int,closes:int,semis:int>>").alias("done"), line(zero, zero, zero).alias("open"))

    def step(state: Column, token: Column) -> Column:
        now = state["open"]
        ends = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
        closed = F.concat(state["done"], F.array(now), F.array_repeat(line(zero, zero, zero), ends - 1))
        one = lambda sign: (token == sign).cast("int")
        more = line(now["opens"] + one("{"), now["closes"] + one("}"), now["semis"] + one(";"))
        return F.when(ends > 0, F.struct(closed.alias("done"), line(zero, zero, zero).alias("open"))).otherwise(F.struct(state["done"].alias("done"), more.alias("open")))

    tokens = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def with_brace_end(rows: DataFrame, name: str = "brace") -> DataFrame:
    """Adds where the braces that open from line ``start`` of ``lines`` on close, within BRACE_LINES lines; null where they don't."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        depth, opened = s["depth"] + x["opens"] - x["closes"], s["opened"] | (x["opens"] > 0)
        end = F.coalesce(s["end"], F.when(opened & (depth <= 0), s["at"]))
        return F.struct(depth.alias("depth"), opened.alias("opened"), end.alias("end"), (s["at"] + 1).alias("at"))

    marks = structure(from_line(F.col("lines"), F.col("start"), N.BRACE_LINES))
    return rows.withColumn(name, F.col("start") + F.aggregate(marks, state, step, lambda s: s["end"]))


def _lines(where: Column | None) -> Column:
    return F.col("lines") if where is None else F.when(where, F.col("lines"))


def with_indent_end(rows: DataFrame, name: str = "indent", where: Column | None = None) -> DataFrame:
    """Adds where the body of a ``def``, ``class`` or ``async def`` ends; it must be the first code line within INDENT_LINES lines.  Else, and not ``where``, null.

    Step by step in columns of their own, so that nothing is worked out again for each line.
    """
    head = F.transform(from_line(_lines(where), F.col("start"), N.INDENT_LINES), lambda x: ~is_blank(x) & ~is_attachment(x))
    found = rows.withColumn("_intro", F.col("start") + F.nullif(F.array_position(head, True), F.lit(0)) - 1)
    line = F.get("lines", F.col("_intro").cast("int"))
    found = found.withColumn("_base", F.when(is_intro(line), indent(line)))
    rest = F.when(F.col("_base").isNotNull(), F.slice("lines", F.col("_intro").cast("int") + 2, F.size("lines")))
    measured = F.transform(rest, lambda x: F.struct(trim(x).alias("t"), indent(x).alias("indent")))
    found = found.withColumn("_rest", F.transform(measured, lambda x: F.struct((x["t"] == "").alias("blank"), _comment(x["t"]).alias("comment"), x["indent"].alias("indent"))))
    # Lines of the body: up to the next that isn't blank and not deeper.
    stop = F.array_position(F.zip_with("_rest", F.array_repeat("_base", F.size("_rest")), lambda x, base: ~x["blank"] & (x["indent"] <= base)), True)
    found = found.withColumn("_stop", stop.cast("int"))
    found = found.withColumn("_body", F.when(F.col("_stop") > 0, F.slice("_rest", 1, F.col("_stop") - 1)).otherwise(F.col("_rest")))
    comment = F.array_max(F.transform("_body", lambda x, i: F.when(x["comment"], i + 1)))
    end = F.when(F.exists("_body", lambda x: ~x["blank"] & ~x["comment"]), F.size("_body")).otherwise(F.coalesce(comment, F.lit(0)))
    return found.withColumn(name, F.when(F.col("_base").isNotNull(), F.col("_intro") + end)).drop("_intro", "_base", "_rest", "_stop", "_body")


# Signs and words that tell a declaration.
_DECLARES = r"(?s)=>|->|[=(){}\[\]<>;]|^(const|let|var|func|type|interface|class|export|public|private|protected|static|package|import|return|if|for|switch|case|async|def) "


def with_declaration_end(rows: DataFrame, name: str = "declaration", where: Column | None = None) -> DataFrame:
    """Adds where the declaration at line ``start`` ends, within DECLARATION_LINES lines; null if it opens a brace or an indented block, is none, and not ``where``."""
    # Each line is trimmed and measured once; all tests read that.
    near = F.transform(from_line(_lines(where), F.col("start"), N.DECLARATION_LINES), lambda x: F.struct(x.alias("line"), trim(x).alias("t"), indent(x).alias("indent")))
    found = rows.withColumn("_near", near)
    # Comments and annotations between are passed over, quotes and braces in them too.
    marks = structure(F.transform("_near", lambda x: F.when(_attachment(x["t"]), "").otherwise(x["line"])))
    found = found.withColumn("_marks", marks).withColumn("_base", F.get("_near", F.lit(0))["indent"])
    found = found.withColumn("_next", F.slice("_near", 2, N.DECLARATION_LINES))
    facts = F.transform(F.arrays_zip("_near", "_marks", "_next"), lambda x, i: F.struct(
        (x["_near"]["t"] == "").alias("blank"), _attachment(x["_near"]["t"]).alias("comment"), _intro(x["_near"]["t"]).alias("intro"), x["_near"]["t"].rlike(_DECLARES).alias("declares"),
        F.right(x["_near"]["t"], F.lit(1)).isin(*",.+-*/=([{\\:").alias("goes_on"), (x["_near"]["indent"] > F.col("_base")).alias("deeper"), x["_marks"].alias("has"), i.alias("at"),
        F.coalesce((x["_next"]["t"] != "") & (x["_next"]["indent"] > F.col("_base")), F.lit(False)).alias("deeper_next"),
    ))
    state = F.struct(F.lit(False).alias("seen"), F.lit(-1).alias("end"), F.lit(False).alias("over"), F.lit(False).alias("failed"))

    def step(s: Column, x: Column) -> Column:
        after = lambda seen=s["seen"], end=s["end"], over=F.lit(False), failed=F.lit(False): F.struct(seen.alias("seen"), end.alias("end"), over.alias("over"), failed.alias("failed"))
        code = after(F.lit(True), x["at"], (x["has"]["semis"] > 0) | ~(x["goes_on"] | x["deeper_next"]))
        return (
            F.when(s["over"], s)
            .when(x["blank"], after(over=s["seen"]))
            .when(x["comment"], F.when(~s["seen"] | x["deeper"], after(end=x["at"])).otherwise(after(over=F.lit(True))))
            .when(x["intro"] | (~s["seen"] & ~x["declares"]), after(over=F.lit(True), failed=F.lit(True)))
            .when(~x["declares"] & ~x["goes_on"], after(over=F.lit(True)))
            .when(x["has"]["opens"] > 0, after(over=F.lit(True), failed=F.lit(True)))
            .otherwise(code)
        )

    end = F.aggregate(facts, state, step, lambda s: F.when(~s["failed"] & (s["end"] >= 0), s["end"]))
    return found.withColumn(name, F.col("start") + end).drop("_near", "_marks", "_base", "_next")


def is_useful(lines: Column, start: Column, end: Column) -> Column:
    """Whether a span holds a line that is neither blank nor a comment."""
    return F.exists(from_line(lines, start, (end - start + 1).cast("int")), lambda x: ~is_blank(x) & ~is_comment(x))


def small_file(lines: Column, size: Column) -> Column:
    return (F.size(lines) <= N.SMALL_LINES) & (size <= N.SMALL_BYTES)


def window(lines: Column, at: Column) -> tuple[Column, Column]:
    """First and last line around an anchor (0 where there is none)."""
    anchor = F.greatest(at, F.lit(0))
    return F.greatest(anchor - N.LINES_BEFORE, F.lit(0)).cast("long"), F.least(anchor + N.LINES_AFTER, F.size(lines) - 1).cast("long")


def joined(lines: Column, first: Column, last: Column, tail: str = "") -> Column:
    """The lines from ``first`` to ``last`` with line ends between, and ``tail`` behind."""
    return F.concat(F.array_join(from_line(lines, first, (last - first + 1).cast("int")), "\n"), F.lit(tail))


def cascade(rows: DataFrame) -> DataFrame:
    """Adds method, full_file, first_line, last_line and content: the first useful span of braces, body and declaration, else the lines around ``at`` or a small file.

    ``rows``: lines, size, at (-1 without an anchor) and start.  An end is looked for only where those before gave nothing.
    """
    useful = lambda end: F.coalesce(is_useful(F.col("lines"), F.col("start"), F.col(end)), F.lit(False)) & (F.col("at") >= 0)
    none = F.col("method").isNull()
    rows = with_brace_end(rows, "_brace")
    rows = rows.withColumn("method", F.when(useful("_brace"), "brace"))
    rows = with_indent_end(rows, "_indent", none)
    rows = rows.withColumn("method", F.when(none & useful("_indent"), "indent").otherwise(F.col("method")))
    rows = with_declaration_end(rows, "_declaration", none)
    rows = rows.withColumn("method", F.when(none & useful("_declaration"), "declaration").when(none, "window").otherwise(F.col("method")))
    whole, (low, high) = small_file(F.col("lines"), F.col("size")), window(F.col("lines"), F.col("at"))
    is_span = F.col("method") != "window"
    rows = rows.withColumn("full_file", ~is_span & whole)
    rows = rows.withColumn("first_line", F.when(is_span, F.col("start")).when(F.col("full_file"), F.lit(0)).otherwise(low).cast("long"))
    last = reduce(lambda found, m: found.when(F.col("method") == m, F.col(f"_{m}")), ("indent", "declaration"), F.when(F.col("method") == "brace", F.col("_brace")))
    rows = rows.withColumn("last_line", last.when(F.col("full_file"), F.size("lines") - 1).otherwise(high).cast("long"))
    content = F.when(F.col("full_file"), F.array_join("lines", "\n")).otherwise(joined(F.col("lines"), F.col("first_line"), F.col("last_line"), "\n"))
    return rows.withColumn("content", content).drop("_brace", "_indent", "_declaration")
