"""Replies that hold files: what they write, delete and say, and the white space of what they write.

Both work inside a row, on the array of a text's lines.  Folds run over the marks among the lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.review import path_error
from treeloom.operators.spans import trim

# Marks of a reply's blocks, and the extensions of files that may hold fences of their own.
FILE, DELETE, TAIL, END = "--- File: ", "--- Delete File: ", " ---", "--- End File ---"
MARKDOWN = ".md .markdown .mdown .mkd".split()
#: Indented lines that vote on a file's indentation.
VOTES = 200

_EVENT = "struct<kind:string,target:string,error:string,first:int,last:int>"


def reply_lines(text: Column) -> Column:
    """Lines as a reader of lines gives them: no carriage return at their ends, no line behind a last line end."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.endswith(x, F.lit("\r")), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def _marks(lines: Column) -> Column:
    """Array of struct(i, kind, target): the lines that may be marks or fences, told by how they begin before anything else is looked at."""
    near = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), trim(x).alias("t"))), lambda m: F.startswith(m["t"], F.lit("--- ")) | F.startswith(m["t"], F.lit("```")))

    def mark(m: Column) -> Column:
        t, shut = m["t"], F.endswith(m["t"], F.lit(TAIL))
        kind = F.when(t == END, "end").when(F.startswith(t, F.lit(FILE)) & shut, "write").when(F.startswith(t, F.lit(DELETE)) & shut, "delete").when(F.startswith(t, F.lit("```")), "fence")
        inner = F.regexp_replace(F.regexp_replace(t, f"^({FILE}|{DELETE})", ""), f"{TAIL}$", "")
        return F.struct(m["i"].alias("i"), kind.alias("kind"), inner.alias("target"))

    return F.filter(F.transform(near, mark), lambda m: m["kind"].isNotNull())


def with_events(rows: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds ``events``, an array of struct(kind, target, error, first, last): what the lines from ``first`` to ``last`` (marks included) do.

    Kinds: ``write``, ``delete``, ``error`` (a path that may not be used: its mark is passed over), ``open`` (a block without an end, which reaches to
    the last line and writes nothing).  Inside a block only its end counts; in a Markdown file an end mark between fences is content.  Marks whose
    path is an example's (angle brackets, "(Extracted Block)") are text.
    """
    seen = rows.withColumn("_marks", _marks(F.col(lines)))
    checked = F.transform("_marks", lambda m: F.struct(
        m["i"].alias("i"), m["kind"].alias("kind"), m["target"].alias("target"), path_error(trim(m["target"])).alias("error"),
        (m["target"].rlike("[<>]") | F.contains(m["target"], F.lit("(Extracted Block)"))).alias("example"), F.lower(F.regexp_extract(m["target"], r"([.][^./]*)$", 1)).isin(MARKDOWN).alias("markdown"),
    ))
    none = F.lit(None).cast("string")
    state = lambda at, target, markdown, fence, done: F.struct(at.alias("at"), target.alias("target"), markdown.alias("markdown"), fence.alias("fence"), done.alias("done"))
    start = state(F.lit(-1), none, F.lit(False), F.lit(False), F.array().cast(f"array<{_EVENT}>"))
    event = lambda kind, target, error, first, last: F.struct(F.lit(kind).alias("kind"), target.alias("target"), error.alias("error"), first.alias("first"), last.alias("last"))

    def step(s: Column, m: Column) -> Column:
        out = lambda *added: state(F.lit(-1), none, F.lit(False), F.lit(False), F.array_append(s["done"], *added) if added else s["done"])
        toggled = state(s["at"], s["target"], s["markdown"], ~s["fence"], s["done"])
        inside = F.when((m["kind"] == "end") & ~(s["markdown"] & s["fence"]), out(event("write", s["target"], none, s["at"], m["i"]))).when((m["kind"] == "fence") & s["markdown"], toggled).otherwise(s)
        opened = state(m["i"], m["target"], m["markdown"], F.lit(False), s["done"])
        outside = (
            F.when(m["kind"].isin("end", "fence") | m["example"], s).when(m["error"].isNotNull(), out(event("error", m["target"], m["error"], m["i"], m["i"])))
            .when(m["kind"] == "delete", out(event("delete", m["target"], none, m["i"], m["i"]))).otherwise(opened)
        )
        return F.when(s["at"] >= 0, inside).otherwise(outside)

    last = F.size(lines) - 1
    end = lambda s: F.when(s["at"] < 0, s["done"]).otherwise(F.array_append(s["done"], event("open", s["target"], F.lit("no end"), s["at"], last)))
    return seen.withColumn("events", F.aggregate(checked, start, step, end)).drop("_marks")


def updates(rows: DataFrame, lines: str = "lines") -> DataFrame:
    """(…, nth, kind, target, content, error) of each event; contents are whole lines, each with a line end."""
    each = rows.select("*", F.posexplode("events").alias("nth", "_e"))
    body = F.slice(lines, F.col("_e.first") + 2, F.greatest(F.col("_e.last") - F.col("_e.first") - 1, F.lit(0)))
    content = F.when(F.col("_e.kind") == "write", F.array_join(F.transform(body, lambda x: F.concat(x, F.lit("\n"))), ""))
    keep = [c for c in rows.columns if c not in (lines, "events")]
    return each.select(*keep, F.col("nth").cast("long").alias("nth"), F.col("_e.kind").alias("kind"), F.col("_e.target").alias("target"), content.alias("content"), F.col("_e.error").alias("error"))


def text_outside(lines: str = "lines", events: str = "events") -> Column:
    """The lines before, between and behind the events, without fences, trimmed as a whole."""
    firsts = F.concat(F.transform(events, lambda e: e["first"]), F.array(F.size(lines)))
    lasts = F.concat(F.array(F.lit(-1)), F.transform(events, lambda e: e["last"]))
    gaps = F.flatten(F.zip_with(lasts, firsts, lambda a, b: F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0)))))
    return trim(F.array_join(F.filter(gaps, lambda x: ~F.startswith(trim(x), F.lit("```"))), "\n"))


def indentation(lines: Column) -> Column:
    """struct(tabs, width): how the first VOTES indented lines, blank ones among them, are indented; tabs win ties and empty votes, of widths the smaller."""
    votes = F.slice(F.filter(lines, lambda x: x.rlike(r"^[ \t]")), 1, VOTES)
    widths = F.transform(F.filter(votes, lambda x: F.startswith(x, F.lit(" "))), lambda x: F.length(F.regexp_extract(x, "^ +", 0)))
    ranked = F.transform(F.array_distinct(widths), lambda w: F.struct((-F.size(F.filter(widths, lambda x: x == w))).alias("n"), w.alias("width")))
    tabs = F.size(votes) - F.size(widths) >= F.size(widths)
    return F.struct(tabs.alias("tabs"), F.when(~tabs, F.array_min(ranked)["width"]).alias("width"))


def reindented(incoming: Column, existing: Column, mode: str) -> Column:
    """``incoming`` with the indentation of the file that it takes the place of.

    ``exact`` and missing or empty files: as it is.  ``smart``: leading tabs, or leading blanks by the incoming file's own unit, are its depth, and odd
    blanks stay behind it.  ``ignore``: all leading blanks and tabs by the unit, odd ones go.  Lines of blanks alone become empty.
    """
    if mode == "exact":
        return incoming
    if mode not in ("smart", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    lines = F.split(incoming, "\n")

    def fixed(source: Column, target: Column) -> Column:
        unit = F.when(source["tabs"], 1).otherwise(source["width"])

        def line(x: Column) -> Column:
            lead, rest = F.regexp_extract(x, r"^[ \t]*", 0), F.regexp_replace(x, r"^[ \t]+", "")
            tabs, blanks = F.length(F.regexp_extract(x, r"^\t*", 0)), F.length(F.regexp_extract(x, r"^ *", 0))
            if mode == "ignore":
                depth, odd = F.floor(F.length(lead) / unit), F.lit(0)
            else:
                depth, odd = F.when(tabs > 0, tabs).otherwise(F.floor(blanks / unit)), F.when(tabs > 0, 0).otherwise(blanks % unit)
            depth, odd = depth.cast("int"), odd.cast("int")
            made = F.when(target["tabs"], F.concat(F.repeat(F.lit("\t"), depth), F.repeat(F.lit(" "), odd))).otherwise(F.repeat(F.lit(" "), depth * target["width"] + odd))
            return F.when(rest == "", "").otherwise(F.concat(made, rest))

        return F.array_join(F.transform(lines, line), "\n")

    # The two styles are worked out once, not for each line.
    styles = F.array(F.struct(indentation(lines).alias("source"), indentation(F.split(existing, "\n")).alias("target")))
    return F.when(F.coalesce(existing, F.lit("")) == "", incoming).otherwise(F.transform(styles, lambda s: fixed(s["source"], s["target"]))[0])
