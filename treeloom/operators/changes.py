"""Records of changes and members of workspaces, read by folds over their fields and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.operators.spans import trim

_CHANGE = "struct<kind:string,path:string,previous:string>"
_COUNT = "struct<path:string,binary:boolean,added:bigint,removed:bigint>"


def name_status(text: Column) -> Column:
    """struct(error, changes) of status records whose fields end in a zero: a status and a path, for renames the path before and the new one.

    Letters other than A, D and R mean modified.  An empty status ends the records; one whose path is missing makes them ``incomplete``, and none count.
    """
    start = F.struct(F.lit("status").alias("next"), F.lit("").alias("kind"), F.lit("").alias("previous"), F.array().cast(f"array<{_CHANGE}>").alias("done"))
    state = lambda at, kind, previous, done: F.struct(F.lit(at).alias("next"), kind.alias("kind"), previous.alias("previous"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        letter = F.left(x, F.lit(1))
        kind = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
        begun = F.when(x == "", state("end", s["kind"], s["previous"], s["done"])).when(letter == "R", state("old", kind, F.lit(""), s["done"])).otherwise(state("path", kind, F.lit(""), s["done"]))
        made = F.array_append(s["done"], F.struct(s["kind"].alias("kind"), x.alias("path"), s["previous"].alias("previous")))
        return F.when(s["next"] == "end", s).when(s["next"] == "status", begun).when(s["next"] == "old", state("path", s["kind"], x, s["done"])).otherwise(state("status", s["kind"], F.lit(""), made))

    whole = lambda s: s["next"].isin("status", "end")
    return F.aggregate(F.split(text, "\x00"), start, step, lambda s: F.struct(F.when(~whole(s), "incomplete").alias("error"), F.when(whole(s), s["done"]).otherwise(F.array().cast(f"array<{_CHANGE}>")).alias("changes")))


def numstat(text: Column) -> Column:
    """struct(error, counts) of count records whose fields end in a zero: added, removed and path with tabs between; an empty path means that the old and the new one follow.

    Two dashes tell a binary file, whose counts are null.  Fields without two tabs, and renames without both paths, make the records ``incomplete``.
    """
    start = F.struct(F.lit("record").alias("next"), F.lit("").alias("record"), F.array().cast(f"array<{_COUNT}>").alias("done"))
    state = lambda at, record, done: F.struct(F.lit(at).alias("next"), record.alias("record"), done.alias("done"))
    shape = r"(?s)\A([^\t]*)\t([^\t]*)\t(.*)\z"

    def count(record: Column, path: Column) -> Column:
        added, removed = F.regexp_extract(record, shape, 1), F.regexp_extract(record, shape, 2)
        number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("long"))
        return F.struct(path.alias("path"), ((added == "-") & (removed == "-")).alias("binary"), number(added).alias("added"), number(removed).alias("removed"))

    def step(s: Column, x: Column) -> Column:
        path = F.regexp_extract(x, shape, 3)
        record = F.when(x == "", state("end", x, s["done"])).when(~x.rlike(shape), state("bad", x, s["done"])).when(path == "", state("old", x, s["done"])).otherwise(state("record", x, F.array_append(s["done"], count(x, path))))
        return F.when(s["next"].isin("end", "bad"), s).when(s["next"] == "record", record).when(s["next"] == "old", state("new", s["record"], s["done"])).otherwise(state("record", x, F.array_append(s["done"], count(s["record"], x))))

    whole = lambda s: s["next"].isin("record", "end")
    return F.aggregate(F.split(text, "\x00"), start, step, lambda s: F.struct(F.when(~whole(s), "incomplete").alias("error"), F.when(whole(s), s["done"]).otherwise(F.array().cast(f"array<{_COUNT}>")).alias("counts")))


def workspace_members(text: Column) -> Column:
    """Array of the paths that a workspace file's ``use`` lines name, alone or in a block in brackets; ``//`` begins a comment, words behind a path and quotes around it are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: trim(F.regexp_replace(x, "(?s)//.*", ""))), lambda x: x != "")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        added = lambda inside, word: F.struct(inside.alias("inside"), F.when(word == "", s["found"]).otherwise(F.array_append(s["found"], word)).alias("found"))
        word = lambda rest: F.regexp_replace(F.regexp_extract(rest, r"^\s*(\S+)", 1), "^[\"']+|[\"']+$", "")
        shut = F.endswith(x, F.lit(")"))
        bare = F.regexp_replace(x, r"\)$", "")
        inner = F.when(x == ")", added(F.lit(False), F.lit(""))).otherwise(added(~shut, word(bare)))
        rest = trim(F.regexp_replace(x, "^use", ""))
        opens = F.startswith(rest, F.lit("("))
        outer = added(opens & ~shut, word(F.regexp_replace(F.regexp_replace(rest, r"^\(", ""), r"\)$", "")))
        return F.when(s["inside"], inner).when(F.startswith(x, F.lit("use")), outer).otherwise(s)

    return F.aggregate(lines, start, step, lambda s: s["found"])
