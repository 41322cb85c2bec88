"""Change sets, review budgets, references, fences, write plans and indentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, old_size, new_size) of two snapshots (path, size, mark): added, deleted or modified."""
    old = before.select("path", F.col("size").alias("old_size"), F.col("mark").alias("old_mark"))
    new = after.select("path", F.col("size").alias("new_size"), F.col("mark").alias("new_mark"))
    change = F.when(F.col("old_mark").isNull(), "added").when(F.col("new_mark").isNull(), "deleted").when(F.col("old_mark") != F.col("new_mark"), "modified")
    return old.join(new, "path", "full").select("path", change.alias("change"), "old_size", "new_size").where("change is not null")


def context_status() -> Column:
    """What a review may show of a change: by kind, sensitivity and change; pending may be included."""
    return F.when(F.col("kind") == "binary", "binary").when(C.is_sensitive(), "sensitive").when(F.col("change") == "added", "added").when(F.col("change") == "deleted", "deleted").otherwise("pending")


def greedy(changes: DataFrame, keys: list[str], order: list[str], limit: int, part: Column | None = None) -> DataFrame:
    """Adds used and verdict: pending files are included until the first that overflows; it and all later ones are over budget.

    ``part`` cuts a key's rows into runs of the order (a start of the first order column, say): sums run inside the parts, on top of the
    totals of the parts before, so that a large key is many tasks' work.
    """
    rows = changes.withColumn("_part", F.lit("") if part is None else part).withColumn("_size", F.when(F.col("status") == "pending", F.col("size")).otherwise(0))
    totals = rows.groupBy(*keys, "_part").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    running = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = rows.withColumn("used", F.sum("_size").over(running)).join(totals, [*keys, "_part"]).withColumn("used", F.col("used") + F.col("_before"))
    first = used.where((F.col("status") == "pending") & (F.col("used") > limit)).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_over"))
    found = used.join(first, keys, "left")
    over = F.coalesce(F.struct(*order) >= F.col("_over"), F.lit(False))
    verdict = F.when(F.col("status") != "pending", F.col("status")).when(over, "budget").otherwise("included")
    return found.withColumn("verdict", verdict).drop("_part", "_size", "_before", "_over")


def fences(lines: Column) -> Column:
    """Blocks struct(first, last) of fenced lines, the fences among them, from an array of lines.

    A fence is a run of three or more backticks or tildes after three blanks at most; what follows backticks may hold none.  It closes at a
    run of the same sign that is as long and has nothing but blanks behind, or at the end.
    """
    shape = r"(?s)^ {0,3}(`{3,}+|~{3,}+)(.*?)\r?\z"

    def fact(x: Column, i: Column) -> Column:
        run, rest = F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 2)
        opens = F.startswith(run, F.lit("~")) | ~F.contains(rest, F.lit("`"))
        return F.struct(i.alias("i"), F.left(run, F.lit(1)).alias("sign"), F.length(run).alias("run"), opens.alias("opens"), rest.rlike(r"^[ \t]*\z").alias("closes"))

    marks = F.filter(F.transform(lines, fact), lambda m: m["run"] > 0)
    kind = "struct<first:int,last:int>"
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("sign"), F.lit(0).alias("run"), F.array().cast(f"array<{kind}>").alias("blocks"))

    def step(s: Column, m: Column) -> Column:
        closing = s["at"].isNotNull() & (m["sign"] == s["sign"]) & (m["run"] >= s["run"]) & m["closes"]
        block = F.struct(s["at"].alias("first"), m["i"].alias("last"))
        shut = F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("sign"), F.lit(0).alias("run"), F.array_append(s["blocks"], block).alias("blocks"))
        opened = F.struct(m["i"].alias("at"), m["sign"].alias("sign"), m["run"].alias("run"), s["blocks"].alias("blocks"))
        return F.when(closing, shut).when(s["at"].isNull() & m["opens"], opened).otherwise(s)

    last = F.struct(F.lit(None).cast("int").alias("first"), (F.size(lines) - 1).alias("last"))
    return F.aggregate(marks, start, step, lambda s: F.when(s["at"].isNull(), s["blocks"]).otherwise(F.array_append(s["blocks"], F.struct(s["at"].alias("first"), last["last"].alias("last")))))


def is_fenced(blocks: Column, i: Column) -> Column:
    return F.exists(blocks, lambda b: (b["first"] <= i) & (i <= b["last"]))


def fence_mask(texts: DataFrame, lines: str = "lines") -> DataFrame:
    """(…, ln, fenced) for each line of an array of lines."""
    rows = texts.withColumn("_blocks", fences(F.col(lines)))
    rows = rows.select("*", F.posexplode(lines).alias("_i", "_line"))
    return rows.select(*[c for c in texts.columns if c != lines], F.col("_i").cast("long").alias("ln"), is_fenced(F.col("_blocks"), F.col("_i")).alias("fenced"))


def _outside_fences(texts: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """``texts`` with helper columns, and the text without its fenced lines."""
    rows = texts.withColumn("_lines", F.split(column, "\n"))
    rows = rows.withColumn("_blocks", fences(F.col("_lines")))
    return rows, F.when(F.size("_blocks") == 0, F.col(column)).otherwise(F.array_join(F.transform("_lines", lambda x, i: F.when(is_fenced(F.col("_blocks"), i), "").otherwise(x)), "\n"))


def open_references(texts: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``texts`` with a quoted reference outside fenced blocks that lacks its end; there is one at most, since the next quotation mark ends it."""
    rows, open_text = _outside_fences(texts, column)
    return rows.withColumn("_open", open_text).where(unclosed_reference("_open")).select(*texts.columns)


def references(texts: DataFrame, column: str = "text") -> DataFrame:
    """(…, pos, ref): ``@path`` and ``@"quoted path"`` outside fenced blocks, where no letter, digit or underscore stands before the sign.

    Unquoted paths lose trailing punctuation; in quoted ones a backslash keeps a quotation mark or backslash.  An unclosed quotation is no
    reference; open_references() finds those.
    """
    token = r'(?s)(?<![\p{L}\p{Nd}_])@("(?:[^"\\]++|\\.)*+"|[\p{L}\p{Nd}/.\-_~+]+)'
    rows, open_text = _outside_fences(texts, column)
    quoted = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r'\\(["\\])', "$1")
    plain = lambda x: F.regexp_replace(x, r"[.]+\z", "")
    found = F.transform(F.regexp_extract_all(open_text, F.lit(token), 1), lambda x: F.struct(F.startswith(x, F.lit('"')).alias("quoted"), F.when(F.startswith(x, F.lit('"')), quoted(x)).otherwise(plain(x)).alias("ref")))
    kept = F.filter(found, lambda x: x["quoted"] | (x["ref"] != ""))
    return rows.select(*texts.columns, F.posexplode(kept).alias("pos", "_r")).select(*texts.columns, F.col("pos").cast("long").alias("pos"), F.col("_r.ref").alias("ref"), F.col("_r.quoted").alias("quoted"))


def unclosed_reference(column: str = "text") -> Column:
    """Whether a quoted reference lacks its end."""
    return F.col(column).rlike(r'(?s)(?<![\p{L}\p{Nd}_])@"(?:[^"\\]++|\\.)*+\\?\z')


def fence_length(column: str = "text") -> Column:
    """Backticks that a fence around the text needs: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(column, F.lit("(`+)"), 1), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1).cast("long")


def write_plan(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, op, target, content, error) of well-formed responses: ``--- File: p ---`` … ``--- End File ---`` and ``--- Delete File: p ---``."""
    head, drop = F.regexp_extract("line", "^--- File: (.+) ---$", 1), F.regexp_extract("line", "^--- Delete File: (.+) ---$", 1)
    shut = F.col("line") == "--- End File ---"
    running = Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("target", F.coalesce(F.nullif(head, F.lit("")), F.nullif(drop, F.lit("")))).withColumn("op", F.when(head != "", "write").when(drop != "", "delete"))
    marked = marked.withColumn("block", F.count("target").over(running)).withColumn("shut", shut)
    inside = marked.where("block > 0").groupBy(*keys, "block").agg(
        F.max("op").alias("op"), F.max("target").alias("target"), F.min(F.when(F.col("shut"), F.col("ln"))).alias("end_ln"), F.min(F.when(F.col("target").isNotNull(), F.col("ln"))).alias("start_ln"),
        F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("rows"),
    )
    body = F.filter(F.col("rows"), lambda r: (r["ln"] > F.col("start_ln")) & (r["ln"] < F.col("end_ln")))
    content = F.when(F.col("op") == "write", F.array_join(F.transform(body, lambda r: r["line"]), "\n"))
    error = F.when((F.col("op") == "write") & F.col("end_ln").isNull(), "unterminated").otherwise(path_error("target"))
    return inside.select(*keys, F.col("block").cast("long").alias("block"), "op", "target", content.alias("content"), error.alias("error"))


def path_error(column: str | Column) -> Column:
    """Why a path may not be written; null where it may."""
    path = F.col(column) if isinstance(column, str) else column
    return (
        F.when(path == "", "empty").when(path.rlike(r"^([/\\]|[A-Za-z]:)"), "absolute").when(path.rlike(r"[*?\[\]]"), "pattern").when(path.rlike("[<>]"), "placeholder")
        .when(path.rlike(r"(^|[/\\])[.][.]([/\\]|$)"), "outside").when(path == ".", "root")
    )


def indent_style(lines: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """(keys, tabs, width): votes of the first indented lines; tabs win ties and empty votes, of widths the smaller."""
    nth = Window.partitionBy(*keys).orderBy("ln")
    deep = lines.where(F.col("line").rlike(r"^[ \t]")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
    deep = deep.withColumn("tab", F.col("line").startswith("\t")).withColumn("width", F.when(~F.col("tab"), F.length(F.regexp_extract("line", "^ +", 0))))
    votes = deep.groupBy(*keys, "width").agg(F.count("*").alias("n"))
    return votes.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("width").isNull(), F.col("n"))), F.lit(0)) >= F.coalesce(F.sum(F.when(F.col("width").isNotNull(), F.col("n"))), F.lit(0))).alias("tabs"),
        F.min_by("width", F.when(F.col("width").isNotNull(), F.struct(-F.col("n"), F.col("width")))).cast("long").alias("width"),
    )


def trimmed(column: str, limit: int) -> Column:
    """At most about ``limit`` bytes: halves from both ends, backed off to whole code points, with the cut bytes' number between."""
    data, half, size = F.encode(F.col(column), "UTF-8"), limit // 2, F.octet_length(column)
    heads = [F.substring(data, 1, half - i) for i in range(4)]
    tails = [F.expr(f"substring(encode({column}, 'UTF-8'), octet_length({column}) - {half} + 1 + {i}, {half})") for i in range(4)]
    pick = lambda parts: F.coalesce(*[F.when(F.is_valid_utf8(p.cast("string")), p.cast("string")) for p in parts])
    head, tail = pick(heads), pick(tails)
    cut = size - F.octet_length(head) - F.octet_length(tail)
    return F.when(size <= limit, F.col(column)).otherwise(F.concat(head, F.lit("\n... [cut "), cut.cast("string"), F.lit(" bytes] ...\n"), tail))


def line_count(column: str = "text") -> Column:
    """Lines without trailing line ends; CR, LF and CRLF each end one; 0 if empty."""
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?<![\r\n])[\r\n]++\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\r\n|\r|\n"))).cast("long")


def completion_score(prefix: Column) -> Column:
    """0 to 7 for a candidate (path, depth, is_dir), lower is nearer; null where it doesn't fit.

    Files before directories; of each: its name at the root begins with the prefix, its name one level down does, its path does, or a segment or a
    part of one (cut at ``.``, ``-``, ``_``, ``+``) does; letters of any case.
    """
    path, wanted = F.lower("path"), F.lower(prefix)
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.concat(F.split(path, "/"), F.split(path, r"[/.\-_+]"))
    score = (
        F.when((F.col("depth") == 0) & F.startswith(name, wanted), 0).when((F.col("depth") == 1) & F.startswith(name, wanted), 1).when(F.startswith(path, wanted), 2)
        .when(F.exists(parts, lambda part: F.startswith(part, wanted)), 3)
    )
    return score + F.when(F.col("is_dir"), 4).otherwise(0)


def shallow(paths: DataFrame) -> DataFrame:
    """(path, depth, is_dir) of the files and directories at the root and one level down."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(2))), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k - 1).alias("depth"), (k < F.size(parts)).alias("is_dir")))
    return paths.select(F.explode(steps).alias("s")).select("s.*").distinct()


def _bytes(data: str, at: int | Column, n: int, little: bool = False) -> Column:
    """A number from ``n`` bytes."""
    raw = F.substring(data, F.lit(at + 1) if isinstance(at, int) else at + 1, F.lit(n))
    digits = F.hex(raw)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.conv(digits, 16, 10).cast("long")


def _jpeg_frame(data: str, start: Column) -> Column:
    """struct(width, height) of a JPEG's first frame, however many segments stand before it."""
    none = F.lit(None).cast("long")
    state = F.struct(F.lit(2).alias("at"), F.lit(False).alias("over"), none.alias("width"), none.alias("height"))

    def step(s: Column, _: Column) -> Column:
        marker = F.hex(F.substring(data, s["at"] + 1, F.lit(2)))
        frame = marker.isin("FFC0", "FFC1", "FFC2") & (F.octet_length(data) >= s["at"] + 9)
        found = F.struct(s["at"].alias("at"), F.lit(True).alias("over"), _bytes(data, s["at"] + 7, 2).alias("width"), _bytes(data, s["at"] + 5, 2).alias("height"))
        onward = lambda by: F.struct((s["at"] + by).cast("int").alias("at"), F.lit(False).alias("over"), none.alias("width"), none.alias("height"))
        size = _bytes(data, s["at"] + 2, 2)
        stop = F.struct(s["at"].alias("at"), F.lit(True).alias("over"), none.alias("width"), none.alias("height"))
        fill, alone = marker == "FFFF", marker.rlike("^FF(D[0-7]|01)$")  # fill bytes; markers without a segment
        fits = marker.startswith("FF") & (F.octet_length(data) >= s["at"] + 4) & (size >= 2)
        return F.when(s["over"], s).when(frame, found).when(fill, onward(F.lit(1))).when(alone, onward(F.lit(2))).when(fits, onward(2 + size)).otherwise(stop)

    # Most frames stand near the start: the steps of the whole walk (a byte each at least) are made only where 64 don't get there.
    walk = lambda steps: F.aggregate(F.sequence(F.lit(1), steps), state, step)
    near = walk(F.lit(64))
    return F.when(~start.startswith("FFD8"), None).when(near["over"], near).otherwise(walk(F.greatest(F.octet_length(data), F.lit(1))))


def image_header(data: str = "data") -> Column:
    """struct(format, width, height, alpha) from the first bytes of JPEG, PNG, GIF, WebP (extended) and ICO; null for others and where bytes are missing."""
    start = F.hex(F.substring(data, 1, 4))
    byte = lambda at: _bytes(data, at, 1)
    made = lambda name, w, h, alpha: F.when(w.isNotNull() & h.isNotNull(), F.struct(F.lit(name).alias("format"), w.alias("width"), h.alias("height"), alpha.alias("alpha")))
    long = lambda at_least: F.octet_length(data) >= at_least
    jpeg = _jpeg_frame(data, start)
    full = lambda b: F.when(b == 0, 256).otherwise(b).cast("long")
    return (
        F.when(~long(12), None)
        .when(start.startswith("FFD8"), made("JPEG", jpeg["width"], jpeg["height"], F.lit(False)))
        .when((start == "89504E47") & long(26), made("PNG", _bytes(data, 16, 4), _bytes(data, 20, 4), byte(25).isin(4, 6)))
        .when(start.startswith("474946"), made("GIF", _bytes(data, 6, 2, little=True), _bytes(data, 8, 2, little=True), F.lit(False)))
        .when((start == "52494646") & (F.hex(F.substring(data, 9, 8)) == "5745425056503858") & long(30), made("WebP", _bytes(data, 24, 3, little=True) + 1, _bytes(data, 27, 3, little=True) + 1, F.expr(f"conv(hex(substring({data}, 21, 1)), 16, 10) & 16") > 0))
        .when((start == "00000100") & long(22) & (_bytes(data, 4, 2, little=True) > 0), made("ICO", full(byte(6)), full(byte(7)), F.lit(False)))
    )


def aspect_ratio(width: str, height: str) -> Column:
    """``w:h`` without common factors; empty where either is not positive."""
    # Euclid's steps as a fold; 64 are enough for 32-bit numbers.
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % F.greatest(acc["b"], F.lit(1))).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.col(width).alias("a"), F.col(height).alias("b")), step, lambda s: s["a"])
    ratio = F.transform(F.array(gcd), lambda g: F.concat((F.col(width) / g).cast("long").cast("string"), F.lit(":"), (F.col(height) / g).cast("long").cast("string")))[0]
    return F.when((F.col(width) > 0) & (F.col(height) > 0), ratio).when(F.col(width).isNotNull(), "")


def untracked(files: DataFrame, keys: list[str], k: int = N.UNTRACKED) -> DataFrame:
    """(keys, path, doc_id, nth, omitted): files by review priority, time and path; omitted counts those beyond k."""
    # The rank alone stands over the window, so that tasks send k rows of a group at most; counts are summed before they are shuffled.
    order = Window.partitionBy(*keys).orderBy(F.desc("priority"), F.desc("mtime"), F.asc("path"), F.asc("doc_id"))
    first = files.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= k)
    counts = files.groupBy(*keys).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("omitted"))
    same = reduce(lambda x, y: x & y, [first[c].eqNullSafe(counts[c]) for c in keys])
    return first.join(counts, same).select(*[first[c] for c in first.columns], "omitted")
