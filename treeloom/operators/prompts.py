"""Prompts within byte budgets: as many rendered sections as fit, and reviews whose files and status lines share one budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.operators.review import fence_length, trimmed


def section(path: Column, content: str, full: Column, limit: int) -> Column:
    """A labelled section of a file's content, of which both ends stay beyond ``limit`` bytes."""
    cut = F.octet_length(content) > limit
    label = F.concat(F.when(F.startswith(content, F.lit("Binary file: ")), "Binary Summary").when(full, "Full File").otherwise("Extracted Span"), F.when(cut, ", Truncated").otherwise(""))
    return F.concat(F.lit("--- File: "), path, F.lit(" ("), label, F.lit(") ---\n"), trimmed(content, limit), F.lit("\n--- End File ---\n"))


def fitted(sections: DataFrame, key: str, order: str, head: Callable[[Column], Column], limit: int, least: int = 40) -> DataFrame:
    """(key, kept, dropped, size, prompt): the head for the number of sections kept, and as many of ``sections`` (key, order, section) as fit, in order.

    The last section goes until the whole is within ``limit`` bytes; the head holds the number, so it shrinks on the way.  Sizes only grow with
    the number, so the largest number that fits is taken from prefix sums.  A head alone may be larger than the limit.  Sections have ``least``
    bytes at least: those too far behind to fit are dropped before the shuffle, and only what is kept is gathered.  ``order`` is unique within a key.
    """
    counts = sections.groupBy(key).agg(F.count("*").alias("n"))
    inside = Window.partitionBy(key).orderBy(order)
    sized = sections.select(key, order, F.octet_length("section").alias("_size")).withColumn("k", F.row_number().over(inside)).where(F.col("k") <= limit // least + 1)
    upto = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = sized.withColumn("_total", upto + F.octet_length(head(F.col("k")))).where(F.col("_total") <= limit).select(F.col(key).alias("_key"), F.col(order).alias("_order"), "k")
    chosen = sections.join(fits, sections[key].eqNullSafe(fits["_key"]) & (sections[order] == fits["_order"])).select("_key", "k", "section")
    gathered = chosen.groupBy("_key").agg(F.max("k").alias("kept"), F.array_sort(F.collect_list(F.struct("k", "section"))).alias("_parts"))
    found = counts.join(gathered, counts[key].eqNullSafe(gathered["_key"]), "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
    body = F.coalesce(F.array_join(F.transform("_parts", lambda p: p["section"]), ""), F.lit(""))
    found = found.withColumn("prompt", F.concat(head(F.col("kept")), body))
    return found.select(key, "kept", (F.col("n") - F.col("kept")).alias("dropped"), F.octet_length("prompt").cast("long").alias("size"), "prompt")


# Fixed wording of a review's parts.
STATUS_HEAD = "[STATUS OF FILES]\n"
#: What a status line says; pending and included files have none.
REASONS = {
    "added": "new file, complete in its patch", "deleted": "deleted", "binary": "binary file", "sensitive": "sensitive file, its content is left out", "unavailable": "file unavailable", "budget": "budget of the review reached",
}


def reason(status: Column, limit: int) -> Column:
    label = f"{limit // 1024} KiB" if limit % 1024 == 0 else f"{limit} bytes"
    pairs = [F.lit(x) for p in (REASONS | {"oversized": f"file exceeds {label}"}).items() for x in p]
    return F.try_element_at(F.create_map(*pairs), status)


def fenced(language: str, content: str) -> Column:
    """``content`` between fences that are longer than any run of backticks in it."""
    fence = F.repeat(F.lit("`"), fence_length(content).cast("int"))
    return F.concat(fence, F.lit(f"{language}\n"), F.col(content), F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n"), fence)


def initial_status(binary: Column, sensitive: Column) -> Column:
    """What becomes of a changed file before any is read, from its change and whether it is untracked; null: it may be read."""
    tracked = F.when(F.col("change") == "added", "added").when(F.col("change") == "deleted", "deleted").when(~F.col("change").isin("modified", "renamed"), "unavailable")
    return F.when(~F.col("untracked") & binary, "binary").when(sensitive, "sensitive").when(~F.col("untracked"), tracked)


def review(files: DataFrame, key: str, limits: list[int], file_limit: int = N.REVIEW_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Verdicts (key, nth, path, status, shown) and prompts (key, failure, size, prompt) of change sets.

    ``files``: (key, nth, path, untracked, status, patch, content), status as of initial_status(), content null where it can't be read.  All patches and untracked paths
    must fit one of ``limits``, tried in order, else the set's failure is ``overflow`` and nothing of it is rendered.  Status lines of files that aren't
    read go from the tail until the rest fits.  Files are then read in order: one that fits is ``included``; the first that doesn't ends the reading, it and
    all later ones are over ``budget``, each with a status line if that still fits.  Sensitive untracked files aren't mentioned at all.

    Only sizes are gathered for the decision, and only of sets whose mandatory part is within a limit; so groups are bounded by it.
    """
    rows = files.where(~(F.col("untracked") & F.coalesce(F.col("status") == "sensitive", F.lit(False))))
    size = F.octet_length("content")
    text = F.is_valid_utf8("content") & ~F.contains("content", F.lit("\x00"))
    read = F.when(F.col("content").isNull(), "unavailable").when(size > file_limit, "oversized").when(F.col("untracked") & ~text, "binary").otherwise("included")
    rows = rows.withColumn("pending", F.col("status").isNull()).withColumn("status", F.coalesce("status", read))
    line = lambda status: F.concat(F.lit("- "), "path", F.when(F.col("untracked"), ", path only: ").otherwise(", diff only: "), reason(status, file_limit), F.lit("\n"))
    block = F.concat(F.when(F.col("untracked"), "\n[UNTRACKED FILE]\nPath: ").otherwise("\n[CHANGED FILE]\nPath: "), "path", F.lit("\n"), fenced("text", "content"), F.lit("\n"))
    rows = rows.withColumns({"line": line(F.col("status")), "spent_line": line(F.lit("budget")), "block": F.when(F.col("status") == "included", block)})
    rows = rows.withColumn("ticks", fence_length("patch"))

    # The mandatory part's size: the fence of all patches, patches with a blank line between, untracked paths.
    tracked = ~F.col("untracked")
    base = rows.groupBy(key).agg(
        F.count_if(tracked).alias("n_patches"), F.sum(F.when(tracked, F.octet_length("patch"))).alias("patch_bytes"), F.max(F.when(tracked, F.col("ticks"))).alias("ticks"),
        F.max_by(F.endswith("patch", F.lit("\n")), F.when(tracked, F.col("nth"))).alias("ended"), F.count_if("untracked").alias("n_untracked"), F.sum(F.when(F.col("untracked"), F.octet_length("path") + 3)).alias("path_bytes"),
    )
    diff = F.when(F.col("n_patches") > 0, F.lit(len("\nDiff:\n") + len("diff\n") + 1) + 2 * F.col("ticks") + F.col("patch_bytes") + 2 * (F.col("n_patches") - 1) + F.when(F.col("ended"), 0).otherwise(1)).otherwise(0)
    paths = F.when(F.col("n_untracked") > 0, F.lit(len("\n[UNTRACKED PATHS]\n")) + F.col("path_bytes")).otherwise(0)
    limit = F.coalesce(*(F.when(F.col("base") - 1 <= most, most) for most in limits))
    base = base.withColumn("base", diff + paths).withColumn("limit", limit)

    items = F.array_sort(F.collect_list(F.struct("nth", "pending", F.coalesce(F.octet_length("line"), F.lit(0)).alias("line"), F.octet_length("spent_line").alias("spent"), F.coalesce(F.octet_length("block"), F.lit(0)).alias("block"))))
    gathered = rows.join(base.where("limit is not null").select(key, "base", "limit"), key).groupBy(key).agg(F.first("base").alias("base"), F.first("limit").alias("limit"), items.alias("items"))
    marked = gathered.withColumn("marks", _verdicts())
    verdicts = marked.select(key, F.explode(F.transform("items", lambda x, i: F.struct(x["nth"].alias("nth"), F.substring(F.col("marks"), i + 1, F.lit(1)).alias("mark")))).alias("v")).select(key, "v.nth", "v.mark")
    known = rows.join(verdicts, [key, "nth"]).withColumn("status", F.when(F.upper("mark") == "B", "budget").otherwise(F.col("status"))).withColumn("shown", F.col("mark").isin("B", "S"))

    parts = known.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(on, F.struct("nth", F.expr(what).alias("text"))))).alias(name) for name, on, what in (
        ("lines", F.col("shown"), "case when mark = 'B' then spent_line else line end"), ("patches", tracked, "patch"), ("others", F.col("untracked"), "path"), ("blocks", F.col("mark") == "I", "block"),
    )))
    text_of = lambda name, glue: F.array_join(F.transform(name, lambda x: x["text"]), glue)
    parts = parts.withColumn("diff", text_of("patches", "\n\n"))
    body = F.concat(
        F.when(F.size("lines") > 0, F.concat(F.lit(STATUS_HEAD), text_of("lines", ""))).otherwise(""), F.when(F.size("patches") > 0, F.concat(F.lit("\nDiff:\n"), fenced("diff", "diff"), F.lit("\n"))).otherwise(""),
        F.when(F.size("others") > 0, F.concat(F.lit("\n[UNTRACKED PATHS]\n"), F.array_join(F.transform("others", lambda x: F.concat(F.lit("- "), x["text"], F.lit("\n"))), ""))).otherwise(""), text_of("blocks", ""),
    )
    rendered = parts.select(key, F.regexp_replace(body, r"\A\n", "").alias("prompt"))
    prompts = base.join(rendered, key, "left").select(key, F.when(F.col("limit").isNull(), "overflow").alias("failure"), F.octet_length("prompt").cast("long").alias("size"), "prompt")
    return known.select(key, "nth", "path", "status", "shown"), prompts


def _verdicts() -> Column:
    """A letter for each of ``items`` within ``limit``: I included, B and b over budget, S and s of another status; capitals are mentioned.

    Sizes: base, less the line end that begins it where no status stands before, the status head and lines, and the included blocks.
    """
    head, item = len(STATUS_HEAD), F.col("items")
    total = lambda lines, size, blocks: F.col("base") + blocks + F.when(lines > 0, size + head).otherwise(-1)
    fixed = F.filter(item, lambda x: ~x["pending"])
    start = F.struct(F.size(fixed).alias("lines"), F.aggregate(fixed, F.lit(0), lambda a, x: a + x["line"]).alias("size"))
    # Lines from the tail that go before anything is read.
    drop = lambda s, x: F.when(total(s["lines"], s["size"], F.lit(0)) <= F.col("limit"), s).otherwise(F.struct((s["lines"] - 1).alias("lines"), (s["size"] - x["line"]).alias("size")))
    left = F.aggregate(F.reverse(fixed), start, drop)
    state = lambda seen, lines, size, blocks, spent, marks: F.struct(seen.alias("seen"), lines.alias("lines"), size.alias("size"), blocks.alias("blocks"), spent.alias("spent"), marks.alias("marks"))

    def fold(first: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            on = lambda mark, lines=s["lines"], size=s["size"], blocks=s["blocks"], spent=s["spent"], seen=s["seen"]: state(seen, lines, size, blocks, spent, F.concat(s["marks"], F.lit(mark)))
            fits = lambda lines, line, block: total(s["lines"] + lines, s["size"] + line, s["blocks"] + block) <= F.col("limit")
            over = F.when(fits(1, x["spent"], 0), on("B", s["lines"] + 1, s["size"] + x["spent"], spent=F.lit(True))).otherwise(on("b", spent=F.lit(True)))
            told = F.when(fits(1, x["line"], 0), on("S", s["lines"] + 1, s["size"] + x["line"])).otherwise(on("s", spent=F.lit(True)))
            taken = F.when(fits(0, 0, x["block"]), on("I", blocks=s["blocks"] + x["block"])).otherwise(over)
            kept = F.when(s["seen"] < first["lines"], on("S", seen=s["seen"] + 1)).otherwise(on("s", seen=s["seen"] + 1))
            return F.when(~x["pending"], kept).when(s["spent"], over).when(x["block"] > 0, taken).otherwise(told)

        return F.aggregate("items", state(F.lit(0), first["lines"], first["size"], F.lit(0), F.lit(False), F.lit("")), step, lambda s: s["marks"])

    # The lines that are left are worked out once: as the one element of an array.
    return F.transform(F.array(left), fold)[0]
