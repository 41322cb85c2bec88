"""Replies, re-indentation, tagged references and prompts within budgets, on small rows."""

import time

import pytest
from pyspark.sql import functions as F

from treeloom.operators import prompts as O
from treeloom.operators import replies as R
from treeloom.operators import review as V
from treeloom.operators import spans as S
from treeloom.operators import tagging as T


def parsed(spark, text):
    rows = R.with_events(spark.createDataFrame([(1, text)], "k int, t string").select("k", R.reply_lines(F.col("t")).alias("lines")))
    return [(r.kind, r.target, r.content if r.content is not None else r.error) for r in R.updates(rows).orderBy("nth").collect()], rows.select(R.text_outside().alias("t")).first().t


@pytest.mark.parametrize(("text", "updates", "rest"), [
    ("Hi\n```\n--- File: a.go ---\nx\n  y\n--- End File ---\n```\nBye", [("write", "a.go", "x\n  y\n")], "Hi\nBye"),
    ("--- File: d.md ---\n```\n--- End File ---\n```\nz\n--- End File ---\n", [("write", "d.md", "```\n--- End File ---\n```\nz\n")], ""),
    ("--- File: d.txt ---\n```\n--- End File ---\n```\nz\n", [("write", "d.txt", "```\n")], "z"),
    ("--- File: ../x ---\nbody\n--- End File ---", [("error", "../x", "outside")], "body\n--- End File ---"),
    ("--- File: <path> ---\nbody\n--- Delete File: old ---\nend", [("delete", "old", None)], "--- File: <path> ---\nbody\nend"),
    ("--- File: a ---\n--- File: b ---\n--- Delete File: c ---\n--- End File ---", [("write", "a", "--- File: b ---\n--- Delete File: c ---\n")], ""),
    ("--- File: a ---\r\nx\r\n--- End File ---\r\n", [("write", "a", "x\n")], ""), ("--- File: a ---\nlost", [("open", "a", "no end")], ""), ("", [], ""), ("--- File:  ---", [("error", "", "empty")], ""), ("  --- File: a b ---  \n--- End File ---", [("write", "a b", "")], ""),
])
def test_replies(spark, text, updates, rest):
    assert parsed(spark, text) == (updates, rest)


@pytest.mark.parametrize(("incoming", "existing", "mode", "want"), [
    ("a\n  b\n    c\n   d", "x\n\ty", "smart", "a\n\tb\n\t\tc\n\t d"), ("a\n  b\n   c", "x\n\ty", "ignore", "a\n\tb\n\tc"), ("\ta\n\t\tb", "x\n    y\n    z", "smart", "    a\n        b"), ("  a", "", "smart", "  a"), ("  a", None, "smart", "  a"),
    ("  a", "\tx", "exact", "  a"), ("    a\n  \n  b", "\tx", "smart", "\t\ta\n\n\tb"), ("\t  a", "\tx", "smart", "\ta"), ("\t  a", "\tx", "ignore", "\t\t\ta"), ("  a\n    b", " x\n\ty", "smart", "\ta\n\t\tb"), ("  a", "plain", "smart", "\ta"),
    ("  a", "  x\n  y\n    z", "smart", "  a"), ("    a", "   x\n  y", "smart", "  a"),
])
def test_reindented(spark, incoming, existing, mode, want):
    rows = spark.createDataFrame([(incoming, existing)], "a string, b string")
    assert rows.select(R.reindented(F.col("a"), F.col("b"), mode).alias("x")).first().x == want


def test_votes_stop_after_two_hundred_lines(spark):
    text = "\n".join(["  x"] * 200 + ["\ty"] * 300)
    assert tuple(spark.createDataFrame([(text,)], "t string").select(R.indentation(F.split("t", "\n")).alias("i")).first().i) == (False, 2)


INSIDE = ["README.md", "src/a.go", "docs/x.md"]
OUTSIDE = [("../side/docs", "/work/side/docs", r) for r in ("spec.md", "x.md", "deep/y.md")] + [("./vendor/lib", "/work/app/vendor/lib", "z.md"), ("../twin", "/work/twin", "spec.md"), ("../side", "/work/side", "docs/spec.md")]


@pytest.mark.parametrize(("ref", "status", "path", "source"), [
    ("README.md", "local", "README.md", None), ("./src//../src/a.go", "local", "src/a.go", None), ("src", "directory", None, None), ("/abs", "absolute", None, None), (" ", "empty", None, None), ("./", "empty", None, None), ("../gone.md", "outside", None, None), ("gone.md", "missing", None, None),
    ("docs/x.md", "local", "docs/x.md", None), ("x.md", "external", "x.md", "/work/side/docs/x.md"), ("docs/deep/y.md", "external", "docs/deep/y.md", "/work/side/docs/deep/y.md"), ("../side/docs/deep/y.md", "external", "../side/docs/deep/y.md", "/work/side/docs/deep/y.md"),
    ("side/docs/deep/y.md", "external", "side/docs/deep/y.md", "/work/side/docs/deep/y.md"), ("spec.md", "ambiguous", None, None), ("docs/spec.md", "external", "docs/spec.md", "/work/side/docs/spec.md"), ("vendor/lib/z.md", "external", "vendor/lib/z.md", "/work/app/vendor/lib/z.md"),
    ("../app/vendor/lib/z.md", "external", "../app/vendor/lib/z.md", "/work/app/vendor/lib/z.md"), ("twin/./spec.md", "external", "twin/./spec.md", "/work/twin/spec.md"), ("deep", "missing", None, None), ("docs/../../side/docs/x.md", "external", "docs/../../side/docs/x.md", "/work/side/docs/x.md"),
])
def test_references_resolve(spark, ref, status, path, source):
    inside, outside = spark.createDataFrame([(x,) for x in INSIDE], "rel string"), spark.createDataFrame(OUTSIDE, "display string, root string, rel string")
    got = T.resolve(spark.createDataFrame([(ref,), (ref,), (None,)], "ref string"), inside, outside, "/work/app").collect()
    assert [tuple(r) for r in got] == [(ref, status, path, source)]


def sections(spark, sizes):
    return spark.createDataFrame([("k", i, "s" * n) for i, n in enumerate(sizes)], "key string, i int, section string")


@pytest.mark.parametrize(("limit", "kept"), [(45, 0), (46, 0), (85, 0), (86, 1), (126, 1), (127, 2), (10_000, 12)])
def test_sections_fit_to_the_byte(spark, limit, kept):
    head = lambda k: F.concat(F.lit("x" * 45), k.cast("string"))
    got = O.fitted(sections(spark, [40, 41, 50, *([40] * 9)]), "key", "i", head, limit).first()
    assert (got.kept, got.dropped, got.size) == (kept, 12 - kept, len(got.prompt)) and got.prompt.startswith("x" * 45 + str(kept))
    assert kept in (0, 12) or got.size <= limit


def test_a_longer_number_takes_its_room(spark):
    head = lambda k: F.concat(F.lit("n"), k.cast("string"))
    for limit, kept in ((402, 9), (403, 10)):
        assert O.fitted(sections(spark, [40] * 12), "key", "i", head, limit).first().kept == kept


FILES = "set int, nth int, path string, untracked boolean, status string, patch string, content string"


def reviewed(spark, rows, *limits, **more):
    verdicts, prompts = O.review(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], FILES), "set", list(limits), **more)
    return [(r.status, r.shown) for r in verdicts.orderBy("nth").collect()], prompts.first()


ROWS = [("a.go", False, None, "@@ a", "one\n"), ("b.go", False, "deleted", "@@ b", None), ("c.go", False, None, "@@ c\n", "``` two"), ("d.go", True, None, None, "three " * 20)]


def test_a_review_fits_to_the_byte(spark):
    whole = reviewed(spark, ROWS, 1 << 20)
    assert whole[0] == [("included", False), ("deleted", True), ("included", False), ("included", False)] and whole[1].failure is None
    size = len(whole[1].prompt.encode())
    assert whole[1]["size"] == size and reviewed(spark, ROWS, size)[1].prompt == whole[1].prompt
    less = reviewed(spark, ROWS, size - 1)
    assert less[0] == [("included", False), ("deleted", True), ("included", False), ("budget", True)] and less[1]["size"] <= size - 1
    for limit in range(60, size):
        verdicts, prompt = reviewed(spark, ROWS, limit) if limit % 23 == 0 else (None, None)
        assert prompt is None or prompt.failure == "overflow" and not verdicts or prompt["size"] <= limit and prompt["size"] == len(prompt.prompt.encode())


def test_mandatory_parts_overflow_and_second_limits_serve(spark):
    bare = [("a", False, "added", "p" * 100, None)]
    mandatory = len("Diff:\n```diff\n") + 100 + len("\n```\n")
    assert reviewed(spark, bare, mandatory - 1)[1].failure == "overflow"
    exact = reviewed(spark, bare, mandatory)
    assert exact == ([("added", False)], exact[1]) and exact[1]["size"] == mandatory and exact[1].prompt.startswith("Diff:\n")
    assert reviewed(spark, bare, mandatory - 1, 1000)[0] == [("added", True)]


def test_reading_ends_at_the_first_file_that_does_not_fit(spark):
    rows = [("a", False, None, "@", "x" * 500), ("b", False, None, "@", "y"), ("c", False, None, "@", None), ("d.key", True, "sensitive", None, "z"), ("e", True, None, None, "n\x00l"), ("f", False, None, "@", "long" * 30)]
    assert reviewed(spark, rows, 400)[0] == [("budget", True), ("budget", True), ("budget", True), ("budget", True), ("budget", True)]
    assert reviewed(spark, rows, 4000, file_limit=100)[0] == [("oversized", True), ("included", False), ("unavailable", True), ("binary", True), ("oversized", True)]
    assert "file exceeds 100 bytes" in reviewed(spark, rows, 4000, file_limit=100)[1].prompt and "d.key" not in reviewed(spark, rows, 4000)[1].prompt


def test_trims_are_linear(spark):
    n = 1_000_000
    rows = spark.createDataFrame([(" a" + " " * n + "b  ", "a" + "\n" * n + "b\r\n\n")], "t string, u string").cache()
    rows.count()
    began = time.time()
    got = rows.select(F.length(S.trim(F.col("t"))).alias("t"), V.line_count("u").alias("u")).first()
    assert (got.t, got.u) == (n + 2, n + 1) and time.time() - began < 5


@pytest.mark.parametrize("segments", [0, 63, 64, 5000])
def test_frames_behind_many_segments(spark, segments):
    data = "FFD8" + "FFE10004ABCD" * segments + "FFFFFFD0" + "FFC0001108000A001403"
    got = spark.createDataFrame([(bytearray.fromhex(data),), (bytearray.fromhex("FFD8" + "FFE10000" * 9),)], "data binary").select(V.image_header().alias("m")).collect()
    assert tuple(got[0].m) == ("JPEG", 20, 10, False) and got[1].m is None
