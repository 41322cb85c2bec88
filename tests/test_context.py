"""Modules, resolution, verdicts, previews and headers on small made rows."""

import pytest
from pyspark.sql import functions as F

from treeloom.jobs import context as J
from treeloom.operators import modules as O
from treeloom.operators import review as R


def files(spark, paths):
    rows = [(p, p.rpartition("/")[0], p.rpartition("/")[2], "." + p.rpartition("/")[2].rpartition(".")[2], s) for p, s in paths]
    return spark.createDataFrame(rows, "path string, dir string, name string, ext string, size long")


TREE = [("go.mod", 1), ("main.go", 9), ("cmd/a/x.go", 30), ("sub/go.mod", 1), ("sub/y.go", 5), ("vendor/z.go", 99), ("a/b/c/d/e/go.mod", 1), ("a/b/c/d/e/w.go", 2), ("web/package.json", 1), ("web/src/x.ts", 7), ("web/node_modules/q.js", 50), ("tool/t.py", 4)]


def test_files_belong_to_the_nearest_module(spark):
    got = {(r.language, r.path): r.root for r in O.detect_all(files(spark, TREE)).collect()}
    assert got == {("Go", "main.go"): "", ("Go", "cmd/a/x.go"): "", ("Go", "sub/y.go"): "sub", ("Go", "a/b/c/d/e/w.go"): "", ("Node", "web/src/x.ts"): "web", ("Python", "tool/t.py"): "tool"}
    rolled = {(r.language, r.root): (r.n_packages, r.n_files, r["size"], r.heaviest) for r in O.rollup(O.detect_all(files(spark, TREE))).collect()}
    assert rolled["Go", ""] == (3, 3, 41, "cmd/a/x.go") and rolled["Go", "sub"] == (1, 1, 5, "sub/y.go")


def test_names_stand_for_the_first_module(spark):
    tree = [("b/go.mod", 1), ("b/x.go", 9), ("a/go.mod", 1), ("a/y.go", 5), ("a/p/x.go", 2), ("a/q/x.go", 3)]
    got = {r.name: r.by_name for r in O.by_name(O.detect_all(files(spark, tree))).collect()}
    assert got == {"x.go": "a/p/x.go", "y.go": "a/y.go"}


def test_verdicts(spark):
    rows = [(1, "ok"), (1, "failed"), (2, "ok"), (3, "excluded"), (4, "failed"), (4, "excluded"), (5, "ok"), (5, "excluded")]
    got = {r.g: r.verdict for r in O.verdict(spark.createDataFrame(rows, "g int, status string"), ["g"]).collect()}
    assert got == {1: "proceed", 2: "ok", 3: "no_safe_files", 4: "failed", 5: "proceed"}


@pytest.mark.parametrize(("over", "want"), [(0, [False] * 3), (1, [False, False, True]), (10, [False, False, True]), (11, [False, True, True]), (30, [True] * 3), (33, [True] * 3), (34, [None] * 3)])
def test_status_lines_go_from_the_tail(spark, over, want):
    rows = spark.createDataFrame([(1, i, 10, over) for i in range(3)], "k int, i int, size int, over int")
    assert [r.suppressed for r in O.suppressed(rows, ["k"], ["i"], "over", 3).orderBy("i").collect()] == want


def test_interactive_budget(spark):
    got = [r.b for r in spark.createDataFrame([(x,) for x in (0, -5, 100, 1000, 41_000, 42_161, 10**9)], "x long").select(J.interactive_budget(F.col("x"), 1200).alias("b")).collect()]
    assert got == [524_288, 524_288, 1, 1, 39_800, 1, 524_288 - 40_960]


def test_escapes_and_first_bytes(spark):
    rows = spark.createDataFrame([('a\t"\\\n\x01\x7fé',), ("",), (None,)], "p string")
    assert [r.e for r in rows.select(J.escaped(F.col("p")).alias("e")).collect()] == ['a\\t\\"\\\\\\n\\x01\\x7fé', "", None]
    cut = spark.createDataFrame([("aé日🙂",)], "t string").select(*[J.first_bytes(F.col("t"), n).alias(f"c{n}") for n in range(1, 11)]).first()
    assert list(cut) == ["a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日🙂"]


def test_completion_scores(spark):
    rows = [("use.md", 0, False), ("docs/usage.md", 1, False), ("user/x", 1, False), ("a/my-use.go", 1, False), ("usr", 0, True), ("a/usb", 1, True), ("us/x", 1, True), ("q/a_us", 1, True), ("none", 0, False)]
    got = [r.s for r in spark.createDataFrame(rows, "path string, depth int, is_dir boolean").select(R.completion_score(F.lit("US")).alias("s")).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, None]


def test_broken_images_have_no_header(spark):
    data = ["FFD8FFC0", "FFD8FFE0FFFF00000000000000", "89504E47" + "00" * 20, "474946383961", "", "00000100010000000000000000000000000000000000"]
    got = [r.m for r in spark.createDataFrame([(bytearray.fromhex(x),) for x in data] + [(None,)], "data binary").select(R.image_header().alias("m")).collect()]
    assert [m and m.format for m in got] == [None, None, None, None, None, "ICO", None] and (got[5].width, got[5].height) == (256, 256)


def test_budget_in_parts_is_that_of_the_whole(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("f"), (F.col("id") * 7919 % 2000).cast("string")).alias("path"), "id", (F.col("id") % 50).alias("size"), F.when(F.col("id") % 7 == 0, "binary").otherwise("pending").alias("status"))
    whole, parts = (R.greedy(rows, ["k"], ["path", "id"], 4000, p).orderBy("id").collect() for p in (None, F.substring("path", 1, 3)))
    assert whole == parts and len({r.verdict for r in whole}) == 3
