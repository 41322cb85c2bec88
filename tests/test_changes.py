"""Change records, workspace members, fallback modules and extraction on small rows."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.jobs import context as J
from treeloom.jobs import extras, reads
from treeloom.operators import changes as C
from treeloom.operators import extraction as E
from treeloom.operators import modules as O

one = lambda spark, text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(("text", "error", "want"), [
    ("A\x00a b\x00R100\x00old\x00new\x00D\x00x\x00", None, [("added", "a b", ""), ("renamed", "new", "old"), ("deleted", "x", "")]), ("", None, []), ("M\x00x", None, [("modified", "x", "")]), ("A", "incomplete", []), ("A\x00x\x00R9\x00old", "incomplete", []),
    ("C75\x00x\x00\x00A\x00late\x00", None, [("modified", "x", "")]), ("A\x00\x00", None, [("added", "", "")]),
])
def test_status_records(spark, text, error, want):
    got = one(spark, text, C.name_status)
    assert (got.error, [tuple(c) for c in got.changes]) == (error, want)


@pytest.mark.parametrize(("text", "error", "want"), [
    ("1\t2\ta\tb\x00-\t-\tp.png\x003\t0\t\x00old\x00new\x00", None, [("a\tb", False, 1, 2), ("p.png", True, None, None), ("new", False, 3, 0)]), ("", None, []), ("1\t2", "incomplete", []), ("1\t2\t\x00old", "incomplete", []), ("x\t2\tq\x00", None, [("q", False, None, 2)]),
])
def test_count_records(spark, text, error, want):
    got = one(spark, text, C.numstat)
    assert (got.error, [tuple(c) for c in got.counts]) == (error, want)


@pytest.mark.parametrize(("text", "want"), [
    ("go 1.22\nuse ./a // note\nuse (\n\t./b\n// ./c\n  \"./d\" x\n)\nuse ./e", ["./a", "./b", "./d", "./e"]), ("use (./a)\nuse ./b", ["./a", "./b"]), ("use ( ./a\n./b )\n./c", ["./a", "./b"]), ("use (\n./open", ["./open"]), ("", []), ("used ./x", ["d"]),
])
def test_workspace_members(spark, text, want):
    assert one(spark, text, C.workspace_members) == want


def test_generic_modules_stand_in_where_no_detector_finds_any(spark):
    paths = ["go/go.mod", "go/a.go", "rust/x.rs", "rust/y.rs", "rust/z.rb", "rust/.env", "rust/go.sum", "plain/notes", "dist/q.rs"]
    files = spark.createDataFrame([(p, p.rpartition("/")[0], p.rpartition("/")[2], "." + p.rpartition(".")[2] if "." in p else "", 1) for p in paths], "path string, dir string, name string, ext string, size long")
    got = O.with_fallback(O.detect_all(files), files, J._omitted())
    assert {(r.language, r.root, r.path) for r in got.collect()} == {("Go", "go", "go/a.go"), ("Rust", "rust", "rust/x.rs"), ("Rust", "rust", "rust/y.rs"), ("Rust", "rust", "rust/z.rb"), ("Generic", "plain", "plain/notes")}


def test_limits_bite(spark):
    sf = "/root/testdata/sf0.001"
    cut = [r.section for r in J.context_sections(spark, sf, limit=301).collect()]
    assert any("Truncated" in s and "bytes] ..." in s for s in cut) and all(len(s.encode()) < 301 + 200 for s in cut)
    assert {r.reason for r in extras.status_reasons(spark, sf, limit=1000).collect() if r.status == "oversized"} == {"over 1000 bytes"}
    assert {r.reason for r in extras.status_reasons(spark, sf, limit=2048).collect() if r.status == "oversized"} == {"over 2 KiB"}
    assert N.FILE_BYTES == 50 * 1024 and N.REVIEW_FILE_BYTES == 64 * 1024 and reads.H.LIMIT == 64 * 1024


def test_extraction_from_selectors_to_prompt(spark):
    code = "package x\n\n// doc\nfunc A() {\n\tone()\n}\n\nfunc B() {\n}\n" + "// more\n" * 30
    files = spark.createDataFrame([("a.go", "source", len(code), code), ("logo.png", "asset", 2048, None), ("b.md", "source", 3, "hey")], "path string, kind string, size long, text string")
    lines = [(1, 0, "PREFIX: a.go # func A"), (1, 1, "near: a.go#func B"), (1, 2, "FILE: logo.png"), (1, 3, "FILE: .env"), (1, 4, "FILE: gone.go"), (1, 5, "prose"), (1, 6, "PREFIX: a.go # func A"), (2, 0, "FILE: id_rsa"), (3, 0, "FILE: gone"), (4, 0, "PREFIX: b.md # x"), (4, 1, "FILE: b.md")]
    head = lambda k: F.concat(F.lit("n"), k.cast("string"), F.lit("\n"))
    got = {r.req_id: r for r in E.context(spark.createDataFrame(lines, "req_id long, seq long, line string"), files, head).collect()}
    assert {k: (r.verdict, r.n_ok, r.n_failed, r.n_excluded, r.kept) for k, r in got.items()} == {1: ("proceed", 3, 1, 1, 3), 2: ("no_safe_files", 0, 0, 1, None), 3: ("failed", 0, 1, 0, None), 4: ("ok", 1, 0, 0, 1)}
    assert got[1].prompt == (
        "n3\n--- File: a.go (Extracted Span) ---\nfunc A() {\n\tone()\n}\n\n--- End File ---\n--- File: a.go (Extracted Span) ---\nfunc B() {\n}\n\n--- End File ---\n"
        "--- File: logo.png (Binary Summary) ---\nBinary file: logo.png\nKind: asset\nSize: 2KB\n--- End File ---\n"
    )
    assert got[4].prompt == "n1\n--- File: b.md (Full File) ---\nhey\n--- End File ---\n"
