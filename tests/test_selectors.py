"""Selectors of turns with line ends, odd blanks and nulls where the pattern is cut out: the SQL's rows."""

import pytest

from tests.oracle import assert_same, connect
from treeloom.jobs.catalog import ORACLE_SQL, QUERIES
from treeloom.operators import selectors as S

#: NEAR takes the 5th to 10th character, PREFIX the first 12.
TEXTS = ["abcdefghi\n", "abcd\nefghij", "abcdefg\r\n", "abcd\refghij", "abcd\u2028efghij", "abcdefgh\x0b\x0b", "abcdefgh\x85\x85", "abcd\xa0\u3000efgh", "abcd\n\n\n\n\n\n", "", None, "abcd#e\nfgh", "FILE: x"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of turns and files, and its SQL: a turn of each kind for each text; the paths of some turns are files', some files have no language or source."""
    folder = str(tmp_path_factory.mktemp("odd"))
    turns = [(i, k, "user" if i % 4 else None, t) for i, t in enumerate(TEXTS) for k in range(5)] + [(None, 2, "user", "abcdefghij"), (1, None, "user", "abcdefghij"), (-3, 2, "user", "abcdefghi\n")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    docs = [(i, "text", None if i % 11 == 3 else "en", None if i % 5 == 3 else "src1") for i in range(40)] + [(None, "text", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, connect(folder)


def same(spark, odd, name):
    """The rows of a query, which are its SQL's."""
    rows = QUERIES[name](spark, odd[0])
    assert_same(rows, odd[1], ORACLE_SQL[name])
    return rows.collect()


def test_parsed(spark, odd):
    got = {(r.req_id, r.seq): (r.type, r.pattern, r.code) for r in same(spark, odd, "parse_selectors")}
    none, empty, near = ("", "", "not_a_selector"), ("NEAR", "", "no_pattern"), lambda x: ("NEAR", x, "ok")
    assert [got[i, 2] for i in range(len(TEXTS))] == [none, none, none, near("efghi"), near("efghi"), near("efgh\x0b\x0b"), near("efgh\x85\x85"), near("efgh"), none, empty, empty, none, near(": x")]
    assert got[0, 1] == none and got[3, 1] == ("PREFIX", "abcd\refghij", "ok") and {got[10, k] for k in range(5)} == {("FILE", "", "ok"), ("PREFIX", "", "no_pattern"), empty, none}


def test_lines_that_are_null_or_end(spark):
    rows = spark.createDataFrame([(0, None), (1, "FILE: a.go\n"), (2, "NEAR: a.go#x\n"), (3, "NEAR: a.go#x\r\n"), (4, "\n"), (5, "NEAR: a\n.go#x")], "i int, line string")
    got = [(r.type, r.sel_path, r.pattern, r.code) for r in S.parse(rows).orderBy("i").collect()]
    assert got == [("", "", "", "blank"), ("FILE", "a.go", "", "ok"), ("", "", "", "not_a_selector"), ("", "", "", "not_a_selector"), ("", "", "", "blank"), ("NEAR", "a\n.go", "x", "ok")]


def test_strict(spark, odd):
    got = {r.req_id: (r.n_lines, r.n_ok, r.accepted) for r in same(spark, odd, "strict_selectors")}
    assert (got[-3], got[1], got[3], got[10]) == ((1, 0, False), (6, 1, False), (5, 3, False), (5, 1, False))


def test_superseded(spark, odd):
    got = {(r.req_id, r.seq) for r in same(spark, odd, "supersede")}
    # Turns 2 of the requests 1 and 3 of the first group: a line end in the pattern, and one that is none.
    assert (0, 102) not in got and (0, 302) in got


def test_resolved_exactly(spark, odd):
    got = {(r.req_id, r.seq): (r.sel_path, r.found) for r in same(spark, odd, "resolve_exact")}
    assert got[0, 0] == ("README.md", True) and got[4, 2] == ("public/en/f14.go", False) and not {(0, 2), (-3, 2), (10, 4)} & set(got)


def test_resolved_by_name(spark, odd):
    got = {r.sel_path: r.resolved for r in same(spark, odd, "resolve_fuzzy")}
    assert got["src/src1/en/f18.sql"] == "src//en/f18.sql" and got["public/en/f14.go"] == "public//f14.go"


def test_resolved_by_suffix(spark, odd):
    got = {r.request: (r.status, r.path) for r in same(spark, odd, "resolve_suffix")}
    assert got["f18.sql"] == ("found", "src//en/f18.sql") and got["f14.go"] == ("found", "public//f14.go") and None not in got


def test_verdicts_of_groups(spark, odd):
    got = {r.grp: (r.n_ok, r.n_failed, r.n_excluded) for r in same(spark, odd, "extraction_verdict")}
    # The texts of the group of turns 8 to 11 have line ends or nothing in their patterns: only the four FILE lines are selectors.
    assert got[2] == (4, 0, 0)
