"""Queries over whole texts, and limits where they bite."""

import re

import pytest

from tests.oracle import assert_same, connect
from treeloom.functions import names as N
from treeloom.jobs import extras, mapping, review, selection
from treeloom.jobs.catalog import ORACLE_SQL
from treeloom.sources.corpus import files

SF = "/root/testdata/sf0.001"


def cut(text, limit):
    data = text.encode()
    if len(data) <= limit:
        return text
    head, tail = data[: limit // 2].decode(errors="ignore"), data[-(limit // 2) :].decode(errors="ignore")
    return f"{head}\n... [cut {len(data) - len(head.encode()) - len(tail.encode())} bytes] ...\n{tail}"


@pytest.mark.parametrize("limit", [8, 9, 10, 11, 50 << 10])
def test_trim_takes_every_document(spark, tmp_path, limit):
    texts = ["aéßüöäñçb" * 2, "日本語テキスト長い", "🙂" * 9, "plain text of one-byte characters", "short", "", None, "é" * 40_000, "x" + "日" * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.content for r in selection.trim_content(spark, str(tmp_path), limit).collect()}
    assert got == {i: None if t is None else cut(t, limit) for i, t in enumerate(texts)}


def test_trim_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.content for r in selection.trim_content(spark, SF, 1000).collect()}
    assert got == {i: cut(t, 1000) for i, t in docs.items()}


@pytest.mark.parametrize("limit", [40, 1000])
def test_trim_same_as_sql(spark, limit):
    assert_same(selection.trim_content(spark, SF, limit), connect(SF), selection._trim_sql(limit))


def test_redact_goes_through_whole_texts(spark, tmp_path):
    texts = ["The a THE " * 500, "é" * 300 + " the end", "x" * 199 + "the", "none", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in extras.redact_root(spark, str(tmp_path)).collect()}
    assert got == {i: t and re.sub("(?i)the", "<repository>", t) for i, t in enumerate(texts)}


def tables(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    turns = [(i // 2, i % 2, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return connect(str(folder))


LONG = ["first line, and FILE: deep/x.go, then\nmore " + "wörds " * 40 + "(FILE:y.py).\nlast line", "short", "a\n\nb\n" + "z" * 500, "", "tail\n"]


def test_whole_turns_in_prompts_and_handoffs(spark, tmp_path):
    con, sf = tables(spark, tmp_path, LONG), str(tmp_path)
    prompts = {r.conv_id: r.prompt for r in review.assemble_prompts(spark, sf).collect()}
    assert prompts == {0: f"user: {LONG[0]}\nuser: {LONG[1]}", 1: f"user: {LONG[2]}\nuser: ", 2: f"user: {LONG[4]}"}
    bodies = {(r.conv_id, r.turn): r.body for r in extras.handoff_parse(spark, sf).collect()}
    assert bodies == {(i // 2, i % 2): t for i, t in enumerate(LONG)}
    assert_same(review.assemble_prompts(spark, sf), con, ORACLE_SQL["assemble_prompts"])
    assert_same(extras.handoff_parse(spark, sf), con, ORACLE_SQL["handoff_parse"])


def test_whole_texts_in_write_plans_and_selectors(spark, tmp_path):
    con, sf = tables(spark, tmp_path, LONG), str(tmp_path)
    written = {r.doc_id: r.content for r in review.write_plan(spark, sf).where("block = 1").collect()}
    assert written == dict(enumerate(LONG))
    paths = [r.sel_path for r in selection.embedded_selectors(spark, sf).where("doc_id = 0").orderBy("pos").collect()]
    assert paths == ["deep/x.go, then\nmore " + "wörds " * 40 + "(", "y.py).\nlast line", "src1/a.go, and", "en/b.py); xFILE:no (", "c.ts"]
    assert_same(review.write_plan(spark, sf), con, ORACLE_SQL["write_plan"])
    assert_same(selection.embedded_selectors(spark, sf), con, ORACLE_SQL["embedded_selectors"])


def test_limits_bite(spark):
    con, f = connect(SF), files(spark, SF)
    assert extras.scan_cap(spark, SF, 7).count() == 7
    assert_same(extras.scan_cap(spark, SF, 7), con, extras._scan_sql(7))
    assert_same(mapping.dir_scan_cap(f, 1), con, mapping._dir_sql(1))
    assert_same(mapping.topology_budget(f, 500), con, mapping._budget_sql(500))
    assert_same(mapping.topology_text(f, 500), con, mapping._text_sql(500))
    assert_same(review.review_budget(spark, SF, 300), con, review._review_sql(300))
    assert_same(selection.prompt_budget(spark, SF, 900, 50), con, selection._prompt_sql(900, 50))
    assert review.review_budget(spark, SF, 300).where("verdict = 'budget'").count() > 0
    assert N.SCAN_FILES == 10_000 and N.DIR_FILES == 250 and N.REVIEW_BYTES == N.MAP_BYTES == 524_288 and N.PROMPT_BYTES == 196_608 and N.FILE_BYTES == 51_200
