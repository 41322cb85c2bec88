"""Raw elements and reader comments of pages, skewed ids, training rows, limits by level."""

import pytest
from pyspark.sql import functions as F

from treeloom.llm import html_extraction, jaccard_join, lm_scoring, quality_rules, toxicity

PARAGRAPHS = [f"Paragraph {i} of the article, with some length, commas, and words that go on for a while so that it scores." for i in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(PARAGRAPHS)
COMMENTS = "".join(f"<p>Comment {i}, by a reader, who writes at length, with commas, and with more words than the article has, again and again and again.</p>" for i in range(8))


@pytest.mark.parametrize("page", [
    "<title>About <!-- comments</title><article>{0}</article>", "<Script>document.write('<!-- ad')</Script><article>{0}</article>", "<Script>if (a<b) x()</Script><article>{0}</article>", "<iframe><!-- x</iframe><article>{0}</article>", "<STYLE>p > a{{}} <!-- </STYLE><article>{0}</article>",
    "<article>{1}<textarea><!-- x</textarea>{2}</article>", "<article>{0}</article><script>open", "<style/><article>{0}</article>", "<template><template><p>t</p></template><p>u</p></template><article>{0}</article>", "<TITLE>a <script></TITLE><article>{0}</article>",
    "<article>{0}</article><div class='reader-comments'>{3}</div>", "<div><div class='txt'>{0}</div></div><div class='reader-comments'>{3}</div>", "<article>{0}</article><div id='user-comments-thread'>{3}</div>", "<article>{0}</article><section class='userComments'>{3}</section>",
    "<article>{0}</article><ol class='article-comments'>{3}</ol>", "<article class='comments-open'>{0}</article>", "<div class='has-comments main'>{0}</div>",
])
def test_pages(page):
    html = page.format(ARTICLE, ARTICLE[: ARTICLE.index("<p>Paragraph 2")], ARTICLE[ARTICLE.index("<p>Paragraph 2") :], COMMENTS)
    assert html_extraction.extract(html) == WANT


def test_unclosed_raw_elements_are_linear():
    import time

    began = time.process_time()
    html_extraction.extract("<style/><p>x" * 20_000 + "<title>" * 20_000)
    assert time.process_time() - began < 5


def test_equal_and_null_ids_fall_into_many_parts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 2_000)
    rows = [(None, f"a b c {i % 7} d e") for i in range(600)] + [(5, "same text of one id")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    plain = sorted(map(tuple, lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert sorted(map(tuple, lm_scoring.lm_scores(docs).collect()), key=str) == plain and len(plain) == 1200
    frame, (path, start, number) = lm_scoring._split_of(docs)
    parts = frame.select(F.pmod(F.xxhash64("doc_id", "text", number), F.lit(16)).alias("p")).groupBy("p").count()
    assert parts.count() == 16 and parts.agg(F.max("count")).first()[0] < 150


def test_a_labelled_id_gives_one_training_row(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, f"vile words {i}") for i in range(300)] + [(i, f"plain words {i}") for i in range(60)], "doc_id long, text string")
    counted = []
    saved = toxicity.saved

    def counting(df, name):
        out = saved(df, name)
        counted.append((name, out.count()))
        return out

    toxicity.saved = counting
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.saved = saved
    assert dict(counted)["toxicity-training"] <= 60


def test_sparse_groups_take_the_limits_of_the_next_level(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_DOCS", 5)
    rows = [("en", "big", i) for i in range(9)] + [("en", "rare", 100)] + [("fr", f"s{i}", i) for i in range(6)] + [("de", "x", 7)]
    frame = spark.createDataFrame([(*r, *[r[2]] * (len(quality_rules.MEASURES) - 1)) for r in rows], "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURES))
    got = {(r.lang, r.source): tuple(r)[2:] for r in quality_rules.thresholds(frame).collect()}
    assert len(got) == 9 and got["en", "rare"] != got["en", "big"] and len({got["fr", f"s{i}"] for i in range(6)}) == 1 and got["de", "x"] not in (got["fr", "s0"], got["en", "rare"])


def test_hot_segments_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUB_SAMPLE", 2)
    monkeypatch.setattr(jaccard_join, "HUB_LEAST", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:k], f"own{i}", *base[k + 1 :]])) for i, k in enumerate([5 + i % 100 for i in range(120)])] + [(500 + i, " ".join(base)) for i in range(20)] + [(900, "another text of its own kind here")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(120)} | {got[500 + i] for i in range(20)} == {0} and got[900] == 900
