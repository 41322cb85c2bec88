"""Odd column names and odd rows for every operator and pipeline stage; limits, scores and recall against brute force."""

import math
import random
import time
from collections import Counter

import pytest

from tests.llm.test_llm_operators import WORDS, edits
from treeloom.llm import bpe, decontamination, html_extraction, jaccard_join, lm_scoring, quality_rules, sharding, token_counts, toxicity, url_rules
from treeloom.llm.pretokens import vocabulary_text

ODD = ["a b", "a.b", "x:y", "row", "score", "size", "kept", "hi", "part", "text_crc32", "tokens", "host"]
TEXTS = [None, "", " ", "one", "good words in a row " * 5, "good words in a row " * 5, "vile moron " * 20, "alpha beta gamma delta epsilon zeta eta theta iota kappa"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, repeated rows, and extra columns that clash with the operators' own."""
    rows = [(i, t, "en", None if i % 2 else "s", 0, *([i] * len(ODD))) for i, t in enumerate(TEXTS)] + [(None, "text of no id", None, None, None, *([9] * len(ODD)))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in ODD)
    return spark.createDataFrame(rows + rows[4:6], kind)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 6)) for i in range(8)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, TEXTS[-1]), (2, None), (3, "")], "item_id long, text string")


def test_filters_keep_columns_and_odd_rows(docs, labels, benchmark):
    everyone = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for kept in (quality_rules.keep_good(docs), decontamination.keep_free(docs, benchmark), toxicity.keep_clean(docs, labels), jaccard_join.keep_one(docs)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert not Counter(r.doc_id for r in kept.select("doc_id").collect()) - everyone
    assert {r.doc_id for r in decontamination.keep_free(docs, benchmark).collect()} == set(everyone) - {7}
    assert {r["row"]["a.b"] for r in decontamination.leaks(docs, benchmark).collect()} == {7}
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == set(everyone) - {5}
    assert decontamination.keep_free(docs, benchmark.limit(0)).count() == docs.count()
    for f in (quality_rules.keep_good, jaccard_join.keep_one, lambda d: decontamination.keep_free(d, benchmark), lambda d: toxicity.keep_clean(d, labels)):
        assert f(docs.limit(0)).count() == 0


def test_row_operators_take_odd_columns(docs):
    n = docs.count()
    vocabularies = vocabulary_text(token_counts.VOCABULARY), vocabulary_text(bpe.VOCABULARY)
    for got in (lm_scoring.lm_scores(docs), sharding.byte_shards(docs), token_counts.token_counts(docs, vocabularies[0]), bpe.coded_digests(docs, vocabularies[1]), quality_rules.quality(docs), jaccard_join.jaccard_components(docs)):
        assert got.count() == n


def test_page_operators_take_odd_columns(spark, labels):
    kind = "page_id long, url string, html string, " + ", ".join(f"`{c}` int" for c in ODD)
    rows = [(1, None, None), (None, "http://x.net/a?b#c", "<p>t"), (3, "no scheme", ""), (3, "no scheme", "")]
    pages = spark.createDataFrame([(*r, *([1] * len(ODD))) for r in rows], kind)
    assert html_extraction.main_texts(pages).count() == url_rules.judge(pages, labels).count() == 4


LONG = "Long text of the article, with commas, that goes on and on until it scores well beside the rest of the page. " * 6


@pytest.mark.parametrize(("html", "text"), [
    ('<article><p>A, b.</p><ul><li><a href=x>Source one</a><li><a href=y>Source two</a></ul></article>', "A, b.\nSource one\nSource two"),
    ('<article><p class="widget-text">One.</p><p class="social-history">Two.</p><p class="reply-intro">Three.</p><p class="ad-box">Buy</p></article>', "One.\nTwo.\nThree."),
    (f'<div class="content with-sidebar"><p>{LONG}</p></div><div class="sidebar-left"><p>{LONG}</p></div>', LONG.strip()),
    (f"<div><div><p>{LONG}</p></div><h2>Next</h2><div>Short.</div><div><p>{LONG}</p></div></div>", f"{LONG.strip()}\nNext\nShort.\n{LONG.strip()}"),
    ('<div class="comments">Only this, in noise.</div>', "Only this, in noise."), ('<div class="related-posts">x</div><p>y</p>', "y"),
])
def test_article_text_stays(html, text):
    assert html_extraction.extract(html) == text


@pytest.mark.parametrize("page", [lambda n: "<div><b>x" * n + "</i></span></p></table>" * n, lambda n: "<i><div>" + "<b>x</i><center>y<li>z" * n, lambda n: "<p><a>" * n + "</p>" * n, lambda n: "<table><tr><td>" * n + "t" + "<td>" * n])
def test_extraction_is_linear(page):
    began = time.process_time()
    html_extraction.extract(page(2_000))
    small = time.process_time() - began
    html_extraction.extract(page(20_000))
    assert time.process_time() - began - small < 40 * max(small, 0.02)


def test_template_tokens_are_mined_as_one(spark):
    """25 constant query keys would have 2**25 frequent sets; weak evidence makes no rule."""
    keys = "&".join(f"k{i}=1" for i in range(25))
    rows = [(i, f"http://a.example/{'bad' if i % 4 == 0 else 'good'}/{i}?{keys}", "") for i in range(400)] + [(1000 + i, f"http://b.example/few/{i}", "") for i in range(8)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)] + [(1000 + i, int(i > 4), 0) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_rules.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all((got[i].verdict == "block") == (i % 4 == 0) for i in range(400))
    assert all(got[1000 + i].verdict == "allow" for i in range(8))


def test_stages_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    plain = docs.drop(*ODD)
    spark.createDataFrame([(6, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[-1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for frame, n in ((plain, plain.count()), (plain.limit(0), 0)):
            after = stage(spark, frame, str(tmp_path))
            assert after.count() <= n
            assert k == 4 or after.columns == plain.columns


def test_limits_follow_their_group(spark):
    rnd = random.Random(3)
    text = lambda marks: " ".join(rnd.choice(WORDS) + ("#" if rnd.random() < marks else "") for _ in range(200))
    rows = [(i, text(0.3), "en", "marked") for i in range(200)] + [(500 + i, text(0), "en", "bare") for i in range(200)] + [(1000, text(0.3), "en", "bare")]
    rows += [(2000 + i, " ".join("langeswort" for _ in range(9)) + f" {i} " + text(0), "de", "s") for i in range(100)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0].kept and got[500].kept and not got[1000].kept and not got[1000].base_failed
    assert got[0].symbol_rate_most > got[500].symbol_rate_most and got[500].word_length_most != got[2000].word_length_most


def test_limits_differ_on_the_given_tables(spark):
    rows = quality_rules.query(spark, "/root/testdata/sf0.01").collect()
    for name in ("upper_rate_most", "repeat_rate_most", "word_length_most", "word_length_least"):
        assert len({r[name] for r in rows}) > 1, name


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choice(WORDS) for _ in range(50)), "en", f"s{i % 7}") for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(map(tuple, quality_rules.quality(frame).collect()))
    monkeypatch.setattr(quality_rules, "FEW_GROUPS", 0)
    assert sorted(map(tuple, quality_rules.quality(frame).collect())) == want


def test_whole_scores_against_brute_force():
    """Words, stems and pairs of stems by edit distance, term by term."""
    terms = ["moron", "worthless", "vequ*", "zorb**"]
    weights = {(0, 0): 5.0, (0, 1): 3.0, (1, 0): 6.0, (1, 1): 4.0, (1, 2): 2.0, (2, 0): 4.5, (3, 0): 4.0}
    model, rnd = toxicity.Model(terms, weights, -2.0, -4.0), random.Random(5)
    words = ["moron", "morom", "worthles", "worthxxss", "vequation", "zorba", "zorbe", "zorbi", "plain", "you", "said", "table", "lamp", "river", "stone"]
    for _ in range(300):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 25))]
        best = {}
        for i, w in enumerate(text):
            near = set(text[max(0, i - toxicity.REACH) : i + toxicity.REACH + 1])
            factor = toxicity.QUOTED if "said" in near else toxicity.ADDRESSED if "you" in near else 1.0
            found = [(e, t) for t, term in enumerate(terms[:2]) if (e := edits(w, term)) <= (1 if len(term) < 9 else 2)]
            if found:
                e, t = min(found)
                best[t, e] = max(best.get((t, e), 0), factor * weights[t, e])
            if w.startswith("vequ"):
                best[2, 0] = max(best.get((2, 0), 0), factor * 4.5)
            if w.startswith("zorb"):
                best.setdefault("zorb", {}).setdefault(w, []).append(factor)
        pair = sorted(max(f) for f in best.pop("zorb", {}).values())
        if len(pair) > 1:
            best[3, 0] = pair[-2] * 4.0
        odds = -2.0 + sum(best.values()) if best else -4.0
        assert math.isclose(model.score(" ".join(text)), 1 / (1 + math.exp(-odds)), rel_tol=1e-12), text


def weighted_jaccard(a, b):
    both = (a & b).total()
    return both / max(1, a.total() + b.total() - both)


def brute_stretch(text, item, threshold):
    """(similarity, first word) of the first best item-sized stretch of those in which a shingle stands as in the item."""
    shingles = lambda w: [tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)]
    last, want = max(0, len(text) - len(item)), shingles(item)
    starts = {min(max(p - q, 0), last) for p, x in enumerate(shingles(text)) for q, y in enumerate(want) if x == y}
    found = [(weighted_jaccard(Counter(shingles(text[s : s + len(item)])), Counter(want)), -s) for s in starts]
    best = max(found, default=(0, 0))
    return (best[0], -best[1]) if best[0] >= threshold else None


@pytest.mark.parametrize("pairs", [decontamination.PAIRS, 0])
def test_best_stretch_is_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    rnd, hits = random.Random(5), 0
    for n in range(600):
        item = [rnd.choice("ab" if n % 2 else "abcdefgh") for _ in range(rnd.randrange(2, 40))]
        text = [rnd.choice("ab") for _ in range(rnd.randrange(20))] + item[: rnd.choice([40, 40, 8])] + [rnd.choice("ab") for _ in range(rnd.randrange(20))]
        index = decontamination.Index([(1, " ".join(item))])
        keys = decontamination.hash_words([" ".join(text).encode()]).keys
        got = decontamination._best_stretch(keys, index.item(0), len(item), True, True, 0.3)
        assert got == brute_stretch(text, item, 0.3), (text, item)
        hits += got is not None
    assert hits > 300


def test_repeated_words_are_linear():
    began = time.process_time()
    for words, item in (("spam " * 40_000, "spam " * 20_000), ("a b " * 20_000, "a b " * 200), ("spam " * 20_000, "spam " * 50)):
        index = decontamination.Index([(1, item)])
        w = decontamination.hash_words([words.encode()], lower=True)
        assert index.search(w.keys, w.first, 0.8) == [(0, 1, 0, 1.0)]
    assert time.process_time() - began < 5


def test_recall_near_the_threshold():
    rnd, found, near = random.Random(11), 0, 0
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(n))) for i, n in enumerate([50, 70, 120, 250, 500] * 20)]
    index = decontamination.Index(items)
    for i, text in items:
        words = text.split()
        want = Counter(decontamination._shingles(index.words[i]).tolist())
        # Change words apart from each other until similarity would fall under 0.8.
        copy = list(words)
        for at in rnd.sample(range(len(words)), len(words)):
            trial = copy[:at] + ["changed"] + copy[at + 1 :]
            keys = decontamination.hash_words([" ".join(trial).encode()], lower=True).keys
            if weighted_jaccard(Counter(decontamination._shingles(keys).tolist()), want) < 0.8:
                break
            copy = trial
        doc = [rnd.choice(WORDS) for _ in range(rnd.randrange(300))] + copy + [rnd.choice(WORDS) for _ in range(100)]
        w = decontamination.hash_words([" ".join(doc).encode()], lower=True)
        near += 1
        found += any(h[1] == i for h in index.search(w.keys, w.first, 0.8))
    assert found >= 0.95 * near
