"""The numbered operators against SQL, brute force, round trips and held-out accuracy, on small rows with odd cases."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.oracle import assert_same, connect
from treeloom.llm import bpe, decontamination, html_extraction, jaccard_join, lm_scoring, quality_rules, registry, sharding, token_counts, toxicity, url_rules
from treeloom.llm.pretokens import vocabulary_text
from treeloom.llm.words import hash_words, shingle_keys

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def made_docs(seed=1):
    """Texts with near and exact copies, nulls, empties, blanks, short and long ones, repeated rows, odd spaces."""
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 12, 40, 90, 300]))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        words = t.split()
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        texts += [" ".join(words), t.upper(), t.replace(" ", "\n\t ")]
    texts += [None, "", " \n\t", "one", "one two", "One  TWO", "a b c d e", "same line\nsame line\nother", "x " * 30_000]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[5:7]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables with odd rows, and a DuckDB connection over it."""
    folder = str(tmp_path_factory.mktemp("small"))
    rnd = random.Random(2)
    docs = made_docs()
    items = [(0, " ".join(docs[4][1].split()[5:40]) if len(docs[4][1].split()) > 45 else "q w e r t y u i o p"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "one")]
    docs.append((900, "x y z " + items[1][1].upper() + " tail words here", "en", "s0", 0))
    hosts = ["good.example.org", "bad.pills.example.com", "x.net", "a.example.net", "EXAMPLE.com"]
    pages = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr', 'buy'])}/{rnd.randrange(99)}{rnd.choice(['', '?id=3', '#top', '/a.html'])}", "<p>t</p>") for i in range(300)]
    pages += [(300, None, None), (301, "no scheme", ""), (302, "http://", "x"), (303, "https://net/", "x"), (304, "http://org?x=/fr/", "x"), (None, "http://x.org/fr/1", "x")]
    labels = [(i, 0 if "pills" in u and "buy" in u else 1, 0) for i, u, _ in pages[:250]] + [(3, 1, 1), (None, 0, 1), (7, None, None)]
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, connect(folder)


@pytest.mark.parametrize("name", [n for n in registry.ORACLE_SQL if n not in ("op10_ngram_jaccard_join", "op2_quality_rules")])
def test_odd_rows_same_as_sql(spark, small, name):
    folder, con = small
    assert_same(registry.QUERIES[name](spark, folder), con, registry.ORACLE_SQL[name])


def test_quality_same_as_sql(spark, small):
    folder, con = small
    df = quality_rules.quality(spark.read.parquet(f"{folder}/documents.parquet"))
    assert_same(df, con, quality_rules.ORACLE_SQL)


def shingle_sets(rows, n):
    out = {}
    for doc_id, text, *_ in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        out[doc_id] = grams
    return out


def components(sets, num, den):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("seed", [1, 5])
def test_jaccard_join_against_all_pairs(spark, seed):
    rows = made_docs(seed)
    sets = shingle_sets(rows, 4)
    want = components(sets, 85, 100)
    # Clashing extra columns are ignored.
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", size int, hub int, component_id int")
    got = jaccard_join.jaccard_components(frame).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = jaccard_join.keep_one(frame)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d in want if want[d] == d})
    assert kept.columns == frame.columns


def test_jaccard_join_dense_families(spark):
    """Many copies with edits, some below the threshold to each other: all links between components are found."""
    rnd = random.Random(3)
    base = [rnd.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((i, " ".join(words)))
    want = components(shingle_sets(rows, 4), 85, 100)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_segments_never_miss_a_link():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        keys = rnd.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        drop = int(rnd.integers(0, max(1, 15 * n // 100) + 1))
        other = np.concatenate([keys[drop:], rnd.integers(0, 2**63, int(rnd.integers(0, drop + 1)), dtype=np.int64).astype(np.uint64)])
        pair = [np.unique(keys), np.unique(other)]
        both = len(np.intersect1d(*pair))
        if not both or 100 * both < 85 * (len(pair[0]) + len(pair[1]) - both):
            continue
        owner = np.repeat([0, 1], [len(pair[0]), len(pair[1])])
        who, segment = jaccard_join._segment_keys(owner, np.concatenate(pair), np.array([len(pair[0]), len(pair[1])]), 85, 100)
        assert set(segment[who == 0].tolist()) & set(segment[who == 1].tolist())


def test_word_keys():
    texts = ["a b a", "", " a\tb\x0b", "ab a b é"]
    words = hash_words([t.encode() for t in texts])
    assert words.counts().tolist() == [3, 0, 2, 3]
    k = words.keys
    assert k[0] == k[2] == k[3] and k[1] == k[4] and len({*k.tolist()}) == 5
    pairs, bounds = shingle_keys(words, 2)
    assert bounds.tolist() == [0, 2, 2, 3, 5] and pairs[0] == pairs[2]


def test_sharding_law(spark, small):
    folder, _ = small
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    hot = [(10_000 + i, "hot text " * 20) for i in range(400)]
    frame = spark.createDataFrame([*map(tuple, rows), *hot], "doc_id long, text string")
    got = sharding.byte_shards(frame, 8).collect()
    text = {d: t for d, t in [*map(tuple, rows), *hot]}
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in [*map(tuple, rows), *hot])
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= largest + total / 8 / 32
    assert sharding.byte_shards(frame.limit(0)).count() == 0


TEXTS = [None, "", "I'll don't 'RE 12345 ½", "<|endoftext|>x<|startoftext|> ok <|endof", "ΣΑΣ İstanbul ﬁ ẞ é    x\x1c y 你好 😀👍🏽 a\x00b", " \n\n\t x  ", "q" * 5000, "a b " * 3000, "été"]


def test_token_counts_as_the_library(spark, small):
    from tokenizers import Tokenizer

    folder, _ = small
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    vocabulary = vocabulary_text(token_counts.VOCABULARY)
    library = Tokenizer.from_str(vocabulary)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.token_counts(frame, vocabulary).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)
    assert token_counts.token_counts(frame.limit(0), vocabulary).count() == 0


def test_bpe_as_the_library_and_back(spark, small):
    import hashlib

    from tokenizers import Tokenizer

    folder, _ = small
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    vocabulary = vocabulary_text(bpe.VOCABULARY)
    library = Tokenizer.from_str(vocabulary)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.coded_digests(frame, vocabulary).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    coded = bpe.encode(frame, vocabulary)
    assert {r.doc_id: r.text for r in bpe.decode(coded, vocabulary).collect()} == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_against_edit_distance():
    terms = ["idiot", "moron", "worthless", "disgusting", "bad", "idiom"]
    trie, rnd = toxicity.FuzzyTrie([*terms, "vequ*"]), random.Random(6)
    words = set(terms) | {"vequation", "veq", ""}
    for t in terms * 40:
        w = list(t)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice("abdeimorst")]])
        words.add("".join(w))
    for w in words:
        near = [(edits(w, t), i) for i, t in enumerate(terms) if edits(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        want = min(near)[0] if near else 0 if w.startswith("vequ") else None
        found = trie.find(w)
        assert (found[1] if found else None) == want, w


def test_quotation_weighs_less_than_abuse():
    model = toxicity.Model(["idiot"], {(0, 0): 6.0}, -2.0, -5.0)
    assert model.score("you idiot go away") > model.score("an idiot it is") > model.score('the book said "idiot" once') > model.score("nothing") == model.score(None)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows)
    false = sum(r.predicted and not r.toxic for r in rows) / sum(not r.toxic for r in rows)
    assert hit >= 0.85 and false <= 0.03


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you moron " * 9, 1.0), (2, None, 2.0), (3, "", 3.0), (None, "fine text", 4.0)] + [(10 + i, "vile moron here" if i % 2 else "nice day here", 0.0) for i in range(200)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(10 + i, 1, i % 2) for i in range(200)] + [(10, 1, 0), (None, 0, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == got[None].predicted == 0
    assert got[2].score == got[3].score and got[1].held_out == (zlib.crc32(b"1") % 5 == 0)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    for known in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity.toxicity(docs, known).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_leaks_of_near_copies(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(n))) for i, n in enumerate([6, 9, 15, 22, 37, 58, 90])]
    docs, want = [], set()
    for d in range(80):
        words = [rnd.choice(WORDS) for _ in range(rnd.choice([0, 20, 300]))]
        if d % 2:
            i, text = items[d % len(items)]
            part = text.split()
            if d % 3 == 0 and len(part) > 40:
                part[20] = "CHANGED"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[5][1][: len(items[5][1]) // 2])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame, bench).select("row.doc_id", "item_id", "similarity").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.8 <= r.similarity <= 1 for r in got)
    kept = decontamination.keep_free(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == frame.columns
    assert decontamination.leaks(frame, bench.limit(0)).count() == 0 and decontamination.leaks(frame.limit(0), bench).count() == 0


def test_hamming_blocks_find_all_within_radius():
    index = decontamination.Index([(i, " ".join(f"k{i}w{j}" for j in range(30))) for i in range(20)])
    c, rnd = index.classes[0], np.random.default_rng(9)
    prints = c.prints[rnd.integers(0, len(c.prints), 500)]
    for row in range(len(prints)):
        for bit in rnd.choice(64, rnd.integers(0, 15), replace=False):
            prints[row] ^= np.uint64(1) << np.uint64(bit)
    want = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ c.prints) <= decontamination.RADIUS).tolist()}
    assert {*zip(*(x.tolist() for x in c.near(prints)), strict=True)} == want


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="top-menu"><a href=x>Home</a></div><header><h1>Site</h1></header><nav><ul><li>n</li></ul></nav>
<div class="cookie-notice">We use cookies, ok?</div><div class="post"><h1>Title</h1><p>First, para &amp; text, with <b>bold</b> and <a href=y>link</a>.</p><div class="ad">Buy, now</div>
<p>Second   para<br>line two, more words here.<ul><li>one<li>two</ul><form><label>Email</label><input></form><script>var a = "</p>";</script></div><aside>side</aside>
<section id="comments"><p>I think, this is great, really</p></section></div><footer>c</footer></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p", ""), ("<p>1<p>2</p>3", "1\n2\n3"), ('<a href="x>y', "y"), ("<div>a<!-- b", "a"), ("<script>x", ""), ("&lt;b&gt;&eacute;&#x41;", "<b>éA"),
    (PAGE, "Title\nFirst, para & text, with bold and link.\nSecond para line two, more words here.\none\ntwo"),
])
def test_extraction(html, text):
    assert html_extraction.extract(html) == text


def test_extraction_of_all_pages(spark):
    """The given pages' article text, cut out by hand."""
    import re
    from html import unescape

    for r in html_extraction.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_rules_are_mined_and_block(spark, small):
    folder, _ = small
    got = url_rules.query(spark, folder).where("rule is null and n_rules > 0")
    assert got.count() > 0 and got.where("verdict <> 'block'").count() == 0
    nodes = url_rules.query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert quality_rules.quality(docs).count() == 0 and quality_rules.keep_good(docs).columns == docs.columns
    assert lm_scoring.lm_scores(docs).count() == 0
    assert url_rules.judge(pages, labels).count() == 0 and html_extraction.main_texts(pages).count() == 0
    assert bpe.coded_digests(docs, vocabulary_text(bpe.VOCABULARY)).count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from treeloom.llm.storage import saved, table

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, docs, sf), f"test-{k}")
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        left = {r.doc_id for r in after.select("doc_id").collect()}
        if k < 4:
            assert after.columns == docs.columns and left < set(before)
        if k == 2:
            groups = components(shingle_sets(before.items(), 4), 85, 100)
            assert left == {d for d in before if groups[d] == d}
        if k == 3:
            found = {r.doc_id for r in decontamination.leaks(docs, table(spark, sf, "benchmark")).select("row.doc_id").collect()}
            assert left == set(before) - found
        docs = after
    assert left == set(before)


def test_scores_keep_apart_keys_that_share_their_high_half(spark):
    names = [b"w%d" % i for i in range(400_000)]
    high = hash_words([b" ".join(names)]).keys >> np.uint64(32)
    order = np.argsort(high, kind="stable")
    same = np.flatnonzero(np.diff(high[order]) == 0)
    assert len(same)
    pairs = [(names[order[i]].decode(), names[order[i + 1]].decode()) for i in same]
    docs = spark.createDataFrame(list(enumerate(x for pair in pairs for x in pair)), "doc_id long, text string")
    assert {(r.n_unigrams, r.n_unseen) for r in lm_scoring.lm_scores(docs).collect()} == {(0, 1)}
