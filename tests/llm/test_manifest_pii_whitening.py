"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tests.llm.test_llm_operators import DOCS, SF, made_docs
from tests.oracle import assert_same, connect
from treeloom.llm import merkle, pii, registry, whitening

CLASH = ["tree", "node", "idx", "nodes", "block", "path", "part", "x", "n", "a b", "a.b", "items"]


def clashing(spark, rows, kind):
    return spark.createDataFrame([(*r, *([1] * len(CLASH))) for r in rows], kind + "".join(f", `{c}` int" for c in CLASH))


# Operator 11


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by the definition, whole trees in memory."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, at):
        out = []
        for level in tree[:-1]:
            first = at - at % 3
            out.append((level[first:at], level[at + 1 : first + 3]))
            at //= 3
        return out

    sources = {}
    for i, text, lang, source, n in rows:
        def leaf(t, i=i, source=source, lang=lang, n=n):
            return h("".join(map(part, (i, source, lang, n, t))))

        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        sources.setdefault(source, []).append(((i is not None, i or 0), leaf(text), leaf(text.replace("\n", "") if even and text is not None else text), i))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(sources[s], key=lambda x: x[:2])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, leaf, tampered, i) in enumerate(sorted(sources[s], key=lambda x: x[:2])):
            steps = way(trees[s], at) + way(top, k)
            folded = tampered
            for left, right in steps:
                folded = h("".join([*left, folded, *right]))
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h("".join(x for a, b in steps for x in a + b)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("rows", [
    made_docs(4) + [(None, "no\nid", None, None, None), (None, None, None, "", 0)],
    [(i, f"line {i}\nline", "en", "hot" if i % 3 else f"s{i}é", 5) for i in range(700)],
    [(7, "only\none", "en", "s", 1)],
    [(1, "same\nrow", "en", "s", 1)] * 200,
])
def test_manifest_is_the_definition(spark, rows):
    got = merkle.manifest(clashing(spark, rows, DOCS).repartition(5)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_manifest(rows), key=str)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_is_its_sql(spark):
    assert_same(registry.QUERIES["op11_merkle_manifest"](spark, SF), connect(SF), registry.ORACLE_SQL["op11_merkle_manifest"])


# Operator 12

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def valid(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m.group())] for k, p in PATTERNS.items()}


def test_base_spans_of_random_texts():
    rnd, finder = random.Random(12), pii.Finder()
    for letters in ("a@.1+2 -()4%_:/é0", "0123456789 -.+()", "1.2", "+1( 5", "a@b.c+-"):
        for _ in range(4000):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(45)))
            found = finder.spans(text)
            assert {k: found[k] for k in pii.KINDS[:4]} == brute_base(text), text


def test_personal_data_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, "a@b.cd é@x.y"), (None, None), (3, ""), (3, "")]
    got = pii.personal_data(clashing(spark, rows, "doc_id long, text string"))
    want = []
    for i, text in rows:
        base = brute_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k])
        want.append((i, *(len(base[k]) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pii.personal_data(got.sparkSession.createDataFrame([], "doc_id long, text string")).collect() == []
    assert {r.text for r in pii.masked(clashing(spark, [(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string")).collect()} == {"mail <email> now", ""}


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mailto:bob@intranet", "contact", "bob@intranet"), ("call TEL:0049 30 1234567.", "contact", "0049 30 1234567"), ("see https://joe:pw1@host.example.com/a", "login", "joe:pw1"),
    ("IBAN: DE89 3704 0044 0532 0130 00 und mehr", "iban", "DE89 3704 0044 0532 0130 00"), ("iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"), ("IBAN: DE88 3704 0044 0532 0130 00", "iban", None),
    ("Passport No. C01X00T478 ok", "account", "C01X00T478"), ("İ SSN: 123-45-6789.", "account", "123-45-6789"), ("account number is 12345678 and more", "account", "12345678"), ("account number of 12 years", "account", None),
    ("mailto:a@b.cd", "contact", None), ("passports 1234567", "account", None), ("acct 4012888888881881", "account", None),
])
def test_added_spans(text, kind, span):
    assert [text[a:b] for a, b in pii.Finder().spans(text)[kind]] == ([span] if span else [])


@pytest.mark.parametrize("text", ["1" * 300_000, "+1" * 150_000, "a@" * 150_000, "1." * 150_000, "iban " * 60_000, "://" * 100_000, "a" * 300_000 + "@", "a.b@c.d " * 40_000, "1 " * 150_000, "acct 12345678 " * 20_000, "+1" + " " * 300_000])
def test_finder_is_linear(text):
    began = time.process_time()
    pii.Finder().spans(text)
    assert time.process_time() - began < 5


# Operator 13


def brute_whitened(vectors, dims):
    """x rows, centre, eigenvalues and eigenvectors of the distinct ones."""
    x = np.array([[*(int(np.floor(64 * float(c))) for c in v), *([0] * (dims - len(v)))] for v in vectors]) + 1_000_000
    fit = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov((fit - fit.mean(axis=0)).T, bias=True).reshape(dims, dims))
    return x, fit, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize(("n", "dims"), [(300, 40), (60, 5), (30, 80), (2, 3)])
def test_whitening_is_the_eigenbasis(spark, n, dims):
    rnd = np.random.default_rng(n)
    vectors = (rnd.standard_normal((n, dims)) * np.linspace(3, 0.5, dims)).astype("float32").tolist()
    rows = [(i, v) for i, v in enumerate(vectors + vectors[:5] * 3)] + [(None, vectors[0]), (5, None), (6, [float("nan")] * dims), (6, [None, *vectors[0][1:]]), (7, [float("inf"), *vectors[0][1:]])]
    got = whitening.whitened(clashing(spark, rows, "vec_id long, embedding array<float>").repartition(4)).toPandas()
    used = rows[:-4]
    x, fit, values, axes = brute_whitened([v for _, v in used], dims)
    k = min(16, dims, int((values > 1e-9).sum()))
    assert len(got) == k * len(used) and set(got.n) == {len(fit)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-8
    deviation = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    order = [i for i, _ in used]
    for c in range(k):
        rows_of = got[got.component == c + 1]
        z = (x - fit.mean(axis=0)) @ axes[:, c] / np.sqrt(values[c])
        mine = rows_of.set_index("vec_id").whitened
        sign = np.sign((mine.loc[1:1].iloc[0]) * z[1])
        for i, (vec, value) in enumerate(zip(order, z, strict=True)):
            if vec is not None:
                assert abs(np.atleast_1d(mine.loc[vec]) - sign * value).min() < 1e-7
                assert set(np.atleast_1d(rows_of.set_index("vec_id").deviation.loc[vec])) == {deviation[i]}
        assert np.allclose(rows_of.explained, values[c] / values.sum(), rtol=1e-9)


def test_filter_certifies_close_eigenvalues():
    rnd = np.random.default_rng(1)
    axes = np.linalg.qr(rnd.standard_normal((300, 300)))[0]
    values = np.concatenate([[500.0], np.linspace(70, 60, 40), np.linspace(55, 1, 259)])
    passes = [0]

    def times(q):
        passes[0] += 1
        return axes @ (values[:, None] * (axes.T @ q))

    found, vectors = whitening.leading_pairs(times, 300, 16)
    assert np.allclose(found, values[:16], rtol=1e-12) and np.abs(np.abs(np.diag(axes[:, :16].T @ vectors)) - 1).max() < 1e-12 and passes[0] < 150


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    white = lambda rows: whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert white([]) == white([(1, None)]) == white([(1, []), (2, [])]) == white([(1, [1.0, 2.0])] * 3) == []
    mixed = white([(1, [1.0]), (2, [1.0, 2.0]), (3, []), (4, [0.5, -1.0])])
    assert {r.vec_id for r in mixed} == {1, 2, 3, 4} and {r.component for r in mixed} == {1, 2}
    huge = white([(1, [1e300]), (2, [0.0]), (3, [-1e300])])
    assert len(huge) == 3 and all(np.isfinite(r.whitened) for r in huge) and huge[0].deviation is None
