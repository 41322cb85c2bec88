"""Toxicity by fuzzy lexicon matching with context windows (operator 9).

The lexicon is learned from labels: words, stems that many words begin with, and stems that two different words of a text begin
with, which are far likelier in toxic documents.  It forms a trie, and the Levenshtein automata of its terms are run on the trie together (states are made when
first reached), so misspelled terms are found in one pass over a word.  Each term and distance has a weight, learned too,
so that lookalikes among clean words count for little.  A window around each hit tells quotation and report from address.
Which weights count, and where the scores' 0.5 lies, is chosen on folds of the training rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from treeloom.llm.resident import vacate
from treeloom.llm.storage import columns, saved, table

#: Labelled rows that the lexicon and its weights are fitted on, at most about this many (chosen by a hash of doc_id).
TRAIN_ROWS = 30_000
#: Terms of the lexicon at most; stems have one of these lengths.
LEXICON, STEMS = 4_000, (4, 5, 6, 7, 8)
#: Evidence a term needs: documents, share of toxic ones, and documents times the log of its lift.
LEAST_DOCS, LEAST_SHARE, LEAST_EVIDENCE = 4, 0.7, 12.0
#: A term stays if this share of the toxic documents hold it, or this many that no more frequent term explains.
OFTEN, LEAST_NEW = 0.02, 2
#: Words of at least these lengths may be off by one edit, or two.
ONE_EDIT, TWO_EDITS = 5, 9
#: Weights under one of these don't count (words that merely look like a term); folds of the training rows tell which.
LEAST_WEIGHTS, FOLDS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0), 4
#: Weights of hits that are quoted or reported, and of hits beside an address; the window's reach in words.
QUOTED, ADDRESSED, REACH = 0.35, 1.15, 6
#: Entries of a worker's cache, and letters of the words in it.
CACHED, CACHED_LETTERS = 300_000, 40

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”„«»‹›"
# Words that report or mention speech, and that address someone.
_REPORT = frozenset("said says called quote quoted quotes quoting word term slur phrase wrote writes sagte schrieb zitat wort dit mot terme citation dijo palabra cita".split())
_ADDRESS = frozenset("you your yours youre du dich dein deine sie ihr tu toi ton ta vous votre tú usted ustedes vosotros".split())


class FuzzyTrie:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic step by step.

    A term ending in ``*`` is a stem: it matches every word that begins with it, exactly.  One ending in ``**`` takes two
    different such words (see Model).
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.allow: list[int] = [0]
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*") and not t.endswith("**")}
        self.pairs = {t[:-2]: i for i, t in enumerate(terms) if t.endswith("**")}
        self.stem_sizes, self.pair_sizes = (sorted({len(s) for s in x}, reverse=True) for x in (self.stems, self.pairs))
        for i, term in enumerate(terms):
            if term.endswith("*"):
                continue
            node, edits = 0, 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2
            self.allow[0] = max(self.allow[0], edits)
            for c in term:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                    self.allow.append(0)
                node = nxt
                self.allow[node] = max(self.allow[node], edits)
            self.end[node] = i
        self.reset()

    def reset(self) -> None:
        start = self._close({0: 0})
        self.state_of, self.states, self.step = {start: 0}, [start], [{}]
        self.accept = [self._accepts(start)]

    def _close(self, state: dict[int, int]) -> frozenset[tuple[int, int]]:
        """Adds what letters left out can reach; the fewest edits for each trie node."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            if state[node] == edits:
                for nxt in self.child[node].values():
                    if edits + 1 <= self.allow[nxt] and edits + 1 < state.get(nxt, 9):
                        state[nxt] = edits + 1
                        todo.append((nxt, edits + 1))
        return frozenset(state.items())

    def _accepts(self, state: frozenset[tuple[int, int]]) -> tuple[int, int] | None:
        found = [(edits, self.end[n]) for n, edits in state if self.end[n] >= 0 and edits <= self.allow_term(self.end[n])]
        if not found:
            return None
        edits, term = min(found)
        return term, edits

    def allow_term(self, term: int) -> int:
        size = len(self.terms[term])
        return 0 if size < ONE_EDIT else 1 if size < TWO_EDITS else 2

    def _next(self, at: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.allow[node] and edits < after.get(node, 9):
                after[node] = edits

        for node, edits in self.states[at]:
            reach(node, edits + 1)  # a letter too many
            for letter, nxt in self.child[node].items():
                reach(nxt, edits + (letter != c))
        if not after:
            self.step[at][c] = -1
            return -1
        state = self._close(after)
        to = self.state_of.get(state)
        if to is None:
            to = self.state_of[state] = len(self.states)
            self.states.append(state)
            self.step.append({})
            self.accept.append(self._accepts(state))
        self.step[at][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or of the longest stem that ``word`` begins with."""
        if len(self.states) > 200_000:
            self.reset()
        at, step = 0, self.step
        for c in word:
            to = step[at].get(c)
            at = self._next(at, c) if to is None else to
            if at < 0:
                break
        found = self.accept[at] if at >= 0 else None
        if found is None or found[1]:
            for size in self.stem_sizes:
                if (stem := self.stems.get(word[:size])) is not None:
                    return stem, 0
        return found

    def find_pair(self, word: str) -> int | None:
        """The longest ``**`` stem that ``word`` begins with."""
        return next((self.pairs[word[:size]] for size in self.pair_sizes if word[:size] in self.pairs), None)


@dataclass
class Model:
    """A lexicon with the weights of (term, edits), and the log odds of documents at large and of those without hits."""

    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    prior: float = -2.0
    bias: float = -4.0

    def __post_init__(self):
        self.trie, self.cache = FuzzyTrie(self.terms), {}

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "prior": self.prior, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(**state)

    def lookup(self, words: set[str]) -> dict[str, tuple[tuple[int, int] | None, int | None]]:
        """(nearest term, ``**`` stem) of each word that has either."""
        cache, found = self.cache, {}
        for w in words:
            hit = cache.get(w, 0)
            if hit == 0:
                if len(cache) >= CACHED:
                    cache.clear()
                hit = self.trie.find(w), self.trie.find_pair(w)
                hit = None if hit == (None, None) else hit
                if len(w) <= CACHED_LETTERS:
                    cache[w] = hit
            if hit is not None:
                found[w] = hit
        return found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(term, edits, context factor) of every hit in the text; a ``**`` stem's is that of its second best word."""
        low = text.lower()
        found = self.lookup(set(_WORD.findall(low)))
        if not found:
            return []
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        out, paired = [], {}
        for i, (w, a, b) in enumerate(words):
            if w in found:
                near = {x[0] for x in words[max(0, i - REACH) : i + REACH + 1]}
                # Between quotation marks of one line, or beside a word of report.
                lead, tail = low[max(0, a - 80) : a].rpartition("\n")[2], low[b : b + 80].partition("\n")[0]
                quoted = any(q in tail for q in _QUOTES) and sum(lead.count(q) for q in _QUOTES) % 2 == 1
                factor = QUOTED if quoted or near & _REPORT else ADDRESSED if near & _ADDRESS else 1.0
                term, pair = found[w]
                if term is not None:
                    out.append((*term, factor))
                if pair is not None:
                    own = paired.setdefault(pair, {})
                    own[w] = max(own.get(w, 0.0), factor)
        return out + [(pair, 0, sorted(own.values())[-2]) for pair, own in paired.items() if len(own) > 1]

    def odds(self, hits: list[tuple[int, int, float]]) -> float:
        """Log odds: the best hit of each (term, edits) adds its weight times the factor of its context."""
        best: dict[tuple[int, int], float] = {}
        for term, edits, factor in hits:
            if weight := self.weights.get((term, edits)):
                best[term, edits] = max(best.get((term, edits), 0.0), weight * factor)
        return self.prior + sum(best.values()) if best else self.bias

    def score(self, text: str | None) -> float:
        """0 to 1 from the log odds."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.odds(self.hits(text or ""))))))


class Hit(NamedTuple):
    """A term found in a text, with the factor of its best context."""

    term: int
    edits: int
    factor: float


class Seen(NamedTuple):
    """A labelled text's hits."""

    toxic: int
    fold: int
    hits: list[Hit]


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text (null: empty) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _terms_of(text: str | None) -> set[str]:
    """Words of a text, stems of one or more of them, and (``**``) of two different ones or more."""
    words = set(_WORD.findall((text or "").lower()))
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) >= n)
    return words | {f"{s}*" for s in stems} | {f"{s}**" for s, n in stems.items() if n > 1}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(_terms_of(text.as_py()))
    terms = list(toxic)  # a term of clean documents alone isn't wanted
    clean_in = [clean.get(t, 0) for t in terms]
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array(clean_in, pa.int64())], ["term", "toxic", "clean"])


def _clean_counts(wanted: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if not label:
                    count.update(_terms_of(text.as_py()) & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "clean"])

    return run


def _terms_held(wanted: Broadcast):
    """mapInArrow function: for each toxic document, which of the ordered terms it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(wanted.value)}
        for batch in batches:
            held = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if label:
                    held.append([place[t] for t in _terms_of(text.as_py()) if t in place])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["terms"])

    return run


def _needed(terms: list[str], count: dict[str, int], held: list[list[int]]) -> list[str]:
    """Terms, the most frequent first, that many toxic documents hold or that explain some which no term before does.

    Words that merely come along in copies of a toxic document explain none.
    """
    docs: list[set[int]] = [set() for _ in terms]
    for d, found in enumerate(held):
        for t in found:
            docs[t].add(d)
    covered, out = set[int](), []
    for t, term in enumerate(terms):
        if count[term] >= OFTEN * len(held) or len(docs[t] - covered) >= LEAST_NEW:
            out.append(term)
            covered |= docs[t]
    return out


def _hits_of(model: Broadcast):
    """mapInArrow function (text, toxic, fold) -> each document's label, fold and hits, the best factor of each (term, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                best: dict[tuple[int, int], float] = {}
                for term, edits, factor in model.value.hits(text.as_py() or ""):
                    best[term, edits] = max(best.get((term, edits), 0.0), factor)
                found.append([{"term": t, "edits": e, "factor": f} for (t, e), f in best.items()])
            kind = pa.list_(pa.struct([("term", pa.int32()), ("edits", pa.int32()), ("factor", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, kind)], ["toxic", "fold", "hits"])

    return run


def _candidates(able: dict[str, int], clean_of: dict[str, int], base: float) -> list[str]:
    """Terms that say enough, stems before the words and longer stems that they cover."""
    plain = sorted(w for w in able if not w.endswith("*"))
    terms: set[str] = set()
    for term in sorted(able, key=lambda t: (not t.endswith("**"), not t.endswith("*"), len(t), t)):
        n_toxic, n_clean = able[term], clean_of.get(term, 0)
        share, stem = n_toxic / (n_toxic + n_clean), term.rstrip("*")
        covered = any(f"{stem[:k]}{mark}" in terms for k in STEMS if k < len(term) for mark in ("*", "**") if f"{stem[:k]}{mark}" != term)
        # A stem says more than a word only where several words begin with it.
        lone = term.endswith("*") and any(able[w] >= 0.8 * n_toxic for w in plain[bisect_left(plain, stem) : bisect_left(plain, stem + chr(0x10FFFF))])
        if share >= LEAST_SHARE and n_toxic * math.log(share / base) >= LEAST_EVIDENCE and not covered and not lone:
            terms.add(term)
    return sorted(terms, key=lambda t: (-able[t], t))[:LEXICON]


def _weighed(terms: list[str], rows: list, least: float) -> Model:
    """A model of ``terms`` with weights from ``rows`` (toxic, hits); those under ``least`` are left out."""
    seen, labels, silent = Counter(), Counter(), Counter()
    for r in rows:
        labels[r.toxic] += 1
        silent[r.toxic] += not r.hits
        seen.update((h.term, h.edits, r.toxic) for h in r.hits)
    toxic, clean = labels[1], labels[0]
    odds = lambda t, e: math.log((seen[t, e, 1] + 0.5) / (toxic + 1)) - math.log((seen[t, e, 0] + 0.5) / (clean + 1))
    weights = {(t, 0): odds(t, 0) for t in range(len(terms))}
    for t, term in enumerate(terms):
        for edits in (1, 2) if not term.endswith("*") else ():
            n_seen = seen[t, edits, 1] + seen[t, edits, 0]
            # Few sightings: lean on the exact term's weight, the less the more edits.
            prior = weights[t, 0] * (0.75, 0.5)[edits - 1]
            weights[t, edits] = (odds(t, edits) * n_seen + prior * 2) / (n_seen + 2) if n_seen else prior
    weights = {k: w for k, w in weights.items() if w >= least}
    return Model(terms, weights, math.log((toxic + 0.5) / (clean + 0.5)), math.log((silent[1] + 0.5) / (silent[0] + 0.5)))


def _chosen(terms: list[str], rows: list) -> Model:
    """The weights and the cut that err least on folds whose rows had no part in the weights; the cut becomes 0.5."""
    best = (math.inf, 0.0, 0.0, 0.0)
    for least in LEAST_WEIGHTS:
        marks = []
        for fold in range(FOLDS):
            model = _weighed(terms, [r for r in rows if r.fold != fold], least)
            marks += [(model.odds(r.hits), r.toxic) for r in rows if r.fold == fold]
        marks.sort()
        # Cut before mark i: toxic ones below are missed, clean ones above are flagged.
        values, label = [m[0] for m in marks], [m[1] for m in marks]
        errors, at = sum(1 - x for x in label), 0
        while True:
            if at == len(values) or at == 0 or values[at] > values[at - 1]:
                low, high = values[at - 1] if at else values[0] - 2, values[at] if at < len(values) else values[-1] + 2
                cut = min(max((low + high) / 2, low), high)
                best = min(best, (errors, abs(cut), -least, cut))
            if at == len(values):
                break
            errors += 1 if label[at] else -1
            at += 1
    _, _, least, cut = best
    model = _weighed(terms, rows, -least)
    return Model(model.terms, model.weights, model.prior - cut, model.bias - cut)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labels (doc_id, toxic) of rows that aren't held out, on about ``rows`` of them at most.

    Without toxic or clean rows the model knows no terms and its score is constant.
    """
    context = docs.sparkSession.sparkContext
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~is_held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    n = known.count()
    if n > rows:
        known = known.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 30}) < {int(rows / n * (1 << 30))}"))
    # At most about ``rows`` labelled ids stand beside the texts; of rows that share an id the text of the least hash is taken.  Copies of a text share a fold.
    fold = F.expr(f"cast(pmod(xxhash64(text), {FOLDS}) as int)").alias("fold")
    one = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))
    train = one.select("text", "toxic", fold).repartition(24)
    train = saved(train, "toxicity-training")
    totals = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model(prior=4.0 if toxic else -4.0, bias=4.0 if toxic else -4.0)
    base = toxic / (toxic + clean)
    # Clean counts of a task are whole only for terms that its toxic documents have: they bound the share from above.
    counts = train.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = f"toxic >= {LEAST_DOCS} and toxic >= {LEAST_SHARE} * (toxic + clean) and toxic * ln(toxic / (toxic + clean) / {base}) >= {LEAST_EVIDENCE}"
    able = {r.term: r.toxic for r in counts.where(enough).orderBy(F.desc("toxic"), "term").limit(4 * LEXICON).collect()}  # bounded by the limit
    sent = context.broadcast(frozenset(able))
    clean_of = {r.term: r.n for r in train.mapInArrow(_clean_counts(sent), "term string, clean long").groupBy("term").agg(F.sum("clean").alias("n")).collect()}
    terms = _candidates(able, clean_of, base)
    listed = context.broadcast(terms)
    held = train.where("toxic = 1").mapInArrow(_terms_held(listed), "terms array<int>").collect()  # at most about ``rows`` rows
    terms = _needed(terms, able, [r.terms for r in held])
    shared = context.broadcast(Model(terms))
    # At most about ``rows`` rows, of the few hits of a text each.
    hits = train.mapInArrow(_hits_of(shared), "toxic int, fold int, hits array<struct<term: int, edits: int, factor: double>>").collect()
    for done in (sent, listed, shared):
        done.destroy()
    return _chosen(terms, [Seen(r.toxic, r.fold, [Hit(*h) for h in r.hits]) for r in hits])


def _scorer(model: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()  # the model lives as long as its broadcast
        for batch in batches:
            scores = [model.value.score(t.as_py()) for t in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64())], [*batch.schema.names[:width], "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and its score; null texts count as empty."""
    packed = docs.select(F.struct(*columns(docs)).alias("row"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return packed.mapInArrow(_scorer(shared, 1), StructType([packed.schema["row"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    Only the text counts for a score; texts without hits, empty and null ones share the least score.  Repeated rows and
    null ids (held out) are scored each; an empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with their columns (names of any kind); odd rows as in toxicity()."""
    return scored(docs, fit(docs, labels)).where("score < 0.5").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_toxicity over the whole of ``documents``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
