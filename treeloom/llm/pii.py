"""Personal data by anchor expansion (operator 12).

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs before digits, schemes and identifier cues ("iban",
"passport", ...).  Small deterministic parsers expand each anchor to its bounds and validate what they find; runs of digits
anchor addresses of machines and card numbers.  No parser walks back over a text again, so costs are linear in its length.

Base spans are those of four fixed patterns, leftmost and non-overlapping for each kind, kept only if valid.  The method adds
spans of further kinds where an anchor vouches for them:

* ``contact``: an address behind ``mailto:``, ``sip:``, ``sips:`` or ``xmpp:`` and a number of 8 to 15 digits behind ``tel:``, ``sms:`` or ``callto:`` that are no base span;
* ``login``: user and password before the at-sign of an address behind ``://``;
* ``iban``: behind its cue, of the country's form, with the right remainder by 97;
* ``account``: behind another cue, at least five digits in 5 to 24 letters, digits and single separators.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.resident import vacate
from treeloom.llm.storage import table

Span = tuple[int, int]

#: Kinds in the order of the result; the first four are the base's.
KINDS = ("email", "ip", "card", "phone", "contact", "login", "iban", "account")
ADDRESS_SCHEMES, NUMBER_SCHEMES = ("mailto:", "sip:", "sips:", "xmpp:"), ("tel:", "sms:", "callto:")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = (
    "account number", "account no", "acct no", "acct", "bank account", "routing number", "sort code", "ssn", "social security number", "passport", "driver license", "driving licence", "tax id", "taxpayer id",
    "kontonummer", "reisepassnummer", "reisepass", "steuernummer", "steuer-id", "sozialversicherungsnummer",
    "numéro de compte", "numéro de passeport", "passeport", "numéro fiscal", "sécurité sociale",
    "número de cuenta", "pasaporte", "seguridad social", "dni", "nif",
)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]+")
_NUMBER = re.compile(r"\+?[0-9][0-9(). -]*")
#: What may stand between a cue and its identifier.
_LINK = re.compile(r"(?:[ \t]?(?:numbers?|number|no|nr|num|code|id|is|ist|est|es)\b\.?)?[ \t]{0,3}[:=#]?[ \t]{0,3}(?:is\b[ \t]{0,3})?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_ACCOUNT = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[A-Za-z0-9]){4,23}")
_AUTHORITY = re.compile(r"[^\s/?#@<>\"']+@")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_FIVE_DIGITS = re.compile(r"(?:[^0-9]*[0-9]){5}")
_AT, _PLUS, _AUTHORITY_MARK, _ADDRESS, _CALL, _IBAN_CUE, _CUE = range(7)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in ((_AT, "@"), (_PLUS, [f"+{d}" for d in range(10)]), (_AUTHORITY_MARK, ["://"]), (_ADDRESS, ADDRESS_SCHEMES), (_CALL, NUMBER_SCHEMES), (_IBAN_CUE, IBAN_CUES), (_CUE, ACCOUNT_CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    """Remainder 1 by 97 with the first four characters moved to the end and letters as numbers from 10 on."""
    plain = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _lower(text: str) -> str:
    """``text`` in lower case with the same offsets."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _word_start(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


class Finder:
    """Spans of a text by kind."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> dict[str, list[Span]]:
        found: dict[str, list[Span]] = {k: [] for k in KINDS}
        done = {"email": 0, "phone": 0}
        for last, (kind, size) in self.anchors.iter(_lower(text)):
            start = last + 1 - size
            if kind == _AT:
                self._email(text, start, done, found)
            elif kind == _PLUS:
                self._phone(text, start, done, found)
            elif kind == _AUTHORITY_MARK:
                self._login(text, last + 1, found)
            elif _word_start(text, start):
                if kind == _ADDRESS:
                    self._contact(text, last + 1, found)
                elif kind == _CALL:
                    self._number(text, last + 1, found)
                elif last + 1 == len(text) or not text[last + 1].isalpha():
                    self._identifier(text, last + 1, kind, found)
        self._digit_runs(text, found)
        return self._settled(found)

    @staticmethod
    def _email(text: str, at: int, done: dict[str, int], found: dict[str, list[Span]]) -> None:
        # The local part can't reach over an at-sign or into the match before; without a domain no other start helps.
        domain = _LABEL.match(text, at + 1)
        end = domain.end() if domain else 0
        dots = 0
        while domain and text[end : end + 1] == "." and (domain := _LABEL.match(text, end + 1)):
            end, dots = domain.end(), dots + 1
        if not dots:
            return
        start = at
        while start > done["email"] and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at:
            found["email"].append((start, end))
            done["email"] = end

    @staticmethod
    def _phone(text: str, start: int, done: dict[str, int], found: dict[str, list[Span]]) -> None:
        tail = _PHONE_TAIL.match(text, start + 2)
        if tail is None or start < done["phone"]:
            return
        end = tail.end()
        while end > start + 3 and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end > start + 3:  # something between the first digit and the last one
            done["phone"] = end
            if 8 <= sum("0" <= c <= "9" for c in text[start:end]) <= 15:
                found["phone"].append((start, end))

    @staticmethod
    def _digit_runs(text: str, found: dict[str, list[Span]]) -> None:
        for run in _CARD_RUN.finditer(text):
            digits = run.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(run.span())
        parts: list[Span] = []
        for run in _DIGITS.finditer(text):
            if not parts or text[parts[-1][1] : run.start()] != ".":
                parts.clear()
            parts.append(run.span())
            if len(parts) == 4:
                if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in parts):
                    found["ip"].append((parts[0][0], parts[3][1]))
                parts.clear()

    @staticmethod
    def _login(text: str, at: int, found: dict[str, list[Span]]) -> None:
        if len(text) - at > 1 and (who := _AUTHORITY.match(text, at, at + 256)):
            found["login"].append((at, who.end() - 1))

    @staticmethod
    def _contact(text: str, at: int, found: dict[str, list[Span]]) -> None:
        sign = text.find("@", at, at + 65)
        if sign > at and _LOCAL_RUN.match(text, at, sign) and (domain := _LABEL.match(text, sign + 1)):
            end = domain.end()
            while text[end : end + 1] == "." and (domain := _LABEL.match(text, end + 1)):
                end = domain.end()
            found["contact"].append((at, end))

    @staticmethod
    def _number(text: str, at: int, found: dict[str, list[Span]]) -> None:
        if (run := _NUMBER.match(text, at, at + 40)) and 8 <= sum(c.isdigit() for c in run.group()) <= 15:
            found["contact"].append((at, at + len(run.group().rstrip(" ().-"))))

    @staticmethod
    def _identifier(text: str, at: int, kind: int, found: dict[str, list[Span]]) -> None:
        at = _LINK.match(text, at).end()
        if kind == _IBAN_CUE:
            if run := _IBAN.match(text, at):
                # Groups of four end at a space: words behind the last one are let go, one after the other.
                end = run.end()
                while end - at > 14:
                    if not text[end : end + 1].isalnum() and valid_iban(text[at:end]):
                        found["iban"].append((at, end))
                        return
                    end = text.rfind(" ", at, end)
        elif (run := _ACCOUNT.match(text, at)) and not text[run.end() : run.end() + 1].isalnum():
            end = run.end()
            while end > at and not any("0" <= c <= "9" for c in re.split(r"[ -]", text[at:end])[-1]):
                end = max(text.rfind(" ", at, end), text.rfind("-", at, end))  # words behind the number
            if end > at and _FIVE_DIGITS.match(text[at:end]):
                found["account"].append((at, end))

    @staticmethod
    def _settled(found: dict[str, list[Span]]) -> dict[str, list[Span]]:
        """Added spans that no span of an earlier kind, and no other one of their own, covers."""
        taken = [s for k in KINDS[:4] for s in found[k]]
        for kind in KINDS[4:]:
            if found[kind]:
                taken.sort()
                starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
                kept: list[Span] = []
                for start, end in sorted(set(found[kind]), key=lambda s: (s[0], -s[1])):
                    before = bisect_right(starts, start)
                    if (not before or reach[before - 1] < end) and (not kept or kept[-1][1] < end):
                        kept.append((start, end))
                found[kind] = kept
                taken += kept
        return found


def digest_text(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by kind as listed, then by start."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _rows(docs: DataFrame, names: list[str], types: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        finder = Finder()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [row(text, finder.spans(text)) for text in (t.as_py() or "" for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*made, strict=True))] if made else [part.column(0), *(pa.array([]) for _ in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs`` (doc_id, text).

    Counts and the digest are of base spans, ``spans`` are all.  Offsets are code points, ends exclusive.  Null and empty texts
    have no spans: counts 0, spans empty.  Repeated rows and null ids are returned each; an empty table gives no rows.
    """

    def row(_: str, spans: dict[str, list[Span]]) -> tuple:
        base = digest_text(spans, KINDS[:4])
        return *(len(spans[k]) for k in KINDS[:4]), hashlib.sha256(base.encode()).hexdigest(), digest_text(spans, KINDS)

    return _rows(docs, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", row)


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets; null texts become empty, spans that overlap are joined under the first one's kind."""

    def row(text: str, spans: dict[str, list[Span]]) -> tuple:
        out, at = [], 0
        for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return ("".join([*out, text[at:]]),)

    return _rows(docs, ["text"], "text string", row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_pii_anchors over the whole of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
