"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and the cues of account numbers and streets. A local parser for each
kind of anchor expands it to both sides, settles where the item begins and
ends, and validates it. Parsers go forward only: what one of a kind has read
is not read again by that kind, so a text costs time linear in its length.

Kinds email, ip, card and phone are the base. Added are sign-in data in an
address (login, which may hold a base span) and, where they overlap no base
span, numbers behind a scheme (tel), checked account numbers (iban), numbers
behind a cue (account) and house numbers with a street (street).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import boxed, chunks, clean, ready, unboxed

KINDS = ("email", "ip", "card", "phone", "login", "tel", "iban", "account", "street")
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TEL = re.compile(r"[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]{1,256}+@[A-Za-z0-9.-]{1,253}+(?::[0-9]{1,5}+)?+")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}\Z")
IBAN = re.compile(r"[ \t]{0,2}+[:#=]?+[ \t]{0,2}+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)")
ACCOUNT = re.compile(r"[ \t]{0,2}+(?:(?:number|num|no|nr|id)\b\.?+)?+[ \t]{0,2}+[:#=]?+[ \t]{0,2}+([0-9](?:[ -]?[0-9]){5,16}+)(?![0-9A-Za-z]|[ -][0-9])", re.IGNORECASE)
HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]{1,20} ){1,4}\Z")
#: Cues by the kind whose parser they start.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn"),
    "tel": ("tel:", "sms:", "callto:"),
}
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Square")
#: Where a house number with its street can begin at most, in characters before the cue.
REACH = 100

Span = tuple[int, int, int]


def automaton() -> ahocorasick.Automaton:
    """All anchors; the value is the parser's name and the anchor's length."""
    made = ahocorasick.Automaton()
    for symbol, kind in [("@", "email"), ("+", "phone"), ("://", "login"), *((d, "digit") for d in "0123456789")]:
        made.add_word(symbol, (kind, len(symbol)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                made.add_word(form, (kind, len(form)))
    for cue in STREETS:
        made.add_word(cue, ("street", len(cue)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits, of whatever length, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def account_ends(text: str, begin: int, end: int) -> int:
    """Where an account number that begins so ends: the longest of its groups for which the checksum holds, or -1."""
    while True:
        own = text[begin:end].replace(" ", "")
        if len(own) < 15:
            return -1
        if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
            return end
        cut = text.rfind(" ", begin, end)
        if cut < 0:
            return -1
        end = cut


def word_edge(text: str, at: int) -> bool:
    return not 0 <= at < len(text) or not text[at].isalnum()


def find(text: str, anchors: ahocorasick.Automaton) -> tuple[list[Span], list[Span]]:
    """Base and added spans as (kind, start, end), by kind, then start; places in code points."""
    base: list[Span] = []
    more: list[Span] = []
    mail_from = ip_from = card_from = phone_from = 0
    for last, (kind, size) in anchors.iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= ip_from:
                if m := IP.match(text, at):
                    ip_from = m.end()
                    if all(map(small, m[0].split("."))):
                        base.append((1, at, ip_from))
                else:
                    ip_from = DIGITS.match(text, at).end()
            if at >= card_from:
                m = CARD.match(text, at)
                card_from = m.end() if m else last + 1
                if m and 16 <= card_from - at <= 37 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    base.append((2, at, card_from))
        elif kind == "email":
            begin = at
            while begin > mail_from and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and (m := DOMAIN.match(text, last + 1)):
                mail_from = m.end()
                base.append((0, begin, mail_from))
        elif kind == "phone":
            if at >= phone_from and (m := PHONE.match(text, at)):
                phone_from = m.end()
                if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    base.append((3, at, phone_from))
        elif kind == "login":
            scheme, m = SCHEME.search(text[max(0, at - 16) : at]), USERINFO.match(text, last + 1)
            if scheme and m:
                more.append((4, at - len(scheme[0]), m.end()))
        elif kind == "street":
            if word_edge(text, last + 1) and (m := HOUSE.search(text[max(0, at - REACH) : at])):
                more.append((8, at - len(m[0]), last + 1))
        elif word_edge(text, at - 1):
            if kind == "tel":
                m = TEL.match(text, last + 1)
                if m and 7 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    more.append((5, m.start(), m.end()))
            elif kind == "iban":
                m = IBAN.match(text, last + 1)
                if m and (end := account_ends(text, m.start(1), m.end(1))) > 0:
                    more.append((6, m.start(1), end))
            elif m := ACCOUNT.match(text, last + 1):
                more.append((7, m.start(1), m.end(1)))
    return sorted(base), apart(more, base)


def apart(more: list[Span], base: list[Span]) -> list[Span]:
    """The added spans that overlap no base span (a login may), and of those that overlap each other the one that begins first, then the longest."""
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    at = end = reached = 0
    for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2], s[0])):
        while at < len(taken) and taken[at][0] < b:
            reached = max(reached, taken[at][1])
            at += 1
        if (kind == 4 or a >= reached) and a >= end:
            out.append((kind, a, b))
            end = b
    return sorted(out)


def shown(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added.

    A null text is an empty one, which has no spans; repeated rows are kept, a
    null doc_id stays null, other columns of docs are ignored. Texts are read
    whole, whatever their length.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(texts.fill_null("").to_pylist()):
                rows = [find(t.as_py() or "", anchors) for t in texts.slice(a, b - a)]
                counts = [pa.array([sum(k == kind for k, *_ in base) for base, _ in rows], pa.int64()) for kind in range(BASE)]
                digests = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *counts, digests, pa.array([shown(base + more) for base, more in rows]), pa.array([len(more) for _, more in rows], pa.int64())], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [c.split()[0] for c in schema.split(", ")]
    return clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def masked_text(text: str, anchors: ahocorasick.Automaton) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap the first stands for all."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, kind) for part in find(text, anchors) for kind, a, b in part):
        if a >= end:
            out.append(text[end:a] + f"[{KINDS[kind].upper()}]")
        end = max(end, b)
    return "".join(out) + text[end:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars follows the text. Null texts stay null, all columns are returned as they were named."""
    ready(docs.sparkSession)
    inner = boxed(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = [t if t is None else masked_text(t, anchors) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], names=["text", "_rest"])

    out = unboxed(inner.mapInArrow(run, inner.schema), docs.columns, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
