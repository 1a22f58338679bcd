"""Personal data: spans against plain regular expressions, awkward rows, very long runs."""

from __future__ import annotations

import hashlib
import random
import re
import time

from rows import LONG, TEXTS, documents

from inkwell.llm import personal

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind: int, found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def plain(text: str) -> list[tuple[int, int, int]]:
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if holds(k, m[0])]


MADE = [
    "a@b.c@d.e f@g a@@b.c .@x.y. é@a.bc x@é.com @a.b a@b..c u+t%1@mail-1.example.com,v@w.xy",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2..3.4.5.6 1.2.3. 999.1.2.3.4.5.6.7",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500 0000 0000 0004 1 2 3 4  5 4111 1111 1111 1111 1",
    "+49 (30) 123-456.78 +1234567 +12345678 ++4930123456 +1 +4930-1234567890123456 call +33 1 23 45 67 89.",
    "😀 mail: ünï.a@b.de +49 30 1234567 10.0.0.1",
]


def test_base_equals_plain_expressions():
    rng, anchors = random.Random(4), personal.automaton()
    texts = MADE + ["".join(rng.choice("01234 .@+-()ab%é") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["4111111111111111", "4111 1111 1111 1111", "+49 30 123456", "8.8.4.4", "a@b.cd", "x", "-", "."]) for _ in range(9)) for _ in range(500)]
    for t in texts:
        assert personal.find(t, anchors)[0] == plain(t), t


def added(text: str) -> list[tuple[str, str]]:
    return [(personal.KINDS[k], text[a:b]) for k, a, b in personal.find(text, personal.automaton())[1]]


def test_added_spans():
    assert added("see ftp://bob:pa55@files.example:21/x and https://example.com/") == [("login", "ftp://bob:pa55@files.example:21")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 AND more, iban GB82WEST12345698765432") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert added("IBAN DE89 3704 0044 0532 0130 01, ibans DE89370400440532013000") == []
    assert added("Account no. 1234-567890 and account 12, my accounts 1234567") == [("account", "1234-567890")]
    assert added("write tel:030 1234567 or hotel:0301234567") == [("tel", "030 1234567")]
    assert added("lives at 12b Old Mill Road, not in 7 Streets or on the Road") == [("street", "12b Old Mill Road")]
    assert added("account 4111 1111 1111 1111") == []  # a card is base


def test_scan_equals_plain_and_edges(spark):
    texts = MADE + [t for _, t, *_ in TEXTS]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal.scan(rows).collect():
        text = texts[r["doc_id"]] or ""
        base, more = plain(text), personal.find(text, personal.automaton())[1]
        assert r["base_sha256"] == hashlib.sha256(personal.shown(base).encode()).hexdigest()
        assert r["spans"] == personal.shown(base + more) and r["n_added"] == len(more)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for k, *_ in base) for i in range(4))
    docs = documents(spark)
    assert personal.scan(docs).count() == len(TEXTS) and personal.scan(docs.limit(0)).count() == 0
    kept = personal.masked(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").first()["text"] == LONG and kept.where("doc_id = 3").first()["text"] is None
    row = personal.masked(spark.createDataFrame([(1, "x a@b.cd, +49 30 1234567!", 25)], "doc_id long, text string, n_chars long")).first()
    assert row["text"] == "x [EMAIL], [PHONE]!" and row["n_chars"] == 19


def test_long_runs_take_linear_time():
    anchors = personal.automaton()
    runs = ["a", "1", "1.", "1 ", "+1", "@", "a@", "a@b", "a@b.", "://", "x://a", "account ", "IBAN DE89", "Ab ", "7 Old Road ", "+(", "1-"]
    for unit in runs:
        began = time.perf_counter()
        text = unit * (1_000_000 // len(unit))
        found = personal.find(text, anchors)[0]
        assert time.perf_counter() - began < 20
        assert personal.find(unit * 500, anchors)[0] == plain(unit * 500)
        assert unit != "1." or len(found) == 125_000
