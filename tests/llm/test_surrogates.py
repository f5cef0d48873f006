"""Surrogates: coreference over spellings, distinctness, validity, and a plain reading of the text beside them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import pii

KEY = "a key"


def run(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(docs, KEY, **more).collect()}


_RNG = random.Random(2)
NUMBERS = sorted({f"+{c}{_RNG.randrange(10**7, 10**8)}" for c in ("1", "44", "380") for _ in range(300)})
PIECES = ["Mail jo.doe@mail.org", "call (743) 555-3824", "IP 10.20.30.40", "SSN 123-45-6789", "Mrs Ann Lee", "card 4111 1111 1111 1111", "password: hunter2hunter2", "sk-abcdefghijklmnopqrstuvwx", "nothing here", "", "É ü 日本"]
MIXED = [". ".join(_RNG.choice(PIECES) for _ in range(_RNG.randint(0, 9))) for _ in range(60)] + [None, "x " * 100_000 + "jo.doe@mail.org"]
FIRST = ["Mr. SMITH met Mr. Smith and Mrs. Smith.", "Mr. Jones left", "Herr Müller und Frau MÜLLER", "+1 743 555 3824 and +17435553824 or +1-743-555-3824", "+49 30 1234567", "+493012345678", "; ".join(NUMBERS), "DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB29NWBK60161331926819"]
IPV6 = [("see 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]), ("fe80::1 and FE80::1", ["fe80::1", "FE80::1"]), ("at 12:34:56 on std::vector, a::b, 10:20", [])]
TEXTS = [*FIRST, *(t for t, _ in IPV6), *MIXED]


@pytest.fixture(scope="module")
def rows(spark):
    return run(spark, TEXTS)


def test_names_fold_case_and_title(rows):
    a, b, c = (x.surrogate.split()[1] for x in rows[0].pii)
    assert a == b.upper() and b == c and b != "Smith" and rows[1].pii[0].surrogate.split()[1] != b
    d, e = (x.surrogate.split()[1] for x in rows[2].pii)
    assert e == d.upper()


def test_one_phone_in_many_spellings(rows):
    digits = [re.sub(r"\D", "", x.surrogate) for x in rows[3].pii]
    assert len(digits) == 3 and len(set(digits)) == 1 and digits[0].startswith("17") and digits[0] != "17435553824"
    assert [re.sub(r"\D", "", rows[i].pii[0].surrogate)[:3] for i in (4, 5)] == ["493", "493"]


def test_phones_stay_distinct(rows):
    got = rows[6].pii
    assert len(got) == len(NUMBERS) == len({x.surrogate for x in got}) and all(x.surrogate[:2] == x.original[:2] for x in got)


def test_ibans_are_valid_and_corefer(rows):
    got = rows[7].pii
    assert [x.kind for x in got] == ["iban"] * 3 and got[0].surrogate.replace(" ", "") == got[1].surrogate != got[1].original
    for x in got:
        s = x.surrogate.replace(" ", "")
        assert s[:2] == x.original[:2] and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", got[0].surrogate) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[2].surrogate)


@pytest.mark.parametrize("i", range(len(IPV6)))
def test_ipv6(rows, i):
    found = IPV6[i][1]
    got = [x for x in rows[len(FIRST) + i].pii if x.kind == "ipv6"]
    assert [x.original for x in got] == found and len({x.surrogate for x in got}) == min(len(found), 1)
    assert all(re.fullmatch(r"2001:db8(:[0-9a-f]{4}){6}", x.surrogate) for x in got)


def test_texts_against_a_plain_replacement(spark, rows):
    """Each entity's surrogate, put at its place by Python, gives the text; the key matters; nothing else changes."""
    known = {}
    for i, t in enumerate(MIXED, len(FIRST) + len(IPV6)):
        if t is None:
            assert rows[i].text is None and rows[i].pii == []
            continue
        out, at = "", 0
        for x in rows[i].pii:
            k = t.index(x.original, at)
            out += t[at:k] + x.surrogate
            at = k + len(x.original)
            assert known.setdefault((x.kind, x.original), x.surrogate) == x.surrogate != x.original
        assert rows[i].text == out + t[at:]
        assert [x.kind for x in rows[i].pii if x.original == "Mrs Ann Lee"] == ["name"] * t.count("Mrs Ann Lee")
    assert len(set(known.values())) == len(known) == 8
    other = pii.pseudonymise(spark.createDataFrame([(1, "jo.doe@mail.org")], "doc_id long, text string"), "another").first()
    assert other.text != known["email", "jo.doe@mail.org"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith", "mine", "m", 5)] * 2, "doc_id long, text string, pii string, pii_matches string, m int")
    got = pii.pseudonymise(docs, KEY)
    assert got.columns == ["doc_id", "text", "pii_matches", "m", "pii"] and got.count() == 2 and got.first().pii[0].kind == "name"
    kept = pii.pseudonymise(docs, KEY, found_col=None)
    assert kept.columns == docs.columns and kept.first().pii == "mine"
    assert pii.pseudonymise(docs.where(F.lit(False)), KEY).count() == 0


def test_names_grow_with_their_number(spark):
    parts = [a + b + c for a in ("Ba", "Ko", "Lu") for b in ("ram", "sen", "tov") for c in ("ic", "er")]
    texts = [f"Mr. {a} {b}" for a in parts for b in parts]
    got = [x.surrogate for r in run(spark, texts).values() for x in r.pii]
    assert len(set(got)) == len(texts)
