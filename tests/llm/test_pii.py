import re
import time
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import op04_feistel_pii as op4
from tests.llm.helpers import ODD, documents

KEY = b"test key"


def test_permutation_and_inverse():
    for radices in ([10], [2, 3], [3, 4, 5], [7, 2, 2, 9]):
        every = list(product(*map(range, radices)))
        image = [tuple(op4.permute(list(x), radices, KEY, "t")) for x in every]
        assert len(set(image)) == len(every)
        assert [tuple(op4.permute(list(y), radices, KEY, "t", back=True)) for y in image] == every


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcXYZ019.-_ é"), max_size=24))
def test_texts_keep_their_format(text):
    new = op4.permute_text(text, KEY, "t")
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", s)))
    assert shape(new) == shape(text) and op4.permute_text(new, KEY, "t", back=True) == text


VALUES = [
    ("email", "jo.doe+x7@mail3.example.com"), ("card", "4041894974608795"), ("card", "4041 8949 7460 8795"), ("phone", "+1 (988) 555-2485"), ("phone", "(516) 555-2642"), ("phone", "516-555-2642"), ("phone", "+49 30 1234567"), ("ssn", "123-45-6789"), ("ssn", "665-01-0001"),
    ("ssn", "899-99-9999"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ipv4", "87.230.227.82"), ("ipv4", "1.2.3.255"), ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "03/04/2001"), ("date", "12/25/2001"), ("date", "1900/01/01"),
]


@pytest.mark.parametrize(("kind", "value"), VALUES)
def test_values(kind, value):
    make = {k: f for k, _, f in op4.FINDERS}[kind]
    new = make(value, KEY)
    assert new != value and len(new) == len(value) and make(new, KEY, True) == value
    assert make(new, KEY) is not None  # it passes the same check again
    text, counts, spans = op4.mask(f"ab {value}, and {value}; end", KEY)
    assert text == f"ab {new}, and {new}; end" and counts[kind] == 2 == sum(counts.values())
    assert [(k, b - a) for k, a, b in spans] == [(kind, len(value))] * 2
    assert op4.mask(value, b"other key")[0] != new


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
BESIDE = [
    ("card", CARD, "{} 12/27"), ("card", CARD, "{} 1111 123"), ("card", CARD, "{} 123"), ("card", CARD, "12 {}"), ("card", CARD, "12 345678 {}"), ("card", CARD, "+1 {}"), ("card", CARD, "7 7 7 {} 3 3 3"), ("card", "4041894974608795", "{} 123"),
    ("iban", IBAN, "{} BIC"), ("iban", IBAN, "{} NOTE"), ("iban", "AT611904300234573201", "{} PAID"), ("date", "1980-02-03", "{}T10:00"), ("date", "1980-02-03", "{}T10:00:00Z"),
]


@pytest.mark.parametrize(("kind", "value", "around"), BESIDE)
def test_values_beside_others(kind, value, around):
    text, counts, _ = op4.mask(f"ab {around.format(value)} end", KEY)
    new = {k: f for k, _, f in op4.FINDERS}[kind](value, KEY)
    assert text == f"ab {around.format(new)} end" and counts[kind] == 1 == sum(counts.values())


def test_several_values_in_a_run_of_digits():
    text, counts, spans = op4.mask(f"516-555-2642 {CARD} 1980-02-03 123-45-6789 4041894974608795", KEY)
    assert (counts["phone"], counts["card"], counts["date"], counts["ssn"]) == (1, 2, 1, 1) and spans == sorted(spans, key=lambda s: s[1])
    assert op4.mask("12 " * 100_000, KEY)[0] and CARD not in op4.mask(f"{CARD} " * 2000, KEY)[0]


@pytest.mark.parametrize("text", ["4041894974608796", "1111111111111111", "300.1.2.3", "1.2.3", "v1.2.3.4.5", "000-12-3456", "666-12-3456", "2024-02-30", "99.99.2020", "DE88370400440532013000", "12345", "a@b", "token=4041894974608795abc", "1,234,567.89", "3.14159265358979"])
def test_what_is_not_valid_stays(text):
    assert op4.mask(text, KEY)[0] == text


def test_rows(spark):
    texts = [*ODD, "mail bosbt.42@mail8.example.com now", "x" * 100_000 + " 87.230.227.82"]
    docs = documents(spark, texts, extra=True)
    got = op4.pseudonymize(docs, KEY)
    assert got.dtypes == docs.dtypes
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    assert [found[i] for i in range(len(ODD))] == ODD and "bosbt" not in found[len(ODD)] and found[len(ODD) + 1].startswith("x" * 100_000 + " ")
    report = op4.pseudonymize(docs.selectExpr("*", "'old' as n_email"), KEY, report=True).where("n_email + n_ipv4 > 0").collect()
    assert [(r["doc_id"], r["n_email"], r["n_ipv4"], r["spans"][0]["kind"]) for r in report] == [(len(ODD), 1, 0, "email"), (len(ODD) + 1, 0, 1, "ipv4")]
    assert op4.pseudonymize(docs.limit(0), KEY).count() == 0


def test_equal_values_stay_linked_across_formats():
    days = [op4.a_date(t, KEY) for t in ("2020-01-02", "02.01.2020", "02/01/2020", "2020/01/02")]
    assert len({tuple(sorted(re.split("[-./]", d))) for d in days}) == 1 and op4.a_date("25.03.2020", KEY)[:2] == op4.a_date("2020-03-25", KEY)[8:]
    assert op4.a_date("03/25/2020", KEY)[3:5] == op4.a_date("2020-03-25", KEY)[8:]
    digits = lambda t: re.sub(r"\D", "", t)
    one = {digits(op4.phone(t, KEY))[-10:] for t in ("+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+19885552485")}
    other = {digits(op4.phone(t, KEY)) for t in ("+49 30 1234567", "+49301234567", "+49-30-1234567")}
    assert len(one) == 1 and len(other) == 1 and other.pop().startswith("49")


def test_long_texts_of_addresses_take_linear_time():
    began = time.process_time()
    text, counts, _ = op4.mask("a" * 1_000_000 + " " + "x.y@mail.example.com " * 40_000 + "@" * 200_000, KEY)
    assert counts["email"] == 40_000 and time.process_time() - began < 20
