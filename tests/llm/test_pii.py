import datetime as dt

import pytest

from stallmark.llm import pii

KEY = b"k"


@pytest.mark.parametrize("value", ["9876543210", "AB12 20110045404", "abcde1234f", "7", "A-1", "000"])
def test_pseudonym_round_trip(value):
    out = pii.pseudonym(value, KEY, "x")
    assert len(out) == len(value) and [c.isdigit() for c in out] == [c.isdigit() for c in value] and [c.isupper() for c in out] == [c.isupper() for c in value]
    assert pii.pseudonym(out, KEY, "x", back=True) == value


def test_permutation_is_one_to_one():
    assert sorted(pii.permute(x, 1000, KEY) for x in range(1000)) == list(range(1000))
    day = dt.date(1990, 3, 12)
    assert pii.pseudonym_date(pii.pseudonym_date(day, KEY), KEY, back=True) == day


CASES = [
    ("Call 98765 43210 or (+91) 8344-695-379 after 6 pm.", ["phone", "phone"]),
    ("Ping at ９６３８７１８０８０ only", ["phone"]),
    ("My no. is 8lO62O8l98, no time pass", ["phone"]),
    ("Call nine one two three four five six seven eight zero and we talk", ["phone"]),
    ("Order id 284-7521500-3317163, IMEI 357183065782634, invoice no. 6133653598 dated 13/03/2025", []),
    ("mail me at a.b@mail.example or c at inbox dot example", ["email", "email"]),
    ("Paid 37,298 @ store, runs at 1920x1080", []),
    ("can show my Aadhaar 6063 3198 9331 as proof. PAN HKJMZ4634V", ["id_number", "id_number"]),
    ("Pick up from H.No. 6/5, Naha Street, Kizobha 240747. Near sector 5 metro gate 2", ["address"]),
    ("My name is Venla Hodhigho and I bought it", ["name"]),
    ("Contact the Zovata helpdesk. This is original Sapa stock. Regards, Sapa sales team", []),
    ("Bought from Mr. Yatbokte last year. Bought from Sapa store in May", ["name"]),
    # twelve bare digits: with and without a valid check digit
    ("number 234123412346 given", ["id_number"]), ("number 234123412345 given", []),
    # long words do not shorten the search
    ("Address: Flat 12B, " + "Verylongname" * 12 + " Residency, Kizobha Road.", ["address"]),
    ("", []), (None, []),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_mentions(text, kinds):
    assert [m.kind for m in pii.find_mentions(text)] == kinds


def test_redaction_keeps_the_rest_and_links_equal_numbers(spark):
    a = pii.redact("call +91 98765 43210 now", KEY)[0]
    b = pii.redact("ph: 9876543210", KEY)[0]
    assert a.startswith("call [PHONE ") and a.endswith("] now") and a[5:-4] == b[4:]
    long = "nothing here " * 20_000
    df = spark.createDataFrame([(1, None, "x", "x"), (2, long, None, "y"), (2, long, None, "y")], "record_id bigint, title string, description string, field string")
    out = pii.redact_table(df, "record_id", {"title": True, "description": False}, "secret").collect()
    assert len(out) == 6 and {r.redacted for r in out} == {None, long, "x"}
    assert pii.redact_table(df.limit(0), "record_id", {"title": True}, "secret").count() == 0


def test_dates_become_dates():
    text = "born 13/05/1990, sold 2023-05-13, seen 4 June 2021, not 31/02/2020 or 99/99/2020"
    red = pii.redact(text, KEY, dates=True)[0]
    assert red.count("[DATE ") == 3 and "31/02/2020 or 99/99/2020" in red and "13/05/1990" not in red
    assert pii.redact(text, KEY)[0] == text
    other = pii.redact("again 1990-05-13", KEY, dates=True)[0]
    d = pii.find_dates(red)
    assert pii.find_dates(other)[0][2] == d[0][2] and pii.pseudonym_date(d[0][2], KEY, back=True).isoformat() == "1990-05-13"


def test_key_is_required(spark):
    with pytest.raises(ValueError):
        pii.redact_table(spark.range(0).selectExpr("id record_id", "'' title"), "record_id", {"title": True}, "")
    assert len(pii.session_key(spark)) == 64 and pii.session_key(spark) == pii.session_key(spark)


def test_check_digit():
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")
