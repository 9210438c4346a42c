import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.functions import privacy as P
from tablecheck.operators import privacy as R


@pytest.mark.parametrize(
    "text, masked",
    [
        ("", ""), ("a", "*"), ("abcd", "****"), ("abcde", "ab*de"), ("abcdefgh", "ab****gh"),
        ("abcdefghi", "abc***ghi"), (None, None),
    ],
)
def test_mask(frame, text, masked):
    assert frame([(text,)], "c string").select(P.mask(F.col("c"))).first()[0] == masked


@pytest.mark.parametrize(
    "text, redacted",
    [
        ("write a.b+c@mail.example.org now", "write [REDACTED_EMAIL] now"),
        ("555-123-4567 or 5551234567", "[REDACTED_PHONE] or [REDACTED_PHONE]"),
        ("id 123-45-6789", "id [REDACTED_SSN]"),
        ("4111 1111 1111 1111", "[REDACTED_CREDIT_CARD]"),
        ("host 10.0.0.255", "host [REDACTED_IP_ADDRESS]"),
        ("x@y.co and 555-123-4567", "[REDACTED_EMAIL] and 555-123-4567"),
        ("nothing here 12345", "nothing here 12345"),
        (None, None),
    ],
)
def test_first_pattern_wins(frame, text, redacted):
    assert frame([(text,)], "c string").select(P.redact_values(F.col("c"))).first()[0] == redacted


def test_redact_text_uses_all(frame):
    df = frame([("x@y.co, 555-123-4567, 1.2.3.4",)], "c string")
    want = "[REDACTED_EMAIL], [REDACTED_PHONE], [REDACTED_IP_ADDRESS]"
    assert df.select(P.redact_text(F.col("c"))).first()[0] == want


def test_redact_table(frame):
    df = frame(
        [(123456789, "a.person@mail.com", "5551234567", 12.5, "call 555-123-4567", None)],
        "order_id bigint, customer_email string, phone_number string, order_total double, note string, full_name string",
    )
    r = R.redact(df).first()
    assert (r.order_id, r.order_total) == (123456789, 12.5)
    assert r.customer_email == "a.p***********com"
    assert r.phone_number == "555****567"
    assert r.note == "call [REDACTED_PHONE]"
    assert r.full_name is None
    h = R.redact(df, "hash").first()
    assert len(h.customer_email) == 64
    assert R.redact(df, "email").first().customer_email == "a***@mail.com"
    assert R.redact(df, "last4").first().phone_number == "******4567"
    with pytest.raises(ValueError):
        R.redact(df, "rot13")


def test_numeric_column_with_telling_name_is_masked(frame):
    r = R.redact(frame([(123456789,)], "ssn bigint")).first()
    assert r.ssn == "123***789"


@pytest.mark.parametrize("name", ["customer_email", "PHONE_number", "ssn", "credit_card_number", "BirthDate", "birth_date", "social_security_no", "home_address", "nickname", "dob"])
def test_telling_names(frame, name):
    df = frame([("x",)], f"{name} string")
    assert R.named_pii(df) == [name]
    assert [r.column for r in R.pii_columns(df).collect()] == [name]


@pytest.mark.parametrize("name", ["order_id", "order_total", "status", "created_at"])
def test_plain_names(frame, name):
    df = frame([("x",)], f"{name} string")
    assert R.named_pii(df) == [] and R.pii_columns(df).count() == 0


def test_scan_and_rows(frame):
    df = frame([("a@b.co c@d.co", 1), ("none", 2), (None, 3), ("1.2.3.4", 4)], "t string, id int")
    got = {r.kind: (r.matches, r.rows_affected) for r in R.pii_scan(df).collect()}
    assert got["email"] == (2, 1) and got["ip_address"] == (1, 1) and got["phone"] == (0, 0)
    assert sorted(r.id for r in R.pii_rows(df).collect()) == [1, 4]


def test_no_pii(frame):
    df = frame([("x", 1)], "name string, v int")
    r = result_of(R.check_no_pii(df.select("v"), df))
    assert (r.status, r.gate) == ("pass", "warn")
    assert result_of(R.check_no_pii(df, df)).violations == 2
    assert result_of(R.check_no_pii(df.select("name"), df)).violations == 1


def test_redact_nested(frame):
    schema = "s struct<note:string,phone:string,n:int>, a array<struct<t:string>>, m map<string,string>, z array<int>"
    df = frame([(("a@b.com", "555-1234567", 1), [("x@y.org",), None], {"k": "c@d.com"}, [1]), (None, None, None, None)], schema)
    full, empty = R.redact(df).collect()
    if full.s is None:
        full, empty = empty, full
    assert "a@b.com" not in full.s.note and "1234" not in full.s.phone and full.s.n == 1
    assert "x@y.org" not in full.a[0].t and full.a[1] is None
    assert "c@d.com" not in full.m["k"] and full.z == [1]
    assert tuple(empty) == (None, None, None, None)


def test_redaction_stays_in_the_jvm(frame):
    plan = R.redact(frame([("x",)], "note string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_no_pii_in_values(frame):
    df = frame([("a@b.example.org",), ("plain",), (None,)], "v string")
    r = result_of(R.check_no_pii(df, values=True))
    assert (r.status, r.violations, r.metrics["matching_rows"]) == ("fail", 1, "1")
    assert result_of(R.check_no_pii(df)).violations == 0
    assert result_of(R.check_no_pii(df.filter("v = 'plain'"), values=True)).status == "pass"
