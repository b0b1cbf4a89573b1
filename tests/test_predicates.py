import pytest

from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.functions.pvalues import upper_gamma


def evaluate(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", P.col(make("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("token", K.PSEUDO_NULLS)
def test_pseudo_nulls(spark, token):
    assert evaluate(spark, P.is_pseudo_null, [token, f" {token.upper()}\t", f"{token}x1"]) == [True, True, False]


def test_pseudo_null_strips_all_whitespace(spark):
    assert evaluate(spark, P.is_pseudo_null, [" n/a　", "\x0bnd\x1c", "", None]) == [True, True, False, None]


def test_numbers(spark):
    values = ["1", " 2.5 ", "-.5", "1e3", "1d", "1f", "1_000", "", "abc", "inf", "-Infinity", "nan", None, "+7."]
    got = evaluate(spark, P.to_number, values)
    assert got == [1.0, 2.5, -0.5, 1000.0, None, None, None, None, None, float("inf"), float("-inf"), None, None, 7.0]


def test_dates(spark):
    values = ["2024-01-15", "2024-1-5", "2024-01-15T10:20:30Z", "31/12/2023", "12/31/2023", "2024/02/30", "2024-13-01", "hello", "12"]
    assert evaluate(spark, P.is_date_text, values) == [True, True, True, True, True, False, False, False, False]


@pytest.mark.parametrize("name, good, bad", [
    ("email", ["a.b+c@x-y.org"], ["a@b", "@x.org", "a b@x.org", "a@x.org."]),
    ("phone", ["0612345678", "+33612345678", "06 12 34 56 78"], ["12345", "0012345678"]),
    ("url", ["https://a.b/c?d"], ["ftp://a.b", "http://", "http://a b"]),
    ("postal", ["75001"], ["7500", "750011", "75001\n7"]),
    ("siret", ["12345678901234"], ["123"]), ("siren", ["123456789"], ["12345678"]),
    ("ip", ["10.0.0.1"], ["10.0.0", "a.b.c.d"]),
])
def test_formats(spark, name, good, bad):
    assert evaluate(spark, lambda c: P.has_format(c, name), good + bad) == [True] * len(good) + [False] * len(bad)


def test_names():
    assert P.format_of_name("email_client") == "email"
    assert P.format_of_name("hotel") is None and P.format_of_name("hotel", substring=True) == "phone"
    assert P.semantic_of_name("stage") is None and P.semantic_of_name("birth_date") == "date_string"
    assert P.is_identifier_name("customer_id") and not P.is_identifier_name("width") and P.is_identifier_name("width", substring=True)


@pytest.mark.parametrize("a, x, q", [(0.5, 1.920729, 0.05), (1.0, 2.995732, 0.05), (5.0, 9.153519, 0.05), (50.0, 62.171, 0.05), (2.0, 0.0, 1.0)])
def test_gamma(a, x, q):
    assert upper_gamma(a, x) == pytest.approx(q, abs=1e-4)
