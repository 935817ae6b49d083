import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, text


@pytest.fixture(scope="module")
def value(spark):
    def run(expression, **columns):
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
        return row.select(F.expr(expression).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(("token", "cents"), [("$1,250.00", 125000), ("-$150", -15000), ("1250.5", 125050), ("$ 7.05", 705), ("0", 0), ("1,25.00", None), ("", None), (".50", None), ("$1.234", None), ("abc", None), (None, None)])
def test_parse_dollars(value, token, cents):
    assert value(money.parse_dollars("cast(t as string)"), t=token) == cents


@pytest.mark.parametrize(("cents", "shown"), [(125000, "$1,250.00"), (-15001, "-$150.01"), (0, "$0.00"), (9, "$0.09"), (9007199254740993, "$90,071,992,547,409.93")])
def test_render(value, cents, shown):
    assert value(money.render("c"), c=cents) == shown
    assert value(money.parse_dollars(money.render("c")), c=cents) == cents


@pytest.mark.parametrize(("part", "total", "share"), [(1, 2, 50), (1, 200, 0), (3, 200, 2), (5, 200, 2), (1, 3, 33), (2, 3, 67), (0, 5, 0), (-1, 5, None), (1, 0, None)])
def test_whole_percent_rounds_halves_to_even(value, part, total, share):
    assert value(money.whole_percent("a", "b"), a=part, b=total) == share


def test_report_numbers(value):
    assert value(money.ratio("a", "b"), a=2, b=3) == "2/3 (66%)" and value(money.ratio("a", "b"), a=0, b=0) == "0/0 (n/a)"
    assert [value(money.delta("a", "b"), a=a, b=3) for a in (5, 3, 1)] == ["+2", "0", "-2"]
    assert value(money.points("a", "b", "c", "d"), a=1, b=3, c=1, d=2) == "+17pp" and value(money.points("a", "b", "c", "d"), a=1, b=0, c=1, d=2) == "n/a"


@pytest.mark.parametrize(("token", "cents"), [
    ("$2,400.00", 240000), ("2,400 dollars", 240000), ("USD 350", 35000), ("350 usd.", 35000), ("twelve hundred dollars", 120000), ("two thousand four hundred dollars", 240000),
    ("one hundred and five dollars", 10500), ("half of the balance", None), ("50%", None), ("50 percent", None), ("many dollars", None), ("-$5", -500), ("USD", None),
])
def test_amount_tokens(value, token, cents):
    assert value(text.amount_cents("t"), t=token) == cents


@pytest.mark.parametrize(("token", "day"), [("2026-03-31", "2026-03-31"), ("March 3, 2026", "2026-03-03"), ("Sept. 1st 2025", "2025-09-01"), ("3/31/2026;", "2026-03-31"), ("2026-02-30", None), ("2/30/2026", None), ("soon", None)])
def test_date_tokens(value, token, day):
    found = value(text.date_value("t"), t=token)
    assert (found and found.isoformat()) == day


def test_sentences(value):
    assert value(text.sentences("t"), t="One costs $1.50. See Invoice No. 12 today!  Two?\n\n three ") == ["One costs $1.50.", "See Invoice No. 12 today!", "Two?", "three"]


def test_matches_have_offsets_of_code_points(value):
    found = value(text.matches("t", r"\$\d+"), t="é $1 and 😀 $22$3")
    assert [(m["start"], m["end"], m["token"]) for m in found] == [(2, 4, "$1"), (11, 14, "$22"), (14, 16, "$3")]
    assert value(text.matches("t", r"\$\d+"), t="none") == []


@pytest.mark.parametrize(("reference", "id"), [("INV_9999", "INV-9999"), ("inv 12", "INV-0012"), ("invoice no. 12", "INV-0012"), ("payment 208", "PMT-0208"), ("credit  memo #7", "CM-7"), ("  something ", "something")])
def test_document_references(value, reference, id):
    assert value(text.document_argument("t", "array('INV-0012', 'PMT-0208', 'INV-5', 'INV-05')"), t=reference) == id
    assert value(text.document_argument("t", "array('INV-5', 'INV-05')"), t="INV 005") == "INV-005"


def test_thinking_is_dropped(value):
    assert value(text.strip_thinking("t"), t="<think>a\nb</think>\n x ") == "x"
