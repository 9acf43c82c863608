import pytest
from pyspark.sql import functions as F

from tallyweave.functions import money, text


# Given and wanted of the parametrised tests below are the published vectors of these
# functions, as results must equal them; the plain assertions are our own.


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, paise",
    [("1,23,456.78", 12345678), ("₹ 1234.5", 123450), ("(450.00)", -45000), ("1234.567", 123457), ("0.1", 10), ("Rs.99", 9900), ("INR 1,000", 100000), ("0.005", 1), ("-12.30", -1230), ("", None), ("  ", None), ("abc", None), ("₹", None), ("1.2.3", None)],
)
def test_to_paise(spark, given, paise):
    assert one(spark, money.to_paise(F.lit(given))) == paise


@pytest.mark.parametrize("paise, shown", [(12345678, "1,23,456.78"), (100000, "1,000.00"), (999, "9.99"), (-45000, "-450.00"), (0, "0.00"), (100000000, "10,00,000.00"), (99905, "999.05")])
def test_indian_format(spark, paise, shown):
    assert one(spark, money.indian_format(F.lit(paise))) == shown


def test_half_even(spark):
    assert [one(spark, money.half_even(F.lit(x), 5000)) for x in (1, 3, 5, 7)] == [0, 2, 2, 4]


@pytest.mark.parametrize("credit, relation", [(100000, "gross"), (98000, "net_of_tds_2pct"), (99000, "net_of_tds_1pct"), (90000, "net_of_tds_10pct"), (95000, None), (100100, "gross"), (100101, None)])
def test_tds(spark, credit, relation):
    assert one(spark, money.tds_relation(F.lit(100000), F.lit(credit))) == relation


def test_names_and_references(spark):
    assert one(spark, text.utrs(F.lit("mb:neft cr-icicn260704675657-x ICICN260704675657"))) == ["ICICN260704675657"]
    assert one(spark, text.utrs(F.lit("SALARY JULY"))) == []
    assert one(spark, text.norm_id(F.lit("INV-2627-1001"))) == "inv26271001"
    assert one(spark, text.name_tokens(F.lit("Acme Pvt. Ltd."))) == ["acme"]
    assert one(spark, text.token_overlap(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
    assert one(spark, text.looks_like_settlement(F.lit("NEFT RZP payout"))) is True
    assert str(one(spark, text.parse_date(F.lit("5-Jul-2026")))) == "2026-07-05"
    assert one(spark, text.parse_date(F.lit("2026-13-40"))) is None
