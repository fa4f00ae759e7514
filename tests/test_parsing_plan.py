"""White space, dates and the work of the parser a line."""

from pyspark.sql import functions as F

from casetrail.functions import enrich, headers
from casetrail.functions.dates import PRINTED_LAYOUTS, normalize_date
from casetrail.functions.text import WHITE, strip
from casetrail.operators import parsing


def test_strip_as_the_pattern_did(spark):
    chars = [chr(c) for c in [*range(1, 0x100), *range(0x1670, 0x1690), 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF]]
    texts = [None, "", *[c + " a" + c + "b " + c + c for c in chars], *chars, WHITE, WHITE + "x" + WHITE, "a \n", "a\r\n"]
    pattern = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.filter(~F.regexp_replace("t", pattern, "").eqNullSafe(strip(F.col("t"))))
    assert wrong.count() == 0


def test_dates_as_all_layouts_give_them(spark):
    seen = ["1/2/2020", "01/02/20", "1/2/69", "1/2/68", "31/2/2020", "1-2-2020", "1-2-99", "1 Jan 20", "01 Feb 2020", "1/2/020",
            "1/2/20200", "1/2/+20200", "1-2/2020", "x", "", None, "1 Jan 2", "01/02/2020 ", " 5  Mar  1999", "1/2/20 10:00", "2020-01-02"]
    df = spark.createDataFrame([(t,) for t in seen], "t string")
    text = F.regexp_replace(strip(F.col("t")), r"\s+", " ")

    def plain(layout):
        day = F.try_to_date(text, layout)
        return day if "yyyy" in layout else F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)

    wanted = F.coalesce(F.date_format(F.coalesce(*[plain(x) for x in PRINTED_LAYOUTS]), "dd/MM/yyyy"), text)
    assert df.filter(~wanted.eqNullSafe(normalize_date(F.col("t")))).count() == 0


def test_each_line_is_matched_and_read_once(spark, capsys):
    parsing.parse_text(spark.createDataFrame([("s", "x")], "statement_id string, text string")).explain()
    plan = capsys.readouterr().out
    for pattern in (parsing.CARD_LINE, parsing.IDFC_LINE, parsing.ICICI_LINE):
        assert plan.count(f"{pattern})") == 1, pattern  # matched
        assert plan.count(f"{pattern}, $1") == 1, pattern  # read
    assert "Filter isnotnull(CASE" not in plan


def test_narrations_are_put_together_once(spark, capsys):
    parsing.parse_text(spark.createDataFrame([("s", "x")], "statement_id string, text string")).explain()
    # Three lines before and three after, for the narration and not again for the direction.
    assert capsys.readouterr().out.count(r"^[\d,. ]+(CR|DR)?$") == 6


def test_lines_of_odd_white_space_read_as_others(spark):
    line = "01/02/2020 SHOP A 1,234.50 Cr"
    text = "HDFC Bank Credit Cards\n{}\n"
    rows = [(k, text.format(f"{c}{line}{c}")) for k, c in enumerate(["", " ", "\t", "\r", "\u00a0", "\u3000 "])]
    found = parsing.parse_text(spark.createDataFrame(rows, "statement_id int, text string")).collect()
    assert sorted((r["statement_id"], r["description"]) for r in found) == [(k, "SHOP A") for k in range(6)]


def test_heads_and_letters_are_read_once(spark, capsys):
    df = spark.createDataFrame([("UPI/12/(unknown)",), ("IMPS-12",), (None,), ("ab1/Caf\u00e9 9 / x",), ("a1b2c34",)], "t string")
    told = df.select("t", enrich.counterparty_from_description(F.col("t")).alias("p"))
    told.explain()
    plan = capsys.readouterr().out
    assert plan.count("^[^-/@]*") == 1 and plan.count(r"[^\p{L}], ") == 1
    assert [r["p"] for r in told.collect()] == ["(unknown)", "12", "(unknown)", "Caf\u00e9 9", "a1b2c34"]


def test_lines_with_digits_leave_the_header_first(spark, capsys):
    df = spark.createDataFrame([("A1\r\rRAVI KUMAR \t\r\nB2",)], "t string")
    told = df.select(headers.guess_holder_name(F.col("t")).alias("h"))
    told.explain()
    assert "transform(filter(slice(filter(split(" in capsys.readouterr().out
    assert told.collect()[0]["h"] == "RAVI KUMAR"
