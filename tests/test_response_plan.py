"""A response is made and read once, whatever is asked of it."""

from casetrail.operators import responses as R
from catalog import responses as Q

SF = "/root/testdata/sf0.001"


def test_filters_do_not_read_responses_again(spark):
    for name in ("a18_provider_agreement", "e21_normalised_responses"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
        lines = plan.toString().splitlines()
        assert not [line for line in lines if line.lstrip(" :+-").startswith("Filter") and "StructsToJson" in line], name
        # Twice for the whole text, twice for what lies between its braces.
        assert plan.toString().count("VariantExpressionEvalUtils.parseJson") <= 4, name


def test_overlay_makes_responses_once_and_sends_no_side_whole(spark):
    plan = Q.QUERIES["j6_model_overlay"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") <= 4
    kinds = "extraction_id int, {} int, date string, amount decimal(18,2), direction string, counterparty string"
    ours, said = (spark.createDataFrame([(1, 1, "d", None, None, None)], kinds.format(c)) for c in ("row_index", "pos"))
    assert "Broadcast" not in R.overlay(ours, said)._jdf.queryExecution().executedPlan().toString()


def test_overlay_of_rows_without_an_extraction(spark):
    kinds = "extraction_id int, {} int, date string, amount decimal(18,2), direction string, counterparty string"
    ours = spark.createDataFrame([(None, 1, "d", None, None, "x"), (1, None, "d", None, None, "y"), (2, None, "d", None, None, "z")], kinds.format("row_index"))
    said = spark.createDataFrame([(None, 1, "d", None, None, "A"), (1, 1, "d", None, None, "B"), (2, 2, "d", None, None, "C"), (2, 1, "d", None, None, "D")], kinds.format("pos"))
    found = R.overlay(ours, said).select("counterparty", "overlaid", "count_match").collect()
    assert sorted(map(tuple, found)) == [("D", True, False), ("x", False, None), ("y", False, True)]


def test_columns_of_the_response_that_counts(spark):
    rows = [(1, "gemini:a", 2, "no"), (1, "gemini:b", 1, "yes"), (1, "other", 0, "no"), (2, "other", 0, "no")]
    df = spark.createDataFrame(rows, "extraction_id int, slot string, seq int, raw string")
    assert [tuple(r) for r in R.primary_slots(df, ("gemini",), "raw").collect()] == [(1, "gemini:b", "yes")]
