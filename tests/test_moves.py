"""How often queries move their rows: what is dealt by page once is not moved again."""

from paperloom.plans import registry
from tests.conftest import SMALL


def exchanges(df) -> int:
    df.collect()  # the final plan, whose reads of one exchange are one
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(line.strip(" :+-*(0123456789)").startswith("Exchange ") for line in plan.splitlines())


def test_segments_are_dealt_once(spark):
    assert exchanges(registry.queries()["ruled_lines"](spark, SMALL)) == 1


def test_characters_are_dealt_once(spark):
    assert exchanges(registry.queries()["merged_rows"](spark, SMALL)) == 1


def test_frames_answer_in_few_squares(spark):
    from paperloom.operators import layout

    rows = [(1, k, 8.0 * k + 3.9 * (k % 2), 8.0 * k, f"text {k}") for k in range(40)]
    found = layout.overprints(spark.createDataFrame(rows, "page long, frame long, x0 double, y0 double, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" in plan
