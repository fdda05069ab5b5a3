"""The cascade's order comes from what the rules cost and reject all over the table."""

from graphloom.llm import rules

PROSE = "one two three four five six seven eight nine ten eleven twelve"


def test_order_does_not_hang_on_the_first_rows(spark):
    head = spark.range(0, 2000, 1, 1).selectExpr("id doc_id", f"'{PROSE} ########################################' text")
    rest = spark.range(2000, 22000, 1, 1).selectExpr("id doc_id", f"'{PROSE} !!!!!!!!!!' text")
    names = [r.name for r in rules.order(head.unionAll(rest))]
    assert names.index("shouting") < names.index("symbols")


def test_costs_are_counted(spark):
    cost = {}
    for kind, text in (("lines", "a b c d\n" * 40), ("one line", "a b c d " * 40)):
        found = rules.measured(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        cost[kind] = {r.name: c for r, (_, c) in zip(rules.RULES, found, strict=True)}
    assert cost["lines"]["dup_lines"] == 320 + 320 + 41 and cost["one line"]["dup_lines"] == 320
    assert cost["lines"]["repeats"] == cost["one line"]["repeats"] == 160 + 156 + 5 * 160
