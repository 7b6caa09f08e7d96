from sourceloom.functions import rules


def test_tables_of_more_than_a_thousand_rules(spark):
    table = spark.createDataFrame([(f"r{k}", k, k, f"word{k}x") for k in range(1500)], "name string, priority int, ord int, pattern string")
    texts = spark.createDataFrame([(k, f"word{k}x word3x") for k in (5, 999, 1000, 1499)] + [(7000, "none")], "line_start int, sql_text string")
    found = {r.line_start: r.rule for r in rules.classify_by_table(texts, table).collect()}
    assert found == {5: "r5", 999: "r999", 1000: "r1000", 1499: "r1499", 7000: "unknown"}
