from sourceloom.operators import java
from sourceloom.plans import queries

SKELETON = "package p;\npublic class A {\n    int x;\n    public static void main(String[] a) { old(); }\n}\n"


def test_overloads_stay_in_order():
    out = java.merged(SKELETON, ["int f(int a) { return 1; } int f(String s) { return 2; }", "int f(Map<String, Integer> m) { return 3; }\nint domain() { return 4; }\nint remain(int k) { return 5; }"])
    assert [out.index(f"return {k}") for k in range(1, 6)] == sorted(out.index(f"return {k}") for k in range(1, 6))


def test_the_last_of_one_signature_or_every_one():
    answers = ["int f(int a) { return 1; }", "int f(final int b) { return 2; }"]
    assert "return 1" not in java.merged(SKELETON, answers) and "return 2" in java.merged(SKELETON, answers)
    both = java.merged(SKELETON, answers, every=True)
    assert both.index("return 1") < both.index("return 2")


def test_only_the_last_main_over_skeleton_and_answers():
    out = java.merged(SKELETON, ["void runMain() { one(); }", "void go() { }", "void job_main(int a) { two(); }", "void last() { }"])
    assert "old()" not in out and "one()" not in out and "two()" in out and "void go()" in out and "void last()" in out and "int x;" in out
    assert "old()" in java.merged(SKELETON, ["void go() { }"])


def test_methods_without_a_class_to_hold_them():
    assert "void go()" in java.merged("// no class\n", ["void go() { }"])


def test_query_keeps_each_order(spark, sf_dir):
    out = queries.QUERIES["k8_java_merge"](spark, sf_dir).collect()
    assert sum(r.text.count("public int m") for r in out) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_classes_share_arrow_batches(spark):
    """One call of pandas for each class took most of the time of small classes; null places come last, as before."""
    rows = spark.createDataFrame([("a", "class A {\n}\n", f"int m{k}() {{ return {k}; }}", k if k else None) for k in range(4)] + [("b", "class B {\n}\n", None, 1)], "class_id string, skeleton string, llm_response string, ord int")
    out = java.merge_classes(rows)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    given = [f"int m{k}() {{ return {k}; }}" for k in (1, 2, 3, 0)]
    assert {r.class_id: r.text for r in out.collect()} == {"a": java.merged("class A {\n}\n", given), "b": java.merged("class B {\n}\n", [""])}
