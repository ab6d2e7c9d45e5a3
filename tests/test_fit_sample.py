from flowspark.plans import evaluate
from flowspark.operators import sampling


def test_small_sample_of_a_large_table_has_training_and_validation_rows(spark):
    rows = [(f"s{k % 4}", k, int(k % 3 == 0)) for k in range(5000)]
    flows = spark.createDataFrame(rows, "Scenario string, RowID long, BinaryLabel int")
    split = sampling.stratified_split(flows, ["BinaryLabel"], ["Scenario", "RowID"])
    found = {r["split"]: r["count"] for r in evaluate._fit_sample(split, 500, "fit-sample").groupBy("split").count().collect()}
    assert found["test"] == 1000 and found["train"] + found["validation"] == 400
    assert 50 < found["validation"] < 110
