import pytest
from pyspark.sql import functions as F

from flowspark.operators import sampling
from flowspark.plans import evaluate
from flowspark.schema import OPERATIONAL_FAMILIES


def test_family_evaluation_works_out_its_attacks_once(spark, monkeypatch):
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        worked_out.add(1)
        return True

    class Capped(Exception):
        pass

    def stop(capped):
        raise Capped(capped.groupBy("OperationalFamily").count().collect())

    monkeypatch.setattr(sampling, "grouped_split_all_classes", stop)
    rows = [(f"s{k % 4}", k, OPERATIONAL_FAMILIES[k % 5]) for k in range(1000)]
    attacks = spark.createDataFrame(rows, "Scenario string, RowID long, OperationalFamily string").where(counted("RowID"))
    with pytest.raises(Capped) as stopped:
        evaluate.evaluate_family(attacks, [], 60)
    assert {r["OperationalFamily"]: r["count"] for r in stopped.value.args[0]} == {f: 60 for f in OPERATIONAL_FAMILIES}
    assert worked_out.value == 1000
