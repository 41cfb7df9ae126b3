"""Margins of passages."""

import re

from pyspark.sql import functions as F

from basewise.llm import licences


def test_margins_score_a_passage_once_not_once_a_family(spark):
    rows = [(float(i % 16), ["word", f"w{i}", "end"]) for i in range(64)]
    df = licences._featured(spark.createDataFrame(rows, "label double, words array<string>"))
    weights = licences.LogisticRegression(family="multinomial", maxIter=1).fit(df)
    found = licences._margins(weights, df).filter(F.array_max("margins") > -100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF(" in plan and not re.search(r"lambda x_\d+#\d+ - UDF\(", plan)
    raw = [r["raw"] for r in weights.transform(df).select(licences.vector_to_array("rawPrediction").alias("raw")).collect()]
    assert sorted(r["margins"] for r in found.collect()) == sorted([x - r[15] for x in r[:15]] for r in raw)
