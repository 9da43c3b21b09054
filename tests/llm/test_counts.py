"""Counts of the operators for training data are exact."""

from kgweave.llm import survivors


def test_records_are_counted_exactly(spark):
    rows = [(i, "VIÊM GAN", ["a"], ["T"], 1, "2024-01-01", "x") for i in range(3000)] * 2 + [(9000, "HO", ["a"], ["T"], 1, "2024-01-01", "x")]
    nodes = spark.createDataFrame(rows, "id bigint, entity_name string, entity_types array<string>, descriptions array<string>, occurrence_count int, extracted_at string, extractor string")
    built = survivors.built_records(nodes, spark.createDataFrame([("x", 1.0)], "extractor string, trust double"))
    assert {r["key"]: r["n_records"] for r in built.collect()} == {"VIÊM GAN": 3000, "HO": 1}
