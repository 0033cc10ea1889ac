"""The plans of near-dedup stay small: what is read several times is stored, and each step is let go of."""

from reclink.llm import near_dedup


def test_no_step_repeats_the_plan_of_another(spark, monkeypatch):
    read, settled = {}, near_dedup.settled

    def counted(df, name):
        read[name] = df._jdf.queryExecution().analyzed().toString().count("Relation [")
        return settled(df, name)

    monkeypatch.setattr(near_dedup, "settled", counted)
    found = near_dedup.op5_near_dedup(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert read["near-rest"] <= 6, read  # three uses of the compared lists, each with the sets; 39 before
