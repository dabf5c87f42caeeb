"""Documents that share an id."""

from tessera.llm import simhash


def test_each_component_keeps_a_row_though_ids_repeat(spark):
    texts = [" ".join(f"{a}{i}" for i in range(200)) for a in "xy"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (None, 0.8):
        assert sorted(tuple(r) for r in simhash.keep_first(df, similarity=similarity).collect()) == sorted(rows[:2])
