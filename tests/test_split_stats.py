from corpusloom.operators import splits


def test_first_ids_of_each_split(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 5, 1) for i in range(60, 0, -1)], "id long, split string, source int, n long")
    out = {r.split: r for r in splits.split_stats(df, "split", "source", "n", "id", head=4).collect()}
    assert out["a"].ids == [1, 2, 4, 5] and out["b"].ids == [3, 6, 9, 12]
    assert out["a"].rows == 40 and out["b"].first_id == 3 and out["b"].last_id == 60
