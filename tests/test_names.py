from pyspark.sql import functions as F

from brightloom.operators import learning, retrieval, snapshot


def test_chunks_of_columns_with_the_names_of_helpers(spark):
    for key, text in (("_at", "_n"), ("chunk_no", "text"), ("id", "_at")):
        got = retrieval.chunks(spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None)], f"`{key}` int, `{text}` string"), key, text, 4, 3).toDF("key", "no", "chunk")
        assert sorted(map(tuple, got.collect())) == [(1, 0, "abcd"), (1, 1, "def")]


def test_changes_with_the_names_of_helpers(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id int, name string, mail string")
    rows = [(1, "B", "q", 1, ["name"]), (1, "d", None, 2, ["name", "mail"]), (2, "d", "y", 3, ["name"]), (2, "e", "y", 4, ["name"]), (9, "f", "f", 5, ["name"])]
    plain = spark.createDataFrame(rows, "id int, name string, mail string, at int, fields_set array<string>")
    odd = plain
    for c in ("_key", "_new", "_ahead", "_own0", "_own1", "_order", "_n"):
        odd = odd.withColumn(c, F.lit("other"))
    for changes in (plain, odd):
        assert sorted(map(tuple, snapshot.refused_changes(old, changes, "id", ["name", "mail"], "at").collect())) == [(1, 1), (2, 3)]
        got = snapshot.patch_unique(old, changes, "id", ["name", "mail"], ["name", "mail"], "at").collect()
        assert sorted(map(tuple, got), key=str) == [(1, "d", None), (2, "e", "y"), (None, "c", "z")]


def test_splits_are_the_same_with_classes_beyond_the_broadcast(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, if(id % 3 = 0, 0, id % 50)) as y", "'a' as _want")
    sent = sorted(map(tuple, learning.stratified_split(df, "id", "y", 0.3).collect()), key=str)
    monkeypatch.setattr(learning, "SENT_CLASSES", 0)
    split = learning.stratified_split(df, "id", "y", 0.3)
    assert "SortMergeJoin" in split._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, split.collect()), key=str) == sent and len(sent) == 500
    assert learning.stratified_split(df.limit(0), "id", "y", 0.3).count() == 0
