from sedge.llm import ngram_join


def test_components_of_null_or_repeated_ids_each_keep_one(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1] + " end"), (7, text[2]), (7, text[3]), (8, text[3] + " end"), (None, text[4]), (9, text[4]), (3, text[5]), (2, text[5]), (None, "")]
    got = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id or 0) for r in got) == sorted([("", 0), (text[0], 0), (text[1], 0), (text[2], 7), (text[3], 7), (text[4], 9), (text[5], 2)])
