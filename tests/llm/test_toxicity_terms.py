import itertools

from sedge.llm import toxicity


def test_every_term_that_passes_is_kept(spark):
    strong = ["".join(c) for c in itertools.product("abcdefghijkl", repeat=3)][:1200]
    rows = [(i, " ".join(strong) + f" own{chr(97 + i)}") for i in range(20)]
    rows += [(i, "zzbad zzworse") for i in range(20, 30)] + [(i, "nice day") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int"))
    assert len(index.vocabulary) > 1200 and "zzbad" in index.vocabulary
    asked = spark.createDataFrame([(1, "a zzbad zzworse thing"), (2, "a nice day")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(asked, index, ["doc_id"]).collect()}
    assert got[1].predicted == 1 and got[1].evidence[0].toxic == 1
    assert got[2].predicted == 0 and got[2].evidence[0].toxic == 0
