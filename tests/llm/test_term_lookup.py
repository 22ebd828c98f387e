import random
from collections import Counter

from sedge.llm import toxicity


def test_terms_looked_up_by_their_first_letters_are_all_terms(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED_WORDS", 50)
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abß", k=rnd.randint(1, 8))) for _ in range(3000)]
    every = sorted({t for w in words for t in toxicity.terms_of_word(w)})
    vocabulary = {t: i for i, t in enumerate(rnd.sample(every, len(every) // 5))}
    for known in (None, vocabulary):
        count = toxicity.TermCounter(known)
        for a in range(0, len(words), 60):
            own = [t for w in words[a : a + 60] for t in toxicity.terms_of_word(w) if known is None or t in known]
            want = Counter(t if known is None else known[t] for t in own)
            text = "; 1_".join(words[a : a + 60]).upper().replace("SS", "ß")
            assert list(count(text).items()) == list(want.items()) and count.present(text) == set(want)
            assert len(count.ids.__self__) <= 51 + 1
    assert count(None) == {} and count.present("") == set()


def test_counted_texts_score_as_texts_do(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("toxic"))
    index = toxicity.fit(docs, labels)
    terms = sorted(index.vocabulary, key=index.vocabulary.get)
    counted = toxicity.term_counts(docs, terms, ["doc_id"])
    df, n = toxicity.summed(counted, len(terms))
    want = toxicity.corpus_frequencies(docs, terms)
    assert len(terms) and (df == want[0]).all() and n == want[1]
    got = toxicity.score(counted, index, ["doc_id"], counted=True).orderBy("doc_id").collect()
    assert got == toxicity.score(docs, index, ["doc_id"]).orderBy("doc_id").collect()
