"""The character model that undoes disguises is of the whole corpus, labelled or not."""

from tabwright.llm import toxicity


def test_words_of_unlabelled_texts_are_restored(spark):
    rows = [(i, "hello yellow fellow") for i in range(40)] + [(40, None), (None, "hello")]
    rows += [(i, f"quiet being heir {i}") for i in range(41, 46)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(i, i % 2) for i in range(41, 46)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        characters, _ = toxicity.train(docs, frame)
        assert toxicity.Restorer(characters).word("he1lo") == "hello"
