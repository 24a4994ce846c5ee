"""The pipeline's marks of a text come from one Python function: each further one in a
row takes another worker for a task, whose memory the executor holds to the end."""

from tabwright.llm import simhash


def test_marks_of_texts_are_one_python_node(spark, capsys):
    texts = ["a b c d", "a b  c d", "x y z", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    marked = simhash._marked(docs, 3)
    marked.distinct().explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    found = {(r["whole"], r["fp"]) for r in marked.collect()}
    fps = {r["text"]: r["fp"] for r in simhash.with_fingerprint(docs, width=3).collect()}
    assert found == {(simhash.whole_text(t), fps[t]) for t in texts}
