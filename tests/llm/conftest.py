import pytest

#: Names that operators use inside, as further columns of their input.
CLASHES = ("row", "key", "h", "a", "b", "fp", "rep", "n", "score", "base", "spans", "component_id", "near", "range", "piece", "bytes", "label", "active", "node", "held_out")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""
    long = "many words in a very long text, and password=hunter2hunter2 in it " * 3000
    rows = [(1, "plain words of some text here", "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (5, "plain words of some text here", "de"), (5, "plain words of some text here", "de"), (5, "another text, same id", None), (None, "no id here", "en"), (7, " \t\n", "fr"), (8, "12 34 !!", "fr")]
    extra = {c: "x" for c in CLASHES}
    data = [{"doc_id": i, "text": t, "lang": lang, "source": None, "n_chars": len(t or ""), **extra} for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([tuple(d.values()) for d in data], schema)


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.limit(0)
