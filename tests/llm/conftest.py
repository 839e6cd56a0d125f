import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

CLASHES = "row key _text base found _id id hash at rep component_id keep".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of texts (ids from 0), or of (doc_id, text) pairs, with columns whose names clash with those that operators make."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en" if i is None or i % 2 else None, None, None if t is None else len(t), 1, "x", 0, *"abcdefghijkl") for i, t in rows]
        return spark.createDataFrame(rows, DOCS + ", n int, fp string, label int" + "".join(f", {c} string" for c in CLASHES)).repartition(3)

    return make

