import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """``(doc_id, text)`` of the smallest documents table."""
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


#: Null, empty, blank, one word, repeated rows, marks, non-ASCII, a very long text and one long word.
EDGE_TEXTS = [
    None,
    "",
    " \t\n ",
    "word",
    "a b c d e",
    "same row text of several words here",
    "same row text of several words here",
    "Ünïcödé ▁ 日本語 text   and \x00 nul",
    "alpha beta gamma delta epsilon " * 400,
    "x" * 5000,
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts under clashing extra columns, with one key null and one key twice."""
    clash = ["n_words", "n_removed", "kept", "n_bytes", "n_spans", "score", "pieces", "component_id", "n_shingles", "block", "rows", "slot", "position", "host"]
    keys = [None, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    rows = [(k, t, *["clash"] * len(clash)) for k, t in zip(keys, EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
