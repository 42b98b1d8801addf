import pytest

#: Columns that operators might use inside; as extra columns of the input they must do no harm.
CLASHING = ("key", "id", "rid", "fp", "h", "n", "start", "place", "part", "score", "label", "values", "copy", "group_", "sequence_id", "offset", "piece", "length", "shard", "media", "spans", "body")

CASES = [
    (5, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (9, "the  quick\tbrown fox jumps over the lazy dog and runs far away from here today"),
    (7, None),
    (8, ""),
    (None, "a null key with some words of its own that nobody else has at all in this table"),
    (11, "één wörd ünd mehr — with “marks” and 😀 <|endoftext|> inside"),
    (12, "word"),
    (13, "\n \n  \t x  y\u00a0 z "),
    (14, "ha " * 9000),
    (15, "unbroken" * 4000),
    (2, "repeated row"),
    (2, "repeated row"),
    (2, "the same key with another text"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(k, t, *range(len(CLASHING))) for k, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    from tidelog.llm import tokens

    return tokens.public_vocabulary()
