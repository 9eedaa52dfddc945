import pytest

from docweave.llm.store import ready

LONG = "alpha beta gamma delta " * 6000
PROSE = (
    "The committee met on Tuesday to discuss the new harbour wall and the cost of stone from the northern quarry. "
    "Several members asked whether the old plan could still be used, since the tide tables had been revised twice. "
    "In the end a smaller group was asked to report again before winter, with drawings and a list of prices."
)

ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "b"),
    (3, PROSE.replace("winter", "spring"), "en", "a"),
    (4, "", "en", None),
    (5, None, None, None),
    (6, " \t\r\n\x0b\x0c ", "xx", "c"),
    (7, "One", None, "c"),
    (8, "two words", "de", "c"),
    (9, LONG, "en", "a"),
    (10, "x" * 30_000, "en", "a"),
    (11, "Ünïcode ▁ text 🙂 日本語\n\n  a  b <|endoftext|> it's\x00\x1c.\n", "fr", "a"),
    (12, "mail a.b@c.example.com, +1 (555) 555-0123 or 10.0.0.255; card 4111 1111 1111 1111.", "en", "a"),
    (12, "mail a.b@c.example.com, +1 (555) 555-0123 or 10.0.0.255; card 4111 1111 1111 1111.", "en", "a"),
    (None, "no id " + PROSE, "en", "a"),
    (13, "same line\nsame line\nsame line\n### $$$ | <b>", "es", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    ready(spark)
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], COLUMNS)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows with columns whose names the operators use themselves."""
    names = ["node", "key", "n", "score", "spans", "model", "length", "row", "part", "ids", "first", "kept", "toxic", "batch", "group", "n_words"]
    return docs.selectExpr("*", *[f"'{c}' AS `{c}`" for c in names])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
