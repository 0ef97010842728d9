import pytest

from gaugelake.llm.shared import importable


@pytest.fixture(scope="session", autouse=True)
def on_workers(spark):
    importable(spark)


PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): NULL, empty, blank, tied, repeated, tiny and very long texts, copies and shared passages."""
    return [
        (0, "one two three"), (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "A"), (6, f"before that {PASSAGE} after this"),
        (7, f"other words first {PASSAGE}"), (8, f"other words first {PASSAGE}"), (9, PASSAGE.upper()), (10, LONG), (11, LONG + " end"),
        (12, "é" * 80 + " tail"), (13, "x " + "é" * 80), (14, "same\nsame\nsame\nother"), (15, "a" * 3000), (16, "b" + "a" * 3000),
        (17, f"repeated row {PASSAGE}"), (17, f"repeated row {PASSAGE}"), (18, f"one id {PASSAGE} of two"), (18, "one id, two texts"),
        (None, f"{PASSAGE} without id"), (None, None), (20, "\x00nul\x1cbyte\x85nel \u2028line 日本語 ’quote’"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    clashing = "h key body node root size tokens group kept spans words rank chunk mid band signature length piece carried tkey __p_x"
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string")
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in clashing.split()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
