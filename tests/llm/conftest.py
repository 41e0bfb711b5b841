import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, body string, node long, comp long, band long, salt int, kept boolean, domain string, epochs long, cut string, words string, n long"


def messy(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if k % 5 == 4 else ("en", "de")[k % 2], None if k % 7 == 6 else f"src{k % 12}", 0, "t", "b", 1, 1, 1, 1, True, "d", 9, "c", "w", 3) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "one", "two words here", "x " * 30_000 + "end", "Ünïcödé ß 漢字 \U0001f600", "tie", "tie", "t i\te", "a\x0bb\x0cc\rd"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, a very long text, ties, a repeated row and a null id."""
    return messy(spark, [*ODD, "tie", "lost id"], [*range(len(ODD)), 7, None])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
