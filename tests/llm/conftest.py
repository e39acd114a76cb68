import pytest


@pytest.fixture(scope="session", autouse=True)
def _package_on_workers(spark):
    from precis.session import ship_package
    ship_package(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, target double, reps long, score double, bucket int, id long, key long, h1 long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like internal ones."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", "   ", "one", "a b c d e f g", "a b c d e f g", "a b c d e f g", long, long + " tail",
             "x\ny\tz  w", "é ß 漢字 <s> <|endoftext|>", "z" * 5_000]
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", None, 1, 2.0, 3, 4.0, 5, 6, 7, 8) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here at all now", None, "src9", None, *range(1, 9))]
    rows = [tuple(float(v) if k in (6, 8) and v is not None else v for k, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, DOCS + EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS + EXTRA)
