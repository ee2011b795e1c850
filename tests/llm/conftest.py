import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables absent")
    return SF


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, texts, extra=""):
    """doc_id, text (and an unused column with a clashing name) of some texts; an item may be (id, text)."""
    pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "x", "s", 0, "clash") for i, t in pairs],
                                 "doc_id long, text string, lang string, source string, n_chars long, _text string")
