import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

ODD = [None, "", " ", "\n\n", "word", "a b c", "é ß ñ <|im_end|> \x01 ▁x", "same same same " * 40, "same same same " * 40]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, blank, short, repeated and a long text; an extra column whose name clashes with results."""
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id here", "x"), (50, "long text, " * 30_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")
