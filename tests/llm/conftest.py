import random

import pytest


@pytest.fixture
def dice():
    return random.Random(5)


@pytest.fixture
def documents(spark):
    """A table like ``documents`` from (id, text) pairs, with a column that clashes with inner names."""

    def make(rows, parts=2):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, _id string"
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


