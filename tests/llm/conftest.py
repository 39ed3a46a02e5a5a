import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

UGLY = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, 0.5),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, 0.5),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 5, 0.5),  # a repeated row
    (3, None, "en", "a", None, None),
    (4, "", None, None, 0, 0.1),
    (5, " \n\t ", "de", "b", 3, 0.1),
    (6, "ONE Two three four five six seven eight nine ten eleven zwölf 日本", "fr", None, 7, 0.2),
    (7, "short", "fr", "b", 5, 0.2),
    (8, "x" * 30_000 + " y" * 40_000, "en", "b", 9, 0.3),
    (None, "no id here at all, none", None, "c", 1, 0.3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def ugly(spark):
    """Nulls in any column, empty and very long texts, a repeated row, and a column whose name clashes with results."""
    return spark.createDataFrame(UGLY, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
