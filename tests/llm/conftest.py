import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parent))  # one test file reads another; last, as a file above has the same name as one here

#: Cases that every operator on documents must stand: null text, blank and empty texts, repeated rows, a very long word.
HARD = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "one", "de", None), (5, "one", "de", None), (5, "one", "de", None),
    (6, "x" * 70_000, "en", "b"), (7, "word " * 3000, "en", "b"), (None, "no id here", "en", "a"), (8, "é ü  ñ z 　 </s>[INST] <|endoftext|> ok", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in HARD], SCHEMA + ", n_words int, sha string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
