import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.\nShared line of many sites here", "en", "s1", 10),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nShared line of many sites here", "en", "s2", 10),
    (3, "", "en", "s3", 0),
    (4, None, "en", "s4", None),
    (5, "   \n\t ", None, None, 3),
    (None, "a text without an id\nShared line of many sites here", "en", "s5", 5),
    (6, LONG, "en", "s1", len(LONG)),
    (7, "Ein kurzer Satz über den Fluss und die Straße, der nicht lang ist.\nShared line of many sites here", "de", "s6", 20),
    (7, "Ein kurzer Satz über den Fluss und die Straße, der nicht lang ist.\nShared line of many sites here", "de", "s6", 20),
    (8, "tiny", None, "s7", 4),
    (9, "mail bob.42@mail7.example.com from 10.0.0.1 card 4111 1111 1111 1111 tel +1 (017) 555-7713\nShared line of many sites here", "en", "s8", 9),
]
#: Names that operators use themselves.
CLASHING = ["id", "a", "b", "h", "w", "copy", "n_copies", "mix_key", "rank", "score", "bucket", "text_hash", "gone", "pieces", "n_lines", "n_removed", "block", "lang_pred", "m_source", "kept"]


@pytest.fixture(scope="session")
def edge(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("doc_id < -1")
