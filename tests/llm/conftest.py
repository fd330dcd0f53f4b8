import random

import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Ordinary rows beside the odd ones: nulls, empty and very long texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    syllables = "the of and er in an ti on es".split()

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    long = prose(30_000)
    rows = [(i, prose(rng.randint(1, 300)), rng.choice(["en", "de", None]), "s", 1) for i in range(40)]
    rows += [(100, None, "en", None, None), (101, "", "en", "s", 0), (102, " \n\t ", None, "s", 4), (103, long, "en", "s", len(long)),
             (104, long + " end", "en", "s", len(long) + 4), (None, "no key here", "en", "s", 11), (None, None, None, None, None),
             (105, "twice the same", "en", "s", 14), (105, "twice the same", "en", "s", 14), (106, "é漢字👍🏽 <|endoftext|> x", "fr", "s", 20),
             (107, "a" * 5000, "en", "s", 5000), (108, "one\none\none\n\none", "en", "s", 16)]
    base = spark.createDataFrame(rows, SCHEMA)
    return base.selectExpr("*", "1 AS score", "'x' AS n_tokens", "2 AS fp", "3 AS length", "'y' AS kept", "0 AS _words")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_path():
    return public_tokenizers.path("byte_bpe_50k.json")
