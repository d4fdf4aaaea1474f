import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own results
        T.StructField("n_words", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:03d}")


def prose(rng, n, vocabulary=400):
    return " ".join(word(rng.randrange(vocabulary)) + rng.choice(["", "", ".", ",", "é"]) for _ in range(n))


def corpus(seed=0):
    """Texts with nulls, empties, copies, near copies, a shared passage, one long text and odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(25)]
    texts = [None, None, "", " \t\n", "one", "two words", "É ü ñ", "a b c d", "a b c d e", "A B c D e"]
    texts += base + base[:6] + base[:2]
    for t in base[:10]:
        words = t.split(" ")
        for _ in range(rng.randint(1, 3)):
            w = list(words)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            texts.append(" ".join(w))
    shared = prose(rng, 90)
    texts += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(5)]
    texts.append(prose(rng, 6000))
    texts.append("x" * 1500)
    texts.append("é" * 700)
    texts += ["\n".join(["same line here"] * 40), "licensed under CC BY 4.0\nAll rights reserved. GNU General Public License, version 3"]
    return texts


@pytest.fixture(scope="session")
def rows():
    texts = corpus()
    out = [(i, t, "en", None if i % 17 == 0 else f"src{0 if i % 3 == 0 else i % 7}", None, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    out += [out[12], out[12], out[0]]  # repeated in full
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
