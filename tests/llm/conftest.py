"""Small tables with every awkward case, and helpers to run an operator on them."""

import random

import pytest
from pyspark.sql import types as T

#: Columns of the documents, then columns whose names clash with those that operators use inside.
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("file", "row", "digest", "kept", "_at", "_file", "_row", "_copies", "size", "words", "rid", "_sampled")]
)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edited(rnd, text, share):
    parts = text.split(" ")
    for k in rnd.sample(range(len(parts)), max(1, int(len(parts) * share))):
        parts[k] = f"x{rnd.randrange(10**6)}"
    return " ".join(parts)


def rows(texts, sources=("b", "a", None, "c")):
    return [(k, t, "en", sources[k % len(sources)], len(t or ""), *["z"] * 12) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward_texts():
    rnd = random.Random(4)
    base = [words(rnd, n) for n in (3, 1, 2, 40, 60, 80, 300, 900)]
    long = words(rnd, 60_000, 5000)
    near = [edited(rnd, base[5], 0.03) for _ in range(12)] + [edited(rnd, base[6], 0.02) for _ in range(12)]
    passage = words(rnd, 70)
    holders = [words(rnd, 30) + " " + passage + "\n" + words(rnd, 30) for _ in range(4)]
    return [None, "", None, " \n\t ", *base, *base[:4], *near, long, long + " end", *holders, "Ünï " * 80, "a" * 700, "tail"]


@pytest.fixture(scope="session")
def awkward(spark, awkward_texts, tmp_path_factory):
    """Parquet documents with nulls, empty and long texts, copies, near copies, repeated rows and null ids."""
    data = rows(awkward_texts)
    data += [data[7], data[7], (None, "no id", None, None, None, *[None] * 12), (None, "no id", None, None, None, *[None] * 12)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(data, DOCS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
