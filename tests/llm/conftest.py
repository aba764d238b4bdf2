import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EN = "the cat sat on a mat and then it ran over the hill to see what was there with all of them".split()
FR = "le chat est sur la table et puis il va dans les champs pour voir ce que nous avons avec eux".split()


def sentence(words: list[str], rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def rows() -> list[tuple]:
    """Documents with nulls, empty and very long texts, ties, repeated rows and copies."""
    rng = random.Random(5)
    out = [(k, "\n".join(sentence(EN if k % 2 else FR, rng, 12) for _ in range(1 + k % 4)), "en" if k % 2 else "fr", f"s{k % 3}", 1) for k in range(60)]
    long = " ".join(sentence(EN, rng, 15) for _ in range(900))
    out += [(100, long, "en", "s0", 1), (101, long + " tail", "en", "s0", 1), (102, "x" * 70_000, "en", None, None), (103, " " * 40_000 + "end", None, "s1", 1)]
    out += [(110, None, "en", "s1", None), (111, "", None, None, None), (112, " \t\n", "fr", "s2", 3), (113, "1234 5678 !!", "en", "s1", 9)]
    out += [(1, out[1][1], "en", "s1", 1), (1, out[1][1], "en", "s1", 1), (120, out[3][1].replace(" ", "  "), "en", "s0", 1), (None, out[5][1], "en", "s0", 1), (None, None, None, None, None)]
    out += [(130, "Ünïcödé ﬁ İstanbul ΑΣ 北京 💡 a\x1cb c Don't we'll <|endoftext|>", "en", "s0", 1), (131, "été Å", "fr", "s0", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """A plain scan of files, with columns whose names clash with those of results."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    extra = "doc_id, text, lang, source, n_chars, 'x' AS fingerprint, 7 AS sequence_id, 'y' AS component_id, true AS kept, 'z' AS start, 1.5 AS score, 'd' AS digest"
    spark.createDataFrame(rows(), DOCS).selectExpr(*extra.split(", ")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)
