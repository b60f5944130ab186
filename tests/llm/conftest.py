"""Small tables with the awkward cases that every corpus operator must bear."""

import pytest

WORDS = "the cat sat on a mat and looked at the old grey house while rain fell over green hills near town".split()


def prose(n: int, seed: int) -> str:
    """n words, different for each seed."""
    return " ".join(f"{WORDS[(i * 7 + seed * 3 + i * i * seed) % len(WORDS)]}{(i * seed) % 11}" for i in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, node string, h1 string, score string, shard string, body string"


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "clash", "clash", "clash", "clash", "clash", "clash")


def awkward_rows():
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, repeated ids, clashing column names."""
    long = prose(30_000, 5)
    return [
        row(1, prose(60, 1)), row(2, prose(60, 1)), row(3, prose(60, 1) + " tail"), row(4, prose(80, 2), None, None),
        row(5, None), row(6, ""), row(7, " \n\t \n"), row(8, "one"), row(9, "one"), row(10, "no letters?".replace("no letters", "123 !")),
        row(11, long), row(12, "x" * 200_000), row(13, "same line\nsame line\nsame line\n\nother"), row(None, prose(40, 3)), row(None, None, None, None),
        row(20, prose(50, 7)), row(20, prose(50, 7)), row(21, prose(50, 8)), row(21, prose(55, 9)), row(22, "ünïcödé 😀 straße"), row(23, "<|endoftext|> x y"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
