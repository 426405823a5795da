from __future__ import annotations

import random

import pytest

CLASH = ["_key", "_text", "_t", "_k", "_sha0", "c", "sig", "row", "v", "shard", "host", "path", "part", "recipe", "root", "n"]


def prose(rng: random.Random, n: int, vocabulary: int = 200) -> str:
    return " ".join("".join(rng.choice("abcdefghilmnorst") for _ in range(2 + w % 6)) for w in rng.choices(range(vocabulary), k=n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text, lang): null and empty texts, copies, near copies, ties, long words and texts, odd characters, a null id."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 8, 40, 120, 121, 300)]
    words = base[4].split(" ")
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (5, 60, 100)]
    long_text = prose(rng, 6000)
    out = [*base, *near, base[0], base[0].upper(), base[3], None, None, "", " \t\n ", "one", "two words", "x" * 5000, long_text, long_text,
           long_text + " end", "Ünïcode ÄÖ ß naïve 'll it's don't  we've 12345 ½ \u00a0\u2003x \x1c\x85 \x00 \U0001F600 e\u0301", "<|endoftext|> '", "a\x0bb\x0cc\rd",
           "!!! 123 ??", "Привет мир это текст", "words Привет words"]
    rows = [(i, t, ["aa", "bb", None][i % 3]) for i, t in enumerate(out)]
    return [*rows, (3, base[3], "aa"), (None, "a text without a key", None), (None, base[2], "bb"), (900, base[2], None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in texts],
                                 "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(4)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id = -5").coalesce(1)


def low(text: str | None) -> str:
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
