import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Invented texts with exact and near copies, nulls, empty and long ones, repeated rows, and columns of clashing names."""
    rng = random.Random(5)
    syllables = "ka lo mi ren tu vas pel dor shi ong".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        base = text(rng.randint(3, 120))
        rows.append((len(rows), base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = base.split()
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    for t in (None, "", "   \n\t", "Only four words here", "only FOUR words  here", text(30_000), "naïve café 漢字 😀 <|endoftext|> x", "a" * 5000):
        rows.append((len(rows), t))
    rows.append(rows[3])
    cols = ["doc_id", "text", "lang", "source", "n_chars", "bucket", "rep", "key", "words", "word"]
    data = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "k", "w", "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, bucket int, rep int, key string, words string, word string").select(cols).repartition(5)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
