import random

import pytest

EXTRA = "key string, part int, piece int, shard int, n long, spans string, score double, lang string"


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text)]): a frame with further columns whose names the operators use themselves."""
    def make(rows, parts=3):
        schema = f"doc_id long, text string, {EXTRA}"
        return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "s", 0.5, "en") for i, t in rows], schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with shared passages, near and exact copies, odd white space, NULLs, empty and long ones."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "und", "é", "ß1", "x"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
                                                        for _ in range(400)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [sentence(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for k in range(60):
        words = sentence(rng.randint(0, 80))
        for passage in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = passage
        text = "".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\n\n"]) for w in words)
        rows.append((k * 7 % 61, text))
    texts = dict(rows)
    rows += [(100 + k, texts[k * 7 % 61]) for k in range(5)]
    rows += [(200, None), (201, ""), (202, None), (203, " \n"), (204, "short"), (205, "a b c"), (206, "a b c")]
    rows += [(300, " ".join(sentence(5000))), (301, rows[0][1]), (301, rows[0][1]), (7, rows[1][1])]
    rows += [(400, "the of " * 60), (401, "the of " * 50)]
    return rows
