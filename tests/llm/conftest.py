import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n made-up words with punctuation and line ends."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        out = []
        for _ in range(n):
            out.append("".join(r.choice(["ba", "ko", "Li", "mé", "tu", "zor", "7", "xin"]) for _ in range(r.randint(2, 4))) + r.choice(["", "", "", ",", "."]))
        return "".join(w + r.choice([" ", " ", " ", " ", "\n"]) for w in out).strip()

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """doc_id, text, lang, source, n_chars: copies, near copies, shared passages, nulls, empty and long texts."""
    base = [prose(i, 40 + 7 * i) for i in range(12)]
    texts = list(base)
    texts += [base[3], base[3], base[5].upper(), base[3] + " tail"]
    near = base[8].split(" ")
    for i in range(5):
        w = list(near)
        w[i * 3] = f"other{i}"
        texts.append(" ".join(w))
    passage = prose(99, 80)
    texts += [prose(100 + i, 30) + "\n" + passage + "\n" + prose(200 + i, 25 + i) for i in range(6)]
    texts += [None, "", " \n\t ", "one two", "One, two!", prose(7, 6000) + " " + passage, "same line\nsame line\n\n" + prose(300, 20)]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
