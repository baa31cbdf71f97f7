"""Hand-made documents with nulls, blanks, ties, repeats and a long text, and one column too many."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"
WORDS = "the of and to in is that house river stone green walk under maison fleuve der die und haus".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 90)) for _ in range(n)]
    texts += [None, "", " \n\t ", "a", "123 456", "!!!", texts[0], texts[0], texts[1].replace(" ", "\n"), texts[2] + " ", texts[3].upper()]
    texts += [sentence(rng, 30_000), "x" * 50_000, "é" * 3000 + " ß 漢字 \U0001f600", "\n".join(["same line here twice"] * 5)]
    rows = [(k, t, ("en", "fr", "de", None)[k % 4], (None, "a", "b", "", "b")[k % 5], 0, "kept?", "size?") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4]]  # the same row again
    rows += [(None, "an id that is null, the text of it", "en", "a", 0, None, None), (None, texts[0], "en", "a", 0, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
