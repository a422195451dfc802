"""Small documents with what goes wrong: nulls, empties, repeats, odd characters, clashing names."""

import random

WORDS = ["alpha", "Beta", "gamma,", "delta", "épée", "straße", "zeta.", "eta", "theta", "iota", "kappa", "x1", "42", "don't", "we'll", "END"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(900)) if rng.random() < 0.6 else "") for _ in range(n))


def texts(seed=3, n=24):
    rng = random.Random(seed)
    out = [prose(rng, rng.choice([1, 2, 5, 40, 200])) for _ in range(n)]
    out += [None, "", " ", "\n\n", "one", "one", "!!!", "tab\tand  runs \n\n\n of space ", "日本語 текст <|endoftext|> mixed", "\x1c\x85odd\xa0space", "x" * 5000, "İstanbul ß ŉ ſ ²³ 1/2", "a'b 's 'll it'S we'RE ''s", out[3], out[3]]
    return out


def documents(spark, rows=None, start=0):
    """doc_id, text and columns whose names operators use themselves."""
    rows = [(i + start, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "k", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n long, id long, key string, start int")
