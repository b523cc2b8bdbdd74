"""Small document tables and brute-force versions for the tests of the subpackage."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, starts string, fp string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    """A table of documents with extra columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "x", "y") for i, t in zip(ids, texts)], SCHEMA)


def corpus(seed, n=40):
    """Texts with shared passages, copies, self-repeats, nulls, empties and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(20, 90)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [text(rng.randint(0, 60))]
        if rng.random() < 0.6:
            parts.append(rng.choice(passages))
            parts.append(text(rng.randint(0, 40)))
        if rng.random() < 0.2:
            parts.append(parts[0])
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    out += [out[0], out[0], out[1][:-3] + "zz", None, "", " ", "ab " * 200, text(3000) + passages[0]]
    return out
