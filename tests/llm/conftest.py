import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, t long, key string"


def words(rng, n, vocabulary=400):
    return [f"{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10 % 10]}o{w}" for w in (rng.randrange(vocabulary) for _ in range(n))]


def sentence_text(rng, n):
    out, line = [], []
    for w in words(rng, n):
        line.append(w)
        if rng.random() < 0.1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    out.append(" ".join(line) + ".")
    return "\n".join(" ".join(out[k : k + 4]) for k in range(0, len(out), 4))


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts, copies, near copies, shared passages, junk, and edge cases."""
    rng = random.Random(42)
    out = {}
    base = [sentence_text(rng, rng.randrange(30, 250)) for _ in range(40)]
    passage = " ".join(words(rng, 70))
    for k, t in enumerate(base):
        out[k] = t
    for k in range(6):
        out[100 + k] = base[0]  # exact copies
    for k in range(6):
        w = base[1].split(" ")
        w[rng.randrange(len(w))] = f"changed{k}"
        out[200 + k] = " ".join(w)  # near copies
    for k in range(4):
        out[300 + k] = base[10 + k] + "\n" + passage + "\n" + base[20 + k]
    out[400] = " ".join(f"{w}###" for w in words(rng, 120))
    out[401] = ("buy " * 90).strip()
    out[402] = " | ".join(words(rng, 80))
    out[403] = "THE!! END!! " * 40
    out[500] = ""
    out[501] = None
    out[502] = "   \n\t "
    out[503] = "one two three"
    out[504] = "ÀÉ ünïcode — dash… 日本語 " * 12
    out[505] = " ".join(words(rng, 6000))  # very long
    out[506] = "x" * 199
    out[507] = "ab" * 300
    out[508] = "line\n\nline\n\n  \nline end"
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with those of results; one repeated row."""
    rows = [(i, t, "en", "src0", len(t or ""), "s", 1, 2, "k") for i, t in texts.items()]
    rows.append(rows[3])
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
