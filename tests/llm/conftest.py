import random

import pytest


def make_docs():
    """(doc_id, text): copies, near copies, shared passages, odd texts."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(300)]

    def prose(n):
        out = [r.choice(vocab) for _ in range(n)]
        for k in range(0, n, 9):
            out[k] = out[k].capitalize() + r.choice((".", ",", "", ".\n"))
        return " ".join(out)

    passage = prose(90)
    docs = [(k, prose(r.randint(5, 160))) for k in range(60)]
    docs += [(100 + k, docs[k][1]) for k in range(8)]
    for k in range(40):
        words = docs[r.randrange(20, 30)][1].split(" ")
        for _ in range(r.randint(1, 3)):
            words[r.randrange(len(words))] = r.choice(vocab)
        docs.append((200 + k, " ".join(words)))
    docs += [(300 + k, prose(20) + passage + prose(15)) for k in range(6)]
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "one two"), (405, "a b c d e"), (406, "x" * 1500), (407, "y" * 1200 + "x" * 900), (408, "tail\n"), (409, "same line here\nsame line here\n\nother")]
    docs.append((409, docs[-1][1]))
    return docs


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in docs_rows], "doc_id long, text string, score string, n int, k1 string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
