import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty texts, ties, repeated rows and columns with clashing names."""
    import random

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(70) for _ in range(3)]
    base = text(300)
    rows = [
        (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "ä" * 120), (5, "a" * 300), (6, "a" * 260 + "b"), (7, base), (7, base), (8, base),
        (None, base + " x")
    ]
    for i in range(9, 60):
        t = [text(rng.randrange(5, 160))]
        if i % 3 == 0:
            t += [shared[i % 9 // 3], text(20)]
        if i % 7 == 0:
            w = base.split()
            w[i] = "changed"
            t = [" ".join(w)]
        rows.append((i, "\n".join(t)))
    rows = [(d, t, "en", "s" if i % 3 else None, 1, "p", 2, 3) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, did bigint, version int"
    ).repartition(5)
