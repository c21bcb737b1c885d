import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


def rows_of(seed=5, n=40):
    """Small documents with copies, near copies, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        out.append((i, "\n".join(lines)))
    for i in range(n, n + 12):  # near copies of one text, by one word
        words = out[3][1].split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    out += [(n + 20, out[5][1]), (n + 21, out[5][1]), (n + 22, out[5][1].upper()), (n + 23, ""), (n + 24, None), (n + 25, " \t\n "), (n + 26, "one two"), (n + 27, "One TWO"), (n + 28, LONG), (n + 29, LONG + " tail"), (None, out[5][1]), (None, None), out[7], out[7], (n + 30, "a\x00b \u2581 \u3000 😀\r\n\x0b\x0cz"), (n + 31, "x" * 5000), (-4, out[3][1])]
    return out


@pytest.fixture(scope="session")
def rows():
    return rows_of()


def table(spark, rows, parts=3):
    """The rows with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, cid long, n_words string, score string, doc string, key string, line int, h int, segment int, n_dropped string, rule int"
    return spark.createDataFrame([(*r, 1, "a", "b", "c", None, 2, 3, 4, "d", 5) for r in rows], schema).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from panelstack.llm.store import ship

    ship(spark)
