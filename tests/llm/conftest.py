import pytest

SF = "/root/testdata/sf0.001"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=1):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies: doc_id, text, source."""
    base = prose(120, 2)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "b"), (5, base, "c"), (6, near, "d"), (7, prose(8, 3), "e"), (8, prose(8, 3), "e"),
        (9, "Line one\nshared line here\n" + prose(30, 4), "f"), (10, prose(20, 5) + "\nshared line here", None), (11, prose(20_000, 6), "g"), (12, "x" * 300 + " y", "h"),
        (13, "x" * 260, "h"), (14, "äöü ß 漢字 " * 30, "i"), (15, "one two three four", "j"), (16, "ONE two three four", "j"), (17, ("a b c d e " * 40).strip(), "k"), (18, base + " " + prose(10, 7), "l"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, source string")
