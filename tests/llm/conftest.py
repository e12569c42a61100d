import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, start=0, step=7):
    return " ".join(WORDS[(start + i * step + i * i) % len(WORDS)] + str((start * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, and columns named like the operators' own."""
    rows = [(1, prose(60), "en", "s", 1), (1, prose(60), "en", "s", 1), (2, None, None, None, None), (None, prose(40, 5), "en", "s", 1), (3, "", "en", "s", 1), (4, "  \n\t\n", "en", "s", 1), (5, prose(60).replace("\n", " "), "de", "s", 1), (6, "é ñ 日本 🙂 \x00 <|endoftext|>", "x", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, sid long, h long, n_tokens long, kept string"
    return spark.createDataFrame([(*r, 0.5, 9, 9, 9, "no") for r in rows], names)


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
