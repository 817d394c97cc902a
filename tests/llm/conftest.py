import re

import pytest

ROOT_TABLES = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = {"spaced": re.compile(r"[^\x20\x09-\x0D]+"), "alnum": re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def plain_words(text, kind):
    """Words by the regular expressions, for comparison."""
    return _WORDS[kind].findall((text or "").translate(_LOWER))


@pytest.fixture
def split():
    return plain_words


#: Texts with the awkward cases: null, empty, blanks only, repeated rows, a very long word, long text, odd breaks.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "no id at all here"), (5, "x" * 50_000), (6, "two words"),
    (7, "a b c " * 3000), (8, "a b c " * 3000), (9, "É ß ñ ж 漢字 \u2028 z"), (10, "\n\n\n"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en" if t else None, None if i == 3 else "s", 7) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
