import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, kept string, n_words int, candidates string, n_lines long, a long, key string"


def messy_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies, shared lines and passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    base, passage, line = prose(120), prose(90), "This very line stands in many documents."
    changed = base.split()
    changed[60] = "changed"
    texts = [
        base, base, " ".join(changed), base.upper(), None, "", "   ", "\n\n", "one", "two words", "a b c d", "a b c d", "a b c d e", prose(30) + passage + prose(20), prose(25) + "\n" + passage,
        passage + " " + passage, f"{prose(20)}\n{line}\n{prose(10)}", f"{line}\n{prose(30)}", f"  {line.upper()}\t\n{line}\n{prose(12)}", f"{prose(60)}\n" * 3, " ".join(["again"] * 80), prose(9000), "x" * 5000,
        "mail ada@mail.example.org or +1 (555) 010-0000 from 10.20.30.40 and 4539 1488 0343 6467.", "\x01\x02 odd marks \x00 @@ a@b 1.2.3.4.5 999.1.1.1 \\ </turn> ###",
    ]
    rows = [(i, t, "en", f"src{i % 2}", None if t is None else len(t), 0.5, "s", "k", 1, "c", 7, 3, "z") for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, base, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((3, prose(40), "en", "src", 1, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
