import random

import pytest

pytest.importorskip("newsgauge.llm")

#: Columns whose names the operators use inside.
CLASHING = ("row", "rest", "sha", "size", "lead", "salt", "normal", "key", "keys", "hash", "keeper", "n", "id", "a", "b", "bucket",
            "bands", "word", "words", "count", "label", "vector", "rep", "times", "list", "q", "base", "held_out", "digest", "value", "text_a")


def sentence(draw, n, letters="abcdefghij"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def sentences():
    draw = random.Random(5)
    return [sentence(draw, 120) for _ in range(12)]


@pytest.fixture(scope="session")
def odd_texts(sentences):
    """Nulls, empty and white texts, ties, copies, near copies, shared passages and lines, a long text, odd letters."""
    a, b, c, d, e, *rest = sentences
    near = a.split()
    near[60] = "changed"
    passage = " ".join(d.split()[20:80])
    line = "This Line of more than forty letters stands in many documents."
    return [a, a, a.replace(" ", " \t", 3), " ".join(near), None, None, "", " ", "\n\n", "x", "one two three", "one two three", b + " " + passage,
            c + "\n" + passage, d, e + "\n" + line, b + "\n  " + line.upper() + " ", c + "\n" + line, line, line + "\n" + line,
            "y\r\n" + line, "ab " * 80, "né à la façon 漢字 🙂 <|endoftext|> it's  we'll", "w" * 5000, " ".join(rest * 8), *rest]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(k * 3 % 101, t, "xy" if k % 4 else None, None, k) for k, t in enumerate(odd_texts)]
    rows.append(rows[0])  # a repeated row
    extra = ", ".join(f"`{x}` string" for x in CLASHING)
    return spark.createDataFrame([(*r, *("z" for _ in CLASHING)) for r in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_id_docs(spark):
    return spark.createDataFrame([(None, "some words without an id", None), (None, None, None), (None, "some words without an id", None)],
                                 "doc_id long, text string, lang string")
