import random

import pytest

#: Columns that operators might use as names of their own.
CLASHING = "key words rep comp h pos n line norm base found keep runs start gram sig tokens grp batch bucket __row __keep".split()


def make_docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, ["en", "de", None][k % 3], ["s0", "s1", "", None][k % 4], None if t is None else len(t), *["x"] * len(CLASHING))
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


def vocabulary(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """Nulls, empties, blanks, long texts, repeated lines and words, copies, near copies, odd characters."""
    rng = random.Random(7)
    vocab = vocabulary()
    base = prose(rng, 300, vocab)
    passage = prose(rng, 60, vocab)
    edited = base.split()
    for i in (40, 140, 240):
        edited[i] = "changed"
    texts = [
        None, "", " ", "\n\n", "word", base, base, " ".join(edited), prose(rng, 80, vocab) + "\n" + passage + "\n" + prose(rng, 90, vocab),
        passage + " " + prose(rng, 70, vocab), prose(rng, 20000, vocab), "For " * 300, "For " * 170 + passage, "a line of text here\n" * 40,
        "A Line Of Text Here \n\tunique é É line one\nshort\nA LINE OF TEXT HERE", "É é ß İ K \x00\x01   漢字 " * 10, "#$% " * 60 + base, base.upper(),
        "mail jo.doe@mail.example.com, card 4111 1111 1111 1111, ip 10.0.0.255 phone +1 (212) 555-0100",
        "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3. all rights reserved", passage, passage,
    ]
    return texts


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    """The hard texts, with a repeated row, a repeated id with another text, and null ids."""
    ids = list(range(len(hard_texts)))
    return make_docs(spark, [*hard_texts, hard_texts[5], "another text under a used id " * 9, hard_texts[5], None], [*ids, 5, 9, None, None]).cache()


@pytest.fixture(scope="session")
def no_docs(spark, hard_docs):
    return spark.createDataFrame([], hard_docs.schema)
