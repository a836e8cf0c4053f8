"""Small tables that every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, given string, doc int, row int, hits string, kept int, score string"


def table(spark, rows):
    """Documents with extra columns whose names operators use themselves; rows are (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "g", 1, 2, "h", 3, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, words=120, vocabulary=400):
    """Text of made-up words, with line ends."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(words):
        out.append(rng.choice(known))
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out)


#: Nulls, empty and blank texts, repeated rows, equal texts under several ids, unusual letters.
EDGES = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "é ß 😀 \x00"), (4, "é ß 😀 \x00"), (None, "no id here at all"), (None, None),
    (5, "One line that is long enough\nshort\nOne line that is long enough"), (6, "  one LINE that is long enough \nshort"),
    (7, "short\nshort"), (8, None), (9, "One line that is long enough"), (-3, "x" * 300), (10, "x" * 300),
]
