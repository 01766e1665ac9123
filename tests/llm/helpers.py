"""Small frames that hold the odd cases every operator has to bear."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score string, kept string, id string, tokens string")   # the last four clash on purpose

WORDS = ("the of and river stone light over under green house walk talk seven moon paper glass "
         "north wind table chair window garden summer winter letter number silver copper").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing", ","]) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", "t")


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows():
    """NULLs, empty and blank texts, repeated rows, a NULL id, a long text."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    return [row(1, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "two words"),
            row(6, "Zürich 東京 ñandú é x"), row(7, long), row(8, "same text here again"),
            row(8, "same text here again"), row(9, "same text here again", None, None),
            row(None, "no id at all here"), row(10, None, None, None),
            row(11, "a" * 5000), row(12, "x y " * 400)]
