"""Small documents with the cases that every operator has to handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for what they add.
CLASHES = ["keep_id", "kept", "score", "lang_pred", "component_id", "n_shingles", "key", "rank", "offset", "length", "n_lines", "a", "b"]


def documents(seed: int = 1, words: int = 40) -> list[tuple]:
    """Nulls, blanks, one-word, long, equal, near and repeated documents, and nulls in every column."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(3 * words), text(30)
    near = base.split()
    near[7] = "changed"
    rows = [
        None,
        "",
        "  \t\n\x0b ",
        "Word",
        "ÄÖ ß naïve 中文 😀",
        base,
        base,
        base.upper(),
        " ".join(near),
        text(10) + " " + passage + "\n" + text(5),
        text(20) + "\n" + passage + " " + text(9),
        "same line here\n" + text(12) + "\nSAME LINE HERE \nsame line here",
        "\tsame line here\n\nsame line here",
        "la " * 70,
        ("ab cd " * 60).strip(),
        " ".join(text(9) + "\n" for _ in range(400)),
        "x" * 20_000,
        *(text(rng.randint(1, 80)) for _ in range(25)),
    ]
    out = [(k, x, ["en", "de", None][k % 3], f"s{k % 4}", None if x is None else len(x)) for k, x in enumerate(rows)]
    return [*out, out[5], out[9], (None, base, None, None, None), (None, None, None, None, None)]


def frame(spark, rows=None, extra=True, parts=3):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({x: F.lit("extra") for x in CLASHES})
    return df.repartition(parts)
