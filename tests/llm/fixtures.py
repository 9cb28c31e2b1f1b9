"""Small documents with every odd case: nulls, empties, ties, repeats, a long text, clashing extra columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and river stone light house garden winter paper music north über größe año niño été école 東京 café".split()
SHARED = "This very line is shared by many documents here."


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", ","]) for _ in range(n))
    plain = ["\n".join(sentence(rng.randint(3, 14)) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    plain = [t + "\n" + SHARED if i % 3 == 0 else "  " + SHARED.upper() + "\t\n" + t if i % 7 == 0 else t for i, t in enumerate(plain)]
    odd: list[str | None] = [
        None, "", " \t\n", "\n\n", "one", "one two three", "a b c d e " * 30, "### $$$ ***\n" * 4 + "word",
        "mail jo.doe@mail.example.com or call +1 (613) 555-3280, ip 10.0.0.255 or 300.1.1.1, card 4111 1111 1111 1111 no 4111111111111112",
        "reach me at (613) 555-3280 or joe (at) mail [dot] com", "x@y", "@@ +1", "<|endoftext|> in a <|endoftext|>text", "tab\x0bbed\x0cand\rreturn words",
        sentence(12) + "\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "éé\u00a0nbsp\u2003em \x1c sep " * 5, sentence(4000), "y" * 5000, SHARED,
    ]
    out = plain + odd + plain[:5] + [plain[8] + " end", plain[9].replace("the", "thee", 1)]
    return out


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    """doc_id, text, and columns with the names that operators use inside."""
    if rows is None:
        found = texts()
        rows = [(i, t) for i, t in enumerate(found)] + [(3, found[3]), (3, found[3]), (None, "a null id with some words"), (None, None)]
    return spark.createDataFrame(
        [(i, t, "en", "src0", len(t or ""), "x", "y", 1, 2, "z", "k", "w", 0.5) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, _text string, _keep string, hi long, fp long, spans string, _doc string, n_words string, _id double",
    ).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall("[^ \t\n\x0b\x0c\r]+", text or "")
