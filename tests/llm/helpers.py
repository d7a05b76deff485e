"""Small document tables with every awkward row, shared by the operators' tests."""

from __future__ import annotations

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like the operators' own: they must neither clash nor leak.
EXTRA = "score double, kept boolean, class_id long, ids string, shard string, _text string, w long, held_out string"

WORDS = {
    "en": "the of and to in a is that it for on was be with as by cat house river stone window morning letter table".split(),
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein hund haus fluss stein fenster morgen brief".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def documents(spark, n: int = 60, seed: int = 3):
    """Ordinary rows plus null, empty, blank, very long, repeated and null-id rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, "en" if i % 3 else "de", rng.randint(30, 120)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(n)]
    rows += [
        (1000, None, "en", None),
        (1001, "", None, "s0"),
        (1002, " \n\t ", "en", "s0"),
        (1003, prose(rng, "en", 30_000), "en", "s0"),
        (1004, "x" * 50_000, None, None),
        (1005, rows[5][1], "de", "s1"),
        rows[7],
        rows[7],
        (None, rows[8][1], "en", "s1"),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], KIND)


def with_extra(df):
    from pyspark.sql import functions as F

    for item in EXTRA.split(", "):
        name, kind = item.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
