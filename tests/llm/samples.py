"""Small tables with the cases that every operator must bear."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " n_words string, ranges long, _text string, key long, fingerprint string, _row_key string"
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "Onan", "reth", "stea", "hent", "é", "ou"]) + rng.choice(["", "er", "and.", "\n"]) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty texts, repeated ids and rows, copies, shared passages, a long text."""
    rng = random.Random(seed)
    whole, passage = prose(rng, 120), prose(rng, 70)
    rows: list[tuple[int | None, str | None]] = [(k, whole) for k in range(6)]
    rows += [(10 + k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for k in range(5)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "a b"), (None, passage), (None, None)]
    rows += [(30, whole + " x"), (30, whole + " x"), (30, whole + " y"), (None, "one two three")]
    rows += [(40, prose(rng, 6_000)), (41, "same same " * 300), (42, "ab" * 700), (43, "ß€😀" * 200)]
    return rows + [(50 + k, prose(rng, rng.randint(1, 200))) for k in range(20)]


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with more columns, whose names are those that operators use inside."""
    full = [(k, t, "en", "s", 1, "w", 2, "t", 3, "f", "r") for k, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
