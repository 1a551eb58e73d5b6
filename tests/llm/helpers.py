"""Small documents for the tests of the training-data operators."""

from __future__ import annotations

import os
import random

SF = "/root/testdata/sf0.001"
has_tables = os.path.isdir(SF)
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def docs(spark, texts, sources=None, clash=True):
    """A documents table with null and repeated rows as given, in several partitions, with columns whose names operators use."""
    rows = [(i, t, "en", (sources or ["s1"])[i % len(sources or ["s1"])], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    if clash:
        df = df.selectExpr("*", "'x' as kept", "1 as size", "'y' as _uid", "'z' as fp", "2L as component_id", "3 as part", "'w' as words")
    return df


def sample(n=40, seed=0):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    shared = words(rng, 60)
    out = base + [base[0], base[1] + " tail", None, "", "   \n\t", "one", shared, base[2] + "\n" + shared + "\n" + base[3], "é " * 300, "ab " * 5000]
    return out + [shared + " " + base[4]]
