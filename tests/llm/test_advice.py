"""Whole results where an operator once did less: near copies, near neighbours in dense groups, junk of each length."""

import base64
import random
import string

import numpy as np
from helpers import docs, words
from pyspark.sql import functions as F

from foretell.llm import ann, near_copies, quality


def test_all_near_copies_go(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        w = words(rng, 150).split()
        texts.append(" ".join(w))
        for changes in (1, 2, 3, 8):
            c = list(w)
            for i in range(changes):
                c[7 + i * 15] = "zz" + str(rng.random())
            texts.append(" ".join(c))
    texts += [texts[0].upper(), words(rng, 80), "", None, "two words", "Two  words"]
    sets = [near_copies.shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) or not (sets[i] or sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(i for i in range(len(texts)) if group[i] == g) for g in set(group)}
    assert {r.doc_id for r in near_copies.keep_one(docs(spark, texts)).collect()} == want
    assert near_copies.keep_one(docs(spark, texts).limit(0)).count() == 0


def test_search_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x[::3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(2000, 64)) * rng.choice([1e-4, 1e-3, 1e-2], (2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, ids in got.items():
        s = u @ u[q]
        s[q] = -9
        hits += len(set(ids) & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 120 and hits == 600


def test_bands_reject_junk_of_each_length(spark):
    rng = random.Random(4)
    few = lambda n, size: " ".join(rng.choices(words(rng, n).split(), k=size // 5))[:size]
    encoded = lambda size: " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(size // 41 + 1))[:size]
    printable = lambda size: "".join(rng.choices(string.digits + string.ascii_letters + string.punctuation + " " * 12, k=size))
    junk = [few(8, n) for n in (9_700, 29_000)] + [few(12, 29_000)] + [encoded(n) for n in (700, 999, 3_000, 9_000)] + [printable(n) for n in (299, 450, 900)]
    good = [words(rng, n) for n in (60, 150, 400, 1_000, 4_000)]
    good += [(good[3] + " " + words(rng, 2_000))[: 4096 + n] for n in (30, 130)]
    got = {r.doc_id: r for r in quality.quality(docs(spark, junk + good)).collect()}
    assert [i for i in range(len(junk)) if got[i].kept] == []
    assert [i for i in range(len(junk), len(junk) + len(good)) if not got[i].kept] == []
