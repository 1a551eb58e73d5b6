import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs, sample, words
from pyspark.sql import functions as F

from foretell.llm import ann, chat, components, mixing, simhash, substrings, warc

# WARC


def test_archive(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, "u\r\nWARC/1.1", "é"), (4, None, None), (5, "e", ""), (6, "h", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "n", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (None, "q", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' as payload", "1 as uid", "'s' as sha256").repartition(3)
    path = warc.write_archive(df)
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == len(pages)
    stored = Counter(r.sha256 for r in rows if r.kind == "response")
    assert set(stored.values()) == {1} and len(stored) == 5  # each payload once
    assert {r.refers_to for r in rows if r.kind == "revisit" and r.sha256 == hashlib.sha256(b"<p>x</p>").hexdigest()} == {2}
    restored = [bytes(r.record) for r in warc.restore(spark, path).collect()]
    bodies = sorted(x.split(b"\r\n\r\n", 1)[1][:-4] for x in restored)
    assert bodies == sorted((p[2] or "").encode() for p in pages)
    for x in restored:
        (head, content), = warc.records(gzip.GzipFile(fileobj=__import__("io").BytesIO(gzip.compress(x))))
        assert "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode() == warc.parse_header(head)["warc-payload-digest"]
    got = sorted(warc.archived_pages(df).collect(), key=str)
    assert len(got) == len(pages) and all(r.payload_bytes == len((next(p[2] for p in pages if p[0] == r.page_id and (p[0] is not None or (p[2] == "only") == (r.payload_bytes == 4))) or "").encode()) for r in got)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_archive_of_long_and_hot_payloads(spark, monkeypatch):
    from foretell.plans import joins

    monkeypatch.setattr(joins, "KEY_ROWS", 5)  # a digest with more records is dealt to several tasks
    long = "<p>" + "x\u00e9 " * 700_000
    pages = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(60)] + [(100, "l", long), (101, "m", long)]
    got = {r.page_id: r for r in warc.archived_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == 62
    for i, _, html in pages:
        last = max(j for j, _, h in pages if h == html)
        assert tuple(got[i])[1:] == (len(html.encode()), warc.base32_sha1(html.encode()), "response" if i == last else "revisit", None if i == last else last)


def test_hot_keys_change_no_result(spark, monkeypatch):
    """The same groups and repeats when every key with a few rows is dealt to several tasks."""
    from foretell.plans import joins

    texts = sample(20) + ["same words over and over again"] * 30 + [f"nearly the same long text about nothing at all number {i}" for i in range(30)]
    d = docs(spark, [t for t in texts if len(t or "") < 6000])
    plain = sorted(simhash.near_duplicates(d).collect()), sorted(tuple(r) for r in substrings.without_repeats(d, texts=False).collect())
    monkeypatch.setattr(joins, "KEY_ROWS", 3)
    assert (sorted(simhash.near_duplicates(d).collect()), sorted(tuple(r) for r in substrings.without_repeats(d, texts=False).collect())) == plain


def test_archive_notices_damage(spark):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "abcdef")], "page_id long, url string, html string"))
    import glob

    name = glob.glob(path.removeprefix("file://") + "/payloads-*")[0]
    raw = gzip.open(name).read().replace(b"abcdef", b"abcdeg")
    with gzip.open(name, "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


# Chat


def digests(turns):
    t = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    loss = "".join(x or "" for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(t.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escaping():
    for x in ["", "<|im_end|>", "<\\|", "<\\\\|x<|", "<", "a<\\", "\n", "<|<|", "|>"]:
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
        assert chat.unescape_role(chat.escape_role(x + "\\n\n")) == x + "\\n\n"
        piece = chat.format_turn("user" + x, x)[0] + chat.format_turn("assistant", x)[0]
        assert list(chat.parse(piece)) == [("user" + x, x), ("assistant", x)]


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 30)
    rng = random.Random(0)
    convs = {c: [(t, rng.choice(["user", "assistant", None, "tool\nx"]), rng.choice([words(rng, 3), None, "", "<|im_end|>", "é\n<\\|"])) for t in range(rng.randint(1, 9))] for c in range(25)}
    convs[99] = [(t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    convs[100] = [(None, "user", "first"), (1, "assistant", "b"), (1, "assistant", "a"), (1, "assistant", "a")]
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as path").repartition(5)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.formatted(chat.chain_nodes(df))).collect()}
    assert len(got) == len(convs)
    for c, rs in convs.items():
        rs = sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        assert got[c] == digests([r[1:] for r in rs]), c
    assert chat.read_back(chat.formatted(chat.chain_nodes(df.limit(0)))).count() == 0


def test_branches_are_ranked(spark):
    #      1          scores: 1, 2: 0, 3: 5, 4: 1, 5: 9, 6: 0
    #     / \
    #    2   3
    #   / \   \
    #  4   5   6
    nodes = spark.createDataFrame([(1, 7, None, 1.0), (2, 7, 1, 0.0), (3, 7, 1, 5.0), (4, 7, 2, 1.0), (5, 7, 2, 9.0), (6, 7, 3, 0.0), (8, 9, 77, None)], "node long, tree long, parent long, score double")
    got = {}
    for r in chat.best_paths(nodes, 2).orderBy("tree", "path", "seq").collect():
        got.setdefault((r.tree, r.path), []).append(r.node)
    assert got == {(7, 5): [1, 2, 5], (7, 6): [1, 3, 6], (9, 8): [8]}  # a parent that is no node makes a root
    with pytest.raises(ValueError, match="cycle"):
        chat.best_paths(spark.createDataFrame([(1, 1, 2, 0.0), (2, 1, 1, 0.0)], "node long, tree long, parent long, score double"))


# Near-duplicates


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 2000 + i) for i in range(50)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]], nodes)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pigeonring_loses_no_link(spark, monkeypatch):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            prints.add(y)
    prints |= {0, 1, (1 << 64) - 1, 1 << 63} | {(1 << i) | (1 << ((i + 17) % 64)) for i in range(64)}
    prints = sorted(prints)
    want = brute_components([(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3], prints)
    for block in (2048, 3):  # 3: keys are dealt out as pairs of blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "FEW", 4 if block == 3 else 12)
        d = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
        roots = {r.node: r.root for r in components.connected_components(simhash.links(d)).collect()}
        groups, mine = {}, {}
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
            mine.setdefault(roots.get(simhash._signed(p), simhash._signed(p)), set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def brute_print(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    texts = sample() + ["A b C d", "a B c D", "É x", "é x"]
    prints = [brute_print(t) for t in texts]
    want = brute_components([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(len(texts)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}
    stay = simhash.keep_one(docs(spark, texts))
    assert stay.columns == docs(spark, ["x"]).columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    twice = docs(spark, ["same words here"]).union(docs(spark, ["same words here"]))
    assert simhash.keep_one(twice).count() == 1
    unknown = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(unknown).collect()) == [(-1, -1), (-1, 4), (4, 4)]


# Repeated substrings


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if c[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("many,piece", [(1_000, 1 << 20), (0, 700)])
def test_substrings(spark, monkeypatch, many, piece):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "PIECE", piece)
    rng = random.Random(7)
    p = words(rng, 120)
    texts = [t for t in sample(25) if len(t or "") < 6000] + [p[:199], p[:200], "x" + p[:200], "é" * 100 + p[:150], "é" * 100 + "!" + p[:150], "é" * 100, p + p, "ab" * 400, "=" * 450, words(rng, 30) + p[50:251] + words(rng, 30)]
    for k in range(12):
        texts.append(words(rng, 20) + " " + p[k * 3 : k * 3 + 230] + " " + words(rng, 20))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts)


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("spill", [False, True])
def test_suffix_order_and_common_prefixes(tmp_path, monkeypatch, spill):
    made = []
    if spill:  # every few numbers go to disk

        class Small(substrings.Queues):
            def __init__(self, size, folder=None, most=0):
                super().__init__(size, folder, 7)
                made.append(self)

        monkeypatch.setattr(substrings, "Queues", Small)
    rng = np.random.default_rng(0)
    for k in range(20 if spill else 200):
        t = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 70)).tolist()
        order, lcp = substrings.suffix_order(np.array(t, np.int16), 200, f"file://{tmp_path}/{k}" if spill else None)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        assert lcp.tolist() == [0] + [shared(t[a:], t[b:]) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert not spill or any(q.spills > 2 for q in made)


# Nearest neighbours


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    x[100:140] = x[100]  # copies, more than k
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [1.0]), (None, x[0].tolist()), (950, (x[7] * 1e-200).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as v").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([*range(900), 950])
    u = np.concatenate((x, x[7:8]))
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    queries = [i for i in ids if i % 50 == 0]
    assert sorted(got) == queries
    for q in queries:
        s = u @ u[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()
        hits += len(set(want) & {v for v, _ in got[q]})
        assert all(abs(s[np.searchsorted(ids, v)] - c) < 1e-9 for v, c in got[q]) and [c for _, c in got[q]] == sorted((c for _, c in got[q]), reverse=True)
    assert hits >= 0.9 * 5 * len(queries)
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0 and ann.search(few.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("dim", [768, 1536, 3072])
def test_search_in_wide_vectors(spark, dim):
    """Sums of table entries beyond 16 bits; clustered vectors, where codes alone tell members apart poorly."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(30, dim))[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, ids in got.items():
        s = u @ u[q]
        s[q] = -9
        assert ids == set(np.argsort(-s)[:5].tolist())
    assert len(got) == 30


def test_search_among_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (50, [0.5, 0.5, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    near = round(1 / 1.01**0.5, 6)
    assert got == sorted([(0, 1, 1, near), (0, 2, 1, near), (0, 3, 0, 0.0), (0, 4, 3, 0.0), (0, 1, 3, 1.0), (0, 2, 1, round(0.1 / 1.01**0.5, 6)), (0, 3, 1, round(0.1 / 1.01**0.5, 6)), (0, 4, 0, 0.0), (50, 1, 2, round(0.5**0.5, 6))])


# Mixing


def test_targets():
    t = mixing.targets([100, 100, 100], [3, 1, 2])
    assert t == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)] and sum(mixing.targets([10, 0, 5], [3, 1, 2])) <= 22.5 + 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def dealt(tree):
    """(shards, sources): how many of each source's places a shard has."""
    out = np.zeros((tree.shards, len(tree.quotas)), np.int64)
    for i, q in enumerate(tree.quotas.tolist()):
        shards = tree.shards_of(i, np.arange(q))
        assert (np.diff(shards) >= 0).all()  # disjoint stretches of the permuted blocks
        out[:, i] = np.bincount(shards, minlength=tree.shards)
    return out


def test_tree_is_exact():
    q = [100, 0, 37, 5000]
    d = dealt(mixing.SplitTree(q, 7))
    assert d.sum(0).tolist() == q and np.ptp(d.sum(1)) <= 3 and (d == dealt(mixing.SplitTree(q, 7))).all()
    some = np.array([3, 77, 1200, 4999])  # a task that sees a few places only agrees with one that sees all
    assert (mixing.SplitTree(q, 7).shards_of(3, some) == mixing.SplitTree(q, 7).shards_of(3, np.arange(5000))[some]).all()


def test_tree_of_large_quotas():
    """Beyond 10**9 blocks: every node's quotas sum to its parent's, at any size."""
    q = np.array([1_500_000_000, 1_200_000_000, 7, 90_000_000_000])
    tree = mixing.SplitTree(q, 1_000_000)
    todo, seen = [(q, 0, tree.shards)], 0
    while todo and seen < 200:
        q, lo, hi = todo.pop(0)
        if hi - lo > 1:
            left = tree.left(q, lo, hi)
            seen += 1
            assert (left >= 0).all() and (left <= q).all() and left.sum() == q.sum() * ((lo + hi) // 2 - lo) // (hi - lo)
            todo += [(left, lo, (lo + hi) // 2), (q - left, (lo + hi) // 2, hi)]
    assert tree.shards_of(3, np.array([0, 45_000_000_000, 89_999_999_999])).tolist()[::2] == [0, 999_999]


def test_large_draws_follow_the_law(monkeypatch):
    monkeypatch.setattr(mixing, "NUMPY_LIMIT", 0)  # the sampler for large counts, on counts that numpy can check
    rng = np.random.default_rng(5)
    for good, bad, draw in ((400_000, 700_000, 300_000), (150_000, 2_000_000, 1_900_000), (120_000, 130_000, 125_000)):
        mine = np.array([mixing.hypergeometric(rng, good, bad, draw) for _ in range(6000)])
        theirs = rng.hypergeometric(good, bad, draw, 6000)
        assert abs(mine.mean() - theirs.mean()) < 5 * theirs.std() / 6000**0.5 and abs(mine.std() / theirs.std() - 1) < 0.06
        edges = np.quantile(theirs, np.linspace(0, 1, 11)[1:-1])
        a, b = (np.bincount(np.searchsorted(edges, x), minlength=10) for x in (mine, theirs))
        assert ((a - b) ** 2 / (a + b)).sum() < 30  # nine degrees of freedom
    thin = np.array([mixing.hypergeometric(rng, 50, 400_000, 200_000) for _ in range(2000)])
    assert abs(thin.mean() - 50 * 200_000 / 400_050) < 0.5 and thin.max() <= 50
    assert mixing.hypergeometric(rng, 5, 0, 5) == 5 and mixing.hypergeometric(rng, 0, 9, 4) == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    rng = random.Random(0)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(200)] + [None, "", words(rng, 5000)]
    sources = ["b", "a", None, "Z", "é"]
    d = docs(spark, texts, sources)
    got = {r.doc_id: r for r in mixing.mixed(d).collect()}
    assert len(got) == len(texts)
    size = {s: sum(len((t or "").split()) for i, t in enumerate(texts) if sources[i % 5] == s) for s in sources}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [3, 1, 2, 3, 1]), strict=True))
    for i, r in got.items():
        s = sources[i % 5]
        assert r.size == len((texts[i] or "").split()) and r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
    for s in sources:
        assert abs(sum(r.taken for i, r in got.items() if sources[i % 5] == s) - want[s]) <= mixing.BLOCK_WORDS
    assert {r.doc_id: r.taken for r in mixing.mixed(d.coalesce(2)).collect()} == {i: r.taken for i, r in got.items()}
    rows = mixing.mix_documents(d)
    assert rows.columns == d.columns and max(Counter(r.doc_id for r in rows.collect()).values()) <= 2
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.mix_documents(d.limit(0)).count() == 0


def test_shards_hold_the_quotas(spark):
    rng = random.Random(1)
    texts = [words(rng, 300) for _ in range(100)]
    d = docs(spark, texts, ["a", "b", "c"])
    sizes = mixing.sized(d)
    taken = mixing.Taken(sizes, 50)
    spans = mixing.deal(taken, shard_words=3000)
    rows = spans.collect()
    size = Counter()
    for i, t in enumerate(texts):
        size["abc"[i % 3]] += len(t.split())
    times = Counter((r.uid, r.block) for r in rows)
    assert set(times.values()) <= {1, 2} and sum(r.words for r in rows) <= 1.5 * sum(size.values()) + 3 * 50
    assert [taken.quotas()[x["no"]] for x in taken.plan] == [sum(1 for r in rows if r.doc_id % 3 == x["no"]) for x in taken.plan]
    per_shard = Counter(r.shard for r in rows)
    assert len(per_shard) == -(-int(sum(x["target"] for x in taken.plan)) // 3000) and max(per_shard.values()) - min(per_shard.values()) <= 5
    by = {r.doc_id: r.uid for r in sizes.collect()}
    whole = spark.createDataFrame([(by[i], t) for i, t in enumerate(texts)], "uid long, text string")
    for r in mixing.block_texts(whole, spans, 50).collect():
        assert r.text == " ".join(texts[r.doc_id].split()[50 * r.block : 50 * r.block + 50])
    order = [(r.shard, r.place) for r in mixing.laid_out(spans).collect()]
    assert order == sorted(order)


def test_mix_of_rows_without_ids(spark):
    d = spark.createDataFrame([(None, "a b c", "s"), (None, "d e", None), (3, "f", "s"), (3, "f", "s"), (3, None, "t")], "doc_id long, text string, source string").repartition(2)
    got = mixing.mixed(d).collect()
    assert len(got) == 5 and sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 2), (-1, 3), (3, 0), (3, 1), (3, 1)] and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id for r in mixing.mix_documents(d).collect()} <= {None, 3}
