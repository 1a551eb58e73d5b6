import pytest
from helpers import SF, docs, has_tables, sample

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from foretell.llm import mixing, near_copies, pii, quality, unigram  # noqa: E402
from foretell.llm import queries as q  # noqa: E402


def test_stages_keep_the_columns_and_follow_each_other(spark, tmp_path):
    d = docs(spark, [(t or "") + " and some more words to make this text long enough" for t in sample()], clash=False)
    seen = [d.count()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        d = f(spark, d, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert d.dtypes == docs(spark, ["x"], clash=False).dtypes
            d.write.parquet(str(tmp_path / str(k)))
            d = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(d.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[4] == seen[5] > 0


@pytest.mark.skipif(not has_tables, reason="no tables")
def test_run_against_plain_python(spark):
    """Each stage again, a row at a time, on the smallest documents."""
    import zstandard

    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    rows = [r for r in rows if quality.judge(r["text"], z)[-1]]
    rows_kept = rows
    sets = [near_copies.shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    stay = {group.index(g) for g in set(group)}
    rows = [r for i, r in enumerate(rows) if i in stay]
    kept = {r["doc_id"]: r for r in rows}
    new = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(rows))).collect()}
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(new[r["doc_id"]].encode().split())
    target = {x["source"]: x["target"] for x in mixing.plan(size)}
    m = unigram.Pieces(q.tokenizer_path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= set(kept) and corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(rows_kept)), "").count() == len(rows)
    taken = {}
    for r in got:
        assert r.ids == m.encode([new[r.doc_id]])[0].tolist() and r.round_trip
        s = kept[r.doc_id]["source"]
        taken[s] = taken.get(s, 0) + len(new[r.doc_id].encode().split())
    largest = {s: max(len(new[d].encode().split()) for d, r in kept.items() if r["source"] == s) for s in size}
    assert all(abs(taken.get(s, 0) - t) <= largest[s] for s, t in target.items())


@pytest.mark.skipif(not has_tables, reason="no tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    want = c.sql(q.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()), key=repr)


def folders(path):
    import os

    return [d for d, _, files in os.walk(path) if any(f.endswith((".parquet", ".idx")) for f in files)]


@pytest.mark.skipif(not has_tables, reason="no tables")
@pytest.mark.parametrize("name", sorted(q.queries()))
def test_a_query_leaves_no_tables_but_its_result(spark, name):
    """Each table written on the way is gone when the query returns; the one that the result is read from stays, or the archive
    that the query writes, or the lists by partition that its last pass reads."""
    from foretell.llm._common import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = {d.split("/part=")[0] for d in folders(root)}
    q.queries()[name](spark, SF)
    new = {d.split("/part=")[0] for d in folders(root)} - before
    assert len(new) <= 1 and not any("/run-" in d for d in new), new
