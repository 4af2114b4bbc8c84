"""The registered queries and the pipeline, against brute force at the smallest scale."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from relweave.llm import decontam, queries
from tests.conftest import SMOKE
from tests.llm.test_llm_lines_tokens import BYTE, brute_lines
from tests.llm.test_llm_sharding_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}


def test_registered():
    names = list(queries.QUERIES)
    assert set(names) <= set(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 14


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        rows = entry.queries()[name](spark, SMOKE)
        got = con.execute(sql).fetchall()
        columns = [d[0] for d in con.description]
        assert sorted(columns) == sorted(rows.columns)
        assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(got)


def test_held_out_flags(spark, docs):
    for name, mod, rest in (("op3_quality", 3, 1), ("op4_language_id", 5, 0)):
        rows = entry.queries()[name](spark, SMOKE).collect()
        assert len(rows) == len(docs)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)


def test_nearest_recall_on_the_given_table(spark):
    folder = SMOKE.replace("sf0.001", "sf0.1")
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(v))
    unit = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids.tolist()])
    got = {}
    for r in entry.queries()["op8_nearest"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for at in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[at]
        cos[at] = -2
        found += len(got[int(ids[at])] & set(ids[np.argsort(-cos)[:5]].tolist()))
    assert found >= 0.9 * 5 * len(got)


def test_stages_against_brute_force(spark, docs, tmp_path):
    frame = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, state = frame.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in frame.collect()}
        stage(spark, frame, SMOKE).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        rows = frame.collect()
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMOKE}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            assert all((d in kept) == bool(q) for d, q in labels.items() if d in before)
        elif name == "line_dedup":
            want = {d: t for d, n, k, t in brute_lines(list(before.items())) if k < n}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            comp = brute_components([brute_fingerprint(before[d]) for d in ids])
            assert {r.doc_id: r.text for r in rows} == {ids[c]: before[ids[c]] for c in comp}
        elif name == "decontamination":
            bench = [[x for x in decontam.words_of(r.text)] for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
            joined = {d: b" " + b" ".join(decontam.words_of(t)) + b" " for d, t in before.items()}
            leaks = {d for d, t in joined.items() if any(b" " + b" ".join(w) + b" " in t for w in bench)}
            assert {r.doc_id for r in rows} == set(before) - leaks
        else:
            tok = Tokenizer.from_file(BYTE)
            for r in rows:
                ids = tok.encode(before[r.doc_id], add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
            state = {(r.doc_id, r.ids_sha256) for r in rows}
            break
        assert frame.columns == columns
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMOKE).collect()} == state


def test_stages_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for rows, n in ((odd_docs, "odd"), (no_docs, "none")):
        frame = rows.drop("a.b")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SMOKE).write.parquet(str(tmp_path / n / name))
            frame = spark.read.parquet(str(tmp_path / n / name))
        assert set(frame.columns) >= {"doc_id", "n_tokens", "ids"}
        if n == "none":
            assert frame.count() == 0


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(rng.randint(4, 90))) for _ in range(60)]
    rows = [(rng.choice([None, *range(25)]), t, rng.choice([None, "x", "y"])) for t in texts]
    rows += [(rng.choice([None, *range(25)]), t + " z" * rng.randint(0, 1), rng.choice([None, "x"])) for t in texts[:30]] + rows[:6]
    rows += [(None, "stands alone without an id", None), (7, None, "x"), (None, "", "x")]
    comp = brute_components([brute_fingerprint(t) for _, t, _ in rows])
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or "")
    want = [min((r for r, c in zip(rows, comp) if c == root), key=order) for root in set(comp)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.without_near_copies(spark, df, SMOKE)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[0] is None for r in want) and len({r[0] for r in want}) < len(want)
