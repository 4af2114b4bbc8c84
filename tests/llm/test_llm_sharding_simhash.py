import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from relweave.llm import sharding, simhash


def _law(rows, n):
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(abs(sums[s] - total / n) <= most for s in range(n))
    for s in sums:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_are_near_equal_with_a_hot_text(spark):
    random.seed(3)
    data = [(i, "copy " * 20 if i % 3 == 0 else "w" * random.randint(0, 400)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    rows = [r.asDict() for r in sharding.shard_by_bytes(df, 40, draws_per_range=8).collect()]
    assert len(rows) == 3000
    _law(rows, 40)
    for r in rows:
        t = dict(data)[r["doc_id"]].encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
    # the order decides alone, not the sample
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(df.repartition(3), 40, draws_per_range=64, ranges_per_shard=3).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_identical_rows_are_subdivided(spark):
    df = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    rows = [r.asDict() for r in sharding.shard_by_bytes(df, 10).collect()]
    _law(rows, 10)
    assert len(rows) == 500


def test_shards_of_odd_rows(odd_docs, no_docs, tmp_path, spark):
    rows = [r.asDict() for r in sharding.shard_by_bytes(odd_docs, 4).collect()]
    assert len(rows) == 15
    _law(rows, 4)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    assert sharding.shard_by_bytes(no_docs, 4).count() == 0
    sharding.write_shards(odd_docs.drop("shard"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 15 and {"shard", "slot", "text", "lang"} <= set(back.columns)


def brute_fingerprint(text, size=3):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < size else [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)]
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def brute_components(fps, budget=3):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= budget):
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def _near(n, seed, share=0.7):
    """Fingerprints of which many are a few bits from another."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(5)] + [0]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < share else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("split_over", [200_000, 60, 3])
def test_trie_join_finds_exactly_the_linked_fingerprints(spark, split_over):
    fps = sorted(set(_near(1500, 5)))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(6)
    got = {r.node: r.root for r in simhash.components(simhash.links(df, 3, split_over)).collect()}
    want = brute_components(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_dense_cluster_links_without_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = simhash.links(df, 3)
    assert edges.count() <= 4 * len(fps)
    assert len({r.root for r in simhash.components(edges).collect()}) == 1


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(1, n + 1)} == {0} and got[1001] == 1000 and 0 not in got


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts = base + [b.replace("1", "2", 1) for b in base[:60]] + base[:30] + [b + "\tx" for b in base[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    for r in simhash.simhash_components(df).collect():
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id]


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == 15
    empty = [r for r in rows if r.doc_id in (2, 3, 8)]
    assert {r.fingerprint for r in empty} == {"0" * 16} and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert [r.component_id for r in rows if r.doc_id == 4] == [4, 4]
    assert simhash.simhash_components(no_docs).count() == 0
