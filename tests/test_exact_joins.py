"""Exact joins (strings by prefixes of rare grams, vectors by pivots, passages by
an automaton) against brute force."""

import collections
import math
import pathlib
import random
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest

from relweave.operators.contain import contained
from relweave.operators.simjoin import best_partners, prefix_join, ranked_grams
from relweave.operators.vectors import OUT_COMPONENTS, Block, copies, drop_near_copies, fill_blocks, first_of_equals, mark_near, pivots_of, visits


def grams(s):
    p = f" {s.lower()} "
    return collections.Counter(p[i:i + 3] for i in range(len(p) - 2))


def cosine(a, b):
    x, y = grams(a), grams(b)
    dot = sum(n * y[g] for g, n in x.items())
    return dot / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))) if dot else 0.0


def words(rng, n):
    return [" ".join(rng.choice(["olive", "azure", "steel", "steal", "blush", "dim"]) + rng.choice(["", "", "x", "ed"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [4096, 7])
def test_best_partners_equal_all_pairs(spark, chunk):
    rng = random.Random(chunk)
    names = words(rng, 150) + ["", "a", "zzz qqq", "Olive", "olive", "xyxyxyxyxyxy", "xyxy", "ÄÖÜ über"]
    df = spark.createDataFrame([(s, 1) for s in names] + [(None, 2), ("olive", 3)], "p string, s int").repartition(3)
    got = {r.s: (round(r.best, 9), r.best_match, r.n_similar) for r in best_partners(df, "p", chunk=chunk).collect()}
    want = {}
    for a in set(names):
        scored = [(cosine(a, b), b) for b in set(names) if a != b]
        top = max(((round(c, 12), b) for c, b in scored if c > 0), default=(0.0, None))
        want[a] = (round(top[0], 9), top[1], sum(c >= 0.5 for c, _ in scored))
    assert {s: (g[0], g[2]) for s, g in got.items()} == {s: (w[0], w[2]) for s, w in want.items()}
    assert all(cosine(s, g[1]) > want[s][0] - 1e-9 for s, g in got.items() if g[1] is not None)
    assert all((g[1] is None) == (want[s][1] is None) for s, g in got.items())
    assert best_partners(df.where("false"), "p").count() == 0


@pytest.mark.parametrize("least", [0.8, 0.5, 0.2, 0.0])
def test_prefix_join_finds_each_pair_once(spark, least):
    rng = random.Random(2)
    names = sorted(set(words(rng, 80)))
    ranked = ranked_grams(spark.createDataFrame([(s,) for s in names], "p string"), "p")
    got = [(r.a, r.b) for r in prefix_join(ranked, ranked, least, chunk=5).collect()]
    want = {(a, b) for a in names for b in names if a != b and cosine(a, b) >= max(least, 1e-12)}
    assert len(got) == len(set(got)) and set(got) == want


def test_prefixes_spare_most_pairs(spark):
    """Names that share only frequent grams don't meet."""
    rng = random.Random(6)
    names = sorted({"common part of every name " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(300)})
    ranked = ranked_grams(spark.createDataFrame([(s,) for s in names], "p string"), "p")
    from relweave.operators.simjoin import _index

    a, b = _index(ranked, 0.8, "a", 4096), _index(ranked, 0.8, "b", 4096)
    met = a.join(b, ["gram", "part"]).where("a <> b").count()
    assert met < 0.1 * len(names) ** 2


def unit(x):
    return x / np.sqrt((x * x).sum(1))[:, None]


@pytest.mark.parametrize("threshold", [0.97, 0.8])
def test_near_copies_equal_all_pairs(spark, threshold):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(90, 12))
    rows = np.concatenate([base, base[:40] + 0.1 * rng.normal(size=(40, 12)), base[:1].repeat(70, 0), base[5:6] + 0.02 * rng.normal(size=(60, 12))])
    rows = rows[rng.permutation(len(rows))]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [None] * 12), (904, [float("nan")] * 12), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + odd, "vec_id long, embedding array<double>").repartition(3)
    c = unit(rows) @ unit(rows).T
    want = [j for j in range(len(rows)) if not (c[:j, j] > threshold).any()] + [900, 901, 902, 903, 904, 905]
    for cell_rows, block in ((512, 2048), (20, 16)):
        got = [r.vec_id for r in drop_near_copies(df, threshold, cell_rows=cell_rows, block=block).collect()]
        assert sorted(x for x in got if x is not None) == want and got.count(None) == 1
    assert drop_near_copies(df.where("false"), threshold).count() == 0


def test_pivots_spare_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 64))
    x = unit(middle[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 64)))
    pivots = x[rng.choice(4000, 60, replace=False)]
    d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
    home = d.argmin(1)
    radius = np.array([d[home == c, c].max(initial=-1.0) for c in range(60)])
    _, cell = visits(x, pivots, radius, math.sqrt(2 - 2 * 0.97))
    pairs = (np.bincount(home, minlength=60) * np.bincount(cell, minlength=60)).sum()
    assert pairs < 0.1 * 4000 ** 2


def test_copies_of_vectors_leave_in_bounded_batches():
    """At 64 dimensions a vector touches many cells; one batch of rows must not become one batch of copies."""
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(3000, 64)), unit(rng.normal(size=(400, 64)))
    radius, r = np.full(400, 2.0), math.sqrt(2 - 2 * 0.97)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.tolist())], ["id", "v"])
    out = list(copies([batch], 64, pivots, radius, r))
    rows, cells = visits(unit(x), pivots, radius, r)
    assert len(rows) > 20 * 3000 and max(b.num_rows for b in out) * 64 <= OUT_COMPONENTS
    got = np.concatenate([np.stack([b.column("id").to_numpy(), b.column("cell").to_numpy()]) for b in out], axis=1)
    assert (got == np.stack([rows, cells])).all()
    assert sum(b.column("home").to_numpy(zero_copy_only=False).sum() for b in out) == 3000
    assert all((np.array(b.column("v").to_pylist()) == x[b.column("id").to_numpy()]).all() for b in out[:2])


def test_vectors_are_written_once(spark):
    """At 64 dimensions without structure a vector touches a good part of all cells. What is written must not grow with them."""
    x = np.random.default_rng(3).normal(size=(1200, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    root = pathlib.Path(urllib.parse.urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before, tasks = set(root.glob("rdd-*")), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = {f.getPath() for f in _shuffle_files(tasks)}
    assert len(drop_near_copies(df, 0.97, cell_rows=12, block=150).collect()) == 1200
    kept = sum(f.stat().st_size for d in set(root.glob("rdd-*")) - before for f in d.iterdir())
    dealt = sum(f.length() for f in _shuffle_files(tasks) if f.getPath() not in shuffled)
    assert kept + dealt < 4 * x.nbytes


def _shuffle_files(disk):
    found = disk.getAllFiles()
    return [f for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")]


@pytest.mark.parametrize("held", [40, 16])
def test_near_copies_over_blocks_equal_all_pairs(spark, held):
    """Crowded cells, equal and nearly equal rows, opposite and parallel ones, repeated ids."""
    rng = np.random.default_rng(held)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, 2 * base[:20], -base[:10], base[:1].repeat(40, 0), base[1:2] + 0.05 * rng.normal(size=(60, 24)), base[20:40] + 0.2 * rng.normal(size=(20, 24))])
    ids = rng.permutation(len(x))
    c = unit(x) @ unit(x).T > 0.97
    want = sorted(ids[j] for j in range(len(x)) if not (c[:, j] & (ids < ids[j])).any())
    again = [(1000, x[3].tolist())] * 2 + [(2000, rng.normal(size=24).tolist())] * 2 + [(3000, v) for v in rng.normal(size=(2, 24)).tolist()]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + again, "vec_id int, embedding array<double>").repartition(3)
    out = drop_near_copies(df, 0.97, cell_rows=9, held=held)
    assert out.schema["vec_id"].dataType.simpleString() == "int"
    assert sorted(r.vec_id for r in out.collect()) == want + [2000, 3000, 3000]


def test_rough_products_are_never_below_the_cosine():
    rng = np.random.default_rng(5)
    x = unit(np.concatenate([rng.normal(size=(400, 40)), rng.normal(size=(1, 40)) + 0.05 * rng.normal(size=(100, 40))]))
    pivots, basis = x[:30], np.linalg.svd(x[:30], full_matrices=False)[2][:15].T
    cells = np.sort((x @ pivots.T).argmax(1)).astype(np.int32)
    x = x[np.argsort((x @ pivots.T).argmax(1), kind="stable")]
    a = Block(np.arange(500), cells, x, pivots, basis)
    assert (a.rough @ a.rough.T > x @ x.T - 1e-5).all()
    mark_near(a, a, pivots, 0.9, 64)
    assert (a.gone == [(x[:j] @ x[j] > 0.9).any() for j in range(500)]).all() and a.gone.sum() > 50


def test_blocks_are_bounded_and_first_of_equals_found():
    rng = np.random.default_rng(6)
    members = np.concatenate([rng.integers(0, 90, 200), [1000, 0, 350]])
    first, many, total = fill_blocks(members, 100)
    load = np.zeros(total)
    for f, k, n in zip(first, many, members, strict=True):
        load[f:f + k] += n / k
    assert load.max() <= 100 and total < 2 * members.sum() / 100 + 2 and (first + many <= total).all()
    v = np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 2.0], [0.0, 1.0], [3.0, 3.0]])
    assert sorted(first_of_equals(np.array([9, 4, 2, 5, 1]), v)) == [1, 2, 4]
    assert pivots_of([[3.0, 4.0], [3.0, 4.0], [1e200, 0.0], [1e-200, 0.0]]).tolist() == [[0.6, 0.8]] and len(pivots_of([[1e-200, 0.0]])) == 1


def test_contained_equals_substring(spark):
    rng = random.Random(9)
    alphabet = ["ab", "aB ", "c", " ", "\n", "é", "É", "x."]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab c"), (502, "ab c")]
    passages = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(900, ""), (901, None), (902, "AB C"), (903, "ab c")]
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    p = spark.createDataFrame(passages, "item_id long, text string")
    want = {(d, i) for d, x in texts for i, y in passages if x is not None and y is not None and y.lower() in x.lower()}
    for size in (4 << 20, 12):  # one block and many
        got = [tuple(r) for r in contained(t, p, "doc_id", "text", "item_id", "text", block_chars=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert contained(t, p.where("false"), "doc_id", "text", "item_id", "text").count() == 0
    plan = contained(t, p, "doc_id", "text", "item_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # texts aren't split into tokens
