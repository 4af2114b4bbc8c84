"""Scores by what changed equal scores from scratch; many foreign keys at once equal one by one."""

import random
import tracemalloc

import pyarrow as pa

from relweave.operators.joins import fk_share, fk_shares
from relweave.operators.rescore import EntryScores, Method, cosine, fits, grams, match_rows, number, row_scores, score_variants

WAYS = (Method("a", True, False, False, (("c_nationkey", "n_name"),)), Method("b", True, True, False, (("c_nationkey", "n_name"),)), Method("c", False, False, True, ()))


def entry(truth):
    return EntryScores(truth, WAYS, ("c_", "n_"), frozenset(["c_name", "c_nationkey", "n_name"]), {"c_nationkey": "bigint"})


def test_shared_parts_equal_a_fresh_start():
    rng = random.Random(1)
    truth = [("c_name", str(i), f"customer#{i:05d}") for i in range(1, 5)] + [("c_nationkey", str(i), str(i * 3)) for i in range(1, 5)] + [("n_name", "1", "none"), ("n_name", "2", "")]
    lines = [f"c_name is customer#{i:05d}, c_nationkey is {v}, n_name is nation {n}, other is 1.5." for i in range(5) for v in ("3", "x", "6 ") for n in (3, 6)] + ["", "no facts here.", "c_name is a | b"]
    shared = entry(truth)
    for _ in range(60):
        text = rng.choices(lines, k=rng.randint(0, 5))
        for m in WAYS:
            assert shared.score(text, m) == entry(truth).score(text, m)
    assert shared.score([], WAYS[0]) == (0.0, 0.0, 0.0, 0.0, 0.0, 1) and shared.score([], WAYS[2])[3] == 1.0


def test_scores_by_hand():
    e = entry([("c_name", "1", "alpha beta"), ("c_nationkey", "1", "7")])
    assert e.score(["c_name is alpha beta, c_nationkey is 7, n_name is nation 7."], WAYS[0]) == (1.0, 1.0, 0.5, 1.0, 1.0, 1)
    assert e.score(["c_name is alpha beta, c_nationkey is seven, n_name is nation 8."], WAYS[0])[3:5] == (1.0, 0.0)
    # a value that runs over two cells
    assert entry([("c_name", "x", "beta | 7")]).score(["c_name is beta, c_nationkey is 7."], WAYS[0])[1] == 0.5
    assert abs(cosine("ab", "ab") - 1) < 1e-12 and cosine("ab", "xy") == 0.0


def test_types():
    assert [fits("bigint", v) for v in ("1", " +5 ", "1.0", "", "9" * 30)] == [True, True, False, False, False]
    assert [fits("double", v) for v in ("1", "-1.5e3", ".5", "1_000", "x", "NaN")] == [True, True, True, False, False, True]


def test_many_foreign_keys_at_once(spark):
    child = spark.createDataFrame([(1, 5), (1, None), (2, 6), (None, 5), (9, 7)], "a int, b int")
    p, q = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([], "y int")
    t = {"child": child, "p": p, "q": q}
    fks = [("child", "a", "p", "x"), ("child", "b", "q", "y"), ("q", "y", "p", "x")]
    got = {r.fk: (r.n_child, r.n_matched, r.share) for r in fk_shares(t, fks).collect()}
    assert got == {f"{c}.{cc}->{p}.{pc}": tuple(fk_share(t[c], cc, t[p], pc).select("n_child", "n_matched", "share").first()) for c, cc, p, pc in fks}
    assert got["q.y->p.x"] == (0, 0, 1.0)


def test_a_repeated_or_missing_key_does_not_load():
    keyed = Method("k", True, False, False, (), (("c_", "c_name"),))
    e = EntryScores([("c_name", "1", "alpha")], (keyed,), ("c_", "n_"), frozenset(), {})
    one, two = "c_name is alpha, c_phone is 1.", "c_name is beta."
    assert [e.score(t, keyed)[4] for t in ([one, two], [one, one], [one, "c_phone is 2."], [one, "n_name is x."], ["c_name is a, c_name is b."])] == [1.0, 0.0, 0.0, 1.0, 0.0]
    assert e.score([one, one], WAYS[0])[4] == 1.0


def test_row_scores_by_hand():
    truth = [("name", "1", "alpha"), ("age", "1", "30"), ("name", "2", "beta")]
    cells = [(0, "name", "alpha"), (0, "years", "30.001"), (0, "id", "1"), (6, "nickname", "beta"), (6, "id", "9")]
    # row 2 has no id cell: position 1 and every fifth after it, so row 6
    assert row_scores(truth, cells, 0.8, 0.5, {}, {}) == (1.0, 1.0, 1.0)
    assert row_scores(truth, cells, 0.8, 0.9, {}, {})[2] < 1.0
    assert row_scores(truth, [], 0.8, 0.5, {}, {}) == (-1.0, -1.0, -1.0) == row_scores([], cells, 0.8, 0.5, {}, {})
    assert row_scores(truth, [(3, "name", "alpha"), (3, "id", "x")], 0.8, 0.5, {}, {}) == (0.0, 0.0, 0.0)
    assert [number(x) for x in ("$1,234.5", " -3 ", "1e3", "")] == [1234.5, -3.0, None, None]


class Given:
    """Stands for a frame of entries; gives back what would run in its tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak(run, entries):
    """(rows, bytes): the rows that come out, and the most that Python held beyond what it was given."""
    batch = pa.RecordBatch.from_pylist(entries)
    grams.cache_clear(), number.cache_clear()
    tracemalloc.start()
    n = sum(b.num_rows for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, most


def test_memory_does_not_grow_with_the_rows_of_a_batch(spark):
    truth = [{"attr": "c_name", "row_id": str(i), "value": f"v{i}"} for i in range(1, 6)]
    pred = [{"method": m, "row_pos": i, "id_val": str(i + 1), "column_name": "c_name", "value": f"v{i + 1}"} for m in "ab" for i in range(5)]
    run = match_rows(Given(spark), ["a", "b"], 0.8, 0.5)
    (few, small), (many, large) = (peak(run, [{"entry_id": i, "domain": "d", "truth": truth, "pred": pred} for i in range(n)]) for n in (400, 4000))
    assert (few, many) == (800, 8000) and large < 2 * small
    run = score_variants(Given(spark), ["x", "y"], list(WAYS), ["c_"], ["c_name"], {})
    (few, small), (many, large) = (peak(run, [{"entry_id": i, "truth": truth, "texts": [["c_name is v1."] * 5] * 2} for i in range(n)]) for n in (400, 4000))
    assert (few, many) == (400 * 6, 4000 * 6) and large < 2 * small
