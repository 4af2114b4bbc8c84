"""op11 to op13 against brute force, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from relweave.llm import centroids, convrepair, topk

FLOATS = "vec_id long, embedding array<float>, label int, id int, dim int, region int, shard int, v string, cluster int, distance long, kind int, near int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2, 3, 4, "v", 5, 6, 7, 8) for i, v in rows], FLOATS).repartition(3)


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


# ---------------------------------------------------------------- top-k products

def brute_products(rows, k=5, every=50):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = whole(v)
            best[i] = min(best.get(i, w), w)
    out = []
    for q in sorted(best):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], w)), i) for i, w in best.items() if i != q and len(w) == len(best[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("shard_rows, max_regions", [(8192, 1024), (40, 1024), (17, 3)])
def test_top_products_equal_brute_force(spark, shard_rows, max_regions):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 16))
    rows = [(i, (middle[i % 6] + 0.2 * rng.normal(size=16)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # one vector a third of all rows: ties to the smaller id
    got = topk.top_products(vectors(spark, rows), shard_rows=shard_rows, max_regions=max_regions).collect()
    assert sorted(map(tuple, got)) == brute_products(rows)


def test_top_products_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [3.0, -1.0]), (2, [1.0]), (100, [2.0]), (3, None), (150, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]),
            (200, []), (6, []), (7, [-2.0, -2.0]), (7, [-3.0, 5.0]), (0, [1.0, 2.0]), (8, [1e30, 1.0]), (-50, [0.5, 0.5])]
    got = sorted(map(tuple, topk.top_products(vectors(spark, rows)).collect()))
    assert got == brute_products([r for r in rows if r[0] != 8])
    assert {q for q, *_ in got} == {-50, 0, 50, 100, 200}
    assert topk.top_products(vectors(spark, rows).where("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_products(vectors(spark, rows).where("false")).count() == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    p = rng.integers(-(1 << 27), 1 << 27, (200, 8))
    tree = topk.BallTree.build(np.arange(200), p, 4, leaf=8)
    q = p[:20]
    who, ids, score, _ = tree.search(np.arange(20), q, np.full(20, topk.LOWEST), 3)
    for j in range(20):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[j], p[i])), i) for i in range(200) if i != j)[:3]
        assert [(-int(s), int(i)) for s, i in zip(score[who == j], ids[who == j])] == want


def test_tree_prunes_clustered_vectors_and_takes_a_shared_bound():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 64)) * 256
    p = np.floor(middle[rng.integers(0, 40, 8000)] + 8 * rng.normal(size=(8000, 64))).astype(np.int64)
    tree = topk.BallTree.from_bytes(topk.BallTree.build(np.arange(8000), p, 6).to_bytes())
    q_ids = np.arange(0, 8000, 50)
    who, ids, score, compared = tree.search(q_ids, p[q_ids], np.full(len(q_ids), topk.LOWEST), 5)
    assert compared < 0.2 * len(q_ids) * 8000
    full = p[q_ids] @ p.T
    full[np.arange(len(q_ids)), q_ids] = topk.LOWEST + 1
    assert np.array_equal(score.reshape(-1, 5), -np.sort(-full, axis=1)[:, :5])
    kth = score.reshape(-1, 5)[:, 4]
    again, _, _, less = tree.search(q_ids, p[q_ids], kth, 5)
    assert less <= compared and len(again) == len(who)
    assert len(tree.search(q_ids, p[q_ids], score.reshape(-1, 5)[:, 0] + 1, 5)[0]) == 0


# ---------------------------------------------------------------- conversation repair

def brute_audit(rows):
    """(cost, audit, repaired) by trying every edit string: (role initial, must go, truncated, role, text)."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def walk(i, state, left):
        if i == len(rows) and state in (0, 3):
            yield 0, "", ()
        if left:
            to = 3 if state == 2 else 2
            for c, a, t in walk(i, to, left - 1):
                yield c + 2, "I" + a, (("assistant" if to == 3 else "user", ""), *t)
        if i < len(rows):
            initial, go, cut, role, text = rows[i]
            for c, a, t in walk(i + 1, state, 2):
                yield c + 3, "D" + a, t
            if not go:
                to = follow.get(initial, {}).get(state)
                if to is not None:
                    for c, a, t in walk(i + 1, to, 2):
                        yield c + cut, "K" + a, ((role, text), *t)
                to = 3 if state == 2 else 2
                for c, a, t in walk(i + 1, to, 2):
                    yield c + 2 + cut, "R" + a, (("assistant" if to == 3 else "user", text), *t)

    return min(walk(0, 0, 2))


def brute_repair(rows):
    """The contract, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        mine += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, done = brute_audit([(r[:1], f in ("blank", "duplicate"), f == "truncated", r, t) for (_, r, t), f in zip(mine, faults)])
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string, gone string, kind int, key string, edit string, last int, later string, c int, k int, low long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "k", "e", 2, "l", 3, 4, 5) for r in rows], CONV).repartition(3)


def test_repair_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(300):
        said = ["Yes.", "No!", "cut", " \n ", "", "Why?\t", "Yes."]
        for turn in range(rng.randint(1, 6)):
            at = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, at, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*said, None])))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, None, None)] + rows[:7]
    got = convrepair.summaries(convrepair.repair(convrepair.damage(conversations(spark, rows)), gone_col="gone"))
    want = brute_repair(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {len(w[7]) for w in want} > {0, 1, 4} and {c for w in want for c in w[7]} == set("KRDI")


def test_repaired_rows_and_edits(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "user", "And?"), (1, 2, "user", "And?"), (1, 5, "assistant", "no end"), (2, 0, "assistant", " ")]
    out = convrepair.repair(conversations(spark, rows)).collect()
    first = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.seq)
    assert [(r.edit, r.role, r.text, r.fault) for r in first] == [
        ("K", "system", "Be brief.", None), ("D", "user", None, None), ("K", "user", "And?", None), ("D", "user", None, "duplicate"), ("K", "assistant", "no end", "truncated")] \
        or "".join(r.edit for r in first) == brute_audit([("s", False, False, "", ""), ("u", False, False, "", ""), ("u", False, False, "", ""), ("u", True, False, "", ""), ("a", False, True, "", "")])[1]
    assert [r.last for r in first] == [False] * (len(first) - 1) + [True] and sum(r.illegal for r in first) == 2
    assert [(r.edit, r.text, r.fault) for r in out if r.conv_id == 2] == [("D", None, "blank")]
    none = conversations(spark, rows).where("false")
    assert convrepair.summaries(convrepair.repair(convrepair.damage(none), gone_col="gone")).count() == 0


def test_a_long_conversation_is_handed_out_in_pieces(spark):
    """Many rows of one conversation, edits made final every few hundred bytes."""
    rng = random.Random(3)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b!", "c", "", f"{t}.", f"x{t}"])) for t in range(3000)]
    df = conversations(spark, rows)
    whole_run = convrepair.summaries(convrepair.repair(df)).collect()
    pieces = convrepair.repair(df, check_bytes=700)
    assert convrepair.summaries(pieces).collect() == whole_run and len(whole_run) == 1
    got = "".join(r.edit for r in sorted(pieces.collect(), key=lambda r: r.seq))
    assert got == whole_run[0].audit and got.count("I") + 3000 == len(got)


def test_least_audit_by_common_prefix_and_verified_collisions(monkeypatch):
    rng = random.Random(5)
    for base in (convrepair._BASE, 0):  # with base 0 all hashes of one last edit meet
        monkeypatch.setattr(convrepair, "_BASE", base)
        for _ in range(120):
            rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2, "r", "t") for _ in range(rng.randint(0, 6))]
            one = convrepair.Audit()
            handed = ""
            for r in rows:
                one.push(*r[:3])
                if rng.random() < 0.4:
                    handed += one.final()
            assert handed + one.finish() == brute_audit(rows)[1]
    edits = convrepair.Edits()
    made = {"": 0}
    for _ in range(400):
        s = rng.choice(list(made))
        e = rng.choice("DIKR")
        made.setdefault(s + e, edits.add(made[s], e))
    for _ in range(2000):
        a, b, x, y = rng.choice(list(made)), rng.choice(list(made)), rng.choice("DIKR"), rng.choice("DIKR")
        if a + x != b + y:
            assert edits.less(made[a], x, made[b], y) == (a + x < b + y)


# ---------------------------------------------------------------- centroids

def brute_clusters(rows, k, rounds, dims):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    mid = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(mid)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(mid)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                mid[j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    own = {j: sum(d for d, c in near if c == j) for j in range(len(mid))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in mid]
    return [(i, c, d, own[c], sum(own.values()), sha[c]) for (i, _), (d, c) in zip(kept, near)]


@pytest.mark.parametrize("n, k", [(300, 12), (5, 12)])
def test_clusters_equal_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=8) * 0.2).tolist()) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(900, 900 + n // 2)] + rows[:3]  # a hot vector, repeated rows
    rows += [(None, rows[1][1]), (7, None), (8, [1.0] * 7), (9, [None] * 8), (10, [float("nan")] * 8), (11, [float("inf")] * 8), (12, []), (-13, [1e36] * 8)]
    got, mid = centroids.cluster(vectors(spark, rows), k=k, rounds=5, dims=8)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters([r for r in rows if r[0] != -13], k, 5, 8), key=str)
    assert len(mid) == min(k, n + n // 2 + 4)


def test_clusters_of_an_empty_table(spark):
    got, mid = centroids.cluster(vectors(spark, [(1, [1.0])]).where("false"))
    assert got.count() == 0 and mid == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_run_without_python(spark):
    df = vectors(spark, [(i, [float(i % 5)] * 64) for i in range(60)])
    rows = centroids.kept_vectors(df, "vec_id", "embedding", 64, 256)
    plan = centroids.nearest_centroid(rows["v"], rows["square"], [[0] * 64])
    text = rows.select(plan)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text
