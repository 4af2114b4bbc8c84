"""JSON files of entries, cut at every kind of place."""

import json
import random

import numpy as np
import pytest

from relweave.sources.entries import read_records, scan
from relweave.sources.tables import read_entries


def nasty(rng, i):
    parts = ["{", "}", "[", "]", '"', "\\", "\\\\", "é中", ",", "\n", "x" * rng.randint(0, 30), '\\"']
    return {"text": "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "domain": f"d{i}", "n": {"deep": [{"er": "}{"}, [1, 2]]}, "output": None}


@pytest.mark.parametrize("size", [1 << 20, 97, 13, 1])
def test_records_of_any_cut(spark, tmp_path, size):
    rng = random.Random(size)
    files = [[nasty(rng, i) for i in range(n)] for n in (40 if size > 1 else 4, 0, 7 if size > 1 else 2)]
    for k, rows in enumerate(files):
        (tmp_path / f"f{k}.json").write_text(json.dumps(rows, ensure_ascii=k % 2 == 0, indent=k or None), encoding="utf-8")
    (tmp_path / "g.json").write_text("\n".join(json.dumps(r) for r in files[2]))  # objects one after the other
    want = [r for rows in [*files, files[2]] for r in rows]
    got = read_records(spark, str(tmp_path), range_bytes=size, range_tasks=4).orderBy("entry_id").collect()
    assert [r.entry_id for r in got] == list(range(len(want))) and [json.loads(r.json) for r in got] == want


def test_first_n_and_nothing_after(spark, tmp_path):
    rows = [{"text": f"t{i}", "ground_truth_key_value": {"a": [["1", "x"]]}} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for n in (0, 1, 499, 500, 900):
        got = read_entries(spark, str(tmp_path), n=n, range_bytes=64).orderBy("entry_id").collect()
        assert [(r.entry_id, r.text) for r in got] == [(i, f"t{i}") for i in range(min(n, 500))]
        assert all(r.ground_truth_key_value["a"][0].id == "1" for r in got)
    # what lies far behind the n-th isn't even looked at
    (tmp_path / "b.json").write_text(json.dumps(rows) + "{{{{")
    assert read_records(spark, str(tmp_path), n=20, range_bytes=64, range_tasks=4).count() == 20


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x" * 50} for _ in range(2000)]))
    rows = read_records(spark, str(tmp_path), range_bytes=4096, range_tasks=8)
    assert rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).filter(lambda k: k > 0).count() >= 4


def test_scan_by_hand():
    data = np.frombuffer(b'{"a\\"}": [1]}', np.uint8)
    outside, depth, end = scan(data, False, False)
    assert not end and depth.tolist()[-3:] == [2, 2, 1] and not outside[6]
    assert scan(np.frombuffer(b'" {', np.uint8), True, True)[2] is True and scan(np.frombuffer(b'" {', np.uint8), True, False)[2] is False
