"""The prepared datasets keep every row and every column that isn't dropped by name."""

from relweave.plans.q_misc import prepare_dataset


def test_suppliers_keep_their_balances(spark, tmp_path):
    tables = {"customer": ([(1, "ann", 2, 5.5, "BUILDING"), (2, "ann", 2, 5.5, "BUILDING"), (3, "bob", None, None, None)],
                           "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"),
              "supplier": ([(1, "sup", 2, 7.25), (2, "sup", 3, 8.0), (3, "sup", 2, 7.25), (4, "other", 2, None)],
                           "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
              "nation": ([(2, "FRANCE", 3)], "n_nationkey long, n_name string, n_regionkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((tuple(r) for r in prepare_dataset(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("customer", "ann", 5.5, "BUILDING"), ("customer", "bob", None, None), ("supplier", "sup", 7.25, None), ("supplier", "sup", 8.0, None),
                          ("supplier", "other", None, None)], key=repr)
