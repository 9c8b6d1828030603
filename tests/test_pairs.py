"""Queries of similar pairs: every pair of rows can be told from their rows, and copies are not multiplied out."""

from itertools import combinations

import pytest

import __spark_entry__ as entry
from pagegraph.functions import fuzzy, names, text
from pyspark.sql import functions as F


def expanded(rows, ids, seen):
    """(lesser id, greater id): what the query says of the pair, from its rows between classes and its members."""
    of = {r.right_key: r.left_key for r in rows if r.same_key}
    alone = {r.right_key: r for r in rows if r.same_key}
    across = {(r.left_key, r.right_key): r for r in rows if not r.same_key}
    out = {}
    for p, q in combinations(sorted(ids), 2):
        x, y = of.get(p, p), of.get(q, q)
        if x == y:
            out[p, q] = seen(alone[q], True)
        elif (x, y) in across or (y, x) in across:
            out[p, q] = seen(across[min(x, y), max(x, y)], x < y)
    return out


@pytest.mark.parametrize("copies", [1, 12])
def test_titles_of_copies(spark, tmp_path, copies):
    told = ["large ring", "ring large", "large rings", "", None, "blue bolt", "blue bot", "bolt", "dim tide a", "tide dim b"]
    rows = [(len(told) * c + i, brand, size, t) for c in range(copies) for i, t in enumerate(told) for brand, size in [((None, "a", "b")[i % 3 if i > 7 else 1], 1)]]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_size int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = entry.queries()["titles_similar"](spark, str(tmp_path)).collect()
    keys = {r.p_partkey: (r.p_brand, r.key) for r in spark.read.parquet(str(tmp_path / "part.parquet")).select("p_partkey", "p_brand", text.normalize_key(F.col("p_name")).alias("key")).collect()}
    want = {(p, q): fuzzy.titles_alike(keys[p][1], keys[q][1]) for p, q in combinations(sorted(keys), 2) if keys[p][0] is not None and keys[p][0] == keys[q][0]}
    assert expanded(got, keys, lambda r, there: r.similar if there else r.similar_back) == want
    assert len(got) <= 45 + len(rows)


@pytest.mark.parametrize("copies", [1, 12])
def test_authors_of_copies(spark, tmp_path, copies):
    told = ["Supplier#000000001", "Supplier#000000010", "Supplier#000000101", "Ann Smith", "Smyth, Ann", "Ann Smithe B", "", None]
    rows = [(len(told) * c + i, t, None if i == 5 else 0) for c in range(copies) for i, t in enumerate(told)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = entry.queries()["fuzzy_author_pairs"](spark, str(tmp_path)).collect()
    key = names.name_key(F.translate("s_name", "#0", " o")).alias("key")
    keys = {r.s_suppkey: r.key for r in spark.read.parquet(str(tmp_path / "supplier.parquet")).where("s_nationkey = 0").select("s_suppkey", key).collect()}
    want = {(p, q): (fuzzy.keys_equivalent(keys[p], keys[q]), round(fuzzy.ratio(keys[p], keys[q]), 6)) for p, q in combinations(sorted(keys), 2)}
    assert expanded(got, keys, lambda r, there: (r.equivalent, r.ratio) if there else (r.equivalent_back, r.ratio_back)) == want
    assert len(got) <= 28 + len(rows)
