import random

import pytest
from pyspark.sql import functions as F

from lethe.operators.lookup import Lookup, lookup
from lethe.operators.order import cut_points, dense_index, index_by_place, keep_first, placed, rank_with_ties, running_sums


@pytest.mark.parametrize("partitions", ["2", "8", "31"])
def test_dense_index_is_dense_and_ordered(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    keys = random.Random(1).sample(range(-5000, 5000), 997)
    rows = dense_index(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["index"])] == sorted(keys)
    assert sorted(r["index"] for r in rows) == list(range(997))


def test_null_order_is_kept_and_first(spark):
    df = spark.createDataFrame([(5,), (None,), (3,)], "k long")
    assert {(r["k"], r["index"]) for r in dense_index(df, "k").collect()} == {(None, 0), (3, 1), (5, 2)}


def test_running_sums_with_a_hot_and_a_null_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), float(i) * 0.5, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, n long")
    got = {(r["g"], r["s"]): (r["n_before"], r["n_total"]) for r in running_sums(df, "s", ["n"], ["g"], totals=True).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        total, seen = sum(r[2] for r in mine), 0
        for _, s, n in mine:
            assert got[(g, s)] == (seen, total)
            seen += n


def test_rank_with_ties_when_one_value_holds_most_rows(spark):
    rows = [(0 if i % 3 else i % 50, i * 7 % 10007) for i in range(4000)]
    ranked = rank_with_ties(spark.createDataFrame(rows, "v long, k long"), "v", "k").collect()
    assert [(r["v"], r["k"]) for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(rows)


def test_cut_points_split_evenly(spark):
    cuts = cut_points(spark.range(10_000).toDF("k"), "k", 10)
    assert len(cuts) == 9 and cuts == sorted(set(cuts))


def test_keep_first_takes_whole_rows_in_order(spark):
    rows = [("a", 2, "late", None), ("a", 1, None, "x"), ("b", 9, "only", "y")]
    df = spark.createDataFrame(rows, "k string, pos int, v string, w string")
    assert {tuple(r) for r in keep_first(df, ["k"], ["pos"]).collect()} == {("a", 1, None, "x"), ("b", 9, "only", "y")}


def test_lookup_keeps_every_row_with_hot_missing_and_null_keys(spark):
    keys = ["hot"] * 4000 + ["gone"] * 1500 + [None] * 900 + [f"k{i}" for i in range(3000)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 3000, 2)], "key string, v int")
    want = {"hot": 1, **{f"k{i}": i for i in range(0, 3000, 2)}}
    for found in (lookup(facts, Lookup(dim, "key", F.col("k"))),):
        rows = found.collect()
        assert len(rows) == len(keys)
        assert all(r["v"] == want.get(r["k"]) for r in rows)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _text_files(folder, names=("b.txt", "a.txt", "c.txt")):
    rng = random.Random(5)
    files = {n: [rng.choice(["", "same", "x" * rng.randrange(60)]) + rng.choice(["", f" {i}"]) for i in range(rng.randrange(100, 400))] for n in names}
    for n, lines in files.items():
        (folder / n).write_text("".join(line + "\n" for line in lines))
    return files


def test_lines_are_indexed_in_file_order_over_many_blocks(spark, tmp_path, small_blocks):
    files = _text_files(tmp_path)
    (tmp_path / "aa.txt").write_text("")
    lines = placed(spark.read.text(str(tmp_path)), "value")
    assert lines.select("file_path", "block_start").distinct().count() > 12
    got = sorted((r["index"], r["value"]) for r in index_by_place(lines).collect())
    assert got == list(enumerate(line for n in sorted(files) for line in files[n]))


def test_lines_are_indexed_within_files(spark, tmp_path, small_blocks):
    files = _text_files(tmp_path)
    lines = placed(spark.read.text(str(tmp_path)), "value", F.regexp_extract("_metadata.file_name", r"(.)\.txt$", 1).alias("f"))
    got = sorted((r["f"], r["i"], r["value"]) for r in index_by_place(lines, "i", ["f"]).collect())
    assert got == [(n[0], i, line) for n in sorted(files) for i, line in enumerate(files[n])]


def test_an_empty_folder_has_no_index_and_a_filtered_scan_is_an_error(spark, tmp_path):
    (tmp_path / "e.txt").write_text("")
    assert index_by_place(placed(spark.read.text(str(tmp_path / "e.txt")), "value")).collect() == []
    (tmp_path / "f.txt").write_text("".join(f"{i}\n" for i in range(9)))
    with pytest.raises(Exception, match="rows of a block are missing"):
        index_by_place(placed(spark.read.text(str(tmp_path / "f.txt")), "value").where("value <> '4'")).collect()
