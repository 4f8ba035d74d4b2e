"""Arrays of records in blocks of any size against json.loads."""

import json
import random

import pytest

from threadloom.sources.json_arrays import read_json_objects


def text(r):
    return "".join(r.choices(["{", "}", "[", "]", '"', "\\", ",", ":", "é", "漢", "\n", "a", "b ", "\\\"}", "x" * 30], k=r.randrange(0, 25)))


def record(r, i):
    return {"id": i, "t": text(r), "c": [{"k": text(r), "n": [1, [2]]} for _ in range(r.randrange(0, 4))], "e": {"}": "{"}, "none": None}


SCHEMA = "id long, t string, c array<struct<k:string,n:string>>"


def rows(df):
    return sorted((r["id"], r["t"], tuple(x["k"] for x in r["c"])) for r in df.collect())


@pytest.mark.parametrize("size", [40, 300, 5000, 1 << 20])
def test_blocks_of_any_size(spark, tmp_path, size):
    r = random.Random(size)
    files = [[record(r, 1000 * f + i) for i in range(n)] for f, n in enumerate((60, 1, 0, 25))]
    for f, some in enumerate(files):
        (tmp_path / f"{f}.json").write_text(json.dumps(some, indent=r.choice([None, 1]), ensure_ascii=f % 2 == 0))
    one = record(r, 9000)
    (tmp_path / "one.json").write_text("  " + json.dumps(one, indent=2) + "\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "mixed.json").write_text('[1, "{}", [], null, {"id": 9001, "t": "", "c": []}, 2]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_json_objects(spark, str(tmp_path), SCHEMA)
        want = [x for some in files for x in some] + [one, {"id": 9001, "t": "", "c": []}]
        assert rows(got) == sorted((x["id"], x["t"], tuple(c["k"] for c in x["c"])) for x in want)
        if size == 300:
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "0.json")).rdd.getNumPartitions() > 5  # one file, several tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
