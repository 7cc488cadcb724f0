"""Quoted text at any split size against Python's own reader and ``multiLine``."""

import csv
import random

import pytest
from pyspark.sql import types as T

from verdict.sources.quoted import quoted_records, read_quoted

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def some_rows(seed, n, alphabet):
    rng = random.Random(seed)

    def field():
        return "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
    return [(f"id{i}", field(), field() + "x" * (400 if i % 50 == 0 else 0)) for i in range(n)]


def write(path, rows, sep, end):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        w.writerow(["a", 'header "b"\nof two lines', "c"])
        w.writerows(rows)


@pytest.fixture()
def splits_of(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(n):
        for k in old:
            spark.conf.set(k, str(n))
    yield set_to
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(df):
    return sorted(tuple(x or None for x in r) for r in df.collect())


@pytest.mark.parametrize("size", [64, 333, 5_000, 1 << 27])
@pytest.mark.parametrize("sep,end", [(",", "\n"), ("\t", "\r\n")])
def test_equal_at_any_split_size(spark, scratch, splits_of, size, sep, end):
    rows = some_rows(1, 400, ["a", "b", '"', '""', "\n", "\n\n", ",", "\t", "é", " "])
    # values that a reader takes for a lone line end or blank are not in question here
    write(f"{scratch}/x.csv", rows, sep, end)
    splits_of(size)
    got = read_quoted(spark, f"{scratch}/x.csv", SCHEMA, sep=sep)
    want = sorted((a, b or None, c or None) for a, b, c in rows)
    assert values(got) == want
    if size < 1000:
        assert spark.read.text(f"{scratch}/x.csv").rdd.getNumPartitions() > 5
    plain = spark.read.schema(SCHEMA).option("sep", sep).option("header", True).option("multiLine", True).option("escape", '"')
    if end == "\n":
        assert values(plain.csv(f"{scratch}/x.csv")) == want


def test_a_record_over_many_splits_and_the_order_of_rows(spark, scratch, splits_of):
    rows = [("id0", "one", ""), ("id1", "line\n" * 3000, "two"), ("id2", "", "x"), ("id1", "last", "")]
    write(f"{scratch}/1.csv", rows, ",", "\n")
    write(f"{scratch}/2.csv", rows[:1], ",", "\n")
    splits_of(200)
    for bound in (10 ** 6, 0):      # starts broadcast, and lines shuffled by split
        df = read_quoted(spark, scratch, SCHEMA, position="at", max_broadcast=bound)
        got = [(r.a, r.b, r.c) for r in df.orderBy("at").collect()]
        assert got == [tuple(x or None for x in r) for r in rows + rows[:1]]


def test_blank_lines_no_header_nothing_and_odd_quotes(spark, scratch):
    def file(name, text):
        with open(f"{scratch}/{name}", "w", newline="", encoding="utf-8") as f:
            f.write(text)
        return f"{scratch}/{name}"
    df = read_quoted(spark, file("a.csv", '\n1,"x\n\ny",\n\r\n\n2,,z'), SCHEMA, header=False)
    assert values(df) == [("1", "x\n\ny", None), ("2", None, "z")]
    assert read_quoted(spark, file("b.csv", ""), SCHEMA).count() == 0
    assert read_quoted(spark, file("c.csv", "a,b,c\n"), SCHEMA).count() == 0
    with pytest.raises(ValueError, match="odd number of quotes"):
        quoted_records(spark, file("d.csv", 'a,b,c\n1,"2,3\n'))
