import pytest
from pyspark.sql import functions as F

from chronoloom.functions.labels import LABELS, filter_labels, has_label, label_map, labels_hash, labels_string, with_metric


def evaluate(spark, labels, column):
    return spark.createDataFrame([(labels,)], f"ls {LABELS}").select(column(F.col("ls"))).first()[0]


@pytest.mark.parametrize(
    ("labels", "kept"),
    [
        ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "2")]),
        ([("a", "1"), ("b", "")], [("a", "1")]),
        ([("a", ""), ("b", "2"), ("c", "")], [("b", "2")]),
        ([("", "x"), ("b", "2")], [("b", "2")]),
        ([("a", ""), ("a", "1"), ("b", "2"), ("b", "3")], [("b", "2")]),
        ([("a", ""), ("b", "")], []),
        ([], []),
        (None, []),
        ([(None, "1"), ("b", None), ("c", "3")], [("c", "3")]),
    ],
)
def test_filter(spark, labels, kept):
    assert [tuple(x) for x in evaluate(spark, labels, filter_labels)] == kept


@pytest.mark.parametrize(
    ("labels", "text"),
    [([("t2", "t2"), ("t1", "t1")], '{t1="t1", t2="t2"}'), ([], "{}"), (None, "{}"), ([("a", 'q"\\\n')], '{a="q\\"\\\\\\n"}'), ([("é", "ü"), ("z", "1")], '{z="1", é="ü"}')],
)
def test_string(spark, labels, text):
    assert evaluate(spark, labels, lambda c: labels_string(label_map(c))) == text


def test_has(spark):
    labels = [("aaa", "1"), ("bbb", "2")]
    assert not evaluate(spark, labels, lambda c: has_label(label_map(c), "foo"))
    assert evaluate(spark, labels, lambda c: has_label(label_map(c), "aaa"))


def test_hash_is_of_the_set(spark):
    def h(labels):
        return evaluate(spark, labels, lambda c: labels_hash(label_map(c)))

    assert h([("a", "1"), ("b", "2")]) == h([("b", "2"), ("a", "1")]) != h([("a", "1")])


def test_metric_takes_the_place_of_a_label_of_its_name(spark):
    got = evaluate(spark, [("b", "2"), ("__name__", "x"), ("a", "1")], lambda c: with_metric(c, F.lit("cpu")))
    assert [tuple(x) for x in got] == [("__name__", "cpu"), ("a", "1"), ("b", "2")]
