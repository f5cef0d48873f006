from pyspark.sql import functions as F

from spanloom.operators import fit
from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_whole_tables_reach_the_operators(spark):
    states = catalog.queries()["restore_conflicts_whole"](spark, DATA)
    most = spark.read.parquet(f"{DATA}/customer.parquet").agg(F.max("c_custkey")).first()[0]
    assert states.agg(F.max("path")).first()[0] == most + 5 and states.where("state = 'missing'").count()


def test_whole_spans_reach_the_operator(spark):
    hints = catalog.queries()["anchor_hints_whole"](spark, DATA)
    assert hints.where("status = 'not_a_file'").count() == 5


def test_folded_texts_are_members(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A b, c d e"), (3, "a b c d e"), (4, "a"), (5, None), (6, "p q r s")], "doc_id long, text string")
    assert sorted(map(tuple, fit.jaccard_members(docs).collect())) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 1), (5, 5, 1), (6, 6, 1)]


def test_every_row_names_its_class(spark):
    docs = spark.createDataFrame([(1, "a  b // x"), (2, "a b"), (3, "c"), (4, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, fit.exact_groups(docs).collect())) == [(1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 1, 3)]
