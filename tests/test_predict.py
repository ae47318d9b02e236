import os

import pytest

import __spark_entry__ as entry
from wordloom.plans import model, predict

SF = "/root/testdata/sf0.001"


def test_every_word_boundary_is_a_context(spark, rows, tmp_path):
    s = spark.createDataFrame([(1, [5, 6, 7]), (1, [5, 6, 7]), (2, [8]), (3, []), (4, None)], "sent_id long, words array<long>")
    s.write.parquet(str(tmp_path / "sentence_t.parquet"))
    assert rows(predict.boundaries(spark, str(tmp_path))) == [(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 8)]
    assert rows(predict.boundaries(spark, str(tmp_path), 1)) == [(1, 1, 6), (1, 2, 7)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_keystrokes_are_counted_at_all_boundaries(spark):
    known = [r.id for r in model.pruned(spark, SF)["words"].where("word is not null").select("id").collect()]
    targets = predict.boundaries(spark, SF)
    assert entry.queries()["success_ratio"](spark, SF).first().words >= targets.where(targets.target.isin(known)).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_words_outside_the_dictionary_count_as_missed(spark):
    assert entry.queries()["success_ratio"](spark, SF).first().words == predict.boundaries(spark, SF).count()
