"""Queries that have no cap read whole tables and whole texts."""

import os

import pytest

from scenewright.plans import views
from scenewright.plans.queries import QUERIES

DATA = os.environ.get("SCENEWRIGHT_DATA", "/root/testdata/sf0.001")


def test_placeholders_are_filled_in_the_whole_text(spark, tmp_path):
    rows = [(1, 0, "user", "x" * 60 + " [obj_1] end"), (1, 1, "bot", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.filled for r in QUERIES["placeholder_fill"](spark, str(tmp_path)).collect()}
    assert got == {0: "The user said at the table: " + "x" * 60 + " table end user", 1: "The bot said at the table:  bot"}


def test_numbers_are_dense_over_ranges(spark):
    keys = [3, 4095, 4096, 4097, 9000, -5, 1 << 40]
    got = views.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(4), "k", "no")
    assert got.columns == ["k", "no"] and sorted((r.no, r.k) for r in got.collect()) == list(enumerate(sorted(keys)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_every_scene_with_options_has_a_record(spark):
    got = [r.question_id for r in QUERIES["task_records"](spark, DATA).collect()]
    assert len(got) > 1000 and sorted(got) == list(range(QUERIES["compose_options"](spark, DATA).count()))
