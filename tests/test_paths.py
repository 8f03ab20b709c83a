"""Paths of any length."""

import os

from framewright.plans import QUERIES


def test_long_paths_are_judged_to_their_end(spark, sf_dir, tmp_path):
    for name in os.listdir(sf_dir):
        if name != "pages.parquet":
            (tmp_path / name).symlink_to(f"{sf_dir}/{name}")
    rows = [(1, "https://" + "ab/" * 5000 + "../x"), (2, "https://" + "ab/" * 5000 + "x")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["safe"] for r in QUERIES["safe_paths"](spark, str(tmp_path)).collect()} == {1: False, 2: True}
