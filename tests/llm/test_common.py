"""Staged tables lie in the application's folder, which can be removed at the end of a job."""

from pathlib import Path

from quarry.llm import common


def test_scratch_is_one_folder_and_can_be_cleared(spark):
    staged = common.staged(spark.range(5), "kept")
    folder = Path(common.run_folder(spark).removeprefix("file:"))
    assert staged.count() == 5 and list(folder.glob("kept-*"))
    common.clear_scratch(spark)
    assert not folder.exists()
    assert common.staged(spark.range(3), "again").count() == 3
