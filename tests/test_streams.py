"""What streams append is read from files, so that no driver holds it."""

import pytest

from framepack.sources import queries as sources


@pytest.mark.parametrize("name", ["streaming_deltas_events", "streaming_runs_events"])
def test_rows_lie_in_files(spark, sf_dir, name):
    df = sources.queries()[name](spark, sf_dir)
    assert df.count() and df.inputFiles()
