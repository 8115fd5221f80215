from pathlib import Path

import pytest

import bench

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_given_tables_and_several_files_are_timed(spark, monkeypatch):
    monkeypatch.setattr(bench, "HEADLINE", ["md_chunks"])
    places, timed = [], bench.timed
    monkeypatch.setattr(bench, "timed", lambda session, sf_dir: places.append(sf_dir) or timed(session, sf_dir))
    told = bench.report(spark, SF_DIR, 2)
    assert places[0] == SF_DIR and len(set(places)) == 2
    assert told["value"] == told["queries"]["md_chunks"] > 0
    assert told["several_files"]["value"] == told["several_files"]["queries"]["md_chunks"] > 0
