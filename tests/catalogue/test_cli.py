"""Configuration and the command line."""

import pytest

from ocelli import catalogue, config
from ocelli.__main__ import main
from ocelli.streaming.progress import PREFIX

SF = "/root/testdata/sf0.001"


def test_settings():
    env = {"OCELLI_MAX_HLS": "7", "OCELLI_MAX_IMAGES": "many", "OCELLI_PROFILE": "full", "OCELLI_X": "yes"}
    args = config.parser(env).parse_args(["run", "p", "t", "o", "--max-images", "3"])
    own = config.run_config(args, [])
    assert (own.max_hls, own.max_images, own.max_total, own.profile) == (7, 3, 10, "full") and own.validates and own.checks_segments
    assert config.setting("x", False, env) is True and config.setting("max_images", 50, env) == 50
    with pytest.raises(SystemExit):
        config.parser(env).parse_args(["run", "p", "t", "o", "--profile", "best"])


def test_commands(spark, tmp_path, capsys):
    pages = catalogue.payloads(spark, SF).filter("_ord < 20")
    pages.write.parquet(str(tmp_path / "payloads"))
    manifest = main(["--block", "*.example.net", "harvest", str(tmp_path / "payloads"), str(tmp_path / "h"), "--media", "hls"], spark)
    assert manifest["counts"]["url_records"] == 10 and manifest["handoff_default_scope"] == "filtered_media_records"
    assert capsys.readouterr().out.startswith(PREFIX)
    catalogue.target_rows(spark).write.parquet(str(tmp_path / "targets"))
    records = str(tmp_path / "h" / "camera_urls_jsonl")
    summary = main(["handoff", records, str(tmp_path / "targets"), str(tmp_path / "r")], spark)
    assert summary["unique_candidates"] == 30 and (tmp_path / "r" / "camera_candidates_table_csv").exists()
