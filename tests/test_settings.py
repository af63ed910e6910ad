import json

import pytest

from parlance.settings import Settings, loaded


def test_defaults_and_overrides():
    assert loaded(lookup=lambda _: None) == Settings()
    said = {"PARLANCE_WORKERS": "3", "PARLANCE_STORAGE": " s3a://calls ", "PARLANCE_INDEX": "  ", "PARLANCE_SPEAKERS": "many"}
    assert loaded(lookup=said.get) == Settings(workers=3, storage="s3a://calls")


def test_overrides_come_after_the_file(tmp_path):
    f = tmp_path / "settings.json"
    f.write_text(json.dumps({"workers": 2, "index": "i"}))
    assert loaded(str(f), {"PARLANCE_WORKERS": "5"}.get) == Settings(workers=5, index="i")


@pytest.mark.parametrize("content", [{"worker": 2}, {"workers": "2"}, {"workers": 0}, {"storage": " "}, {"workers": True}])
def test_wrong_files(tmp_path, content):
    f = tmp_path / "settings.json"
    f.write_text(json.dumps(content))
    with pytest.raises(ValueError):
        loaded(str(f), lambda _: None)


def test_a_file_that_is_asked_for_has_to_be_there(tmp_path):
    with pytest.raises(FileNotFoundError):
        loaded(str(tmp_path / "none.json"), lambda _: None)
    with pytest.raises(ValueError):
        loaded(lookup={"PARLANCE_LOCK_SECONDS": "0"}.get)


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    f = tmp_path / "settings.yaml"
    f.write_text("workers: 4\n")
    assert loaded(str(f), lambda _: None).workers == 4
