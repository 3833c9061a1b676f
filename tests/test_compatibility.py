import json

import pytest

from folioscan.engine import SearchEngine
from folioscan.schema import META_FILE, SCHEMA_VERSION
from folioscan.sources.store import MANIFEST, SchemaMismatch, check_index_compatibility


@pytest.fixture
def path(spark, tmp_path):
    root = tmp_path / "index"
    SearchEngine(spark, str(root)).close()
    return root


def change(path, file, **values):
    (path / file).write_text(json.dumps(json.loads((path / file).read_text()) | values))


def test_statuses(spark, path, tmp_path):
    state = check_index_compatibility(str(path))
    assert (state.compatible, state.status, state.found_schema_version, state.reason) == (True, "compatible", SCHEMA_VERSION, None)
    assert check_index_compatibility(str(tmp_path / "none")).status == "missing_index"
    (tmp_path / "file").write_text("")
    assert check_index_compatibility(str(tmp_path / "file")).status == "invalid_index_path"
    (tmp_path / "empty").mkdir()
    assert check_index_compatibility(str(tmp_path / "empty")).status == "missing_metadata"


@pytest.mark.parametrize(("version", "status"), [(SCHEMA_VERSION - 1, "rebuild_required"), (SCHEMA_VERSION + 1, "engine_too_old")])
def test_versions(spark, path, version, status):
    change(path, META_FILE, schema_version=version)
    state = check_index_compatibility(str(path))
    assert (state.compatible, state.status, state.found_schema_version) == (False, status, version)
    with pytest.raises(SchemaMismatch):
        SearchEngine(spark, str(path))


def test_broken_metadata(path):
    change(path, META_FILE, format="other")
    assert check_index_compatibility(str(path)).status == "invalid_format"
    (path / META_FILE).write_text("{")
    assert check_index_compatibility(str(path)).status == "invalid_metadata"


def test_without_metadata(spark, path):
    (path / META_FILE).unlink()
    assert check_index_compatibility(str(path)).status == "legacy_compatible"
    SearchEngine(spark, str(path))
    assert check_index_compatibility(str(path)).status == "compatible"  # written on opening
    (path / META_FILE).unlink()
    schema = json.loads((path / MANIFEST).read_text())["schema"]
    change(path, MANIFEST, schema=[f | {"indexed": False} if f["name"] == "id" else f for f in schema])
    state = check_index_compatibility(str(path))
    assert (state.status, state.found_schema_version) == ("rebuild_required", 1)
    change(path, MANIFEST, schema=[f | {"type": "int"} if f["name"] == "file_path" else f for f in schema])
    assert check_index_compatibility(str(path)).found_schema_version is None
    (path / MANIFEST).write_text("[")
    assert check_index_compatibility(str(path)).status == "invalid_manifest"
