"""Text files of all folders are read, however many folders there are."""

from verseloom.sources import readers as R


def test_folders_beyond_one_read(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.txt").write_text(f"text {i}")
        (tmp_path / f"d{i}" / "b.txt").write_text(f"more {i}")
    files = R.folder_inventory(spark, str(tmp_path), ["*.txt"])
    want = [(f"{w} {i}", "ok") for i in range(5) for w in ("text", "more")]
    for folders in (1, 2, 5, 100_000):
        monkeypatch.setattr(R, "FOLDERS_PER_READ", folders)
        got = R.extract_text_files(files).query(["text", "status"])
        assert sorted((r.text, r.status) for r in got.collect()) == sorted(want)
