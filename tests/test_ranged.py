"""Listings, byte ranges and seekable reads."""

import zipfile

from quarry.sources import ranged


def test_ranges_cover_each_file_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.bin", 25), ("sub/b.bin", 10), ("c.bin", 0), ("d.txt", 9)):
        (tmp_path / name).write_bytes(bytes(range(n)))
    files = ranged.listing(spark, str(tmp_path), "*.bin")
    found = sorted((r.path.rsplit("/", 1)[-1], r.start, r.end) for r in ranged.byte_ranges(files, 10).collect())
    assert found == [("a.bin", 0, 10), ("a.bin", 10, 20), ("a.bin", 20, 25), ("b.bin", 0, 10)]
    assert {r.path.rsplit("/", 1)[-1] for r in ranged.listing(spark, str(tmp_path), "*.bin", recursive=False).collect()} == {"a.bin"}


def test_opened_by_path_and_uri(tmp_path):
    path = tmp_path / "x y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.txt", "1" * 100)
    for uri in (str(path), f"file:{path}", f"file://{path}"):
        with ranged.opened(uri) as f, zipfile.ZipFile(f) as z:
            assert z.read("one.txt") == b"1" * 100
