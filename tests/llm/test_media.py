import hashlib
import zipfile
import zlib

from coclave.llm import media
from tests.llm import odd


def test_png_round_trip_and_damage():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 33):
        stored = media.encode_png(raw)
        payload, n = media.decode_png(stored)
        assert n == len(raw) and payload == raw + bytes(-len(raw) % 64 if raw else 64)
    broken = bytearray(stored)
    broken[60] ^= 1
    try:
        media.decode_png(bytes(broken))
        raise AssertionError("damage not seen")
    except (ValueError, zlib.error):
        pass


def test_every_row_comes_back(spark):
    got = media.media_columns(odd.documents(spark)).collect()
    want = []
    for i, t, *_ in odd.rows():
        raw = (t or "").encode()
        payload = media.pad(raw)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert key(want[0])
    assert media.media_columns(odd.empty(spark)).count() == 0


def test_ranges_split_archives_and_zip_tools_read_them(spark, tmp_path):
    folder = media.store_media(odd.documents(spark).repartition(1), folder=f"file://{tmp_path}/m", archive_bytes=20_000)
    archives = sorted(tmp_path.glob("m/*.zip"))
    assert len(archives) > 1
    members = [m for a in archives for m in zipfile.ZipFile(a).namelist()]
    assert len(members) == len(odd.rows()) and all(zipfile.ZipFile(a).testzip() is None for a in archives)
    whole = media.read_media(spark, folder)
    split = media.read_media(spark, folder, splitBytes=700, batchBytes=100)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    key = lambda df: sorted(map(str, df.select("archive", "offset", "key").collect()))
    assert key(whole) == key(split)


def test_a_member_is_read_again_from_its_offset(spark, tmp_path, monkeypatch):
    folder = media.store_media(odd.documents(spark).limit(3).repartition(1), folder=f"file://{tmp_path}/m")
    reader = media.MediaReader({"path": folder, "tries": "3"})
    real, fails = media._open, {"left": 2}

    class Flaky:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            data = self.f.read_at(n, at)
            if at < 200 and fails["left"]:
                fails["left"] -= 1
                return data[:-1] if fails["left"] else b"?" * len(data)
            return data

    class System:
        def __init__(self, s):
            self.s = s

        def __getattr__(self, name):
            return getattr(self.s, name)

        def open_input_file(self, path):
            return Flaky(self.s.open_input_file(path))

    monkeypatch.setattr(media, "_open", lambda uri: (System(real(uri)[0]), real(uri)[1]))
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 3 and fails["left"] == 0
