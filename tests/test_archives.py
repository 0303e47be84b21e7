import io
import json
import tarfile
import zipfile

import pytest

from tabulon.sources import archives


def tar(path, mode, members):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


MEMBERS = [(f"m{i}.json", json.dumps([{"a": i}, {"a": i + 100}]).encode()) for i in range(7)] + [("dir/x.jsonl", b'{"a": 1}\n\n{"a": 2}'), ("skip.txt", b"no"), ("m0.json", b'{"a": "again"}'), ("big.jsonl", b"\n".join(json.dumps({"a": "y" * 3000}).encode() for _ in range(2000)))]


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_members(spark, tmp_path, kind):
    path = str(tmp_path / f"x.{kind}")
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("dir")
            for name, data in MEMBERS:
                z.writestr(name, data)
    else:
        tar(path, "w:gz" if kind == "tar.gz" else "w", MEMBERS)
    listed = sorted((r.member, r.size) for r in archives.archive_members(spark, path).collect())
    assert listed == sorted((n, len(d)) for n, d in MEMBERS)
    got = sorted((r.member, r.value) for r in archives.archived_json(spark, path).collect())
    want = []
    for name, data in MEMBERS:
        if name.endswith(".json"):
            value = json.loads(data)
            want += [(name, json.dumps(v)) for v in (value if isinstance(value, list) else [value])]
        elif name.endswith(".jsonl"):
            want += [(name, line) for line in data.decode().split("\n") if line]
    assert got == sorted(want)


def test_a_task_reads_its_members_alone(spark, tmp_path):
    """Members of one archive are dealt to several tasks, and what is asked for is found by seeking: the rest may even be broken."""
    path = tmp_path / "x.tar"
    tar(path, "w", [(f"{i}.json", b'{"a": 1}') for i in range(200)])
    assert archives.archived_json(spark, str(path)).count() == 200
    assert archives.archived_json(spark, str(path)).rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    (tmp_path / "y.bin").write_bytes(b"neither")
    with pytest.raises(Exception, match="could not be opened|ReadError|invalid header|truncated"):
        archives.archive_members(spark, str(tmp_path / "y.bin")).collect()
