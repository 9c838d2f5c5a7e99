"""The folder source: byte ranges, tails that read little, pushed filters, office members."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("files"), random.Random(2)
    (top / "sub" / ".hidden").mkdir(parents=True)
    for i in range(4):
        lines = [f"{i}:{j} " + "é" * rng.randint(0, 30) for j in range(300)]
        (top / "sub" / f"log{i}.jsonl").write_text("\n".join(lines) + ("\n" if i % 2 else ""), encoding="utf-8")
    (top / "empty.jsonl").write_text("")
    (top / "blank.jsonl").write_bytes(b"\n\r\n\nlast")
    (top / "sub" / ".hidden" / "x.jsonl").write_text("no\n")
    (top / "_temporary.jsonl").write_text("no\n")
    (top / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (top / "b.bin").write_bytes(b"a\x00b")
    (top / "bad.docx").write_bytes(b"no zip")
    for name, parts in {
        "d.docx": {"word/document.xml": "<w:document><w:p><w:t>One &amp; </w:t><w:t>two</w:t></w:p><w:p/><w:p>three</w:p></w:document>", "word/styles.xml": "no"},
        "s.pptx": {f"ppt/slides/slide{n}.xml": f"<a:p>slide {n}</a:p>" for n in (10, 2, 1)},
    }.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for member, xml in parts.items():
                z.writestr(member, xml)
        (top / name).write_bytes(data.getvalue())
    return top


def read(spark, folder, **options):
    return files.read_folder(spark, str(folder), **options)


def expected(folder, name):
    raw = (folder / name).read_bytes()
    lines, at = [], 0
    for part in raw.split(b"\n"):
        lines.append((at, part.rstrip(b"\r").decode()))
        at += len(part) + 1
    return lines if raw and not raw.endswith(b"\n") else lines[:-1]


@pytest.mark.parametrize("block", [1, 7, 1000, 1 << 20])
def test_lines_by_byte_range(spark, folder, block):
    if block == 1:
        data = (folder / "blank.jsonl").read_bytes()
        got = [x for a in range(len(data)) for x in files.lines_in(io.BytesIO(data), a, a + 1, 2)]
        assert [(a, x.rstrip(b"\r").decode()) for a, x in got] == expected(folder, "blank.jsonl")
        return
    df = read(spark, folder, suffixes="jsonl", block=str(block if block > 7 else 200))
    got = {}
    for r in df.collect():
        got.setdefault(r.path[len(str(folder)) + 1 :], []).append((r.offset, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {n: expected(folder, n) for n in ("blank.jsonl", *(f"sub/log{i}.jsonl" for i in range(4)))}


def test_tails_read_the_last_blocks_only(spark, folder):
    df = read(spark, folder, mode="tail", lines="3", suffixes="jsonl")
    got = {}
    for r in df.collect():
        got.setdefault(r.path[len(str(folder)) + 1 :], []).append((r.offset, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {n: expected(folder, n)[-3:] for n in ("blank.jsonl", *(f"sub/log{i}.jsonl" for i in range(4)))}
    data = b"".join(b"%d some line\n" % i for i in range(100_000))
    n, lines = files.last_lines(io.BytesIO(data), len(data), 5)
    assert n <= 1 << 13 and [x for _, x in lines] == [b"%d some line" % i for i in range(99_995, 100_000)]
    assert all(files.last_lines(io.BytesIO(d), len(d), 2, 1)[1] == want for d, want in ((b"", []), (b"a", [(0, b"a")]), (b"a\nb\nc\n", [(2, b"b"), (4, b"c")]), (b"\n\n", [(0, b""), (1, b"")])))


def test_filters_reach_the_list_of_files(spark, folder, monkeypatch):
    reader = files.FolderReader({"path": str(folder), "mode": "index"})
    from pyspark.sql.datasource import GreaterThan, IsNotNull, StringEndsWith

    left = list(reader.pushFilters([IsNotNull(("size",)), GreaterThan(("size",), 500), StringEndsWith(("path",), "3.jsonl")]))
    assert [type(f) for f in left] == [IsNotNull] and [p.path.rsplit("/", 1)[1] for p in reader.partitions()] == ["log3.jsonl"]
    df = read(spark, folder, mode="index").where((F.col("size") > 500) & F.endswith("path", F.lit("3.jsonl")))
    assert [r.path.rsplit("/", 1)[1] for r in df.collect()] == ["log3.jsonl"]
    paged = read(spark, folder, mode="index").orderBy("path").offset(1).limit(2)
    assert [r.path.rsplit("/", 1)[1] for r in paged.collect()] == ["b.bin", "bad.docx"]
    nothing = read(spark, folder, mode="index", suffixes="zzz")
    assert nothing.collect() == []


def test_members_of_documents(spark, folder):
    rows = read(spark, folder, mode="members", suffixes="docx,pptx,txt,bin").collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.member, r.text) for r in rows)
    assert got == sorted([("a.txt", "", "café"), ("d.docx", "word/document.xml", "One & two\nthree"), *[("s.pptx", f"ppt/slides/slide{n}.xml", f"slide {n}") for n in (1, 2, 10)]])
