import gzip
import random

import pytest

from cladeflow.sources import fastq, sinks

# The records and the parts of messages that readers of this format agree on.
TWO = "@seq1 description\nATGC\n+\n!!!!\n@seq2\nGCGT\n+\n$$$$\n"


def records(text, tmp_path, **kw):
    p = tmp_path / "a.fastq"
    p.write_bytes(text.encode())
    return [r[1:] for r in fastq.single_records(str(p), **kw)]


def test_valid(tmp_path):
    want = [("seq1", "description", "ATGC", "+", "!!!!"), ("seq2", None, "GCGT", "+", "$$$$")]
    assert records(TWO, tmp_path) == want
    assert records(TWO.replace("\n", "\r\n"), tmp_path) == want
    assert records("\n \n" + TWO.replace("@seq2", "\n@seq2").rstrip("\n"), tmp_path) == want
    assert records("", tmp_path) == []


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("seq1 description\nATGC\n+\n!!!!\n", r"\(line: 1\): expected '@' at record start"),
        ("@seq1 description\nATGC\n+\n", "incomplete record"),
        ("@seq1 description\nATGC\n+\n!!\n", r"do not match \(4 vs 2\)"),
        ("@seq1\nATGC\n-\n!!!!\n", "expected '\\+'"),
    ],
)
def test_errors(tmp_path, text, message):
    with pytest.raises(fastq.FastqError, match=message):
        records(text, tmp_path)


def test_splits_give_every_record_once(spark, tmp_path):
    r = random.Random(2)
    lines, want = [], []
    for i in range(500):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, 60)))
        qual = "".join(r.choice("@+I!") for _ in seq)
        lines.append(f"@r{i} d{i}\n{seq}\n+\n{qual}\n")
        want.append((f"r{i}", f"d{i}", seq, qual))
    p = tmp_path / "x.fq"
    p.write_text("".join(lines))
    for split in (40, 333, 5_000, 10**6):
        df = fastq.read_fastq(spark, str(p), split_bytes=split)
        got = [tuple(x) for x in df.orderBy("pos").select("id", "desc", "seq", "qual").collect()]
        assert got == want


def test_pairs_gzip_and_round_trip(spark, tmp_path):
    a, b = tmp_path / "1.fq.gz", tmp_path / "2.fq.gz"
    # two gzip members in one file
    a.write_bytes(gzip.compress(b"@x\nAC\n+\nII\n") + gzip.compress(b"@y d\nGG\n+\nJJ\n"))
    b.write_bytes(gzip.compress(b"@x\nTTT\n+\nIII\n@y e\nCC\n+\nKK\n"))
    pairs = fastq.read_fastq(spark, str(a), mates=str(b))
    got = sorted(tuple(r) for r in pairs.select("id", "desc1", "seq1", "desc2", "seq2", "qual2").collect())
    assert got == [("x", None, "AC", None, "TTT", "III"), ("y", "d", "GG", "e", "CC", "KK")]
    sinks.write_fastq_pair(pairs, str(tmp_path / "o1"), str(tmp_path / "o2"), gzip=True, order=["pos"])
    again = fastq.read_fastq(spark, str(tmp_path / "o2"))
    assert sorted(tuple(r) for r in again.select("id", "desc", "seq", "sep", "qual").collect()) == [("x", None, "TTT", "+", "III"), ("y", "e", "CC", "+", "KK")]
    with pytest.raises(ValueError, match="at least one output"):
        sinks.write_fastq_pair(pairs, None, None)
    with pytest.raises(ValueError, match="level"):
        sinks.write_fastq(again, str(tmp_path / "o3"), level=13)


def test_pair_errors(tmp_path):
    a, b = tmp_path / "1.fq", tmp_path / "2.fq"
    a.write_text(TWO)
    b.write_text("@seq1\nA\n+\nI\n@other\nA\n+\nI\n")
    with pytest.raises(fastq.FastqError, match=r"sequence IDs do not match: \(line: 5\): seq2, \(line: 5\): other"):
        list(fastq.paired_records(str(a), str(b)))
    b.write_text("@seq1\nA\n+\nI\n")
    with pytest.raises(fastq.FastqError, match="ends before its mate"):
        list(fastq.paired_records(str(a), str(b)))


def test_odd_paths_and_uris(spark, tmp_path):
    odd = tmp_path / "a,b [1]"
    odd.mkdir()
    (odd / "x.fq").write_text(TWO)
    (odd / "_skipped").write_text("no record")
    for path in (str(odd), str(odd / "x.fq"), [str(odd / "x.fq")], f"file://{odd}/x.fq", f"file:{odd}/x.fq"):
        assert fastq.read_fastq(spark, path).count() == 2


def test_remote_files_are_opened_by_uri(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "x.fq").write_text(TWO)
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(TWO.encode()))
    (tmp_path / "_z").write_text("")
    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(fastq, "_remote", lambda path: (system, path.split("://h/")[1]))
    for name in ("x.fq", "y.fq.gz"):
        assert [r[1] for r in fastq.single_records(f"mem://h/{name}")] == ["seq1", "seq2"]
    assert [r[1] for r in fastq.single_records("mem://h/x.fq", 5, 60)] == ["seq2"]
    assert fastq._files(["mem://h/*.fq"]) == ["mem://h/x.fq"] and fastq._size("mem://h/x.fq") == len(TWO)


def test_long_pairs_are_read_in_splits(spark, tmp_path):
    r = random.Random(4)
    record = lambda i, n: f"@r{i} d{i}\n{'A' * n}\n+\n{'I' * n}\n"
    sizes = [(i, r.randint(1, 40), r.randint(1, 90)) for i in range(300)]
    for f in ("p", "q"):
        (tmp_path / f"{f}1.fq").write_text("".join(record(f"{f}{i}", n) for i, n, _ in sizes))
        (tmp_path / f"{f}2.fq").write_text("".join(record(f"{f}{i}", n) for i, _, n in sizes))
    first, second = ([str(tmp_path / f"{f}{m}.fq") for f in ("p", "q")] for m in "12")
    whole, parts = (fastq.read_fastq(spark, first, second, split_bytes=n) for n in (1 << 20, 5000))
    assert "FullOuter" in parts._jdf.queryExecution().toString() and whole.schema == parts.schema
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    (tmp_path / "q2.fq").write_text("".join(record(f"q{i}", n) for i, _, n in sizes[:-1]))
    with pytest.raises(Exception, match="ends before its mate"):
        fastq.read_fastq(spark, first, second, split_bytes=5000).collect()
    (tmp_path / "q2.fq").write_text("".join(record(f"q{i if i else 'x'}", n) for i, _, n in sizes))
    with pytest.raises(Exception, match="IDs do not match: rq0, rqx"):
        fastq.read_fastq(spark, first, second, split_bytes=5000).collect()
