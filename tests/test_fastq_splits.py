"""A broken record fails the file wherever splits begin."""

import pytest

from cladeflow.sources import fastq

GOOD = "@a\nACGT\n+\nIIII\n"


@pytest.mark.parametrize("bad", ["@b\nACGT\n+\nII\n", "@b\nACGT\n-\nIIII\n", "b\nACGT\n+\nIIII\n", "@b\nACGT\n"])
def test_broken_record_fails_at_any_split(tmp_path, bad):
    tail = GOOD * 3 if bad.count("\n") == 4 else ""
    p, text = tmp_path / "a.fq", GOOD * 2 + bad + tail
    p.write_text(text)
    for split in range(1, len(text) + 1):
        with pytest.raises(fastq.FastqError):
            for start in range(0, len(text), split):
                list(fastq.single_records(str(p), start, start + split))


def test_good_records_pass_at_any_split(tmp_path):
    p, text = tmp_path / "a.fq", GOOD * 5
    p.write_text(text)
    for split in range(1, len(text) + 1):
        assert sum(len(list(fastq.single_records(str(p), s, s + split))) for s in range(0, len(text), split)) == 5
