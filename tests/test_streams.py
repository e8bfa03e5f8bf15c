"""Streams of files hold a bounded part of them, however well they were packed."""

import gzip

from lodestrand.sources import streams


def test_pieces_and_counts_of_well_packed_gzip(spark, tmp_path):
    text = b"a\n" * 5_000_000 + b"end"
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(text[:7_000_001]) + gzip.compress(text[7_000_001:]))
    found = list(streams.pieces(f"file://{path}"))
    assert b"".join(found) == text and max(map(len, found)) <= streams.READ_BYTES
    (tmp_path / "exact.gz").write_bytes(gzip.compress(b"a\n" * (streams.READ_BYTES // 2)))
    (tmp_path / "plain").write_bytes(b"a\n\nb\n")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.lines for r in streams.count_lines(spark, str(tmp_path)).collect()}
    assert got == {"x.gz": 5_000_001, "exact.gz": streams.READ_BYTES // 2, "plain": 3}
