"""Contents: sizes first, then bytes, in chunks."""

from __future__ import annotations

import os

from conftest import ts
from sylva.operators import content as Co

PAIR = ("source_path string, dest_path string, s_is_dir boolean, s_size bigint, s_mtime timestamp, s_hash string, "
        "d_is_dir boolean, d_size bigint, d_mtime timestamp, d_hash string")


def test_bytes_are_read_for_equal_sizes_alone_and_in_ranges(spark, tmp_path):
    def put(name, data):
        p = tmp_path / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_bytes(data)
        return len(data)

    big = os.urandom(10_000)
    other = big[:7000] + b"x" + big[7001:]
    files = {"same": (big, big), "late": (big, other), "size": (big, big + b"1"), "empty": (b"", b""), "edge": (b"a" * 4096, b"a" * 4096)}
    rows = []
    for n, (s, d) in files.items():
        rows.append((f"/s/{n}", f"/d/{n}", False, put(f"s/{n}", s), ts(0), None, False, put(f"d/{n}", d), ts(0), None))
    rows.append(("/s/gone", "/d/gone", False, 5, ts(0), None, False, put("d/gone", b"12345"), ts(0), None))
    rows.append(("/s/hash", "/d/hash", False, 5, ts(0), "h", False, 5, ts(0), "h"))
    rows.append(("/s/dir", "/d/dir", True, 0, None, None, True, 0, None, None))
    rows.append(("/s/new", "/d/new", False, 5, ts(0), None, None, None, None, None))
    pairs = spark.createDataFrame(rows, PAIR)
    of = lambda files: Co.file_chunks(files, str(tmp_path), chunk_bytes=1024)
    got = {r.dest_path: (r.equal, r.n_read) for r in Co.equal_by_content(pairs, of, of).collect()}
    assert got == {"/d/same": (True, 20_000), "/d/late": (False, 20_000), "/d/size": (False, 0), "/d/empty": (True, 0), "/d/edge": (True, 8192),
                   "/d/gone": (False, 5), "/d/hash": (True, 0), "/d/dir": (True, 0), "/d/new": (False, 0)}
    assert of(spark.createDataFrame([("/s/same", 10_000)], "path string, size bigint")).count() == 10


def test_one_sided_hashes_are_read(spark):
    rows = [("/s/a", "/d/a", False, 3, ts(0), "stored", False, 3, ts(0), None)]
    pairs = spark.createDataFrame(rows, PAIR)
    chunks = {p: spark.createDataFrame([(p, 1, b"c"), (p, 0, b"ab")], "path string, k int, bytes binary") for p in ("/s/a", "/d/a")}
    out = Co.equal_by_content(pairs, lambda f: Co.table_chunks(chunks["/s/a"], f), lambda f: Co.table_chunks(chunks["/d/a"], f)).collect()
    assert [(r.equal, r.n_read) for r in out] == [(True, 6)]
