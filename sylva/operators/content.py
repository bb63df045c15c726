"""Equality of contents by size first, then by bytes, in chunks.

Phase one needs no content: pairs whose sizes differ are unequal. Phase two
reads only pairs of equal size that lack a hash. Contents are read in ranges
of ``chunk_bytes``, so a file may be larger than memory or 2 GB; a range's
digest is SHA-256, a file's is the SHA-256 of its ranges' digests in order.
Ranges, not files, are the rows that Spark deals out: a huge file is read by
many tasks. The aggregate that folds them holds 32 bytes for each range.

Contents come from files (``file_chunks``, anything that ``pyarrow.fs`` opens) or
from a table of chunks ``path, k, bytes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.diff import content_equal

CHUNK_BYTES = 64 << 20


def ranges(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` (with ``path, size``) once for each range: ``k`` and its ``length``; an empty file has one empty range."""
    last = F.greatest(F.floor((F.col("size") - 1) / chunk_bytes), F.lit(0)).cast("long")
    return files.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        "length", F.least(F.col("size") - F.col("k") * chunk_bytes, F.lit(chunk_bytes)).cast("long"))


def file_chunks(files: DataFrame, root: str = "", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, k, digest, n_read`` of every range of files (``path, size``) below ``root``. A file that is gone or
    shorter than its size has null digests there, so it equals nothing."""
    kept = pa.schema([("path", pa.string()), ("k", pa.int64()), ("digest", pa.binary()), ("n_read", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylva.sources.listing import open_location

        for b in batches:
            out = []
            for path, k, length in zip(*(b.column(c).to_pylist() for c in ("path", "k", "length"))):
                try:
                    system, at = open_location(root + path)
                    with system.open_input_file(at) as f:
                        state, left = hashlib.sha256(), length
                        f.seek(k * chunk_bytes)
                        while left and (data := f.read(min(left, 4 << 20))):
                            state.update(data)
                            left -= len(data)
                    out.append((path, k, state.digest() if not left else None, length - left))
                except OSError:
                    out.append((path, k, None, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kept.types)], schema=kept)

    return ranges(files.select("path", "size").distinct(), chunk_bytes).select("path", "k", "length").mapInArrow(run, "path string, k long, digest binary, n_read long")


def table_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The same of a table of chunks ``path, k, bytes``, restricted to ``files`` before its bytes are read."""
    wanted = files.select("path").distinct()
    return chunks.join(wanted, "path", "left_semi").select(
        "path", F.col("k").cast("long").alias("k"), F.unhex(F.sha2("bytes", 256)).alias("digest"), F.octet_length("bytes").cast("long").alias("n_read"))


def fold_digests(chunks: DataFrame) -> DataFrame:
    """``path, content_hash, n_read``: null hash where a range's digest is null."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "digest"))).getField("digest")
    whole = F.aggregate(ordered, F.lit("").cast("binary"), lambda a, d: F.concat(a, d))
    g = chunks.groupBy("path").agg(whole.alias("w"), F.count_if(F.col("digest").isNull()).alias("bad"), F.sum("n_read").alias("n_read"))
    return g.select("path", F.when(F.col("bad") == 0, F.sha2("w", 256)).alias("content_hash"), "n_read")


def undecided() -> Column:
    """Pairs that only bytes can judge: two files of equal size, a hash missing."""
    return (F.col("source_path").isNotNull() & ~F.col("s_is_dir") & ~F.col("d_is_dir") & (F.col("s_size") == F.col("d_size"))
            & (F.col("s_hash").isNull() | F.col("d_hash").isNull()))


def equal_by_content(pairs: DataFrame, source_chunks, dest_chunks) -> DataFrame:
    """Judged ``pairs`` with ``equal`` and ``n_read`` (content bytes read for the pair).

    ``source_chunks`` and ``dest_chunks`` give the chunk digests of a frame of
    ``path, size``, e.g. ``lambda files: file_chunks(files, root)``; they get only
    the files of pairs that are undecided. Where one hash is missing both
    sides are read: a stored hash may be of another kind.
    """
    need = pairs.where(F.coalesce(undecided(), F.lit(False)))
    s = fold_digests(source_chunks(need.select(F.col("source_path").alias("path"), F.col("s_size").alias("size"))))
    d = fold_digests(dest_chunks(need.select(F.col("dest_path").alias("path"), F.col("d_size").alias("size"))))
    read = (need.select("source_path", "dest_path")
                .join(s.select(F.col("path").alias("source_path"), F.col("content_hash").alias("_s"), F.col("n_read").alias("_sn")), "source_path", "left")
                .join(d.select(F.col("path").alias("dest_path"), F.col("content_hash").alias("_d"), F.col("n_read").alias("_dn")), "dest_path", "left")
                .select("dest_path", F.coalesce(F.col("_s") == F.col("_d"), F.lit(False)).alias("_same"),
                        (F.coalesce("_sn", F.lit(0)) + F.coalesce("_dn", F.lit(0))).alias("_n")))
    return (pairs.join(read, "dest_path", "left")
                 .withColumn("equal", F.coalesce("_same", content_equal()))
                 .withColumn("n_read", F.coalesce("_n", F.lit(0)).cast("long")).drop("_same", "_n"))
