"""Near-duplicates by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.components import components
from cardwatch.llm.shared import numbered, stage

BITS = 64
#: Fingerprints compared with each other in one bucket; a larger one is split further.
BUCKET = 200


def shingles(text: str | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and bytes of a text's shingles of words, in order; fewer words are one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    flat = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.append(0, spaces + 1)
    ends = np.append(spaces, len(flat))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], 42) for a, b in spans], "<u8"), ends - starts


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of `shingles`."""
    return shingles(text, shingle)[0]


def fingerprint_bytes(text: str | None, shingle: int) -> bytes:
    """Eight bytes, little-endian: bit b is set if most shingle hashes have it."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def with_fingerprint(
    docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", shingle: int = 3
) -> DataFrame:
    """Appends the fingerprint as a signed 64-bit integer. Null text has no words."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = b"".join(fingerprint_bytes(t.as_py(), shingle) for t in texts)
            yield pa.array(np.frombuffer(found, "<i8"), pa.int64())

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 bit masks that no difference of `radius` bits can all touch.

    Each bit position has a vector of radius + 1 bits; the mask of v holds the positions
    whose vector has an odd product with v. The vectors of at most `radius` differing
    positions leave some v with even products only, so its mask touches none of them.
    Every vector is dealt to the same number of positions, in an order of its own for
    each level.
    """
    vectors = [k % 2 ** (radius + 1) for k in range(BITS)]
    random.Random(level).shuffle(vectors)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << b for b, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def links(prints: DataFrame, *, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(u, v): pairs u < v of distinct fingerprints at `radius` or fewer differing bits.

    Two fingerprints that agree under a mask share a bucket. Buckets of up to `bucket`
    are compared inside; all fingerprints of a larger one are dealt again, by masks of
    the next level, together with the old bucket. The pair stays together at each level
    in some table, whatever the masks, so none is lost. A level halves the bits that can
    still differ, and on the last one buckets are small of themselves.
    """
    nodes = prints.select(F.col("fingerprint").alias("fp")).distinct()
    open_rows = nodes.withColumn("trail", F.lit(0).cast("long"))
    found = None
    for level in range(6):
        masks = covering_masks(radius, level)
        tables = F.explode(
            F.array(
                *[
                    F.struct(
                        F.xxhash64(
                            "trail", F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))
                        ).alias("key")
                    )
                    for k, m in enumerate(masks)
                ]
            )
        )
        dealt = stage(open_rows.select("fp", tables.alias("t")).select("fp", "t.key"), "buckets")
        sizes = dealt.groupBy("key").count().filter("`count` > 1")
        last = level == 5
        small = sizes if last else sizes.filter(F.col("count") <= bucket)
        inside = stage(dealt.join(small.select("key"), "key"), "shared-buckets")
        a = inside.select("key", F.col("fp").alias("u"))
        b = inside.select("key", F.col("fp").alias("v"))
        near = (F.col("u") < F.col("v")) & (
            F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
        )
        pairs = stage(a.join(b, "key").filter(near).select("u", "v").distinct(), "pairs")
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        large = sizes.filter(F.col("count") > bucket).select(F.col("key").alias("trail"))
        open_rows = dealt.withColumnRenamed("key", "trail").join(large, "trail").select("fp", "trail")
        if large.isEmpty():
            break
    return found.distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    shingle: int = 3,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id.

    The component is what links lead to: fingerprints at `radius` or fewer differing bits,
    in chains. Its id is the smallest id in it. Documents with the same fingerprint are
    one node, so thousands of copies cost one comparison.

    Null and empty text: fingerprint zero, linked like any other. Fewer words than a
    shingle: the whole sequence. Null ids: rows are kept and don't count for the smallest
    id; a component of none but null ids has a null id. Repeated rows each have a row.
    Empty table: no rows. Very long texts are hashed whole.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stage(with_fingerprint(rows, text_col="_text", shingle=shingle).drop("_text"), "prints")
    nodes = rows.groupBy("fingerprint").agg(F.min("_id").alias("low"))
    linked = components(links(rows, radius=radius, bucket=bucket))
    named = nodes.join(linked, nodes["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "low", F.coalesce("component", "fingerprint").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 3
) -> DataFrame:
    """One whole row of each component of `near_duplicates`, with its own columns.

    It is the first by id (nulls first) and text; rows that repeat an id are documents of
    their own. An aggregate finds it, so copies never meet in one task.
    """
    rows, key = numbered(docs, id_col, text_col)
    found = near_duplicates(
        rows.select(key, text_col), id_col=key, text_col=text_col, radius=radius
    )
    # Hashing the ids spares sorting the texts.
    firsts = found.filter(F.col(key) == F.col("component_id")).select(key).hint("shuffle_hash")
    return rows.join(firsts, key, "left_semi").drop(key)
