"""A bounded sample of labelled documents for fitting the classifiers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: The bounds of a sample that comes to the driver: labelled rows, and bytes of their texts.
MAX_ROWS = 3000
MAX_BYTES = 24 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """(text, label) of about ``max_rows`` labelled rows outside the held-out remainder, whole texts, in a fixed order.

    Rows are chosen by a hash of their id, so that the expected number is max_rows; a text
    that does not fit in what is left of max_bytes is passed over, by its length, before any text comes here. Null ids, labels and texts take no part.
    """
    own = labels.where(F.col(label).isin(0, 1) & (crc_mod(doc_id, mod) != held_out)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_rows / n)))
    few = F.broadcast(own)  # about max_rows rows of two numbers
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").join(few, "id").withColumns({"size": F.octet_length("text"), "h": F.xxhash64("text")})
    keys = rows.select("id", "y", "h", "size")
    sizes = keys.collect()
    sizes.sort(key=lambda r: (hash_of(r["id"]), str(r["id"]), r["y"], r["h"]))
    fits, size = Counter(), 0
    for r in sizes:
        if size + r["size"] <= max_bytes:
            size += r["size"]
            fits[tuple(r)] += 1
    if fits.total() < len(sizes):
        kept = docs.sparkSession.createDataFrame(list(fits), keys.schema)
        rows = rows.join(F.broadcast(kept), ["id", "y", "h", "size"], "left_semi")
    got = rows.select("id", "y", "h", "size", "text").collect()
    got.sort(key=lambda r: (hash_of(r["id"]), str(r["id"]), r["y"], r["text"]))
    out = []
    for r in got:
        if fits[key := tuple(r)[:4]] > 0:
            fits[key] -= 1
            out.append((r["text"], r["y"]))
    return out


def hash_of(value: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(value))
