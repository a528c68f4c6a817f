"""Exact deduplication by composable polynomial fingerprints, confirmed chunk by chunk.

A text's fingerprint is the value of its UTF-8 bytes as base-256 digits modulo a prime. Fingerprints
compose: that of ``a + b`` is ``fp(a) * 256**len(b) + fp(b)``, so the chunks of a huge document are
hashed by different tasks and put together by length-shifted arithmetic. Rows of equal length and
fingerprint are then compared with the row that stays, chunk by chunk, without any whole text in memory.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, arrow_map, numbered, text_or_empty, unique_ids

#: A safe prime (p and (p - 1) / 2 are prime), so powers of 256 don't repeat within any text.
PRIME = (1 << 122) + 12523
CHUNK_BYTES = 1 << 16


def combine(left: tuple[int, int], right: tuple[int, int], prime: int = PRIME) -> tuple[int, int]:
    """(length, hash) of the joined bytes of two parts."""
    return left[0] + right[0], (left[1] * pow(256, right[0], prime) + right[1]) % prime


def fingerprint(data: bytes, prime: int = PRIME, chunk: int = CHUNK_BYTES) -> tuple[int, int]:
    """(length, hash), by chunks."""
    if len(data) <= chunk:
        return len(data), int.from_bytes(data, "big") % prime
    shift, value, size = pow(256, chunk, prime), 0, len(data)
    whole = size - size % chunk
    for at in range(0, whole, chunk):
        value = (value * shift + int.from_bytes(data[at : at + chunk], "big")) % prime
    return combine((whole, value), (size - whole, int.from_bytes(data[whole:], "big") % prime), prime)


def _hashes(prime: int, sha: bool):
    def work(ids, parts, texts):
        n, fp, digest = [], [], []
        for t in texts:
            data = t.encode()
            size, value = fingerprint(data, prime)
            n.append(size)
            fp.append(value.to_bytes(16, "big"))
            digest.append(hashlib.sha256(data).hexdigest() if sha else None)
        return {"doc_id": ids, "part": parts, "n_bytes": n, "fp": fp, "sha": digest}

    return work


def _combined(prime: int):
    def work(ids, lengths, hashes):
        n, fp = [], []
        for sizes, values in zip(lengths, hashes, strict=True):
            whole = (0, 0)
            for size, value in zip(sizes, values, strict=True):
                whole = combine(whole, (size, int.from_bytes(value, "big")), prime)
            n.append(whole[0])
            fp.append(whole[1].to_bytes(16, "big"))
        return {"doc_id": ids, "n_bytes": n, "fp": fp}

    return work


def fingerprints(docs: DataFrame, kind: str, *, split_chars: int, prime: int = PRIME) -> DataFrame:
    """``doc_id, n_bytes, fp, sha`` of ``doc_id, text``; texts of over ``split_chars`` characters are dealt out in parts."""
    schema = f"doc_id {kind}, part int, n_bytes bigint, fp binary, sha string"
    small = arrow_map(docs.filter(F.length("text") <= split_chars).select("doc_id", F.lit(0).alias("part"), "text"), lambda: _hashes(prime, True), schema).drop("part")
    huge = docs.filter(F.length("text") > split_chars)
    parts = huge.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / split_chars).cast("int"))).alias("part"))
    parts = parts.select("doc_id", "part", F.col("text").substr(F.col("part") * split_chars + 1, F.lit(split_chars)).alias("text")).repartition("doc_id", "part")
    hashed = arrow_map(parts, lambda: _hashes(prime, False), schema)
    listed = hashed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "n_bytes", "fp"))).alias("p")).select("doc_id", "p.n_bytes", "p.fp")
    whole = arrow_map(listed, lambda: _combined(prime), f"doc_id {kind}, n_bytes bigint, fp binary")
    return small.unionByName(whole.join(huge.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("sha")), "doc_id"))


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    split_chars: int = 1 << 22,
    compare_chars: int = 1 << 16,
    salt_rows: int = 256,
    prime: int = PRIME,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text is empty. A null id is less than any
    other; of rows that repeat an id, too, one stays, and each counts. Other columns, whatever their names,
    are not read.

    The texts of a group are dealt over ``salt_rows`` members a task with a copy of the text that stays,
    so that one group may hold any share of the rows. Rows that turn out to differ from the row that
    stays although their fingerprints are equal form groups of their own, until none are left. What a
    join meets with a hot key is a written table, so that the engine can split that key's rows.
    """
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    options = {"split_chars": split_chars, "compare_chars": compare_chars, "salt_rows": salt_rows, "prime": prime}
    if unique_ids(texts, "doc_id"):
        return _unique(scratch, texts, **options)
    rows = numbered(scratch, texts.withColumnRenamed("doc_id", "id"), "id", "doc_id", nulls_first=True)
    found = _unique(scratch, rows.select("doc_id", "text"), **options)
    ids = rows.select("doc_id", "id")
    found = found.join(ids, "doc_id").join(ids.select(F.col("doc_id").alias("keep_id"), F.col("id").alias("keep")), "keep_id")
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", "text_sha256")


def _unique(scratch: Scratch, texts: DataFrame, *, split_chars: int, compare_chars: int, salt_rows: int, prime: int) -> DataFrame:
    """``exact_dedup`` of ``doc_id, text`` with ids that are unique and not null."""
    kind = dict(texts.dtypes)["doc_id"]
    fps = scratch.table(fingerprints(texts, kind, split_chars=split_chars, prime=prime))
    open_rows, settled = fps, None
    while True:
        groups = scratch.table(open_rows.groupBy("n_bytes", "fp").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1"))
        members = open_rows.select("doc_id", "n_bytes", "fp").join(groups, ["n_bytes", "fp"]).filter("doc_id <> keep_id")
        members = scratch.table(members.select("doc_id", "keep_id", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / salt_rows)).alias("salt")))
        apart = scratch.table(differing(texts, members, compare_chars))
        same = members.join(apart, "doc_id", "left_anti").select("doc_id", "keep_id")
        settled = same if settled is None else settled.union(same)
        if apart.isEmpty():
            break
        open_rows = open_rows.join(apart, "doc_id", "left_semi")
    sized = scratch.table(settled.groupBy("keep_id").agg((F.count("*") + 1).alias("group_size")))
    kept = settled.join(sized, "keep_id").select("doc_id", "keep_id", "group_size").union(sized.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size"))
    known = fps.join(kept, "doc_id", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return known.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.col("sha").alias("text_sha256"))


def differing(texts: DataFrame, members: DataFrame, compare_chars: int) -> DataFrame:
    """``doc_id`` of the members whose text isn't that of the row that stays."""
    salts = members.select("keep_id", "salt").distinct()
    needed = members.select("doc_id").union(members.select("keep_id")).distinct()
    at = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / compare_chars).cast("int")))
    cut = F.col("text").substr(F.col("chunk") * compare_chars + 1, F.lit(compare_chars)).alias("piece")
    chunks = texts.join(needed, "doc_id", "left_semi").select("doc_id", "text", at.alias("chunk")).select("doc_id", "chunk", cut)
    mine = chunks.join(members, "doc_id")
    stays = chunks.join(salts, chunks.doc_id == salts.keep_id).select("keep_id", "salt", "chunk", F.col("piece").alias("other"))
    return mine.join(stays, ["keep_id", "salt", "chunk"], "left").filter("NOT piece <=> other").select("doc_id").distinct()
