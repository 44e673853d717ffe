"""Token files with a minimal perfect hash index for keyed access.

Documents are range-partitioned and sorted by doc_id; every partition is
encoded into one shard file of raw ids. Keys are hashed into index buckets; for
each bucket a minimal perfect hash function maps its keys to 0..n-1, and arrays
in that order hold a fingerprint, the shard, the place and the number of ids.
A lookup reads one bucket, one slot, and one range of one shard.

A shard file is `TIDS`, a version byte, a byte with the width of an id, two
zero bytes, then little-endian ids. Files are written under another name and
moved into place, so a repeated or speculative task leaves one whole file.

Defined cases: null and empty texts are the end id alone; null doc_ids come
first and are keyed as null; of rows that share a doc_id each has its own key
(doc_id, occurrence), in order of a hash of the text; an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import settle, ship, slices
from skyledger.llm.tokens import shared_encoder
from skyledger.llm.words import mix
from skyledger.session import scratch_path

HEADER = 8
_LEVEL_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Levels of bits: a key takes the first level where no other key shares its place.

    The slot of a key is the number of set bits before its own.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        parts, sizes, left = [], [], keys
        for seed in _LEVEL_SEEDS:
            if not left.size:
                break
            size = -(-max(int(left.size * spread), 64) // 64) * 64
            place = mix(left ^ seed) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place.astype(np.int64)]]
        if left.size:
            raise ValueError("keys are not distinct")
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where no level has its bit set."""
        out, left, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for seed, size in zip(_LEVEL_SEEDS, self.sizes):
            place = (mix(keys[left] ^ seed) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[place >> 6] + below)[hit]
            left, base = left[~hit], base + int(size)
        return out


def key_hashes(doc_ids: pd.Series, occurrence: pd.Series) -> np.ndarray:
    """64-bit keys of (doc_id, occurrence); distinct for all first occurrences."""
    null = doc_ids.isna().to_numpy()
    ids = doc_ids.fillna(0).astype("int64").to_numpy().view(np.uint64)
    again = occurrence.to_numpy().astype(np.uint64) + np.where(null, np.uint64(1 << 63), np.uint64(0))
    return mix(ids ^ np.where(again > 0, mix(again + np.uint64(0x51ED270B)), np.uint64(0)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _place(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}") if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


@contextmanager
def _published(root: str, name: str) -> Iterator:
    """A stream under a name of this attempt; the file moves into place when it is whole.

    A store that refuses to move onto a name gets the earlier attempt's file
    removed first; the two hold the same rows.
    """
    files, path = _place(root)
    files.create_dir(path, recursive=True)
    own, place = f"{path}/_{name}-{TaskContext.get().taskAttemptId()}", f"{path}/{name}"
    with files.open_output_stream(own) as out:
        yield out
    try:
        files.move(own, place)
    except OSError:
        files.delete_file(place)
        files.move(own, place)


@dataclass
class TokenStore:
    """A written store: its folder, entries (settled table), shard offsets and buckets."""

    spark: SparkSession
    root: str
    entries: DataFrame
    offsets: dict[int, int]
    buckets: int


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shards: int | None = None, bucket_keys: int = 100_000, root: str | None = None) -> TokenStore:
    """Encode ``docs`` into shard files in ascending doc_id order, and index them.

    Rows are dealt by ranges of doc_id and a hash of the text, so one doc_id on
    very many rows fills several shards. ``shards`` defaults to spark.sql.shuffle.partitions; ``bucket_keys`` is the
    aimed number of keys of an index bucket; ``root`` is a shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    root = root or scratch_path(spark, "llm-token-store")
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(definition.value, keeps_space=False)
        end = int(end_id).to_bytes(encoder.width, "little")
        shard = TaskContext.get().partitionId()
        with _published(f"{root}/ids", f"shard-{shard:06d}.ids") as out:
            out.write(b"TIDS" + bytes([1, encoder.width, 0, 0]))
            offset, last, again = 0, object(), 0
            for frame in frames:
                for rows, texts in slices(frame, 2 << 20):
                    ids, found = [x + end for x in encoder.encode(texts)], []
                    for doc_id, x in zip(rows["doc_id"], ids):
                        doc_id = None if pd.isna(doc_id) else int(doc_id)
                        again = again + 1 if doc_id == last else 0
                        last, n = doc_id, len(x) // encoder.width
                        found.append((shard, doc_id, again, offset, n))
                        offset += n
                    out.write(b"".join(ids))
                    listed = pd.DataFrame(found, columns=["shard", "doc_id", "occurrence", "offset", "n"])
                    yield listed.astype({"doc_id": "Int64"})

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that share a doc_id may fill more than one shard.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("order")).repartitionByRange(n, "doc_id", "order")
    rows = rows.sortWithinPartitions("doc_id", "order", "text").select("doc_id", "text")
    entries = settle(rows.mapInPandas(encode, "shard int, doc_id long, occurrence int, offset long, n long"), "token-entries")
    totals = entries.groupBy("shard").agg(
        F.sum("n").alias("n"), F.count("*").alias("keys"), F.min_by("doc_id", "offset").alias("first"),
        F.max_by("doc_id", "offset").alias("last"), F.max_by("occurrence", "offset").alias("again"),
    ).toPandas().astype({"first": "Int64", "last": "Int64"}).sort_values("shard")
    offsets = dict(zip(totals["shard"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist()))
    buckets = max(1, -(-int(totals["keys"].sum()) // bucket_keys))
    entries = _counted_on(entries, totals)

    def index(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = key_hashes(frame["doc_id"], frame["occurrence"])
        function = PerfectHash.build(keys)
        order = np.empty(keys.size, np.int64)
        order[function.slots(keys)] = np.arange(keys.size)
        blob = io.BytesIO()
        np.savez(
            blob, bits=function.bits, sizes=function.sizes, fingerprint=fingerprints(keys)[order],
            **{c: frame[c].to_numpy()[order] for c in ("shard", "offset", "n")},
        )
        with _published(f"{root}/index", f"bucket-{key[0]:06d}.mph") as out:
            out.write(blob.getvalue())
        return pd.DataFrame({"bucket": [key[0]], "keys": [keys.size]})

    indexed = _bucketed(entries, buckets).groupBy("bucket").applyInPandas(index, "bucket int, keys long")
    settle(indexed, "token-index")
    return TokenStore(spark, root, entries, offsets, buckets)


def _counted_on(entries: DataFrame, totals: pd.DataFrame) -> DataFrame:
    """Occurrences of a shard's first doc_id go on where the shard before ended with the same one."""
    carried, last, count = {}, object(), 0
    for row in totals.itertuples(index=False):
        first = None if pd.isna(row.first) else int(row.first)
        own = None if pd.isna(row.last) else int(row.last)
        before = count if first == last else 0
        if before:
            carried[int(row.shard)] = (first, before)
        # All rows of a shard that has one doc_id only come on top of those before.
        last, count = own, int(row.again) + 1 + (before if own == first else 0)
    if not carried:
        return entries
    shared = entries.sparkSession.sparkContext.broadcast(carried)  # one entry per shard at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in set(frame["shard"].unique()) & shared.value.keys():
                doc_id, before = shared.value[shard]
                here = frame["shard"] == shard
                same = frame["doc_id"].isna() if doc_id is None else frame["doc_id"] == doc_id
                frame.loc[here & same, "occurrence"] += before
            yield frame.astype({"doc_id": "Int64"})

    return settle(entries.mapInPandas(run, entries.schema), "token-entries")


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets)).cast("int"))


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, occurrence, shard, offset, n) of each key that the index has."""
    root = store.root

    def find(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        files, path = _place(f"{root}/index")
        with files.open_input_file(f"{path}/bucket-{key[0]:06d}.mph") as f:
            index = np.load(io.BytesIO(f.read()))
        hashes = key_hashes(frame["doc_id"], frame["occurrence"])
        slots = PerfectHash(index["bits"], index["sizes"]).slots(hashes)
        known = (slots >= 0) & (index["fingerprint"][np.maximum(slots, 0)] == fingerprints(hashes))
        out = frame.loc[known, ["doc_id", "occurrence"]].astype({"doc_id": "Int64"})
        return out.assign(**{c: index[c][slots[known]] for c in ("shard", "offset", "n")})

    schema = "doc_id long, occurrence int, shard int, offset long, n long"
    return _bucketed(keys.select("doc_id", "occurrence"), store.buckets).groupBy("bucket").applyInPandas(find, schema)


def read_back(store: TokenStore, keys: DataFrame | None = None, window: int = 8 << 20) -> DataFrame:
    """doc_id, occurrence, start, n_tokens and crc32 of the stored ids of each key.

    Keys default to all. Ranges of a shard are read in order, ``window`` bytes
    at a time; the ids never leave the tasks.
    """
    root, base = store.root, store.spark.sparkContext.broadcast(store.offsets)

    def check(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        files, path = _place(f"{root}/ids")
        crc = []
        with files.open_input_file(f"{path}/shard-{key[0]:06d}.ids") as f:
            width = f.read_at(HEADER, 0)[5]
            begins = (frame["offset"].to_numpy() * width + HEADER).tolist()
            sizes = (frame["n"].to_numpy() * width).tolist()
            held, held_at = b"", 0
            for at, size in zip(begins, sizes):
                if at < held_at or at + size > held_at + len(held):
                    held, held_at = f.read_at(max(window, size), at), at
                ids = np.frombuffer(held, "<u2" if width == 2 else "<u4", size // width, at - held_at)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64"), "occurrence": frame["occurrence"],
            "start": frame["offset"] + base.value[key[0]], "n_tokens": frame["n"], "ids_crc32": crc,
        })

    found = locate(store, store.entries if keys is None else keys)
    return found.groupBy("shard").applyInPandas(
        check, "doc_id long, occurrence int, start long, n_tokens long, ids_crc32 long"
    )
