"""Token ids in shard files, with a minimal perfect hash from document keys to their place.

A store is a folder of shards and a manifest with one row per shard. Shards follow each other in
ascending order of the document id. A shard holds, little endian and in this order:

* the ids of its documents, one after the other, two bytes each if the vocabulary allows;
* the start of each document in ids, and the end of the last;
* the perfect hash of the different document ids: sizes of its levels, bits, ranks;
* by number of the key: a 32-bit fingerprint, the first row and how many rows the key has;
* the footer, which gives the length of each section.

A key is looked up in the shards whose range holds it (rows of one key may go on in the next
shard): its number, the fingerprint, then the start and end of its ids. No keys are stored.

Writers name files anew in each attempt, and only the files of successful tasks are in the
manifest, so a lost executor leaves no trace in a store. The folder may be in any file system
that pyarrow reaches from its address.

Defined results: a null text has no ids but the end id; a null id takes the place of the
smallest 64-bit number; rows with the same id follow each other in the order of a hash of their
text; an empty table makes an empty store; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices
from aliasmith.llm.mphash import PerfectHash, mix
from aliasmith.llm.wordpieces import WordEncoder
from aliasmith.session import scratch_folder, stored

# Ids in a shard before the next one is begun; a document is never split.
SHARD_IDS = 1 << 26
END_ID = 1
NULL_ID = -(1 << 63)
_MAGIC = b"ALIASTOK"
_SECTIONS = ("ids", "starts", "levels", "bits", "ranks", "prints", "rows", "counts")
_KINDS = {"starts": "<u8", "levels": "<u8", "bits": "<u8", "ranks": "<u8", "prints": "<u4", "rows": "<u4", "counts": "<u4"}
_FOOTER = struct.Struct("<8sQ" + "Q" * len(_SECTIONS))
_FINGERPRINT_SEED = 1 << 20
_ROWS = 1024
# Ids that are read from a shard at once.
_RUN_IDS = 1 << 20
_MANIFEST = "partition int, shard int, path string, low bigint, high bigint, n_docs bigint, n_ids bigint"


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, _FINGERPRINT_SEED) >> np.uint64(32)).astype("<u4")


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; a plain path is a local one."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


class ShardWriter:
    def __init__(self, address: str, kind: np.dtype) -> None:
        system, folder = open_folder(address)
        system.create_dir(folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids"
        self.file = system.open_output_stream(f"{folder}/{self.name}")
        self.kind, self.keys, self.sizes, self.n_ids = kind, [], [], 0

    def add(self, key: int, ids: bytes) -> None:
        self.file.write(ids)
        size = len(ids) // self.kind.itemsize
        self.keys.append(key)
        self.sizes.append(size)
        self.n_ids += size

    def close(self) -> dict:
        """Writes the index; returns the shard's row of the manifest."""
        keys, first, counts = np.unique(np.array(self.keys, np.int64), return_index=True, return_counts=True)
        unsigned = keys.view(np.uint64)
        table = PerfectHash.build(unsigned)
        place = table.number(unsigned)
        by_number = {"prints": fingerprints(unsigned), "rows": first, "counts": counts}
        parts = {
            "starts": np.cumsum([0, *self.sizes]),
            "levels": table.sizes,
            "bits": table.words,
            "ranks": table.ranks,
        }
        for name, values in by_number.items():
            parts[name] = np.empty(len(keys), _KINDS[name])
            parts[name][place] = values
        lengths = [self.n_ids * self.kind.itemsize]
        for name in _SECTIONS[1:]:
            raw = parts[name].astype(_KINDS[name]).tobytes()
            lengths.append(len(raw))
            self.file.write(raw)
        self.file.write(_FOOTER.pack(_MAGIC, self.kind.itemsize, *lengths))
        self.file.close()
        return {
            "path": self.name,
            "low": self.keys[0],
            "high": self.keys[-1],
            "n_docs": len(self.keys),
            "n_ids": self.n_ids,
        }


class Shard:
    """An open shard; its index is in memory, its ids stay in the file."""

    def __init__(self, address: str, name: str) -> None:
        system, folder = open_folder(address)
        self.file = system.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        magic, width, *lengths = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not a shard of token ids")
        self.kind = np.dtype(f"<u{width}")
        at, parts = lengths[0], {}
        for section, length in zip(_SECTIONS[1:], lengths[1:], strict=True):
            parts[section] = np.frombuffer(self.file.read_at(length, at), _KINDS[section])
            at += length
        self.starts, self.prints, self.rows, self.counts = (parts[p] for p in ("starts", "prints", "rows", "counts"))
        self.table = PerfectHash(parts["levels"], parts["bits"], parts["ranks"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; keys whose fingerprint differs have none."""
        unsigned = keys.astype(np.int64).view(np.uint64)
        number = self.table.number(unsigned)
        known = number >= 0
        known[known] = self.prints[number[known]] == fingerprints(unsigned[known])
        number = np.where(known, number, 0)
        if not len(self.rows):
            return number, np.zeros(len(keys), np.int64)
        return self.rows[number].astype(np.int64), np.where(known, self.counts[number], 0).astype(np.int64)

    def read(self, start: int, end: int) -> bytes:
        width = self.kind.itemsize
        return self.file.read_at((end - start) * width, start * width)

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class TokenStore:
    address: str
    manifest: DataFrame


@cache
def _encoder(path: str) -> WordEncoder:
    """One per worker and vocabulary."""
    return WordEncoder(path)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))


def write_tokens(
    docs: DataFrame, vocabulary: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS, address: str | None = None
) -> TokenStore:
    """Encodes ``docs (doc_id, text)`` and writes a store, by default below the shared folder.

    The texts are shuffled once, by ranges of id (and of the text's hash within an id, so that
    an id with very many rows is dealt over several tasks), and encoded where they are written.
    """
    address = address or scratch_folder(docs.sparkSession, "token-ids")
    types = {
        "partition": pa.int32(),
        "shard": pa.int32(),
        "path": pa.string(),
        "low": pa.int64(),
        "high": pa.int64(),
        "n_docs": pa.int64(),
        "n_ids": pa.int64(),
    }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(vocabulary)
        end = np.array([end_id], encoder.kind).tobytes()
        partition, shard, writer = TaskContext.get().partitionId(), 0, None

        def row() -> pa.RecordBatch:
            values = {"partition": partition, "shard": shard, **writer.close()}
            return record_batch({k: [v] for k, v in values.items()}, types)

        for batch in slices(batches, _ROWS):
            ids, bounds = encoder.encode_column(batch.column(1))
            for key, start, stop in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if writer is not None and writer.n_ids >= shard_ids:
                    yield row()
                    shard, writer = shard + 1, None
                if writer is None:
                    writer = ShardWriter(address, encoder.kind)
                writer.add(key, ids[start:stop].tobytes() + end)
        if writer is not None:
            yield row()

    rows = docs.select(_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", "order").sortWithinPartitions("key", "order").drop("order")
    return TokenStore(address, stored(dealt.mapInArrow(write, _MANIFEST), "manifest"))


def _shards(store: TokenStore) -> dict[str, np.ndarray]:
    """The manifest in order, with the ids before each shard; one row per shard of 128 MB or more."""
    order = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before")
    rows = store.manifest.select("path", "low", "high", before).orderBy("before", "low", "high").collect()
    return {
        "path": np.array([r.path for r in rows], object),
        "low": np.array([r.low for r in rows], np.int64),
        "high": np.array([r.high for r in rows], np.int64),
        "before": np.array([r.before for r in rows], np.int64),
    }


def _runs(shard: Shard, row: np.ndarray, n_rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of a shard that hold the rows of the keys, in runs of bounded size.

    A run ends where the next wanted row is not the next row, and after ``_RUN_IDS`` ids or ``_ROWS``
    rows; so each run is one read, and a key with very many rows takes several.
    """
    wanted = np.repeat(row - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
    starts, at = shard.starts.astype(np.int64), 0
    gaps = np.flatnonzero(np.diff(wanted) != 1) + 1
    while at < len(wanted):
        a = wanted[at]
        together = np.searchsorted(starts, starts[a] + _RUN_IDS, "right") - 1 - a
        gap = gaps[np.searchsorted(gaps, at, "right")] if len(gaps) and gaps[-1] > at else len(wanted)
        stop = min(at + max(1, int(together)), int(gap), at + _ROWS)
        yield int(a), int(a) + stop - at
        at = stop


def _run(
    shard: Shard, before: int, a: int, b: int, keys: np.ndarray, row: np.ndarray, n_rows: np.ndarray, use: Callable, types: dict
) -> dict[str, list]:
    """The columns of the rows from ``a`` to ``b`` of a shard, read at once."""
    starts = shard.starts[a : b + 1].astype(np.int64)
    ids = np.frombuffer(shard.read(int(starts[0]), int(starts[-1])), shard.kind)
    found = [use(ids[start:end]) for start, end in zip(starts[:-1] - starts[0], starts[1:] - starts[0], strict=True)]
    # Rows of a shard are in the order of their keys.
    own = np.flatnonzero(n_rows)
    owner = keys[own[np.searchsorted(row[own], np.arange(a, b), "right") - 1]].tolist()
    out = {
        "doc_id": [None if key == NULL_ID else key for key in owner],
        "start": (before + starts[:-1]).tolist(),
        "n_tokens": np.diff(starts).tolist(),
    }
    return out | {name: [f[name] for f in found] for name in types if name not in out}


def read_documents(
    store: TokenStore, keys: DataFrame, use: Callable[[np.ndarray], dict], schema: str, types: dict[str, pa.DataType]
) -> DataFrame:
    """Looks up ``keys (doc_id)`` and gives each stored document's ids to ``use``.

    ``(doc_id, start, n_tokens)`` and what ``use`` returns, one row per stored document of a
    key. Keys are dealt by ranges, so a task opens few shards, one after the other; keys in
    any order and keys that are not stored are allowed.
    """
    in_order = _shards(store)
    shards = keys.sparkSession.sparkContext.broadcast(in_order)
    address = store.address
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), **types}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, opened, number = shards.value, None, -1
        for batch in slices(batches, _ROWS):
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.searchsorted(known["high"], asked, "left")
            last = np.searchsorted(known["low"], asked, "right") - 1
            for at in np.unique(np.concatenate([first, last])):
                mine = asked[(first <= at) & (at <= last)]
                if not len(mine):
                    continue
                if at != number:
                    if opened is not None:
                        opened.close()
                    opened, number = Shard(address, known["path"][at]), at
                row, n_rows = opened.find(mine)
                for a, b in _runs(opened, row, n_rows):
                    yield record_batch(_run(opened, int(known["before"][at]), a, b, mine, row, n_rows, use, types), types)
        if opened is not None:
            opened.close()

    distinct = keys.select(_key().alias("key")).distinct()
    # Keys are small and what they point to is not, so their size must not decide on the tasks.
    dealt = distinct.repartitionByRange(max(1, len(in_order["path"])), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(look_up, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def checksum(ids: np.ndarray) -> dict:
    return {"ids_crc32": crc32(ids.astype("<u4").tobytes())}


def stored_checksums(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document of the keys, from the files."""
    return read_documents(store, keys, checksum, "ids_crc32 bigint", {"ids_crc32": pa.int64()})


def stored_ids(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every stored document of the keys, from the files."""
    return read_documents(
        store, keys, lambda ids: {"ids": ids.astype(np.int32)}, "ids array<int>", {"ids": pa.list_(pa.int32())}
    )
