"""Near duplicates: a Jaccard join on word shingles with Bayesian pruning of candidates.

Documents with the same shingles are one class, so copies are handled once. Classes that share
a band of MinHash values are candidates. Their sketches are compared some values at a
time, and a pair is dropped as soon as the posterior chance that its similarity reaches the
threshold, with an even prior, falls below ``TOLERANCE``; all other pairs are verified
on the shingles themselves. With 32 bands of 7 values a pair at the threshold of 0.8 is a
candidate with chance 0.9995, one at 0.85 with chance 0.999996.

No step writes all pairs of a group:

1. each class meets the first class of its bands, and is linked to one of those it resembles;
2. bands that now hold several components are looked through in blocks of bounded
   size, for pairs between different components only; of a block with more than a few
   pairs for each of its rows the rows are written instead, and its texts are compared
   where they are, which leaves the links that join what is connected;
3. the links inside a component are counted in blocks, one sum per class and block.

Tables of bands, pairs and texts are joined by shuffles; texts of classes without candidates are
not shuffled. A task holds one block of a band or component at a time.

Defined results: texts are compared by their words (A to Z lower-cased); a text of fewer words than
a shingle is one shingle; texts without words are in one class if they are equal, with null as
empty, and have no other links; rows that repeat are documents of their own in the counts; an
empty table gives an empty result; other columns are not read, and are kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aliasmith.llm.batches import record_batch, slices, utf8
from aliasmith.llm.graph import components
from aliasmith.llm.shingles import jaccard, mixed, multipliers, shingle_sets, signature
from aliasmith.session import stored

THRESHOLD = 0.8
BANDS = 32
ROWS = 7
SKETCH = 64
SKETCH_STEP = 16
TOLERANCE = 1e-6
SLOT_BITS = 22
# A block of a band, in classes; a block of a component, in classes and in bytes of text.
BAND_BLOCK = 512
LINK_BLOCK = 512
LINK_BYTES = 1 << 22
# Surviving pairs for each row of a block of a band above which the block is verified where it is.
DENSE = 2
_SMALL_BLOCK = 64
_TOGETHER = 1 << 15
_ROWS = 512


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def fewest_matches(step: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``step`` equal values at which a pair is kept.

    With an even prior and m matches the chance that the similarity is at least t is that
    of at most m successes in step + 1 draws of chance t.
    """
    total, n = 0.0, step + 1
    for m in range(n + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return n


def likely(one: np.ndarray, two: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs of sketches survive; each step looks at those the earlier steps kept."""
    alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for start in range(0, SKETCH, SKETCH_STEP):
        part = slice(start, start + SKETCH_STEP)
        matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= fewest_matches(start + SKETCH_STEP, threshold, tolerance)]
    kept = np.zeros(len(one), bool)
    kept[alive] = True
    return kept


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SKETCH)


def signed(docs: DataFrame) -> DataFrame:
    """``(doc_id, set_id, text_key, size, bands, sketch)`` per document."""
    types = {
        "doc_id": pa.int64(),
        "set_id": pa.string(),
        "text_key": pa.string(),
        "size": pa.int64(),
        "bands": pa.list_(pa.int64()),
        "sketch": pa.binary(),
    }
    factors = multipliers(BANDS * ROWS + SKETCH)
    weights = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    offsets = mixed(np.arange(1000, 1000 + BANDS, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            texts = utf8(batch.column(2))
            out: dict[str, list] = {name: [] for name in types}
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, shingle_sets(texts), strict=True)
            for doc_id, key, text, found in rows:
                out["doc_id"].append(doc_id)
                out["text_key"].append(key)
                out["size"].append(len(found))
                if not len(found):
                    out["set_id"].append("0" + md5(text).hexdigest())
                    out["bands"].append([])
                    out["sketch"].append(bytes(2 * SKETCH))
                    continue
                lowest = signature(found, factors)
                grouped = lowest[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                keys = mixed((grouped * weights).sum(axis=1, dtype=np.uint64) + offsets)
                out["set_id"].append("1" + md5(found.tobytes()).hexdigest())
                out["bands"].append(keys.view(np.int64))
                out["sketch"].append((lowest[BANDS * ROWS :] & 0xFFFF).astype("<u2").tobytes())
            yield record_batch(out, types)

    columns = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text")).alias("k"), F.col("text").cast("string"))
    schema = "doc_id bigint, set_id string, text_key string, size bigint, bands array<bigint>, sketch binary"
    return columns.mapInArrow(sign, schema)


def classes(signed_docs: DataFrame) -> DataFrame:
    """One row per set of shingles with a number of its own; copies are combined before they are shuffled."""
    found = signed_docs.groupBy("set_id").agg(
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("n_docs"),
        F.min("text_key").alias("text_key"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    return stored(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def _slots(keys: DataFrame) -> bytes:
    """A byte per slot; at most ``1 << SLOT_BITS`` numbers arrive here, whatever the table's size."""
    slot = F.crc32(F.col("text_key").cast("binary")).bitwiseAND((1 << SLOT_BITS) - 1).cast("int")
    taken = np.zeros(1 << SLOT_BITS, np.uint8)
    taken[keys.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()] = 1
    return taken.tobytes()


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)`` for ``nodes (node, text_key)``.

    A table of fixed size drops most other texts before the shuffle; the join drops the rest.
    """
    taken = docs.sparkSession.sparkContext.broadcast(_slots(nodes))
    slot = F.crc32(F.col("k").cast("binary")).bitwiseAND((1 << SLOT_BITS) - 1).cast("int")
    columns = docs.select(text_key(F.col("text")).alias("k"), F.col("text").cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(taken.value, np.uint8)
        for batch in batches:
            wanted = table[batch.column(2).to_numpy()] == 1
            yield batch.filter(pa.array(wanted)).select([0, 1])

    kept = columns.withColumn("slot", slot).mapInArrow(keep, "k string, text string")
    one_each = kept.groupBy("k").agg(F.first("text").alias("text"))
    return nodes.join(one_each, F.col("text_key") == F.col("k")).select("node", "text")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of ``pairs (a, b)`` whose Jaccard similarity, on all shingles, reaches the threshold."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = stored(texts_of(docs, nodes.select("node", "text_key").join(needed, "node")), "texts")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    types = {"a": pa.int64(), "b": pa.int64()}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            ours, theirs = shingle_sets(utf8(batch.column(2))), shingle_sets(utf8(batch.column(3)))
            found = [jaccard(x, y) >= threshold for x, y in zip(ours, theirs, strict=True)]
            columns = (np.array(batch.column(i).to_pylist(), np.int64)[found] for i in range(2))
            yield record_batch(dict(zip(types, columns, strict=True)), types)

    return stored(joined.mapInArrow(verify, "a bigint, b bigint"), "verified")


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sketches survive the comparison."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = likely(sketches(batch.column(2)), sketches(batch.column(3)))
                yield batch.select([0, 1]).filter(pa.array(kept))

    return joined.mapInArrow(prune, "a bigint, b bigint")


def _grouped(
    keys: list[str], use: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands rows that arrive sorted by ``keys`` to ``use``, whole groups at a time, some together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            last = tuple(c[-1] for c in columns)
            at = next(i for i in range(batch.num_rows) if tuple(c[i] for c in columns) == last)
            if held and at == 0 and tuple(held[-1].column(k)[-1].as_py() for k in keys) == last:
                held.append(batch)
                continue
            if at:
                held.append(batch.slice(0, at))
            if held:
                yield from use(pa.Table.from_batches(held))
            held = [batch.slice(at)]
        if held:
            yield from use(pa.Table.from_batches(held))

    return run


def _in_blocks(rows: DataFrame, blocks: Column, key: str) -> DataFrame:
    """Each row once per pair of blocks that its own block belongs to: ``one`` and ``two``, with ``own``."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = rows.withColumn("blocks", blocks.cast("bigint")).withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    pairs = spread.select(
        "*", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    ).drop("other", "blocks")
    return pairs.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "node")


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), len(columns[0]))


_CANDIDATES = "a bigint, b bigint, key bigint, one int, two int, own int, comp bigint"


def _band_candidates(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that survive pruning; of a block with many, its rows instead.

    A row of a pair has ``a`` and ``b``; a row of a dense block has ``a`` and the block. Either
    way a block gives a bounded number of rows for each of its own.
    """
    key, one, two, own, node, comp = (table.column(c).to_numpy() for c in ("key", "one", "two", "own", "node", "comp"))
    held = sketches(table.column("sketch").combine_chunks())
    bounds = _bounds(key, one, two)
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    dense: list[tuple[int, int]] = []
    waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    size = 0

    def differ(i: np.ndarray | int, j: np.ndarray, start: int) -> np.ndarray:
        wanted = comp[j] != comp[i]
        return wanted & (own[j] != own[i]) if one[start] != two[start] else wanted

    def compare() -> None:
        """Many small blocks at once."""
        nonlocal left, right
        i, j = np.concatenate([w[2] for w in waiting]), np.concatenate([w[3] for w in waiting])
        kept = likely(held[i], held[j])
        ends = np.cumsum([len(w[2]) for w in waiting])
        for (start, end, mine, _), stop in zip(waiting, ends, strict=True):
            mine = slice(stop - len(mine), stop)
            if kept[mine].sum() > DENSE * (end - start):
                dense.append((start, end))
                kept[mine] = False
        left, right = np.append(left, i[kept]), np.append(right, j[kept])
        waiting.clear()

    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - start <= _SMALL_BLOCK:
            i, j = np.triu_indices(end - start, 1)
            wanted = differ(i + start, j + start, start)
            if wanted.any():
                waiting.append((start, end, i[wanted] + start, j[wanted] + start))
                size += int(wanted.sum())
            if size > _TOGETHER:
                compare()
                size = 0
            continue
        found, n_found = [np.zeros((2, 0), np.int64)], 0
        for i in range(start, end - 1):
            others = np.arange(i + 1, end)
            others = others[differ(i, others, start)]
            others = others[likely(np.broadcast_to(held[i], (len(others), SKETCH)), held[others])]
            found.append(np.stack([np.full(len(others), i), others]))
            n_found += len(others)
            if n_found > DENSE * (end - start):
                dense.append((start, end))
                break
        else:
            pairs = np.concatenate(found, axis=1)
            left, right = np.append(left, pairs[0]), np.append(right, pairs[1])
    if waiting:
        compare()
    rows = np.concatenate([np.arange(*d) for d in dense]) if dense else np.zeros(0, np.int64)
    a, b = node[left], node[right]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    n_pairs, n_rows = len(pairs), len(rows)

    def column(in_pairs: np.ndarray | None, in_rows: np.ndarray | None, kind: pa.DataType) -> pa.Array:
        one_part = pa.nulls(n_pairs, kind) if in_pairs is None else pa.array(in_pairs, kind)
        two_part = pa.nulls(n_rows, kind) if in_rows is None else pa.array(in_rows, kind)
        return pa.concat_arrays([one_part, two_part])

    long, short = pa.int64(), pa.int32()
    yield pa.RecordBatch.from_arrays(
        [
            column(pairs[:, 0], node[rows], long),
            column(pairs[:, 1], None, long),
            column(None, key[rows], long),
            column(None, one[rows], short),
            column(None, two[rows], short),
            column(None, own[rows], short),
            column(None, comp[rows], long),
        ],
        ["a", "b", "key", "one", "two", "own", "comp"],
    )


class _Incidence:
    """Which of some sets hold which shingle, a bit each, to count common shingles of many pairs."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        self.bits = np.zeros((len(sets), -(-len(shingles) // 64)), np.uint64)
        np.bitwise_or.at(self.bits, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))

    def near(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``others`` reach the threshold with set ``i``."""
        found = np.zeros(len(others), bool)
        for start in range(0, len(others), 128):
            part = others[start : start + 128]
            common = np.bitwise_count(self.bits[i] & self.bits[part]).sum(axis=1, dtype=np.int64)
            union = self.sizes[i] + self.sizes[part] - common
            found[start : start + 128] = common >= threshold * union - 1e-9
        return found


def _dense_links(threshold: float) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Verified links of dense blocks: as many as join what is connected, at most one per row."""
    types = {"a": pa.int64(), "b": pa.int64()}

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, one, two, own, node, comp = (
            table.column(c).to_numpy() for c in ("key", "one", "two", "own", "a", "comp")
        )
        held = sketches(table.column("sketch").combine_chunks())
        texts = utf8(table.column("text").combine_chunks())
        bounds = _bounds(key, one, two)
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            sets = _Incidence(shingle_sets(texts[start:end]))
            label = np.unique(comp[start:end], return_inverse=True)[1]
            out: dict[str, list] = {"a": [], "b": []}
            for i in range(end - start - 1):
                others = np.arange(i + 1, end - start)
                wanted = label[others] != label[i]
                if one[start] != two[start]:
                    wanted &= own[start + others] != own[start + i]
                others = others[wanted]
                others = others[likely(np.broadcast_to(held[start + i], (len(others), SKETCH)), held[start + others])]
                others = others[sets.near(i, others, threshold)]
                joined, first = np.unique(label[others], return_index=True)
                out["a"] += [node[start + i]] * len(first)
                out["b"] += node[start + others[first]].tolist()
                label[np.isin(label, joined)] = label[i]
            yield record_batch(out, types)

    return links


def _link_sums(threshold: float) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    types = {"node": pa.int64(), "n_links": pa.int64()}

    def sums(table: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, one, two, own, node, n_docs = (
            table.column(c).to_numpy() for c in ("comp", "one", "two", "own", "node", "n_docs")
        )
        sets = shingle_sets(utf8(table.column("text").combine_chunks()))
        out_node, out_links = [], []
        starts = _bounds(comp, one, two)
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            found = np.zeros(end - start, np.int64)
            incidence = _Incidence(sets[start:end])
            for i in range(end - start - 1):
                others = np.arange(i + 1, end - start)
                if one[start] != two[start]:
                    others = others[own[start + others] != own[start + i]]
                others = others[incidence.near(i, others, threshold)]
                found[i] += n_docs[start + others].sum()
                found[others] += n_docs[start + i]
            out_node.append(node[start:end])
            out_links.append(found)
        yield record_batch({"node": np.concatenate(out_node), "n_links": np.concatenate(out_links)}, types)

    return sums


def _linked_in_blocks(rows: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified links of the dense blocks, whose texts are compared where the block is."""
    rows = rows.drop("b")
    needed = nodes.join(rows.select(F.col("a").alias("node")).distinct(), "node").select("node", "text_key", "sketch")
    texts = stored(texts_of(docs, needed), "texts")
    texts = texts.join(needed.select("node", "sketch"), "node").withColumnRenamed("node", "a")
    dealt = rows.join(texts, "a").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "a")
    return stored(dealt.mapInArrow(_grouped(["key", "one", "two"], _dense_links(threshold)), "a bigint, b bigint"), "verified")


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed documents, the classes, and ``(node, comp)`` of the classes that have links."""
    rows = stored(signed(docs), "signed")
    nodes = classes(rows)
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members"))
    members = stored(banded.join(shared.where(F.col("members") > 1), "key"), "bands")

    # 1. Every class and the first one of each of its bands; of those it resembles it keeps one.
    meets = members.where(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    first = _pruned(meets.distinct(), nodes).groupBy("a").agg(F.min("b").alias("b"))
    links = verified(stored(first, "pairs"), docs, nodes, threshold)
    known = components(links)

    # 2. Pairs of different components that share a band.
    labelled = members.join(known, "node", "left").select(
        "key", "node", "members", F.coalesce("comp", "node").alias("comp")
    )
    labelled = stored(labelled, "band-components")
    several = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_rows = labelled.join(several.where(F.col("low") != F.col("high")).select("key"), "key")
    open_rows = open_rows.join(nodes.select("node", "sketch"), "node")
    dealt = _in_blocks(open_rows, F.ceil(F.col("members") / BAND_BLOCK), "key")
    found = stored(dealt.mapInArrow(_grouped(["key", "one", "two"], _band_candidates), _CANDIDATES), "candidates")
    sparse = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
    more = verified(stored(sparse, "pairs"), docs, nodes, threshold)
    more = more.union(_linked_in_blocks(found.where(F.col("b").isNull()), docs, nodes, threshold))
    if not more.isEmpty():
        known = components(links.union(more))
    return rows, nodes, known


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_key, class_id, group_id, n_links)`` per document.

    ``class_id`` and ``group_id``: the smallest id among the documents with the same shingles, and
    among those connected by links. ``n_links``: how many other documents reach the threshold.
    """
    rows, nodes, known = linked(docs, threshold)
    labelled = nodes.join(known, "node", "left").select(
        "node", "set_id", "class_id", "n_docs", "text_key", F.coalesce("comp", "node").alias("comp")
    )
    labelled = stored(labelled, "labelled")
    whole = labelled.groupBy("comp").agg(
        F.min("class_id").alias("group_id"), F.count("*").alias("parts"), F.sum("n_docs").alias("in_group")
    )
    whole = stored(whole, "groups")
    # 3. Two classes of a component are linked; more are counted on their texts.
    larger = labelled.join(whole.where(F.col("parts") > 2), "comp")
    texts = texts_of(docs, larger.select("node", "text_key"))
    with_text = larger.select("comp", "node", "n_docs", "parts").join(texts, "node")
    volume = with_text.groupBy("comp").agg(F.sum(F.octet_length("text")).alias("volume"))
    blocks = F.greatest(F.ceil(F.col("parts") / LINK_BLOCK), F.ceil(F.col("volume") / LINK_BYTES))
    dealt = _in_blocks(with_text.join(volume, "comp"), blocks, "comp")
    counted = dealt.select("comp", "one", "two", "own", "node", "n_docs", "text").mapInArrow(
        _grouped(["comp", "one", "two"], _link_sums(threshold)), "node bigint, n_links bigint"
    )
    counted = counted.groupBy("node").agg(F.sum("n_links").alias("counted"))
    others = F.when(F.col("parts") == 2, F.col("in_group") - F.col("n_docs")).otherwise(F.coalesce("counted", F.lit(0)))
    per_class = labelled.join(whole, "comp").join(counted, "node", "left").select(
        "set_id", "class_id", "group_id", (F.col("n_docs") - 1 + others).alias("n_links")
    )
    return rows.select("doc_id", "text_key", "set_id").join(per_class, "set_id").select(
        "doc_id", "text_key", "class_id", "group_id", "n_links"
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group of linked documents: the first by id and text."""
    rows, nodes, known = linked(docs, threshold)
    groups = nodes.join(known, "node", "left").select("set_id", F.coalesce("comp", "node").alias("comp"))
    kept = rows.select("set_id", F.struct("doc_id", "text_key").alias("row")).join(groups, "set_id").groupBy("comp").agg(
        F.min("row").alias("row")
    )
    kept = stored(kept.select(F.col("row.doc_id").alias("_kept_id"), F.col("row.text_key").alias("_kept_text")), "kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = keyed.select("_row", F.col("_row.doc_id").alias("_id"), text_key(F.col("_row.text")).alias("_key"))
    joined = keyed.join(kept, (F.col("_key") == F.col("_kept_text")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    once = joined.dropDuplicates(["_key", "_id"])
    return once.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
