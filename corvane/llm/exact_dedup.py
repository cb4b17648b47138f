"""Exact deduplication with an extendible-hash index on shared files.

1. Keys, 64-bit hashes of the texts, are counted in each batch and go to the
   owner of their range (their leading bits). An owner keeps them in an
   extendible-hash index: a directory that doubles whenever a full bucket can't
   be told apart by the bits in use. Each owner's index is a file in the shared
   folder. No text moves in this step.
2. Texts whose key the index counts more than once are reduced to one of a kind
   in their own task, however many copies there are, and go to the key's owner.
   It reads its file, looks every key up, chains the texts under their entry of
   the index and compares their bytes.

Defined results:

* a null text is no copy of anything; empty texts are copies of each other;
* of equal texts the row with the least id stays (a null id comes last);
  rows that are equal in id too are told apart by their order alone;
* an empty table gives an empty result; other columns are passed through,
  whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import BROADCAST_BYTES, col, cut, fresh, partitions, shared_dir
from corvane.llm._vector import column, trim

CAPACITY = 256
#: The directory doubles so many times; keys that agree in all these bits share
#: a bucket, however full, and are told apart by bisection.
DEEPEST = 20
#: Texts a task holds before it passes them on; equal ones may then go twice.
HELD_BYTES = 64 << 20


class ExtendibleIndex:
    """Buckets of (key, count) reached through the leading bits of unsigned keys.

    ``shift`` bits at the top of the keys are the owner's and tell nothing. A
    bucket's keys are in order, each once.
    """

    def __init__(self, capacity: int = CAPACITY, shift: int = 0):
        self.capacity, self.shift, self.depth = capacity, shift, 0
        self.directory = np.zeros(1, np.int64)
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.depths = [0]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        return ((keys << np.uint64(self.shift)) >> np.uint64(64 - self.depth)).astype(np.int64)

    def _touched(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets that keys belong to, with the places of theirs."""
        to = self.directory[self.slot(keys)]
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for at in np.split(order, cuts) if len(order) else ():
            yield int(to[at[0]]), at

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count keys; a bucket that is too full afterwards is split."""
        for bucket, at in self._touched(keys):
            have, back = np.unique(np.concatenate([self.keys[bucket], keys[at]]), return_inverse=True)
            total = np.zeros(len(have), np.int64)
            np.add.at(total, back, np.concatenate([self.counts[bucket], counts[at]]))
            self.keys[bucket], self.counts[bucket] = have, total
            self._relieve(bucket)

    def _relieve(self, bucket: int) -> None:
        """Split an overfull bucket until its parts fit."""
        todo = [bucket]
        while todo:
            b = todo.pop()
            keys = self.keys[b]
            if len(keys) <= self.capacity or self.depths[b] == DEEPEST:
                continue
            if self.depths[b] == self.depth:
                self.directory, self.depth = np.repeat(self.directory, 2), self.depth + 1
            new, self.depths[b] = len(self.keys), self.depths[b] + 1
            slots = np.flatnonzero(self.directory == b)
            upper = slots[len(slots) // 2 :]
            self.directory[upper] = new
            right = self.slot(keys) >= upper[0]
            self.keys.append(keys[right])
            self.counts.append(self.counts[b][right])
            self.depths.append(self.depths[b])
            self.keys[b], self.counts[b] = keys[~right], self.counts[b][~right]
            todo += [b, new]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's entry (bucket << 32 | place), -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for bucket, at in self._touched(keys):
            have = self.keys[bucket]
            if len(have):
                place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
                out[at] = np.where(have[place] == keys[at], (bucket << 32) | place, -1)
        return out

    def repeated(self) -> np.ndarray:
        """Keys counted more than once."""
        return np.concatenate([k[n > 1] for k, n in zip(self.keys, self.counts, strict=True)])

    def table(self) -> pa.Table:
        size = np.array([len(k) for k in self.keys])
        meta = {b"depth": str(self.depth).encode(), b"shift": str(self.shift).encode(), b"directory": self.directory.astype("<i8").tobytes().hex().encode()}
        return pa.table({"bucket": np.repeat(np.arange(len(size)), size), "key": np.concatenate(self.keys), "count": np.concatenate(self.counts)}).replace_schema_metadata(meta)

    @classmethod
    def of(cls, table: pa.Table) -> ExtendibleIndex:
        meta = table.schema.metadata
        x = cls(shift=int(meta[b"shift"]))
        x.depth, x.directory = int(meta[b"depth"]), np.frombuffer(bytes.fromhex(meta[b"directory"].decode()), "<i8")
        bucket, n = table["bucket"].to_numpy(), int(x.directory.max()) + 1
        cuts = np.searchsorted(bucket, np.arange(n + 1))
        key, counts = table["key"].to_numpy(), table["count"].to_numpy()
        x.keys = [key[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        x.counts = [counts[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return x


def _write(folder: str, owner: int, index: ExtendibleIndex) -> None:
    """One file an owner; a repeated task replaces it by an equal one."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    name, part = f"{path}/owner-{owner:08d}.arrow", f"{path}/.{uuid.uuid4().hex}"
    table = index.table()
    with where.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_table(table)
    where.move(part, name)


def read_index(folder: str, owner: int) -> ExtendibleIndex | None:
    where, path = fs.FileSystem.from_uri(folder)
    name = f"{path}/owner-{owner:08d}.arrow"
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with where.open_input_file(name) as f:
        return ExtendibleIndex.of(pa.ipc.open_file(f).read_all())


def owner_bits(tasks: int) -> int:
    """Owners are four a task at least, so that their files stay small."""
    return min(24, max(2, math.ceil(math.log2(tasks)) + 2))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).view(np.uint64)


def index_keys(keys: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """Write the index of the column ``key`` and return the keys it counts more
    than once."""
    tasks = partitions(keys.sparkSession)
    bits = owner_bits(tasks)

    def counted(batches):
        for batch in batches:
            key, n = np.unique(_unsigned(batch, "key"), return_counts=True)
            yield pa.record_batch({"owner": pa.array((key >> np.uint64(64 - bits)).astype(np.int32)), "key": pa.array(key.view(np.int64)), "n": pa.array(n)})

    def build(batches):
        owner, index = None, None

        def done():
            _write(folder, owner, index)
            return pa.record_batch({"key": pa.array(index.repeated().view(np.int64))})

        for batch in batches:
            owners = column(batch, "owner").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if owners[a] != owner:
                        if index is not None:
                            yield done()
                        owner, index = int(owners[a]), ExtendibleIndex(capacity, bits)
                    index.add(_unsigned(batch, "key")[a:b], column(batch, "n").to_numpy()[a:b])
        if index is not None:
            yield done()
        trim()

    rows = keys.select("key").where("key is not null").mapInArrow(counted, "owner int, key long, n long")
    return cut(rows.repartition(tasks, "owner").sortWithinPartitions("owner").mapInArrow(build, "key long"))


class _Kinds:
    """Distinct texts under a number each; of each the best row and how many."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def put(self, number: int, text: bytes, rank: tuple, row, count: int) -> None:
        chain = self.chains.setdefault(number, [])
        for link in chain:
            if link[0] == text:
                link[3] += count
                if rank < link[1]:
                    link[1], link[2] = rank, row() if callable(row) else row
                return
        chain.append([text, rank, row() if callable(row) else row, count])
        self.bytes += len(text)


def _ranks(batch: pa.RecordBatch, ident: str) -> list[tuple]:
    return [(x is None, x or 0) for x in column(batch, ident).to_pylist()]


def _local(batches: Iterator[pa.RecordBatch], text: str, ident: str, key: str, count: str) -> Iterator[pa.RecordBatch]:
    """One row a text of those in this task, with the number of its copies."""
    kinds, schema = _Kinds(), None

    def flush():
        links = [x for chain in kinds.chains.values() for x in chain]
        kinds.chains, kinds.bytes = {}, 0
        for a in range(0, len(links), 256):
            some = links[a : a + 256]
            rows = pa.Table.from_batches([x[2] for x in some], schema).combine_chunks().to_batches()
            whole = rows[0] if rows else pa.RecordBatch.from_pylist([], schema)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([x[3] for x in some], pa.int64())], [*schema.names, count])

    for batch in batches:
        schema = batch.schema
        keys, texts, ranks = column(batch, key).to_pylist(), column(batch, text), _ranks(batch, ident)
        for i, k in enumerate(keys):
            kinds.put(k, texts[i].as_buffer().to_pybytes(), ranks[i], lambda i=i, b=batch: pa.RecordBatch.from_arrays([c.take(pa.array([i])) for c in b.columns], schema=b.schema), 1)
        if kinds.bytes > HELD_BYTES:
            yield from flush()
    yield from flush()
    trim()


def _owned(batches: Iterator[pa.RecordBatch], folder: str, text: str, ident: str, key: str, owner: str, count: str) -> Iterator[tuple[int, list[list]]]:
    """Each entry of the index that texts came to: its key and their chain."""
    now, index, kinds, name = None, None, _Kinds(), {}
    for batch in batches:
        keys, owners = _unsigned(batch, key), column(batch, owner).to_numpy()
        texts, ranks, counts = column(batch, text), _ranks(batch, ident), column(batch, count).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if owners[a] != now:
                yield from ((name[e], c) for e, c in kinds.chains.items())
                now, kinds, name = int(owners[a]), _Kinds(), {}
                index = read_index(folder, now)
            at = index.find(keys[a:b]) if index is not None else np.full(b - a, -1)
            if (at < 0).any():
                raise RuntimeError(f"the index file of owner {now} lacks a key that it was asked for")
            for i, e in zip(range(a, b), at.tolist(), strict=True):
                name[e] = int(keys[i].view(np.int64))
                kinds.put(e, texts[i].as_buffer().to_pybytes(), ranks[i], lambda i=i, x=batch: pa.RecordBatch.from_arrays([c.take(pa.array([i])) for c in x.columns], schema=x.schema), counts[i])
    yield from ((name[e], c) for e, c in kinds.chains.items())


def _is_small(repeated: DataFrame) -> bool:
    return repeated.count() * 16 <= BROADCAST_BYTES


def _to_owners(rows: DataFrame, repeated: DataFrame, small: bool, text: str, ident: str, key: str, owner: str, count: str) -> DataFrame:
    """Texts of repeated keys, one of a kind in each task, at their owners."""
    tasks = partitions(rows.sparkSession)
    some = rows.join(F.broadcast(repeated) if small else repeated, key, "left_semi").select(*rows.columns)
    kind = rows.withColumn(count, F.lit(1).cast("long")).schema
    local = some.mapInArrow(lambda batches: _local(batches, text, ident, key, count), kind)
    return local.withColumn(owner, F.shiftrightunsigned(F.col(key), 64 - owner_bits(tasks)).cast("int")).repartition(tasks, owner).sortWithinPartitions(owner)


def classes(rows: DataFrame, repeated: DataFrame, folder: str, small: bool = True) -> DataFrame:
    """key, text, keep_id and copies of each text of ``rows`` (key, text, id)
    that occurs more than once; the text is null where no other shares its key."""

    def run(batches):
        out = []
        for key, chain in _owned(batches, folder, "text", "id", "key", "owner", "n"):
            for text, (null, i), _, count in chain:
                if count > 1:
                    out.append((key, text.decode("utf-8", "surrogatepass") if len(chain) > 1 else None, None if null else i, count))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], ["key", "text", "keep_id", "copies"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], ["key", "text", "keep_id", "copies"])
        trim()

    return _to_owners(rows, repeated, small, "text", "id", "key", "owner", "n").mapInArrow(run, "key long, text string, keep_id long, copies long")


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64())


def _folder(docs: DataFrame, index_dir: str | None) -> str:
    return index_dir or f"{shared_dir(docs.sparkSession)}/exact-{uuid.uuid4().hex}"


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", capacity: int = CAPACITY, index_dir: str | None = None, key: Column | None = None) -> DataFrame:
    """For each row: its id, the id of the copy that stays, and the number of
    copies, itself included. ``key`` is another hash of the text (long)."""
    folder = _folder(docs, index_dir)
    own = text_key(col(docs, text)) if key is None else key
    rows = docs.select(F.when(col(docs, text).isNotNull(), own).alias("key"), col(docs, text).alias("text"), col(docs, ident).cast("long").alias("id"))
    repeated = index_keys(rows, folder, capacity)
    small = _is_small(repeated)
    found = cut(classes(rows, repeated, folder, small))
    few = found.count() * 32 <= BROADCAST_BYTES
    lone = found.where("text is null").drop("text")
    out = rows.join(F.broadcast(lone) if few else lone, "key", "left")
    chained = found.where("text is not null")
    if not chained.isEmpty():  # different texts share a key
        chained = chained.select(F.col("key").alias("k"), F.col("text").alias("t"), F.col("keep_id").alias("keep_2"), F.col("copies").alias("copies_2"))
        out = out.join(chained, (F.col("key") == F.col("k")) & (F.col("text") == F.col("t")), "left").withColumn("keep_id", F.coalesce("keep_id", "keep_2")).withColumn("copies", F.coalesce("copies", "copies_2"))
    return out.select(F.col("id").alias(ident), F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def drop_exact_copies(docs: DataFrame, text: str = "text", ident: str = "doc_id", capacity: int = CAPACITY, index_dir: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without later copies of a text. Each
    row is judged itself, so null or repeated ids lose nothing."""
    folder = _folder(docs, index_dir)
    width, names = len(docs.columns), [c.lower() for c in docs.columns]
    plain = docs.toDF(*[f"c{i}" for i in range(width)])  # any names go through
    own_text, own_ident = f"c{names.index(text.lower())}", f"c{names.index(ident.lower())}"
    keyed = plain.withColumn("key", F.when(F.col(own_text).isNotNull(), text_key(F.col(own_text))))
    repeated = index_keys(keyed.select("key"), folder, capacity)
    small = _is_small(repeated)

    def run(batches):
        for _, chain in _owned(batches, folder, own_text, own_ident, "key", "owner", "n"):
            for link in chain:
                yield pa.RecordBatch.from_arrays(link[2].columns[:width], schema=pa.schema(list(link[2].schema)[:width]))
        trim()

    alone = keyed.join(F.broadcast(repeated) if small else repeated, "key", "left_anti").select(*plain.columns)
    first = _to_owners(keyed, repeated, small, own_text, own_ident, "key", "owner", "n").mapInArrow(run, plain.schema)
    return alone.unionByName(first).toDF(*docs.columns)
