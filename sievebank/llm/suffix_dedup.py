"""Removal of repeated passages by suffix bucket refinement.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id.  Sorting all suffixes of a corpus would move each of them; instead:

1. *Anchors.*  Inside every string of ``LENGTH`` bytes the q-grams with the smallest hash are
   anchors, so two equal strings share an anchor at the same place.  Documents are packed
   into blocks of a few MB; each block sends the distinct hashes of its anchors' q-grams, and
   is told which of them occur in other documents.
2. *Windows.*  For such anchors a block sends the distinct windows around them: all bytes that
   a string of ``LENGTH`` bytes through the anchor can hold.  They carry the smallest id in the
   block.
3. *Bucket-pointer refinement.*  The windows of one anchor q-gram are suffixes in one initial
   bucket.  Where a bucket has more than one window, buckets of q-grams at all offsets are
   refined: a suffix's bucket becomes the pair of its own bucket and the bucket of the suffix
   h bytes later, so the order reached for one offset is reused for all others, and h doubles
   until it spans ``LENGTH``.  The smallest id in each final bucket answers for that string.
4. Each block gets the answers for its windows and cuts its texts.

What is sent for a passage is bounded by the number of blocks that hold it, not by its copies.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import NULL_ID, persist, persist_by, shuffle_partitions, text_or_empty

LENGTH = 50
#: Bytes of an anchor's q-gram; every string of LENGTH bytes holds SPAN of them.
Q = 26
SPAN = LENGTH - Q + 1
SIDE = LENGTH - Q
WINDOW = Q + 2 * SIDE
BLOCK_BYTES = 4 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    + [T.StructField("kept_sha256", T.StringType())]
)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; ``data`` ends in at least seven spare bytes."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def qgram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` bytes from each position on."""
    x = eights(data)
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, by in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (Q - 8, 0x27D4EB2F165667C5)):
        h ^= h >> np.uint64(29)
        h += x[at : at + n] * np.uint64(by)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` neighbours, by doubling."""
    done = 1
    out = x
    while 2 * done <= size:
        out = pick(out[:-done], out[done:])
        done *= 2
    if done < size:
        out = pick(out[: len(x) - size + 1], out[size - done :])
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the documents that lie in ``data`` side by side."""
    places, hashes = [], []
    step = 1 << 18  # pieces small enough for the processor's cache
    n = len(data)
    for lo in range(0, n, step):
        # q-grams that start in [lo, lo + step) and those around them that decide on them
        a, b = max(0, lo - SPAN), min(n, lo + step + SPAN + Q)
        h = qgram_hashes(np.concatenate([data[a:b], np.zeros(8, np.uint8)]))[: max(0, b - a - Q + 1)]
        if len(h) < 1:
            continue
        # q-grams that reach over a document's end belong to none
        k0, k1 = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        for e in ends[k0:k1].tolist():
            h[max(0, e - Q + 1 - a) : max(0, e - a)] = NONE
        padded = np.concatenate([np.full(SPAN - 1, NONE), h, np.full(SPAN - 1, NONE)])
        low = sliding(padded, SPAN, np.minimum)
        # a minimum of some window around it
        found = np.flatnonzero((sliding(np.where(low == NONE, np.uint64(0), low), SPAN, np.maximum) == h) & (h != NONE))
        found = found[(found + a >= lo) & (found + a < lo + step)]
        places.append(found + a)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


class Block:
    """Documents side by side."""

    def __init__(self, payload: bytes, sizes: list[int], ids: list[int]):
        raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, sum(sizes)))
        self.data = np.frombuffer(raw, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.ids = np.array(ids, np.int64)
        self.places, self.hashes = anchors(self.data, self.starts, self.ends)
        self.owner = np.searchsorted(self.ends, self.places, "right")

    def windows(self, k: np.ndarray) -> np.ndarray:
        """The windows around some anchors, zero beyond the document, with the bytes on either side that count."""
        at = self.places[k]
        left = np.minimum(at - self.starts[self.owner[k]], SIDE)
        right = np.minimum(self.ends[self.owner[k]] - at - Q, SIDE)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), self.data, np.zeros(SIDE, np.uint8)])
        out = np.empty((len(k), WINDOW + 2), np.uint8)
        out[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at]
        cell = np.arange(WINDOW)
        out[:, :WINDOW][(cell < (SIDE - left)[:, None]) | (cell >= (SIDE + Q + right)[:, None])] = 0
        out[:, WINDOW], out[:, WINDOW + 1] = left, right
        return out


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of bytes together, and the number of its group for each row of that order."""
    pad = -rows.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(np.uint64)
    order = np.lexsort(wide.T)
    wide = wide[order]
    new = np.ones(len(order), bool)
    new[1:] = (wide[1:] != wide[:-1]).any(axis=1)
    return order, np.cumsum(new) - 1


def refined(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For windows and each of their ``SPAN`` strings, the smallest id among equal strings at the same place.

    Strings that a document's end cuts short get ``NULL_ID``.
    """
    n = len(rows)
    data, left, right = rows[:, :WINDOW], rows[:, WINDOW].astype(np.int64), rows[:, WINDOW + 1].astype(np.int64)
    # initial buckets: the eight bytes from each offset on
    x = data.astype(np.uint64)
    x = x[:, :-1] | x[:, 1:] << np.uint64(8)
    x = x[:, :-2] | x[:, 2:] << np.uint64(16)
    x = x[:, :-4] | x[:, 4:] << np.uint64(32)
    bucket, h = np.unique(x, return_inverse=True)[1].reshape(x.shape), 8
    while h < LENGTH:
        by = min(h, LENGTH - h)
        width = WINDOW - (h + by) + 1
        key = bucket[:, :width].astype(np.int64) * (int(bucket.max()) + 1) + bucket[:, by : by + width]
        bucket, h = np.unique(key, return_inverse=True)[1].reshape(key.shape), h + by
    # strings start ``o`` bytes before the anchor at column SIDE - o; only the anchor's own place counts
    bucket = bucket[:, : SPAN].astype(np.int64) * SPAN + np.arange(SPAN)
    column = np.arange(SPAN)
    whole = (column >= (SIDE - left)[:, None]) & (column <= (right)[:, None])
    own = np.where(whole, ids[:, None], NULL_ID)
    keys, inverse = np.unique(bucket, return_inverse=True)
    least = np.full(len(keys), NULL_ID)
    np.minimum.at(least, inverse.ravel(), own.ravel())
    return np.where(whole, least[inverse.reshape(n, SPAN)], NULL_ID)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def short(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of hashes; the lower ones chose the bucket.

    Strings that share them are taken for shared at first, and told apart by their windows.
    """
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def long(data: bytes) -> np.ndarray:
    """What ``short`` kept, as numbers."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def blocks_of(docs: DataFrame, id_column: str, text_column: str, extra: list[str], most: int = BLOCK_BYTES) -> DataFrame:
    """Documents packed side by side into blocks, in a table in the shared folder."""
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("nulls", T.ArrayType(T.BooleanType())),
            T.StructField("rest", T.BinaryType()),
        ]
    )
    out = pa.schema(
        [("block", pa.string()), ("payload", pa.binary()), ("sizes", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), ("rest", pa.binary())]
    )
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.encode(text_or_empty(text_column), "UTF-8").alias("_bytes"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        ids, texts, rest, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            if extra:
                table = pa.Table.from_batches(rest)
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
            row = {
                "block": uuid.uuid4().hex,
                "payload": packer.compress(b"".join(texts)),
                "sizes": list(map(len, texts)),
                "ids": [NULL_ID if i is None else i for i in ids],
                "nulls": [i is None for i in ids],
                "rest": packer.compress(sink.getvalue().to_pybytes()),
            }
            return pa.RecordBatch.from_pylist([row], out)

        for batch in batches:
            own_ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for k, t in enumerate(own):
                if size and size + len(t) > most:
                    rest.append(batch.slice(at, k - at).select(range(2, 2 + len(extra))))
                    yield done()
                    ids, texts, rest, size, at = [], [], [], 0, k
                ids.append(own_ids[k])
                texts.append(t)
                size += len(t)
            rest.append(batch.slice(at).select(range(2, 2 + len(extra))))
        if ids:
            yield done()

    spark = docs.sparkSession
    # laid out by block, so that answers come to the texts and not the texts to the answers
    return persist_by(rows.mapInArrow(run, schema), "blocks", "block", max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))


def opened(row: dict) -> Block:
    return Block(row["payload"], row["sizes"], row["ids"])


def cut(docs: DataFrame, id_column: str, text_column: str, extra: list[str], finish, schema: T.StructType) -> DataFrame:
    """``finish(row of the block, block, covered)`` for each block, where ``covered`` marks the bytes to remove."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_column, text_column, extra, BLOCK_BYTES)
    plain = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(shuffle_partitions(spark), plain // (64 << 20))
    key = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("hashes", pa.binary()), ("many", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = opened(row)
                # distinct q-grams, and whether the block holds them in two documents
                order = np.lexsort((b.ids[b.owner], b.hashes))
                h, d = b.hashes[order], b.ids[b.owner[order]]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                many = np.zeros(len(h), bool)
                many[1:] = ~first[1:] & (d[1:] != d[:-1])
                at = np.flatnonzero(first)
                own, twice = h[at], np.logical_or.reduceat(many, at) if len(at) else many
                to = bucket_of(own, buckets)
                by = np.argsort(to, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], np.diff(to[by]) != 0])) if len(by) else by
                cuts = np.append(edge, len(by))
                if len(edge):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(to[by][edge], pa.int32()),
                            pa.array([row["block"]] * len(edge)),
                            pa.array([short(own[by[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                            pa.array([np.packbits(twice[by[i:j]]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        ],
                        schema=key,
                    )

    def shared(table: pa.Table) -> pa.Table:
        """Per block, the q-grams of this bucket that another document holds too."""
        raw = [long(x) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in raw])
        bits = zip(table.column("many").to_pylist(), size.tolist(), strict=True)
        h, twice = np.concatenate(raw), np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in bits])
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= s[1:] == s[:-1]
        dup = np.zeros(len(s), bool)
        dup[order] = same
        dup |= twice
        ends = np.cumsum(size)
        out = [short(h[e - n : e][dup[e - n : e]] << np.uint64(24)) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        keep = [k for k, x in enumerate(out) if x]
        return pa.table({"block": table.column("block").combine_chunks().take(pa.array(keep, pa.int64())), "hashes": pa.array([out[k] for k in keep], pa.binary())})

    asked = blocks.select("block", "payload", "sizes", "ids").mapInArrow(ask, "bucket int, block string, hashes binary, many binary")
    told = asked.groupBy("bucket").applyInArrow(shared, "block string, hashes binary")
    told = told.groupBy("block").agg(F.collect_list("hashes").alias("hashes"))

    sent = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("at", pa.binary()), ("windows", pa.binary()), ("ids", pa.binary())])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                b = opened(row)
                k, group, first, least = distinct_windows(b, long(b"".join(row["hashes"])))
                if not len(first):
                    continue
                rows, to = b.windows(k[first]), bucket_of(b.hashes[k[first]], buckets)
                for t in np.unique(to).tolist():
                    own = np.flatnonzero(to == t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x]) for x in (t, row["block"], *(packer.compress(x.tobytes()) for x in (own.astype("<i4"), rows[own], least[own])))], names=sent.names
                    ).cast(sent)

    def answer(table: pa.Table) -> pa.Table:
        """Per block, the smallest ids for the strings of its windows."""
        plain = zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([np.frombuffer(plain(x), np.uint8).reshape(-1, WINDOW + 2) for x in table.column("windows").to_pylist()])
        ids = np.concatenate([np.frombuffer(plain(x), np.int64) for x in table.column("ids").to_pylist()])
        order, group = grouped(rows)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.minimum.reduceat(ids[order], first)
        kinds = rows[order[first]]
        # a bucket with one window needs no refinement
        gram_order, gram = grouped(kinds[:, SIDE : SIDE + Q])
        count = np.bincount(gram)
        alone = np.empty(len(kinds), bool)
        alone[gram_order] = count[gram] == 1
        best = np.repeat(least[:, None], SPAN, 1)
        mixed = gram_order[count[gram] > 1]  # whole buckets, one after the other
        begin = 0
        while begin < len(mixed):
            stop = min(len(mixed), begin + 60_000)
            while stop < len(mixed) and (kinds[mixed[stop], SIDE : SIDE + Q] == kinds[mixed[stop - 1], SIDE : SIDE + Q]).all():
                stop += 1
            own = mixed[begin:stop]
            best[own] = refined(kinds[own], least[own])
            begin = stop
        of = np.empty(len(rows), np.int64)
        of[order] = group
        flat = (best == best[:, :1]).all(axis=1)
        packer = zstandard.ZstdCompressor(level=3)
        out_block, out_at, out_one, out_all = [], [], [], []
        done = 0
        for block, at in zip(table.column("block").to_pylist(), table.column("at").to_pylist(), strict=True):
            place = np.frombuffer(plain(at), "<i4")
            own = of[done : done + len(place)]
            done += len(place)
            one = flat[own]
            out_block.append(block)
            out_at.append(packer.compress(np.concatenate([place[one], place[~one]]).astype("<i4").tobytes()))
            out_one.append(packer.compress(best[own[one], 0].tobytes()))
            out_all.append(packer.compress(best[own[~one]].tobytes()))
        return pa.table({"block": out_block, "at": pa.array(out_at, pa.binary()), "one": pa.array(out_one, pa.binary()), "all": pa.array(out_all, pa.binary())})

    known = persist(told, "shared-grams")
    shown = blocks.select("block", "payload", "sizes", "ids").join(known, "block").select("payload", "sizes", "ids", "block", "hashes").mapInArrow(show, "bucket int, block string, at binary, windows binary, ids binary")
    answers = shown.groupBy("bucket").applyInArrow(answer, "block string, at binary, one binary, all binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("at", "one", "all")).alias("answers"))
    met = blocks.join(known, "block", "left").join(answers, "block", "left")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = opened(row)
                covered = np.zeros(len(b.data) + 1, np.int32)
                if row["answers"]:
                    k, group, first, _ = distinct_windows(b, long(b"".join(row["hashes"])))
                    best = np.full((len(first), SPAN), NULL_ID)
                    plain = zstandard.ZstdDecompressor().decompress
                    for a in row["answers"]:
                        at, one = np.frombuffer(plain(a["at"]), "<i4"), np.frombuffer(plain(a["one"]), np.int64)
                        best[at[: len(one)]] = one[:, None]
                        best[at[len(one) :]] = np.frombuffer(plain(a["all"]), np.int64).reshape(-1, SPAN)
                    own = b.ids[b.owner[k]]
                    item, column = np.nonzero(best[group] < own[:, None])
                    start = b.places[k[item]] - SIDE + column
                    fits = (start >= b.starts[b.owner[k[item]]]) & (start + LENGTH <= b.ends[b.owner[k[item]]])
                    np.add.at(covered, start[fits], 1)
                    np.add.at(covered, start[fits] + LENGTH, -1)
                yield finish(row, b, np.cumsum(covered)[:-1] > 0)

    return met.mapInArrow(close, schema)


def distinct_windows(b: Block, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of shared q-grams, each one's window's number, and of each window its first anchor (as an index of the former) and smallest id."""
    k = np.flatnonzero(np.isin(b.hashes >> np.uint64(24), shared))
    if not len(k):
        return k, k, k, k
    order, group = grouped(b.windows(k))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(b.ids[b.owner[k[order]]], first)
    of = np.empty(len(k), np.int64)
    of[order] = group
    return k, of, order[first], least


def each_document(row: dict, b: Block, covered: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """Of each document the remaining bytes, the number removed, and the number of removed runs."""
    for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
        gone = covered[s:e]
        n = int(gone.sum())
        if n:
            edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            yield b.data[s:e][~gone].tobytes(), n, edges
        else:
            yield b.data[s:e].tobytes(), 0, 0


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What is removed from each row's text, and a digest of what is left.

    A null text is empty.  Rows with equal ids do not remove each other's bytes; a null id
    counts as the largest.  Texts shorter than ``LENGTH`` bytes stay whole.  Other columns
    are left out; an empty table gives no rows.
    """

    def finish(row: dict, b: Block, covered: np.ndarray) -> pa.RecordBatch:
        out = [(s, n, k, hashlib.sha256(left).hexdigest()) for (left, n, k), s in zip(each_document(row, b, covered), row["sizes"], strict=True)]
        ids = [None if null else i for i, null in zip(row["ids"], row["nulls"], strict=True)]
        columns = [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
        return pa.RecordBatch.from_arrays(columns, RESULT.names)

    return cut(docs, id_column, text_column, [], finish, RESULT)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows with repeated bytes cut out of their texts, all columns kept.

    A character of which only some bytes are cut goes as a whole.  ``length_column``, if the
    table has it, becomes the new text's length.  A row that loses nothing is as it was.
    """
    columns = docs.columns
    extra = [c for c in columns if c != text_column]
    schema = docs.select(*extra, F.col(text_column)).schema
    null_at = "_null"
    marked = docs.withColumn(null_at, F.col(text_column).isNull())

    def finish(row: dict, b: Block, covered: np.ndarray) -> pa.RecordBatch:
        raw = zstandard.ZstdDecompressor().decompress(row["rest"])
        rest = pa.ipc.open_stream(raw).read_all().combine_chunks()
        nulls = rest.column(len(extra)).to_pylist()
        texts, lengths = [], []
        for left, _, _ in each_document(row, b, covered):
            texts.append(left.decode("utf-8", "ignore"))
            lengths.append(len(texts[-1]))
        arrays = [rest.column(k).combine_chunks() for k in range(len(extra))]
        if length_column in extra:
            k = extra.index(length_column)
            lost = np.add.reduceat(np.append(covered, 0).astype(np.int64), np.minimum(b.starts, len(covered))) * (b.sizes > 0)
            arrays[k] = pa.array([n if gone else old for n, gone, old in zip(lengths, lost.tolist(), arrays[k].to_pylist(), strict=True)], arrays[k].type)
        arrays.append(pa.array([None if null else t for t, null in zip(texts, nulls, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, [*extra, text_column])

    return cut(marked, id_column, text_column, [*extra, null_at], finish, schema).select(*columns)
