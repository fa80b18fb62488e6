"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that may be near share a key.  Inside a bucket of equal keys, members are held
vertically: for each bit position one machine word holds that bit of 64 members.  A query is
compared with 64 members at once: XOR each plane with the query's bit, and add the outcome to
bitwise counters with carry-save additions.  The counters start so that passing the radius
carries out of the top; a block whose 64 members have all passed it is abandoned.

Fingerprints of 64 bits that differ in at most three of them agree in three of six blocks of
bits, so the 20 choices of three blocks, of about 32 bits each, are keys that lose no pair.
At similarity 0.8 a seventh of all bits differs, and no band of bits is both long enough for
small buckets and short enough to be shared; there the keys of ``keep_one`` are minima of
the shingles' hashes, four at a time.  They and the SimHash of 512 bits only propose pairs,
which the sets of shingles decide.

Only spanning links leave a bucket, never all its pairs.  Buckets over ``TILE`` members are
cut into blocks, and pairs of blocks go to different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import NULL_ID, persist, shuffle_partitions, text_or_empty
from .components import connected

SEED = 42
TILE = 4096
#: (query, word) items compared at once.
ITEMS = 1 << 15
#: Pairs added to a spanning forest at once.
PAIRS = 1 << 19

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle, of none has none."""
    found = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(found) - words + 1
    digest = xxhash.xxh64_intdigest
    cut = zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return np.fromiter([digest(joined[i:j], SEED) for i, j in cut], np.uint64, n)


def majority(rows: np.ndarray) -> np.ndarray:
    """The words whose bits are set in over half of the rows (rows x words)."""
    n = len(rows)
    if not n:
        return np.zeros(rows.shape[1], np.uint64)
    # planes[k] holds, bitwise, the 2^k digit of the column counts; carry-save adders halve the rows
    planes, level = [], [rows]
    while level:
        carried = []
        pool = np.concatenate(level) if len(level) > 1 else level[0]
        while len(pool) > 1:
            third = len(pool) // 3
            if third:
                a, b, c = pool[:third], pool[third : 2 * third], pool[2 * third : 3 * third]
                u = a ^ b
                carried.append((a & b) | (u & c))
                pool = np.concatenate([u ^ c, pool[3 * third :]])
            else:
                a, b = pool[:1], pool[1:2]
                carried.append(a & b)
                pool = a ^ b
        planes.append(pool[0])
        level = carried
    # bitwise comparison of the counts with half of n
    half = n // 2
    more, same = np.zeros(rows.shape[1], np.uint64), np.full(rows.shape[1], ONES)
    for k in range(max(len(planes), half.bit_length()) - 1, -1, -1):
        digit = planes[k] if k < len(planes) else np.zeros(rows.shape[1], np.uint64)
        if half >> k & 1:
            same = same & digit
        else:
            more = more | (same & digit)
            same = same & ~digit
    return more


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit words for each hash; the first is the hash itself."""
    if words == 1:
        return hashes[:, None]
    odd = (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = hashes[:, None] * odd[None, :] + odd[None, :]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    x[:, 0] = hashes
    return x


def signatures(docs: DataFrame, shingle: int, words: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id`` and ``sig``, the SimHash of ``64 * words`` bits as longs, of each row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [majority(spread(shingle_hashes(t, shingle), words)) for t in batch.column(1).to_pylist()]
                flat = np.concatenate(found).view(np.int64)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), sig], ["doc_id", "sig"])

    return rows.mapInArrow(run, schema)


def near(sketch: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced comparison of queries with words of 64 members.

    ``sketch`` is members x words of bits; ``lanes`` is words x 64 member numbers, -1 for
    none; item ``k`` compares member ``query[k]`` with the members of ``lanes[word[k]]``.
    Returns the pairs (query, member) that are within the radius.
    """
    bits = 64 * sketch.shape[1]
    size = max(1, int(radius).bit_length())
    start = (1 << size) - 1 - radius
    # planes: bit x word
    safe = np.where(lanes >= 0, lanes, 0)
    shift = np.arange(64, dtype=np.uint64)
    planes = np.empty((bits, len(lanes)), np.uint64)
    for c in range(sketch.shape[1]):
        held = sketch[safe, c]
        for k in range(64):
            planes[64 * c + k] = np.bitwise_or.reduce(((held >> np.uint64(k)) & np.uint64(1)) << shift, axis=1)
    empty = np.bitwise_or.reduce(np.where(lanes < 0, np.uint64(1), np.uint64(0)) << shift, axis=1)
    over = empty[word]
    counters = [np.full(len(query), ONES if start >> k & 1 else np.uint64(0)) for k in range(size)]
    for k in range(bits):
        bit = np.uint64(0) - ((sketch[query, k // 64] >> np.uint64(k % 64)) & np.uint64(1))
        carry = planes[k][word] ^ bit
        for j in range(size):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if k % 8 == 7 and k > 2 * radius:
            live = over != ONES
            if not live.all():
                query, word, over = query[live], word[live], over[live]
                counters = [c[live] for c in counters]
                if not len(query):
                    break
    hit = np.flatnonzero(over != ONES)
    item, lane = np.nonzero((((~over[hit])[:, None] >> shift) & np.uint64(1)).astype(bool))
    item = hit[item]
    return query[item], lanes[word[item], lane]


def spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member that each of ``n`` members is linked to."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs ``a``, ``b`` that span the components of ``n`` members, near ones first (Boruvka's rounds)."""
    order = np.argsort(far, kind="stable")
    a, b, far = a[order], b[order], far[order]
    label, live, kept = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        take = np.unique(best[best < len(a)])
        kept.append(take)
        label = spanning(n, [(label[a[take]], label[b[take]])])[label]
    own = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[own], b[own], far[own]


def pairs_in(key: np.ndarray, block: np.ndarray, cross: np.ndarray, sketch: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of the pairs within the radius between members of equal key; all is sorted by key and block.

    Where ``cross`` holds, only members of different blocks are compared: the tile is one of
    two blocks of a large bucket.
    """
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    size = np.diff(np.append(first, len(key)))
    bucket_end = np.searchsorted(key, key[first], "right")
    lanes, words_of, queries_of = [], [], []
    # words of each run of one bucket and block, and the queries that meet them
    for f, s, e, x in zip(first.tolist(), size.tolist(), bucket_end.tolist(), cross[first].tolist(), strict=True):
        lo, hi = (f + s, e) if x else (f, f + s)
        if hi - lo < 1 or (not x and s < 2):
            continue
        for at in range(f, f + s, 64):
            own = np.arange(at, min(at + 64, f + s))
            # a member is only compared with those at or behind its own word
            met = np.arange(lo if x else at, hi)
            queries_of.append(met)
            words_of.append(np.full(len(met), len(lanes)))
            lanes.append(np.pad(own, (0, 64 - len(own)), constant_values=-1))
    at, n = 0, len(lanes)
    counts = np.cumsum([len(q) for q in queries_of])
    limit = max(64, (8 << 20) // (8 * sketch.shape[1] * 8))
    while at < n:  # as many words as their planes take a few MB
        to = min(n, at + limit, max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + 8 * ITEMS, "right"))))
        q, w = np.concatenate(queries_of[at:to]), np.concatenate(words_of[at:to]) - at
        held = np.array(lanes[at:to])
        for k in range(0, len(q), 2 * ITEMS):
            a, b = near(sketch, q[k : k + 2 * ITEMS], w[k : k + 2 * ITEMS], held, radius)
            off = a != b
            yield a[off], b[off]
        at = to


def links_in(ids: np.ndarray, key: np.ndarray, block: np.ndarray, cross: np.ndarray, sketch: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between members of equal key."""
    order = np.lexsort((block, key))
    ids = ids[order]
    label = spanning(len(ids), list(pairs_in(key[order], block[order], cross[order], sketch[order], radius)))
    own = np.flatnonzero(label != np.arange(len(label)))
    return ids[own], ids[label[own]]


def candidates_in(ids: np.ndarray, key: np.ndarray, block: np.ndarray, cross: np.ndarray, sketch: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that span the components, near ones first; the smaller id stands first."""
    order = np.lexsort((block, key))
    ids, sketch = ids[order], sketch[order]
    a = b = far = np.zeros(0, np.int64)
    for all_x, all_y in pairs_in(key[order], block[order], cross[order], sketch, radius):
        for k in range(0, len(all_x), PAIRS):  # a large group has millions of pairs
            x, y = all_x[k : k + PAIRS], all_y[k : k + PAIRS]
            far = np.concatenate([far, distance(sketch, x, y)])
            a, b, far = forest(len(ids), np.concatenate([a, x]), np.concatenate([b, y]), far)
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])


def distance(sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for c in range(sketch.shape[1]):
        out += np.bitwise_count(sketch[x, c] ^ sketch[y, c])
    return out


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def joins_in(ids: np.ndarray, part: np.ndarray, sets: list[np.ndarray], key: np.ndarray, block: np.ndarray, cross: np.ndarray, sketch: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Alike pairs that join different parts; every pair within the radius is decided, near ones first, unless its parts have met."""
    order = np.lexsort((block, key))
    ids, sketch = ids[order], sketch[order]
    label = np.unique(part[order], return_inverse=True)[1].tolist()
    parent, size_u, size_v = list(range(max(label, default=-1) + 1)), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for all_x, all_y in pairs_in(key[order], block[order], cross[order], sketch, radius):
        for k in range(0, len(all_x), PAIRS):
            x, y = all_x[k : k + PAIRS], all_y[k : k + PAIRS]
            near_first = np.argsort(distance(sketch, x, y), kind="stable")
            for i, j in zip(x[near_first].tolist(), y[near_first].tolist(), strict=True):
                p, q = root(label[i]), root(label[j])
                if p != q and alike(sets[order[i]], sets[order[j]], similarity):
                    parent[max(p, q)] = min(p, q)
                    size_u.append(i)
                    size_v.append(j)
    u, v = ids[np.array(size_u, np.int64)], ids[np.array(size_v, np.int64)]
    return np.minimum(u, v), np.maximum(u, v)


def tiles_of(items: DataFrame, *more: str) -> DataFrame:
    """The items (``node``, ``sketch``, ``keys``) once for each key and tile that they are compared in, with a group ``g`` of tiles."""
    spark = items.sparkSession
    rows = items.select("node", *more, "sketch", F.explode("keys").alias("key"))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    sizes = items.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    # a table of its own, so that Spark knows its size: a small one spares dealing out the rows
    large = persist(sizes.select(F.col("key").alias("of"), "n", blocks.alias("blocks")), "large-buckets")
    total = items.agg(F.sum(F.size("keys"))).first()[0] or 0
    total += large.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0] or 0
    met = rows.join(large.drop("n"), F.col("key") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = met.select("node", *more, "sketch", "key", "block", other).withColumn("cross", F.col("other") != F.col("block"))
    tile = F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    groups = max(shuffle_partitions(spark), total // 50_000)
    tiles = tiles.withColumn("tile", F.xxhash64("key", tile)).withColumn("g", F.pmod(F.col("tile"), F.lit(groups)))
    return tiles.select("g", "node", "tile", "block", "cross", "sketch", *more)


def columns_of(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as arrays, and the sketches as a matrix."""
    get = [table.column(n).combine_chunks() for n in (*names, "sketch")]
    sketch = get.pop().flatten().to_numpy().view(np.uint64)
    return [x.to_numpy(zero_copy_only=False) for x in get] + [sketch.reshape(table.num_rows, -1)]


def pairs_table(u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def component_roots(items: DataFrame, radius: int) -> DataFrame:
    """``node`` and ``root`` for the items (``node`` long, ``sketch`` longs, ``keys`` longs) linked to another."""

    def compare(table: pa.Table) -> pa.Table:
        return pairs_table(*links_in(*columns_of(table, "node", "tile", "block", "cross"), radius))

    return connected(tiles_of(items).groupBy("g").applyInArrow(compare, "u long, v long"))


def candidates(items: DataFrame, radius: int) -> DataFrame:
    """Distinct pairs ``u`` < ``v`` of items that ``candidates_in`` finds in the tiles."""

    def compare(table: pa.Table) -> pa.Table:
        return pairs_table(*candidates_in(*columns_of(table, "node", "tile", "block", "cross"), radius))

    return tiles_of(items).groupBy("g").applyInArrow(compare, "u long, v long").distinct()


def joins(items: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Distinct pairs ``u`` < ``v`` of alike items (with ``part`` and ``set``) that join different parts."""

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        node, part, *rest = columns_of(table, "node", "part", "tile", "block", "cross")
        return pairs_table(*joins_in(node, part, sets, *rest, radius, similarity))

    return tiles_of(items, "part", "set").groupBy("g").applyInArrow(compare, "u long, v long").distinct()


def block_keys(fp: str, radius: int) -> Column:
    """Keys of which fingerprints within the radius share one: ``radius`` of twice as many blocks of bits."""
    edges = [64 * k // (2 * radius) for k in range(2 * radius + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, radius)]
    return F.array(*[F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(chosen)])


def fingerprints_linked(docs: DataFrame, shingle: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """64-bit fingerprints, and the components of documents whose fingerprints differ in few bits.

    A null or empty text has the fingerprint zero and is linked like any other.  Equal
    fingerprints are compared once.  A component is named by its smallest id; null ids are
    passed over in that, and a component of null ids alone has a null name.  Repeated rows
    each get a row, other columns are left out, an empty table gives no rows.
    """
    rows = persist(signatures(docs, shingle, 1, id_column, text_column).select("doc_id", F.col("sig")[0].alias("fp")), "fingerprints")
    nodes = persist(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    keys = block_keys("fp", radius) if radius else F.array("fp")
    roots = component_roots(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("sketch"), keys.alias("keys")), radius)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = persist(named, "named")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that both sides of the join are dealt anew and a hot fingerprint can be split
    known = persist(named.join(names, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    return rows.join(known, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Keys of ``keep_one``, each of so many minima, and the words of its SimHash.
KEYS, MINIMA, SKETCH_WORDS = 12, 4, 8
_FACTORS = (np.arange(1, KEYS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minimum_keys(own: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: two sets of similarity s share one of them with a chance of 1 - (1 - s^4)^12."""
    least = np.full(KEYS * MINIMA, ONES)
    for k in range(0, len(own), 4096):
        x = own[k : k + 4096, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=0))
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for column in least.reshape(KEYS, MINIMA).T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def radius_for(similarity: float, bits: int) -> int:
    """Bits in which SimHashes of sets of this Jaccard similarity and like size are expected to differ, and three deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


ADDED = [("key", T.BinaryType()), ("sketch", T.ArrayType(T.LongType())), ("keys", T.ArrayType(T.LongType()))]


def longs(rows: list[np.ndarray], size: int) -> pa.Array:
    """Lists of ``size`` longs each; none for None."""
    flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
    edges = np.concatenate([[0], np.cumsum([0 if x is None else size for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat), mask=pa.array([x is None for x in rows], pa.bool_()))


def shingle_sets(docs: DataFrame, shingle: int, text: int) -> DataFrame:
    """The columns of ``docs``, and of the set of shingles of column number ``text`` a digest ``key``, the SimHash ``sketch`` and the search ``keys``.

    A text without a word has none of the three.
    """
    schema = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, sketch, keys = [], [], []
            for t in batch.column(text).to_pylist():
                own = np.unique(shingle_hashes(t or "", shingle))
                some = len(own) > 0
                digest.append(xxhash.xxh3_128_digest(own.tobytes(), SEED) if some else None)
                sketch.append(majority(spread(own, SKETCH_WORDS)) if some else None)
                keys.append(minimum_keys(own) if some else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.binary()), longs(sketch, SKETCH_WORDS), longs(keys, KEYS)], schema.names)

    return docs.mapInArrow(run, schema)


def with_sets(items: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The items with their sets of shingles as sorted hashes side by side in ``set``."""
    met = items.hint("merge").join(texts, "node")
    at = met.columns.index("text")
    names = [c for c in met.columns if c != "text"]
    schema = T.StructType([*(f for f in met.schema.fields if f.name != "text"), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], schema.names)

    return met.mapInArrow(run, schema)


def decided(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs with ``alike``: whether the Jaccard similarity of the sets of shingles is at least ``similarity``."""
    ends = pairs.select(F.col("u").alias("end")).union(pairs.select("v")).distinct()
    # tables, so that a member of many pairs can be split in the joins
    own = persist(texts.join(ends.hint("merge"), F.col("node") == F.col("end"), "left_semi").select("node", "text"), "pair-texts")
    met = pairs.hint("merge").join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").hint("merge").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(k).to_pylist() for k in (0, 1))
            good, held = [], {}
            for i, j, a, b in zip(u, v, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if len(held) > 256:
                    held.clear()
                for node, text in ((i, a), (j, b)):
                    if node not in held:
                        held[node] = np.unique(shingle_hashes(text, shingle))
                good.append(alike(held[i], held[j], similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["u", "v", "alike"])

    return met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, alike boolean")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays.

    Two documents are linked if the Jaccard similarity of their sets of shingles of
    ``shingle`` words, compared shingle by shingle, is at least ``similarity``; groups are the
    components of these links.  Search keys and SimHashes only propose pairs: a key is shared
    with a chance of 0.998 at similarity 0.8 and of almost 1 at 0.9, and the radius of the
    512 bits lies three deviations above what 0.8 is expected to differ in.

    First only near pairs that span the proposed components are decided.  Where that leaves a
    component in several parts, all proposed pairs between its parts are decided where they
    were found, until their parts have met, so no link that would join them is passed over.

    Joins with texts are merged whatever the sizes, so that small inputs run as large ones do.

    Each row is judged by itself: of rows with equal or null ids and unlike texts all stay, a
    null id comes last, and of rows with the same text and id one stays.  Documents without a
    word are left as they are: they have no shingles to be alike in.  All columns are
    returned; an empty table gives no rows.
    """
    radius, columns = radius_for(similarity, 64 * SKETCH_WORDS), docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    text, doc = f"c{columns.index(text_column)}", F.coalesce(F.col(f"c{columns.index(id_column)}").cast("long"), F.lit(NULL_ID))
    # numbers given once, in a table: one row stands for all of an equal set
    rows = persist(shingle_sets(plain, shingle, columns.index(text_column)).withColumn("node", F.monotonically_increasing_id()), "signatures")
    sets = rows.filter("key IS NOT NULL").select("key", F.struct(doc.alias("doc"), "node").alias("row"), "sketch", "keys")
    nodes = sets.groupBy("key").agg(F.min("row").alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys"))
    nodes = persist(nodes.select(F.col("first.node").alias("node"), "first", "sketch", "keys"), "distinct")
    items, texts = nodes.select("node", "sketch", "keys"), rows.select("node", F.coalesce(text, F.lit("")).alias("text"))
    links = persist(decided(persist(candidates(items, radius), "candidates"), texts, shingle, similarity), "decided")
    good = links.filter("alike").select("u", "v")
    failed = links.filter("NOT alike").select("u", "v")
    if not failed.isEmpty():
        parts = connected(good)
        ends = failed.join(parts.select(F.col("node").alias("u"), F.col("root").alias("pu")), "u", "left").join(parts.select(F.col("node").alias("v"), F.col("root").alias("pv")), "v", "left")
        ends = ends.select(F.coalesce("pu", "u").alias("pu"), F.coalesce("pv", "v").alias("pv")).filter("pu <> pv")
        # every part of a component that fell apart lies at a failed pair
        open_parts = persist(ends.select(F.col("pu").alias("open")).union(ends.select("pv")).distinct(), "open-parts")
        rest = items.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).join(open_parts, F.col("part") == F.col("open"), "left_semi").select("node", "part", "sketch", "keys")
        good = good.union(persist(joins(persist(with_sets(rest, texts, shingle), "open"), radius, similarity), "joins"))
    roots = nodes.select("node", "first").join(connected(good), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stay = persist(roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.node").alias("stays")), "staying")
    wordless = rows.filter("key IS NULL")
    kept = rows.filter("key IS NOT NULL").join(stay.hint("merge"), F.col("node") == F.col("stays"), "left_semi").unionByName(wordless)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
