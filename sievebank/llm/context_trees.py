"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the bytes before it,
``DEPTH`` deep.  Every node holds a Krichevsky-Trofimov estimate from the training documents'
counts, and weighs it against the product of its children's.  The model's probability of a
bit mixes the estimates along its context by those weights; a node that training never
reached adds nothing, so the mixture ends at the deepest one reached.  A text's probability
is the product over its bytes and its end.

The probability of a byte depends on the ``DEPTH`` bytes before it alone, so documents are
packed into blocks, and each block asks once for every distinct string of ``DEPTH + 1`` bytes
in it.  Counts are gathered by the nearest two context bytes, or by more of them where a
context is hot, so a task holds whole subtrees.  The few nodes nearer to the root are summed
up on the driver.  Logarithms come back in fixed point, at most 2^-25 off for each byte.

The base score, of single words with one added to each count, comes from the same blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import each_row, pack, persist, persist_by, shuffle_partitions, unpack
from .suffix_dedup import blocks_of

DEPTH = 7
#: Nearest bytes that choose a string's task: the least, and the most where contexts are hot.
ROOTS = (2, 6)
#: Blocks looked at for hot contexts, and the fixed point of logarithms on their way back.
SAMPLED, FIXED = 4, 1 << 24
FOLDS, HELD_OUT = 7, 2
BLOCK = 8 << 20
BEFORE, END = 0xFF, 0xFE  # in no UTF-8 text
#: A base token that no text can hold.
END_TOKEN = b"\xfe"
HALF = math.log(0.5)

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ]
)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


#: Logarithms of the gamma function at k + 1/2 and k + 1 for small k.
SMALL = 1 << 16
_HALVES = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(np.arange(SMALL - 1) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(SMALL - 1) + 1.0))])


def stirling(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for numbers from 8 on."""
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_gamma(k: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function at ``k + add`` for counts ``k``, whose small values ``table`` holds."""
    out = table[np.minimum(k, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(k >= SMALL)
    out[large] = stirling(k[large] + add)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a, 0.5, _HALVES) + log_gamma(b, 0.5, _HALVES) - math.log(math.pi) - log_gamma(a + b, 1.0, _WHOLES)


def weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted probability, and the logarithm of its own estimate's weight in it."""
    own, other = HALF + log_kt(a, b), HALF + below
    both = np.maximum(own, other) + np.log(1 + np.exp(-np.abs(own - other)))
    return both, own - both


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the place among them of each number of ``x``."""
    order = np.argsort(x)
    held = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return held[new], of


class Tree:
    """The nodes below contexts of ``top`` bytes for sorted strings ``key``: contexts, nearest byte first, then the byte.

    Each level is the sorted table of its (context, byte) pairs, made once for all eight
    decisions; the nodes of one decision are runs of that table.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, top: int, depth: int):
        self.top, self.depth = top, depth
        self.pairs, self.counts, self.up = {depth: key}, {depth: count.astype(float)}, {}
        for d in range(depth - 1, top - 1, -1):
            # drop the farthest context byte, which stands above the byte
            self.pairs[d], self.up[d + 1] = numbered(parent(self.pairs[d + 1]))
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.pairs[d]))

    def decide(self, bit: int) -> dict[int, tuple]:
        """Of each level's nodes the first pairs, counts, logs, weights and parents' places, and the node of each pair."""
        levels, child = {}, None
        for d in range(self.depth, self.top - 1, -1):
            pair, count = self.pairs[d], self.counts[d]
            node = pair >> np.uint64(8 - bit)
            new = np.ones(len(pair), bool)
            np.not_equal(node[1:], node[:-1], out=new[1:])
            first, of = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            b = np.add.reduceat(count * ((pair >> np.uint64(7 - bit)) & np.uint64(1)), first)
            a = np.add.reduceat(count, first) - b
            if child is None:
                log, weight = log_kt(a, b), np.zeros(len(first))
            else:
                up = of[self.up[d + 1][levels[child][0]]]
                levels[child] = (*levels[child][:-1], up)
                log, weight = weighted(a, b, np.bincount(up, levels[child][3], len(first)))
            levels[d], child = (first, a, b, log, weight, of, None), d
        return levels

    def nodes(self, level: tuple, bit: int) -> np.ndarray:
        """Names of the top level's nodes: the context above the decided bits behind a leading one."""
        pair = self.pairs[self.top][level[0]]
        return (pair >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << bit) | (pair & np.uint64(0xFF)) >> np.uint64(8 - bit)

    def chances(self, bit: int, levels: dict[int, tuple], sums: np.ndarray, rest: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Probability of each string's bit, given the mixtures that reach the top level's nodes from above."""
        for d in range(self.top, self.depth + 1):
            _, a, b, _, weight, of, up = levels[d]
            if d > self.top:
                sums, rest, final = sums[up], rest[up], final[up]
            sums, rest, final = mixed(a, b, np.exp(weight), sums, rest, final)
        one = (self.pairs[self.depth] >> np.uint64(7 - bit)) & np.uint64(1)
        p = final[of]
        return np.where(one == 1, p, 1 - p)


def parent(node: np.ndarray) -> np.ndarray:
    """The node, or pair, with one context byte less."""
    return (node >> np.uint64(16)) << np.uint64(8) | (node & np.uint64(0xFF))


def mixed(a: np.ndarray, b: np.ndarray, weight: np.ndarray, sums: np.ndarray, rest: np.ndarray, final: np.ndarray) -> tuple:
    """One level further down: the share decided, the share left, and the chance of a one if it ends here."""
    seen = a + b > 0
    own = (b + 0.5) / (a + b + 1.0)
    end = np.where(seen, sums + rest * own, final)
    return np.where(seen, sums + rest * weight * own, final), np.where(seen, rest * (1 - weight), 0.0), end


class Strings:
    """The strings of ``depth + 1`` bytes that end at each byte and at the end of each document.

    They are made in portions by their nearest byte, so that portions follow each other in
    the strings' order and a block takes little more memory than a portion.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int):
        n = len(sizes)
        ends = np.cumsum(sizes)
        self.depth = depth
        #: Each document has ``depth`` bytes before it and one behind it.
        self.bytes = np.full(len(data) + n * (depth + 1), BEFORE, np.uint8)
        self.wanted = np.zeros(len(self.bytes), bool)
        self.begin = ends - sizes + np.arange(n) * (depth + 1) + depth
        self.sizes = sizes
        for i, j, size in zip(self.begin.tolist(), (ends - sizes).tolist(), sizes.tolist(), strict=True):
            self.bytes[i : i + size] = data[j : j + size]
            self.bytes[i + size] = END
            self.wanted[i : i + size + 1] = True

    def portions(self, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``bytes`` and the keys there, nearest context byte first and the byte last, of about ``most`` strings."""
        before = np.empty_like(self.bytes)
        before[0], before[1:] = BEFORE, self.bytes[:-1]
        upto = np.cumsum(np.bincount(before[self.wanted], minlength=256))
        n = len(self.bytes) - self.depth
        ahead = np.concatenate([np.full(7 - self.depth, BEFORE, np.uint8), self.bytes, np.zeros(16, np.uint8)])
        whole = np.empty(n, np.uint64)  # the eight bytes up to each place, the last one on top
        for k in range(8):
            whole[k::8] = ahead[k : k + n // 8 * 8 + 8].view("<u8")[: len(whole[k::8])]
        last = whole >> np.uint64(56)
        whole <<= np.uint64(8)
        whole >>= np.uint64(64 - 8 * self.depth)
        whole <<= np.uint64(8)
        whole |= last
        del ahead, last
        low = 0
        while low < 256:
            done = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, done + most, "right")))
            at = np.flatnonzero(self.wanted & (before >= low) & (before <= high - 1))
            if len(at):
                yield at, whole[at - self.depth]
            low = high

    def distinct(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and how often each stands in the documents marked in ``train``."""
        marks = np.zeros(len(self.bytes), bool)
        for i, size, is_train in zip(self.begin.tolist(), self.sizes.tolist(), train.tolist(), strict=True):
            marks[i : i + size + 1] = is_train
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, key in self.portions():
            own = marks[at]
            learned, count = counted(key[own])
            other = counted(key[~own])[0]
            to = np.searchsorted(learned, other)
            new = learned[np.minimum(to, len(learned) - 1)] != other if len(learned) else np.ones(len(other), bool)
            keys.append(np.insert(learned, to[new], other[new]))
            counts.append(np.insert(count, to[new], 0))
        return np.concatenate(keys), np.concatenate(counts)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The values of each document's strings, added up; ``value`` follows the distinct keys."""
        out, base = np.zeros(len(self.bytes), value.dtype), 0
        for at, key in self.portions():
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            rank = np.cumsum(new, dtype=np.int32)
            out[at[order]] = value[base + rank - 1]
            base += int(rank[-1])
        return np.add.reduceat(out, self.begin, dtype=np.uint64) if len(self.begin) else np.zeros(0, np.uint64)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each stands there; the numbers end up sorted."""
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return key[first], np.diff(np.append(first, len(key)))


def nearest(key: np.ndarray, depth: int, n: int) -> np.ndarray:
    """The ``n`` nearest context bytes of strings."""
    return key >> np.uint64(8 * (depth + 1 - n))


def among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def roots_of(key: np.ndarray, depth: int, hot: dict[int, np.ndarray]) -> np.ndarray:
    """How many nearest bytes choose a string's task: two, and one more each time those are a hot context."""
    out = np.full(len(key), ROOTS[0], np.int8)
    for n in range(ROOTS[0], min(ROOTS[1], depth)):
        at = np.flatnonzero(out == n)
        out[at[among(nearest(key[at], depth, n), hot[n])]] = n + 1
    return out


def group_of(key: np.ndarray, depth: int, hot: dict[int, np.ndarray], groups: int) -> np.ndarray:
    """The task of each string: all with the same nearest bytes, as many as ``roots_of`` says, meet."""
    roots = roots_of(key, depth, hot)
    near = key >> (8 * (depth + 1 - roots)).astype(np.uint64)
    mixed_ = (near * np.uint64(8) + roots.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed_ >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def slices(key: np.ndarray, depth: int, hot: dict[int, np.ndarray], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """The strings of whole subtrees, some at a time: the bytes of their roots, and their places in ``key``."""
    roots = roots_of(key, depth, hot)
    for top in np.unique(roots).tolist():
        own = np.flatnonzero(roots == top)
        near = nearest(key[own], depth, top)
        edges = np.append(np.flatnonzero(np.diff(near)) + 1, len(own))
        at = 0
        while at < len(own):
            to = int(edges[min(np.searchsorted(edges, at + most), len(edges) - 1)])
            yield top, own[at:to]
            at = to


class Texts:
    """A block's documents."""

    def __init__(self, row: dict):
        self.raw = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=max(1, sum(row["sizes"])))
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ids = [None if null else i for i, null in zip(row["ids"], row["nulls"], strict=True)]
        self.held = np.array([is_held_out(i) for i in self.ids], bool)
        self.ends = np.cumsum(self.sizes)

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words in order, the place among them of each word of the block, and how many words each document has."""
        plain = self.raw.lower()  # bytes: A-Z only
        edges = np.concatenate([[0], self.ends]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(self.ids), pa.py_buffer(edges), pa.py_buffer(plain))
        found = pc.ascii_split_whitespace(texts)
        flat, of = found.flatten().cast(pa.binary()), np.repeat(np.arange(len(self.ids)), np.diff(found.offsets.to_numpy()))
        real = pc.not_equal(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
        if not pc.all(real, min_count=0).as_py():
            flat, of = flat.filter(real), of[real.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], np.bincount(of, minlength=len(self.ids))

    def vocabulary(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct words in order, and how often training documents hold each."""
        words, at, count = self.words()
        return words.to_pylist(), np.bincount(at[np.repeat(~self.held, count)], minlength=len(words))


ASKED = pa.schema([("g", pa.int32()), ("block", pa.string()), ("at", pa.binary()), ("what", pa.binary()), ("n", pa.binary())])
ASKED_SQL = "g int, block string, at binary, what binary, n binary"


def asked(block: str, group: np.ndarray, what, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for each group; ``what`` gives the bytes of chosen entries."""
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")  # few numbers sort by their digits
    edge = np.flatnonzero(np.diff(group[order], prepend=-1))
    rows = []
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
        own = order[i:j]
        rows.append({"g": int(group[own[0]]), "block": block, "at": pack(own.astype("<i4")), "what": what(own), "n": pack(n[own])})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ASKED)


def gathered(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[int]]:
    n = [unpack(x, np.int64) for x in table.column("n").to_pylist()]
    return table.column("what").to_pylist(), np.concatenate(n), [len(x) for x in n]


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH, groups: int | None = None) -> DataFrame:
    """Base score and model score of each whole text, learned from those not held out.

    A null text is empty: one token and one symbol, the end.  A null id has the checksum of
    no text, so it is trained on.  Repeated rows count and are scored one by one; other
    columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_column, text_column, [], BLOCK).select("block", "payload", "sizes", "ids", "nulls")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    groups = groups or max(shuffle_partitions(spark), (size["total"] or 0) // (8 << 20))
    hot = hot_contexts(blocks, size["n"], depth, groups)

    def ask_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                t = Texts(row)
                distinct, n = Strings(t.data, t.sizes, depth).distinct(~t.held)
                yield from asked(row["block"], group_of(distinct, depth, hot, groups), lambda own, d=distinct: pack(d[own]), n)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in each_row(batch):
                words, n = Texts(row).vocabulary()
                to = np.fromiter((zlib.crc32(w) % groups for w in words), np.int64, len(words))
                yield from asked(row["block"], to, lambda own, w=words: packer.compress(b"\n".join([w[k] for k in own.tolist()])), n)

    def count_words(table: pa.Table) -> pa.Table:
        what, n, sizes = gathered(table)
        counts: dict[bytes, int] = {}
        plain = zstandard.ZstdDecompressor().decompress
        parts = [plain(x).split(b"\n") for x in what]
        values = iter(n.tolist())
        for part in parts:
            for w in part:
                counts[w] = counts.get(w, 0) + next(values)
        answers = [pack(np.array([counts[w] for w in part], np.int64)) for part in parts]
        known = sum(c > 0 for c in counts.values())
        extra = [known] + [0] * (len(parts) - 1), [sum(counts.values())] + [0] * (len(parts) - 1)
        return pa.table({"block": table.column("block"), "at": table.column("at"), "n": pa.array(answers, pa.binary()), "known": extra[0], "tokens": extra[1]})

    words = persist(
        blocks.mapInArrow(ask_words, ASKED_SQL).groupBy("g").applyInArrow(count_words, "block string, at binary, n binary, known long, tokens long"), "words"
    )
    row = words.agg(F.sum("known").alias("v"), F.sum("tokens").alias("n")).first()
    held = blocks.select(F.explode(F.arrays_zip("ids", "nulls")).alias("x")).select(
        F.when(F.col("x.nulls"), F.lit("")).otherwise(F.col("x.ids").cast("string")).alias("id")
    )
    ends = held.filter(F.crc32(F.encode("id", "UTF-8")) % FOLDS != HELD_OUT).count()
    n_train, vocabulary = (row["n"] or 0) + ends, (row["v"] or 0) + (ends > 0)
    base = n_train + vocabulary + 1

    # dealt out once and laid out by task, so that neither pass over the trees moves strings again
    parts = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    tallies = persist_by(blocks.mapInArrow(ask_strings, ASKED_SQL).repartition(parts, "g"), "strings", "g", parts)

    def sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Distinct strings, their counts, and the places of all blocks' strings among them."""
        what, n, sizes = gathered(table)
        key, of = numbered(np.concatenate([unpack(x, np.uint64) for x in what]))
        return key, np.bincount(of, n, len(key)), of, sizes

    def upwards(table: pa.Table) -> pa.Table:
        """What the subtrees hand to the nodes above their roots."""
        key, count, _, _ = sums(table)
        out = []
        for top, own in slices(key, depth, hot):
            tree = Tree(key[own], count[own], top, depth)
            for bit in range(8):
                level = tree.decide(bit)[top]
                above, up = numbered(parent(tree.nodes(level, bit)))
                out.append((np.full(len(above), top - 1), above.astype(np.int64), *(np.bincount(up, x, len(above)) for x in level[1:4])))
        return pa.table(dict(zip(("level", "node", "a", "b", "log"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    # nodes with one context byte, at most 256 * 255, and 255 for each hot context, of which there are no more than tasks
    near = tallies.select("g", "what", "n").groupBy("g").applyInArrow(upwards, "level long, node long, a double, b double, log double")
    near = near.groupBy("level", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log").alias("log")).orderBy("level", "node").toArrow()
    table = spark.sparkContext.broadcast(from_root(*(near.column(c).to_numpy() for c in ("level", "node", "a", "b", "log"))))

    def downwards(data: pa.Table) -> pa.Table:
        key, count, of, sizes = sums(data)
        logs = np.zeros(len(key))
        for top, own in slices(key, depth, hot):
            tree = Tree(key[own], count[own], top, depth)
            node, *state = table.value[top - 1]
            chance = np.ones(len(own))
            for bit in range(8):
                levels = tree.decide(bit)
                at = np.searchsorted(node, parent(tree.nodes(levels[top], bit)))
                chance *= tree.chances(bit, levels, *(x[at] for x in state))
            logs[own] = np.log(chance)
        fixed = np.rint(logs * -FIXED).astype("<u4")
        ends = np.cumsum(sizes)
        answers = [pack(fixed[of[e - n : e]]) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"block": data.column("block"), "at": data.column("at"), "log": pa.array(answers, pa.binary())})

    logs = tallies.groupBy("g").applyInArrow(downwards, "block string, at binary, log binary")
    answers = logs.select("block", "at", F.col("log").alias("what"), F.lit(True).alias("is_log"))
    answers = answers.union(words.select("block", "at", "n", F.lit(False)))

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        """The scores of a block's documents, from what came back for its strings and words."""
        out, lowest = [], math.log10(base)
        is_log = np.array(right.column("is_log").to_pylist(), bool)
        logs, counts = (right.filter(pa.array(x)) for x in (is_log, ~is_log))
        del right
        for row in (r for b in left.to_batches() for r in each_row(b)):
            t = Texts(row)
            value = np.zeros(sum(len(unpack(x, "<i4")) for x in logs.column("at").to_pylist()), np.uint32)
            for at, log in zip(logs.column("at"), logs.column("what"), strict=True):
                value[unpack(at.as_py(), "<i4")] = unpack(log.as_py(), "<u4")
            scores = Strings(t.data, t.sizes, depth).sums(value) / (-FIXED * math.log(10))
            del value
            words_, at_word, count = t.words()
            n = np.zeros(len(words_), np.int64)  # in the order of words
            for at, own in zip(counts.column("at"), counts.column("what"), strict=True):
                n[unpack(at.as_py(), "<i4")] = unpack(own.as_py(), np.int64)
            of = np.repeat(np.arange(len(t.ids)), count)
            tokens = count + 1
            plain = np.bincount(of, np.log10(n + 1.0)[at_word], len(t.ids)) + math.log10(ends + 1.0) - tokens * lowest
            seen = np.bincount(of, (n > 0)[at_word], len(t.ids)).astype(np.int64) + (ends > 0)
            bits = -scores / math.log10(2) / (t.sizes + 1)
            columns = [t.ids, t.held, tokens, seen, np.full(len(t.ids), n_train), plain, scores, t.sizes, bits]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            out.append(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT.names))
        return pa.concat_tables(out)

    # rows of answers meet their block as they are: no list of all of them is put together
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(close, RESULT)


def hot_contexts(blocks: DataFrame, n_blocks: int, depth: int, groups: int) -> dict[int, np.ndarray]:
    """Contexts of two bytes and more that hold more strings than a task should.

    Some ``SAMPLED`` blocks are looked at; which contexts are hot decides on the layout alone, not on any result.
    """
    some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // SAMPLED))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                t = Texts(row)
                key = Strings(t.data, t.sizes, depth).distinct(~t.held)[0]
                found = [(0, 0, len(key))]
                for n in range(ROOTS[0], min(ROOTS[1], depth)):
                    near, count = counted(nearest(key, depth, n))
                    large = count * 4 * groups > len(key)
                    found += [(n, c, k) for c, k in zip(near[large].tolist(), count[large].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["n", "context", "strings"])

    rows = some.mapInArrow(run, "n long, context long, strings long").groupBy("n", "context").agg(F.sum("strings").alias("strings")).collect()
    total = sum(r["strings"] for r in rows if not r["n"])
    return {n: np.array(sorted(r["context"] for r in rows if r["n"] == n and r["strings"] * groups > total), np.uint64) for n in range(*ROOTS)}


def from_root(level: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> dict[int, tuple]:
    """By level the nodes above the subtrees, with the mixtures that leave them downwards."""
    own = {d: tuple(x[level == d] for x in (node.astype(np.uint64), a, b, below)) for d in np.unique(level).tolist()}
    levels: dict[int, tuple] = {}
    for d in range(max(own, default=-1), -1, -1):
        parts = [own[d]] if d in own else []
        if d + 1 in levels:
            ids, _, a, b, _, log = levels[d + 1]
            parts.append((parent(ids), a, b, log))
        ids, of = numbered(np.concatenate([p[0] for p in parts]))
        a, b, below = (np.bincount(of, np.concatenate([p[k] for p in parts]), len(ids)) for k in (1, 2, 3))
        if d + 1 in levels:
            child = levels[d + 1]
            levels[d + 1] = (child[0], of[len(of) - len(child[0]) :], *child[2:])
        log, weight = weighted(a, b, below)
        levels[d] = (ids, None, a, b, np.exp(weight), log)
    out: dict[int, tuple] = {}
    for d in range(len(levels)):
        ids, up, a, b, weight, _ = levels[d]
        state = (np.full(len(ids), x) for x in (0.0, 1.0, 0.5)) if up is None else (x[up] for x in out[d - 1][1:])
        out[d] = (ids, *mixed(a, b, weight, *state))
    return out
