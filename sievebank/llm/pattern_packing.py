"""Packing documents into fixed-length sequences by non-negative least squares over patterns.

1. Every text becomes its ids and an end id; longer ones are cut at the capacity.
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver.
3. All patterns of at most three lengths that fill a sequence exactly are enumerated, and
   repeat counts are fitted to the histogram by non-negative least squares (projected
   gradient with momentum; a pattern touches three entries, so a step is a gather and a
   count).
4. Counts are rounded, largest first, as far as the histogram holds out; best fit, longest
   first, packs what is left, again on the histogram.
5. Pieces are numbered within their length, from counts for each task and length, and each
   takes the place that the plan gives to its number.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Memory, no_collector, persist, portions, text_or_empty, tokenizer_file

CAPACITY = 2048
END_ID = 0

#: Letters of Latin-1 in UTF-8, then ASCII punctuation.
LETTERS_AND_MARKS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?|()\-]*)")

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "rank")]
    + [T.StructField(n, T.IntegerType()) for n in ("piece", "part")]
)
PLACED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class ChunkTokenizer:
    """A ``tokenizers`` model that remembers the ids of chunks between ASCII white space.

    Its normalizer and its splitter work inside such chunks, so a text's ids are its
    chunks' ids in a row. They also part letters from punctuation, so a chunk of letters
    with punctuation behind it is put together from the two.  New words of letters go to the
    model many at a time, side by side: each ends in a token that only ends words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        suffix = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        size = self.model.get_vocab_size()
        self.ends = np.array([bool(suffix) and (self.model.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.memory = Memory(700_000)

    def _each(self, chunks: list[bytes]) -> Iterator[bytes]:
        """The ids of each chunk by itself."""
        for e in self.model.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _words(self, words: list[bytes], at_once: int = 1000) -> Iterator[bytes]:
        """The ids of words of letters."""
        lines = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        for own, e in zip(lines, self.model.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(own) or ends[-1] != 4 * len(ids):
                yield from self._each(own)
                continue
            raw = ids.tobytes()
            yield from (raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True))

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks, and of the words and marks that they are made of."""
        young, old, known, parts, words, rest = self.memory.young, self.memory.old, {}, [], set(), set()
        match = LETTERS_AND_MARKS.fullmatch
        for c in chunks:
            m = match(c)
            if not m:
                rest.add(c)
                continue
            word, marks = m.groups()
            word = word.lower()
            if word != c:
                parts.append((c, word, marks))
            for x, to in ((word, words), (marks, rest)):
                if x and x not in known:
                    got = young.get(x) or old.get(x)
                    if got is None:
                        to.add(x)
                    else:
                        known[x] = got
        for wanted, ids_of in ((list(words), self._words), (list(rest), self._each)):
            known.update(zip(wanted, ids_of(wanted), strict=True))
        known[b""] = b""
        known.update([(c, known[w] + known[m]) for c, w, m in parts])
        del known[b""]
        return known

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8 as little-endian unsigned 32-bit numbers."""
        cut = [t.split() for t in texts]  # bytes split at ASCII white space only
        asked: set[bytes] = set()
        for chunks in cut:
            asked.update(chunks)
        missing = asked.difference(self.memory.young)
        if not missing:
            get = self.memory.young.__getitem__
        else:
            had = self.memory.young
            new = self.memory.fill(missing, self.learn)
            get = self.memory.young.__getitem__ if self.memory.young.keys() >= asked else ({c: had[c] for c in asked if c in had} | new).__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker."""
    return ChunkTokenizer(path)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces of all documents, numbered within their task and length."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seen = chunk_tokenizer(tokenizer_file(tokenizer)), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            texts, encoded = batch.column(1).cast(pa.binary()).to_pylist(), []
            for i, j in portions(texts):
                with no_collector():
                    encoded += model.ids(texts[i:j])
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for k in range(0, len(ids), wide):
                    own = ids[k : k + wide]
                    n = len(own) // 4
                    out.append((doc, k // 4, n, zlib.crc32(own), seen[n], k // wide, part))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k < 5 else pa.int32()) for k, c in enumerate(zip(*out, strict=True))], PIECES.names
                )

    return rows.mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` with one to three of these lengths; 0 stands for none."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = capacity - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(histogram: np.ndarray, found: np.ndarray, steps: int = 200) -> np.ndarray:
    """Repeat counts of the patterns, none negative, whose lengths come closest to the histogram."""
    if not len(found):
        return np.zeros(0)
    size = len(histogram)
    goal = histogram.astype(float)
    goal[0] = 0.0
    # entries are weighted by their size, so that rare lengths count as much as frequent ones
    weight = 1.0 / np.maximum(goal, 1.0)
    weight[0] = 0.0

    def spread(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(found[:, k], x, size) for k in range(3))

    def gather(r: np.ndarray) -> np.ndarray:
        return r[found[:, 0]] + r[found[:, 1]] + r[found[:, 2]]

    # rows scaled by the share of each pattern that its scarcest length allows
    scale = np.min(np.where(found > 0, goal[found] / np.maximum(np.bincount(found.ravel(), minlength=size), 1)[found], np.inf), 1)
    v = np.ones(len(found))
    for _ in range(12):
        w = scale * gather(weight * spread(scale * v))
        norm = np.linalg.norm(w)
        v = w / norm
    step = 1.0 / (norm * 1.05)
    y = x = np.ones(len(found))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * scale * gather(weight * (spread(scale * y) - goal)), 0.0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x * scale


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as lists of lengths, with their repeat counts, that use up the histogram.

    Fitted counts are rounded to the nearest number and, again, downwards; the rounding that
    ends in fewer sequences stands.
    """
    found = patterns(np.flatnonzero(histogram[1:]) + 1, capacity)
    counts = fit(histogram, found)
    ways = [rounded(histogram, found, counts, up, capacity) for up in (True, False)]
    return min(ways, key=lambda way: sum(times for _, times in way))


def rounded(histogram: np.ndarray, found: np.ndarray, counts: np.ndarray, up: bool, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns repeated by their rounded counts, largest first, as far as the histogram holds out, and the rest by best fit."""
    out: list[tuple[tuple[int, ...], int]] = []
    have = histogram.astype(np.int64).tolist()
    for k in np.argsort(-counts, kind="stable").tolist():
        if counts[k] < (0.05 if up else 1.0):
            break
        own = tuple(x for x in found[k].tolist() if x)
        most = min(have[x] // own.count(x) for x in own)
        times = min(most, max(1, round(float(counts[k]))) if up else int(counts[k]))
        if times > 0:
            for x in own:
                have[x] -= times
            out.append((own, times))
    return out + best_fit(have, capacity)


def best_fit(have: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are filled together."""
    open_: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, bool)  # rooms for which open sequences exist
    for size in range(capacity, 0, -1):
        n = have[size]
        while n:
            at = np.flatnonzero(room[size:])
            if len(at):
                space = int(at[0]) + size
                own, times = open_[space].pop()
                if not open_[space]:
                    room[space] = False
                used = min(n, times)
                if used < times:
                    open_[space].append([own, times - used])
                    room[space] = True
            else:
                space, own = capacity, ()
                used = max(1, n // (capacity // size))  # full ones take several of this length
            rest = space - size
            open_.setdefault(rest, []).append([(*own, size), used])
            room[rest] = rest > 0
            n -= used
    return [(tuple(own), times) for entries in open_.values() for own, times in entries]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Place every document, or every piece of one that is too long, in a sequence.

    A null or empty text is its end id alone.  Repeated rows and null ids are packed like
    others; other columns are left out.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = persist(pieces_of(docs, tokenizer, capacity, id_column, text_column), "pieces")
    tally = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # one number for each length at most, whatever the size of the corpus
    histogram = np.zeros(capacity + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]

    starts, places = [], []
    used = np.zeros(capacity + 1, np.int64).tolist()
    sequence = 0
    for own, times in plan(histogram, capacity):
        offset = 0
        for size in own:
            starts.append((size << 44) + used[size])
            places.append((sequence, offset, used[size]))
            used[size] += times
            offset += size
        sequence += times
    # as many entries as patterns at most, and those depend on the capacity alone
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    table = spark.sparkContext.broadcast((np.array(starts, np.int64)[order], np.array(places, np.int64).reshape(-1, 3)[order]))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = persist(tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            rank = get["first"].to_numpy() + get["rank"].to_numpy()
            at = np.searchsorted(starts, (get["length"].to_numpy() << 44) + rank, "right") - 1
            to = places[at]
            yield pa.RecordBatch.from_arrays(
                [get[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(to[:, 0] + rank - to[:, 2]), pa.array(to[:, 1])],
                PLACED.names,
            )

    return pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "first").mapInArrow(place, PLACED)
