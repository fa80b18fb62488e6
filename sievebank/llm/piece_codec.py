"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Every prefix of a text has exactly one BPE encoding, so it has exactly one *last token*.
The encoder walks the text once, and at each position asks an automaton for the tokens
that end there.  A token ``t`` is the last token of the prefix if its left neighbour
``u``, the last token stored for the prefix that ends where ``t`` begins, may stand before
it: BPE run on ``u`` + ``t`` must give back that pair.  Exactly one ``t`` passes.  The ids
are read from the table backwards.

The compatibility of a pair is decided without running BPE: undo the merges of ``u`` and
``t`` along their touching edges, latest merge first, and reject the pair if at some
moment a token across the seam would have been merged before the merges that are being
undone.  Decisions are remembered, as are the ids of short segments.

Texts are first cut where no token of the vocabulary reaches across.  That changes no id,
and keeps the segments short enough to be remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Memory, no_collector, portions, text_or_empty, tokenizer_file

SPACE = "▁"

LETTER = r"[^\W\d_¹²³]"
#: A newline, letters or other characters, each with the spaces before it. No token may reach
#: from one segment into the next; that is checked against the vocabulary.
SEGMENT = re.compile(rf"[ {SPACE}]*{LETTER}+|[ {SPACE}]*(?:[^ {SPACE}\n\w]|[\d_¹²³])+|[ {SPACE}]+|\n")
PLAIN = re.compile(" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class PrefixTable:
    """Encoder of a SentencePiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = self.model
        special = [m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i) for i in range(m.get_piece_size())]
        self.pieces = {m.id_to_piece(i): i for i, s in enumerate(special) if not s}
        self.n = m.get_piece_size()
        #: When a merge that makes a token runs: from the highest score down.
        self.rank = [0] * self.n
        for k, i in enumerate(sorted(self.pieces.values(), key=lambda i: (-m.get_score(i), i))):
            self.rank[i] = k
        #: left id * n + right id -> id of the joined token
        self.joined = {
            self.pieces[p[:k]] * self.n + self.pieces[p[k:]]: i
            for p, i in self.pieces.items()
            for k in range(1, len(p))
            if p[:k] in self.pieces and p[k:] in self.pieces
        }
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.parts: list[tuple[int, int] | None] = [None] * self.n
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            if len(piece) > 1 and (split := self._split(piece)):
                self.parts[i] = split
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.joined_keys = np.array(sorted(self.joined), np.int64)
        self.joined_ids = np.array([self.joined[k] for k in self.joined_keys.tolist()], np.int64)
        self.ranks = np.array(self.rank, np.int64)
        self.lefts = np.array([p[0] if p else -1 for p in self.parts], np.int64)
        self.rights = np.array([p[1] if p else -1 for p in self.parts], np.int64)
        self.singles = np.full(0x110000, -1, np.int64)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.singles[ord(p)] = i
        self._trie()
        self.numbers = list(range(self.n))
        self.memory = Memory(450_000)
        self.touching = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.cuts = self._cuts()
        letter = re.compile(LETTER)
        mixed = any(SPACE not in p and bool(letter.match(p[0])) != bool(letter.match(p[1])) for p in self.touching)
        if mixed or any("\n" in p or " " in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("tokens of this model reach across the segments")

    def _split(self, piece: str) -> tuple[int, int] | None:
        """The last merge inside a token, found by running BPE on it; none if BPE can't make it."""
        symbols, last = [self.pieces.get(c, -1) for c in piece], None
        if -1 in symbols:
            return None
        while len(symbols) > 1:
            made = [self.joined.get(a * self.n + b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            ways = [(self.rank[t], k) for k, t in enumerate(made) if t >= 0]
            if not ways:
                return None
            k = min(ways)[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [made[k]]
        return last

    def _trie(self) -> None:
        """The tokens' trie as sorted arrays, for stepping from many places at once."""
        edges: dict[int, int] = {}
        ends = {}
        for piece, i in self.pieces.items():
            if self.parts[i] is None:
                continue
            node = 0
            for c in piece:
                node = edges.setdefault(node * self.n + self.pieces[c], len(edges) + 1)
            ends[node] = i
        self.longest = max(len(p) for p, i in self.pieces.items() if self.parts[i])
        self.edges = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.ends = np.full(len(edges) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def _cuts(self) -> re.Pattern:
        """A pattern for segments that no token reaches out of."""
        inner = {c for p in self.pieces if len(p) > 1 for c in p} - {SPACE}
        spaced = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        word = "[" + "".join(map(re.escape, sorted(inner))) + "]"
        # a run of spaces with the joinable characters behind it, or one character that never joins
        return re.compile(f"(?:{SPACE}|{word})+|." if spaced else f"{SPACE}+{word}*|{word}+|.", re.DOTALL)

    def _apart(self, u: int, v: int) -> bool:
        """Whether BPE leaves tokens ``u`` and ``v`` apart when they stand side by side."""
        joined, rank, parts, n = self.joined, self.rank, self.parts, self.n
        limit = n
        across = joined.get(u * n + v)
        if across is not None:
            return False
        while True:
            pu, pv = parts[u], parts[v]
            ru = rank[u] if pu else -1
            rv = rank[v] if pv else -1
            if ru < 0 and rv < 0:
                return True
            if ru > rv:
                limit, u = ru, pu[1]
                across = joined.get(u * n + v)
                # the merge that made the left token starts further left, so it wins a tie
                if across is not None and rank[across] < limit:
                    return False
            else:
                limit, v = rv, pv[0]
                across = joined.get(u * n + v)
                # the merge across starts further left, so it wins a tie
                if across is not None and rank[across] <= limit:
                    return False

    def last_tokens(self, segment: str) -> list[int]:
        """The tokens of one segment, from the table of last tokens; its characters must be tokens."""
        pieces, n = self.pieces, self.n
        last = [pieces[c] for c in segment]
        length = [1] * len(segment)
        done = -1
        for end, (size, token) in self.automaton.iter(segment):
            if end == done or (begin := end - size) >= 0 and not self._apart(last[begin], token):
                continue
            last[end], length[end], done = token, size, end
        out, k = [], len(segment) - 1
        while k >= 0:
            out.append(last[k])
            k -= length[k]
        return out[::-1]

    def _apart_all(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``_apart`` for many pairs at once."""
        joined, made, rank, n = self.joined_keys, self.joined_ids, self.ranks, self.n

        def across(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            key = u * n + v
            at = np.minimum(np.searchsorted(joined, key), len(joined) - 1)
            return np.where(joined[at] == key, rank[made[at]], n)

        out = across(u, v) == n
        live = np.flatnonzero(out)
        u, v = u[live], v[live]
        while len(live):
            ru, rv = np.where(self.lefts[u] >= 0, rank[u], -1), np.where(self.lefts[v] >= 0, rank[v], -1)
            go = (ru >= 0) | (rv >= 0)
            live, u, v, ru, rv = live[go], u[go], v[go], ru[go], rv[go]
            on_left = ru > rv
            u, v = np.where(on_left, self.rights[u], u), np.where(on_left, v, self.lefts[v])
            found = across(u, v)
            bad = np.where(on_left, found < ru, found <= rv)
            out[live[bad]] = False
            live, u, v = live[~bad], u[~bad], v[~bad]
        return out

    def last_tokens_all(self, segments: list[str]) -> list[list[int]]:
        """``last_tokens`` for many segments: the table is filled position by position for all of them."""
        out: list[list[int]] = [[] for _ in segments]
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        lengths = np.array([len(segments[k]) for k in order])
        for size in np.unique(lengths):
            lo, hi = np.searchsorted(lengths, [size, size + 1])
            rows = order[lo:hi]
            if len(rows) < 16 or size > 64:
                for k in rows:
                    out[k] = self.last_tokens(segments[k])
                continue
            codes = np.frombuffer("".join([segments[k] for k in rows]).encode("utf-32-le"), "<u4").reshape(len(rows), size)
            last, span = self._fill(self.singles[codes])
            at, ids = np.full(len(rows), size - 1), [[] for _ in rows]
            live = np.arange(len(rows))
            while len(live):
                for k, t in zip(live.tolist(), last[live, at[live]].tolist(), strict=True):
                    ids[k].append(t)
                at[live] -= span[live, at[live]]
                live = live[at[live] >= 0]
            for k, x in zip(rows, ids, strict=True):
                out[k] = x[::-1]
        return out

    def _fill(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token and its length, for each segment and position."""
        rows, size = chars.shape
        last, span = chars.copy(), np.ones((rows, size), np.int64)
        row, start = (x.ravel() for x in np.indices((rows, size)))
        node, found = np.zeros(rows * size, np.int64), {}
        for k in range(1, self.longest + 1):
            keep = start + k <= size
            row, start, node = row[keep], start[keep], node[keep]
            key = node * self.n + chars[row, start + k - 1]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            row, start, node = row[hit], start[hit], self.edge_to[at[hit]]
            token = self.ends[node]
            full = np.flatnonzero(token >= 0)
            if len(full):
                by = np.argsort(start[full], kind="stable")
                found[k] = (row[full][by], start[full][by], token[full][by])
        free = np.empty(rows, bool)
        for end in range(1, size):
            free[:] = True
            for k in range(min(end + 1, self.longest), 1, -1):
                if k not in found:
                    continue
                r, s, t = found[k]
                begin = end - k + 1
                lo, hi = np.searchsorted(s, [begin, begin + 1])
                r, t = r[lo:hi], t[lo:hi]
                ok = free[r]
                r, t = r[ok], t[ok]
                if begin and len(r):
                    ok = self._apart_all(last[r, begin - 1], t)
                    r, t = r[ok], t[ok]
                last[r, end], span[r, end], free[r] = t, k, False
        return last, span

    def _cut(self, segment: str) -> list[str]:
        """A segment cut where two characters stand side by side in no token."""
        touching, begin, out = self.touching, 0, []
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in touching:
                out.append(segment[begin:k])
                begin = k
        out.append(segment[begin:])
        return out

    def learn(self, segments: set[str]) -> dict[str, tuple[str, tuple[int, ...]]]:
        """The ids of segments of a text, in decimal joined by commas, and as numbers."""
        young, old, number = self.memory.young, self.memory.old, self.numbers
        out: dict[str, tuple[str, tuple[int, ...]]] = {}
        parts: dict[str, list[str]] = {}
        wanted: set[str] = set()
        for s in segments:
            if PLAIN.fullmatch(s):
                wanted.add(s)
                continue
            parts[s] = own = [y.replace(SPACE, " ") for x in self.cuts.findall(s.replace(" ", SPACE)) for y in self._cut(x)]
            for x in own:
                if x not in out:
                    got = young.get(x) or old.get(x)
                    if got is None:
                        wanted.add(x)
                    else:
                        out[x] = got
        order = list(wanted)
        pieces = [x.replace(" ", SPACE) for x in order]
        long = [k for k, x in enumerate(pieces) if len(x) > 1]
        ids: list[list[int]] = [[]] * len(pieces)
        for k, x in zip(long, self.last_tokens_all([pieces[k] for k in long]), strict=True):
            ids[k] = x
        for k, x in enumerate(pieces):
            if len(x) == 1:
                own = self.pieces.get(x)
                ids[k] = [self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")] if own is None else [own]
        # the numbers are shared, so a remembered segment costs little more than its own text
        for s, x in zip(order, ids, strict=True):
            out[s] = (",".join(map(str, x)), tuple([number[i] for i in x]))
        for s, own in parts.items():
            if s not in out:
                out[s] = (",".join([out[x][0] for x in own]), tuple([i for x in own for i in out[x][1]]))
        return out

    def encoded(self, texts: list[str]) -> list[list[tuple[str, tuple[int, ...]]]]:
        """For each text what ``learn`` gives for its segments, in order."""
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        known, missing = self.memory.young, set()
        found = []
        for segments in cut:
            found.append(got := list(map(known.get, segments)))
            if None in got:
                missing.update([s for s, g in zip(segments, got, strict=True) if g is None])
        if missing:
            new = self.memory.fill(missing, self.learn)
            found = [[g or new[s] for s, g in zip(c, f, strict=True)] if None in f else f for c, f in zip(cut, found, strict=True)]
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of a text, as the library gives them."""
        return [i for part in self.encoded([text])[0] for i in part[1]]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids, and SHA-256 of the decoded text."""
        found = self.encoded(texts)
        ids = [list(chain.from_iterable([p[1] for p in f])) for f in found]
        decoded = self.model.decode(ids) if ids else []
        return [
            (len(i), sha256(",".join([p[0] for p in f]).encode()).hexdigest(), sha256(d.encode("utf-8", "replace")).hexdigest())
            for f, i, d in zip(found, ids, decoded, strict=True)
        ]


@lru_cache(maxsize=2)
def codec(model_file: str) -> PrefixTable:
    """One table for each Python worker."""
    return PrefixTable(model_file)


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every whole text; one row of counts and digests for each row.

    A null text is the empty text and gives no ids.  Repeated rows give repeated results, a
    null id stays null, other columns are left out.  The table's size and what it remembers
    are bounded by parameters, whatever the texts hold.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(tokenizer_file(model))
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, j in portions(texts):
                with no_collector():
                    out += [(k, *d) for k, d in zip(ids[i:j], table.digests(texts[i:j]), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, SCHEMA)
