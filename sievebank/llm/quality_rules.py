"""Quality rules of documents, and verdicts on hosts drawn from them.

Each whole text gets a few counts and fails or passes each of a set of rules: the base ones
on words and repeated words, and those on symbols, lines that occur before and the length of
words.  A text that fails any of them goes.  Failures are added up by host (the ``source`` column).  The rate of failing documents on a host is shrunk
towards the rate on all hosts by a beta prior, which is fitted to the hosts by the method of
moments: a host of three documents says little by itself, one of a million says all.  A host
whose shrunk rate is far over the corpus's own, by ``HOST_ODDS`` and at least ``HOST_LEAST``,
is rejected with all its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ASCII_WS, no_collector, persist, text_or_empty

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: Symbols for a hundred words, percent of lines that are copies (of two at least), and mean letters of a word that a text may have.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT, DUP_LINES = 30, 2
SHORTEST, LONGEST = 2, 12
#: A host is rejected whose shrunk odds of failing are this many times those of the whole corpus, unless its rate is small.
HOST_ODDS = 4.0
HOST_LEAST = 0.2
SYMBOLS = "#*$%&|<>"
NO_HOST = "\x00none"

WORD = re.compile(rf"[^{re.escape(ASCII_WS)}]+")
NO_SPACE = {ord(c): None for c in ASCII_WS}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five words that the text holds at least twice."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for k, window in enumerate(windows):
        if seen[window] > 1:
            covered += k + WINDOW - max(k, upto)
            upto = k + WINDOW
    return covered


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of ``COUNTS`` for one text, and its lines; a null text counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(ASCII_WS)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words) if len(words) > WINDOW else 0,
        len(lines),
    )


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def fails_any(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> bool:
    """Whether a text fails a base rule or one on symbols, copied lines or the length of words."""
    return (
        fails(n_words, n_repeat_words)
        or 100 * n_symbols > SYMBOL_PERCENT * n_words
        or (n_dup_lines >= DUP_LINES and 100 * n_dup_lines > DUP_LINE_PERCENT * n_lines)
        or not SHORTEST * n_words <= word_chars <= LONGEST * n_words
    )


STATS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("failed", T.BooleanType())]
)


def host_of(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_HOST))


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Counts, base verdict and verdict of all rules of each row; a row without a host belongs to the host of such rows."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), host_of(host_column).alias("host"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with no_collector():
                found = [counts_of(t) for t in batch.column(2).to_pylist()]
            if found:
                base, failed = [fails(x[0], x[4]) for x in found], [fails_any(*x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[: len(COUNTS)]), pa.array(base), pa.array(failed)], STATS.names
                )

    return rows.mapInArrow(run, STATS)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """The beta distribution whose mean and spread are those of the hosts' rates.

    ``hosts`` has ``n`` documents and ``failed`` of them by host.  What the spread shows
    beyond that of equal rates sets the prior's weight.
    """
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not total["n"]:
        return 1.0, 1.0
    n, mean = float(total["n"]), min(max(total["f"] / total["n"], 1e-9), 1 - 1e-9)
    noise = mean * (1 - mean)
    spread = hosts.agg(F.sum(F.col("n") * (F.col("failed") / F.col("n") - F.lit(mean)) ** 2).alias("s")).first()["s"]
    room = n - float(total["nn"]) / n
    excess = (spread - (total["k"] - 1) * noise) / room if room > 0 else 0.0
    weight = min(max(noise / excess - 1 if excess > 0 else 1e6, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def rejected_hosts(stats: DataFrame, limit: float | None = None) -> DataFrame:
    """Hosts whose shrunk rate of failing documents is over the limit, or if none is given over that of the corpus."""
    hosts = persist(stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "hosts")
    a, b = beta_prior(hosts)
    if limit is None:
        limit = max(HOST_LEAST, HOST_ODDS * a / (HOST_ODDS * a + b))
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).filter(F.col("host_rate") > limit)


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", limit: float | None = None) -> DataFrame:
    """Counts and verdict of each row.

    A null or empty text has no words and fails; a null id stays null, repeated rows are
    judged and counted one by one.  An empty table gives no rows.  Other columns are left
    out, so their names can't clash.
    """
    stats = persist(statistics(docs, id_column, text_column, host_column), "quality")
    bad = persist(rejected_hosts(stats, limit).select("host", "host_rate"), "bad-hosts")
    return stats.join(bad, "host", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("failed") & F.col("host_rate").isNull()).alias("kept"), F.col("host_rate").isNotNull().alias("host_rejected")
    )


def keep_good(docs: DataFrame, text_column: str = "text", host_column: str = "source", limit: float | None = None) -> DataFrame:
    """The rows that pass, with all their columns.

    Two passes: the first gathers failures by host, the second drops failing rows where
    they are read and then those of rejected hosts.
    """
    spare = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).alias("source"))
    bad = persist(rejected_hosts(statistics(spare), limit).select("host"), "bad-hosts")
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with no_collector():
                found = [counts_of(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not fails_any(*x) for x in found], pa.bool_()))

    kept = docs.mapInArrow(run, docs.schema)
    return kept.join(bad, host_of(host_column) == bad["host"], "left_anti")
