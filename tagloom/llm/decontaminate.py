"""Benchmark decontamination with an FM-index per shard of training text.

Words are runs of ASCII letters (lowered), digits and non-ASCII characters.  Test phrases are all windows of WINDOW consecutive
words of an item, or the whole of a shorter one.  A task joins its documents into shards of about SHARD bytes and indexes all words
of a shard: its text is the sequence of the words' numbers, an end after each document.  The index is a Burrows-Wheeler transform
over a full suffix array, a wavelet matrix with rank directories, and suffix positions sampled at every STEP-th place and at the
documents' starts.  All phrases are searched backwards together; occurrences are located by walking to a sampled row; their word
spans are merged.

Phrases go to the tasks with the function, as word hashes.  A test set of over BLOCK_WORDS words is worked off block by block: the
driver holds one block, its spans and items are written with the documents, and those of the next block are added to them.

Edge cases: null or empty texts have no words and are clean; null or empty texts of items give no phrase; phrases of items without
an id count as hits, but for no item; an item id with several texts has all their phrases; equal phrases belong to all their items;
repeated documents each get a row; a text longer than SHARD is a shard; extra columns stay, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, free, materialize, prepare, table, text_bytes, tidied, word_hashes, word_spans

WINDOW, SHARD, STEP, BLOCK_WORDS = 13, 3 << 20, 8, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each text."""
    data = _LOWER[data]
    starts, ends, at = word_spans(data, offsets, _WORD)
    return word_hashes(data, starts, ends), at


class Phrases:
    """The test phrases of some items: word hashes, and start, length and item of each phrase there."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)} | {None: -1}
        hashes, at = words_of(*text_bytes(pa.array([t for _, t in items], pa.string())))
        size = np.diff(at)
        many = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        ends = np.cumsum(many)
        self.starts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[:-1] - (ends - many), many)
        self.lengths = np.repeat(np.minimum(size, window), many)
        self.owner = np.repeat(np.array([number[i] for i, _ in items], np.int64), many)
        self.vocabulary, self.words = np.unique(hashes, return_inverse=True)


class Bits:
    """A bit vector with a rank directory: the set bits before each 64 of it."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels, self.zeros, now = [], [], symbols.astype(np.int32)
        for k in reversed(range(self.bits)):
            bit = (now >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - int(np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each place."""
        start, at = np.zeros(len(symbol), np.int64), list(places)
        for level, k in enumerate(reversed(range(self.bits))):
            ones, bits, zeros = ((symbol >> k) & 1).astype(bool), self.levels[level], self.zeros[level]

            def step(i: np.ndarray) -> np.ndarray:
                before = bits.rank(i)  # noqa: B023
                return np.where(ones, zeros + before, i - before)  # noqa: B023

            start, at = step(start), [step(i) for i in at]
        return [i - start for i in at]

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(place), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit, before = bits.get(place), bits.rank(place)
            place = np.where(bit == 1, zeros + before, place - before)
            out = out << 1 | bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. text: numbers from 1, in runs that each end with a 0; the ends sort first, by place.

    The first sort is by as many symbols as fit into 63 bits. Then, with twice the depth each round, only groups of suffixes
    that are still equal are sorted anew.
    """
    n, ends = len(text), text == 0
    symbols = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + text).astype(np.int64)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    depth = 63 // bits
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    order = np.argsort(key)
    rank, open_ = np.empty(n, np.int64), np.arange(n)
    key = key[order]
    while len(open_):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        rank[order[open_]] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        # Equal suffixes hold no end so far, so the text goes on after them.
        key = rank[order[open_]] * (n + 1) + rank[order[open_] + depth]
        again = np.argsort(key)
        order[open_], key = order[open_][again], key[again]
        depth *= 2
    return order


class FMIndex:
    """Index of a sequence of numbers from 1, in runs that each end with a 0."""

    def __init__(self, text: np.ndarray, step: int = STEP):
        self.n, self.top = len(text), int(text.max()) if len(text) else 0
        order = suffix_array(text)
        before = text[order - 1] if self.n else text
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 2))])
        self.ranks = WaveletMatrix(before, self.top)
        sampled = (order % step == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.positions = order[sampled]

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (words[start : start + length], 0 for unknown ones), found backwards."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = words[starts[live] + lengths[live] - back]
            known = (symbol > 0) & (symbol <= self.top)
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            a, b = self.ranks.rank(symbol, low[live], high[live])
            low[live], high[live] = self.before[symbol] + a, self.before[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled.get(at) == 1
            out[open_[done]] = self.positions[self.sampled.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.ranks.access(at)
            at = self.before[symbol] + self.ranks.rank(symbol, at)[0]
            steps += 1
        return out


def find(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list, list]:
    """Words of each text of a shard, its merged hit spans (in words), and the numbers of the items found."""
    hashes, at = words_of(data, offsets)
    n_words, spans, items = np.diff(at), [[] for _ in range(len(offsets) - 1)], [[] for _ in range(len(offsets) - 1)]
    if not len(phrases.starts) or not len(hashes):
        return n_words, spans, items
    coded = pa.array(hashes).dictionary_encode()
    text = np.zeros(len(hashes) + len(n_words), np.int64)  # word i of document d stands at i + d, and after it an end
    doc = np.repeat(np.arange(len(n_words)), n_words)
    text[np.arange(len(hashes)) + doc] = coded.indices.to_numpy() + 1
    index = FMIndex(text)
    known = pc.fill_null(pc.index_in(pa.array(phrases.vocabulary), value_set=coded.dictionary), -1).to_numpy() + 1
    low, high = index.search(known[phrases.words].astype(np.int64), phrases.starts, phrases.lengths)
    many = high - low
    hit = np.flatnonzero(many > 0)
    if not len(hit):
        return n_words, spans, items
    which = np.repeat(hit, many[hit])
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit]) + low[which]
    where = index.locate(rows)
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + phrases.lengths[which], -1)
    covered = np.cumsum(cover[:-1]) > 0  # never at a document's end
    change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2)
    begins = at[:-1] + np.arange(len(n_words))
    inside = np.searchsorted(begins, change[:, 0], side="right") - 1
    for d, (a, b) in zip(inside.tolist(), (change - begins[inside, None]).tolist(), strict=True):
        spans[d].append((a, b))
    pair = np.unique((np.searchsorted(begins, where, side="right") - 1) * (len(phrases.items) + 1) + phrases.owner[which] + 1)
    for d, item in zip(*(x.tolist() for x in np.divmod(pair, len(phrases.items) + 1)), strict=True):
        if item:  # 0: phrases of items without an id
            items[d].append(item - 1)
    return n_words, spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = {"__n_words": "long", "__spans": "array<struct<start:long,stop:long>>", "__items": "array<string>"}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, at: int, phrases: Phrases, again: bool) -> DataFrame:
    """Columns c0, c1, ...: those of docs (the text is column at) and the three of _FOUND; again: docs has these three of other phrases already."""
    kinds = [f.dataType.simpleString() for f in docs.schema][: -3 if again else None]
    schema = ", ".join(f"c{k} {t}" for k, t in enumerate([*kinds, *_FOUND.values()]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, SHARD, at):
            data, offsets = text_bytes(batch.column(at))
            n, spans, items = [], [], []
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SHARD, side="right")) - 1)
                x, y, z = find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], phrases)
                n += x.tolist()
                spans += y
                items += [{phrases.items[i] for i in s} for s in z]
                a = b
            if again:
                old = batch.columns[-3:]
                spans = [merge([*s, *((v["start"], v["stop"]) for v in o)]) for s, o in zip(spans, old[1].to_pylist(), strict=True)]
                items = [s | set(o) for s, o in zip(items, old[2].to_pylist(), strict=True)]
            new = [pa.array(n, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPANS), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
            columns = [*batch.columns[: len(kinds)], *new]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return docs.mapInArrow(run, schema)


def phrase_blocks(bench: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test set as blocks of phrases, each from items of at most about block_words words (sizes are counted first); one at a time comes to the driver."""
    texts = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    n = max(1, -(-size // (5 * block_words)))  # about five characters a word
    part = F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(n))
    for k in range(n):
        yield Phrases([tuple(r) for r in texts.where(part == k).collect()])


def judged(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns c0, c1, ... of docs, then words, spans, items, hit words, and whether the document is contaminated, as c-columns too."""
    prepare(docs.sparkSession)
    n, at = len(docs.columns), docs.columns.index("text")
    out, last = docs.toDF(*(f"c{k}" for k in range(n))), None
    for phrases in phrase_blocks(bench, block_words):
        if last is not None:  # the driver lets go of the block before
            out = materialize(out, "block")
        out, last = scan(out, at, phrases, last is not None), phrases
    out = out.withColumn(f"c{n + 3}", F.expr(f"aggregate(c{n + 1}, 0L, (n, s) -> n + s.stop - s.start)"))
    return out.withColumn(f"c{n + 4}", F.expr(f"c{n + 3} > 0 AND 20 * c{n + 3} >= c{n}"))


def contaminated(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of docs with __n_words, __spans (merged, in words), __items, __n_hit and __contaminated; with _ after a name that docs has itself."""
    return judged(docs, bench, block_words).toDF(*docs.columns, *free(docs.columns, *_FOUND, "__n_hit", "__contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    n = len(docs.columns)
    return judged(docs, bench).where(f"NOT c{n + 4}").select(*(f"c{k}" for k in range(n))).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), F.col("__contaminated").alias("contaminated"))


ORACLE_SQL = {
    "op10_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS k FROM p),
g AS (SELECT r, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n)),
h AS (SELECT g.r, g.i, len(g.g) AS k, p.item_id FROM g JOIN p USING (g)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS x FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(x, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""
}
