"""Token-ID output in directly addressable codes.

Format.  A token file is a Parquet dataset with one row per segment: ``shard``, ``seg``, ``first_token`` (ids of the shard
before the segment), ``n_tokens``, ``doc_ids``, ``doc_lens`` and ``payload``.  Segments hold whole documents in ascending
doc_id order and close at SEGMENT ids; a longer document has a segment of its own.  The payload splits every id into 8-bit
chunks, low chunk first.  Level k holds chunk k of the ids that have one, a bitmap telling which continue on level k + 1, and a
rank directory with the count of set bits before each block of 512.  So id i is found by one byte, one bit and one rank a level,
without decoding its neighbours: ``Dac(payload)[i]``.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; equal doc_ids are ordered by text and each keeps
its row; extra columns are ignored; an empty table gives an empty dataset.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, partitions, prepare, scratch, table, tidied

SEGMENT = 1 << 18
CHUNK = 4 << 20  # bytes of texts that are encoded together
BLOCK = 512
MAGIC = b"DAC1"


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels of 8-bit chunks, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        last = not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b""
        if not last:
            counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
            ranks = (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes()
        levels.append((len(chunk), chunk.tobytes(), bits, ranks))
        if last:
            break
        rest = rest[more]
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class Dac:
    """Reads a payload: ``dac[i]`` is random access, ``dac.decode()`` all ids."""

    def __init__(self, payload: bytes):
        assert payload[:4] == MAGIC, "not a DAC payload"
        (n,) = struct.unpack_from("<I", payload, 4)
        sizes = struct.unpack_from(f"<{n}Q", payload, 8)
        at, self.levels = 8 + 8 * n, []
        for k, size in enumerate(sizes):
            chunk = np.frombuffer(payload, np.uint8, size, at)
            at += size
            bits = ranks = None
            if k + 1 < n:
                bits = np.frombuffer(payload, np.uint8, -(-size // 8), at)
                at += len(bits)
                ranks = np.frombuffer(payload, "<u4", -(-size // BLOCK), at)
                at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            base = i // BLOCK * (BLOCK // 8)
            inside = np.unpackbits(bits[base : (i >> 3) + 1], bitorder="little")[: i % BLOCK]
            i = int(ranks[i // BLOCK]) + int(inside.sum())
        return value

    def decode(self) -> np.ndarray:
        out = None
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if bits is not None:
                here[np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))] |= out << np.uint32(8)
            out = here
        return out


#: A space or newline before one of these is the last of its run of white space; the byte-level pre-tokenizer starts a piece there.
_SOLID = "!-~\u00a1-\u167f\u1681-\u1fff\u2060-\u2fff\u3001-\U0010ffff"
_LOOSE = f"[ \n](?:[^{_SOLID}]|\\z)"
_SPLIT = re.compile(f"(?=[ \n][{_SOLID}])")
#: White space, or what some call so, inside a part.
_INSIDE = re.compile(r"[\s\x1c-\x1f\x85]")
#: Marks at a part's end that form a piece of their own after a letter or digit (an apostrophe might start a contraction).
_MARKS = ".,!?;:*$%&#|"
_MARKED = f"[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481][{_MARKS}]+\\z"


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same of the next."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class PieceEncoder:
    """Encodes columns of whole texts with a byte-level BPE tokenizer, each distinct part once.

    BPE never merges across pieces of the pre-tokenizer, and a piece starts at every space or newline before a solid
    character; so the ids of a text are those of its parts, and parts repeat.  Arrow splits the texts of a chunk and numbers
    their distinct parts; the tokenizer gets those that the memo does not hold.  Marks at a part's end are a piece too, so the
    memo holds stems.  A part that follows a space is kept without it; a text's first part, which follows nothing, is kept apart.  Texts that hold a special token's string are encoded
    whole.  The memo is an Arrow column of parts and one array of their ids, bounded by KEEP parts and LONGEST characters;
    the parts that were used last stay.
    """

    KEEP, LONGEST = 300_000, 48
    #: Characters of the parts that are encoded as one text.
    TOGETHER = 20_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "")[:1] in ("\u0120", "\u010a") for i in range(size)])
        self.parts = pa.array([], pa.large_string())
        self.ids, self.at, self.used, self.now = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _led(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many of each part, of parts that follow a space or start with a newline: encoded as one text, cut where pieces so start."""
        odd = [k for k, w in enumerate(parts) if not w or _INSIDE.search(w, 1)]
        alone = dict(zip(odd, self._each([w if w[:1] == "\n" else " " + w for w in (parts[k] for k in odd)]), strict=True)) if odd else {}
        plain = [w for k, w in enumerate(parts) if k not in alone] if odd else parts
        text = "".join([w if w[0] == "\n" else " " + w for w in plain])
        ids = self._each([text])[0]
        cut = np.append(np.flatnonzero(self.leads[ids]), len(ids))
        if len(cut) != len(plain) + 1:
            raise ValueError("parts do not match their pieces")
        if not odd:
            return ids, np.diff(cut)
        pieces = iter(np.split(ids, cut[1:-1]) if plain else ())
        found = [alone[k] if k in alone else next(pieces) for k in range(len(parts))]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many of each part, of parts that are not known."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        ends = np.cumsum([len(w) + 1 for w in new]) // self.TOGETHER
        for some in np.split(np.arange(len(new)), np.flatnonzero(np.diff(ends)) + 1) if new else ():
            x, n = self._led(new[some[0] : some[-1] + 1])
            ids.append(x), counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _stems(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and start and number of each part's ids there: those of its stem and of the marks after it."""
        marked = pc.match_substring_regex(parts, _MARKED)
        stems = pc.if_else(marked, pc.utf8_rtrim(parts, characters=_MARKS), parts).dictionary_encode()
        ids, at, many = self._known(stems.dictionary)
        stem = stems.indices.to_numpy(zero_copy_only=False)
        starts, counts = np.zeros((len(parts), 2), np.int64), np.zeros((len(parts), 2), np.int64)
        starts[:, 0], counts[:, 0] = at[stem], many[stem]
        where = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        tails = pa.array([w[len(w.rstrip(_MARKS)) :] for w in parts.take(pa.array(where)).to_pylist()], pa.large_string()).dictionary_encode()
        found = self._each(tails.dictionary.to_pylist())
        sizes, tail = np.array([len(x) for x in found], np.int64), tails.indices.to_numpy(zero_copy_only=False)
        starts[where, 1], counts[where, 1] = (len(ids) + np.cumsum(sizes) - sizes)[tail], sizes[tail]
        out, total = np.concatenate([ids, *found])[ragged(starts.ravel(), counts.ravel())], counts.sum(axis=1)
        return out, np.cumsum(total) - total, total

    def _known(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and start and number of each part's ids there."""
        place = pc.index_in(parts, value_set=self.parts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.now += 1
        fresh = np.flatnonzero(place < 0)
        self.used[place[place >= 0]] = self.now
        new = parts.take(pa.array(fresh))
        ids, counts = self._learn(new.to_pylist())
        at = np.concatenate([[0], np.cumsum(counts)])
        every, starts, many = np.concatenate([self.ids, ids]), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        old = place[place >= 0]
        starts[place >= 0], many[place >= 0] = self.at[old], self.at[old + 1] - self.at[old]
        starts[fresh], many[fresh] = len(self.ids) + at[:-1], counts
        self._remember(new, at, counts, every)
        return every, starts, many

    def _remember(self, new: pa.Array, at: np.ndarray, counts: np.ndarray, every: np.ndarray) -> None:
        """Add new parts to the memo; beyond KEEP, those that were used last stay."""
        short = np.flatnonzero(pc.utf8_length(new).to_numpy(zero_copy_only=False) <= self.LONGEST)[: self.KEEP]
        starts = np.concatenate([self.at[:-1], len(self.ids) + at[:-1][short]])
        counts = np.concatenate([np.diff(self.at), counts[short]])
        used = np.concatenate([self.used, np.full(len(short), self.now)])
        parts = pa.concat_arrays([self.parts, new.take(pa.array(short))])
        if len(used) > self.KEEP:
            stay = np.sort(np.argsort(used, kind="stable")[-self.KEEP // 2 :])
            starts, counts, used, parts = starts[stay], counts[stay], used[stay], parts.take(pa.array(stay))
        self.ids = every[ragged(starts, counts)]
        self.at, self.used, self.parts = np.concatenate([[0], np.cumsum(counts)]), used, parts

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after the other, and the place where each text's begin and the last one's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        whole = np.zeros(n, bool)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False) & ~whole
        apart = whole | loose
        rest = pc.if_else(pa.array(apart), "", texts) if apart.any() else texts
        lists = pc.split_pattern(pc.replace_substring(rest, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts, counts = starts[:-1] - starts[0], np.diff(starts)
        words = lists.flatten()
        if loose.any():
            split = [[p[1:] if k and p[0] == " " else p for k, p in enumerate(_SPLIT.split(t))] for t in texts.filter(pa.array(loose)).to_pylist()]
            counts[loose] = [len(x) for x in split]
            starts[loose] = len(words) + np.cumsum(counts[loose]) - counts[loose]
            words = pa.concat_arrays([words, pa.array([p for x in split for p in x], pa.large_string())])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # First parts follow nothing; their ids, and those of texts encoded whole, come after those of all other parts.
        heads = coded.dictionary.take(pa.array(codes[starts])).dictionary_encode() if n else pa.array([], pa.large_string()).dictionary_encode()
        first = self._each(heads.dictionary.to_pylist()) + self._each(texts.filter(pa.array(whole)).to_pylist())
        inner = np.ones(len(codes), bool)
        inner[starts] = False
        seen = np.flatnonzero(np.bincount(codes[inner], minlength=len(coded.dictionary)))
        ids, at, many = self._stems(coded.dictionary.take(pa.array(seen)))
        sizes = np.array([len(x) for x in first], np.int64)
        at = np.concatenate([at, len(ids) + np.cumsum(sizes) - sizes])
        many, ids = np.concatenate([many, sizes]), np.concatenate([ids, *first])
        number = np.zeros(len(coded.dictionary), np.int64)
        number[seen] = np.arange(len(seen))
        head = len(seen) + heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        head[whole] = len(seen) + len(heads.dictionary) + np.arange(int(whole.sum()))
        out, ends = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for some in np.split(np.arange(n), np.flatnonzero(np.diff(np.cumsum(counts) >> 19)) + 1) if n else ():  # some texts at a time
            order = number[codes[ragged(starts[some], counts[some])]]
            begin = np.cumsum(counts[some]) - counts[some]
            order[begin] = head[some]
            size = many[order]
            out.append(ids[ragged(at[order], size)])
            ends.append(ends[-1][-1] + np.cumsum(np.add.reduceat(size, begin)))
        return np.concatenate(out), np.concatenate(ends)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.column(pa.array([text], pa.large_string()))[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


SEGMENTS = "shard int, seg int, first_token long, n_tokens long, doc_ids array<long>, doc_lens array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Encode (doc_id, text) and write segments in ascending doc_id order; shard k holds the k-th range of doc_ids."""

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        seg = first = held = 0
        ids, lens, parts = [], [], []

        def close():
            nonlocal seg, first, held
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seg], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([ids[:]], pa.list_(pa.int64())), pa.array([lens[:]], pa.list_(pa.int64())), pa.array([dac_encode(np.concatenate(parts))], pa.binary())],
                names=["shard", "seg", "first_token", "n_tokens", "doc_ids", "doc_lens", "payload"],
            )
            first, seg, held = first + held, seg + 1, 0
            ids.clear(), lens.clear(), parts.clear()
            return out

        for chunk in chunks(batches, CHUNK, 1):
            got, at = encode.column(chunk.column(1))
            for doc_id, a, b in zip(chunk.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if held and held + b - a + 1 > segment:
                    yield close()
                ids.append(doc_id), lens.append(b - a + 1)
                parts += [got[a:b], end]
                held += b - a + 1
        if held:
            yield close()

    spark = prepare(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(write, SEGMENTS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Dac(row["payload"]).decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(row["doc_lens"])])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["first_token"]), pa.array(row["doc_lens"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = prepare(spark).read.schema(SEGMENTS).parquet(path)
    # One row a shard: bounded by the number of partitions, whatever the input.
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    docs = files.mapInArrow(read, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


class TokenFiles:
    """Random access to the ids of token files by their place in the order of all documents: ``TokenFiles(spark, path)[i]``.

    The directory that the driver holds has a row a shard: bounded by the number of partitions. An access reads the one segment
    that holds the place, by a filter on the files' statistics, and of its payload a byte, a bit and a rank a level.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.files = spark.read.schema(SEGMENTS).parquet(path)
        rows = sorted((r["shard"], r["n"]) for r in self.files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
        self.shards = [s for s, _ in rows]
        self.ends = np.cumsum([n for _, n in rows], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.ends, i, side="right"))
        i -= int(self.ends[k - 1]) if k else 0
        here = self.files.where((F.col("shard") == self.shards[k]) & (F.col("first_token") <= i) & (F.col("first_token") + F.col("n_tokens") > i))
        row = here.select("first_token", "payload").head()
        return Dac(row["payload"])[i - row["first_token"]]


def token_output(docs: DataFrame) -> DataFrame:
    """Write the token files of documents to the shared folder and return their per-document digest."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
