"""Best-fit packing (operator 9): vector best-fit of document pieces into sequences.

Documents are tokenised, end with an end id, and are cut into pieces only where longer than a sequence; the first piece
takes the remainder. Pieces of one length are interchangeable, so the packing itself runs on the histogram of lengths,
which has at most `capacity` entries whatever the number of documents. Bins of equal residual capacities are kept as one
class with a count: for each length, longest first, the class with the best score that the piece fits under every
constraint (tokens, documents, attention cost as the sum of squared lengths) takes as many as fit, then the next; what
remains opens new bins. The score is the smallest residual norm or the largest weighted dot product of demand and
residual, in parts of the capacities. The plan is a list of ranges "pieces a..b of length n go to sequences from s on",
and every piece finds its place by its rank among the pieces of its length. Ranks are counted within (length, salt)
groups, with as many salts as keep a group under GROUP_ROWS, so a frequent length is not one task's work.

Defined results: a null or empty text is the end id alone; a document of exactly `capacity` ids is one whole piece;
repeated rows are pieces of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, slices

CAPACITY = 1024
END_ID = 2
#: Pieces of text kept by a Python worker; beyond that only those of the last block stay.
CACHE = 1_200_000
#: Longer pieces are not kept.
PIECE_CHARS = 64
#: Bytes of a block of texts; a longer text is a block of its own.
BLOCK = 12_000_000
MARKS = string.punctuation
#: White space of Unicode, and what Python counts as such.
BLANKS, WIDE_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f ", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: New pieces that the library gets as one text.
RUN = 2000
GROUP_ROWS = 100_000


class Ids:
    """Little-endian unsigned 32-bit ids of whole texts, by the tokenizers library.

    A text is cut where the pre-tokeniser begins a match whatever stands around: before a space or a line feed between
    two characters that are no white space, and between a letter and an ASCII mark. The library encodes each distinct
    piece once, and a text's ids are those of its pieces. Cuts, distinct pieces and ids are columns of a block; only
    what the library gets and gives is Python's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character of the byte alphabet is a byte
        self.cache = CACHE
        self.pieces = pa.array([], pa.large_string())  # those kept
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # the ids of piece k: ends[k] to ends[k + 1]

    @property
    def known(self) -> list[str]:
        """Kept pieces that begin with a space."""
        return [p for p in self.pieces.to_pylist() if p[0] == " "]

    @property
    def lines(self) -> list[str]:
        """Kept pieces that begin with a line feed."""
        return [p for p in self.pieces.to_pylist() if p[0] == "\n"]

    @property
    def tails(self) -> list[str]:
        """Other kept pieces: marks that end a word, and beginnings of texts."""
        return [p for p in self.pieces.to_pylist() if p[0] not in " \n"]

    def learn(self, new: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces, and how many each has. Pieces that begin with a space or a line feed and hold no other
        white space are encoded in long runs and told apart by the bytes their ids stand for."""
        led = pc.match_substring_regex(new, LED)
        ids, counts = [], np.zeros(len(new), np.int64)
        run = new.filter(led)
        data, bounds = _buffers(run)
        stops = []
        for at in range(0, len(run), RUN):
            own = bounds[at : at + RUN + 1]
            text = data[own[0] : own[-1]].tobytes().decode()
            ids.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            stops.append(np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids[-1]]), own[1:] - own[0], side="right"), prepend=0))
        led = led.to_numpy(zero_copy_only=False)
        counts[led] = np.concatenate([np.zeros(0, np.int64), *stops])
        alone = self.tokenizer.encode_batch_fast(new.filter(pa.array(~led)).to_pylist(), add_special_tokens=False)
        ids += [np.array(e.ids, "<u4") for e in alone]
        counts[~led] = [len(e.ids) for e in alone]
        order = np.argsort(~led, kind="stable")  # of the ids: first the runs, then those alone
        at = np.empty(len(new), np.int64)
        at[order] = np.arange(len(new))
        return _ragged(np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate(([0], np.cumsum(counts[order]))), at), counts

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "").cast(pa.large_string())
        data, bounds = _buffers(column)
        out: list[bytes] = []
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
            out += self._block(data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at])
            at = stop
        return out

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """data: the bytes of texts, one after another; bounds: where they begin, and the end of the last."""
        starts = piece_starts(data, bounds)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        coded = pa.chunked_array([self.pieces, pieces]).dictionary_encode().chunks  # kept pieces have their own numbers
        codes = coded[-1].indices.to_numpy() if len(starts) else np.zeros(0, np.int32)
        every = coded[-1].dictionary if coded else self.pieces
        if len(every) > len(self.pieces):
            ids, counts = self.learn(every.slice(len(self.pieces)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
            self.ids = np.concatenate((self.ids, ids))
        own = _ragged(self.ids, self.ends, codes)
        ends = np.concatenate(([0], np.cumsum(np.diff(self.ends)[codes])))[np.searchsorted(starts, bounds)].tolist()
        self._keep(every, codes)
        return [own[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _keep(self, every: pa.LargeStringArray, codes: np.ndarray) -> None:
        """Keep pieces for later blocks: not the long ones, and beyond `cache` only those of this block."""
        stay = np.ones(len(every), bool)
        stay[len(self.pieces) :] = pc.utf8_length(every.slice(len(self.pieces))).to_numpy() <= PIECE_CHARS
        if stay.sum() > self.cache:
            stay &= np.bincount(codes, minlength=len(every)) > 0
        if not stay.all():
            at = np.flatnonzero(stay)
            every = every.take(pa.array(at))
            self.ids, self.ends = _ragged(self.ids, self.ends, at), np.concatenate(([0], np.cumsum(np.diff(self.ends)[at])))
        self.pieces = every


def _buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where its rows begin in them, with the end of the last."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _ragged(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows, one after another; row k has those from ends[k] to ends[k + 1]."""
    first, size = ends[:-1][rows], np.diff(ends)[rows]
    stops = np.cumsum(size)
    at = np.repeat(first - stops + size, size)
    at += np.arange(len(at))
    return values[at]


LEAD, MARK, LETTER, BLANK = 1, 2, 3, 4
#: What a byte is: one of these, or 0.
KINDS = bytes({**dict.fromkeys(BLANKS, BLANK), **dict.fromkeys(" \n", LEAD), **dict.fromkeys(MARKS, MARK), **dict.fromkeys(string.ascii_letters, LETTER)}.get(chr(i), 0) for i in range(256))
#: White space beyond ASCII, by the two or three bytes of a character as one number.
WIDE = [[int.from_bytes(c.encode()) for c in WIDE_BLANKS if len(c.encode()) == n] for n in (2, 3)]
#: A lead and no other white space.
LED = rf"\A[ \n][^{''.join(f'\\x{{{ord(c):x}}}' for c in BLANKS + WIDE_BLANKS)}]+\z"


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; data and bounds as in Ids._block. A neighbour in another text decides nothing but
    a cut before a space or a line feed that is a text's last character, which is right in either case."""
    start = np.zeros(len(data) + 1, bool)
    start[bounds] = True
    own = b"".join((b"\0\0\0", data, b"\0\0\0"))
    byte, kind = np.frombuffer(own, np.uint8), np.frombuffer(own.translate(KINDS), np.uint8)

    at = np.flatnonzero(kind == LEAD)
    for near in ((-1, -2, -3), (1, 2, 3)):  # the last bytes of the character before, the first bytes of that after
        beside = kind[at + near[0]]
        blank = (beside == LEAD) | (beside == BLANK)
        far = np.flatnonzero(byte[at + near[0]] >= 0x80)
        for k, wide in zip((2, 3), WIDE, strict=True):
            character = sum(byte[at[far] + step].astype(np.int32) << 8 * (k - 1 - i) for i, step in enumerate(sorted(near[:k])))
            blank[far] |= np.isin(character, wide)
        at = at[~blank]
    start[at - 3] = True
    at = np.flatnonzero(kind == MARK)
    lead, last = byte[at - 2], byte[at - 1]
    # U+00C0 to U+017F and U+0400 to U+047F are letters but for the signs of times and division
    wide = ((lead >= 0xC3) & (lead <= 0xC5) | (lead == 0xD0) | (lead == 0xD1)) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    start[at[(kind[at - 1] == LETTER) | (last >= 0x80) & wide] - 3] = True
    return np.flatnonzero(start[:-1])


_tokenizers: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    """One a Python worker, kept between its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = Ids(path)
    return _tokenizers[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text).

    cache: pieces of text that a Python worker holds; a smaller one needs less memory and more time. keep: whether the
    worker holds them for its next tasks."""
    rows = 4000 if keep else 1000
    end = end_id.to_bytes(4, "little")

    def run(batches):
        ids = ids_by(path)
        ids.cache = cache
        for b in slices(batches, rows):
            out: list[tuple] = []
            for doc, own in zip(b.column(0).to_pylist(), ids.encode(b.column(1)), strict=True):
                own += end
                n = len(own) // 4
                start = 0
                stop = n % capacity or capacity
                k = 0
                while start < n:
                    out.append((doc, k, start, stop - start, zlib.crc32(own[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + capacity, k + 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep:
            _tokenizers.clear()
            give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) by vector best-fit, longest first.

    histogram: pieces of each length. max_docs and max_cost default to what the token capacity allows anyway.
    """
    full = (capacity, max_docs or capacity, max_cost or capacity * capacity)
    bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> (first sequence, count) ranges
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, full, strict=True)):
            raise ValueError(f"a piece of {length} ids exceeds the capacities {full}")

        def rank(residual):
            part = [w * (r - d) / c for w, r, d, c in zip(weights, residual, demand, full, strict=True)]
            if score == "norm":
                return (sum(x * x for x in part), residual)
            return (-sum(w * d * r / c / c for w, d, r, c in zip(weights, demand, residual, full, strict=True)), residual)

        todo, done = histogram[length], 0
        fits = sorted((r for r in bins if all(d <= x for d, x in zip(demand, r, strict=True))), key=rank)
        for residual in [*fits, full]:
            if not todo:
                break
            each = min(x // d for d, x in zip(demand, residual, strict=True))  # the best bin stays the best until it is full
            left = tuple(x - each * d for d, x in zip(demand, residual, strict=True))
            ranges = bins.pop(residual, []) if residual != full else [(sequences, -(-todo // each))]
            offset = capacity - residual[0]
            kept = []
            for first, count in ranges:
                if residual == full:
                    sequences += count
                whole = min(count, todo // each)
                if whole:
                    out.append((length, done, done + whole * each, each, first, offset))
                    bins.setdefault(left, []).append((first, whole))
                    done, todo = done + whole * each, todo - whole * each
                if whole < count and todo:  # fewer than one bin takes
                    out.append((length, done, done + todo, todo, first + whole, offset))
                    bins.setdefault(tuple(x - todo * d for d, x in zip(demand, residual, strict=True)), []).append((first + whole, 1))
                    whole, done, todo = whole + 1, done + todo, 0
                if whole < count:
                    kept.append((first + whole, count - whole))
            if kept:
                bins.setdefault(residual, []).extend(kept)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, broadcast_ranges: int = 500_000, **options) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); pieces should be stored, as they
    are read three times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, -(-max(counts.values(), default=0) // GROUP_ROWS), min(64, max(counts.values(), default=0) // 64))
    # The row's number deals equal rows to different groups; it is the same in each pass, as the pieces are stored.
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)))
    groups = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most capacity * salts groups: salts grows by one in GROUP_ROWS pieces.
    below = groups.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("local", local.cast("long")).join(below, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local"))
    places = plan(counts, capacity, **options)
    table = spark.createDataFrame(places, "length long, low long, high long, each long, first long, base long")
    if len(places) <= broadcast_ranges:  # a few for each length: bounded by the capacity, not by the rows
        table = F.broadcast(table)
    ranked = ranked.drop("base", "local", "salt").withColumnRenamed("length", "n")
    p = ranked.join(table, (F.col("n") == F.col("length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    return p.select(
        "doc_id", "piece", "start", F.col("n").alias("length"), "ids_crc32",
        (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(k, F.col("each")) * F.col("n")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = CACHE, keep: bool = True, **options) -> DataFrame:
    from .common import importable

    importable(docs.sparkSession)
    return pack(cut(pieces_of(docs, path, capacity, end_id, cache, keep)), capacity, **options)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
