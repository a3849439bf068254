"""Byte-level BPE encoding and decoding (operator 4): corpus-level merge replay.

The pieces of the whole corpus (what stands between spaces) are counted in one aggregation. The frequent ones, at most
HEAD of them by a level of their counts, are dealt to tasks, and each task replays the merges over all words of its
pieces at once: an inverted index leads from a token pair to the places (word, token) where it stands, a heap gives the
pairs in rank order, and a merge touches only its two neighbours in the index. If a merge makes a pair of lower rank
than the one in hand, the rest of that word waits until the lower one is done, so that every word comes out as if it
were encoded alone. This table, whose size is bounded by HEAD and PIECE_CHARS, goes to every task that encodes
documents. Pieces beyond it, which a corpus of any size holds few times each, are replayed in the same way by the block
of documents that has them, and kept for later blocks in a bounded cache. A document's ids are those of its words. Only
distinct pieces are shuffled; memory is a block, the table and the cache, and a lost task is simply run again. With
`head` 0 there is no table and nothing is shuffled: every piece is replayed by the blocks. The query does that, as the
count of pieces and the table need more than 3,000 MB of an executor (README).

Texts are cut before each space that does not stand between white space; no match of the pattern crosses such a cut, so
a piece always gives the same matches. Texts with other runs of white space around a space are matched whole.

Defined results: a null text counts as empty; an empty text has no ids (n_tokens 0, hashes of the empty string);
repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import cut, importable, slices, uncollected

#: Pieces beyond the table, and words, kept by a Python worker; beyond that only those of the last block stay.
CACHE = 500_000
#: Pieces of the table; pieces met fewer than LEAST times are never in it. Longer pieces than PIECE_CHARS are not kept.
HEAD, PIECE_CHARS, LEAST = 400_000, 64, 8
#: Characters of a block of documents.
BLOCK = 12_000_000
UNSAFE = regex.compile(r"\s \s|\s $")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes sets of words by replaying merges over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.shift = len(self.tokens).bit_length()
        #: Every pair of tokens that makes a token, as left << shift | right, and the rank of what it makes.
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs of tokens, -1 where there is none (a token below 0 is a word's end)."""
        key = left << self.shift | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = list(map(self.ranks.get, words))
        out: list[list[int]] = [[x] for x in whole]
        rest = [n for n, x in enumerate(whole) if x is None]
        if not rest:
            return out
        # The tokens of the remaining words, with a -1 before and after each.
        raw = np.frombuffer(b"\0".join([b"", *(words[n] for n in rest), b""]), np.uint8)
        size = np.array([len(words[n]) for n in rest])
        ends = np.concatenate(([0], np.cumsum(size + 1)))
        ids = self.byte[raw]
        ids[ends] = -1
        after = np.arange(1, len(ids) + 1)
        before = np.arange(-1, len(ids) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            places, ranks = places[keep], ranks[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            bounds = [*first.tolist(), len(ranks)]
            for i, rank in enumerate(ranks[first].tolist()):
                own = index.get(rank)
                if own is None:
                    index[rank] = [places[bounds[i] : bounds[i + 1]]]
                    heappush(heap, rank)
                else:
                    own.append(places[bounds[i] : bounds[i + 1]])

        add(np.arange(len(ids) - 1), self.ranks_of(ids[:-1], ids[1:]))
        while heap:
            rank = heappop(heap)
            own = index.pop(rank, None)
            if own is None:
                continue
            at = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
            gone = after[at]
            good = self.ranks_of(ids[at], ids[gone]) == rank  # elsewhere a neighbour was merged meanwhile
            if not good.all():
                at, gone = at[good], gone[good]
                if not len(at):
                    continue
            if len(at) > 1 and (touch := at[1:] == gone[:-1]).any():  # overlapping places: the leftmost goes first
                keep, free = np.ones(len(at), bool), True
                for i in np.flatnonzero(touch).tolist():
                    free = keep[i]
                    keep[i + 1] = not free
                at, gone = at[keep], gone[keep]
            beyond, near = after[gone], before[at]
            left, right = self.ranks_of(ids[near], np.full(len(at), rank)), self.ranks_of(np.full(len(at), rank), ids[beyond])
            low = ((left >= 0) & (left < rank)) | ((right >= 0) & (right < rank))
            if low.any():  # a lower rank appears: in those words merge the first place only, the others wait
                word = np.searchsorted(ends, at)
                first = np.concatenate(([True], word[1:] != word[:-1]))
                keep = first | ~np.isin(word, word[low])
                add(at[~keep], np.full((~keep).sum(), rank))
                at, gone, beyond, near = at[keep], gone[keep], beyond[keep], near[keep]
            ids[gone] = -2
            ids[at] = rank
            after[at] = beyond
            before[beyond] = at
            near = before[at]
            beyond = after[at]
            places = np.concatenate((near, at))
            add(places, self.ranks_of(ids[places], np.concatenate((ids[at], ids[beyond]))))
        left = ids[ids >= -1]
        bounds = np.flatnonzero(left == -1).tolist()
        left = left.tolist()
        for i, n in enumerate(rest):
            out[n] = left[bounds[i] + 1 : bounds[i + 1]]
        return out


_replays: dict[str, Replay] = {}


class Encoder:
    """Ids of whole texts. What a piece of text gives is (number of ids, " id id ...", decoded bytes)."""

    def __init__(self, path: str, pattern: str, head: dict[str, tuple[int, str, bytes]] | None = None):
        if path not in _replays:
            _replays[path] = Replay(read_ranks(path))
        self.replay = _replays[path]
        self.head = head or {}
        self.text = [f" {i}" for i in range(len(self.replay.tokens))]
        self.find = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.known = dict(self.head)  # by what follows a space

    def learn(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """What pieces give; their words go to the cache."""
        find = self.find
        split = [find(p) for p in pieces]
        words = self.words
        distinct = set().union(*split)
        new = list(distinct.difference(words))
        text, token = self.text.__getitem__, self.replay.tokens.__getitem__
        for word, ids in zip(new, self.replay.encode([w.encode() for w in new]), strict=True):
            words[word] = (len(ids), "".join(map(text, ids)), b"".join(map(token, ids)))
        out = []
        for ws in split:
            if len(ws) == 2:
                (n, t, d), (m, u, e) = words[ws[0]], words[ws[1]]
                out.append((n + m, t + u, d + e))
                continue
            got = words[ws[0]] if ws else (0, "", b"")
            for w in ws[1:]:
                n, t, d = words[w]
                got = (got[0] + n, got[1] + t, got[2] + d)
            out.append(got)
        for w in new:
            if len(w) > PIECE_CHARS:
                del words[w]
        if len(words) > CACHE:
            self.words = {w: words[w] for w in distinct if w in words}
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by one space, decoded bytes) of each text."""
        out = []
        with uncollected():
            for block in blocks(texts):  # the distinct new words of a block are encoded together
                split = [[t] if UNSAFE.search(t) else t.split(" ") for t in block]
                heads = self.learn([pieces[0] for pieces in split])
                for pieces in split:
                    del pieces[0]
                known = self.known
                distinct = set().union(*split)
                new = list(distinct.difference(known))
                known.update(zip(new, self.learn([" " + p for p in new]), strict=True))
                get = known.__getitem__
                for first, pieces in zip(heads, split, strict=True):
                    n, ids, decoded = zip(first, *map(get, pieces), strict=True)
                    out.append((sum(n), "".join(ids)[1:], b"".join(decoded)))
                for p in new:
                    if len(p) > PIECE_CHARS:
                        del known[p]
                if len(known) > len(self.head) + CACHE:
                    self.known = self.head | {p: known[p] for p in distinct if p in known}
        return out


def blocks(texts: list[str]):
    """Runs of texts of about BLOCK characters; a longer text is a block of its own."""
    own, size = [], 0
    for t in texts:
        t = t or ""
        if own and size + len(t) > BLOCK:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str, name: str = "", head=None) -> Encoder:
    """One a Python worker and table (by its name), kept between its tasks. head: a broadcast table."""
    if (path, pattern, name) not in _encoders:
        _encoders.clear()
        columns = [c.to_pylist() for c in head.value.columns] if head is not None else [[]] * 4
        with uncollected():
            own = dict(zip(columns[0], zip(*columns[1:], strict=True), strict=True))
        _encoders[path, pattern, name] = Encoder(path, pattern, own)
    return _encoders[path, pattern, name]


def frequent_pieces(docs: DataFrame, most: int = HEAD, least: int = LEAST) -> DataFrame:
    """piece: the pieces that stand most often in the corpus, at most `most`; all whose counts are of one level (a
    quarter of a power of two) or none."""
    pieces = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), " ")).alias("piece")).filter(F.length("piece") <= PIECE_CHARS)
    counts = pieces.groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    levels = cut(counts.select("piece", F.floor(4 * F.log2("n")).alias("level")))
    from_level, total = 1 << 62, 0
    for r in levels.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # at most 256 rows
        total += r["n"]
        if total > most:
            break
        from_level = r["level"]
    return levels.filter(F.col("level") >= from_level).select("piece")


def replayed(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """piece, n, ids, decoded of what a space and a piece give; each task replays all its pieces at once."""

    def run(batches):
        own = [p for b in batches for p in b.column(0).to_pylist()]  # at most HEAD pieces of PIECE_CHARS
        if own:
            n, ids, decoded = zip(*encoder(path, pattern).learn([" " + p for p in own]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())], ["piece", "n", "ids", "decoded"])

    return pieces.repartition("piece").mapInArrow(run, "piece string, n long, ids string, decoded binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text); with `ids` the ids too."""
    spark = docs.sparkSession
    importable(spark)
    shared, name = None, ""
    if head:
        table = replayed(frequent_pieces(docs, head), path, pattern).toArrow()  # at most `head` pieces
        shared, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches):
        enc = encoder(path, pattern, name, shared)
        for b in slices(batches, 4000):
            n, ids_sha, decoded_sha, own = [], [], [], []
            for count, joined, decoded in enc.encode(b.column(1).to_pylist()):
                n.append(count)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    own.append([int(x) for x in joined.split()])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, head=0)
