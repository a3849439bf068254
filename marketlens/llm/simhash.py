"""SimHash near-duplicates (operator 7): Golay-code fuzzy hashing.

A 64-bit fingerprint is split into three segments (22, 21 and 21 bits), each padded to a word of the perfect binary
Golay code (23, 12). A word's keys are the indices of all codewords within distance 4 of it: one if the word is within
2 of its codeword, else six. Two words at distance 2 or less have a word between them at distance 1 or less from both,
whose codeword is within 4 of both: they share a key. Of `max_bits` = 4 differing bits over three segments, the two
segments with the fewest have 2 or fewer in sum, so 2 or fewer each: linked fingerprints share a joint key of two
segments. Every distinct fingerprint is sent under its joint keys (3 pairs, up to 36 keys each), and each bucket's
fingerprints are verified by their differing bits.

Exact copies share a fingerprint and are one row from the start. A bucket gives links enough to connect it, not all
its pairs: a breadth-first scan compares a linked fingerprint only with those of the bucket that are not linked yet, so
a dense group costs about its size. What a bucket returns is at most a link for each of its fingerprints. Buckets are
read in sorted order, eight bytes a fingerprint; components come from alternating large-star and small-star rounds over
the links, each cut by a checkpoint, until nothing changes. Joins on a fingerprint, a node or a component count the rows
of each key first: keys with more than one in HOT of all rows, fewer than HOT of them, are joined by broadcast, so that
a text with a third of all rows as copies, or a component with a third of all fingerprints, is no task of its own.

Defined results: a null or empty text, or one without words, has the fingerprint zero; a null doc_id takes part as text
but is never a component's name (its component_id is the smallest id in reach, or null); repeated rows get equal
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, importable

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: A key with more than one in so many of all rows is hot; there are fewer than so many.
HOT = 1000
#: Edges of a checkpoint file between rounds.
EDGES_PER_FILE = 250_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


def _syndromes() -> np.ndarray:
    """The remainder of every 23-bit word by the generator."""
    words = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
    return words.astype(np.int16)


class Golay:
    """Keys of 23-bit words: indices of the codewords within distance 4."""

    def __init__(self):
        self.syndrome = _syndromes()
        # For each syndrome the error patterns of weight 4 or less: one of weight 3 or less, and five of weight 4 if that is 3.
        patterns: dict[int, list[int]] = {}
        ones = [1 << i for i in range(23)]
        level = [0]
        for weight in range(5):
            for p in level:
                patterns.setdefault(int(self.syndrome[p]), []).append(p)
            level = [p | b for p in level for b in ones if b > p] if weight < 4 else []
        self.count = np.zeros(2048, np.int64)
        self.errors = np.zeros((2048, 6), np.int64)
        for s, ps in patterns.items():
            self.count[s] = len(ps)
            self.errors[s, : len(ps)] = ps

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of shape (n, 6), how many of them each word has); a codeword's index is its upper 12 bits."""
        s = self.syndrome[words]
        return (words[:, None] ^ self.errors[s]) >> 11, self.count[s]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def joint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in fps): every joint key of every fingerprint."""
    code = golay()
    own = [code.keys(((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for at, bits in SEGMENTS]
    keys, rows = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for i in range(6):
            for j in range(6):
                has = np.flatnonzero((own[a][1] > i) & (own[b][1] > j))
                keys.append(pair << 24 | own[a][0][has, i] << 12 | own[b][0][has, j])
                rows.append(has)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only the six ASCII breaks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _send_keys(batches):
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 5000):
            part = fps[at : at + 5000]
            keys, rows = joint_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], ["key", "fp"])


def _near(fp: np.uint64, others: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(others ^ fp) <= max_bits


def bucket_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[list, list]:
    """Links (a, b) that connect what is connected within a bucket of distinct fingerprints."""
    a, b = [], []
    rest = np.sort(fps)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            fp = todo.pop()
            near = _near(fp, rest, max_bits)
            if near.any():
                found = rest[near]
                a += [fp] * len(found)
                b += found.tolist()
                todo += list(found)
                rest = rest[~near]
    return a, b


def _links(max_bits: int):
    """Over (key, fp) sorted by key: (a, b) links within each key."""

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def solve(keys, fps):
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.concatenate((first, [len(keys)])))
            a, b = [], []
            small = np.repeat(size <= 8, size)  # all pairs of small buckets at once
            for d in range(1, 8):
                if d >= len(keys):
                    break
                i = np.flatnonzero(small[:-d] & (keys[:-d] == keys[d:]))
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
                a.append(fps[i])
                b.append(fps[i + d])
            for at, n in zip(first[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                x, y = bucket_links(fps[at : at + n], max_bits)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
            a = np.concatenate(a) if a else np.empty(0, np.uint64)
            b = np.concatenate(b) if b else np.empty(0, np.uint64)
            links = np.unique(np.stack((a, b), 1), axis=0)  # many keys show the same link
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy().view(np.int64)), pa.array(links[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            open_from = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if open_from:
                held.append((k[:open_from], f[:open_from]))
            if open_from and sum(len(x[0]) for x in held) > 50_000 or open_from and len(held) > 1:
                keys, fps = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                yield solve(keys, fps)
                held = []
            elif open_from:
                yield solve(*held.pop())
            held.append((k[open_from:], f[open_from:]))
        if held:
            yield solve(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return run


def links_of(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the fingerprints (fp, distinct) of which any two with max_bits differing bits are linked."""
    if max_bits > MAX_BITS:
        raise ValueError(f"three segments find at most {MAX_BITS} differing bits")
    sent = distinct.select("fp").mapInArrow(_send_keys, "key long, fp long")
    dealt = sent.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key with the number n of rows of left that have it, `total` in all."""
    is_hot = F.col("n") * HOT > total
    hot, cold = right.filter(is_hot).drop("n"), right.filter(~is_hot).drop("n")
    hot = F.broadcast(hot)  # fewer than HOT rows, as their n sum to total at most
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node but the smallest of its component, which is its root."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n = edges.count()
    while True:  # alternating stars settle in a number of rounds of the order of log^2 of the nodes
        # Large star: neighbours above a node go to its smallest neighbour (or to itself).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.filter("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(new.coalesce(1 + n // EDGES_PER_FILE))  # rounds never add edges
        before, n = n, new.count()
        same = n == before and not new.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if same:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text)."""
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    n_rows, n_classes = fps.count(), classes.count()
    found = components(links_of(classes, max_bits))
    named = cut(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = spread_join(named.select("fp", "root", "copies"), names, "root", n_classes).select("fp", "component_id", F.col("copies").alias("n"))
    return spread_join(fps, by_fp, "fp", n_rows).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs of which each component keeps one: that of its smallest doc_id (one of them, if rows repeat it).
    Rows without a doc_id pass: no decision can name them."""
    found = near_duplicates(docs.select("doc_id", "text"), max_bits)
    ids = cut(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")).filter("doc_id <> component_id OR n > 1"))
    gone = ids.filter("doc_id <> component_id").select("doc_id")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti")
    again = ids.filter("n > 1 AND doc_id = component_id").select("doc_id")
    if again.limit(1).count():
        one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
