"""BPE by merge replay and packing, against the libraries and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from marketlens.llm import bpe, packing  # noqa: E402

TEXTS = ["", None, "  ", " ", "a  b   c\n\n d \n", "aaaa aaaaaaaaaa\t\t x", "it's we'll  'sx <|endoftext|> 日本語 😀😀", "\n \n", "x \n y", " lead", "trail ", "trail  ", "a\n b", "a \tb", "123abc456 --- !!!", "the" * 300, "z" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.replay.ranks, special_tokens={})


def same(encoder, reference, texts):
    for t, (n, joined, decoded) in zip(texts, encoder.encode(texts), strict=True):
        ids = reference.encode_ordinary(t or "")
        assert (n, joined, decoded) == (len(ids), " ".join(map(str, ids)), (t or "").encode()), repr(t)


def test_ids_equal_the_librarys(encoder, tiktoken_encoding):
    same(encoder, tiktoken_encoding, TEXTS)
    r = random.Random(1)
    same(encoder, tiktoken_encoding, ["".join(r.choice("ab \n\té1.'s") for _ in range(r.randint(0, 40))) for _ in range(2000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(encoder, tiktoken_encoding, texts):
    same(encoder, tiktoken_encoding, texts)


def test_a_small_cache_gives_the_same(encoder, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "BLOCK", 20)
    same(encoder, tiktoken_encoding, TEXTS * 2)


def test_a_lower_rank_made_by_a_merge_goes_first():
    """ranks where merging b and c makes a + bc, which ranks below bc."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"bc": 400, b"aa": 350}
    replay = bpe.Replay(ranks)

    def alone(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)), default=(10**9, 0))
            if best[0] == 10**9:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    words = [b"abcabc", b"xbcbcabc", b"aaabc", b"aaaa", b"aabcaabc", b"bcbcbc"]
    assert replay.encode(words) == [alone(w) for w in words]


def test_encode_documents(spark, tiktoken_encoding):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "a b", "x")] * 2, "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, path, public_tokenizers.PATTERN, ids=True).collect()}
    assert len(got) == len(TEXTS) + 1
    assert all(got[i]["ids"] == tiktoken_encoding.encode_ordinary(t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode_documents(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_the_corpus_table_changes_nothing(spark, tiktoken_encoding, monkeypatch):
    """Pieces replayed once for the corpus, none of them, and some; ties at the limit go together."""
    r = random.Random(4)
    words = ["alpha", "beta,", "gamma\nDelta", "don't", "x", "", "日本"] + [f"w{i}" for i in range(50)]
    texts = TEXTS + [" ".join(r.choice(words[: r.randint(1, len(words))]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = {i: tiktoken_encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {}
    for t in texts:
        for p in (t or "").split(" "):
            counts[p] = counts.get(p, 0) + 1
    sizes = []
    for head in (bpe.HEAD, 12, 0):
        got = {x["piece"] for x in bpe.frequent_pieces(df, head).collect()}
        sizes.append(len(got))
        assert len(got) <= head and all(counts[p] >= bpe.LEAST for p in got)
        assert not got or min(counts[p] for p in got) > max([n for p, n in counts.items() if p not in got and n >= bpe.LEAST], default=0)
        assert {x["doc_id"]: x["ids"] for x in bpe.encode_documents(df, path, public_tokenizers.PATTERN, ids=True, head=head).collect()} == want
    assert sizes[0] == sum(n >= bpe.LEAST and len(p) <= bpe.PIECE_CHARS for p, n in counts.items()) > sizes[1] >= sizes[2] == 0
    table = bpe.replayed(spark.createDataFrame([("alpha",), ("",), ("a\nb",)], "piece string"), path, public_tokenizers.PATTERN).collect()
    assert all(x["ids"].split() == list(map(str, tiktoken_encoding.encode_ordinary(" " + x["piece"]))) and x["decoded"] == (" " + x["piece"]).encode() for x in table)


def test_long_pieces_are_not_kept(encoder, tiktoken_encoding):
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefgh") for _ in range(20_000)) + " x\n" + "y" * 5000 + "\n" + "z" * 300 + " " + "!" * 4000 + " w" + "?" * 200 for _ in range(5)]
    same(encoder, tiktoken_encoding, texts)
    same(encoder, tiktoken_encoding, texts)
    assert all(len(p) <= bpe.PIECE_CHARS for kept in (encoder.words, encoder.known) for p in kept)
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [x[:-1].tolist() for x in library_ids(texts)]
    assert all(len(p) <= packing.PIECE_CHARS for kept in (ids.known, ids.lines, ids.tails) for p in kept)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array([*e.ids, packing.END_ID], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def same_ids(ids, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [x[:-1].tolist() for x in library_ids(texts)]


def test_packing_learns_words_and_marks_not_their_products():
    """The library gets a word once whatever marks or words stand around it, and what is kept grows with words plus marks."""
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    words, marks = [f"{a}{b}é" for a in ("uno", "zwei", "trois") for b in "abcdefgh"], [".", ",", "!", ";", "?!", ")"]
    texts = ["x " + " ".join(w + m for w in words for m in marks)]
    same_ids(ids, texts)
    assert len(ids.known) == len(words) and len(ids.tails) == len(marks) + 1  # and the beginning of the text
    given, library = [], ids.tokenizer
    ids.tokenizer = type("Seen", (), {"encode_batch_fast": lambda self, texts, **options: given.extend(texts) or library.encode_batch_fast(texts, **options)})()
    same_ids(ids, texts * 2)
    same_ids(ids, ["x " + " ".join(w + m for w in reversed(words) for m in reversed(marks))])
    assert not given


def test_packing_reads_a_sliced_column_with_nulls():
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["left out", "é, ü\nß", None, "", "a  b"]
    for kind in (pa.string(), pa.large_string()):
        assert ids.encode(pa.array(texts, kind).slice(1)) == ids.encode(texts[1:])
    assert ids.encode(pa.array([], pa.string())) == ids.encode([]) == [] and ids.encode([None, ""]) == [b"", b""]
    same_ids(ids, texts)


CHARACTERS = ["a", "Z", "é", "ß", "×", "÷", "Ж", "҂", "日", "ª", "\u0301", "1", ".", "'", "'s", "'ll", "“", "😀", " ", " ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "<|endoftext|>"]


@pytest.fixture(scope="module")
def packing_ids():
    return packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CHARACTERS), max_size=30).map("".join) | st.text(max_size=20), max_size=8), st.sampled_from((1, 20, 10_000)), st.sampled_from((1, 30)))
def test_packing_ids_of_any_text(packing_ids, texts, block, cache):
    was, packing.BLOCK, packing_ids.cache = packing.BLOCK, block, cache
    try:
        same_ids(packing_ids, texts)
    finally:
        packing.BLOCK = was


def check_packing(rows, texts, capacity):
    rows = [r.asDict() for r in rows]
    ids = library_ids(texts)
    for doc, own in enumerate(ids):
        parts = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(own) // capacity)))
        assert all(p["length"] == capacity for p in parts[1:])
        at = 0
        for p in parts:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(own[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_cuts_and_fills(spark):
    r = random.Random(3)
    texts = [*TEXTS, *(" ".join(r.choice(("uno", "zwei", "trois", "four,", "five.\nSix")) for _ in range(r.randint(0, 900))) for _ in range(120)), "word " * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for capacity in (64, 1024):
        rows = packing.pack_documents(df, path, capacity, keep=capacity == 64).collect()
        n = check_packing(rows, texts, capacity)
        least = -(-sum(x["length"] for x in rows) // capacity)
        assert least <= n <= least * 1.02 + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(7, "same words")] * 300 + [(None, "x")] * 3, "doc_id long, text string")
    rows = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 16).collect()
    assert len(rows) == 303 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 303


def test_packing_plans_and_groups_give_one_result(spark, monkeypatch):
    """A table of ranges too large to broadcast, groups of a few rows, and a limit on documents."""
    texts = ["same words"] * 200 + [f"w{i} " * (i % 30) for i in range(200)]
    df = spark.createDataFrame([(i if i >= 100 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = packing.cut(packing.pieces_of(df, public_tokenizers.path("byte_bpe_50k.json"), 32))
    counts = []
    for limit, group in ((500_000, 100_000), (0, 100_000), (500_000, 7)):
        monkeypatch.setattr(packing, "GROUP_ROWS", group)
        rows = packing.pack(pieces, 32, broadcast_ranges=limit, max_docs=5).collect()
        at, docs = {}, {}
        for r in rows:
            at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in at.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 32 and len(parts) <= 5
        counts.append((len(rows), len(at)))
    assert len(set(counts)) == 1 and counts[0][0] == pieces.count()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=12), st.sampled_from(["norm", "dot"]), st.integers(1, 50), st.integers(300, 2500))
def test_plan_holds_every_constraint(histogram, score, max_docs, max_cost):
    if any(n * n > max_cost for n in histogram):
        with pytest.raises(ValueError, match="exceeds"):
            packing.plan(histogram, 50, max_docs, max_cost, score)
        return
    bins, seen = {}, {n: 0 for n in histogram}
    for length, low, high, each, first, offset in packing.plan(histogram, 50, max_docs, max_cost, score):
        assert low == seen[length]
        seen[length] = high
        for k in range(high - low):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert seen == histogram
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50 and len(parts) <= max_docs and sum(n * n for _, n in parts) <= max_cost


def best_fit_alone(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: (bins[i] - n, i))] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_needs_no_more_bins_than_best_fit(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan(histogram, 40, score="norm", weights=(1.0, 0.0, 0.0))
    used = max((first + -(-(high - low) // each) for _, low, high, each, first, _ in plan), default=0)
    assert used <= best_fit_alone(lengths, 40)
