"""The pipeline against a brute-force version of its decisions."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from test_near import brute_components, brute_fingerprint  # noqa: E402
from test_tokens import check_packing  # noqa: E402

from marketlens.llm import toxicity as X  # noqa: E402
from marketlens.llm.secrets import ALPHABET  # noqa: E402


def test_stages_keep_the_right_documents(spark, sf, duck, tmp_path):
    from marketlens.llm.quality_rules import rules_sql
    from marketlens.llm.secrets import scan_sql

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # quality, in SQL
    one = P.quality(spark, docs, sf).cache()
    want = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, left_text FROM ({rules_sql()}) WHERE kept").fetchall()}
    assert {r["doc_id"]: r["text"] for r in one.collect()} == want and one.columns == list(P.COLUMNS)
    # toxicity, document by document
    two = P.toxic(spark, one, sf).cache()
    model = X.fit(one, labels)
    tame = {d for d, t in want.items() if model.probability(model.evidence(*model.passages(t))) < 0.5}
    assert {r["doc_id"] for r in two.collect()} == tame
    # near duplicates, all pairs
    three = P.near_dups(spark, two, sf).cache()
    ids = sorted(tame)
    parts = brute_components([brute_fingerprint(want[d]) for d in ids])
    assert {r["doc_id"] for r in three.collect()} == {ids[c] for c in parts}
    # secrets, in SQL
    four = P.secret(spark, three, sf).cache()
    three.toPandas().to_parquet(path := str(tmp_path / "three.parquet"))
    marks = dict(duck.sql(f"SELECT doc_id, spans FROM ({scan_sql(chr(39) + path + chr(39))})").fetchall())
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        text, spans = before[r["doc_id"]], sorted(tuple(map(int, s.split(":")[1:])) for s in marks[r["doc_id"]].split(",") if s)
        merged = []
        for s, e in spans:
            if merged and merged[-1][1] >= s:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            text = text[:s] + "[SECRET]" + text[e:]
        assert r["text"] == text and r["n_chars"] == len(text)
    # packing
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    rows = P.run(spark, sf).collect()
    numbered = {d: i for i, d in enumerate(sorted(texts))}
    assert {r["doc_id"] for r in rows} == set(texts)
    check_packing([_Row(r.asDict() | {"doc_id": numbered[r["doc_id"]]}) for r in rows], [texts[d] for d in sorted(texts)], 1024)


class _Row(dict):
    def asDict(self):  # noqa: N802
        return dict(self)


def test_empty_and_odd_documents(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "tiny", None, None, None), (2, "tiny", None, None, None), (3, "w " * 100_000, "en", "s", 7), (4, " ".join(f"w{i}" for i in range(200)), None, None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert {r["doc_id"] for r in docs.collect()} == {4}
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_repeated_rows_and_clashing_columns_reach_every_stage(spark, sf):
    """Copies under one id and under others, a very long candidate, and columns named like the operators' own."""
    r = random.Random(2)
    prose = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(k))
    one, other, long = prose(300), prose(300), prose(200) + " " + "".join(r.choice(ALPHABET) for _ in range(300_000)) + " " + prose(200)
    rows = [(5, one), (5, one), (6, one), (7, other), (None, one), (8, other + " token=abcdefgh12345"), (9, long), (10, "x " * 300_000)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), 1.5, 2, "a", [3]) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, fp int, salt string, _all array<int>")
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.collect()
    ids = lambda name: sorted((x["doc_id"] for x in seen[name]), key=str)
    assert ids("quality") == ids("toxicity") == sorted([5, 5, 6, 7, None, 8, 9], key=str)
    assert ids("near_dups") == sorted([5, 7, None, 9], key=str) or ids("near_dups") == sorted([5, 7, 8, None, 9], key=str)
    texts = {x["doc_id"]: x["text"] for x in seen["secrets"]}
    assert "[SECRET]" in texts[9] and len(texts[9]) < 4000 and texts[5] == one
    assert sorted({x["doc_id"] for x in seen["pack"]}, key=str) == ids("near_dups")


def test_stages_delete_what_no_later_one_reads(spark, sf):
    import os

    from marketlens.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(os.path.dirname(folder)) if f.endswith(".parquet")} | {f for f in os.listdir(folder) if f.endswith(".parquet")}
    P.run(spark, sf).count()
    after = {f for f in os.listdir(os.path.dirname(folder)) if f.endswith(".parquet")} | {f for f in os.listdir(folder) if f.endswith(".parquet")}
    assert len(after - before) == 1
