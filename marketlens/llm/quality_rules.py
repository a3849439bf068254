"""Quality rules (operator 6): base statistics of a text, and the frequency of its lines across the documents of a host.

Native: DataFrame functions only. A document's host is its `source`. Lines are normalised (ASCII lower case, runs of
white space to one space, trimmed) and hashed; a line is frequent in a host if more distinct documents of the host hold
it than the host's limit: LINE_PERCENT of the host's distinct documents, but LEAST_DOCS at least and MAX_DOCS at most.
Documents are distinct if their sets of lines are, so exact copies count once and a group of them does not make its own
lines look like boilerplate; documents that differ in a line count each. Frequent lines are removed; a document is
depleted if less than `min_left` percent of its words remain.

Defined results: a null text counts as empty; an empty one has no words and fails the base rules; a null source is a
host of its own; repeated rows get equal results; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, IN_WORD, LOWER, UPPER, WORD_BREAK, cut, settled

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_DOCS, LEAST_DOCS, LINE_PERCENT = 100, 20, 10
MIN_LEFT_PERCENT = 30
SALTS = 16
#: Frequent lines of a host are kept in buckets of about so many, by their hash.
BUCKET = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(IN_WORD))


def line_key(line: Column) -> Column:
    """60 bits of the md5 of the normalised line."""
    norm = F.translate(F.trim(F.regexp_replace(line, WORD_BREAK, " ")), UPPER, LOWER)
    return F.conv(F.substring(F.md5(norm), 1, 15), 16, 10).cast("long")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def base_statistics(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to each row.

    Windows of three words are compared by a hash whose high bits share a long with the window's position, so that one
    primitive sort brings equal windows together; the cost is n log n in the words of a text. Windows of equal hashes
    are compared by their words: if any two neighbours differ, the text's windows are sorted by their words instead, so
    counts are exact. `bits` weakens the hash, for tests.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words_of(t)).withColumn("_l", lines_of(t))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("_bits", F.length(F.bin("n_words")))
    hashed = "xxhash64(get(_w, int(i)), get(_w, int(i + 1)), get(_w, int(i + 2)))"
    if bits < 64:
        hashed = f"shiftleft({hashed}, {64 - bits})"
    d = d.withColumn(
        "_s",
        F.expr(f"sort_array(CASE WHEN n_words < 4 THEN array() ELSE transform(sequence(0L, n_words - 3), i -> shiftleft(shiftright({hashed}, _bits), _bits) | i) END)"),
    )
    d = d.withColumn(
        "_q",
        F.expr(
            "filter(_s, (x, k) -> shiftright(x, _bits) = shiftright(get(_s, k - 1), _bits) "
            "OR shiftright(x, _bits) = shiftright(get(_s, k + 1), _bits))"
        ),
    )
    at = "int(({0} & (shiftleft(1L, _bits) - 1)) + {1})"
    unlike = " OR ".join(f"get(_w, {at.format('x', o)}) <> get(_w, {at.format('get(_q, k - 1)', o)})" for o in range(3))
    d = d.withColumn("_clash", F.expr(f"size(filter(_q, (x, k) -> k > 0 AND shiftright(x, _bits) = shiftright(get(_q, k - 1), _bits) AND ({unlike}))) > 0"))
    d = d.withColumn(
        "_e",
        F.expr("CASE WHEN _clash THEN array_sort(transform(sequence(0, int(n_words) - 3), i -> named_struct('w', slice(_w, i + 1, 3), 'i', bigint(i)))) END"),
    )
    d = d.withColumn(
        "_p",
        F.expr(
            "sort_array(CASE WHEN _clash THEN transform(filter(_e, (x, k) -> x.w = get(_e, k - 1).w OR x.w = get(_e, k + 1).w), x -> x.i) "
            "ELSE transform(_q, x -> x & (shiftleft(1L, _bits) - 1)) END)"
        ),
    )
    d = d.withColumn(
        "n_repeat_words",
        F.expr("aggregate(transform(_p, (x, k) -> least(3L, coalesce(get(_p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)"),
    )
    d = d.withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.drop("_w", "_s", "_q", "_clash", "_e", "_p", "_bits")


def _keys_of(docs: DataFrame) -> Column:
    return F.array_distinct(F.transform(lines_of(F.coalesce(F.col("text"), F.lit(""))), line_key))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, least_docs: int = LEAST_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """(host, line): the lines that more distinct documents of a host hold than its limit; stored, so that it is counted
    once. The line -1, which no hash is, stands in every document and so counts the host's."""
    least_docs = min(least_docs, max_docs)
    rows = docs.select(F.col("source").alias("host"), F.array_sort(_keys_of(docs)).alias("keys"))
    rows = rows.select("host", F.xxhash64("keys").alias("doc"), F.explode(F.array_append("keys", F.lit(-1).cast("long"))).alias("line"))
    once = rows.groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
    counts = cut(once.groupBy("host", "line").agg(F.count("one").alias("n_docs")).filter((F.col("n_docs") > least_docs) | (F.col("line") == -1)))
    limits = counts.filter("line = -1").select(F.col("host").alias("_host"), F.least(F.lit(max_docs).cast("double"), F.greatest(F.lit(least_docs).cast("double"), F.col("n_docs") * percent / 100)).alias("most"))
    found = counts.filter("line <> -1").join(limits, F.col("host").eqNullSafe(F.col("_host")))
    return found.filter("n_docs > most").select("host", "line")


def _by_host(frequent: DataFrame) -> DataFrame:
    """_host, _bad: each host's lines in buckets by hash, so that a line is looked up in a few."""
    n = frequent.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("n")).withColumnRenamed("host", "_host")
    dealt = frequent.join(n, F.col("host").eqNullSafe(F.col("_host"))).groupBy("_host", "n", F.pmod("line", F.col("n")).alias("b"))
    lists = dealt.agg(F.collect_list("line").alias("ls")).groupBy("_host", "n").agg(F.map_from_entries(F.collect_list(F.struct("b", "ls"))).alias("m"))
    return lists.select("_host", F.expr("transform(sequence(0L, n - 1), b -> coalesce(m[b], array()))").alias("_bad"))


def _with_removed(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds _bad: frequent lines to remove from the row, in buckets.

    A small set of frequent lines goes to every task, a row a host (the lines are counted). Beyond that the lines of
    each document are joined with it, a frequent line salted over SALTS keys.
    """
    frequent = cut(frequent)
    if frequent.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(_by_host(frequent)), docs["source"].eqNullSafe(F.col("_host")), "left").drop("_host")
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "source", "text"))
    lines = docs.select("_row", F.coalesce("source", F.lit("\0")).alias("host"), F.explode(_keys_of(docs)).alias("line"))
    lines = lines.withColumn("salt", F.pmod("_row", F.lit(SALTS)))
    salted = frequent.select(F.coalesce("host", F.lit("\0")).alias("host"), "line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    bad = lines.join(salted, ["host", "line", "salt"], "left_semi").groupBy("_row").agg(F.array(F.collect_set("line")).alias("_bad"))
    return docs.join(bad, "_row", "left").drop("_row")


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT_PERCENT, texts: bool = True, least_docs: int = LEAST_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, the base statistics, n_left_words, kept, and with `texts` also
    source, lang where given, and the text without frequent lines."""
    own = [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
    docs = docs.select(*own)
    d = _with_removed(docs, frequent_lines(docs, max_docs, least_docs, percent))
    d = base_statistics(d)
    listed = lambda x: F.exists(F.array(line_key(x)), lambda k: F.array_contains(F.get("_bad", F.pmod(k, F.size("_bad")).cast("int")), k))
    gone = F.filter("_l", listed)
    gone = F.when(F.col("_bad").isNull() | F.col("base_failed"), F.array().cast("array<string>")).otherwise(gone)
    d = d.withColumn("_gone", gone)
    lost = F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + n_words_of(x))
    d = d.withColumn("n_left_words", F.col("n_words") - lost)
    d = d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_left_words") >= min_left * F.col("n_words")))
    if texts:
        left = F.concat_ws("\n", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~(x.rlike(IN_WORD) & listed(x))))
        d = d.withColumn("text", F.when(F.size("_gone") > 0, left).otherwise(F.col("text")))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "kept"]
    return settled(d, [*(own if texts else ["doc_id"]), *stats])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = quality_rules(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_sql(source: str = "documents") -> str:
    """SQL with one row a document: the statistics, kept and the text that is left. Lines are compared as they are, not
    by a hash, and documents by their sorted sets of lines."""
    norm = f"translate(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM {source}),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM h WHERE n > 1) GROUP BY rid),
k AS (SELECT rid, source, list_sort(list_distinct(list_transform(l, lambda x: {norm}))) AS lines FROM d),
v AS (SELECT DISTINCT source, lines FROM k),
z AS (SELECT source, least({MAX_DOCS}, greatest({LEAST_DOCS}, count(*) * {LINE_PERCENT} / 100)) AS most FROM v GROUP BY source),
f AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(lines) AS line FROM v) GROUP BY source, line) c
  JOIN z ON z.source IS NOT DISTINCT FROM c.source WHERE n > most),
s AS (
  SELECT d.rid, doc_id, source, lang, text, l, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r ON r.rid = d.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
x AS (
  SELECT b.rid, sum(len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))::BIGINT AS lost, list(x) AS gone
  FROM (SELECT rid, source, unnest(l) AS x FROM b WHERE NOT base_failed) b JOIN f ON f.source IS NOT DISTINCT FROM b.source AND f.line = {norm} GROUP BY b.rid)
SELECT b.* EXCLUDE (rid), NOT base_failed AND 100 * (n_words - coalesce(lost, 0)) >= {MIN_LEFT_PERCENT} * n_words AS kept,
  CASE WHEN lost IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda y: NOT list_contains(gone, y)), chr(10)) END AS left_text
FROM b LEFT JOIN x ON x.rid = b.rid"""


ORACLE = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({rules_sql()})"
