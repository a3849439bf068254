"""Secret scans (operator 10): three base patterns and a sliding-window entropy scan.

Native: DataFrame functions only. A pattern's matches come from regexp_extract_all and the text between them from
split, so that running sums of lengths give every match's place in code points. The method takes candidate strings
(maximal runs of CANDIDATE characters, so a name before = is not part of one), slides a window of WINDOW characters over
each and keeps the counts of its characters, those of its character classes, and the sum of c * log2(c): one step takes
the leaving character out, puts the entering one in and changes these two counts and the sum. The characters present
give the window's class (hexadecimal, letters of one case or both, those with digits, all mixed), each class has its
own entropy, and windows above it are joined into spans of kind `entropy`. The allow list suppresses a candidate that
it matches as a whole: UUIDs, word and path lists, the alphabet, names of samples. All arithmetic is on integers.

Every step is linear in the text: long candidates are scanned and long lists summed in parts of bounded size, and no
pattern holds a group that repeats by recursion.

Defined results: a null or empty text has no spans; runs under WINDOW characters have no entropy span; repeated rows
get equal results; other input columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import settled

# The three base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{32,}"  # runs are maximal, so the short ones need not be matched first
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"  # what follows a later AKIA of the same run is shorter still

CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
WINDOW = 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Character classes of a window: digits, a-f, g-z, A-F, G-Z, marks.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_-")
SCALE = 1_000_000
#: Bits of entropy from which a window is a secret, by what it holds. Words reach about 3.7.
HEX_BITS, ONE_CASE_BITS, LETTER_BITS, MARKED_LETTER_BITS, ONE_CASE_DIGIT_BITS, MIXED_BITS = 3.0, 4.0, 4.1, 4.2, 3.6, 3.9
#: Possessive repeats: no state is kept for a repetition, whatever the length of a candidate.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^(?:(?:example|sample|placeholder|changeme|lorem)[0-9/_+-]*+)++$",
    r"^[a-z]++(?:[/_-][a-z]++)*+$",
    r"(?i)^(?:abcdefghijklmnopqrstuvwxyz|0123456789)++$",
)
#: table[c] = c * log2(c), scaled and rounded: the entropy of a window is log2(W) - sum(table[c]) / (SCALE * W). One entry
#: more than the window, as a character enters before another leaves.
TABLE = [0, *(round(SCALE * c * math.log2(c)) for c in range(1, WINDOW + 2))]
#: Elements of a list, and windows of a candidate, that one part takes.
PART, WINDOWS = 256, 512
SPANS = "array<struct<s: int, e: int, m: string>>"


def _most(bits: float) -> int:
    """The largest sum of table values of a window with at least so much entropy."""
    return int(TABLE[WINDOW] - bits * SCALE * WINDOW)


def most_by_classes(present: int) -> int:
    """The same for the classes present in a window (a bit each, as in CLASSES); -1 if such windows are no secrets."""
    digit, af, gz, AF, GZ, mark = (bool(present >> i & 1) for i in range(6))
    small, capital = af or gz, AF or GZ
    if mark:
        return _most(MIXED_BITS if digit else MARKED_LETTER_BITS) if small and capital else -1
    if not gz and not GZ and not (af and AF):
        return _most(HEX_BITS)
    if not digit:
        return _most(LETTER_BITS if small and capital else ONE_CASE_BITS)
    return _most(MIXED_BITS if small and capital else ONE_CASE_DIGIT_BITS)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(body: str, **values: str) -> str:
    """SQL of body with names for values, each computed once; later values may use earlier names."""
    for name, value in reversed(values.items()):
        body = f"get(transform(array({value}), {name} -> {body}), 0)"
    return body


def _running(values: str, fold: str = "{0} + {1}") -> str:
    """SQL of the running sums (or another fold from 0) of an array of int, in parts of PART."""
    last = "coalesce(get({0}, size({0}) - 1), 0)"
    inner = fold.format(last.format("acc"), "y")
    outer = fold.format(last.format("acc"), last.format("ys"))
    return _let(
        f"flatten(transform(parts, (ys, j) -> transform(ys, y -> {fold.format('get(bases, j)', 'y')})))",
        vals=values,
        parts=f"transform(sequence(0, greatest(size(vals) - 1, 0), {PART}), p -> aggregate(slice(vals, p + 1, {PART}), cast(array() AS array<int>), (acc, y) -> concat(acc, array({inner}))))",
        bases=f"aggregate(parts, array(0), (acc, ys) -> concat(acc, array({outer})))",
    )


def _matches(text: str, pattern: str, keep: str) -> str:
    """SQL of the array (s, e, m) of a pattern's matches in a column; `keep` filters them by x.m."""
    every = _let(
        f"filter(transform(found, (m, k) -> named_struct('s', get(ends, k) - length(m), 'e', get(ends, k), 'm', m)), x -> {keep})",
        found=f"regexp_extract_all({text}, {_quoted(pattern)}, 0)",
        gaps=f"split({text}, {_quoted(pattern)})",
        ends=_running("transform(found, (m, k) -> length(get(gaps, k)) + length(m))"),
    )
    return f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN {every} ELSE cast(array() AS {SPANS}) END"


def _entropy_spans(c: str) -> str:
    """SQL of the array (s, e, m) of the spans in a candidate c (s, e, m), by incremental counts.

    The counts are a string, one letter a character of ALPHABET (A for none); those of the classes are five bits each of
    one long. A part begins its windows anew, WINDOW - 1 characters before its first."""
    table = f"array({', '.join(f'{x}L' for x in TABLE)})"
    unit = {ch: 1 << 5 * i for i, chars in enumerate(CLASSES) for ch in chars}
    units = f"array({', '.join(f'{unit[ch]}L' for ch in ALPHABET)})"
    most = f"array({', '.join(f'{most_by_classes(p)}L' for p in range(1 << len(CLASSES)))})"
    present = " + ".join(f"int((moved.c & {31 << 5 * i}L) <> 0) * {1 << i}" for i in range(len(CLASSES)))
    count = "(ascii(substring({0}.n, {1}, 1)) - 65)"
    entered = _let(
        f"named_struct('n', overlay(a.n, chr(66 + old), g.i, 1), 'f', a.f + get({table}, old + 1) - get({table}, old), 'c', a.c + get({units}, g.i - 1), 'out', a.out)",
        old=count.format("a", "g.i"),
    )
    left = _let(
        f"named_struct('n', overlay(more.n, chr(64 + old), g.o, 1), 'f', more.f - get({table}, old) + get({table}, old - 1), 'c', more.c - get({units}, g.o - 1), 'out', more.out)",
        old=count.format("more", "g.o"),
    )
    hit = f"g.k >= {WINDOW} AND moved.f <= {max(map(most_by_classes, range(64)))}L AND moved.f <= get({most}, {present})"
    step = _let(
        f"CASE WHEN {hit} THEN named_struct('n', moved.n, 'f', moved.f, 'c', moved.c, 'out', concat(moved.out, array(p + g.k - {WINDOW}))) ELSE moved END",
        more=entered,
        moved=f"CASE WHEN g.o = 0 THEN more ELSE {left} END",
    )
    zero = f"named_struct('n', repeat('A', {len(ALPHABET)}), 'f', 0L, 'c', 0L, 'out', cast(array() AS array<int>))"
    steps = f"transform(slice(codes, p + 1, {WINDOWS + WINDOW - 1}), (x, k) -> named_struct('i', x, 'o', CASE WHEN k >= {WINDOW} THEN get(codes, p + k - {WINDOW}) ELSE 0 END, 'k', k + 1))"
    spans = _let(
        f"transform(firsts, (x, k) -> named_struct('s', {c}.s + x, 'e', {c}.s + get(lasts, k) + {WINDOW}, 'm', ''))",
        codes=f"transform(split({c}.m, ''), ch -> locate(ch, '{ALPHABET}'))",
        hits=f"flatten(transform(sequence(0, greatest(size(codes) - {WINDOW}, 0), {WINDOWS}), p -> aggregate({steps}, {zero}, (a, g) -> {step}, a -> a.out)))",
        firsts=f"filter(hits, (x, k) -> k = 0 OR x - get(hits, k - 1) > {WINDOW})",
        lasts=f"filter(hits, (x, k) -> k = size(hits) - 1 OR get(hits, k + 1) - x > {WINDOW})",
    )
    allowed = " OR ".join(f"{c}.m RLIKE {_quoted(x)}" for x in ALLOW)
    return f"CASE WHEN {allowed} THEN cast(array() AS {SPANS}) ELSE {spans} END"


def _joined(spans: str) -> str:
    """SQL of the spans (s, e) of a sorted array, those that overlap or touch as one."""
    return _let(
        "transform(filter(firsts, x -> x IS NOT NULL), (x, k) -> named_struct('s', x, 'e', get(lasts, k)))",
        every=spans,
        most=_running("transform(every, x -> x.e)", "greatest({0}, {1})"),
        firsts="transform(every, (x, k) -> CASE WHEN k = 0 OR x.s > get(most, k - 1) THEN x.s END)",
        lasts="filter(transform(every, (x, k) -> CASE WHEN k = size(every) - 1 OR get(every, k + 1).s > get(most, k) THEN get(most, k) END), x -> x IS NOT NULL)",
    )


def _labelled(column: str, kind: int) -> str:
    return f"transform({column}, x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e))"


KINDS = ("assign", "access", "hex", "entropy")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _assign, _access, _hex and _entropy: arrays of (s, e, m)."""
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_assign", F.expr(_matches("_t", ASSIGN, f"length(regexp_extract(x.m, {_quoted(ASSIGN)}, 2)) >= 8")))
    d = d.withColumn("_access", F.expr(_matches("_t", ACCESS_LONG, "true")))
    d = d.withColumn("_hex", F.expr(_matches("_t", HEX_LONG, "true")))
    d = d.withColumn("_cand", F.expr(_matches("_t", CANDIDATE, "true")))
    d = d.withColumn("_entropy", F.expr(f"flatten(transform(_cand, cand -> {_entropy_spans('cand')}))"))
    return d.drop("_cand", "_t")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_entropy, base_sha256, spans and _all (the spans as an array) to every row."""
    d = with_spans(docs, text)
    parts = [_labelled(f"_{k}", i) for i, k in enumerate(KINDS)]
    d = d.withColumn("_base", F.expr(f"array_sort(concat({', '.join(parts[:3])}))"))
    d = d.withColumn("_all", F.expr(f"array_sort(concat(_base, {parts[3]}))"))
    for k in KINDS:
        d = d.withColumn(f"n_{k}", F.size(f"_{k}").cast("long"))
    d = d.withColumn("base_sha256", F.sha2(_text_of(F.col("_base")), 256)).withColumn("spans", _text_of(F.col("_all")))
    d = d.drop("_base", *(f"_{k}" for k in KINDS))
    return settled(d, [F.col(f"`{c}`") for c in d.columns])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by a mark; overlapping spans are replaced as one."""
    d = scan(docs.select(F.struct(*docs.columns).alias("_in"), F.col(text).cast("string").alias("_x")), "_x")
    left = _let(
        f"array_join(flatten(transform(sequence(0, size(spans)), k -> concat(CASE WHEN k = 0 THEN array() ELSE array('{mark}') END, "
        "slice(chars, coalesce(get(spans, k - 1).e, 0) + 1, greatest(coalesce(get(spans, k).s, size(chars)) - coalesce(get(spans, k - 1).e, 0), 0))))), '')",
        spans=_joined("_all"),
        chars="split(_x, '')",
    )
    new = F.expr(f"CASE WHEN size(_all) = 0 THEN _x ELSE {left} END")
    return d.select(*(new.alias(c) if c == text else F.col(f"_in.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _sql_matches(kind: int, pattern: str, keep: str, source: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, {kind} AS k, s, s + length(m) AS e, m FROM (
    SELECT rid, m, (sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m))::BIGINT AS s FROM (
      SELECT rid, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest(regexp_split_to_array(text, '{p}')) AS g,
        generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM {source}) WHERE m IS NOT NULL)
  WHERE {keep}"""


def scan_sql(source: str = "documents") -> str:
    """SQL with one row a document: counts, base_sha256 and spans. Each window is counted afresh."""
    value = ASSIGN.replace("'", "''")
    table = f"[{', '.join(map(str, TABLE))}]"
    allowed = " OR ".join(f"regexp_matches(m, '{x.replace('++', '+').replace('*+', '*')}')" for x in ALLOW)
    has = lambda chars: f"regexp_matches(w, '[{chars}]')"
    digit, small, capital = has("0-9"), has("a-z"), has("A-Z")
    most = f"""CASE WHEN {has("+/_-")} THEN CASE WHEN NOT ({small} AND {capital}) THEN -1 WHEN {digit} THEN {_most(MIXED_BITS)} ELSE {_most(MARKED_LETTER_BITS)} END
      WHEN NOT {has("g-zG-Z")} AND NOT ({has("a-f")} AND {has("A-F")}) THEN {_most(HEX_BITS)}
      WHEN NOT {digit} THEN CASE WHEN {small} AND {capital} THEN {_most(LETTER_BITS)} ELSE {_most(ONE_CASE_BITS)} END
      WHEN {small} AND {capital} THEN {_most(MIXED_BITS)} ELSE {_most(ONE_CASE_DIGIT_BITS)} END"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
a AS ({_sql_matches(0, ASSIGN, f"length(regexp_extract(m, '{value}', 2)) >= 8", "d")}),
c AS ({_sql_matches(1, ACCESS, "length(m) >= 16", "d")}),
h AS ({_sql_matches(2, HEX, "length(m) >= 32", "d")}),
q AS ({_sql_matches(3, CANDIDATE, "true", "d")}),
qt AS (SELECT rid, s, m, row_number() OVER () AS cid FROM q WHERE NOT ({allowed})),
win AS (SELECT cid, rid, s, i, substr(m, i + 1, {WINDOW}) AS w FROM (SELECT *, unnest(range(0, length(m) - {WINDOW} + 1)) AS i FROM qt)),
lim AS (SELECT *, {most} AS t FROM win),
cnt AS (SELECT cid, rid, s, t, i, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS ch FROM lim WHERE t >= 0) GROUP BY cid, rid, s, t, i, ch),
hit AS (SELECT cid, rid, s + i AS b FROM (SELECT cid, rid, s, t, i, sum({table}[n + 1]) AS f FROM cnt GROUP BY cid, rid, s, t, i) WHERE f <= t),
isl AS (SELECT *, sum(CASE WHEN b - p <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY cid ORDER BY b) AS g FROM (SELECT *, lag(b) OVER (PARTITION BY cid ORDER BY b) AS p FROM hit)),
e AS (SELECT rid, 3 AS k, min(b)::BIGINT AS s, (max(b) + {WINDOW})::BIGINT AS e FROM isl GROUP BY rid, cid, g),
u AS (SELECT rid, k, s, e FROM a UNION ALL SELECT rid, k, s, e FROM c UNION ALL SELECT rid, k, s, e FROM h UNION ALL SELECT rid, k, s, e FROM e),
n AS (SELECT rid, k, s, e, (['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || s || ':' || e AS x FROM u),
r AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY s, k, e) AS spans FROM n GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.rid = d.rid"""


ORACLE = scan_sql()
