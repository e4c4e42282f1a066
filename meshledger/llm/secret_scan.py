"""Secrets in texts: three fixed patterns, and long runs that look drawn at random.

A character Markov model of random strings and one of ordinary identifiers are counted from labelled
samples. A run of 16 or more letters, digits and ``+ / _ -`` is a secret too if the log of its
likelihood ratio under the two models, summed over its characters, is at least ``MARGIN``. All of it
is DataFrame functions: a text is scanned and a run scored inside its row, without a shuffle; only
the samples and the counts of character pairs (at most 2 x 69 x 68) are gathered.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common

#: The models' characters; all that a run or a value of the patterns can hold.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
SIZE = len(ALPHABET)
#: Bounds of the labelled samples: texts from which identifiers are taken, distinct values of the patterns.
TEXTS, VALUES = 2_000, 20_000
#: Least length of a run that is scored, and of a value that is learned from.
LONG = 16
#: A transition counts as if seen so often more, by the characters' own shares, which get half a count more.
PRIOR, HALF = 10.0, 0.5
#: Least natural log of the likelihood ratio of a run.
MARGIN = 12.0


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


RUN = "[A-Za-z0-9+/_-]"
NAME = _either_case("(?:password|passwd|secret|token|api_?key)")
LEAD = NAME + r"""["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
#: An assignment with the run before it, or a long run. As an assignment's name is made of run
#: characters, both kinds are found in one scan and never overlap.
PIECE = f"{RUN}*?{LEAD}{VALUE}|{RUN}{{{LONG},}}={{0,2}}"
#: No match can begin inside a run, which spares the scan most of its tries.
PIECE_SCAN = f"(?<!{RUN})(?:{PIECE})"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row, not once for each use."""
    return F.transform(F.array(value), body)[0]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def running_sums(x: Column) -> Column:
    """Prefix sums of an array of int, in blocks of about the root of its length: n^1.5 steps."""
    n = F.size(x)
    side = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.sequence(F.lit(0), F.ceil(n / side).cast("int") - 1)
    sums = F.transform(blocks, lambda b: _total(F.slice(x, b * side + 1, side)))
    before = lambda s: F.transform(blocks, lambda b: _total(F.slice(s, F.lit(1), b)))
    inside = lambda b, start: F.transform(F.sequence(F.lit(1), F.least(side, n - b * side)), lambda j: start + _total(F.slice(x, b * side + 1, j)))
    return _bind(sums, lambda s: _bind(before(s), lambda at: F.flatten(
        F.transform(blocks, lambda b: _bind(F.get(at, b), lambda start: inside(b, start))))))


def _spans(found: Column, steps: Column) -> Column:
    """(start, stop, value) of the matches; ``steps`` are the lengths from one match's end to the next one's."""
    return F.when(F.size(found) > 0, F.zip_with(found, running_sums(steps), lambda v, stop: F.struct(
        (stop - F.char_length(v)).alias("start"), stop.alias("stop"), v.alias("value"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, values, runs) per row of ``docs``.

    ``base`` are (start, place in KINDS, stop) of the fixed patterns in order, in code points, the
    stop exclusive; ``values`` their secret parts; ``runs`` (start, stop, value) of the long runs
    that hold none of them. Matches are located by the lengths of the pieces between them.
    """
    patterns = {"piece": PIECE_SCAN, "access": ACCESS, "hex": HEX}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    # the text is split only where something matched
    steps = found.select("*", *[
        F.when(F.size(k) > 0, F.zip_with(F.slice(F.split("text", p, -1), F.lit(1), F.size(k)), F.col(k), lambda gap, v: F.char_length(gap) + F.char_length(v)))
        .alias(f"{k}_steps") for k, p in patterns.items()])
    spans = steps.select("id", *[F.coalesce(_spans(F.col(k), F.col(f"{k}_steps")), F.expr("array()").cast("array<struct<start:int,stop:int,value:string>>")).alias(k) for k in patterns])
    assigned = F.transform(F.filter("piece", lambda m: m.value.rlike(LEAD + VALUE + "$")), lambda m: F.struct(
        m.stop.alias("stop"), F.regexp_extract(m.value, f"^{RUN}*?({LEAD}{VALUE})$", 1).alias("whole"),
        F.regexp_extract(m.value, f"^{RUN}*?{LEAD}({VALUE})$", 1).alias("value")))
    spans = spans.select("id", "access", "hex", F.filter(assigned, lambda m: F.char_length(m.value) >= 6).alias("assign"), F.filter(
        "piece", lambda m: ~m.value.rlike(LEAD + VALUE + "$") & ~m.value.rlike(ACCESS) & ~m.value.rlike(HEX)).alias("runs"))
    place = lambda start, kind, m: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m.stop.alias("stop"))
    base = F.concat(
        F.transform("assign", lambda m: place(m.stop - F.char_length(m.whole), "assign", m)),
        F.transform("access", lambda m: place(m.start, "access", m)), F.transform("hex", lambda m: place(m.start, "hex", m)))
    values = F.concat(*[F.transform(k, lambda m: m.value) for k in ("assign", "access", "hex")])
    return spans.select("id", F.array_sort(base).alias("base"), values.alias("values"), "runs")


def labelled(docs: DataFrame, scanned: DataFrame, text_col: str = "text", texts: int = TEXTS, values: int = VALUES) -> DataFrame:
    """Labelled sample (value, random).

    Random are the secret parts of LONG or more characters that the patterns found, at most ``values``
    distinct ones, and a base64 digest of each sampled text; ordinary are the runs of six or more characters of the
    sampled texts less what the patterns match. Sampled are the ``texts`` distinct texts of smallest
    MD5, so copies count once.
    """
    body = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    last = body.select("digest").distinct().orderBy("digest").limit(texts).agg(F.max("digest")).first()[0] or ""
    some = body.where(F.col("digest") <= last).select("text").distinct()
    rest = F.regexp_replace("text", f"{LEAD}{VALUE}|{ACCESS}|{HEX}", " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(rest, F.lit(RUN + "{6,}"), F.lit(0))).alias("value")).distinct()
    drawn = some.select(F.rtrim(F.base64(F.unhex(F.sha2(F.col("text").cast("binary"), 256))), F.lit("=")).alias("value"))
    known = scanned.select(F.explode("values").alias("value")).where(F.char_length("value") >= LONG).distinct().orderBy(F.md5(F.col("value").cast("binary"))).limit(values)
    return ordinary.withColumn("random", F.lit(False)).unionByName(drawn.unionByName(known).withColumn("random", F.lit(True)))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def fit(samples: DataFrame) -> list[float]:
    """Log likelihood ratio of each character by the one before: row 0 for the first character of a string.

    ``samples`` has (value, random). A string counts each of its transitions once, so one long or
    monotonous string does not outweigh the rest; characters outside ALPHABET are left out. Without any sample all ratios are 0.
    """
    codes = samples.select("random", F.filter(_codes(F.col("value")), lambda c: c > 0).alias("codes"))
    pairs = codes.select("random", F.explode(F.array_distinct(F.zip_with(
        F.slice(F.concat(F.array(F.lit(0)), "codes"), F.lit(1), F.size("codes")), "codes", lambda p, c: F.struct(p.alias("before"), c.alias("code"))))).alias("pair"))
    counts = {(r.random, r.before, r.code): r.n for r in pairs.groupBy("random", "pair.before", "pair.code").agg(F.count("*").alias("n")).collect()}

    shares = {}
    for random in (True, False):
        own = [sum(counts.get((random, before, c), 0) for before in range(SIZE + 1)) + HALF for c in range(1, SIZE + 1)]
        shares[random] = [x / sum(own) for x in own]

    def log_of(random: bool, before: int) -> list[float]:
        own = [counts.get((random, before, c), 0) + PRIOR * shares[random][c - 1] for c in range(1, SIZE + 1)]
        return [math.log(x / sum(own)) for x in own]

    return [a - b for before in range(SIZE + 1) for a, b in zip(log_of(True, before), log_of(False, before))]


def score(value: Column, ratios: list[float]) -> Column:
    """Log likelihood ratio of a string of ALPHABET's characters, one pass over it."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("before"), (a["sum"] + F.get(table, a["before"] * SIZE + c - 1)).alias("sum"))
    return F.aggregate(_codes(value), start, step, lambda a: a["sum"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, n_random, base, added.

    ``base`` and ``added`` are arrays of (start, kind, stop); the base spans always stay, the added
    ones overlap none of them. ``samples`` has (value, random); by default they are taken from the table
    (`labelled`), whose own unlabelled secrets then count as ordinary, which only a small table feels. Null and empty texts have no spans, repeated rows and ids are rows of
    their own, a null id stays null, other columns are not read. An empty table gives no rows.
    """
    scanned = common.store(scan(docs, id_col, text_col), "secret-scan")
    ratios = fit(labelled(docs, scanned, text_col) if samples is None else samples)
    added = F.transform(F.filter("runs", lambda r: score(r.value, ratios) >= margin),
                        lambda r: F.struct(r.start.alias("start"), F.lit(3).alias("kind"), r.stop.alias("stop")))
    count = lambda k: F.size(F.filter("base", lambda b: b.kind == k)).cast("long")
    return scanned.select("id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], "base", added.alias("added")).withColumn("n_random", F.size("added").cast("long"))


def written(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s.start.cast("string"), s.stop.cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(common.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "n_random",
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), hits AS (
  SELECT r, k, unnest(found) AS value, unnest(list_slice(gaps, 1, len(found))) AS gap, generate_subscripts(found, 1) AS i
  FROM (SELECT r, k, regexp_extract_all(text, p) AS found, string_split_regex(text, p) AS gaps
        FROM docs, (VALUES (0, {_sql(PIECE)}), (1, {_sql(ACCESS)}), (2, {_sql(HEX)})) AS patterns(k, p))
), placed AS (
  SELECT r, k, value, sum(length(gap) + length(value)) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM hits
), pieces AS (
  SELECT r, stop, value, regexp_extract(value, {_sql(f'^{RUN}*?({LEAD}{VALUE})$')}, 1) AS whole,
         regexp_extract(value, {_sql(f'^{RUN}*?{LEAD}({VALUE})$')}, 1) AS part FROM placed WHERE k = 0
), base AS (
  SELECT r, stop - length(whole) AS start, 0 AS kind, stop, part AS value FROM pieces WHERE length(part) >= 6
  UNION ALL SELECT r, stop - length(value), k, stop, value FROM placed WHERE k > 0
), sampled AS (
  SELECT DISTINCT text FROM docs WHERE md5(text) IN (SELECT DISTINCT md5(text) AS m FROM docs ORDER BY m LIMIT {TEXTS})
), samples AS (
  SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, {_sql(f'{LEAD}{VALUE}|{ACCESS}|{HEX}')}, ' ', 'g'), {_sql(RUN + '{6,}')})) AS value, FALSE AS random FROM sampled
  UNION ALL SELECT rtrim(base64(unhex(sha256(text))), '='), TRUE FROM sampled
  UNION ALL SELECT value, TRUE FROM (SELECT DISTINCT value FROM base WHERE length(value) >= {LONG} ORDER BY md5(value) LIMIT {VALUES})
), pairs AS (
  SELECT DISTINCT random, value, CASE WHEN i = 1 THEN '' ELSE substr(value, i - 1, 1) END AS before, substr(value, i, 1) AS code
  FROM (SELECT random, value, unnest(range(1, length(value) + 1)) AS i FROM samples)
), letters AS (
  SELECT substr('{ALPHABET}', i::INT, 1) AS code FROM range(1, {SIZE + 1}) AS t(i)
), counts AS (
  SELECT before, code, count(*) FILTER (random) AS yes, count(*) FILTER (NOT random) AS no FROM pairs GROUP BY ALL
), shares AS (
  SELECT code, yes / sum(yes) OVER () AS yes, no / sum(no) OVER () AS no
  FROM (SELECT l.code, coalesce(sum(yes), 0) + {HALF} AS yes, coalesce(sum(no), 0) + {HALF} AS no FROM letters AS l LEFT JOIN counts AS c USING (code) GROUP BY 1)
), grid AS (
  SELECT b.code AS before, s.code, coalesce(c.yes, 0) + {PRIOR} * s.yes AS yes, coalesce(c.no, 0) + {PRIOR} * s.no AS no
  FROM (SELECT code FROM letters UNION ALL SELECT '') AS b CROSS JOIN shares AS s
  LEFT JOIN counts AS c ON c.before = b.code AND c.code = s.code
), ratios AS (
  SELECT before, code, ln(yes / sum(yes) OVER (PARTITION BY before)) - ln(no / sum(no) OVER (PARTITION BY before)) AS ratio FROM grid
), runs AS (
  SELECT row_number() OVER () AS q, r, stop - length(value) AS start, stop, value FROM pieces
  WHERE whole = '' AND NOT regexp_matches(value, {_sql(ACCESS)}) AND NOT regexp_matches(value, {_sql(HEX)})
), steps AS (
  SELECT q, CASE WHEN i = 1 THEN '' ELSE substr(value, i - 1, 1) END AS before, substr(value, i, 1) AS code
  FROM (SELECT q, value, unnest(range(1, length(value) + 1)) AS i FROM runs)
), added AS (
  SELECT r, start, 3 AS kind, stop FROM runs
  WHERE q IN (SELECT q FROM steps JOIN ratios USING (before, code) GROUP BY q HAVING sum(ratio) >= {MARGIN})
), named AS (
  SELECT r, start, kind, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS span
  FROM (SELECT r, start, kind, stop FROM base UNION ALL SELECT * FROM added)
), joined AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         count(*) FILTER (kind = 3) AS n_random, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (r)
"""
