"""Secret spans: fixed patterns, and a battery of randomness tests.

Only DataFrame functions are used.  Besides the base patterns, long tokens of
letters and digits are tested for randomness in the encoding that their
characters imply: chi-squared uniformity over the alphabet, runs of odd and
even codes, and circular serial correlation of the codes.  A token's score is
the largest of the three deviations in standard units.

Words of letters alone serve as decoys: how often a word looks as random as a
score, per length class, estimates how many tokens at or below that score are
not secrets.  With the share of tokens that clearly are not (Storey's
estimate), each length class gets the largest score at which the false
discovery rate stays within bounds.  Shorter decoys are counted in for longer
tokens, for which they are the harder case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: The base patterns, the group whose length counts and its least length.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {"assign": (ASSIGN, 2, 8), "access": (r"(AKIA[A-Z0-9]+)", 1, 16), "hex": (r"([0-9a-f]{32,})", 1, 32)}
KINDS = [*BASE, "random"]

#: Tokens and decoys: maximal runs of these characters.
TOKEN = r"([A-Za-z0-9+/_=-]{16,})"
#: Parts of a text that no match reaches beyond: each ends after a character that
#: no pattern has, or after a lone space that is not next to a colon or an equals
#: sign, if there is one among 4096 characters, else after the next.
_END = r"(?:[^A-Za-z0-9+/_.=:\"'\x20-]|(?<=[^\x20:=])\x20(?=[^\x20:=]))"
PART = rf"(?s).{{0,4095}}{_END}|.*?{_END}|.+"
#: Score bins a unit, the bin over which a token is clearly no secret, and the last bin.
BINS, CLEAR_BIN, LAST_BIN = 4, 16, 100


@dataclass(frozen=True)
class Battery:
    least_length: int = 20
    fdr: float = 0.05


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("token", T.StringType())])


def _parts(text: Column) -> Column:
    """Array of (text, at) of the parts of a text; at in code points.  All work
    on matches is within a part, so that it grows with the text and not with
    the square of its matches."""

    def placed(texts: Column) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
        step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.array_append(s["all"], s["at"]).alias("all"))
        return F.arrays_zip(texts.alias("text"), F.aggregate(texts, state, step, lambda s: s["all"]).alias("at"))

    # One-element arrays name an expression inside another.
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(PART), F.lit(0))), placed)[0]


def _matches(text: Column, at: Column, pattern: str, group: int) -> Column:
    """Array of (start, stop, token) of all matches in a part, in code points
    from ``at`` on; token is the group.  The texts between matches give the
    places."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    inner = F.regexp_extract_all(text, regex, F.lit(group))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), lambda g: F.length(g).cast("long"))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda w: F.length(w).cast("long")).alias("size"), inner.alias("token"))
    state = F.struct(at.alias("at"), F.array().cast(T.ArrayType(SPAN)).alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        own = F.struct(begin.alias("start"), (begin + x["size"]).alias("stop"), x["token"].alias("token"))
        return F.struct((begin + x["size"]).alias("at"), F.array_append(s["found"], own).alias("found"))

    found = F.aggregate(parts, state, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(T.ArrayType(SPAN)))


def _base_spans(text: Column, at: Column, rank: int, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    hits = F.filter(_matches(text, at, pattern, group), lambda x: F.length(x["token"]) >= least)
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _score(token: Column) -> Column:
    """Bin of the largest deviation from randomness of a token's characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("double"))
    n = F.length(token).cast("double")
    alphabet = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(token.rlike("^[a-z]+$"), 26.0).when(token.rlike("^[A-Z2-7]+$"), 32.0)
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0).when(token.rlike("^[A-Za-z]+$"), 52.0).when(token.rlike("^[0-9A-Za-z]+$"), 62.0).otherwise(64.0)
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def bins(codes: Column) -> Column:
        following = F.concat(F.slice(codes, F.lit(2), F.size(codes)), F.slice(codes, F.lit(1), F.lit(1)))
        squares = total(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0))))
        uniform = (alphabet * squares / n - n - (alphabet - 1)) / F.sqrt(2 * (alphabet - 1))
        odd = total(F.transform(codes, lambda c: c % 2))
        changes = total(F.zip_with(codes, following, lambda a, b: F.abs(a % 2 - b % 2))) - F.abs(F.element_at(codes, -1) % 2 - F.element_at(codes, 1) % 2)
        mean = 2 * odd * (n - odd) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(spread > 0, F.abs(changes + 1 - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(n)
        first, second = total(codes), total(F.transform(codes, lambda c: c * c))
        lagged = total(F.zip_with(codes, following, lambda a, b: a * b))
        spread_of_codes = n * second - first * first
        serial = F.when(spread_of_codes > 0, F.abs(n * lagged - first * first) / F.greatest(spread_of_codes, F.lit(1.0)) * F.sqrt(n)).otherwise(n)
        return F.least(F.floor(F.greatest(uniform, runs, serial) * BINS), F.lit(LAST_BIN)).cast("int")

    # One-element arrays name an expression inside another.
    return F.transform(F.array(codes), bins)[0]


def _length_class(n: Column) -> Column:
    return F.when(n < 32, 1).when(n < 64, 2).when(n < 128, 3).otherwise(4)


#: Largest accepted bin of each length class; runs in Spark SQL and in DuckDB
#: over counts(cls, decoy, bin, n), a few hundred rows.
THRESHOLDS = """
SELECT cls, max(bin) AS top FROM (
  SELECT c.cls, t.bin,
    least(1.0e0, (c.high + 1.0e0) / (c.m * greatest(1.0e0 - (c.decoys_clear + 1.0e0) / (c.decoys + 1.0e0), 1.0e0 / (c.decoys + 1.0e0))))
      * c.m * (coalesce(sum(CASE WHEN k.decoy AND k.cls <= c.cls AND k.bin <= t.bin THEN k.n END), 0) + 1.0e0) / (c.decoys + 1.0e0)
      / greatest(coalesce(sum(CASE WHEN NOT k.decoy AND k.cls = c.cls AND k.bin <= t.bin THEN k.n END), 0), 1) AS fdr
  FROM (
    SELECT a.cls,
      cast(sum(CASE WHEN NOT b.decoy AND b.cls = a.cls THEN b.n ELSE 0 END) AS double) AS m,
      cast(sum(CASE WHEN NOT b.decoy AND b.cls = a.cls AND b.bin > {clear} THEN b.n ELSE 0 END) AS double) AS high,
      cast(sum(CASE WHEN b.decoy AND b.cls <= a.cls THEN b.n ELSE 0 END) AS double) AS decoys,
      cast(sum(CASE WHEN b.decoy AND b.cls <= a.cls AND b.bin <= {clear} THEN b.n ELSE 0 END) AS double) AS decoys_clear
    FROM (SELECT DISTINCT cls FROM {counts} WHERE NOT decoy) a JOIN {counts} b ON b.cls <= a.cls GROUP BY a.cls) c
  JOIN (SELECT DISTINCT bin FROM {counts} WHERE NOT decoy AND bin <= {clear}) t ON 1 = 1
  JOIN {counts} k ON k.cls <= c.cls
  GROUP BY c.cls, t.bin, c.m, c.high, c.decoys, c.decoys_clear) x
WHERE fdr <= {fdr} GROUP BY cls
"""


def find_secrets(docs: DataFrame, battery: Battery = Battery(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secret spans of every row: ``id_col`` and spans, an array of (start, rank,
    stop, kind) in order of start, then kind; places in code points, stop
    exclusive.

    Random tokens are added where they overlap no base span.  Null and empty
    texts have no spans; texts of any length are read whole, part by part.  A
    tie of start goes by kind.  Repeated rows each return a row; rows with a
    null id keep it; an empty table returns none.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own_id"), _parts(text).alias("parts"))

    def judged(part: Column) -> Column:
        base = F.concat(*[_base_spans(part["text"], part["at"], rank, kind) for rank, kind in enumerate(BASE)])
        tokens = F.transform(
            _matches(part["text"], part["at"], TOKEN, 1),
            lambda x: F.struct(
                x["start"].alias("start"), x["stop"].alias("stop"), _length_class(F.length(x["token"])).alias("cls"), _score(x["token"]).alias("bin"),
                x["token"].rlike("^[A-Za-z]+$").alias("decoy"),
                (x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]") & (F.length(x["token"]) >= battery.least_length)).alias("test"),
            ),
        )
        return F.struct(F.array_sort(base).alias("base"), F.filter(tokens, lambda x: x["decoy"] | x["test"]).alias("tokens"))

    found = rows.select("own_id", F.filter(F.transform("parts", judged), lambda p: (F.size(p["base"]) > 0) | (F.size(p["tokens"]) > 0)).alias("parts"))
    found = storage.materialize(found, "secret-tokens")
    counts = found.select(F.explode(F.flatten("parts.tokens")).alias("x")).groupBy("x.cls", "x.decoy", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    counts = storage.materialize(counts.coalesce(1), "secret-counts")
    tops = spark.sql(THRESHOLDS.format(counts="{c}", clear=CLEAR_BIN, fdr=battery.fdr), c=counts)
    # At most one row for each of the four length classes.
    top = {r["cls"]: r["top"] for r in tops.collect()}
    limit = F.create_map(*[F.lit(v) for pair in top.items() for v in pair]) if top else F.lit(None).cast("map<int,int>")

    def spans(part: Column) -> Column:
        def accepted(x: Column) -> Column:
            apart = ~F.exists(part["base"], lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"]))
            return x["test"] & F.coalesce(x["bin"] <= limit[x["cls"]], F.lit(False)) & apart

        added = F.transform(
            F.filter(part["tokens"], accepted),
            lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), x["stop"].alias("stop"), F.lit("random").alias("kind")),
        )
        return F.array_sort(F.concat(part["base"], added))

    return found.select(F.col("own_id").alias(id_col), F.flatten(F.transform("parts", spans)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans, per document."""
    found = find_secrets(docs, battery)
    counts = [_count_of("spans", kind).alias(f"n_{kind}") for kind in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


#: Spans in a block, which a part of a text that it does not meet passes over whole.
BLOCK = 256


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``, which
    stands where the run begins.  Done part by part, like the scan; spans in
    order of start, none inside another of an earlier start that ends later."""

    def clean(part: Column, blocks: Column) -> Column:
        at, size = part["at"], F.length(part["text"]).cast("long")
        near = F.filter(blocks, lambda b: (F.element_at(b, 1)["start"] < at + size) & (F.element_at(b, -1)["stop"] > at))
        own = F.filter(F.flatten(near), lambda x: (x["start"] < at + size) & (x["stop"] > at))
        state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

        def step(s: Column, x: Column) -> Column:
            begin = x["start"] - at
            between = F.substring(part["text"], (s["at"] + 1).cast("int"), (begin - s["at"]).cast("int"))
            fresh = F.concat(s["out"], between, F.lit(mark))
            inside = begin < s["at"]
            return F.struct(F.when(inside, s["out"]).otherwise(fresh).alias("out"), F.greatest(s["at"], F.least(x["stop"] - at, size)).alias("at"))

        return F.aggregate(own, state, step, lambda s: F.concat(s["out"], F.substring(part["text"], (s["at"] + 1).cast("int"), size.cast("int"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda k: F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)))
    parts = F.transform(F.array(blocks), lambda named: F.transform(_parts(text), lambda p: clean(p, named)))[0]
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def _sql_matches(name: str, pattern: str, group: int) -> str:
    q = pattern.replace("'", "''").replace('\\"', '"')
    return f"""
{name}_m AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w, v, g FROM (
    SELECT doc_id, regexp_extract_all(t, '{q}', 0) AS w, regexp_extract_all(t, '{q}', {group}) AS v, string_split_regex(t, '{re_no_groups(q)}') AS g
    FROM d WHERE regexp_matches(t, '{q}'))),
{name}_s AS (
  SELECT doc_id, v[i] AS token,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS start,
    length(w[i]) AS size FROM {name}_m)"""


def re_no_groups(pattern: str) -> str:
    """The pattern with its capturing groups made plain."""
    return pattern.replace("((?i:", "(?:(?i:").replace("([", "(?:[").replace("(AKIA", "(?:AKIA")


def sql(battery: Battery = Battery()) -> str:
    """``secret_report`` in DuckDB SQL."""
    parts = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    parts += [_sql_matches(kind, pattern, group) for kind, (pattern, group, _) in BASE.items()]
    parts.append(_sql_matches("tok", TOKEN, 1))
    union = " UNION ALL ".join(
        f"SELECT doc_id, start, {rank} AS rank, start + size AS stop, '{kind}' AS kind FROM {kind}_s WHERE length(token) >= {BASE[kind][2]}" for rank, kind in enumerate(BASE)
    )
    parts.append(f"base AS ({union})")
    parts.append(f"""
chosen AS (
  SELECT *, length(token)::DOUBLE AS n, list_transform(string_split(token, ''), lambda c: ascii(c)::DOUBLE) AS codes, regexp_full_match(token, '[A-Za-z]+') AS decoy
  FROM tok_s WHERE regexp_full_match(token, '[A-Za-z]+')
    OR (regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]') AND length(token) >= {battery.least_length})),
sums AS (
  SELECT *, CASE WHEN regexp_full_match(token, '[0-9a-f]+|[0-9A-F]+') THEN 16.0::DOUBLE WHEN regexp_full_match(token, '[a-z]+') THEN 26.0
      WHEN regexp_full_match(token, '[A-Z2-7]+') THEN 32.0 WHEN regexp_full_match(token, '[0-9a-z]+|[0-9A-Z]+') THEN 36.0
      WHEN regexp_full_match(token, '[A-Za-z]+') THEN 52.0 WHEN regexp_full_match(token, '[0-9A-Za-z]+') THEN 62.0 ELSE 64.0 END AS a,
    list_sum(list_transform(list_distinct(codes), lambda c: (len(list_filter(codes, lambda x: x = c))::DOUBLE) ** 2)) AS squares,
    list_sum(list_transform(codes, lambda c: c % 2)) AS odd, list_sum(codes) AS s1, list_sum(list_transform(codes, lambda c: c * c)) AS s2,
    list_sum(list_transform(range(1, len(codes) + 1), lambda i: codes[i] * codes[i % len(codes) + 1])) AS s11,
    list_sum(list_transform(range(1, len(codes)), lambda i: abs(codes[i] % 2 - codes[i + 1] % 2))) AS changes
  FROM chosen),
moments AS (SELECT *, 2 * odd * (n - odd) / n + 1 AS mean, n * s2 - s1 * s1 AS vs FROM sums),
scores AS (
  SELECT *, (mean - 1) * (mean - 2) / (n - 1) AS vr FROM moments),
tokens AS (
  SELECT doc_id, start, start + size AS stop, decoy, CASE WHEN n < 32 THEN 1 WHEN n < 64 THEN 2 WHEN n < 128 THEN 3 ELSE 4 END AS cls,
    least(floor(4 * greatest((a * squares / n - n - (a - 1)) / sqrt(2 * (a - 1)),
      CASE WHEN vr > 0 THEN abs(changes + 1 - mean) / sqrt(greatest(vr, 1e-9)) ELSE n END,
      CASE WHEN vs > 0 THEN abs(n * s11 - s1 * s1) / greatest(vs, 1.0) * sqrt(n) ELSE n END)), {LAST_BIN})::INT AS bin
  FROM scores),
counts AS (SELECT cls, decoy, bin, count(*) AS n FROM tokens GROUP BY ALL),
tops AS ({THRESHOLDS.format(counts="counts", clear=CLEAR_BIN, fdr=battery.fdr)}),
every AS (
  SELECT * FROM base UNION ALL
  SELECT t.doc_id, t.start, {len(BASE)}, t.stop, 'random' FROM tokens t JOIN tops USING (cls)
  WHERE NOT t.decoy AND t.bin <= tops.top
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND b.stop > t.start)),
named AS (SELECT *, concat(kind, ':', start, ':', stop) AS s FROM every)""")
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in KINDS)
    return ",".join(parts) + f"""
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg(s, ',' ORDER BY start, rank, stop) FILTER (kind <> 'random'), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, rank, stop), '') AS spans
FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""
