"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams of lower-cased text is derived: an OR of
alternatives, each an AND of trigrams that every match must hold. The index has postings (trigram, text)
for the trigrams that queries name. A rule's postings are intersected (a text needs all trigrams of
one alternative), and only its candidates are verified with the regular expression; a rule without a
mandatory trigram scans every text. DataFrame operations only.

Texts are named by a digest. Two passes read them: the first makes the postings and scans for the rules that
have no trigram, and what it stores is narrow; the second verifies candidates. A sieve of fixed size (a bit for
each value of a hash that a candidate has) is broadcast to the second pass, so that only the texts of candidates,
and the few others that share a candidate's bit, are shuffled.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import keep, let, sieve, sifted, table
from quillcast.llm.spans import SPAN, digest, find_spans, tagged

#: Kind, pattern, and the least length of the value after the keyword (0: no such condition).
BASE_RULES = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
]
VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
MORE_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
    ("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("map_key", r"AIza[0-9A-Za-z_-]{35}", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
]
RULES = BASE_RULES + MORE_RULES
MOST = 16


def trigram_query(pattern: str) -> list[set[str]] | None:
    """Alternatives of mandatory trigrams (lower case) for a pattern; None if it has none.

    Literal stretches are expanded over branches, small classes and optional items to at most MOST strings;
    the stretch whose shortest string is longest gives the query."""
    stretches: list[set[str]] = []

    def walk(items, now: set[str] | None) -> set[str] | None:
        """Strings of the open stretch after `items`; None after a break."""
        for op, arg in items:
            here: set[str] | None = None
            if op is sre.LITERAL:
                here = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                here = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                here = walk(arg[3], {""}) if finite(arg[3]) else None
            elif op is sre.BRANCH:
                here = set().union(*(walk(x, {""}) for x in arg[1])) if all(finite(x) for x in arg[1]) else None
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1) and finite(arg[2]):
                here = {""} | walk(arg[2], {""})
            joined = None if here is None or now is None else {a + b for a in now for b in here}
            if joined is None or len(joined) > MOST:
                if now:
                    stretches.append(now)
                now = here if here is not None else {""}
            else:
                now = joined
        return now

    def finite(items) -> bool:
        return all(
            op is sre.LITERAL or (op is sre.IN and len(a) <= 8 and all(o is sre.LITERAL for o, _ in a)) or (op is sre.SUBPATTERN and finite(a[3]))
            or (op is sre.BRANCH and all(finite(x) for x in a[1])) or (op is sre.MAX_REPEAT and a[:2] == (0, 1) and finite(a[2]))
            for op, a in items
        )

    last = walk(sre_parser.parse(pattern), {""})
    best = max([*stretches, last or {""}], key=lambda x: min(map(len, x)))
    if min(map(len, best)) < 3:
        return None
    return sorted(({s[k : k + 3] for k in range(len(s) - 2)} for s in best), key=sorted)


def held_trigrams(text: Column, trigrams: list[str]) -> Column:
    """Those of `trigrams` that the lower-cased text holds."""
    return let(F.lower(text), lambda t: F.filter(F.array(*(F.lit(g) for g in trigrams)), lambda g: F.contains(t, g)))


def candidates(index: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(key, rules) from postings index(key, trigrams): bit k is set if the text's postings fulfil the query of the k-th rule."""
    needs = [(k, a, g, len(alternative)) for k, (_, pattern, _) in enumerate(rules) for a, alternative in enumerate(trigram_query(pattern) or []) for g in sorted(alternative)]
    query = index.sparkSession.createDataFrame(needs, "rule int, alternative int, trigram string, needed int")
    # Copies of a text share a key: they become one posting in the first partial sum. The query has a few rows for each rule.
    postings = index.select("key", F.explode("trigrams").alias("trigram")).join(F.broadcast(query), "trigram")
    both = postings.groupBy("key", "rule", "alternative").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).filter("n = needed")
    return both.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_secrets(docs: DataFrame, rules: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(doc_id, spans) for every row of docs(doc_id, text): spans is an array per rule of (s, e, t).

    A null or empty text has none. Rows are kept apart whatever their ids are; equal texts are verified once. Very
    long texts are searched whole. Nothing is dropped."""
    rules = rules or RULES
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("key"))

    def spans(pattern: str, least: int) -> Column:
        found = find_spans(F.col("text"), pattern)
        return F.filter(found, lambda x: F.length(F.regexp_extract(x["t"], VALUE, 1)) >= least) if least else found

    named = sorted({g for _, pattern, _ in rules for alternative in trigram_query(pattern) or [] for g in alternative})
    scanned = [(name, p, c) for name, p, c in rules if trigram_query(p) is None]
    first = keep(docs.select("doc_id", "key", held_trigrams(F.col("text"), named).alias("trigrams"), *(spans(p, c).alias(name) for name, p, c in scanned)), "index")
    able = keep(candidates(first, rules), "candidates")
    texts = sifted(docs.select("key", "text"), sieve(able, "key"), "key").groupBy("key").agg(F.min("text").alias("text")).join(able, "key")
    none = F.array().cast(SPAN)
    verify = lambda k, p, c: F.when(F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, spans(p, c)).otherwise(none)
    verified = keep(texts.select("key", *(verify(k, p, c).alias(name) for k, (name, p, c) in enumerate(rules) if trigram_query(p) is not None)), "verified")
    rows = first.drop("trigrams").join(verified, "key", "left")
    return rows.select("doc_id", *(F.coalesce(name, none).alias(name) for name, _, _ in rules))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [r[0] for r in RULES]
    base = F.sort_array(F.concat(*(tagged(k, F.col(names[k])) for k in range(len(BASE_RULES)))))
    every = F.sort_array(F.concat(*(tagged(k, F.col(n)) for k, n in enumerate(names))))
    return found.select(
        "doc_id", *(F.size(n).cast("long").alias(f"n_{n}") for n in names[:3]),
        F.sha2(digest(base, names), 256).alias("base_sha256"), digest(every, names).alias("spans"),
    )


def _sql_spans(k: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''").replace('\\"', '"')
    return (
        f"SELECT doc_id, {k} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 't': m[i]}})) AS x "
        f"FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m FROM d) WHERE len(m) > 0"
    )


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_sql_spans(k, p) for k, (_, p, _) in enumerate(RULES))}),
b AS (SELECT doc_id, k, x.s AS s, x.s + length(x.t) AS e FROM a WHERE k <> 0 OR length(regexp_extract(x.t, '{VALUE.replace("'", "''").replace(chr(92) + '"', '"')}', 1)) >= 8),
c AS (SELECT doc_id, k, s, [{", ".join(f"'{r[0]}'" for r in RULES)}][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS w FROM b),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(w, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY s, k) AS spans FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
