"""Quality rules as a ledger of bits.

Each rule is evaluated once for a document; what it measured and one failure bit for each rule are kept.
A policy is a named, versioned set of rules, so a verdict is one bitwise AND, a new policy needs no new
pass over the text, and an ablation is an aggregate over the bits. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import WS, keep, let, table

#: Rule name and the condition, over the measurements, under which a document fails it. The order fixes the bits.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "10 * word_chars < 22 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "exclamations": "10 * n_exclaim > 3 * n_words",
    "digits": "10 * n_digits > 4 * word_chars",
    "unbroken_run": "longest_run > 1000",
}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "repeated_lines", "symbols", "short_words", "long_words", "upper_case", "exclamations", "digits", "unbroken_run"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_digits", "longest_run"]
WINDOW = 8


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows of `window` words that occur twice or more, by a 64-bit hash of each window."""
    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        like = lambda z, s, k: F.coalesce(F.get(z, k)["h"] == s["h"], F.lit(False))
        starts = let(pairs, lambda z: F.sort_array(F.transform(F.filter(z, lambda s, k: like(z, s, k - 1) | like(z, s, k + 1)), lambda s: s["i"])))
        gaps = let(starts, lambda p: F.transform(p, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - s, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > window, found).otherwise(0)


def ledger(docs: DataFrame) -> DataFrame:
    """Columns of `docs` and MEASURES (long) and failures (long, bit k for the k-th rule).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; a null or empty text has none, measures 0
    everywhere and fails few_words only. Lines are split at \\n and count if they have a word; a line
    that equals an earlier one is a repeat. Columns of `docs` with one of these names are replaced.
    Repeated rows are measured alike; nothing is dropped."""
    own = [c for c in docs.columns if c not in MEASURES and c != "failures"]
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))
    left = lambda kept: F.length(F.regexp_replace(text, kept, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat"), F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.select(
        *own, by_words.alias("_w"), by_lines.alias("_l"), left("[^#*$%&|<>]+").alias("_s"), left("[^A-ZÀ-ÖØ-Þ]+").alias("_u"), left("[^!]+").alias("_e"), left("[^0-9]+").alias("_d"),
    )
    values = {"n_words": "_w.n", "word_chars": "_w.chars", "n_symbols": "_s", "n_lines": "_l.n", "n_dup_lines": "_l.dup", "n_repeat_words": "_w.repeat", "n_upper": "_u", "n_exclaim": "_e", "n_digits": "_d", "longest_run": "_w.longest"}
    out = out.select(*own, *(F.col(v).cast("long").alias(k) for k, v in values.items()))
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return out.withColumn("failures", failures)


def verdict(policy: str, failures: str = "failures") -> Column:
    """True for what the policy keeps."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of docs as a stored table without the text: policies and ablations read it, and the text is read once."""
    return keep(ledger(docs.select("doc_id", "text")), "ledger")


def apply_policies(found: DataFrame, *policies: str) -> DataFrame:
    """A stored ledger with kept_<policy> for each policy: one bitwise AND each."""
    return found.withColumns({f"kept_{p}": verdict(p) for p in policies})


def accept(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns. For this one policy the bits are used in the pass
    that makes them; for several, or for ablations, see stored_ledger()."""
    found = ledger(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return found.filter(verdict(policy)).select("_row.*")


def ablation(found: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rejected by no other rule of it), n_kept_without.

    The ledger is first counted by its bits, at most 2 ** len(RULES) groups; an empty ledger gives zeros."""
    bits = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    counts = found.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = counts.agg(*(
        F.struct(F.lit(r).alias("rule"), total(F.col("bits").bitwiseAND(F.lit(b)) != 0).alias("n_failed"), total(F.col("bits") == b).alias("n_only"), total(F.col("bits").isin(0, b)).alias("n_kept_without")).alias(r)
        for r, b in ((r, 1 << list(RULES).index(r)) for r in POLICIES[policy])
    ))
    return sums.select(F.explode(F.array(*POLICIES[policy])).alias("x")).select("x.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_policies(stored_ledger(table(spark, sf_dir, "documents")), "base", "v1")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), "failures", "longest_run",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies' ablations, from one stored ledger."""
    found = stored_ledger(table(spark, sf_dir, "documents"))
    both = [ablation(found, p).select(F.lit(p).alias("policy"), "*") for p in POLICIES]
    return both[0].union(both[1])


OP5_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g WHERE (doc_id, s) IN (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_run
  FROM a LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (2 * n_dup_lines > n_lines)::INT + 8 * (10 * n_symbols > n_words)::INT
  + 16 * (10 * word_chars < 22 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT + 64 * (2 * n_upper > word_chars)::INT + 128 * (10 * n_exclaim > 3 * n_words)::INT
  + 256 * (10 * n_digits > 4 * word_chars)::INT + 512 * (longest_run > 1000)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures, longest_run FROM f
"""
ABLATION_SQL = (
    OP5_SQL.rsplit("SELECT doc_id, n_words", 1)[0]
    + f""", p AS (SELECT unnest([{", ".join(f"{{'policy': '{p}', 'rule': '{r}', 'mask': {mask(p)}, 'bit': {1 << list(RULES).index(r)}}}" for p in POLICIES for r in POLICIES[p])}]) AS x)
SELECT x.policy AS policy, x.rule AS rule, count(*) FILTER (failures & x.bit <> 0) AS n_failed, count(*) FILTER (failures & x.mask = x.bit) AS n_only, count(*) FILTER (failures & x.mask & ~x.bit = 0) AS n_kept_without
FROM p, f GROUP BY ALL
"""
)
