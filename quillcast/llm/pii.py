"""Personal data: base entities by pattern, and further identifiers by bootstrapped contexts.

1. One pass over the text finds the base entities (email, ip, card, phone) and the tokens that look like
   identifiers but are none of these, each with its lexical patterns: the word before it, the two words before
   it, the words on either side, and the word before it with its shape.
2. The base entities are the seeds of a graph of patterns and instances. A pattern's score is the share of the
   accepted instances among all that follows it in the corpus, whatever that is: a second pass counts how often
   each pattern that has enough instances occurs in front of any word. So a stop word scores near 0 however few
   numbers are about. Patterns of high score with enough different accepted instances are trusted, and their
   instances accepted; that goes on until nothing more is trusted. Accepted instances stay, so it ends.
3. An identifier-like token in a trusted pattern is a new entity (kind `context`).
DataFrame operations only; no text is shuffled, and pairs (pattern, instance) are aggregated before joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import WS, keep, let, table
from quillcast.llm.spans import digest, find_spans, tagged

KINDS = ["email", "ip", "card", "phone", "context"]
# The look-behinds only spare the search positions at which no leftmost match can start; possessive
# quantifiers take no stack on very long runs. Neither changes a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TOKEN = rf"(?<![^{WS}])[^{WS}0-9]*+[0-9][^{WS}]*+"
#: Bounds of the bootstrap: least score and least number of different accepted instances of a pattern, characters
#: and digits of an identifier. A pattern is trusted if at most about 1.5 other things follow it for each accepted one.
#: A word and a shape are a pattern only if one in 1 / RATE words after that word looks like an identifier.
CONFIDENCE, SEEDS, LENGTH, DIGITS, RATE = 0.4, 5, 6, 4, 0.05
#: Bits of the sieve through which the second pass looks for patterns; its size does not grow.
SIEVE = 1 << 17


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """True if a string of digits has Luhn's check digit."""
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_entities(text: Column) -> Column:
    """A struct with an array of (s, e, t, l2, l1, r) for each base kind; matches that fail their check are dropped."""

    spans = lambda p: find_spans(text, p, context=True)

    def is_card(x: Column) -> Column:
        return let(digits(x["t"]), lambda d: F.length(d).between(14, 19) & luhn(d))

    return F.struct(
        spans(EMAIL).alias("email"),
        F.filter(spans(IP), lambda x: x["t"].rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")).alias("ip"),
        F.filter(spans(CARD), is_card).alias("card"),
        F.filter(spans(PHONE), lambda x: F.length(digits(x["t"])).between(10, 15)).alias("phone"),
    )


def shape(t: Column) -> Column:
    """A token with every digit as 9, every capital as A and every stretch of other letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]+", "a")


def patterns(x: Column) -> Column:
    """The patterns of an instance (t, l2, l1, r) by its context; those that lack a word are left out."""
    both = [F.concat(F.lit("1 "), x["l1"]), F.concat(F.lit("2 "), x["l2"], F.lit(" "), x["l1"]), F.concat(F.lit("3 "), x["l1"], F.lit(" "), x["r"]), F.concat(F.lit("4 "), x["l1"], F.lit(" "), shape(x["t"]))]
    return F.filter(F.array(*both), lambda p: p.isNotNull())


def find_entities(docs: DataFrame) -> DataFrame:
    """A stored table with, for every row of docs(doc_id, text): rid, doc_id, base, seeds, tokens."""

    def rest(b: Column, text: Column) -> Column:
        whole = F.concat(b["email"], b["ip"], b["card"], b["phone"])
        free = lambda x: ~F.exists(whole, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        likely = F.filter(find_spans(text, TOKEN, context=True), lambda x: (F.length(x["t"]) >= LENGTH) & (F.length(digits(x["t"])) >= DIGITS) & free(x))
        named = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.sha2(x["t"], 256).alias("v"), patterns(x).alias("p")))
        return F.struct(b.alias("base"), named(whole).alias("seeds"), named(likely).alias("tokens"))

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text)
    return keep(rows.select("rid", "doc_id", let(base_entities(F.col("text")), lambda b: rest(b, F.col("text"))).alias("x")).select("rid", "doc_id", "x.*"), "entities")


def sieve_of(names: DataFrame) -> Column:
    """A literal of SIEVE bits, in which those of the hashes of `p` are set: a filter without false negatives."""
    h = F.pmod(F.xxhash64("p"), F.lit(SIEVE))
    words = names.select(F.shiftright(h, 6).cast("int").alias("at"), F.pmod(h, F.lit(64)).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("x"))
    bits = np.zeros(SIEVE // 64, np.int64)
    for r in words.collect():  # at most SIEVE / 64 rows
        bits[r["at"]] = r["x"]
    return F.lit(bits)


def in_sieve(bits: Column, p: Column) -> Column:
    h = F.pmod(F.xxhash64(p), F.lit(SIEVE))
    return F.getbit(F.get(bits, F.shiftright(h, 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def background(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p, n_all) for each pattern of a stored table wanted(p) by words alone: before how many words of all texts it stands."""
    by_words = wanted.filter(~F.col("p").startswith("4 "))
    first = sieve_of(by_words.select(F.element_at(F.split("p", " "), F.when(F.col("p").startswith("2 "), 3).otherwise(2)).alias("p")).distinct())
    whole = sieve_of(by_words)
    trimmed = F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))

    def at(w: Column, i: Column) -> Column:
        l1 = F.get(w, i - 1)
        both = F.array(F.concat(F.lit("1 "), l1), F.concat(F.lit("2 "), F.get(w, i - 2), F.lit(" "), l1), F.concat(F.lit("3 "), l1, F.lit(" "), F.get(w, i + 1)))
        return F.filter(both, lambda p: p.isNotNull() & in_sieve(whole, p))

    def found(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: in_sieve(first, F.get(w, i - 1)))
        return F.when(F.size(w) > 1, F.flatten(F.transform(places, lambda i: at(w, i)))).otherwise(F.array().cast("array<string>"))

    seen = docs.select(F.explode(let(F.split(trimmed, rf"[{WS}]+"), found)).alias("p")).groupBy("p").agg(F.count("*").alias("n_all"))
    return by_words.join(seen, "p", "left").select("p", F.coalesce("n_all", F.lit(0)).alias("n_all"))


def trusted_patterns(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(p, score, n_accepted): the patterns that are trusted when nothing more is. docs(text) are the texts of `found`.

    Only patterns with SEEDS different instances are counted in the texts; others can't be trusted."""
    of = lambda c, seed: found.select(F.explode(c).alias("x")).select("x.v", F.explode("x.p").alias("p"), F.lit(seed).alias("seed"))
    edges = of("seeds", True).union(of("tokens", False)).groupBy("p", "v").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = keep(edges, "edges")
    # An instance is a seed wherever it occurs.
    seeds = keep(edges.filter("seed").select("v").distinct(), "seeds")
    wanted = keep(edges.groupBy("p").agg(F.count("*").alias("n_v"), F.sum("n").alias("n_own")).filter(F.col("n_v") >= SEEDS), "wanted")
    n_all = keep(background(docs, wanted), "background")
    # A seed of several words is more than one word to the count of all; it counts itself at least.
    counted = wanted.join(n_all, "p").select("p", "n_own", F.greatest("n_own", "n_all").alias("n_all"))
    # The shape's pattern has as many instances as its word's at most, so the word was counted.
    rare = counted.filter(F.col("p").startswith("1 ") & (F.col("n_own") < RATE * F.col("n_all"))).select(F.split("p", " ")[1].alias("l1"))
    shapes = wanted.filter(F.col("p").startswith("4 ")).withColumn("l1", F.split("p", " ")[1]).join(rare, "l1", "left_anti").select("p", F.col("n_own").alias("n_all"))
    total = counted.select("p", "n_all").union(shapes)
    edges = keep(edges.join(total, "p").select("p", "v", "n", "n_all"), "edges")
    accepted, last = seeds.withColumn("accepted", F.lit(True)), -1
    while True:
        own = edges.join(accepted, "v", "left").groupBy("p", "n_all").agg(F.sum(F.when(F.col("accepted"), F.col("n"))).alias("n_good"), F.count("accepted").alias("n_accepted"))
        score = F.col("n_good") / (F.col("n_all") + 2)
        good = keep(own.withColumn("score", score).filter((F.col("score") >= CONFIDENCE) & (F.col("n_accepted") >= SEEDS)).select("p", "score", "n_accepted"), "patterns")
        now = good.count()
        if now == last:
            return good
        new = edges.join(good, "p", "left_semi").select("v").union(accepted.select("v")).distinct()
        accepted, last = keep(new.withColumn("accepted", F.lit(True)), "instances"), now


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, base, context) for every row of docs(doc_id, text): base is a struct of arrays of (s, e, t, l2, l1, r),
    context an array of (s, k, e).

    A null or empty text has none; rows are kept apart even where doc_id repeats or is null; a table
    without seeds finds no patterns and no further entities."""
    found = find_entities(docs)
    good = keep(trusted_patterns(docs.select("text"), found).select("p"), "trusted")
    tokens = found.select("rid", F.explode("tokens").alias("x")).select("rid", "x.s", "x.e", F.explode("x.p").alias("p"))
    # One row for each token that is found, and at most as many for a document as it has tokens.
    new = tokens.join(good, "p", "left_semi").select("rid", "s", "e").distinct()
    new = new.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e"))).alias("context"))
    return found.join(new, "rid", "left").select("doc_id", "base", F.coalesce("context", F.array().cast("array<struct<s: int, k: int, e: int>>")).alias("context"))


def op6_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sort_array(F.concat(*(tagged(k, F.col(f"base.{n}")) for k, n in enumerate(KINDS[:4]))))
    every = F.sort_array(F.concat(base, F.transform("context", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))
    return found.select(
        "doc_id", *(F.size(f"base.{n}").cast("long").alias(f"n_{n}") for n in KINDS[:4]),
        F.sha2(digest(base, KINDS), 256).alias("base_sha256"), digest(every, KINDS).alias("spans"),
    )
