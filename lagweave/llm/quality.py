"""Quality rules with host-level verdicts.  Built-in expressions only.

Per document: word and symbol counts, repeated lines and repeated three-word windows, and
from them four rules (``RULES``): too few words, too many words in repeated windows, too many
symbols per word, too many repeated lines.  The first two fail a document by themselves.
Per host and rule: the share of documents that fail, shrunk with a beta prior that is fitted
to all hosts by the method of moments, rule by rule.  A host is rejected, with all of its
documents, when one of its shrunken shares reaches that rule's limit: more than half of what
it serves is then expected to fail.

Defined cases: a null text has no words and fails; null ids are kept; a null host is a host of
its own; ties and repeated rows are judged row by row; a very long text is judged whole, at
n log n in its words; an empty table gives an empty result; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, SPACE_CHARS, cut, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10  # of the number of words
MAX_DUP_LINE_PERCENT = 30  # of the lines with a word
LEAST_PRIOR, MOST_PRIOR = 4.0, 1000.0  # documents that a prior counts as
RULES = ("short", "repeats", "symbols", "lines")
HOST_LIMITS = {"short": 0.5, "repeats": 0.5, "symbols": 0.5, "lines": 0.5}


def features(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", whole_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, host, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, base_failed and a column fails_<rule> for each rule; with ``whole_rows`` also the input row as struct ``row``.

    Repeated windows: three-word windows are compared by 64-bit hash.  Sorting (hash,
    position) pairs puts equal windows side by side; the positions found are sorted again,
    and each adds the words by which it goes beyond the one before it.  This is n log n per
    document and shuffles nothing; documents without a repeated window skip the sorts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    kept = ["row"] if whole_rows else []
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), words(F.col(text_col)).alias("w"), lines.alias("lines"),
        F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), *row)
    w = F.col("w")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    hashed = base.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(windows).alias("h"), *kept)
    h = F.col("h")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    paired = hashed.withColumn("p", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)).drop("h")
    p = F.col("p")
    repeated = F.filter(p, lambda e, j: (F.when(j > 0, p[j - 1]["x"]) == e["x"]) | (F.when(j < F.size(p) - 1, p[j + 1]["x"]) == e["x"]))
    placed = paired.withColumn("at", F.when(p.isNotNull(), F.sort_array(F.transform(repeated, lambda e: e["i"])))).drop("p")
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("before")), lambda s, x: F.struct(
        (s["n"] + F.least(F.lit(3), x - s["before"])).alias("n"), x.alias("before")))["n"]
    done = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    n = F.col("n_words")
    fails = {"short": n < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n, "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
             "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")}
    return done.withColumns({f"fails_{r}": fails[r] for r in RULES}).withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))


def rejected_hosts(feats: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Hosts that a rule rejects: host, n_docs, and n_<rule> and rate_<rule> for each rule.

    A rule's prior has the hosts' mean rate and the variance that sampling leaves unexplained.
    Only the one row of moments, three numbers a rule, reaches the driver.
    """
    limits = HOST_LIMITS if limits is None else limits
    hosts = feats.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES))
    share = {r: F.col(f"n_{r}") / F.col("n_docs") for r in RULES}
    moments = hosts.agg(F.avg(1.0 / F.col("n_docs")), *(f(share[r]) for r in RULES for f in (F.avg, F.var_pop))).first()
    bad = F.lit(False)
    for k, r in enumerate(RULES):
        alpha, beta = beta_prior(moments[1 + 2 * k] or 0.0, moments[2 + 2 * k] or 0.0, moments[0] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))
        bad = bad | (F.col(f"rate_{r}") >= limits[r])
    return hosts.filter(bad)


def beta_prior(mean: float, var: float, mean_inverse_n: float) -> tuple[float, float]:
    """Method of moments; the prior counts as 4 documents at least and 1,000 at most."""
    spread = mean * (1 - mean)
    own = var - spread * mean_inverse_n
    size = min(max(spread / own - 1, LEAST_PRIOR), MOST_PRIOR) if own > 0 else MOST_PRIOR
    return mean * size, (1 - mean) * size


def judge(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", host_limits: dict[str, float] | None = None, whole_rows: bool = False) -> DataFrame:
    """``features`` with ``kept``.  Features are computed once and written; host totals and
    the verdict join read that slim table.  The verdict side holds rejected hosts only; its
    measured size decides between broadcast and a shuffled join whose large keys AQE splits."""
    feats = cut(features(docs, id_col, text_col, host_col, whole_rows), "quality")
    bad = cut(rejected_hosts(feats, host_limits).select(F.col("host").alias("bad_host"), F.lit(True).alias("host_failed")), "bad-hosts")
    joined = feats.join(bad, feats["host"].eqNullSafe(bad["bad_host"]), "left").drop("bad_host")
    return joined.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judge(docs, whole_rows=True, **options).filter("kept").select("row.*")
