"""Secret scan with a randomness test battery.  Built-in expressions only.

Base kinds, leftmost non-overlapping per kind: ``assign`` (a key word, ``:`` or ``=``, a value
of 12 or more characters), ``access`` (AKIA keys of 18 or more) and ``hex`` (16 or more).
The method adds kind ``random``: runs of 20 or more key characters outside all base spans.
For each an encoding is inferred from its characters (``ENCODINGS``), and three statistics are
taken against that encoding's alphabet of k characters, L being the length:

* chi-squared uniformity, k/L * sum(n_c^2) - L;
* runs: changes of class between neighbours.  In encodings of letters alone the classes are
  vowels and consonants, which natural words alternate more than chance does; otherwise small
  letters, capitals and digits, which natural names change less (a capital that opens a word
  is no change);
* serial correlation of neighbouring places in the alphabet, times the root of L.

Each statistic is used twice.  Under the uniform distribution over the alphabet the classic
test must not reject (two-sided |z| of ``MAX_Z``; chi-squared by Wilson and Hilferty): what is
not random in its encoding is no key, such as alphabets in order, numbers or padded words.
Under natural text of that encoding, whose rates are the fixed values below, each gives a
one-sided p-value: how often natural text looks as random as this.  Fisher's method joins the
three, and Benjamini-Hochberg control at level ``FDR`` is made within classes of length,
since long strings give more power than short ones; it uses counts per (class, bin of log p),
so no class is ever sorted in one task.  Digits alone are numbers and are never added.

A run of any length is split into characters once and folded once, so the cost is linear.
Positions are code points, ends exclusive.  Defined cases: a null text is empty; null ids are
kept; documents without a match give zeros and empty strings; repeated rows are scanned each
for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

# The patterns of the contract, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
# A run of 16 or more hex digits is a match of HEX of that length, and a key of 18 or more
# one of ACCESS: both patterns are greedy over one class of characters.
LONG_HEX = r"[0-9a-f]{16,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

# Encodings in the order they are tried: name, pattern, alphabet in its order, whether it has
# letters of one case and nothing else.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", False),
    ("hex", r"^[0-9A-F]+$", "0123456789ABCDEF", False),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", True),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", True),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", False),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", False),
    ("base62", r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", False),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
)
DASHES = ("-_", "+/")  # the other spelling of base64's last two characters
VOWELS = "AEIOUYaeiouy"

FDR = 0.01
MAX_Z = 4.0
# Natural text: chance that two characters are equal in any alphabet of 26 or more, and index of
# coincidence (that chance times the alphabet's size) in poorer ones, chance that neighbours change class in
# letters alone (vowel or consonant) and in mixed encodings, and mean serial correlation of mixed ones
NATURAL_MATCH = 0.065
NATURAL_INDEX = 1.7
NATURAL_VOWELS = 0.62
NATURAL_CHANGE = 0.18
NATURAL_SERIAL = 0.35
BINS = 300  # tenths of a decade of p


def rates() -> dict[str, tuple[float, float, float]]:
    """For each encoding the size of its alphabet, the chance that two neighbours drawn from it
    uniformly change class, and the chance that two characters of natural text are equal."""
    out = {}
    for name, _, alphabet, letters in ENCODINGS:
        k = len(alphabet)
        equal = max(NATURAL_MATCH, NATURAL_INDEX / k)
        if letters:
            v = sum(c in VOWELS for c in alphabet) / k
            out[name] = float(k), 2 * v * (1 - v), equal
            continue
        small, capital, digit = (sum(f(c) for c in alphabet) / k for f in (str.islower, str.isupper, str.isdigit))
        # neighbours outside the classes do not count, nor does a small letter after a capital
        # digits alone never change class; they are not added, whatever their rate
        out[name] = float(k), small * capital + 2 * digit * (small + capital) or 0.5, equal
    return out


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Matches as structs: kind, number, characters between the match before and this one, match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h")
    gaps = F.split(text, pattern, -1).alias("g")
    empty = F.array().cast("array<struct<kind:int,no:int,gap:int,hit:string>>")
    # zipped, so that a text is split once and not for each match; the last gap has no match
    found = F.transform(F.arrays_zip(hits, gaps), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.char_length(x["g"]).alias("gap"), x["h"].alias("hit")))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["hit"].isNotNull())).otherwise(empty)


def _below(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _by_encoding(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("encoding") == name, F.lit(float(value))).otherwise(out)
    return out


def battery(hits: DataFrame) -> DataFrame:
    """Add encoding, chi2, changes, serial_z, uniform (whether no test rejects randomness) and p
    to rows with a column ``hit``."""
    body = F.translate(F.rtrim(F.col("hit"), F.lit("=")), *DASHES)
    named = F.lit(ENCODINGS[-1][0])
    for name, pattern, _, _ in reversed(ENCODINGS[:-1]):
        named = F.when(F.col("body").rlike(pattern), name).otherwise(named)
    coded = hits.withColumn("body", body).withColumn("encoding", named).withColumn("chars", F.split("body", ""))
    alone = F.col("encoding").isin("lower", "upper")
    alphabet_of = F.lit(ENCODINGS[-1][2])
    for name, _, alphabet, _ in ENCODINGS[:-1]:
        alphabet_of = F.when(F.col("encoding") == name, F.lit(alphabet)).otherwise(alphabet_of)
    place = F.transform("chars", lambda c: F.call_function("instr", F.col("letters"), c) - 1)
    kind_of = F.when(alone, F.transform("chars", lambda c: F.lit(VOWELS).contains(c).cast("int"))).otherwise(
        F.transform("chars", lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)))
    # one fold over (place, class): sums for the correlation and the changes of class
    pairs = F.arrays_zip(place.alias("v"), kind_of.alias("k"))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "s", "q", "lag", "changes", "v0", "v1")), F.lit(None).cast("int").alias("k"))

    def add(acc, x):
        v, k, was = x["v"].cast("long"), x["k"], acc["k"]
        opens = (was == 2) & (k == 1)
        change = F.coalesce((was != k) & (was < 3) & (k < 3) & ~opens, F.lit(False))
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q"), (acc["lag"] + F.when(acc["n"] > 0, v * acc["v1"]).otherwise(F.lit(0))).alias("lag"),
                        (acc["changes"] + change.cast("long")).alias("changes"), F.when(acc["n"] == 0, v).otherwise(acc["v0"]).alias("v0"), v.alias("v1"), k.alias("k"))

    folded = coded.withColumn("letters", alphabet_of).withColumn("pairs", pairs).withColumn("f", F.aggregate("pairs", zero, add))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0).cast("long"), lambda s, c: s + F.pow(F.char_length("body") - F.char_length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2)).cast("long"))
    stats = folded.select(*hits.columns, "encoding", squares.alias("squares"), "f.*").withColumnRenamed("k", "last")
    known = rates()
    n = F.col("n").cast("double")
    stats = stats.withColumns({**{c: _by_encoding({e: r[i] for e, r in known.items()}) for i, c in enumerate(("alphabet", "change", "match"))}, "squares": F.col("squares").cast("double")})
    k, letters = F.col("alphabet"), F.col("encoding").isin("lower", "upper")
    # lag-one correlation from whole sums: sum (a-m)(b-m) over neighbours, and sum (a-m)^2
    spread = n * F.col("q") - F.col("s") * F.col("s")
    lagged = n * F.col("lag") - F.col("s") * (2 * F.col("s") - F.col("v0") - F.col("v1")) + (n - 1) / n * F.col("s") * F.col("s")
    stats = stats.withColumns({"chi2": k / n * F.col("squares") - n, "serial_z": F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.lit(99.0))})
    # under uniform draws
    z_uniform = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    z_runs = (F.col("changes") - (n - 1) * F.col("change")) / F.sqrt((n - 1) * F.col("change") * (1 - F.col("change")))
    uniform = (F.abs(z_uniform) < MAX_Z) & (F.abs(z_runs) < MAX_Z) & (F.abs("serial_z") < MAX_Z)
    # under natural text: equal pairs vary more than a Poisson count, their variance is taken as twice the mean
    equal = n * (n - 1) / 2 * F.col("match")
    p_uniform = _below((F.col("chi2") - (k / n * (2 * equal + n) - n) + k / n) / (k / n * 2 * F.sqrt(2 * equal)))
    vowels = _below((F.col("changes") + 0.5 - (n - 1) * NATURAL_VOWELS) / F.sqrt((n - 1) * (NATURAL_VOWELS * (1 - NATURAL_VOWELS))))
    mixed = 1 - _below((F.col("changes") - 0.5 - (n - 1) * NATURAL_CHANGE) / F.sqrt((n - 1) * (NATURAL_CHANGE * (1 - NATURAL_CHANGE))))
    p_runs = F.when(letters, vowels).otherwise(mixed)
    p_serial = _below(F.abs("serial_z") - F.when(letters, 0.0).otherwise(F.sqrt(n) * NATURAL_SERIAL))
    joint = -(F.ln(F.greatest(p_uniform, F.lit(1e-30))) + F.ln(F.greatest(p_runs, F.lit(1e-30))) + F.ln(F.greatest(p_serial, F.lit(1e-30))))
    p = F.exp(-F.col("joint")) * (1 + F.col("joint") + F.col("joint") * F.col("joint") / 2)
    tested = stats.withColumns({"uniform": uniform & (F.col("encoding") != "decimal"), "joint": joint}).withColumn("p", F.when(F.col("uniform"), F.least(F.lit(1.0), p)).otherwise(F.lit(1.0)))
    return tested.select(*hits.columns, "encoding", "chi2", "changes", "serial_z", "uniform", "p")


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """Rows of ``tested`` that Benjamini-Hochberg control accepts in their class of length.

    The threshold table has a row per class, and classes are powers of two: at most 32 rows."""
    binned = tested.withColumn("length_class", F.floor(F.log2(F.char_length("hit").cast("double"))).cast("int")).withColumn(
        "bin", F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(F.col("p"), F.lit(1e-30))))).cast("int"))
    counts = binned.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("length_class")))
    limits = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("rank") / F.col("m")).groupBy("length_class").agg(F.min("bin").alias("least_bin"))
    return binned.join(F.broadcast(limits), "length_class").filter(F.col("bin") >= F.col("least_bin")).drop("length_class", "bin", "least_bin")


def scan(docs: DataFrame, id_col="doc_id", text_col="text", fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id and ``found``, the spans (start, kind, end) in order.

    Texts are scanned once; matches, few and short, are written and everything else works on
    them.  Positions come from running sums of gap and match lengths per document and kind, and
    overlaps with base spans from running ends and starts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [_found(text, p, k) for k, p in enumerate((ASSIGN, LONG_ACCESS, LONG_HEX, CANDIDATE))]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.concat(*every).alias("f"))
    hits = cut(rows.select("rid", "doc_id", F.explode_outer("f").alias("f")).select("rid", "doc_id", "f.*"), "secrets")
    before = Window.partitionBy("rid", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = hits.filter("kind is not null").withColumn("start", F.coalesce(F.sum(F.col("gap") + F.char_length("hit")).over(before), F.lit(0)) + F.col("gap"))
    spans = placed.withColumn("end", F.col("start") + F.char_length("hit")).drop("gap", "no")
    value = F.regexp_extract("hit", ASSIGN, 2)
    real = spans.filter((F.col("kind") != 0) | (F.char_length(value) >= 12))
    up, down = Window.partitionBy("rid").orderBy("start", "kind"), Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind"))  # growing frames, which cost a constant a row
    base = F.col("kind") < 3
    apart = real.withColumns({"reach": F.max(F.when(base, F.col("end"))).over(up.rowsBetween(Window.unboundedPreceding, -1)),
                              "next": F.min(F.when(base, F.col("start"))).over(down.rowsBetween(Window.unboundedPreceding, -1))})
    alone = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    apart = cut(apart.filter(base | alone).drop("reach", "next"), "secret-spans")
    added = discoveries(battery(apart.filter("kind = 3")), fdr).select("rid", "kind", "start", "end")
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("kind"), F.col("end").cast("long").alias("end"))
    grouped = apart.filter(base).select("rid", "kind", "start", "end").unionByName(added).groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("found"))
    ids = hits.groupBy("rid").agg(F.first("doc_id").alias("doc_id"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return ids.join(grouped, "rid", "left").select("doc_id", F.coalesce("found", nothing).alias("found"))


def spell(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
