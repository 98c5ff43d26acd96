"""Surrogates for personal data.  Built-in expressions only.

Detected: e-mail and IP addresses (four octets, or IPv6), payment cards, phone and social
security numbers, IBANs, and persons.  A person is what follows a title (up to five
capitalised words, initials and particles) or a common given name followed by a capitalised
word; in a document that names a person so, every later or earlier mention of one of these
words with a capital is a mention of that person too.  Every distinct value gets a
replacement derived from a secret key, so equal values agree in all documents, and a full
name agrees with its surname alone.  Within a document a word has one role: if it is a given
name anywhere it is one everywhere.  Replacements keep the kind and the format: digits for
digits, letters for letters, separators in place, a valid Luhn digit or IBAN check number
where the original had one, the country of an IBAN, the gender of title or given name, the
script of a name, its hyphens and its capitals.  Initials are rotated in their alphabet.

Collision checks: two values of one kind with one replacement, or a replacement that is
itself a value of the corpus, are drawn again with the next attempt number.  A value that
still clashes after ``MAX_ATTEMPTS`` draws, because its kind's space is nearly full, becomes
a mark such as ``[phone-0f3a...]``: distinct and the same everywhere, but out of format.

All patterns are linear: classes repeat possessively or within bounds, and no group repeats
without bound, so a text of any length neither stalls a task nor overruns its stack.  A local
part has at most 64 characters, a domain 253, a word of a name 40 letters; beyond that only
what fits is replaced.

Defined cases: a null text stays null; null ids are kept; texts without an entity are
returned as they are; repeated rows are rewritten alike; an empty table gives an empty
result; further columns are ignored by ``surrogates``.  Names in scripts without capitals,
names with neither title nor common given name, and small-letter mentions are not found.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, few, release, shuffle_count

# Titles by gender (n: either), particles, common given names by gender,
# given names and syllables of replacements by script, alphabets of initials.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "κ."),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "κα"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Rev", "д-р", "проф"),
}
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "du", "dos", "bin", "ibn", "al", "el", "zu", "ter")
KNOWN = {
    "m": ("James", "John", "Robert", "Michael", "David", "William", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Andrew", "Paul", "Kevin", "Brian", "George",
          "Edward", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Pierre", "Jacques", "Philippe", "Juan", "Carlos", "José", "Luis", "Miguel", "Pedro", "Иван", "Сергей", "Андрей",
          "Николай", "Дмитрий", "Александр", "Γιώργος", "Νίκος", "Δημήτρης", "Արամ", "Տիգրան"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Emily", "Anna", "Maria", "Helen", "Laura", "Julia", "Jane", "Emma",
          "Alice", "Ada", "Ursula", "Monika", "Petra", "Sabine", "Claudia", "Isabelle", "Sophie", "Camille", "Carmen", "Lucía", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Мария", "Анна",
          "Ελένη", "Μαρία", "Κατερίνα", "Անի", "Մարիամ"),
}
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "Damian", "Emil", "Felix", "Hugo", "Igor", "Leon", "Oscar", "Pascal", "Victor"), "f": ("Alma", "Bella", "Clara", "Diana", "Elena", "Flora", "Hanna", "Irene", "Lara", "Nora", "Paula", "Vera")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Лев"), "f": ("Алла", "Вера", "Галина", "Дарья", "Жанна", "Инна", "Лидия", "Нина")},
    "greek": {"m": ("Άρης", "Δήμος", "Ηλίας", "Κώστας", "Μάνος", "Πέτρος", "Σπύρος", "Τάσος"), "f": ("Άννα", "Γεωργία", "Δήμητρα", "Ζωή", "Ιωάννα", "Νίκη", "Ρένα", "Σοφία")},
    "armenian": {"m": ("Վահան", "Գրիգոր", "Հայկ", "Սուրեն"), "f": ("Նարե", "Լուսինե", "Սիրան", "Զարուհի")},
}
SYLLABLES = {
    "latin": ("ba", "den", "fal", "gor", "hil", "jan", "kel", "lor", "mar", "nev", "pol", "ren", "sil", "tam", "vor", "wel"),
    "cyrillic": ("ба", "вер", "гор", "дан", "зим", "кар", "лен", "мир", "нов", "пол", "ряб", "сав", "тим", "фед", "хар", "яр"),
    "greek": ("αλ", "βασ", "γερ", "δημ", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαβ", "ταρ", "φωτ", "χατ", "ψαρ", "ωρ"),
    "armenian": ("ար", "բեկ", "գոր", "դան", "զար", "թով", "կար", "հակ", "ման", "ներ", "պետ", "սար", "տիգ", "քոչ", "օհ", "վար"),
}
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "ԱԲԳԴԵԶԷԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՔՕ")

EDGE = r"(?![\p{L}\p{N}_])"
SP = r"[\x20\xA0]"
LETTER = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}&&\p{L}]"
CAPITAL = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}&&\p{Lu}]"


def _any(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
IP6 = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[A-Fa-f:]{0,38}\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
IP = rf"(?:{OCTET}\.){{3}}{OCTET}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"(?:\d{4}[\x20-]){3}\d{1,7}|\d{13,19}"
PHONE = r"\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?(?:[\x20.-]?\d{2,4}){2,4}|\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}|\d{3}[-.\x20]\d{3}[-.\x20]\d{4}"
TITLE = rf"(?:{_any(TITLES['m'] + TITLES['f'] + TITLES['n'])})\.?"
NO_TITLE = rf"(?!{TITLE}{EDGE})"
WORD = rf"{NO_TITLE}{CAPITAL}{LETTER}{{0,39}}+(?:[-‐]{LETTER}{{1,40}}+|['’]{CAPITAL}{LETTER}{{0,39}}+){{0,3}}+{EDGE}"
INITIAL = rf"{CAPITAL}\.(?:{CAPITAL}\.){{0,3}}+"
PARTICLE = rf"(?:(?:{_any(PARTICLES)}){SP})"
MORE = rf"(?:{SP}{PARTICLE}{{0,2}}+(?:{INITIAL}|{WORD})){{0,4}}+"
TITLED = rf"(?:{TITLE}{SP}){{1,3}}+{PARTICLE}{{0,2}}+(?:{INITIAL}{SP}?){{0,3}}+{WORD}{MORE}"
BARE = rf"(?=\p{{Lu}})(?:{_any(KNOWN['m'] + KNOWN['f'])})(?:{SP}{INITIAL})?{SP}{PARTICLE}{{0,2}}+{WORD}{MORE}"
PERSON = rf"(?=[\p{{Lu}}гдпκ])(?:{TITLED}|{BARE})"
START = r"(?<![\p{L}\p{N}_])"
ENTITY = rf"{START}(?:{EMAIL}|{IBAN}|{IP6}|{IP}|{SSN}|{CARD}|{PERSON}){EDGE}|(?<![\p{{L}}\p{{N}}_+])(?:{PHONE}){EDGE}"
# in documents with a person, words with a capital are looked up among its names
ENTITY_OR_WORD = rf"{ENTITY}|{START}{CAPITAL}{LETTER}{{1,39}}+{EDGE}"

MAX_ATTEMPTS = 20
DRAWS = 2048  # values drawn in a task


def _part(lit: Column, kind: Column | None, value: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(lit.alias("lit"), (none if kind is None else kind).alias("kind"), (none if value is None else value).alias("value"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").when(word.rlike(r"^\p{IsArmenian}"), "armenian").otherwise("latin")


def _parts(gap: Column, hit: Column) -> Column:
    """The literals and values of a match, in order: array of (lit, kind, value); a part
    without a kind is only its literal."""
    whole = (F.when(hit.contains("@"), "email").when(hit.rlike(f"^(?:{IP})$"), "ip").when(hit.rlike(f"^(?:{IP6})$"), "ip6").when(hit.rlike(f"^(?:{SSN})$"), "ssn")
             .when(hit.rlike(f"^(?:{CARD})$"), "card").when(hit.rlike(f"^(?:{IBAN})$"), "iban").when(hit.rlike(r"^[\d+(]"), "phone"))
    title = F.regexp_extract(hit, rf"^(?:{TITLE}{SP}){{0,3}}+", 0)
    rest = F.substring(hit, F.char_length(title) + 1, F.char_length(hit))
    known = lambda g: F.regexp_extract(rest, rf"^(?:{_any(KNOWN[g])}){EDGE}", 0) != ""
    titled = lambda g: title.rlike(rf"(?:^|{SP})(?:{_any(TITLES[g])})\.?{SP}")
    gender = F.when(titled("f"), "f").when(titled("m"), "m").when(known("f"), "f").when(known("m"), "m").otherwise("n")
    words = F.regexp_extract_all(rest, F.lit(rf"[^\x20\xA0]+{SP}?"), F.lit(0))
    runs, between = (lambda w: F.regexp_extract_all(w, F.lit(r"\p{L}+"), F.lit(0))), (lambda w: F.split(w, r"\p{L}+", -1))
    role = lambda x, at: F.when(F.char_length(x) == 1, "initial").when(at == F.size(words) - 1, F.concat_ws(":", F.lit("family"), _script(x))).otherwise(F.concat_ws(":", F.lit("given"), gender, _script(x)))
    spelled = lambda w, at: F.when(w.rlike(r"^\p{Ll}"), F.array(_part(w, None, None))).otherwise(
        F.concat(F.transform(runs(w), lambda x, i: _part(between(w)[i], role(x, at), x)), F.array(_part(F.element_at(between(w), -1), None, None))))
    named = F.concat(F.array(_part(F.concat(gap, title), None, None)), F.flatten(F.transform(words, spelled)))
    person = (title != "") | rest.contains(" ") | rest.contains(" ")
    return F.when(whole.isNotNull(), F.array(_part(gap, whole, hit))).when(person, named).otherwise(F.array(_part(gap, F.lit("word"), hit)))


def _canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions the same value."""
    return (F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, r"\D", ""))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "ip", value).otherwise(F.lower(value)))


def _picker(syllables: tuple[str, ...], number):
    return lambda i: F.array(*map(F.lit, syllables))[number(i) % len(syllables)]


def _draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical value, in canonical form."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)
    number = lambda i: F.conv(F.substring(digest, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int")
    chars = F.sequence(F.lit(1), F.greatest(F.char_length(canon), F.lit(1)))
    letter = lambda n, upper: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))

    def alike(fixed):
        def change(i):
            c = F.substring(canon, i, F.lit(1))
            return F.when(fixed(i), c).when(c.between("0", "9"), (number(i) % 10).cast("string")).when(c.between("a", "z"), letter(number(i), False)).when(c.between("A", "Z"), letter(number(i), True)).otherwise(c)
        return F.array_join(F.transform(chars, change), "")

    length = F.char_length(canon)
    tail = F.char_length(F.regexp_extract(canon, r"(\.[a-z]{2,24})$", 1))
    email = alike(lambda i: i > length - tail)
    phone = alike(lambda i: i <= length - 10)
    drawn = alike(lambda i: i <= 4)
    country, account = F.substring(canon, 1, 2), F.substring(drawn, F.lit(5), F.greatest(length - 4, F.lit(1)))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(_mod97(F.concat(F.substring(canon, F.lit(5), F.greatest(length - 4, F.lit(1))), F.substring(canon, 1, 4))) == 1, F.concat(country, check, account)).otherwise(alike(lambda i: i <= 2))
    first = alike(lambda i: i <= 1)
    card = F.when(_luhn(canon) % 10 == 0, F.concat(F.substring(first, F.lit(1), length - 1), ((10 - _luhn(F.concat(F.substring(first, F.lit(1), length - 1), F.lit("0"))) % 10) % 10).cast("string"))).otherwise(first)
    ip = F.concat_ws(".", (number(F.lit(1)) % 223 + 1).cast("string"), *((number(F.lit(i)) % 256).cast("string") for i in (2, 3, 4)))
    ip6 = F.array_join(F.transform(chars, lambda i: F.when(F.substring(canon, i, F.lit(1)) == ":", ":").otherwise(F.substring(F.lit("123456789abcdef"), number(i) % 15 + 1, F.lit(1)))), "")
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6)
    for script, syllables in SYLLABLES.items():
        syllable = _picker(syllables, number)
        built = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), syllable), "")
        # Russian surnames end by gender
        ending = F.when(canon.rlike("[ая]$"), "ова").otherwise("ов") if script == "cyrillic" else F.lit("")
        out = out.when(kind == f"family:{script}", F.concat(built, ending))
        for gender in ("m", "f", "n"):
            names = GIVEN[script].get(gender) or GIVEN[script]["m"] + GIVEN[script]["f"]
            # the first attempt takes a name from the list; later ones join syllables to it
            listed = F.lower(F.array(*map(F.lit, names))[number(F.lit(0)) % len(names)])
            out = out.when(kind == f"given:{gender}:{script}", F.concat(listed, F.when(attempt == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), syllable), ""))))
    return out.otherwise(alike(lambda i: F.lit(False)))


def _mod97(value: Column) -> Column:
    """The rest by 97 of digits and capitals, where A stands for 10 and Z for 35."""
    def add(rest, i):
        c = F.substring(value, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1))), F.lit(0), add)


def _luhn(digits: Column) -> Column:
    """The Luhn sum; a multiple of 10 is valid."""
    n = F.char_length(digits)

    def add(s, i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return s + F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def replacements(values: DataFrame, key: str, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, canon), distinct, to (kind, canon, sur); distinct within a kind, and no value of
    the corpus.  Only clashing values are drawn again; each round is written.  What clashes
    after the last round gets a mark of kind and digest."""
    # distinct values are few bytes and much work: they are spread by their number
    n = values.count()
    parts = min(shuffle_count(values.sparkSession), few(n, DRAWS))
    spread = values.repartition(parts, "kind", "canon")
    drawn = cut(spread.select("kind", "canon", F.lit(0).alias("attempt"), _draw(F.col("kind"), F.col("canon"), F.lit(0), key).alias("sur")), "pii-values", parts)
    known = values.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    for _ in range(attempts):
        order = Window.partitionBy("kind", "sur").orderBy("attempt", "canon")
        ranked = drawn.withColumn("place", F.row_number().over(order))
        marked = ranked.join(known.withColumn("real", F.lit(True)), (F.col("kind") == F.col("k")) & (F.col("sur") == F.col("c")), "left").withColumn(
            "clash", (F.col("place") > 1) | F.coalesce("real", F.lit(False))).select("kind", "canon", "attempt", "sur", "clash")
        checked = cut(marked, "pii-checked", few(n))
        if not checked.filter("clash").limit(1).count():
            return checked.select("kind", "canon", "sur")
        again = F.col("attempt") + F.when(F.col("clash"), 1).otherwise(0)
        redrawn = checked.select("kind", "canon", again.alias("attempt"), "sur", "clash").withColumn(
            "sur", F.when(F.col("clash"), _draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("sur")))
        before, drawn = drawn, cut(redrawn.select("kind", "canon", "attempt", "sur"), "pii-values")
        release(before)
        kept = checked
    mark = F.concat(F.lit("["), F.substring_index("kind", ":", 1), F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("mark"), "kind", "canon"), 256), 1, 24), F.lit("]"))
    return kept.select("kind", "canon", F.when(F.col("clash"), mark).otherwise(F.col("sur")).alias("sur"))


def _rotations(key: str) -> tuple[str, str]:
    """Capitals, and what stands for each: every alphabet is turned by a keyed number of places."""
    turned = []
    for k, letters in enumerate(ALPHABETS):
        by = int(hashlib.sha256(f"{key}\x1finitial\x1f{k}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        turned.append(letters[by:] + letters[:by])
    return "".join(ALPHABETS), "".join(turned)


def _like(kind: Column, value: Column, sur: Column) -> Column:
    """The replacement in the format of the mention."""
    every = F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1)))
    char = lambda i: F.substring(value, i, F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def lay(s, i):
        taken = F.when(kind == "iban", char(i) != " ").otherwise(char(i).between("0", "9"))
        return F.struct(F.concat(s["out"], F.when(taken, F.substring(sur, s["at"], F.lit(1))).otherwise(char(i))).alias("out"), (s["at"] + taken.cast("int")).alias("at"))
    laid = F.aggregate(every, start, lay, lambda s: s["out"])
    cased = F.array_join(F.transform(every, lambda i: F.when(char(i).between("A", "Z"), F.upper(F.substring(sur, i, F.lit(1)))).otherwise(F.substring(sur, i, F.lit(1)))), "")
    named = F.when((F.upper(value) == value) & (F.char_length(value) > 1), F.upper(sur)).when(F.lower(value) == value, F.lower(sur)).otherwise(F.initcap(sur))
    return (F.when(sur.startswith("["), sur).when(kind.isin("card", "phone", "ssn", "iban"), laid).when(kind.isin("email", "ip6"), cased).when(kind == "ip", sur).otherwise(named))


def surrogates(docs: DataFrame, key: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_entities (values replaced), text with all entities replaced.

    Texts are matched once and written in pieces; only values move to be joined, and only
    documents with an entity are put together again."""
    text = F.col(text_col)
    person = text.rlike(rf"{START}{PERSON}{EDGE}")
    hits = F.when(person, F.regexp_extract_all(text, F.lit(ENTITY_OR_WORD), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    tagged = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"), hits.alias("hits"), person.alias("person"))
    # zipped, so that a text is split once and not for each match; the last gap has no match
    between = F.when(F.col("person"), F.split("text", ENTITY_OR_WORD, -1)).otherwise(F.split("text", ENTITY, -1))
    pieces = F.flatten(F.transform(F.arrays_zip(F.col("hits").alias("h"), between.alias("g")), lambda x: F.when(x["h"].isNotNull(), _parts(x["g"], x["h"])).otherwise(F.array(_part(x["g"], None, None)))))
    found = cut(tagged.select("rid", "doc_id", F.when(F.size("hits") > 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("plain"), F.when(F.size("hits") > 0, pieces).alias("parts")), "pii-pieces")
    some = found.filter("parts is not null")
    every = cut(some.select("rid", F.posexplode("parts").alias("no", "p")).select("rid", "no", F.col("p.kind").alias("kind"), _canonical(F.col("p.kind"), F.col("p.value")).alias("canon")), "pii-mentions")
    # one role for each name of a document, and mentions of names without a title
    is_name, is_word = F.col("kind").rlike("^(?:given|family):"), F.col("kind") == "word"
    rank = F.when(F.col("kind").startswith("given:n"), 1).when(F.col("kind").startswith("given"), 0).otherwise(2)
    roles = every.filter(is_name).groupBy("rid", "canon").agg(F.min(F.struct(rank.alias("rank"), "kind")).alias("r")).select("rid", "canon", F.col("r.kind").alias("role"))
    named = every.filter(is_name | is_word).join(roles, ["rid", "canon"], "left").select("rid", "no", F.col("role").alias("kind"), "canon")
    other = every.filter(F.col("kind").isNull() | ~(is_name | is_word)).select("rid", "no", F.when(F.col("kind") != "initial", F.col("kind")).alias("kind"), "canon")
    n = every.count()
    mentions = cut(named.unionByName(other), "pii-resolved", few(n))
    # a given name after a neutral title goes with the same name after others, wherever these stand
    distinct = cut(mentions.filter("kind is not null").select("kind", "canon").distinct(), "pii-distinct", few(n))
    gendered = distinct.filter("kind rlike '^given:[mf]:'").groupBy("canon", F.substring_index("kind", ":", -1).alias("script")).agg(F.min("kind").alias("own"))
    neutral = distinct.filter("kind like 'given:n:%'").withColumn("script", F.substring_index("kind", ":", -1)).join(gendered, ["canon", "script"], "left")
    drawn = cut(distinct.filter("kind not like 'given:n:%'").select("kind", "canon").unionByName(neutral.filter("own is null").select("kind", "canon")), "pii-drawn", few(n))
    table = replacements(drawn, key).select(F.col("kind").alias("k"), F.col("canon").alias("c"), "sur")
    alias = neutral.filter("own is not null").select("kind", "canon", "own")
    shared = alias.join(table, (alias["own"] == table["k"]) & (alias["canon"] == table["c"])).select(alias["kind"].alias("k"), alias["canon"].alias("c"), "sur")
    renamed = cut(table.unionByName(shared), "pii-renamed", few(n))
    meant = mentions.filter("kind is not null")
    surs = meant.join(renamed, (meant["kind"] == renamed["k"]) & (meant["canon"] == renamed["c"])).select("rid", "no", "kind", "sur")
    none = F.lit(None).cast("string")
    surs = surs.unionByName(mentions.filter("kind is null").select("rid", "no", none.alias("kind"), none.alias("sur"))).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("no", "kind", "sur"))).alias("surs"))
    plain, turned = _rotations(key)
    rewritten = lambda p, s: F.concat(p["lit"], F.when(p["kind"] == "initial", F.translate(p["value"], plain, turned)).otherwise(
        F.coalesce(_like(s["kind"], p["value"], s["sur"]), p["value"], F.lit(""))))
    done = some.join(surs, "rid").select(
        "doc_id", F.size(F.filter("surs", lambda s: s["sur"].isNotNull())).cast("long").alias("n_entities"),
        F.array_join(F.zip_with("parts", "surs", rewritten), "").alias("text"))
    clean = found.filter("parts is null").select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.col("plain").alias("text"))
    return clean.unionByName(done)
