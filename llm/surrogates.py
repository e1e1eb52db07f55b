"""Surrogates for personal data (operator 5), in DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, telephone, social security, card and account
numbers, values given as password, token, secret or key, access keys with a known prefix,
and names after a form of address. Every
entity gets a replacement drawn from a keyed hash of its type and normal form, so the same
entity gets the same one everywhere (whatever its case or punctuation), and the format
stays: digits for digits, letters for letters in the same case and script, hex for hex,
octets within range, valid check digits for valid ones, a top-level domain and a country
code as they were, given names with the ending of their gender.

Names are replaced word by word, given and family names apart: "Mr John Smith", "Mr Smith" and
"Dr John Smith" share their surrogates, and a full name that stands after a form of address once is replaced
in the rest of its text too, without one. (A lone word of a name is not sought.) A
given name after a title without gender takes the gender that it has elsewhere in the corpus.

Collision checks: all distinct entities of the corpus are gathered with their
replacements; where two of one type meet, or a replacement is itself an entity of the
corpus, all but the first draw again until none is left. So distinct entities stay distinct. From the
``WIDER``-th draw on, replacements grow by a character each time (addresses take the form of IPv6),
so that free ones are found even where a format is used up.

Null texts stay null; texts without entities are untouched; very long texts are searched
whole; repeated rows change alike; ids are not used; empty tables give empty results;
further columns are kept, and ``n_replaced`` is replaced if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.keys import checkpoint, written

_HONORIFICS_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "г-н", "κ")
_HONORIFICS_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Madam", "г-жа", "κα")
_HONORIFICS_N = ("Dr", "Dra", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "д-р", "проф", "δρ")
_HONORIFIC = "|".join(sorted(_HONORIFICS_M + _HONORIFICS_F + _HONORIFICS_N, key=len, reverse=True))
#: Draws of the same form before replacements get longer; each longer one has at least five times the room, so drawing ends.
WIDER = 8
#: Alternatives are tried in this order; each starts at a boundary, so a search takes linear time.
PATTERN = "|".join(
    (
        r"(?<![\w.%+@-])[\w.%+-]{1,64}+@[\w-]{1,63}+(?:\.[\w-]{1,63}+)+",
        r"(?<![\w-])(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=~-]{6,}+",
        r"(?<![\w])(?:A[KS]IA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?!\w)",
        r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
        r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)",
        r"(?<![\w+])\+\d{8,15}(?!\w)",
        rf"(?<!\w)(?:{_HONORIFIC})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
    )
)
#: No entity is in a text without a match of this.
MAYBE = rf"[0-9@]|(?i:password|passwd|secret|token|key)|(?<!\w)(?:{_HONORIFIC})\.? "
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдклмнпрст", "greek": "βγδζκλμνπρστ"}
#: Last letters of given names.
_WOMEN, _MEN = {"latin": "a", "cyrillic": "а", "greek": "α"}, {"latin": "o", "cyrillic": "н", "greek": "ς"}


def entity_type(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"(?i)^(password|passwd|secret|token|api)"), "secret")
        .when(e.rlike(r"^(A[KS]IA|gh[opsu]_|sk-)"), "key")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d([ -]?\d){12,18}$"), "card")
        .when(e.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _fixed(kind: Column, e: Column) -> Column:
    """What stays at the front: a keyword, a country code, a form of address."""
    return (
        F.when(kind == "secret", F.regexp_extract(e, r"(?i)^([a-z_-]+\s*[=:]\s*[\"']?)", 1))
        .when(kind == "key", F.regexp_extract(e, r"^(A[KS]IA|gh[opsu]_|sk-)", 1))
        .when(kind == "phone", F.regexp_extract(e, r"^(\+\d{1,3})(?=[ .(-])", 1))
        .when(kind == "name", F.regexp_extract(e, rf"^((?:{_HONORIFIC})\.? )", 1))
        .otherwise("")
    )


def _ending(kind: Column, e: Column) -> Column:
    """What stays at the end: a top-level domain."""
    return F.when(kind == "email", F.regexp_extract(e, r"(\.[\w-]+)$", 1)).otherwise("")


def with_units(rows: DataFrame) -> DataFrame:
    """A row for each entity of ``rows``, or each word of a name: unit (its number), kind, body, before and after (what stays), gender, norm."""
    rows = rows.withColumn("kind", entity_type(F.col("entity")))
    rows = rows.withColumn("fixed", _fixed(F.col("kind"), F.col("entity"))).withColumn("ending", _ending(F.col("kind"), F.col("entity")))
    rows = rows.withColumn("body", F.expr("substring(entity, length(fixed) + 1, length(entity) - length(fixed) - length(ending))"))
    title = F.rtrim(F.regexp_replace("fixed", r"\.", ""))
    gender = F.when(title.isin(*_HONORIFICS_F), "f").when(title.isin(*_HONORIFICS_M), "m").otherwise("n")
    # hyphens and dots tell e-mail addresses, values and IP addresses apart, spacing does not tell numbers apart
    exact = F.col("kind").isin("email", "ip", "secret", "key")
    norm = F.concat_ws("|", F.when(F.col("kind") == "phone", F.col("fixed")).otherwise(""), F.when(exact, F.lower("body")).otherwise(flat(F.col("body"))), F.lower("ending"))
    rows = rows.withColumn("words", F.split("body", "[ -]")).withColumn("gaps", F.regexp_extract_all("body", F.lit("[ -]"), F.lit(0)))

    def word(w: Column, i: Column) -> Column:
        given = i < F.size("words") - 1
        before, after = F.when(i == 0, F.col("fixed")).otherwise(""), F.coalesce(F.get("gaps", i), F.lit(""))
        return F.struct(F.when(given, "given").otherwise("family").alias("kind"), w.alias("body"), before.alias("before"), after.alias("after"), F.when(given, gender).otherwise("").alias("gender"), F.lower(w).alias("norm"))

    whole = F.array(F.struct("kind", "body", F.col("fixed").alias("before"), F.col("ending").alias("after"), F.lit("").alias("gender"), norm.alias("norm")))
    units = F.when(F.col("kind") == "name", F.transform("words", word)).otherwise(whole)
    kept = [c for c in rows.columns if c not in ("kind", "fixed", "ending", "body", "words", "gaps")]
    return rows.select(*kept, F.posexplode(units).alias("unit", "u")).select(*kept, "unit", "u.*")


def flat(e: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))


def _digit_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    chars = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )


def with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``drawn``, the new body, to rows with the columns of :func:`with_units` and an ``attempt``."""
    rows = rows.withColumn("seed", F.sha2(F.concat_ws("\x00", F.lit(key), "kind", "gender", "norm", F.col("attempt").cast("string")), 256))
    rows = rows.withColumn("hex", F.col("body").rlike("^[0-9a-fA-F]{8,}[\"']?$"))
    number = F.col("kind").isin("phone", "card", "ssn")
    wider = F.repeat(F.when(number, F.lit("7")).otherwise(F.lit("e")), F.greatest(F.col("attempt") - (WIDER - 1), F.lit(0)))
    rows = rows.withColumn("chars", F.split(F.concat("body", wider), ""))
    # the number of the letter or digit, so that spacing does not change the draw
    rows = rows.withColumn("marks", F.transform("chars", lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)))
    rows = rows.withColumn("nth", F.transform(F.sequence(F.lit(1), F.greatest(F.size("marks"), F.lit(1))), lambda i: F.aggregate(F.slice("marks", 1, i), F.lit(0), lambda a, x: a + x)))
    named = F.col("kind").isin("given", "family")

    def pick(letters: str, h: Column) -> Column:
        return F.substring(F.lit(letters), (F.pmod(h, F.lit(len(letters))) + 1).cast("int"), F.lit(1))

    def draw(c: Column, i: Column) -> Column:
        h = F.xxhash64("seed", i)
        low = F.lower(c)
        syllable = F.when(F.pmod(i, F.lit(2)) == 0, _by_script(low, _VOWELS, pick, h)).otherwise(_by_script(low, _CONSONANTS, pick, h))
        letter = F.when(F.col("hex") & ~named, pick("abcdef", h)).when(named, syllable).when(low.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", h)).otherwise(syllable)
        letter = F.when(c == low, letter).otherwise(F.upper(letter))
        first_of_card = (F.col("kind") == "card") & (i == 1)
        return F.when(c.rlike(r"[0-9]"), F.when(first_of_card, c).otherwise(pick("0123456789", h))).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    rows = rows.withColumn("new", F.array_join(F.zip_with("chars", "nth", draw), ""))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.pmod(F.xxhash64("seed", i), F.lit(254)).cast("int") + F.lit(1)), ".")
    long_ip = F.concat(F.lit("fd"), F.substring("seed", 1, 2), *(x for i in range(7) for x in (F.lit(":"), F.substring(F.col("seed"), 4 * i + 5, 4))))
    digits = F.regexp_replace("new", "[^0-9]", "")
    valid = _digit_sum(F.regexp_replace("body", "[^0-9]", "")) % 10 == 0
    check = F.pmod(F.substring("new", -1, 1).cast("int") - _digit_sum(digits), F.lit(10)).cast("string")
    card = F.when(valid, F.concat(F.expr("substring(new, 1, length(new) - 1)"), check)).otherwise(F.col("new"))
    low, keep = F.lower("new"), lambda letter, h: F.lit(letter)
    last = F.when(F.col("gender") == "f", _by_script(low, _WOMEN, keep, low)).when(F.col("gender") == "m", _by_script(low, _MEN, keep, low)).otherwise(F.substring("new", -1, 1))
    given = F.concat(F.expr("substring(new, 1, length(new) - 1)"), last)
    new = F.when(F.col("kind") == "ip", F.when(F.col("attempt") < WIDER, octets).otherwise(long_ip)).when(F.col("kind") == "card", card).when((F.col("kind") == "given") & (F.length("new") > 1), given).otherwise(F.col("new"))
    return rows.withColumn("drawn", new).drop("seed", "hex", "chars", "marks", "nth", "new")


def _by_script(low: Column, letters: dict[str, str], pick, h: Column) -> Column:
    return F.when(low.rlike(r"\p{IsCyrillic}"), pick(letters["cyrillic"], h)).when(low.rlike(r"\p{IsGreek}"), pick(letters["greek"], h)).otherwise(pick(letters["latin"], h))


def _attempts(units: DataFrame, key: str) -> DataFrame:
    """(kind, gender, norm, attempt) for the units whose first replacement would clash; few, if any."""
    unit = ["kind", "gender", "norm"]
    forms = checkpoint(units.groupBy(*unit).agg(F.min(F.struct("body", "after")).alias("form")).select(*unit, "form.body", "form.after"))
    # a replacement must not be that of another unit or any unit of the corpus, whatever the punctuation
    plain = lambda c: flat(F.concat(c, F.when(F.col("kind").isin("given", "family"), "").otherwise(F.col("after"))))
    real = forms.select("kind", plain(F.col("body")).alias("flat")).distinct()
    current = forms.withColumn("attempt", F.lit(0))
    while True:
        again = checkpoint(with_surrogate(current, key).select(*unit, "attempt", plain(F.col("drawn")).alias("flat")))
        twice = again.groupBy("kind", "flat").agg(F.min(F.struct("norm", "gender")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        clash = again.join(twice, ["kind", "flat"]).where((F.col("norm") != F.col("owner.norm")) | (F.col("gender") != F.col("owner.gender"))).select(*unit)
        clash = checkpoint(clash.unionByName(again.join(real, ["kind", "flat"], "left_semi").select(*unit)).distinct())
        if clash.isEmpty():
            return again.where("attempt > 0").select(*unit, "attempt")
        hit = clash.withColumn("hit", F.lit(1))
        current = checkpoint(forms.join(again.select(*unit, "attempt"), unit).join(hit, unit, "left").withColumn("attempt", F.col("attempt") + F.coalesce("hit", F.lit(0))).drop("hit"))


def with_genders(units: DataFrame) -> DataFrame:
    """Given names after a title without gender get the one that they have elsewhere."""
    known = units.where("kind = 'given' and gender <> 'n'").groupBy("norm").agg(F.min("gender").alias("known"))
    gender = F.when((F.col("kind") == "given") & (F.col("gender") == "n"), F.coalesce("known", "gender")).otherwise(F.col("gender"))
    return units.join(known, "norm", "left").withColumn("gender", gender).drop("known")


def replace_personal_data(docs: DataFrame, *, text_col: str = "text", key: str = "k1") -> DataFrame:
    """``docs`` with all entities in ``text_col`` replaced, and ``n_replaced``."""
    docs = docs.drop("n_replaced", "_found")
    columns = docs.columns
    text = F.col(text_col)
    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # the texts are searched once
    marked = written(docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>"))))
    some = marked.where(F.size("_found") > 0).withColumn("_text", F.sha2(text, 256))
    # one row for each different text that holds entities
    lists = some.select("_text", "_found").dropDuplicates(["_text"])
    units = checkpoint(with_genders(with_units(lists.select("_text", F.posexplode("_found").alias("pos", "entity")))))
    attempts = checkpoint(_attempts(units, key))
    drawn = with_surrogate(units.join(attempts, ["kind", "gender", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))), key)
    drawn = checkpoint(drawn.select("_text", "pos", "unit", "kind", "entity", F.concat("before", "drawn", "after").alias("piece"), F.length("before").alias("fixed")))
    pieces = drawn.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("pos", "unit", "piece"))).alias("_new"))
    full = drawn.where("kind in ('given', 'family')").groupBy("_text", "pos").agg(F.min("entity").alias("entity"), F.sort_array(F.collect_list(F.struct("unit", "piece"))).alias("words"), F.max("fixed").alias("fixed")).where("size(words) > 1")
    full = full.select("_text", F.expr("substring(entity, fixed + 1)").alias("old"), F.expr("substring(array_join(words.piece, ''), fixed + 1)").alias("new"))
    bare = full.groupBy("_text", "old").agg(F.min("new").alias("new")).groupBy("_text").agg(F.sort_array(F.collect_list(F.struct(-F.length("old"), "old", "new"))).alias("_bare"))
    changed = some.join(pieces, "_text").join(bare, "_text", "left").withColumn("_parts", F.split(text, PATTERN))
    named = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x.old, F.lit(r"\E(?![\p{L}\p{N}])"))
    count = lambda n, p: F.aggregate("_bare", n, lambda m, x: m + F.size(F.regexp_extract_all(p, named(x), F.lit(0))).cast("long"))
    again = F.when(F.col("_bare").isNotNull(), F.aggregate("_parts", F.lit(0).cast("long"), count)).otherwise(0)
    changed = changed.withColumn("n_replaced", F.size("_found").cast("long") + again)
    swap = lambda p: F.aggregate("_bare", p, lambda t, x: F.regexp_replace(t, named(x), x.new))
    changed = changed.withColumn("_parts", F.when(F.col("_bare").isNotNull(), F.transform("_parts", swap)).otherwise(F.col("_parts")))
    rebuilt = F.concat(F.array_join(F.transform("_new", lambda x: F.concat(F.when(x.unit == 0, F.get("_parts", x.pos)).otherwise(""), x.piece)), ""), F.element_at("_parts", -1))
    changed = changed.withColumn(text_col, rebuilt).select(*columns, "n_replaced")
    same = marked.where(F.size("_found") == 0).select(*columns, F.lit(0).cast("long").alias("n_replaced"))
    return same.unionByName(changed)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_personal_data(docs)
