"""PII (10): detected entities get keyed surrogates of their type, format, gender and script.

Entities: e-mail, IPv4 and IPv6 addresses, IBANs, US social security numbers, payment cards, phone numbers, and personal names: a
given and family name after a title (with the title's gender, if it tells one, and the name's script), and in the same text each further
mention of such a given or family name that is written with a capital, titled or not.  An entity is (type, canonical value): formats of
one number, and capitals in an address, don't make another.  Its surrogate follows from a SHA-256 of key, type, value and attempt:
digits for digits, letters for letters, separators, capitals and lengths as found; phone numbers keep their country code, cards their first
digit and whether the Luhn sum holds, IBANs their country and whether the check digits hold; domains become names under the reserved
.example; names come from lists of their gender and script, or are built of its syllables.

Collision checks: over all entities of the input, a surrogate that another entity shares, or that is itself an entity found there, is
drawn again for all but one, until there is none.  So different entities stay different, and the same entity has one surrogate in
all rows (coreference).  Without the key surrogates can't be told.  A format may have fewer values than there are entities: one
without a surrogate after ATTEMPTS draws gets its type and 32 digits of its hash instead, which keeps it distinct but not like it.

Only DataFrame operations and SQL functions are used.

Defined results: a null text stays null; a text without entities stays as it is; overlapping patterns: the one that starts first, then in
the order above; a name that has stood after titles of several genders in a text counts as what stood first, and as a family name if it
was one; repeated rows and rows with equal texts get equal results; pseudonymise() keeps extra columns, but its own n_entities and
entity_types replace such columns; an empty table gives an empty result.
An address may have Latin, Cyrillic and Greek letters; ten or eleven digits without separators are a phone number after a word for one.
A run of more than 256 letters and digits before an @ is no address, a name part has 31 characters at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared
from .spans import bound, find, outside, rewrite

#: Patterns of entities, in order of preference.
LETTERS = r"A-Za-z0-9\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{Mn}"
EMAIL = rf"(?<![{LETTERS}])[{LETTERS}][{LETTERS}._%+-]{{0,255}}+@[{LETTERS}-]{{1,63}}(?:\.[{LETTERS}-]{{1,63}}){{1,126}}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
HEXES = "[0-9A-Fa-f]{1,4}"
# all eight groups, or some left out at one ::, and a digit among them, for words like face::add are names in programs
IP6 = rf"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{HEXES}(?::{HEXES}){{7}}|(?:{HEXES}:){{1,6}}(?::{HEXES}){{1,6}}|::{HEXES}(?::{HEXES}){{1,6}}|(?:{HEXES}:){{2,7}}:)(?![A-Za-z0-9:]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![A-Za-z0-9.+-])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![A-Za-z0-9])"
PHONE = r"(?<![A-Za-z0-9.])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9.])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,5}){2,5}(?![A-Za-z0-9])"
#: Digits without any separator, after a word that says what they are.
DIGITS = r"(?=[0-9]{10,11}(?![A-Za-z0-9]))(?<=(?i:phone|tel|telephone|telefon|mobile|cell|call|fax)(?:\x20(?i:no|nr|number))?[.:]{0,2}\x20{0,2})[0-9]{10,11}"
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "Κυρία")
#: Titles of either gender.
EITHER = ("Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор", "Δρ", "Δόκτωρ")
PART = r"\p{Lu}(?:[\p{L}-]{1,30}|'\p{Lu}[\p{L}-]{1,29})"
END = r"(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE + FEMALE + EITHER)}|M(?=\.))\.?\x20{PART}(?:\x20{PART})?{END}"
#: A word that may be a further mention of a name.
WORD = rf"(?<![\p{{L}}\p{{N}}]){PART}{END}"
TYPES = (("email", EMAIL), ("ip", IP), ("ip6", IP6), ("iban", IBAN), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("name", NAME))
#: Draws of a surrogate before a format counts as used up.
ATTEMPTS = 24
#: A key is hot if it holds 1 in HOT rows, and more than HOT; parts that the copies of a hot text are dealt into.
HOT, PARTS = 1000, 64
#: Every entity starts at a digit or where no ASCII letter or digit goes on: one look rejects all other places.
ANY = f"(?:(?=[0-9])|(?<![A-Za-z0-9]))(?:{'|'.join([*(f'(?:{p})' for _, p in TYPES), DIGITS])})"
#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl Daniel Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Niklas Oscar Paul Quentin Rafael Simon Tomas Victor".split(),
    ("f", "latin"): "Alma Beatrice Clara Diana Elena Flora Greta Hanna Irene Julia Katrin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Олег Павел Роман Сергей Фёдор".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Марина Нина Ольга Полина Раиса Софья Юлия".split(),
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θεοδώρα Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne".split(),
    "cyrillic": "ба бе би бо да де ди до га го жа же за ка ке ла ле ли ло ма ме ми мо на не ва".split(),
    "greek": "βα βε βι γα γε δα δε δι ζα θα κα κε λα λε λι μα με μι να νε πα πε ρα ρε σα σε".split(),
}


def _kind(value: Column) -> Column:
    return reduce(lambda out, x: out.when(value.rlike(f"^(?:{x[1]})$"), x[0]), TYPES[1:], F.when(value.rlike(f"^(?:{EMAIL})$"), "email")).otherwise("phone")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _marked(docs: DataFrame) -> DataFrame:
    """digest (of the text), spans (of entities), words (that may be further mentions): one row per text with entities."""
    body, name = F.col("body"), f"^(?:{NAME})$"
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def mentions(spans: Column) -> Column:
        """Words with a capital in what the entities leave of a text that names someone."""
        moved = lambda g, w: F.struct((g["start"] + w["start"]).alias("start"), (g["start"] + w["end"]).alias("end"), w["value"].alias("value"))
        words = F.transform(outside(body, spans), lambda g: F.transform(find(g["value"], WORD), lambda w: moved(g, w)))
        return F.when(F.exists(spans, lambda s: s["value"].rlike(name)), F.flatten(words)).otherwise(nothing)

    texts = docs.select(F.col("text").cast("string").alias("body")).select(F.md5("body").alias("digest"), "body", find(body, ANY).alias("spans")).where(F.size("spans") > 0)
    return shared(texts.select("digest", "spans", bound(F.col("spans"), mentions).alias("words")))


def occurrences(texts: DataFrame) -> DataFrame:
    """digest, start, end, value, type, canon: one row per entity of a distinct text that is _marked()."""
    rows = texts.select("digest", F.explode("spans").alias("s")).select("digest", "s.start", "s.end", "s.value").dropDuplicates(["digest", "start"]).withColumn("type", _kind(F.col("value")))
    names = rows.where("type = 'name'").withColumn("words", F.split("value", " "))
    title = F.regexp_replace(F.col("words")[0], r"\.", "")
    gender = F.when(title.isin(*MALE, "M"), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    parts = F.posexplode(F.slice("words", 2, 2)).alias("nth", "part")
    names = names.select("digest", "start", "end", "words", gender.alias("gender"), parts)
    begin = F.when(F.col("nth") + 2 == F.size("words"), F.col("end") - F.length("part")).otherwise(F.col("start") + F.length(F.col("words")[0]) + 1)
    family = F.col("nth") + 2 == F.size("words")
    sort = F.concat_ws("_", F.when(family, "family").otherwise(F.concat(F.lit("given_"), F.col("gender"))), _script(F.col("part")))
    names = names.select("digest", begin.alias("start"), (begin + F.length("part")).alias("end"), F.col("part").alias("value"), sort.alias("type"), F.lower("part").alias("canon"))
    known = names.groupBy("digest", "canon").agg(F.min(F.struct(F.col("type").startswith("given").alias("given"), "start", "type")).alias("x")).select("digest", "canon", "x.type")
    words = texts.select("digest", F.explode("words").alias("w")).select("digest", "w.start", "w.end", "w.value", F.lower("w.value").alias("canon")).dropDuplicates(["digest", "start"])
    again = words.join(known, ["digest", "canon"]).select("digest", "start", "end", "value", "type", "canon")
    value = F.col("value")
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    code = F.regexp_extract(value, r"^\+([0-9]{1,3})[\x20.(-]", 1)
    canon = F.when(F.col("type").isin("email", "ip6"), F.lower("value")).when(F.col("type") == "ip", value).when(F.col("type") == "phone", F.concat_ws("+", F.when(code != "", code), F.substring(plain, F.length(code) + 1, F.length(plain)))).otherwise(plain)
    return rows.where("type <> 'name'").select("digest", "start", "end", "value", "type", canon.alias("canon")).union(names).union(again)


def _stream(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that hang on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _like(value: Column, stream: Column) -> Column:
    """value with each digit and letter replaced by the stream's, in turn: Cyrillic and Greek letters by such ones, others by ASCII."""
    digits, letters = F.split(F.translate(stream, "abcdef", "381604"), ""), F.split(F.translate(stream, "0123456789", "ghijkmnpqr"), "")
    nth = lambda a, i: F.element_at(a, F.pmod(i, F.lit(64)) + 1)
    other = lambda i, alphabet: F.translate(nth(letters, i), "abcdefghijkmnpqr", alphabet)
    beyond = lambda c, i: F.when(c.rlike(r"\p{IsCyrillic}"), other(i, "абвгдежзиклмнопр")).when(c.rlike(r"\p{IsGreek}"), other(i, "αβγδεζηθικλμνξοπ")).when(c.rlike(r"\p{Ll}|\p{Lo}|\p{Mn}"), nth(letters, i)).when(c.rlike(r"\p{L}"), F.upper(nth(letters, i)))
    put = lambda c, i: F.when(c.rlike("[0-9]"), nth(digits, i)).when(c.rlike("[a-z]"), nth(letters, i)).when(c.rlike("[A-Z]"), F.upper(nth(letters, i))).otherwise(F.coalesce(beyond(c, i), c))
    return F.array_join(F.transform(F.split(value, ""), put), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda t, x: t + x), F.lit(10))


def _mod97(plain: Column) -> Column:
    """The number that digits and letters (A for 10, and on) make, modulo 97."""
    step = lambda t, c: F.pmod(F.when(c.rlike("[0-9]"), t * 10 + F.ascii(c) - 48).otherwise(t * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(plain, ""), F.lit(0), step)


def _surrogate(key: str) -> Column:
    """Of the columns type, canon and attempt, in the form of a canonical value."""
    kind, canon, attempt = F.col("type"), F.col("canon"), F.col("attempt")
    stream = _stream(key, kind, canon, attempt.cast("string"))
    number = lambda i: F.conv(F.substring(stream, 1 + 4 * i, 4), 16, 10).cast("int")
    domain = F.concat(F.translate(F.substring(_stream(key, F.lit("domain"), F.substring_index(canon, "@", -1)), 1, 12), "0123456789", "ghijkmnpqr"), F.lit(".example"))
    local = F.substring_index(canon, "@", 1)
    # a local part of few characters has few others like it: each attempt beyond the third adds one
    email = F.concat(_like(F.concat(local, F.repeat(F.lit("a"), F.greatest(attempt - 3, F.lit(0)))), stream), F.lit("@"), domain)
    ip = F.concat_ws(".", *[(F.pmod(number(i), F.lit(254)) + 1).cast("string") for i in range(4)])
    body = F.concat(F.substring(canon, 1, 1), F.expr("substring(canon, 2, length(canon) - 2)"))
    drawn = F.concat(F.substring(body, 1, 1), _like(F.substring(body, 2, 30), stream))
    missing = F.pmod(10 - _luhn(F.concat(drawn, F.lit("0"))), F.lit(10))
    card = F.concat(drawn, F.pmod(missing + F.when(_luhn(canon) == 0, 0).otherwise(1 + F.pmod(number(3), F.lit(9))), F.lit(10)).cast("string"))
    split = F.instr(canon, "+")
    phone = F.concat(F.expr("substring(canon, 1, instr(canon, '+'))"), _like(F.substring(canon, split + 1, F.length(canon)), stream))
    account = _like(F.substring(canon, 5, 40), stream)
    country = F.substring(canon, 1, 2)
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    holds = _mod97(F.concat(F.substring(canon, 5, 40), F.substring(canon, 1, 4))) == 1
    check = F.when(holds, check).otherwise(F.when(check == 98, 2).otherwise(check + 1))
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)
    hexes = F.split(stream, "")
    ip6 = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.element_at(hexes, i + 1))), "")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ip6", ip6).when(kind == "ssn", F.concat(F.lit("9"), _like(F.substring(canon, 2, 8), stream)))
    # each attempt beyond the second makes a longer name, so that there is always another
    def drawn_parts(names: list[str], n: int) -> Column:
        choice = F.array(*[F.lit(x) for x in names])
        place = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("-", stream, i), 256), 1, 6), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(1), n + F.greatest(attempt - 2, F.lit(0))), lambda i: F.element_at(choice, F.pmod(place(i), F.lit(len(names))) + 1))

    for (gender, script), names in GIVEN.items():
        out = out.when(kind == f"given_{gender}_{script}", F.lower(F.array_join(drawn_parts(names, 1), "-")))
    for script, syllables in SYLLABLES.items():
        out = out.when(kind == f"given_n_{script}", F.lower(F.array_join(drawn_parts(GIVEN["m", script] + GIVEN["f", script], 1), "-")))
        out = out.when(kind == f"family_{script}", F.array_join(drawn_parts(syllables, 3), ""))
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, canon, surrogate: different entities of a type have different surrogates, and none is an entity of its type."""
    # dealt by number, so that draws are spread whatever the size of the table
    entities = shared(entities.select("type", "canon").distinct().repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "canon"))
    drawn = shared(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)))
    for attempt in range(ATTEMPTS + 1):
        shares = drawn.groupBy("type", "surrogate").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").select("type", "surrogate", "first")
        real = drawn.join(entities.withColumnRenamed("canon", "surrogate"), ["type", "surrogate"], "left_semi").select("type", "canon")
        again = shared(drawn.join(shares, ["type", "surrogate"]).where("canon <> first").select("type", "canon").union(real).distinct())
        if again.isEmpty():
            break
        drawing = _surrogate(key) if attempt < ATTEMPTS else F.concat("type", F.lit("-"), F.substring(_stream(key, F.col("type"), F.col("canon"), F.lit("")), 1, 32))
        new = drawn.join(again, ["type", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", drawing)
        drawn = shared(drawn.join(again, ["type", "canon"], "left_anti").unionByName(new))
    return drawn.select("type", "canon", "surrogate")


def _render() -> Column:
    """The surrogate in the format of value: separators and capitals as found."""
    kind, value, new = F.col("type"), F.col("value"), F.col("surrogate")
    letters = F.split(F.regexp_replace(new, "[^A-Za-z0-9]", ""), "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct((state["n"] + own.cast("int")).alias("n"), F.concat(state["out"], F.when(own, F.get(letters, state["n"])).otherwise(c)).alias("out"))

    number = F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])
    upper = (value == F.upper(value)) & (F.length(value) > 1)
    return F.when(new.startswith(F.concat(kind, F.lit("-"))), new).when(kind.isin("iban", "ssn", "card", "phone"), number).when(kind.isin("email", "ip"), new).when((kind == "ip6") & ~upper, new).when(upper, F.upper(new)).otherwise(F.regexp_replace(F.initcap(F.regexp_replace(new, "-", " ")), " ", "-"))


def _hot(rows: DataFrame, *keys: str) -> DataFrame:
    """The values of keys that 1 in HOT rows, and HOT of them, hold: fewer than HOT, whatever the size of rows."""
    many = max(HOT, rows.count() // HOT)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > many).select(*keys)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs, all columns, with text rewritten, and n_entities, how many parts were replaced, and entity_types."""
    docs = docs.drop("n_entities", "entity_types")
    texts = _marked(docs)
    found = shared(occurrences(texts))
    known = surrogates(found, key)
    # what stands in a large share of all places is sent to the places instead of meeting them in one task
    hot = shared(known.join(F.broadcast(_hot(found, "type", "canon")), ["type", "canon"]))
    met = found.join(F.broadcast(hot), ["type", "canon"], "left")
    rest = met.where("surrogate IS NULL").drop("surrogate").join(known, ["type", "canon"])
    new = met.where("surrogate IS NOT NULL").unionByName(rest).select("digest", F.struct("start", "end", _render().alias("new"), "type").alias("s"))
    per_text = new.groupBy("digest").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("body", F.col(text).cast("string"))
    has = F.coalesce(F.col("body").rlike(ANY), F.lit(False))
    # texts of very many copies are dealt into parts, each of which gets the text's spans
    copied = shared(_hot(texts, "digest").withColumn("hot", F.lit(True)))
    per_text = per_text.join(F.broadcast(copied), "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), PARTS - 1).otherwise(0)))).drop("hot")
    changed = plain.where(has).withColumn("digest", F.md5("body")).join(F.broadcast(copied), "digest", "left")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64(*[c for c in names if c != text]), F.lit(PARTS))).otherwise(0).cast("int")
    changed = changed.withColumn("part", part).drop("hot").join(per_text, ["digest", "part"])
    columns = [F.col(c) for c in names if c != text]
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"]))), ",")
    changed = changed.select(*columns, rewrite(F.col("body"), F.col("spans")).alias(text), F.size("spans").cast("long").alias("n_entities"), kinds.alias("entity_types"))
    same = plain.where(~has).select(*columns, F.col("body").alias(text), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types"))
    out = changed.union(same).select(*names, "n_entities", "entity_types")
    return out.toDF(*docs.columns, "n_entities", "entity_types")
