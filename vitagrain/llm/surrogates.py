"""Keyed surrogates for personal data, in SQL functions only.

Detection is one pattern over whole texts: e-mail addresses, labelled secrets
and access keys, bank and card numbers, identity and telephone numbers, network
addresses of both versions, and names behind a title. Where a document has a
titled name, every other capitalised or upper-case mention of its parts in that
document is an entity too. Every entity splits into literal parts and units; a
unit is its type and canonical form (digits only, lower case), so all spellings
of one entity share a unit and stay the same entity afterwards.

A unit's surrogate is a keyed hash rendered in its type: digits for digits with
separators and length kept (the first digit and the check digit of a card number
stay valid), letters for letters in their case, names from lists of the same
script and of the gender that the titles tell (neutral where they differ). Units are distinct rows of the
corpus; a surrogate that another unit of its type has, or that is itself a unit
of the corpus, is drawn again with the next attempt number until none collides, so different
entities stay different. Later attempts have room for any number of units: names
take syllables (as many from the start as the number of names asks for), e-mails
and secrets letters, telephone and identity numbers digits at their end.

Texts without an entity pass by; of the others only entities travel to the
units, and the text meets its replacements once.

Defined cases: null and empty texts stay; very long texts are taken whole;
repeated rows and null ids get the same replacement for the same entity; an
empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import fresh, shared_folder, written

#: The setting that holds the secret key; KEY stands in where neither it nor the caller gives one, as in tests.
KEY_SETTING, KEY = "spark.vitagrain.surrogateKey", "vitagrain"
LEAST_ID = -(1 << 63)
#: Titles by the gender they tell, per script.
MALE = "Mr Herr Señor Sr Monsieur Signor Don г-н господин κ".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Madame Mme Signora Doña г-жа госпожа κα".split()
NEUTRAL = "Dr Prof Professor Mx др проф".split()
#: Surrogate names by gender and script.
NAMES = {
    "male-latin": "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jakob Karl Louis Martin Noel Oscar Paul".split(),
    "female-latin": "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Katja Laura Maria Nora Olga Paula".split(),
    "neutral-latin": "Alex Andrea Bente Charlie Dominique Eden Florin Gabriel Jamie Kim Lou Mika Noa Robin Sam Toni".split(),
    "surname-latin": "Abel Brandt Costa Dumont Ebert Fontana Garner Hofer Iversen Jansen Keller Lorenz Mercer Nolan Ortega Palmer".split(),
    "male-cyrillic": "Антон Борис Виктор Григорий Денис Егор Игорь Кирилл Леонид Максим Никита Олег Павел Роман Семён Фёдор".split(),
    "female-cyrillic": "Алина Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Марина Нина Ольга Полина Раиса София".split(),
    "surname-cyrillic": "Авдеев Белов Власов Громов Дроздов Ершов Жуков Зимин Климов Лебедев Морозов Носов Орлов Попов Рябов Соколов".split(),
    "neutral-cyrillic": "Валя Женя Саша Шура Паша Слава".split(),
    "neutral-greek": "Αριάδνη Φώτης Χάρης Ίρις".split(),
    "male-greek": "Άγγελος Βασίλης Γιάννης Δημήτρης Κώστας Λευτέρης Μάνος Νίκος".split(),
    "female-greek": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία".split(),
    "surname-greek": "Αλεξίου Βλάχος Γεωργίου Δήμου Καλογήρου Λάμπρου Μάρκου Νικολάου".split(),
}
SYLLABLES = {"latin": "ba ce di fo gu ha ke li mo nu pa re si to va we".split(),
             "cyrillic": "ба ве ги до жу за ки ле мо ну па ре си то фу ха".split(),
             "greek": "βα γε δι ζο θυ κα λε μι νο πα ρε σι το φα χε ψι".split()}
TITLES = "|".join(t.replace("-", r"\-") for t in MALE + FEMALE + NEUTRAL)
FIRSTS = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
#: (type, pattern); the first that fits at a place wins. Tests of the first character keep the scan cheap.
#: An address is not tried again from the middle of a run that has no at sign, and a domain has 128 labels at
#: most (a name of 253 characters has no more): long runs of labels neither take quadratic time nor the stack.
KINDS = (
    ("email", r"(?<![\p{L}0-9])(?=[\p{L}0-9])(?>(?<![._%+\-])|(?<![\p{L}0-9][._%+\-]{1,40})|(?<=@[\p{L}0-9._%+\-]{1,253}))[\p{L}0-9][\p{L}0-9._%+\-]*+@[\p{L}0-9\-]++(?:\.[\p{L}0-9\-]++){0,126}\.\p{L}{2,}"),
    ("secret", r"\b(?=[PpSsTtAa])(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{4,}"),
    ("access", r"\b(?:A[KS]IA[0-9A-Z]{16}\b|(?:sk|ghp|xox[abp])[_\-][0-9A-Za-z_\-]{16,})"),
    ("bank", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("address6", r"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z_:.])(?=[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
                 r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:"
                 r"|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z_:])"),
    ("address", r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b(?!\.[0-9])"),
    ("identity", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("card", r"\b[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}\b|\b3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}\b"),
    ("phone", r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)|\b[0-9]{2,4})[ .\-][0-9]{3,4}[ .\-][0-9]{3,5}\b"
              r"|\+[0-9]{1,3}(?:[ .\-]?[0-9]{6,12}|[ .\-/]?\(?[0-9]{1,5}\)?[ .\-/]?[0-9]{5,9}|[ .\-][0-9](?:[ .\-][0-9]{2}){4})\b"
              r"|\b0[0-9](?:[ .\-][0-9]{2}){4}\b|\(0[0-9]{1,4}\) ?[0-9]{5,9}\b|\b0[1-9][0-9]{1,3}[ /\-][0-9]{5,9}\b"
              r"|(?<![0-9.\-])[2-9][0-9]{2}-[0-9]{4}\b(?!-)|\b(?:1?[2-9][0-9]{9}|0[1-9][0-9]{8,10})\b"),
    ("name", rf"\b(?=[{FIRSTS}])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?"),
)
NUMBERS = ("address", "identity", "card", "phone")
PATTERN = "|".join([*(f"(?:{p})" for k, p in KINDS if k not in (*NUMBERS, "name")),
                    f"(?=[0-9+(])(?:{'|'.join(f'(?:{p})' for k, p in KINDS if k in NUMBERS)})", f"(?:{dict(KINDS)['name']})"])
DIGITS = ("bank", "address", "identity", "card", "phone")
#: Between the unit of a bare mention and its word, in `surface`.
BARE = "\x01"
#: What a name takes from the text behind it.
ENDING = r"(?:['’][sS]?|-)$"


HEX = "0123456789abcdef"
#: What stands for characters of texts that hold no letter or digit, and what later attempts append.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Attempts in the shape of the original, before characters are appended.
SHAPED, SHAPED_DIGITS = 2, 6
SECRET_LABEL = r"^((?i:password|passwd|pwd|secret|token|api[_\-]?key)\s{0,2}[=:]\s{0,2}[\"\']?)"


def _part(raw: Column, kind: Column, canon: Column, gender: Column | None = None) -> Column:
    gender = F.lit(None).cast("string") if gender is None else gender
    return F.struct(raw.alias("raw"), kind.alias("type"), canon.alias("canon"), gender.alias("gender"))


def _literal(raw: Column) -> Column:
    return _part(raw, F.lit(None).cast("string"), F.lit(None).cast("string"))


def _groups(surface: Column) -> Column:
    """The eight groups of a version 6 address, without leading zeros."""
    sides = F.transform(F.split(F.lower(surface), "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def with_parts(surfaces: DataFrame) -> DataFrame:
    """surface, kind and `parts`: raw text with its unit's type, canonical form and gender (null for what stays)."""
    surface = F.col("surface")
    kind = F.lit("other")
    for name, pattern in reversed(KINDS):
        kind = F.when(surface.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    kind = F.when(surface.rlike(f"^(?:given|surname){BARE}"), "bare").otherwise(kind)
    script = F.when(surface.rlike(r"\p{IsCyrillic}"), "cyrillic").when(surface.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    words = F.split(surface, " ")
    title = F.rtrim(words[0], F.lit("."))
    gender = F.when(title.isin(MALE), "male").when(title.isin(FEMALE), "female")
    given = _part(words[1], F.concat(F.lit("given-"), script), F.lower(words[1]), gender)
    ending = F.regexp_extract(surface, ENDING, 0)
    last = F.regexp_replace(F.element_at(words, -1), ENDING, "")
    surname = _part(last, F.concat(F.lit("surname-"), script), F.lower(last))
    lead = _literal(F.concat(words[0], F.lit(" ")))
    word = F.substring_index(surface, BARE, -1)
    bare = _part(word, F.concat(F.substring_index(surface, BARE, 1), F.lit("-"), script), F.lower(word))
    secret = F.regexp_replace(surface, SECRET_LABEL, "")
    label = F.regexp_extract(surface, SECRET_LABEL, 1)
    canon = F.when(F.col("kind").isin("address", "access"), surface).when(F.col("kind") == "address6", _groups(surface)).when(
        F.col("kind").isin(*DIGITS), F.upper(
            F.regexp_replace(surface, r"[^0-9A-Za-z]", ""))).otherwise(F.lower(surface))
    return surfaces.withColumn("kind", kind).select("surface", "kind", F.when(
        (F.col("kind") == "name") & (F.size(words) > 2), F.array(lead, given, _literal(F.lit(" ")), surname, _literal(ending))).when(
        F.col("kind") == "name", F.array(lead, surname, _literal(ending))).when(F.col("kind") == "bare", F.array(bare)).when(
        F.col("kind") == "secret", F.array(_literal(label), _part(secret, F.lit("secret"), secret))).otherwise(
        F.array(_part(surface, F.col("kind"), canon))).alias("parts"))


def _named(found: Column, given: bool) -> Column:
    """The given names, or the last names, of the titled names among a text's entities, as written and in capitals."""
    split = F.transform(F.filter(found, lambda x: x.rlike(f"^(?:{dict(KINDS)['name']})$")), lambda x: F.split(x, " "))
    if given:
        words = F.transform(F.filter(split, lambda x: F.size(x) > 2), lambda x: x[1])
    else:
        words = F.transform(split, lambda x: F.regexp_replace(F.element_at(x, -1), ENDING, ""))
    return F.array_distinct(F.concat(words, F.transform(words, F.upper), F.transform(words, F.initcap)))


def _with_bare(words: Column) -> Column:
    """The pattern of entities and of the words (letters, hyphens and apostrophes only) of a document."""
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))


def _value(stream: str, place: str) -> str:
    """SQL for a number from 0 to 255 out of a hexadecimal stream, by place."""
    at = f"(2 * ({place}) % 126)"
    return (f"(16 * (instr('{HEX}', substring({stream}, {at} + 1, 1)) - 1) "
            f"+ instr('{HEX}', substring({stream}, {at} + 2, 1)) - 1)")


def _shaped(text: str, stream: str = "stream") -> str:
    """SQL: every digit, capital and other letter replaced by another of its class, all else kept."""
    v = _value(stream, "i")
    return (f"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c BETWEEN '0' AND '9' THEN cast({v} % 10 AS string) "
            f"WHEN c BETWEEN 'A' AND 'Z' THEN chr(65 + {v} % 26) WHEN c RLIKE '[\\\\p{{L}}\\\\p{{N}}]' THEN chr(97 + {v} % 26) "
            f"ELSE c END), '')")


def _drawn(text: str, stream: str = "stream") -> str:
    """SQL: every character replaced by one of the alphabet."""
    return (f"array_join(transform(split({text}, ''), (c, i) -> substring('{ALPHABET}', 1 + {_value(stream, 'i')} % "
            f"{len(ALPHABET)}, 1)), '')")


def _hidden(text: str) -> str:
    """SQL: the shape of a text that has a letter or digit, else characters of the alphabet."""
    return f"IF({text} RLIKE '[\\\\p{{L}}\\\\p{{N}}]', {_shaped(text)}, {_drawn(text)})"


def _tail(after: int, kinds: int) -> str:
    """SQL: a keyed letter or digit (of the alphabet's last `kinds`) for every attempt beyond `after`."""
    return (f"array_join(transform(sequence(0, greatest(attempt - {after - 1}, 0)), (x, i) -> IF(i = 0, '', "
            f"substring('{ALPHABET[-kinds:]}', 1 + {_value('more', 'i')} % {kinds}, 1))), '')")


def _check_digit(body: str) -> str:
    """SQL: the Luhn digit that completes a string of digits."""
    doubled = "int(c) * 2 - IF(int(c) > 4, 9, 0)"
    return (f"cast((10 - aggregate(transform(reverse(split({body}, '')), (c, i) -> IF(i % 2 = 0, {doubled}, int(c))), "
            f"0, (s, x) -> s + x) % 10) % 10 AS string)")


def _bank(country: str, rest: str) -> str:
    """SQL: a bank number of the country whose two check digits leave 1 modulo 97."""
    step = "IF(c BETWEEN '0' AND '9', (s * 10 + int(c)) % 97, (s * 100 + ascii(c) - 55) % 97)"
    left = f"aggregate(split(concat({rest}, {country}, '00'), ''), 0, (s, c) -> {step})"
    return f"concat({country}, lpad(cast(98 - {left} AS string), 2, '0'), {rest})"


def drawn(units: DataFrame, key: str) -> DataFrame:
    """Units (type, canon, gender, attempt) with `new`, the canonical form of their surrogate."""
    made = units.withColumn("stream", F.sha2(F.concat_ws("\n", F.lit(key), "type", "canon", F.col("attempt").cast("string")), 512))
    made = made.withColumn("more", F.sha2("stream", 512))
    lists = {k: v for k, v in NAMES.items()}
    key_of = F.when(F.col("type").startswith("given-"), F.concat(
        F.coalesce("gender", F.lit("neutral")), F.lit("-"), F.substring_index("type", "-", -1))).otherwise(F.col("type"))
    names = F.create_map(*(x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    sounds = F.create_map(*(x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    made = made.withColumn("names", names[key_of]).withColumn("sounds", sounds[F.substring_index("type", "-", -1)])
    pick = _value("stream", "60")
    name = (f"lower(concat(get(names, {pick} % size(names)), array_join(transform(sequence(0, attempt), "
            f"i -> IF(i = 0, '', get(sounds, {_value('stream', 'i')} % 16))), '')))")
    local = "substring_index(canon, '@', 1)"
    mail = f"concat({_shaped(local)}, {_tail(SHAPED, 36)}, '@', get(array('example.com', 'example.net', 'example.org'), {pick} % 3))"
    address = "concat_ws('.', " + ", ".join(f"1 + {_value('stream', str(i))} % 254" for i in range(4)) + ")"
    address6 = "concat('2001:db8', " + ", ".join(
        f"':', regexp_replace(substring(stream, {4 * i + 1}, 4), '^0+(?=.)', '')" for i in range(6)) + ")"
    kept = "greatest(length(canon) - 10, 0)"
    trunk = (f"concat('0', translate(substring({_shaped('canon')}, 2, 1), '0', '7'), substring({_shaped('canon')}, 3), "
             f"{_tail(SHAPED_DIGITS, 10)})")
    phone = (f"IF(canon LIKE '0%', {trunk}, concat(substring(canon, 1, {kept}), translate(substring({_shaped('canon')}, {kept} + 1, 1), '01', '78'), "
             f"substring({_shaped('canon')}, {kept} + 2), {_tail(SHAPED_DIGITS, 10)}))")
    body = f"concat(substring(canon, 1, 1), substring({_shaped('canon')}, 2, length(canon) - 2))"
    bank = _bank("substring(canon, 1, 2)", f"substring({_shaped('canon')}, 5)")
    access = f"concat(substring(canon, 1, 4), {_hidden('substring(canon, 5)')}, {_tail(SHAPED, 36)})"
    secret = f"concat({_hidden('canon')}, {_tail(SHAPED, 36)})"
    identity = f"concat({_shaped('canon')}, {_tail(SHAPED_DIGITS, 10)})"
    new = (f"CASE WHEN names IS NOT NULL THEN {name} WHEN type = 'email' THEN {mail} WHEN type = 'address' THEN {address} WHEN type = 'address6' THEN {address6} "
           f"WHEN type = 'phone' THEN {phone} WHEN type = 'card' THEN concat({body}, {_check_digit(body)}) "
           f"WHEN type = 'bank' THEN {bank} WHEN type = 'access' THEN {access} WHEN type = 'secret' THEN {secret} "
           f"ELSE {identity} END")
    return made.withColumn("new", F.expr(new)).select("type", "canon", "gender", "attempt", "new")


def settled(units: DataFrame, key: str, folder: str) -> DataFrame:
    """type, canon and new of every unit; no two share a surrogate and none is the canonical form of another."""
    # names start with the syllables that give four times as many surrogates as there are names of the type
    many = units.where(F.col("type").contains("-")).groupBy("type").agg(F.count("*").alias("many"))  # a dozen rows
    first = F.greatest(F.ceil(F.log(16.0, 4.0 * F.col("many"))) - 1, F.lit(0)).cast("int")
    now = units.join(F.broadcast(many), "type", "left").select(
        "type", "canon", "gender", F.coalesce(first, F.lit(0)).alias("attempt"), F.lit(False).alias("done"))
    turn = 0
    while True:
        tried = drawn(now, key).join(now.select("type", "canon", "done"), ["type", "canon"])
        taken = tried.select("type", F.col("canon").alias("new"), F.lit(True).alias("in_use"))
        order = Window.partitionBy("type", "new").orderBy(F.desc("done"), "canon")
        judged = tried.join(taken, ["type", "new"], "left").withColumn(
            "clash", (F.row_number().over(order) > 1) | F.coalesce("in_use", F.lit(False)))
        judged = written(judged.select("type", "canon", "gender", "new", "attempt", "clash"), folder, f"units_{turn}")
        if not judged.where("clash").take(1):
            return judged.select("type", "canon", "new")
        now = judged.select("type", "canon", "gender", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"),
                            (~F.col("clash")).alias("done"))
        turn += 1


def replacements(surfaces: DataFrame, key: str, folder: str) -> DataFrame:
    """surface and `new_surface` of every distinct entity."""
    split = written(with_parts(surfaces), folder, "parts")
    pieces = split.select("surface", F.posexplode("parts").alias("place", "part")).select("surface", "place", "part.*")
    told = F.collect_set("gender")  # two values at most
    units = pieces.where("type IS NOT NULL").groupBy("type", "canon").agg(
        F.when(F.size(told) == 1, told[0]).alias("gender"))
    met = pieces.join(settled(units, key, folder), ["type", "canon"], "left")
    filled = ("array_join(transform(split(raw, ''), (c, i) -> IF(c RLIKE '[0-9A-Za-z]', substring(new, "
              "length(regexp_replace(substring(raw, 1, i + 1), '[^0-9A-Za-z]', '')), 1), c)), '')")
    digits = ", ".join(f"'{k}'" for k in DIGITS if k != "address")
    shown = F.expr(f"CASE WHEN new IS NULL THEN raw WHEN type IN ({digits}) THEN concat({filled}, substring(new, length(canon) + 1)) "
                   f"WHEN type NOT LIKE '%-%' THEN new WHEN raw = upper(raw) THEN upper(new) ELSE initcap(new) END")
    return met.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("shown")).select(
        "surface", F.array_join("shown.shown", "").alias("new_surface"))


def replace(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """The documents with surrogates for entities in `text` (and `n_chars`, if there is one, counted anew).

    count names a column for the number of entities of a text. The key is the caller's,
    else that of the setting KEY_SETTING; whoever knows it can tell surrogates of a guess.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    folder = shared_folder(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit(""))
    stem = fresh(docs, "entity_row")
    ident, mark, new, words = (f"{stem}_{x}" for x in ("id", "mark", "new", "words"))
    some = docs.where(text.rlike(PATTERN)).withColumns({
        ident: F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST_ID)), mark: F.xxhash64(text)})
    listed = some.select(F.col(ident).alias("id"), F.col(mark).alias("mark"), text.alias("text"),
                         F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"))
    listed = listed.withColumns({"given": _named(F.col("found"), True), "last": _named(F.col("found"), False)})
    listed = listed.withColumn("words", F.array_join(F.array_union("given", "last"), "|"))
    every = F.when(F.col("words") == "", F.col("found")).otherwise(
        F.regexp_extract_all("text", _with_bare(F.col("words")), F.lit(0)))
    bare = F.transform(every, lambda x: F.when(F.array_contains("given", x), F.concat(F.lit(f"given{BARE}"), x)).when(
        F.array_contains("last", x), F.concat(F.lit(f"surname{BARE}"), x)).otherwise(x))
    places = listed.select("id", "mark", F.nullif("words", F.lit("")).alias("words"), F.posexplode(bare).alias("place", "surface"))
    places = places.withColumn("words", F.when(F.col("place") == 0, F.col("words")))
    places = written(places, folder, "places")
    mapped = written(replacements(places.select("surface").distinct(), key, folder), folder, "mapped")
    met = places.join(mapped, "surface").groupBy("id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("place", "new_surface"))).alias("all"), F.max("words").alias("words"))
    met = met.select(F.col("id").alias(ident), F.col("mark").alias(mark), F.col("all.new_surface").alias(new),
                     F.col("words").alias(words))
    joined = some.join(met, [ident, mark]).withColumn(f"{stem}_between", F.when(
        F.col(words).isNull(), F.split(F.coalesce("text", F.lit("")), PATTERN, -1)).otherwise(
        F.split(F.coalesce("text", F.lit("")), _with_bare(F.col(words)), -1)))
    whole = F.array_join(F.transform(f"{stem}_between", lambda x, i: F.concat(
        x, F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    out = {"text": whole} | ({"n_chars": F.char_length(whole).cast("long")} if "n_chars" in docs.columns else {})
    changed = joined.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns),
                            *([F.size(new).alias(count)] if count else []))
    rest = docs.where(~text.rlike(PATTERN))
    return changed.unionByName(rest.withColumn(count, F.lit(0)) if count else rest)
